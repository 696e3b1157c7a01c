"""Embedding methods: each returns an Embedding with one vector for every node."""
