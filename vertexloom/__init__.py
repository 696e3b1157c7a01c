"""Attributed-graph embedding and evaluation as Spark DataFrame jobs."""
