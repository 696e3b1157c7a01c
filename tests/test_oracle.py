"""Every query that has SQL gives the same rows as DuckDB (the smallest scale has isolated nodes)."""

import pytest

from __spark_entry__ import oracle_sql, queries

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, con, name):
    assert compare(spark, con, queries()[name], oracle_sql()[name], SF) is None


def test_names():
    assert set(oracle_sql()) <= set(queries())
