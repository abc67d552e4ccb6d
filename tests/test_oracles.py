"""Every registered query with a SQL twin against DuckDB on the smallest tables."""

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, sf, con, name):
    msg, n = compare(queries()[name](spark, sf), con, oracle_sql()[name])
    assert msg is None, msg
    assert n > 0


def test_entry(spark):
    d = entry(spark)
    assert d.count() > 0 and "h_last" in d.columns


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
