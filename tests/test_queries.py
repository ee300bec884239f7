"""Every registered query runs; every one with SQL equals it."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

PATH = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(PATH)


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, PATH)
    if name in SQL:
        assert difference(df, con, SQL[name]) is None
    else:
        assert len(df.columns) == len(set(df.columns)) and df.count() > 0
