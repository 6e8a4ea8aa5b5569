"""Every registered query runs; those with a SQL twin give the same rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, difference, duck

SF = f"{DATA}/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_twins_belong_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert difference(got, con.execute(SQL[name]).fetchdf()) is None
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
