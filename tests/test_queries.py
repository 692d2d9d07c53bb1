"""Every query that has SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tests.conftest import SF

SQL = __spark_entry__.oracle_sql()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    found, want = __spark_entry__.queries()[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


@pytest.mark.parametrize("name", sorted(__spark_entry__.queries().keys() - SQL.keys()))
def test_query_without_sql_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
