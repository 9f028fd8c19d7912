"""Catalog queries against their SQL, on the smallest tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from askloom.catalog import registry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import TABLES, rows_of  # noqa: E402

QUERIES, SQL = registry.load()


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, db, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["query_id", "route", "context", "prompt", "canned_answer"]
    assert frame.count() == 40
