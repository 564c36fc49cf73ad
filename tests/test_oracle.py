"""Every registered query that SQL can express, next to that SQL on another engine."""

import duckdb
import pytest

import check
from harborline.plans.catalog import QUERIES
from harborline.sources.domain import BASE_TABLES

SF_DIR = "/root/testdata/sf0.001"
WITH_SQL = [name for name, query in QUERIES.items() if query.sql is not None]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, con, name):
    text, _, _, ok = check.compare(name, spark, SF_DIR, con)
    assert ok, text


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(3).count() == 3
