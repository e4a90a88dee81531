"""The driver contract: every query runs, and equals its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
import compare

FOLDER = "/root/testdata/sf0.001"
CORE = [n for m in entry.MODULES for n in m.QUERIES]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in compare.TABLES:
        if os.path.exists(f"{FOLDER}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toArrow()
    if sql := entry.oracle_sql().get(name):
        assert compare.canonical(got) == compare.canonical(con.sql(sql).to_arrow_table())
