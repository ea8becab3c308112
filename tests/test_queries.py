"""Every registered query runs, and equals its SQL twin."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import __spark_entry__ as entry  # noqa: E402
from tools.check import rows  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in sorted(os.listdir(FOLDER)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, sql, name):
    frame = entry.queries()[name](spark, FOLDER)
    got = frame.collect()
    twin = entry.oracle_sql().get(name)
    if twin is None:
        assert got
        return
    result = sql.execute(twin)
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows(frame.columns, got) == rows(names, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "id", "distance"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
