"""What the driver calls: names, SQL for known names only, and queries that run on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from spanloom.plans import registry

FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.queries()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_all_core_queries_run(spark):
    assert entry.entry(spark).count() > 0
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            connection.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    for name in registry.queries():
        got = entry.queries()[name](spark, FOLDER)
        n = got.count()
        if name in registry.sql():
            want = connection.execute(registry.sql()[name]).df()
            assert (name, sorted(got.columns), n) == (name, sorted(want.columns), len(want))
