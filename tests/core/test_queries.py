"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans.library import R

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(R.sql))
def test_equals_sql(spark, duck, name):
    got = R.queries[name](spark, DIR)
    want = duck.sql(R.sql[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    left = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    right = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert left == right


@pytest.mark.parametrize("name", sorted(set(R.queries) - set(R.sql)))
def test_runs(spark, name):
    assert R.queries[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
