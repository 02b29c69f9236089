"""The registered queries against DuckDB on the smallest tables."""

import glob
import math
import os
from collections import Counter

import pytest

from sessionlake.plans.catalog import QUERIES, SQL

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables here")


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{BASE}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, BASE)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    theirs = Counter(tuple(_plain(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    QUERIES[name](spark, BASE).limit(5).collect()


def test_entry_has_every_query(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
