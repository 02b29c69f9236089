"""The registered queries of the training-data operators on the smallest tables, against DuckDB where SQL can say them."""

import glob
import os
from collections import Counter

import pytest

from sessionlake.llm.queries import QUERIES
from sessionlake.llm.sql import SQL

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables here")

COLUMNS = {
    "p1_found": ["event_id"],
    "p3_found": ["source_table", "record_id", "field", "line_no"],
    "p4_found": ["session_id"],
    "p5_found": ["id"],
    "p6_found": ["vec_rowid_a", "vec_rowid_b"],
    "p7_found": ["source_table", "record_id", "field", "pii_type"],
    "p8_ids": ["doc_id", "ids"],
    "p10_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    df = QUERIES[name](spark, BASE)
    assert df.columns == COLUMNS[name]
    rows = [str(tuple(r)) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{BASE}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, BASE)
    result = c.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(tuple(r[x] for x in columns) for r in df.collect()) == Counter(map(tuple, result.fetchall()))


def test_pieces_put_together_are_the_messages(spark):
    pieces = {}
    for r in QUERIES["p1_pieces"](spark, BASE).collect():
        pieces.setdefault(r["event_id"], []).append(r)
    texts = {r["event_id"]: r["text"] for r in spark.read.parquet(f"{BASE}/messages.parquet").collect() if r["text"] is not None}
    assert set(pieces) == set(texts)
    for event, parts in pieces.items():
        out, end = "", 0
        for p in sorted(parts, key=lambda p: p["piece_no"]):
            out += p["piece_text"][end - p["char_start"] :]
            end = p["char_end"]
        assert out == texts[event]


def test_containers_hold_every_document_once(spark):
    loads, covered = Counter(), Counter()
    capacity = {r["pack_id"]: r["capacity_tokens"] for r in spark.read.parquet(f"{BASE}/pack_limits.parquet").collect()}
    for r in QUERIES["p9_containers"](spark, BASE).collect():
        loads[r["pack_id"], r["container_no"]] += r["token_end"] - r["token_start"]
        covered[r["pack_id"], r["doc_id"]] += r["token_end"] - r["token_start"]
    sizes = {r["doc_id"]: len(r["ids"]) for r in QUERIES["p8_ids"](spark, BASE).collect()}
    assert all(v <= capacity[p] for (p, _), v in loads.items())
    assert covered == Counter({(p, d): n for p in capacity for d, n in sizes.items()})
