"""Queries that must cover every record of their tables, on the smallest ones."""

import os

import pytest

from sessionlake.llm.queries import QUERIES

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables here")


def _stored(spark, fields):
    """Table, record and field of every record, with its text."""
    out = {}
    for name, key, columns in fields:
        for r in spark.read.parquet(f"{BASE}/{name}.parquet").collect():
            out |= {(name, r[key], c): r[c] for c in columns}
    return out


def _rewritten(spark, query, found, fields):
    """Asserts that a row comes out for each record and field, changed where ``found`` has it and nowhere else."""
    stored = _stored(spark, fields)
    rows = QUERIES[query](spark, BASE).collect()
    got = {(r["source_table"], r["record_id"], r["field"]): r["text"] for r in rows}
    assert len(rows) == len(got) and set(got) == set(stored)
    wanted = {(r["source_table"], r["record_id"], r["field"]) for r in QUERIES[found](spark, BASE).collect()}
    assert {k for k, t in got.items() if t != stored[k]} == wanted
    return {k[0] for k in wanted}


def test_every_credential_found_is_redacted(spark):
    fields = [("messages", "event_id", ["text"]), ("tool_calls", "id", ["input_text", "output_text"])]
    assert _rewritten(spark, "p3_redacted", "p3_found", fields) == {"messages", "tool_calls"}


def test_all_personal_information_found_is_masked(spark):
    fields = [("messages", "event_id", ["text"]), ("tool_calls", "id", ["output_text"])]
    assert _rewritten(spark, "p7_masked", "p7_found", fields) == {"messages", "tool_calls"}


def test_every_document_has_a_language_row(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()}
    passages = {r["doc_id"] for r in QUERIES["p10_passages"](spark, BASE).collect()}
    rows = QUERIES["p10_documents"](spark, BASE).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and passages < set(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        if r["doc_id"] in passages:
            assert r["lang"] and r["n_passages"] > 0 and 0 < r["confidence"] <= 1
        else:
            assert (r["lang"], r["confidence"], r["n_passages"]) == ("en" if any(map(str.isalpha, text)) else None, 0.0, 0)
