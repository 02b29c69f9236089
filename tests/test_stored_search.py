"""The stored index, the measured vector search and whole sessions on small stores."""

import pytest
from pyspark.sql import functions as F

from sessionlake.operators.search import LexicalIndex, documents, lexical_search, live_vectors, semantic_search, vector_search
from sessionlake.operators.store import Store
from sessionlake.plans.query import QueryError, enrichment_page, full_session
from sessionlake.schemas import TABLES

QUERY = [1.0] + [0.0] * 7


def _store(spark, folder, rows):
    for name in ("messages", "message_vectors", "sessions", "tool_calls"):
        spark.createDataFrame(rows.get(name, []), TABLES[name]).write.parquet(f"{folder}/{name}.parquet")
    return Store(spark, str(folder))


def _message(session, event, seq, role, text, content_hash="h"):
    return (session, event, seq, role, text, None, "p", content_hash, None, None, None, None, None)


def _vector(rowid, session, seq, role, vector, content_hash="h"):
    return (rowid, "m", "text", session, seq, role, "p", "codex", content_hash, None, 8, None, vector, None, None, None)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    messages = [_message("codex:1", f"e{i}", i, "user" if i % 2 else "assistant", f"planner {'merge ' * (i % 3)} number {i}") for i in range(30)]
    messages += [_message("codex:1", None, 30, "user", "merge planner"), _message("codex:1", "odd", 31, "nobody", "merge planner"), _message("codex:2", "n", 0, "user", None), messages[4]]
    vectors = [_vector(i, "codex:1", i, "user" if i % 2 else "assistant", [1.0, i / 10] + [0.0] * 6, "h" if i > 9 else "stale") for i in range(30)]
    vectors += [_vector(40, "codex:1", 11, "user", [1.0] * 7), _vector(41, "codex:1", 11, "user", None), _vector(42, "codex:1", 13, "user", [0.0] * 8), _vector(43, "codex:1", 13, "user", [float("nan")] * 8), vectors[12]]
    sessions = [(s, "p", "codex", "a", None, None, None, None, None, None, 1, 1, None, None, None, p, 0, 0, None) for s, p in (("codex:1", None), ("codex:2", "codex:1"), ("codex:3", None))]
    return _store(spark, tmp_path_factory.mktemp("store"), {"messages": messages, "message_vectors": vectors, "sessions": sessions})


@pytest.mark.parametrize("text,where", [("merge planner", None), ("planner", "role = 'user'"), ("absent", None), ("merge absent", None), ("", None)])
def test_the_index_gives_what_the_scan_gives(spark, store, tmp_path, text, where):
    where = F.expr(where) if where else None
    index = LexicalIndex.of(store, str(tmp_path))
    want = [tuple(r) for r in lexical_search(documents(store), text, limit=12, offset=1, where=where).orderBy("rank").collect()]
    assert [tuple(r) for r in index.search(text, limit=12, offset=1, where=where).orderBy("rank").collect()] == want
    assert LexicalIndex.of(store, str(tmp_path)).folder == index.folder


@pytest.mark.parametrize("limit,offset,where", [(5, 0, None), (3, 4, None), (50, 0, None), (4, 0, "role = 'user'")])
def test_the_measured_search_gives_what_the_scan_gives(store, limit, offset, where):
    where = F.expr(where) if where else None
    plain = lambda df: [(r["key"], r["seq"], r["rank"], round(r["score"], 9)) for r in df.orderBy("rank").collect()]
    want = plain(vector_search(live_vectors(store, "m"), QUERY, limit, offset, where, dimensions=8))
    assert plain(semantic_search(store, "m", QUERY, limit, offset, where, dimensions=8)) == want and want


def test_empty_tables(spark, tmp_path):
    empty = _store(spark, tmp_path / "s", {})
    assert LexicalIndex.of(empty, str(tmp_path)).search("planner").count() == 0
    assert semantic_search(empty, "m", QUERY, dimensions=8).count() == 0 and full_session(empty, "codex:1").count() == 0


def test_a_whole_session_has_its_descendants(store):
    rows = full_session(store, "codex:1").collect()
    assert {(r["session_id"], r["depth"]) for r in rows} == {("codex:1", 0), ("codex:2", 1)}
    assert sorted(r["place"] for r in rows if r["session_id"] == "codex:1") == list(range(32))


def test_enrichments_of_sessions_that_are_here(spark, store):
    rows = [(s, n, "1", 1, "p", "h", "{}", "t") for s in ("codex:1", "codex:2", "gone") for n in ("b", "a")]
    enrichments = spark.createDataFrame(rows, TABLES["session_enrichments"])
    sessions = store.rows("sessions", "project_key")
    keys = lambda df: [(r["session_id"], r["namespace"]) for r in df.collect()]
    assert keys(enrichment_page(enrichments, sessions)) == [("codex:1", "a"), ("codex:1", "b"), ("codex:2", "a"), ("codex:2", "b")]
    assert keys(enrichment_page(enrichments, sessions, after=("codex:1", "a"), limit=1)) == [("codex:1", "b"), ("codex:2", "a")]
    assert keys(enrichment_page(enrichments, sessions, project_key="other")) == [] and keys(enrichment_page(enrichments, sessions, namespace="b", session_id="codex:2")) == [("codex:2", "b")]
    with pytest.raises(QueryError):
        enrichment_page(enrichments, sessions, limit=0)
