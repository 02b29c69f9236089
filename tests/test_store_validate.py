import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sessionlake.operators import validate
from sessionlake.operators.store import Store, vector_coverage
from sessionlake.plans.query import Filters, Query, page, select_messages, select_sessions, session_detail


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    """A root, its child and grandchild, and an unrelated root; two messages each, some broken."""
    folder = tmp_path_factory.mktemp("store")
    text = lambda *names: {n: pa.string() for n in names}
    sessions = text("session_id", "project_key", "provider", "agent_name", "title", "started_at", "updated_at", "source_path", "source_fingerprint", "host", "model", "model_provider", "assignment_role", "parent_session_id") | {"identity_scheme_version": pa.int32(), "normalization_version": pa.int32(), "message_count": pa.int64(), "tool_call_count": pa.int64(), "ingested_at": pa.timestamp("us")}
    messages = text("session_id", "event_id", "role", "text", "ts", "project_key", "content_hash", "execution_context_id", "model", "model_provider", "reasoning_effort") | {"seq": pa.int64(), "ingested_at": pa.timestamp("us")}
    calls = text("id", "session_id", "event_id", "tool_name", "status", "input_text", "output_text", "input_hash", "output_hash", "started_at", "completed_at", "project_key", "provider", "execution_context_id", "model", "model_provider", "reasoning_effort") | {"seq": pa.int64(), "output_bytes": pa.int64(), "ingested_at": pa.timestamp("us")}
    vectors = text("model", "modality", "session_id", "role", "project_key", "provider", "content_hash", "document_hash", "encoding", "created_at", "updated_at") | {"vec_rowid": pa.int64(), "seq": pa.int64(), "dimensions": pa.int32(), "vector": pa.list_(pa.float32()), "ingested_at": pa.timestamp("us")}

    def write(name, schema, rows):
        pq.write_table(pa.table({c: pa.array([r.get(c) for r in rows], t) for c, t in schema.items()}), f"{folder}/{name}.parquet")

    people = [("codex:a", None, 1), ("codex:b", "codex:a", 2), ("claude:c", "codex:b", 3), ("grok:d", None, 4)]
    rows = [{"session_id": s, "project_key": "p", "provider": s.split(":")[0], "agent_name": "x", "started_at": f"2026-01-0{n}T00:00:00Z", "parent_session_id": p, "message_count": 2, "tool_call_count": 0} for s, p, n in people]
    write("sessions", sessions, rows + rows[:1])
    said = [{"session_id": s, "event_id": f"{s}:e{i}", "seq": i, "role": ["user", "assistant"][i], "text": "hello", "ts": f"2026-01-0{n}T00:0{i}:00Z", "project_key": "p", "content_hash": f"h{i}", "model": f"m{n}"} for s, _, n in people for i in (0, 1)]
    said.append({"session_id": "codex:a", "event_id": None, "seq": 1, "role": "system", "text": " ", "ts": "soon", "project_key": "q", "content_hash": ""})
    write("messages", messages, said + said[:2])
    write("tool_calls", calls, [{"id": "t", "session_id": "gone", "seq": 0, "tool_name": "", "provider": "codex", "input_text": "x", "input_hash": "y"}])
    write("message_vectors", vectors, [{"vec_rowid": 1, "model": "v", "session_id": "codex:a", "seq": 0, "role": "user", "content_hash": "h0", "dimensions": 2, "vector": [1.0, 2.0]}, {"vec_rowid": 2, "model": "v", "session_id": "codex:a", "seq": 1, "role": "assistant", "content_hash": "old", "dimensions": 3, "vector": [1.0, float("nan")]}])
    return str(folder)


def test_pages_reproduce_the_scan(spark, base):
    store = Store(spark, base)
    whole = [(r["session_id"], r["seq"], r["message_id"]) for r in select_messages(store, Filters()).orderBy("session_id", "seq", "message_id").collect()]
    assert len(whole) == 9
    seen, after = [], None
    for _ in range(20):
        rows = page(store, Query("messages", limit=3, after=after)).collect()
        seen += [(r["session_id"], r["seq"], r["message_id"]) for r in rows[:3]]
        if len(rows) <= 3:
            break
        after = (rows[2]["session_id"], rows[2]["seq"])
    assert {x[:2] for x in seen} == {x[:2] for x in whole}


def test_filters(spark, base):
    store = Store(spark, base)
    count = lambda **f: select_messages(store, Filters(**f)).count()
    assert count(message_after="2026-01-02T00:00:00Z", message_before="2026-01-03T00:00:00Z") == 2
    assert count(message_after="2026-01-02T00:01:00Z") == 5 and count(providers=()) == 0 and count(providers=("codex",)) == 5
    assert count(model="m3") == 2 and count(roots_only=True) == 5
    assert count(lineage_root_session_id="codex:b") == 4 and count(lineage_root_session_id="absent") == 0
    assert select_sessions(store, Filters(session_started_after="2026-01-02", session_started_before="2026-01-04")).count() == 2
    detail = session_detail(store, "codex:a", limit=1)
    assert detail["messages"].collect()[0]["total"] == 3 and detail["messages"].collect()[0]["has_more"]


def test_coverage(spark, base):
    row = vector_coverage(Store(spark, base), "v").first()
    assert tuple(row) == (8, 1, 7, 1)


def test_violations(spark, base):
    store = Store(spark, base)
    rules = {}
    for r in validate.violations(store).collect():
        rules[r["rule"]] = rules.get(r["rule"], 0) + 1
    assert rules == {"message.role": 1, "message.text": 1, "message.time": 1, "message.project": 1, "message.shared_seq": 2, "message.hash": 1, "tool_call.session": 1, "tool_call.name": 1, "tool_call.input_hash": 1, "vector.dimensions": 1, "vector.finite": 1}
    audit = {r["rule"]: r for r in validate.audit(store).collect()}
    assert audit["message.shared_seq"]["n_records"] == 2 and audit["tool_call.name"]["examples"] == ["t"]


def test_samples_and_replays(spark):
    df = spark.range(100).selectExpr("id", "id % 7 as v")
    first = validate.sample_by_hash(df, "id", 10)
    assert first.collect() == validate.sample_by_hash(df.repartition(7), "id", 10).collect()
    assert validate.replay_differences(df, df.repartition(3), ["id"]).count() == 0
    assert {(r["id"], r["side"]) for r in validate.replay_differences(df, df.where("id <> 5"), ["id"]).collect()} == {(5, "first")}
