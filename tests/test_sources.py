import json
import os
import sqlite3

import pytest

from sessionlake.operators.merge import VersionedTables
from sessionlake.sources import connectors as C
from sessionlake.sources.files import blob_references, list_files, parse_lines, read_lines, wire_fields
from sessionlake.streaming.ingest import ingest_stream

NOW = "2026-06-11T00:00:00Z"


def _codex(native, *more):
    item = lambda **p: {"timestamp": NOW, "type": "response_item", "payload": p}
    return [
        {"timestamp": NOW, "type": "session_meta", "payload": {"id": native, "cwd": "/x", "type": "session_meta"}},
        item(type="message", role="user", content=[{"type": "input_text", "text": "hello there"}]),
        item(type="function_call", call_id="c1", name="bash", arguments='{"cmd":"pwd"}'),
        item(type="function_call_output", call_id="c1", output="/x"),
        item(type="message", role="assistant", content=[{"type": "output_text", "text": "hi"}]),
        *more,
    ]


def _write(path, records, tail=""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(map(json.dumps, records)) + tail)


def test_codex_with_hostile_lines(spark, tmp_path):
    _write(f"{tmp_path}/a/rollout-1.jsonl", _codex("u1", {"type": "turn_context", "payload": {}}, {"type": "mystery"}), "\nnot json\n\n[1]\n{\"torn\":")
    _write(f"{tmp_path}/a/other.jsonl", [{"type": "ignored"}])
    open(f"{tmp_path}/a/rollout-2.jsonl", "w").close()
    events, problems = C.read_source(spark, "codex", str(tmp_path))
    rows = events.orderBy("record_no").collect()
    assert [(r["kind"], r["role"]) for r in rows] == [("system", "system"), ("message", "user"), ("tool_call", "assistant"), ("tool_result", "tool"), ("message", "assistant")]
    assert len({r["session_id"] for r in rows}) == 1 and rows[1]["content_text"] == "hello there" and rows[0]["cwd"] == "/x"
    assert sorted((r["line_no"], r["name"]) for r in problems.collect()) == [(6, "drop:turn_context"), (7, "unknown_type:mystery"), (8, "invalid_json"), (10, "not_an_object"), (11, "torn_line")]
    call = C.merged_calls(events).collect()
    assert [(r["tool_name"], r["tool_input"], r["tool_output"], r["status"], r["first_record"]) for r in call] == [("bash", '{"cmd":"pwd"}', "/x", "completed", 3)]
    assert list_files(spark, str(tmp_path), "rollout-*.jsonl").count() == 1  # the empty one holds no session


def test_preambles_and_usage(spark, tmp_path):
    usage = {"timestamp": NOW, "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 3, "output_tokens": 4}}}}
    wrapped = {"timestamp": NOW, "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "<environment_context> x"}]}}
    _write(f"{tmp_path}/rollout-1.jsonl", _codex("u1", wrapped, usage))
    good, _ = parse_lines(read_lines(spark, str(tmp_path), "rollout-*.jsonl"))
    events, _ = C.classify(good, C.CONNECTORS["codex"])
    kinds = [r["kind"] for r in C.mark_preambles(events).orderBy("record_no").collect()]
    assert kinds[-2:] == ["preamble", "usage"]
    assert [tuple(r)[1:] for r in C.usage_of(events, good).collect()] == [(7, 3, 4, 7)]


@pytest.mark.parametrize(
    "provider,path,records,texts",
    [
        ("claude", "p/abc.jsonl", [{"uuid": "1", "sessionId": "s", "timestamp": NOW, "type": "user", "message": {"role": "user", "content": [{"type": "text", "text": "q"}]}}, {"uuid": "2", "sessionId": "s", "type": "assistant", "message": {"role": "assistant", "content": "a"}}, {"type": "mode"}], [("user", "q"), ("assistant", "a")]),
        ("grok", "s1/chat_history.jsonl", [{"id": "1", "type": "user", "content": "q"}, {"id": "2", "type": "assistant", "content": "a", "tool_calls": [{"id": "c", "name": "bash", "arguments": "{}"}]}], [("user", "q"), ("assistant", "a")]),
        ("kimi", "s1/wire.jsonl", [{"type": "context.append_message", "time": 1, "message": {"role": "user", "content": "q"}}, {"type": "context.append_loop_event", "event": {"type": "content.part", "part": {"type": "text", "text": "a"}}}, {"type": "metadata"}], [("user", "q"), ("assistant", "a")]),
        ("antigravity", "s1.jsonl", [{"type": "USER_INPUT", "created_at": NOW, "content": "q"}, {"type": "PLANNER_RESPONSE", "content": "a"}], [("user", "q"), ("assistant", "a")]),
        ("omp", "s1.jsonl", [{"type": "session", "id": "n"}, {"type": "message", "message": {"role": "user", "content": "q"}}], [("user", "q")]),
        ("pi", "s1.jsonl", [{"type": "session", "id": "n"}, {"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "q"}]}}], [("user", "q")]),
        ("prime", "s1.jsonl", [{"type": "session", "id": "n"}, {"type": "message", "message": {"role": "assistant", "content": "a"}}], [("assistant", "a")]),
    ],
)
def test_other_sources(spark, tmp_path, provider, path, records, texts):
    _write(f"{tmp_path}/{path}", records)
    events, problems = C.read_source(spark, provider, str(tmp_path))
    said = events.where("kind = 'message'").orderBy("record_no").collect()
    assert [(r["role"], r["content_text"]) for r in said] == texts and all(r["session_id"].startswith(f"{provider}:") for r in said)
    assert all(r["name"].startswith("drop:") for r in problems.collect())


def test_terminal_responses(spark, tmp_path):
    records = [{"type": "USER_INPUT", "content": "q"}, {"type": "PLANNER_RESPONSE", "content": "working"}, {"type": "PLANNER_RESPONSE", "content": "answer"}, {"type": "USER_INPUT", "content": "more"}, {"type": "PLANNER_RESPONSE", "content": "done"}]
    _write(f"{tmp_path}/s.jsonl", records)
    events = C.terminal_responses(C.read_source(spark, "antigravity", str(tmp_path))[0])
    assert [r["content_text"] for r in events.where("kind = 'message' and role = 'assistant'").orderBy("record_no").collect()] == ["answer", "done"]


def test_sqlite_sources(spark, tmp_path):
    os.makedirs(f"{tmp_path}/bad")
    with open(f"{tmp_path}/bad/opencode.db", "w") as f:
        f.write("garbage" * 100)
    db = sqlite3.connect(f"{tmp_path}/opencode.db")
    db.executescript(
        """create table session (id text, title text, directory text); create table message (id text, session_id text, time_created integer, data text); create table part (id text, message_id text, session_id text, time_created integer, data text);
        insert into session values ('s', 't', '/x'); insert into message values ('m', 's', 1, '{"role":"user"}'); insert into part values ('p1', 'm', 's', 1, '{"type":"text","text":"q"}');
        insert into part values ('p2', 'm', 's', 2, '{"type":"tool","tool":"bash","callID":"k","state":{"status":"completed","input":{"a":1},"output":"o"}}'); insert into part values ('p3', 'm', 's', 3, '{"type":"step-start"}');"""
    )
    db.execute("insert into part values ('p4', 'm', 's', 4, ?)", (json.dumps({"type": "text", "text": "x" * (1 << 20)}),))
    db.commit()
    db.close()
    events, problems = C.read_opencode(spark, str(tmp_path))
    assert [(r["record_no"], r["kind"], r["content_text"], r["tool_output"]) for r in events.orderBy("record_no").collect()] == [(1, "message", "q", None), (2, "tool_result", None, "o")]
    assert sorted(r["name"] for r in problems.collect()) == ["corrupt_database", "oversized_part"]
    db = sqlite3.connect(f"{tmp_path}/state.db")
    db.executescript(
        """create table sessions (id text, model text); create table messages (id integer, session_id text, role text, content text, tool_call_id text, tool_calls text, tool_name text, timestamp real);
        insert into sessions values ('h', 'm'); insert into messages values (1, 'h', 'user', 'q', null, null, null, 1717200000.5), (2, 'h', 'assistant', null, null, '[{"id":"c","function":{"name":"bash","arguments":"{}"}}]', null, 1717200001.0), (3, 'h', 'tool', 'o', 'c', null, 'bash', 1717200002.0), (4, 'h', 'session_meta', 'x', null, null, null, 1717200003.0);"""
    )
    db.commit()
    db.close()
    events, problems = C.read_hermes(spark, str(tmp_path))
    rows = events.orderBy("record_no").collect()
    assert [(r["kind"], r["role"], r["tool_call_id"], r["tool_name"]) for r in rows] == [("message", "user", None, None), ("tool_call", "assistant", "c", "bash"), ("tool_result", "tool", "c", "bash")]
    assert rows[0]["timestamp"] == "2024-06-01T00:00:00.500Z" and [r["name"] for r in problems.collect()] == ["drop:session_meta"]


def test_blobs(spark, tmp_path):
    message = json.dumps({"role": "user"}).encode()
    hashes = [bytes([i]) * 32 for i in (1, 2)]
    root = b"".join(bytes([0x0A, 32]) + h for h in hashes)
    assert wire_fields(root + bytes([0x10, 0x96, 0x01])) == [(1, 2, hashes[0]), (1, 2, hashes[1]), (2, 0, 150)]
    for broken in (b"\x0a\x20short", b"\x00", b"\x0b", b"\xff" * 12):
        with pytest.raises(ValueError):
            wire_fields(broken)
    df = spark.createDataFrame([(root,), (b"\x0a\x20x",), (None,)], "b binary")
    assert [r[0] and len(r[0]) for r in df.select(blob_references(df["b"])).collect()] == [2, None, None]
    db = sqlite3.connect(f"{tmp_path}/store.db")
    db.execute("create table blobs (id text, data blob)")
    db.executemany("insert into blobs values (?, ?)", [("root", root), (hashes[0].hex(), message)])
    db.commit()
    db.close()
    assert [tuple(r)[1:] for r in C.read_cursor(spark, str(tmp_path)).orderBy("position").collect()] == [(0, '{"role":"user"}', False), (1, None, False)]


def test_threads_and_chains(spark, tmp_path):
    with open(f"{tmp_path}/t1.json", "w") as f:
        json.dump({"id": "T", "messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"type": "tool_use", "id": "c", "name": "bash", "input": {"a": 1}}]}]}, f)
    with open(f"{tmp_path}/t2.json", "w") as f:
        f.write("{")
    events, problems = C.read_threads(spark, str(tmp_path))
    assert [(r["kind"], r["role"], r["content_text"], r["tool_name"]) for r in events.orderBy("record_no").collect()] == [("message", "user", "q", None), ("tool_call", "assistant", "", "bash")]
    assert problems.count() == 1
    nodes = spark.createDataFrame([("s", 1, None), ("s", 2, 1), ("s", 3, 2), ("t", 1, 2), ("t", 2, 1), ("u", 5, 9)], "native_session_id string, node_id long, parent_node_id long")
    heads = spark.createDataFrame([("s", 3), ("t", 2), ("u", 5)], "native_session_id string, node_id long")
    assert sorted(tuple(r) for r in C.node_chains(nodes, heads).collect()) == [("s", 1, 0), ("s", 2, 1), ("s", 3, 2)]


def test_incremental_ingest(spark, tmp_path):
    source, tables, at = f"{tmp_path}/in", VersionedTables(spark, f"{tmp_path}/store"), f"{tmp_path}/checkpoint"
    _write(f"{source}/rollout-1.jsonl", _codex("u1"))
    ingest_stream(spark, "codex", source, tables, at).awaitTermination()
    first = tables.snapshot()
    assert sorted(r["text"] for r in tables.read("messages").collect()) == ["hello there", "hi"]
    ingest_stream(spark, "codex", source, tables, at).awaitTermination()
    assert tables.snapshot() == first
    _write(f"{source}/rollout-2.jsonl", _codex("u2")[:2])
    ingest_stream(spark, "codex", source, tables, at).awaitTermination()
    assert tables.snapshot() != first and tables.read("messages").count() == 3


def test_mutated_records_cost_themselves_only(spark, tmp_path):
    base = _codex("u1")
    mutants = [{**base[1], "payload": None}, {**base[1], "payload": {"type": "message", "role": 7, "content": {"text": ["x"]}}}, {**base[2], "payload": {"type": "function_call"}}, {"type": 5}, {}, {**base[1], "timestamp": {"a": 1}}]
    _write(f"{tmp_path}/rollout-1.jsonl", base + mutants)
    events, problems = C.read_source(spark, "codex", str(tmp_path))
    assert events.where("record_no <= 5").count() == 5 and events.count() + problems.count() == len(base) + len(mutants)


def test_every_call_of_a_turn_is_read(spark, tmp_path):
    use = lambda i, name, **p: {"type": "tool_use", "id": i, "name": name, "input": p}
    records = [
        {"uuid": "1", "sessionId": "s", "timestamp": NOW, "type": "user", "message": {"role": "user", "content": "run both"}},
        {"uuid": "2", "sessionId": "s", "timestamp": NOW, "type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "Both."}, use("a", "Read", path="/x"), use("b", "Bash", command="ls")]}},
        {"uuid": "3", "sessionId": "s", "timestamp": NOW, "type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "b", "content": "out b"}, {"type": "tool_result", "tool_use_id": "a", "content": [{"type": "text", "text": "out a"}]}]}},
        {"uuid": "4", "sessionId": "s", "timestamp": NOW, "type": "assistant", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}]}},
        {"uuid": "5", "sessionId": "s", "type": "assistant", "message": {"role": "assistant", "content": [use("c", "Read", path="/y"), {"type": "tool_use", "name": "no id"}, 7, None]}},
    ]
    _write(f"{tmp_path}/p/s.jsonl", records)
    events, _ = C.read_source(spark, "claude", str(tmp_path))
    rows = events.orderBy("record_no").collect()
    assert [r["kind"] for r in rows] == ["message", "tool_call", "tool_result", "reasoning", "tool_call"] and rows[1]["content_text"] == "Both." and rows[1]["role"] == "assistant"
    calls = {r["tool_call_id"]: r for r in C.merged_calls(events).collect()}
    assert {i: (r["tool_name"], r["tool_input"], r["tool_output"], r["status"], r["first_record"]) for i, r in calls.items()} == {
        "a": ("Read", '{"path":"/x"}', '[{"text":"out a","type":"text"}]', "completed", 2),
        "b": ("Bash", '{"command":"ls"}', "out b", "completed", 2),
        "c": ("Read", '{"path":"/y"}', None, "started", 5),
    }
    assert (calls["a"]["started_at"], calls["a"]["completed_at"], calls["c"]["started_at"]) == (NOW, NOW, None)


@pytest.mark.parametrize("provider,path,record", [("grok", "s1/chat_history.jsonl", {"id": "1", "type": "assistant", "content": "a"}), ("antigravity", "s1.jsonl", {"type": "PLANNER_RESPONSE", "content": "a"})])
def test_every_call_of_a_list_is_read(spark, tmp_path, provider, path, record):
    _write(f"{tmp_path}/{path}", [{**record, "tool_calls": [{"id": "c", "name": "bash", "arguments": "{}"}, {"name": "read", "arguments": {"p": 1}}, {"id": "d"}]}])
    calls = C.merged_calls(C.read_source(spark, provider, str(tmp_path))[0]).collect()
    assert sorted((r["tool_call_id"], r["tool_name"], r["tool_input"]) for r in calls) == [("c", "bash", "{}"), ("call:1:1", "read", '{"p":1}'), ("d", None, None)]


def test_rows_of_the_write_ahead_log_are_read(spark, tmp_path):
    from sessionlake.sources.files import read_sqlite

    db = sqlite3.connect(f"{tmp_path}/state.db", isolation_level=None)
    db.execute("pragma journal_mode=wal")
    db.execute("pragma wal_autocheckpoint=0")
    db.execute("create table t (a integer)")
    db.execute("insert into t values (1), (2)")
    assert os.path.getsize(f"{tmp_path}/state.db-wal") > 0
    rows = read_sqlite(spark, str(tmp_path), "state.db", "select a from t", "a long").collect()
    db.close()
    assert sorted(r["a"] for r in rows) == [1, 2] and all(r["error"] is None for r in rows)
