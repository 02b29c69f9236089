"""The named queries of the connectors, over small histories written out here, and the rows they must give.

The test tables hold no raw histories, so each source has a few records of its own: ordinary turns with
several calls, and lines that are dropped or broken.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from sessionlake.plans.catalog import query
from sessionlake.runtime import Folder, shared_folder, ship
from sessionlake.sources import connectors

_T = "2026-06-11T00:00:0{}Z"


def _use(id_: str, name: str, **given) -> dict:
    return {"type": "tool_use", "id": id_, "name": name, "input": given}


def _codex(n: int, **payload) -> dict:
    return {"timestamp": _T.format(n), "type": "response_item", "payload": payload}


#: File and records of each source; a record that is text is written as it is.
HISTORIES: dict[str, tuple[str, list[dict | str]]] = {
    "codex": (
        "rollout-1.jsonl",
        [
            {"timestamp": _T.format(0), "type": "session_meta", "payload": {"id": "u1", "cwd": "/x"}},
            _codex(1, type="message", role="user", content=[{"type": "input_text", "text": "list it"}]),
            _codex(2, type="function_call", call_id="c1", name="shell", arguments='{"cmd":"ls"}'),
            _codex(3, type="function_call", call_id="c2", name="shell", arguments='{"cmd":"pwd"}'),
            "not json",
            _codex(4, type="function_call_output", call_id="c2", output="/x"),
            _codex(5, type="function_call_output", call_id="c1", output="a b"),
            {"type": "turn_context", "payload": {}},
            _codex(6, type="message", role="assistant", content=[{"type": "output_text", "text": "done"}]),
        ],
    ),
    "claude": (
        "p/s1.jsonl",
        [
            {"uuid": "1", "sessionId": "s1", "timestamp": _T.format(1), "type": "user", "message": {"role": "user", "content": "run both"}},
            {"uuid": "2", "sessionId": "s1", "timestamp": _T.format(2), "type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "Both at once."}, _use("a", "Read", path="/x"), _use("b", "Bash", command="ls")]}},
            {"uuid": "3", "sessionId": "s1", "timestamp": _T.format(3), "type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "b", "content": "out b"}, {"type": "tool_result", "tool_use_id": "a", "content": "out a"}]}},
            {"uuid": "4", "sessionId": "s1", "timestamp": _T.format(4), "type": "assistant", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "so far so good"}]}},
            {"type": "queue-operation"},
            {"uuid": "5", "sessionId": "s1", "timestamp": _T.format(5), "type": "assistant", "message": {"role": "assistant", "content": [_use("c", "Read", path="/y")]}},
        ],
    ),
    "grok": (
        "g1/chat_history.jsonl",
        [
            {"id": "1", "type": "user", "content": "q"},
            {"id": "2", "type": "assistant", "content": "two calls", "tool_calls": [{"id": "k1", "name": "bash", "arguments": "{}"}, {"id": "k2", "name": "read", "arguments": '{"p":1}'}]},
            {"id": "3", "type": "tool_result", "tool_call_id": "k2", "content": "text of p"},
            {"type": "mystery"},
        ],
    ),
    "antigravity": (
        "a1.jsonl",
        [
            {"type": "USER_INPUT", "created_at": _T.format(1), "content": "q"},
            {"type": "PLANNER_RESPONSE", "created_at": _T.format(2), "content": "a", "tool_calls": [{"id": "m", "name": "view", "arguments": "{}"}, {"name": "find", "arguments": "{}"}]},
            {"type": "CONVERSATION_HISTORY"},
        ],
    ),
    "kimi": (
        "k1/wire.jsonl",
        [
            {"type": "context.append_message", "time": 1, "message": {"role": "user", "content": "q"}},
            {"type": "context.append_loop_event", "time": 2, "event": {"type": "tool.call", "toolCallId": "t1", "name": "bash", "arguments": "{}"}},
            {"type": "context.append_loop_event", "time": 3, "event": {"type": "tool.result", "toolCallId": "t1", "output": "ok"}},
            {"type": "metadata"},
        ],
    ),
}


def _read(spark: SparkSession) -> list[tuple[DataFrame, DataFrame]]:
    ship(spark)
    root = f"{shared_folder(spark)}/histories-{uuid.uuid4().hex}"
    folder = Folder(spark, root)
    for provider, (name, records) in HISTORIES.items():
        folder.write(f"{provider}/{name}", "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
    return [connectors.read_source(spark, provider, f"{root}/{provider}") for provider in HISTORIES]


def _values(rows: list[tuple], columns: str) -> str:
    said = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "FROM (VALUES " + ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows) + f") x({columns})"


_EVENTS = [
    ("codex", 1, "system", "system", ""), ("codex", 2, "message", "user", "list it"), ("codex", 3, "tool_call", "assistant", ""), ("codex", 4, "tool_call", "assistant", ""), ("codex", 5, "tool_result", "tool", ""), ("codex", 6, "tool_result", "tool", ""), ("codex", 8, "message", "assistant", "done"),
    ("claude", 1, "message", "user", "run both"), ("claude", 2, "tool_call", "assistant", "Both at once."), ("claude", 3, "tool_result", "user", ""), ("claude", 4, "reasoning", "assistant", "so far so good"), ("claude", 6, "tool_call", "assistant", ""),
    ("grok", 1, "message", "user", "q"), ("grok", 2, "message", "assistant", "two calls"), ("grok", 3, "tool_result", "tool", "text of p"),
    ("antigravity", 1, "message", "user", "q"), ("antigravity", 2, "message", "assistant", "a"),
    ("kimi", 1, "message", "user", "q"), ("kimi", 2, "tool_call", "assistant", ""), ("kimi", 3, "tool_result", "tool", ""),
]


@query(_values(_EVENTS, "provider, record_no, kind, role, content_text").replace("FROM", "SELECT provider, record_no::bigint AS record_no, kind, role, content_text FROM", 1))
def source_events(spark: SparkSession, base: str) -> DataFrame:
    """The events of five sources."""
    return reduce(DataFrame.unionByName, [events for events, _ in _read(spark)]).select("provider", "record_no", "kind", "role", "content_text")


_CALLS = [
    ("codex", "c1", "shell", '{"cmd":"ls"}', "a b", "completed", 3), ("codex", "c2", "shell", '{"cmd":"pwd"}', "/x", "completed", 4),
    ("claude", "a", "Read", '{"path":"/x"}', "out a", "completed", 2), ("claude", "b", "Bash", '{"command":"ls"}', "out b", "completed", 2), ("claude", "c", "Read", '{"path":"/y"}', None, "started", 6),
    ("grok", "k1", "bash", "{}", None, "started", 2), ("grok", "k2", "read", '{"p":1}', "text of p", "completed", 2),
    ("antigravity", "m", "view", "{}", None, "started", 2), ("antigravity", "call:2:1", "find", "{}", None, "started", 2),
    ("kimi", "t1", "bash", "{}", "ok", "completed", 2),
]


@query(_values(_CALLS, "provider, tool_call_id, tool_name, tool_input, tool_output, status, first_record").replace("FROM", "SELECT provider, tool_call_id, tool_name, tool_input, tool_output, status, first_record::bigint AS first_record FROM", 1))
def source_calls(spark: SparkSession, base: str) -> DataFrame:
    """The tool calls of five sources, all carriers of a call in one row."""
    from sessionlake.operators.search import provider_of

    calls = connectors.merged_calls(reduce(DataFrame.unionByName, [events for events, _ in _read(spark)]))
    return calls.select(provider_of(calls["session_id"]).alias("provider"), "tool_call_id", "tool_name", "tool_input", "tool_output", "status", "first_record")


@query(_values([("codex", 5, "invalid_json"), ("codex", 8, "drop:turn_context"), ("claude", 5, "drop:queue-operation"), ("grok", 4, "unknown_type:mystery"), ("antigravity", 3, "drop:CONVERSATION_HISTORY"), ("kimi", 4, "drop:metadata")], "provider, line_no, name"))
def source_diagnostics(spark: SparkSession, base: str) -> DataFrame:
    """The records and lines that five sources drop, each by name."""
    from pyspark.sql import functions as F

    found = [bad.select(F.lit(provider).alias("provider"), F.col("line_no").cast("int").alias("line_no"), "name") for provider, (_, bad) in zip(HISTORIES, _read(spark))]
    return reduce(DataFrame.unionByName, found)
