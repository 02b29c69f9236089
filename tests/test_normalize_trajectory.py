import json

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import normalize as N
from sessionlake.operators import trajectory as T


def test_context_in_force(spark):
    events = spark.createDataFrame([("s", "e1", 1, None), ("s", "e2", 2, "nat"), ("s", "e3", 3, None), ("t", "f1", 0, None)], "session_id string, id string, sequence long, native_event_id string")
    contexts = spark.createDataFrame(
        [("s", "c1", 0, "session", None, "m1", "p1", None), ("s", "c2", 2, "session", None, "m2", None, "high"), ("s", "c3", 0, "turn", "nat", "m3", None, None)],
        "session_id string, id string, sequence long, scope string, turn_id string, model string, model_provider string, reasoning_effort string",
    )
    usage = spark.createDataFrame([("s", "e3", "mu", None, 1)], "session_id string, event_id string, model string, model_provider string, order_index int")
    got = {r["id"]: (r["model"], r["model_provider"], r["reasoning_effort"], r["execution_context_id"]) for r in N.event_context(events, contexts, usage).collect()}
    assert got["e2"] == ("m3", "p1", "high", "c3") and got["e3"] == ("mu", "p1", "high", "c2") and got["f1"] == (None, None, None, None)
    assert got["e1"][1:3] == ("p1", None)
    latest = N.latest_model(contexts, usage.select("session_id", F.lit("u").alias("id"), "model", "model_provider", "order_index")).first()
    assert (latest["model"], latest["model_provider"]) == ("m2", "p1")


def test_blocks_and_text(spark):
    native = json.dumps([{"type": "text", "text": "a"}, {"type": "tool_use", "content": [{"text": "hidden"}]}, {"type": "image"}, "plain", {"thinking": "hm"}])
    row = spark.createDataFrame([(native,), (None,), ("not json",)], "n string").select(N.content_blocks(F.col("n")).alias("b")).select("b", N.event_text(F.lit(None).cast("string"), F.col("b")).alias("t")).collect()
    assert [b["kind"] for b in row[0]["b"]] == ["text", "text", "image", "text", "thinking"]
    assert row[0]["t"] == "a\n\nplain\n\nhm" and row[1]["t"] == "" and row[2]["t"] == "not json"


@pytest.mark.parametrize(
    "remote,key",
    [("git@Host.example:Team/Repo.git", "host.example/team/repo"), ("https://user@host.example:8443/team/repo.git/", "host.example/team/repo"), ("ssh://git@host.example/a/b", "host.example/a/b"), ("plain/Path.git", "plain/path"), ("", None), ("https://host.example/", None)],
)
def test_remotes(spark, remote, key):
    assert spark.range(1).select(N.normalized_remote(F.lit(remote))).first()[0] == key


def test_identity_ladder(spark):
    rows = [("k", "git@h:a/b", "p", "w", "/x", "m"), (None, "git@h:a/b", "p", "w", "/x", "m"), (None, None, "p", "w", "/x", "m"), (" ", "", " ", "w", "/x", "m"), (None, None, None, None, "/x/", "m")]
    got = N.project_identity(spark.createDataFrame(rows, "explicit_key string, git_remote string, package_name string, workspace_name string, raw_path string, machine_id string")).collect()
    assert [r["project_key"].split(":")[0] for r in got] == ["project", "git", "package", "workspace", "path"] and [r["confidence"] for r in got] == ["explicit", "high", "medium", "medium", "low"]


def test_rows_of_events(spark):
    blocks = "array<struct<id:string,sequence:bigint,kind:string,text:string,markdown:string,thinking:string,nativeType:string>>"
    events = spark.createDataFrame([("s", "e", 0, "user", " TOKEN=abc \n", [], None, "p"), ("s", "f", 1, "tool", "x", [], None, "p"), ("s", "g", 2, "thinking", "  ", [], None, "p")], f"session_id string, id string, sequence long, role string, content_text string, blocks {blocks}, timestamp string, project_key string")
    got = N.message_rows(events).collect()
    assert [(r["event_id"], r["text"], len(r["content_hash"])) for r in got] == [("e", "TOKEN=[redacted]", 32)]
    edges = spark.createDataFrame([("s", "2", "subagent_of", "late", 5), ("s", "1", "subagent_of", "first", 1), ("s", "0", "parent", "no", 0)], "session_id string, id string, kind string, from_id string, order_index int")
    assert N.parents_of(edges).first()["parent_session_id"] == "first"


@pytest.fixture()
def session(spark):
    sessions = spark.createDataFrame([("s", "2024-01-01T00:00:00Z", "codex", "m")], "session_id string, started_at string, provider string, model string")
    events = spark.createDataFrame(
        [("s", "u", 0, "user", "message", "2024-01-01T00:00:01Z", "hi"), ("s", "r", 1, "thinking", "reasoning", "2024-01-01T00:00:02Z", "hm"), ("s", "a", 2, "assistant", "message", "bad", "yo"), ("s", "c", 3, "assistant", "tool_call", "2024-01-01T00:00:03Z", None), ("s", "x", 4, "unknown", "lifecycle", None, None)],
        "session_id string, id string, sequence long, role string, kind string, timestamp string, text string",
    )
    calls = spark.createDataFrame([("k", "s", "c", 3, "bash", "completed", '{"cmd": 1}', "é" * 10, None, "2024-01-01T00:00:04Z"), ("l", "s", "c", 3, "bash", None, "raw", None, None, None)], "id string, session_id string, event_id string, seq long, tool_name string, status string, input_text string, output_text string, started_at string, completed_at string")
    return sessions, events, calls


def test_trajectory(spark, session):
    records, losses = T.trajectory(*session, most_bytes=5)
    rows = records.orderBy("sequence").collect()
    assert [r["role"] for r in rows] == ["meta", "user", "reasoning", "assistant", "tool_call", "tool_call", "tool_result"]
    assert rows[-1]["content"] == "éé" and rows[-1]["original_bytes"] == 20 and rows[-1]["truncated"]
    assert {(r["kind"], r["source_id"]) for r in losses.collect()} == {("truncated", "k"), ("omitted", "x")}
    assert T.trajectory_faults(records).count() == 0
    assert T.trajectory_faults(records.where("role <> 'meta'")).count() > 0
    counts = T.trajectory_counts(records, losses).first()
    assert (counts["records"], counts["omitted_facts"], counts["truncated_records"]) == (7, 1, 1)
    _, fewer = T.trajectory(*session, reasoning=False, results=False)
    assert {(r["source_id"], r["reason"]) for r in fewer.collect()} == {("r", "excluded_by_option"), ("k", "excluded_by_option"), ("x", "not_selected_for_agent_projection")}


def test_exchange_formats(spark, session):
    records, _ = T.trajectory(*session)
    letta, issues = T.letta_records(records, session[0])
    said = [json.loads(r["record"]) for r in letta.orderBy("sequence").collect()]
    assert said[0] == {"role": "meta", "source": "codex", "model": "m"} and [x["id"] for x in said[3]["tool_calls"]] == ["k", "l"] and said[3]["content"] is None
    assert {r["kind"] for r in issues.collect()} == {"missing_or_invalid_timestamp"}
    steps = T.atif_steps(records).orderBy("step_id").collect()
    assert [(s["step_id"], s["source"]) for s in steps] == [(1, "user"), (2, "agent"), (3, "agent"), (4, "agent")]
    assert [c["arguments"] for c in steps[3]["tool_calls"]] == ['{"cmd": 1}', "{}"] and steps[3]["tool_calls"][1]["raw_arguments"] == "raw"


def test_export_pages():
    page = [{"session_id": "a", "text": "x"}, {"session_id": "b", "text": "é"}]
    lines = list(T.export_lines(page, {"b": [1]}, {"snapshot": "c:1"}, "a", ["b", 1]))
    receipt = T.verify_export(lines)
    assert receipt["counts"] == {"messages": 2, "trajectories": 1} and lines == list(T.export_lines(page, {"b": [1]}, {"snapshot": "c:1"}, "a", ["b", 1]))
    with pytest.raises(ValueError):
        T.verify_export([lines[0], *lines[2:]])

    def expired():
        raise RuntimeError("expired")

    broken = list(T.export_lines(page, {}, {"snapshot": "c:1"}, None, None, check=expired))
    assert json.loads(broken[-1]) == {"kind": "error", "message": "expired"}
    with pytest.raises(ValueError, match="expired"):
        T.verify_export(broken)
