"""The queries over all rows, where SQL cannot follow, against brute force."""

from collections import Counter

from sessionlake.functions.text import query_terms
from sessionlake.operators.redaction import redact_value
from sessionlake.plans.catalog import QUERIES

MESSAGE = "session_id string, event_id string, seq long, role string, text string, project_key string, model string, model_provider string"
MESSAGES = [
    ("codex:1", "e0", 0, "user", "Лог сессии 42, ab ログを見る", "p", None, None),
    ("codex:1", "e1", 1, "assistant", "ab ab Größe 42", "p", "m1", None),
    ("codex:1", "e2", 1, "assistant", None, "p", "m2", "x"),
    ("codex:1", "e3", 1, "reasoning", "", "p", None, None),
    ("codex:1", "e4", 2, "user", "a", "p", None, "y"),
    ("codex:2", "f0", 5, "user", "other", "p", None, None),
    ("codex:2", "f1", 6, "nobody", "unseen", "p", "m9", None),
]


def _messages(spark, folder):
    spark.createDataFrame([*MESSAGES, MESSAGES[1]], MESSAGE).write.parquet(f"{folder}/messages.parquet")
    return str(folder)


def test_every_term_is_indexed(spark, tmp_path):
    tf, df = Counter(), Counter()
    for _, _, _, role, text, *_ in MESSAGES:
        if role in ("user", "assistant", "reasoning"):
            tf.update(query_terms(text or ""))
            df.update(set(query_terms(text or "")))
    rows = QUERIES["index_terms"](spark, _messages(spark, tmp_path)).collect()
    assert {r["term"]: (r["tf"], r["df"]) for r in rows} == {t: (tf[t], df[t]) for t in tf} and len(rows) == len(tf)
    assert {"42", "ab", "лог"} <= set(tf)


def test_every_input_is_redacted(spark, tmp_path):
    rows = [("a", "export DB_PASSWORD=hunter2 x"), ("b", None), ("c", ""), ("d", "token == other"), ("e", "API_KEY = k1\nAuthorization: Bearer abc"), ("f", "plain")]
    spark.createDataFrame([*rows, rows[0]], "id string, input_text string").write.parquet(f"{tmp_path}/tool_calls.parquet")
    got = [tuple(r) for r in QUERIES["redacted_inputs"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(i, t and redact_value(t)) for i, t in rows]
    assert dict(got)["a"] == "export DB_PASSWORD=[redacted] x"


def test_every_message_has_its_context(spark, tmp_path):
    expected = {}
    for session, event, seq, _, _, _, *own in MESSAGES:
        before = sorted((m for m in MESSAGES if m[0] == session and m[2] <= seq), key=lambda m: (m[2], m[1]))
        expected[session, event] = tuple(v or next((m[6 + i] for m in reversed(before) if m[6 + i]), None) for i, v in enumerate(own))
    rows = QUERIES["context_forward_fill"](spark, _messages(spark, tmp_path)).collect()
    assert {(r["session_id"], r["id"]): (r["model"], r["model_provider"]) for r in rows} == expected and len(rows) == len(expected)
    assert expected["codex:1", "e3"] == ("m2", "x") and expected["codex:1", "e1"] == ("m1", "x")
