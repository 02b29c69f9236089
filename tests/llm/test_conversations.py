import random

import pytest

from sessionlake.llm import conversations as C

M = "session_id string, event_id string, seq long, role string, text string, ingested_at timestamp, blank string, cls string"


def _fault(turns, calls):
    """Brute force: (role, text, seq) of one session."""
    blank = lambda t: t is None or not t.strip("\u0009\u000a\u000b\u000c\u000d \u0085      　")
    said = [(q, r, blank(t)) for r, t, q in turns]
    no_dialogue = not any(r == "user" and not b for _, r, b in said) or not any(r == "assistant" and not b for _, r, b in said)
    bad_role = any(r not in C.ROLES for _, r, _ in said)
    seqs = [q for q, _, _ in said]
    every = set(seqs) | set(calls)
    bad_sequence = bool(said or calls) and (len(set(seqs)) != len(seqs) or None in every or every != set(range(len(every))))
    line = [(r, b) for q, r, b in sorted((x for x in said if x[0] is not None), key=lambda x: (x[0], "U" if x[1] == "user" else "A" if x[1] == "assistant" and not x[2] else "N")) if not (r == "user" and b)]
    no_reply = False
    for i, (r, _) in enumerate(line):
        if r == "user" and (i + 1 == len(line) or line[i + 1][0] != "user"):
            later = next((x for x in line[i + 1 :] if x[0] == "user" or x[0] == "assistant" and not x[1]), None)
            no_reply |= later is None or later[0] == "user"
    return no_dialogue, bad_role, bad_sequence, no_reply


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_faults_agree_with_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(block)
    messages, calls, expected = [], [], {}
    for s in range(120):
        n = rng.randint(0, 9)
        places = list(range(n)) if rng.random() < 0.8 else [rng.randint(0, n) for _ in range(n)]
        turns, own = [], []
        for q in places:
            kind = rng.random()
            if kind < 0.15:
                own.append(q)
            else:
                turns.append((rng.choice(["user", "user", "assistant", "assistant", "reasoning"] + ["system"] * (rng.random() < 0.05)), rng.choice(["hi", "hi", "hi", "  ", None, ""]), q))
        expected[f"s{s}"] = _fault(turns, own)
        for i, (r, t, q) in enumerate(turns):
            row = (f"s{s}", f"s{s}:{i}", q, r, t, None, "x", "y")
            messages += [row] * rng.choice([1, 1, 2])
        calls += [(f"s{s}", q) for q in own] * 2
    sessions = spark.createDataFrame([(f"s{s}",) for s in range(120)] * 2 + [(None,)], "session_id string")
    faults = C.session_faults(sessions, spark.createDataFrame(messages, M), spark.createDataFrame(calls, "session_id string, seq long"))
    got = {r[0]: tuple(r)[1:] for r in faults.collect()}
    assert got == expected
    kept = {r[0] for r in C.dropped_sessions(faults).collect()}
    assert kept == {s for s, f in expected.items() if any(f)}


def test_turns_are_numbered_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 2)
    rows = [("s", f"e{i}", i, "user" if i % 2 == 0 else "assistant", f"t{i}" if i != 4 else " ", None, "x", "y") for i in range(8)]
    rows[5] = ("s", "e5", 5, "assistant", "t5", None, "x", "y")
    sessions = spark.createDataFrame([("s",)], "session_id string")
    none = spark.createDataFrame([], "session_id string, seq long")
    turns = C.conversations(sessions, spark.createDataFrame(rows, M), none).orderBy("turn_no").collect()
    assert [(r["turn_no"], r["seq"]) for r in turns] == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 5), (6, 6), (7, 7)]


def test_edits_and_deletes_fold(spark):
    rows = [("s", "a", 0, "user", "old", "2024-01-01", "write"), ("s", "a", 0, "user", "new", "2024-01-02", "write"), ("s", "b", 1, "assistant", "x", "2024-01-01", "write"), ("s", "b", 1, "assistant", "x", "2024-01-03", "delete"), ("s", None, 2, "user", "y", None, None)]
    df = spark.createDataFrame(rows, "session_id string, event_id string, seq long, role string, text string, ingested_at string, op string")
    got = {(r["event_id"], r["text"]) for r in C.fold_events(df, ["seq", "role", "text"], operation="op").collect()}
    assert got == {("a", "new"), ("seq:2", "y")}


def test_empty(spark):
    e = spark.createDataFrame([], M)
    s = spark.createDataFrame([("lonely",)], "session_id string")
    c = spark.createDataFrame([], "session_id string, seq long")
    assert [tuple(r) for r in C.session_faults(s, e, c).collect()] == [("lonely", True, False, False, False)]
    assert C.session_faults(s.limit(0), e, c).count() == 0 and C.conversations(s, e, c).count() == 0
    m = spark.createDataFrame([("q", "lonely"), ("q", None)], "search_id string, session_id string")
    assert C.matched_conversations(m, C.conversations(s, e, c)).count() == 0
