import math

import pytest
from pyspark.sql import functions as F

from sessionlake.llm.truncation import BROKEN_CHAR, JSON_END, NOTICE, SIZE, evidence, found_limits, measured, poisson_tail_bound, truncated_outputs, truncation_rates

CUT = [
    ("some text<truncated 620 bytes>", None, NOTICE),
    ("some text...[31 chars clipped]", None, NOTICE),
    ("a\nb\n[... output truncated ...]", None, NOTICE),
    ("a\nb\n(output cut, 56 more characters)", None, NOTICE),
    ("a\nb\n… +44 lines", None, NOTICE),
    ("a b …49 tokens truncated… c d", None, NOTICE),
    ("a\n~~ middle elided ~~\nb", None, NOTICE),
    ("a\n... [53 lines omitted] ...\nb", None, NOTICE),
    ("a\n<<< 68 characters removed >>>\nb", None, NOTICE),
    ("a\n--- response exceeded limit, remainder dropped ---", None, NOTICE),
    ("a\n[Ausgabe gekürzt]", None, NOTICE),
    ("a\n[…]\nb", None, NOTICE),
    ("short", 900, SIZE),
    ('{"items": [{"id": 1}, {"no', None, JSON_END),
    ("text that ends in �", None, BROKEN_CHAR),
    ("a\n[log shortened: 300 lines hidden]", None, NOTICE),
]
WHOLE = [
    ("48 rows, nothing omitted.", None),
    ("warning: column depth was truncated to 40 chars by the view", None),
    ("TRUNCATE TABLE digest; -- done", None),
    ("Watching for changes...", None),
    ("a\nb\nc", 7),
    ("a\nb", 5),
    ("trimmed", 8),
    ("日本語", 3),
    ('{"a": [1, 2]}', None),
    ('{"a": 1}\n{"a": 2}', None),
    ("see [the omitted part]( x ) in the docs", None),
]


@pytest.mark.parametrize("text,reported,flag", CUT)
def test_cut(text, reported, flag):
    assert evidence(text, reported, "x")[0] & flag


@pytest.mark.parametrize("text,reported", WHOLE)
def test_whole(text, reported):
    assert evidence(text, reported, "x")[0] == 0


def test_a_part_that_was_asked_for_is_whole():
    assert evidence('{"items": [', None, '{"path": "a", "limit": 20}')[0] == 0


def test_the_tail_is_bounded_from_above_and_closely(spark):
    rows = [(5.0, 2.0), (5.0, 0.01), (40.0, 3.0), (1.0, 0.5), (7.0, 6.9), (0.0, 1.0), (3.0, 4.0), (3.0, 0.0)]
    got = [r[2] for r in spark.createDataFrame(rows, "n double, mean double").select("n", "mean", poisson_tail_bound(F.col("n"), F.col("mean"))).collect()]
    for (n, mean), bound in zip(rows, got):
        exact = 1.0 if n <= mean or n < 1 else sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(int(n), 400)) if mean else 0.0
        assert exact * (1 - 1e-6) <= bound <= min(1.0, 3 * exact), (n, mean, exact, bound)


SCHEMA = "id string, provider string, tool string, text string, reported long, asked string, flags string, _limits string"


def test_limits_come_from_the_data(spark):
    words = "alpha beta gamma delta epsilon. "
    rows = [(f"w{i}", "a", "t", (words * 40)[: 199 + 7 * i % 700] + " done.", None, "", None, None) for i in range(400)]
    rows += [(f"c{i}", "a", "t", ("line of text number %d goes on and on\n" % i * 40)[:500], None, "", None, None) for i in range(30)]
    rows += [(f"d{i}", "a", "t", (words * 40)[:493] + " done.", None, "", None, None) for i in range(30)]
    rows += [("n", "a", "t", None, 5, None, None, None), ("e", None, None, "", 5, None, None, None), ("c0", *rows[400][1:])]
    got = {r["id"]: r for r in truncated_outputs(spark.createDataFrame(rows, SCHEMA), "id", "provider", "tool", "text", "reported", "asked").collect()}
    assert len(got) == 462
    assert {i for i, r in got.items() if r["is_cut"]} == {f"c{i}" for i in range(30)}
    assert got["c1"]["evidence"] == ["length_limit"] and not got["n"]["evidence"] and not got["e"]["is_cut"]
    limits = found_limits(*measured(spark.createDataFrame(rows, SCHEMA), "id", "provider", "tool", "text", "reported", "asked"), "provider").collect()
    assert {(r["provider"], r["unit"], r["limit_length"], r["n_torn"]) for r in limits} == {("a", u, 500, 30) for u in ("chars", "bytes")}
    rates = {(r["provider"], r["tool"]): (r["n_calls"], r["n_cut"]) for r in truncation_rates(spark.createDataFrame(list(got.values())), "provider", "tool").collect()}
    assert rates[("a", "t")] == (461, 30) and rates[(None, None)] == (1, 0)


def test_empty(spark):
    assert truncated_outputs(spark.createDataFrame([], SCHEMA), "id", "provider", "tool", "text", "reported", "asked").count() == 0
