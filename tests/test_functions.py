import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.functions import hashing, text, vectors
from sessionlake.operators.redaction import redact, redact_json, redact_value


def _one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def _fnv(s):
    h = 2166136261
    for u in np.frombuffer(s.encode("utf-16-le"), dtype=np.uint16):
        h = ((h ^ int(u)) * 16777619) & 0xFFFFFFFF
    return f"{h:08x}"


@pytest.mark.parametrize("value", ["", "abc", "naïve", "👍🏽", "x" * 300])
def test_hashes(spark, value):
    assert hashing.stable_hash(value) == _fnv(value)
    assert hashing.wide_hash(value) == "".join(_fnv(p + value) for p in ("a:", "b:", "c:", "d:"))
    assert _one(spark, hashing.fnv_expression(F.col("v")), v=value) == _fnv(value)
    assert _one(spark, hashing.wide_hash_column(F.col("v")), v=value) == hashing.wide_hash(value)


def test_known_hash():
    assert hashing.stable_hash("abc") == "1a47e90b" and hashing.canonical_json({"b": 1, "a": [None]}) == '{"a":[null],"b":1}'


def test_null_hash(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    assert [r[0] for r in df.select(hashing.wide_hash_column(F.col("v"))).collect()] == [hashing.wide_hash("a"), None]


@pytest.mark.parametrize("value", ["ascii", "é" * 5, "日本語", "👍🏽👍🏽"])
@pytest.mark.parametrize("most", range(0, 12))
def test_utf8_prefix(spark, value, most):
    got = _one(spark, text.utf8_prefix(F.col("v"), most), v=value)
    assert value.startswith(got) and len(got.encode()) <= most and (got == value or len(value[: len(got) + 1].encode()) > most)


def test_text(spark):
    assert text.query_terms("Ünï-code_x 12!") == ["uni", "code", "x", "12"]
    assert _one(spark, text.terms(F.col("v")), v="Ünï-code_x 12!") == ["uni", "code", "x", "12"]
    assert _one(spark, text.encode_uri_component(F.col("v")), v="a b!'()*~/é") == "a%20b!'()*~%2F%C3%A9"
    assert _one(spark, hashing.base64url(F.col("v").cast("binary")), v="??>>~") == "Pz8-Pn4"
    assert _one(spark, text.snippet(F.col("v"), "needle", 3, 3), v="aaaa Needle bbbb") == "…aa Needle bb…"
    assert [tuple(x) for x in _one(spark, text.highlight_ranges(F.col("v"), "ab bc"), v="abc AB")] == [(0, 2), (4, 6)]
    assert text.parse_search("project:x @y #user free words role:assistant") == {"project": "y", "role": "assistant", "text": "free words"}
    assert _one(spark, text.compact(F.col("v")), v=" a\x01b \n c ") == "a b c"


@pytest.mark.parametrize("value,there", [("2024-01-02T03:04:05Z", True), ("2024-01-02", True), ("", False), ("soon", False), ("2024-13-40T00:00:00Z", False)])
def test_timestamps(spark, value, there):
    assert (_one(spark, text.parsed_timestamp(F.col("v")), v=value) is not None) == there


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [0.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1:] == [1.0, 0.0, None, None]


def test_half_precision():
    x = np.array([1.0, 1 + 2**-11, 1 + 3 * 2**-11, 65504.0, 65520.0, 2**-25, 0.0, -0.1])
    assert vectors.half_precision(x)[:5].tolist() == [1.0, 1 + 2**-10, 1 + 2**-9, 65504.0, np.inf]
    rng = np.random.default_rng(0).normal(size=1000)
    assert np.allclose(vectors.half_precision(rng), rng.astype(np.float16).astype(float), atol=1e-3)
    for bad in ([1.0], [0.0, 0.0], [float("nan"), 1.0], [1e9, 0.0]):
        with pytest.raises(ValueError):
            vectors.query_vector(bad, 2)


def test_mean_vector(spark):
    df = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("a", None), ("b", [7.0])], "k string, v array<double>")
    assert {r["k"]: (r["vector"], r["n_vectors"]) for r in vectors.mean_vector(df, ["k"], "v").collect()} == {"a": ([2.0, 4.0], 2), "b": ([7.0], 1)}


REDACTED = [
    ("Authorization: Bearer abc.def-1", "Authorization: Bearer [redacted]"),
    ("DB_PASSWORD=hunter2 x", "DB_PASSWORD=[redacted] x"),
    ("token == other", "token == other"),
    ('SECRET="quoted"', 'SECRET="quoted"'),
    ("postgres://u:pw@h/x", "postgres://u:[redacted]@h/x"),
    ("sk-" + "a" * 24, "[redacted]"),
    ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----[redacted]-----END PRIVATE KEY-----"),
    ("nothing here", "nothing here"),
]


@pytest.mark.parametrize("value,clean", REDACTED)
def test_redaction(spark, value, clean):
    assert _one(spark, redact(F.col("v")), v=value) == clean == redact_value(value)


def test_redaction_of_json(spark):
    got = _one(spark, redact_json(F.col("v")), v='{"a": {"api_key": 1, "b": ["TOKEN=x"]}}')
    assert json.loads(got) == {"a": {"api_key": "[redacted]", "b": ["TOKEN=[redacted]"]}}
    assert _one(spark, redact_json(F.col("v")), v="TOKEN=x") == "TOKEN=[redacted]"
