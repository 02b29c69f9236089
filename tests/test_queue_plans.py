"""The queue's changes: right for each state of a job, and planned with few reads however many follow one another."""

import hashlib

from pyspark.sql import functions as F

from sessionlake.operators import jobs
from sessionlake.plans import writes
from sessionlake.schemas import TABLES


def _leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pruned_jobs_reads_each_state_a_few_times(spark, tmp_path):
    rows = [(f"s:{i}", None if i % 7 == 0 else f"f{i}") for i in range(24)]
    spark.createDataFrame([*rows, *rows[:9]], "session_id string, source_fingerprint string").write.parquet(f"{tmp_path}/sessions.parquet")
    pruned = writes.pruned_jobs(spark, str(tmp_path))
    assert _leaves(pruned) <= 12
    ids = sorted((_sha(f"embed:{s}:{_sha(f or '')}"), s) for s, f in rows)
    failed = {i for i, _ in ids[:20] if i >= "8"}
    gone = {i for i, s in ids if i in failed and s.endswith("1")}
    assert failed and gone
    assert sorted(tuple(r) for r in pruned.collect()) == [(i, "failed" if i in failed else "pending") for i, _ in ids if i not in gone]


def test_enqueue_reads_the_queue_once(spark):
    then, now = (F.to_timestamp(F.lit(f"2024-01-0{d} 00:00:00")) for d in (1, 2))
    states = [("waits", "pending", 2, None), ("runs", "leased", 1, "w"), ("done", "completed", 3, None), ("broke", "failed", 5, None), ("other", "completed", 1, None), (None, "failed", 4, None), ("blank", None, 1, None)]
    held = spark.createDataFrame(states, "idempotency_key string, status string, attempts int, leased_by string").select(
        F.concat(F.lit("id-"), F.coalesce("idempotency_key", F.lit("?"))).alias("job_id"), "idempotency_key", F.lit("embed").alias("kind"), F.lit("old").alias("payload_json"), "status", "attempts",
        F.lit(5).alias("max_attempts"), "leased_by", F.lit(None).cast("timestamp").alias("lease_until"), then.alias("next_run_at"), F.lit("boom").alias("last_error"), then.alias("updated_at"),
    )
    asked = spark.createDataFrame([(k, "embed", "new") for k in ("waits", "runs", "done", "broke", "blank", "fresh", "fresh", None)], "idempotency_key string, kind string, payload_json string")
    after = jobs.enqueue(held, asked, now, 9)
    assert _leaves(after) == _leaves(held) + _leaves(asked)
    assert {(c, t) for c, t in after.dtypes} == {(c, t) for c, t in spark.createDataFrame([], TABLES["queue_jobs"]).dtypes}
    got = sorted(after.select("idempotency_key", "job_id", "payload_json", "status", "attempts", "max_attempts", "leased_by", F.day("next_run_at"), "last_error", F.day("updated_at")).collect(), key=str)
    expected = [
        ("waits", "id-waits", "old", "pending", 2, 5, None, 1, "boom", 1),
        ("runs", "id-runs", "old", "leased", 1, 5, "w", 1, "boom", 1),
        ("done", "id-done", "new", "pending", 0, 5, None, 2, None, 1),
        ("broke", "id-broke", "new", "pending", 0, 5, None, 2, None, 1),
        ("other", "id-other", "old", "completed", 1, 5, None, 1, "boom", 1),
        ("blank", "id-blank", "old", None, 1, 5, None, 1, "boom", 1),
        (None, "id-?", "old", "failed", 4, 5, None, 1, "boom", 1),
        (None, None, "new", "pending", 0, 9, None, 2, None, 2),
        ("fresh", _sha("fresh"), "new", "pending", 0, 9, None, 2, None, 2),
    ]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
