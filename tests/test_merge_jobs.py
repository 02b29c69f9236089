import pytest
from pyspark.sql import functions as F

from sessionlake.operators import jobs, merge


def test_diff_and_apply(spark):
    schema = "session_id string, seq int, text string"
    old = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("s", 2, None), ("t", 0, "z")], schema)
    new = spark.createDataFrame([("s", 0, "a"), ("s", 1, "B"), ("s", 2, None), ("s", 3, "d")], schema)
    got = {r["seq"]: r["change"] for r in merge.diff(old, new, ["session_id", "seq"], ["session_id"], ["text"]).collect()}
    assert got == {0: "unchanged", 1: "update", 2: "unchanged", 3: "insert"}
    assert {r["change"] for r in merge.diff(old, new.limit(1), ["session_id", "seq"], ["session_id"], ["text"]).collect()} == {"unchanged", "delete"}
    after = merge.apply_diff(old, new, ["session_id"])
    assert after.count() == 5 and after.where("session_id = 't'").count() == 1


def test_upsert_takes_the_newest(spark):
    schema = "k string, v string, at int"
    got = merge.upsert(spark.createDataFrame([("a", "old", 1), ("b", "keep", 5)], schema), spark.createDataFrame([("a", "new", 1), ("b", "late", 2), ("c", "first", 0)], schema), ["k"], "at")
    assert {r["k"]: r["v"] for r in got.collect()} == {"a": "new", "b": "keep", "c": "first"}


def test_enrichments(spark):
    schema = "session_id string, namespace string, protocol_version string, schema_version int, producer string, input_hash string, payload_json string, updated_at string"
    row = lambda s, payload, at: (s, "n", "1", 1, "p", "h", payload, at)
    stored = spark.createDataFrame([row("a", "{}", "t0"), row("b", "{}", "t0")], schema)
    incoming = spark.createDataFrame([row("a", "{}", "t1"), row("b", "[1]", "t1"), row("c", "{}", "t1"), row("gone", "{}", "t1")], schema)
    merged, outcome = merge.enrich(stored, incoming, spark.createDataFrame([("a",), ("b",), ("c",)], "session_id string"))
    assert {r["session_id"]: r["outcome"] for r in outcome.collect()} == {"a": "unchanged", "b": "updated", "c": "inserted", "gone": "rejected"}
    assert {(r["session_id"], r["updated_at"]) for r in merged.collect()} == {("a", "t0"), ("b", "t1"), ("c", "t1")}


def test_versioned_tables(spark, tmp_path):
    tables = merge.VersionedTables(spark, str(tmp_path))
    first = tables.commit({"x": spark.range(3)})
    tables.check(first)
    second = tables.commit({"x": spark.range(5)})
    assert tables.read("x").count() == 5
    with pytest.raises(merge.SnapshotError, match="expired"):
        tables.check(first)
    with pytest.raises(Exception):
        tables.commit({"x": spark.range(1).select(F.raise_error(F.lit("no")))})
    assert tables.snapshot() == second and tables.read("x").count() == 5
    tables.begin()
    with pytest.raises(merge.SnapshotError, match="busy"):
        tables.snapshot()


def test_only_touched_buckets_are_written(spark, tmp_path):
    tables = merge.VersionedTables(spark, f"file://{tmp_path}/store", buckets=8)
    rows = [(f"s{i}", i, "a") for i in range(40)]
    schema = "session_id string, seq int, text string"
    first = tables.replace_sessions("m", spark.createDataFrame(rows, schema))
    before = tables._read()["tables"]["m"]["buckets"]
    assert tables.snapshot() == first and sorted(tuple(r) for r in tables.read("m").collect()) == sorted(rows)
    assert tables.replace_sessions("m", spark.createDataFrame(rows[:3], schema)) is None and tables.snapshot() == first
    tables.replace_sessions("m", spark.createDataFrame([("s7", 0, "b"), ("s7", 1, "c"), ("s3", 3, "a")], schema))
    after = tables._read()["tables"]["m"]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert sorted(tuple(r) for r in tables.read("m").collect()) == sorted([*[r for r in rows if r[0] != "s7"], ("s7", 0, "b"), ("s7", 1, "c")])


def test_ingest_decisions(spark):
    schema = "session_id string, source_fingerprint string, normalization_version int"
    stored = spark.createDataFrame([("a", "f", 2), ("b", "f", 1)], schema)
    incoming = spark.createDataFrame([("a", "f", 2), ("b", "f", 2), ("c", "g", 2)], schema)
    assert {r[0] for r in merge.to_ingest(incoming, stored).collect()} == {"b", "c"} and merge.to_ingest(incoming, stored, force=True).count() == 3
    files = spark.createDataFrame([("p", 1, "t"), ("q", 2, "t")], "path string, size int, modified string")
    manifest = spark.createDataFrame([("p", 1, "t", 2)], "path string, size int, modified string, normalization_version int")
    assert [r["path"] for r in merge.to_read(files, manifest, 2).collect()] == ["q"] and merge.to_read(files, manifest, 3).count() == 2


def test_queue(spark):
    from sessionlake.schemas import TABLES

    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    empty = spark.createDataFrame([], TABLES["queue_jobs"])
    sessions = spark.createDataFrame([("s", "f"), ("s", "f"), ("t", None)], "session_id string, source_fingerprint string")
    queue = jobs.enqueue(empty, jobs.fan_out(sessions), now).cache()
    assert queue.count() == 2 and jobs.enqueue(queue, jobs.fan_out(sessions), now).count() == 2
    leased = jobs.lease(queue, "embed", "w", now, 1).cache()
    assert {(r["status"], r["attempts"]) for r in leased.collect()} == {("leased", 1), ("pending", 0)}
    mine = leased.where("status = 'leased'").select("job_id", F.lit(False).alias("ok"), F.lit("boom").alias("error"))
    failed = jobs.settle(leased, mine, now)
    assert failed.where("last_error = 'boom' and status = 'pending' and next_run_at > timestamp'2024-01-01'").count() == 1
    done = jobs.settle(leased, mine.withColumn("ok", F.lit(True)), now)
    assert {r["status"]: 1 for r in done.collect()} == {"completed": 1, "pending": 1}
    assert jobs.recover(leased, F.to_timestamp(F.lit("2024-01-02 00:00:00"))).where("status = 'pending'").count() == 2
    totals = jobs.queue_totals(done).first()
    assert (totals["pending"], totals["completed"], totals["failed"]) == (1, 1, 0)
    assert jobs.prune(done, sessions).count() == 1
    assert jobs.enqueue(done, jobs.fan_out(sessions), now).where("status = 'pending'").count() == 2


def test_backoff_chunks_alerts(spark):
    waits = [r[0] for r in spark.createDataFrame([(i,) for i in (1, 2, 5, 50)], "n int").select(jobs.backoff_seconds(F.col("n"))).collect()]
    assert waits == [5.0, 10.0, 80.0, 600.0]
    docs = spark.createDataFrame([("a", "x" * 25), ("b", ""), ("c", None)], "k string, t string")
    assert sorted((r["k"], r["chunk_no"], len(r["chunk"])) for r in jobs.chunks(docs, ["k"], "t", 10).collect()) == [("a", 0, 10), ("a", 1, 10), ("a", 2, 5), ("b", 0, 0)]
    metrics = spark.createDataFrame([("lag", 5.0), ("rate", 0.1), ("odd", float("nan"))], "name string, value double")
    got = {r["name"]: r["firing"] for r in jobs.alerts(metrics, [("lag", "above", 3.0), ("rate", "below", 0.5), ("odd", "above", 0.0), ("absent", "above", 0.0)]).collect()}
    assert got == {"lag": True, "rate": True, "odd": False, "absent": False}
