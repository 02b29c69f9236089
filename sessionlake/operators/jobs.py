"""The embedding pipeline and its durable queue as tables: chunks, cache, missing work, leases, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.vectors import mean_vector

CHUNK = 12_000
MOST_BACKOFF_SECONDS, MOST_DOUBLINGS = 600, 8
TERMINAL = ("completed", "failed")


def chunks(df: DataFrame, keys: list[str], text: str, size: int = CHUNK) -> DataFrame:
    """``keys, chunk_no, chunk``: each text cut into ``size`` code points; the empty text is one empty chunk, a null none."""
    count = F.greatest(F.ceil(F.length(text) / size).cast("int"), F.lit(1))
    starts = F.sequence(F.lit(0), count - 1)
    cut = F.transform(starts, lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))
    return df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(cut).alias("chunk_no", "chunk"))


def document_vectors(chunk_vectors: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys, vector, n_vectors``: the mean of the vectors of a document's chunks."""
    return mean_vector(chunk_vectors, keys, vector)


def from_cache(wanted: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """``wanted`` (content_hash, ...) with the cached ``vector`` of a model, null where it must be embedded."""
    held = cache.where(F.col("model") == model).groupBy("content_hash").agg(F.any_value("vector").alias("vector"))
    return wanted.join(held, "content_hash", "left")


def fan_out(sessions: DataFrame, kinds: tuple[str, ...] = ("embed",)) -> DataFrame:
    """``idempotency_key, kind, payload_json``: the jobs that a written session asks for, each once."""
    kind = F.explode(F.array(*map(F.lit, kinds)))
    jobs = sessions.select("session_id", "source_fingerprint", kind.alias("kind"))
    key = F.concat_ws(":", "kind", "session_id", F.sha2(F.coalesce("source_fingerprint", F.lit("")), 256))
    return jobs.select(key.alias("idempotency_key"), "kind", F.to_json(F.struct("session_id")).alias("payload_json")).dropDuplicates(["idempotency_key"])


def enqueue(jobs: DataFrame, incoming: DataFrame, now: Column, most_attempts: int = 5) -> DataFrame:
    """The queue after ``incoming``: new keys wait, terminal jobs of a known key start again, others stay as they are.

    One full join, so that a plan of several changes reads ``jobs`` once for each of them.
    """
    keys = incoming.dropDuplicates(["idempotency_key"]).select("idempotency_key", F.col("kind").alias("_kind"), F.col("payload_json").alias("_payload"), F.lit(True).alias("_asked"))
    both = jobs.withColumn("_held", F.lit(True)).join(keys, "idempotency_key", "full")
    held = F.col("_held").isNotNull()
    stays = held & ~F.coalesce(F.col("_asked") & F.col("status").isin(*TERMINAL), F.lit(False))
    renewed = {"payload_json": F.col("_payload"), "attempts": F.lit(0), "next_run_at": now, "last_error": F.lit(None).cast("string"), "status": F.lit("pending")}
    given = {
        "job_id": F.sha2("idempotency_key", 256), "kind": F.col("_kind"), "max_attempts": F.lit(most_attempts),
        "leased_by": F.lit(None).cast("string"), "lease_until": F.lit(None).cast("timestamp"), "updated_at": now,
    }
    return both.withColumns({c: F.when(stays, F.col(c)).otherwise(x) for c, x in renewed.items()} | {c: F.when(held, F.col(c)).otherwise(x) for c, x in given.items()}).drop("_kind", "_payload", "_asked", "_held")


def lease(jobs: DataFrame, kind: str, worker: str, now: Column, count: int, seconds: int = 60) -> DataFrame:
    """The queue after ``worker`` has leased up to ``count`` due jobs of a kind, oldest first."""
    due = jobs.where((F.col("kind") == kind) & (F.col("status") == "pending") & (F.col("next_run_at") <= now))
    taken = due.orderBy("next_run_at", "job_id").limit(count).select("job_id", F.lit(True).alias("_mine"))
    mine = F.col("_mine").isNotNull()
    return (
        jobs.join(taken, "job_id", "left")
        .withColumns(
            {
                "status": F.when(mine, "leased").otherwise(F.col("status")),
                "leased_by": F.when(mine, F.lit(worker)).otherwise(F.col("leased_by")),
                "lease_until": F.when(mine, now + F.make_interval(secs=F.lit(seconds))).otherwise(F.col("lease_until")),
                "attempts": F.col("attempts") + mine.cast("int"),
            }
        )
        .drop("_mine")
    )


def backoff_seconds(attempts: Column, base: float = 5.0) -> Column:
    """Seconds until the next attempt: doubled with each, at most ten minutes."""
    doubled = F.lit(base) * F.pow(F.lit(2.0), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(MOST_DOUBLINGS)))
    return F.least(doubled, F.lit(float(MOST_BACKOFF_SECONDS)))


def settle(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The queue after ``outcomes`` (job_id, ok, error): completed, to be tried again after a pause, or failed for good."""
    joined = jobs.join(outcomes.select("job_id", F.col("ok").alias("_ok"), F.col("error").alias("_error")), "job_id", "left")
    told, spent = F.col("_ok").isNotNull(), F.col("attempts") >= F.col("max_attempts")
    status = F.when(~told, F.col("status")).when(F.col("_ok"), "completed").when(spent, "failed").otherwise("pending")
    later = now + F.make_interval(secs=backoff_seconds(F.col("attempts")))
    return joined.withColumns(
        {
            "status": status,
            "next_run_at": F.when(told & ~F.col("_ok") & ~spent, later).otherwise(F.col("next_run_at")),
            "last_error": F.when(told & ~F.col("_ok"), F.col("_error")).otherwise(F.col("last_error")),
            "leased_by": F.when(told, F.lit(None).cast("string")).otherwise(F.col("leased_by")),
            "lease_until": F.when(told, F.lit(None).cast("timestamp")).otherwise(F.col("lease_until")),
        }
    ).drop("_ok", "_error")


def recover(jobs: DataFrame, now: Column) -> DataFrame:
    """The queue after leases that ran out have been given back."""
    lost = (F.col("status") == "leased") & (F.col("lease_until") < now)
    return jobs.withColumns(
        {
            "status": F.when(lost, "pending").otherwise(F.col("status")),
            "leased_by": F.when(lost, F.lit(None).cast("string")).otherwise(F.col("leased_by")),
            "lease_until": F.when(lost, F.lit(None).cast("timestamp")).otherwise(F.col("lease_until")),
        }
    )


def queue_totals(jobs: DataFrame) -> DataFrame:
    """``kind`` and a column for each status with its number of jobs."""
    statuses = ["pending", "leased", "completed", "failed"]
    return jobs.groupBy("kind").pivot("status", statuses).count().na.fill(0, statuses)


def prune(jobs: DataFrame, sessions: DataFrame) -> DataFrame:
    """The queue without completed jobs, without failed ones of sessions that are gone, and without failed ones that a later completed job of the session resolves."""
    named = jobs.withColumn("_session", F.get_json_object("payload_json", "$.session_id"))
    resolved = named.where(F.col("status") == "completed").groupBy("_session", "kind").agg(F.max("updated_at").alias("_done"))
    here = sessions.select(F.col("session_id").alias("_session")).distinct().withColumn("_here", F.lit(True))
    judged = named.join(here, "_session", "left").join(resolved, ["_session", "kind"], "left")
    gone = (F.col("status") == "failed") & (F.col("_here").isNull() | (F.col("_done") >= F.col("updated_at")))
    return judged.where((F.col("status") != "completed") & ~F.coalesce(gone, F.lit(False))).select(*jobs.columns)


def alerts(metrics: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """``name, value, threshold, firing`` for each rule (metric, above or below, threshold); a metric that is missing or not a number does not fire."""
    cases = metrics.sparkSession.createDataFrame(rules, "name string, side string, threshold double")
    joined = cases.join(metrics.select("name", "value"), "name", "left")
    beyond = F.when(F.col("side") == "above", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return joined.select("name", "value", "threshold", F.coalesce(beyond & ~F.isnan("value"), F.lit(False)).alias("firing"))


def dense_numbers(df: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Rows numbered from 0 within each group by ``order``."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("long"))
