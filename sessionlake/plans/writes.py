"""The named queries of writing, jobs and enrichments, over states made from the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.operators import jobs, merge, normalize
from sessionlake.operators.store import Store
from sessionlake.plans.catalog import _M, _MODEL, _S, _T, _V, query
from sessionlake.plans.query import enrichment_page, session_sections
from sessionlake.runtime import checkpoint
from sessionlake.schemas import TABLES

_NOW = "2026-07-01 00:00:00"


def _now():
    return F.to_timestamp(F.lit(_NOW))


# ---- upserts and differences


@query(
    f"""WITH {_S}, i AS (SELECT session_id, 'new' AS model, normalization_version + length(title) % 3 - 1 AS v FROM s WHERE title IS NOT NULL)
SELECT s.session_id, CASE WHEN i.v >= s.normalization_version THEN i.model ELSE s.model END AS model, greatest(s.normalization_version, coalesce(i.v, s.normalization_version))::int AS normalization_version FROM s LEFT JOIN i USING (session_id)"""
)
def upserted_sessions(spark: SparkSession, base: str) -> DataFrame:
    """The sessions after new versions of those with a title have come, some of them older than what is stored."""
    stored = Store(spark, base).rows("sessions", "model", "normalization_version", "title")
    incoming = stored.where(F.col("title").isNotNull()).withColumns({"model": F.lit("new"), "normalization_version": (F.col("normalization_version") + F.length("title") % 3 - 1).cast("int")})
    return merge.upsert(stored.drop("title"), incoming.drop("title"), ["session_id"], "normalization_version")


@query(
    f"""WITH {_T}, old AS (SELECT * FROM t WHERE seq % 5 <> 0), new AS (SELECT id, session_id, status, tool_name, input_hash, CASE WHEN seq % 7 = 0 THEN output_hash || 'x' ELSE output_hash END AS output_hash FROM t WHERE seq % 11 <> 10),
  o AS (SELECT * FROM old WHERE session_id IN (SELECT session_id FROM new))
SELECT coalesce(o.id, new.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN new.id IS NULL THEN 'delete' WHEN (o.status, o.tool_name, o.input_hash, o.output_hash) IS DISTINCT FROM (new.status, new.tool_name, new.input_hash, new.output_hash) THEN 'update' ELSE 'unchanged' END AS change
FROM o FULL JOIN new ON o.session_id = new.session_id AND o.id = new.id"""
)
def tool_call_diff(spark: SparkSession, base: str) -> DataFrame:
    """Row-level changes between two states of the tool calls, their payloads told apart by hash."""
    rows = Store(spark, base).rows("tool_calls", "session_id", "seq", "status", "tool_name", "input_hash", "output_hash")
    new = rows.where(F.col("seq") % 11 != 10).withColumn("output_hash", F.when(F.col("seq") % 7 == 0, F.concat("output_hash", F.lit("x"))).otherwise(F.col("output_hash")))
    return merge.diff(rows.where(F.col("seq") % 5 != 0), new, ["session_id", "id"], ["session_id"], ["status", "tool_name", "input_hash", "output_hash"]).select("id", "change")


@query(
    f"""WITH {_M}, e AS (SELECT session_id, event_id AS id, seq, content_hash AS fact_hash FROM m), old AS (SELECT * FROM e WHERE seq % 3 <> 0), new AS (SELECT session_id, id, seq, CASE WHEN seq % 4 = 0 THEN fact_hash || '!' ELSE fact_hash END AS fact_hash FROM e WHERE seq % 5 <> 4),
  o AS (SELECT * FROM old WHERE session_id IN (SELECT session_id FROM new))
SELECT coalesce(o.session_id, new.session_id) AS session_id, coalesce(o.id, new.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN new.id IS NULL THEN 'delete' WHEN (o.seq, o.fact_hash) IS DISTINCT FROM (new.seq, new.fact_hash) THEN 'update' ELSE 'unchanged' END AS change
FROM o FULL JOIN new ON o.session_id = new.session_id AND o.id = new.id"""
)
def fact_diff(spark: SparkSession, base: str) -> DataFrame:
    """Row-level changes between two states of the session events, one of the fact tables, told by place and hash."""
    rows = Store(spark, base).rows("messages", "seq", "content_hash")
    facts = rows.select("session_id", F.col("event_id").alias("id"), F.col("seq").alias("sequence"), F.col("content_hash").alias("fact_hash"), F.lit("{}").alias("event_json"))
    new = facts.where(F.col("sequence") % 5 != 4).withColumn("fact_hash", F.when(F.col("sequence") % 4 == 0, F.concat("fact_hash", F.lit("!"))).otherwise(F.col("fact_hash")))
    return merge.diff_facts("session_events", facts.where(F.col("sequence") % 3 != 0), new)


@query(
    f"""WITH {_M}, {_V}, u AS (SELECT DISTINCT ON (model, session_id, seq) * FROM v ORDER BY model, session_id, seq, vec_rowid), o AS (SELECT * FROM u WHERE vec_rowid % 2 = 0),
  i AS (SELECT u.* FROM u WHERE vec_rowid % 3 = 0 AND EXISTS (FROM m WHERE m.session_id = u.session_id AND m.seq = u.seq AND m.role = u.role AND m.content_hash = u.content_hash))
SELECT model, session_id, seq, CASE WHEN i.vec_rowid IS NULL THEN o.created_at ELSE coalesce(o.created_at, 'now') END AS created_at, CASE WHEN i.vec_rowid IS NOT NULL THEN 'now' ELSE o.updated_at END AS updated_at FROM o FULL JOIN i USING (model, session_id, seq)"""
)
def upserted_vectors(spark: SparkSession, base: str) -> DataFrame:
    """The vectors after an upsert, which takes those whose message still says the same and keeps the first time of creation."""
    shop = Store(spark, base)
    keys = ["model", "session_id", "seq"]
    rest = ["vec_rowid", "role", "content_hash", "created_at", "updated_at"]
    rows = shop.rows("message_vectors", *keys, *rest).groupBy(*keys).agg(F.min_by(F.struct(*rest), "vec_rowid").alias("_r")).select(*keys, "_r.*")
    messages = shop.rows("messages", "seq", "role", "content_hash")
    stored = rows.where(F.col("vec_rowid") % 2 == 0)
    return merge.upsert_vectors(stored, rows.where(F.col("vec_rowid") % 3 == 0), messages, "now").select(*keys, "created_at", "updated_at")


@query(f"WITH {_M}, {_V}, c AS (SELECT DISTINCT content_hash FROM v WHERE model = '{_MODEL}') SELECT role, count(*) AS n_wanted, count(c.content_hash) AS n_cached FROM (SELECT role, content_hash FROM m WHERE content_hash IS NOT NULL) w LEFT JOIN c USING (content_hash) GROUP BY 1")
def cached_vectors(spark: SparkSession, base: str) -> DataFrame:
    """How many contents of each role the embedding cache has."""
    shop = Store(spark, base)
    wanted = shop.rows("messages", "role", "content_hash").where(F.col("content_hash").isNotNull())
    cache = shop.rows("message_vectors", "model", "content_hash", F.lit(True).alias("vector"))
    return jobs.from_cache(wanted, cache, _MODEL).groupBy("role").agg(F.count("*").alias("n_wanted"), F.count("vector").alias("n_cached"))


# ---- the queue

_JOBS = f"{_S}, j AS (SELECT session_id, 'embed:' || session_id || ':' || sha256(coalesce(source_fingerprint, '')) AS key FROM s), q AS (SELECT session_id, key, sha256(key) AS id, row_number() OVER (ORDER BY sha256(key)) AS n FROM j)"


def _queue(spark: SparkSession, base: str) -> DataFrame:
    sessions = Store(spark, base).rows("sessions", "source_fingerprint")
    return jobs.enqueue(spark.createDataFrame([], TABLES["queue_jobs"]), jobs.fan_out(sessions), _now())


@query(f"WITH {_JOBS} SELECT id AS job_id, CASE WHEN n <= 20 THEN 'leased' ELSE 'pending' END AS status, (n <= 20)::int AS attempts, CASE WHEN n <= 20 THEN 'worker' END AS leased_by FROM q")
def leased_jobs(spark: SparkSession, base: str) -> DataFrame:
    """The queue of embedding jobs after a worker has leased the first twenty."""
    return jobs.lease(_queue(spark, base), "embed", "worker", _now(), 20).select("job_id", "status", "attempts", "leased_by")


@query(
    f"WITH {_JOBS} SELECT id AS job_id, CASE WHEN n <= 20 AND id < '8' THEN 'completed' ELSE 'pending' END AS status, CASE WHEN n <= 20 AND id >= '8' THEN 'boom' END AS last_error, "
    f"(CASE WHEN n <= 20 AND id >= '8' THEN 5 ELSE 0 END)::bigint AS wait_seconds FROM q"
)
def settled_jobs(spark: SparkSession, base: str) -> DataFrame:
    """The queue after some of the leased jobs were done and the others are to be tried again."""
    leased = jobs.lease(_queue(spark, base), "embed", "worker", _now(), 20)
    outcomes = leased.where("status = 'leased'").select("job_id", (F.col("job_id") < "8").alias("ok"), F.when(F.col("job_id") >= "8", "boom").alias("error"))
    return jobs.settle(leased, outcomes, _now()).select("job_id", "status", "last_error", (F.unix_seconds("next_run_at") - F.unix_seconds(_now())).alias("wait_seconds"))


@query(f"WITH {_JOBS} SELECT id AS job_id, CASE WHEN n <= 20 AND id < '8' THEN 'pending' WHEN n <= 20 THEN 'failed' ELSE 'pending' END AS status FROM q WHERE NOT (n <= 20 AND id >= '8' AND session_id LIKE '%1')")
def pruned_jobs(spark: SparkSession, base: str) -> DataFrame:
    """The queue after completed jobs were asked for again, and failed ones of sessions that are gone were removed."""
    leased = checkpoint(jobs.lease(_queue(spark, base), "embed", "worker", _now(), 20).withColumn("max_attempts", F.lit(1)))
    outcomes = leased.where("status = 'leased'").select("job_id", (F.col("job_id") < "8").alias("ok"), F.lit("boom").alias("error"))
    settled = checkpoint(jobs.settle(leased, outcomes, _now()))
    sessions = Store(spark, base).rows("sessions", "source_fingerprint")
    again = jobs.enqueue(settled, jobs.fan_out(sessions.join(settled.where("status = 'completed'").select(F.get_json_object("payload_json", "$.session_id").alias("session_id")), "session_id", "left_semi")), _now())
    return jobs.prune(again, sessions.where(~F.col("session_id").endswith("1"))).select("job_id", "status")


@query(f"WITH {_JOBS} SELECT 'embed' AS kind, (SELECT count(*) FROM q) - 20 AS pending, 20::bigint AS leased, 0::bigint AS completed, 0::bigint AS failed")
def queue_totals(spark: SparkSession, base: str) -> DataFrame:
    """Jobs by kind and status."""
    return jobs.queue_totals(jobs.lease(_queue(spark, base), "embed", "worker", _now(), 20))


# ---- enrichments and the parts of a session

_ENRICHED = f"{_S}, e AS (SELECT session_id, n AS namespace, 'p' || length(session_id) % 3 AS producer, sha256(session_id) AS input_hash, coalesce(title, '') AS payload_json FROM s, (VALUES ('labels'), ('summary')) x(n) WHERE n = 'labels' OR title IS NOT NULL)"


def _enrichments(spark: SparkSession, base: str) -> DataFrame:
    sessions = Store(spark, base).rows("sessions", "title")
    each = sessions.withColumn("namespace", F.explode(F.array(F.lit("labels"), F.lit("summary")))).where((F.col("namespace") == "labels") | F.col("title").isNotNull())
    return each.select("session_id", "namespace", F.lit("1").alias("protocol_version"), F.lit(1).alias("schema_version"), F.concat(F.lit("p"), (F.length("session_id") % 3).cast("string")).alias("producer"), F.sha2("session_id", 256).alias("input_hash"), F.coalesce("title", F.lit("")).alias("payload_json"), F.lit("t0").alias("updated_at"))


@query(
    f"""WITH {_ENRICHED}, i AS (SELECT session_id, namespace, CASE WHEN session_id LIKE '%a' THEN payload_json || '!' ELSE payload_json END AS payload_json, session_id LIKE '%b' AS unknown FROM e WHERE namespace = 'summary')
SELECT session_id || CASE WHEN unknown THEN '?' ELSE '' END AS session_id, namespace, CASE WHEN unknown THEN 'rejected' WHEN session_id LIKE '%c' THEN 'inserted' WHEN session_id LIKE '%a' THEN 'updated' ELSE 'unchanged' END AS outcome FROM i"""
)
def enrichment_outcomes(spark: SparkSession, base: str) -> DataFrame:
    """What becomes of incoming enrichments: of absent sessions, new, changed and equal ones."""
    stored = _enrichments(spark, base)
    incoming = stored.where("namespace = 'summary'").withColumns({"payload_json": F.when(F.col("session_id").endswith("a"), F.concat("payload_json", F.lit("!"))).otherwise(F.col("payload_json")), "session_id": F.when(F.col("session_id").endswith("b"), F.concat("session_id", F.lit("?"))).otherwise(F.col("session_id"))})
    held = stored.where(~((F.col("namespace") == "summary") & F.col("session_id").endswith("c")))
    return merge.enrich(held, incoming, Store(spark, base).rows("sessions", "session_id"))[1]


@query(f"WITH {_ENRICHED} SELECT e.session_id, namespace, producer, input_hash, project_key FROM e JOIN s USING (session_id) WHERE namespace = 'summary' AND producer = 'p1' AND (e.session_id, namespace) > ('codex:5', 'a') ORDER BY 1, 2 LIMIT 51")
def enrichments_page(spark: SparkSession, base: str) -> DataFrame:
    """A page of the enrichments of one namespace and producer after a key, and the row after it."""
    sessions = Store(spark, base).rows("sessions", "project_key")
    return enrichment_page(_enrichments(spark, base), sessions, namespace="summary", producer="p1", after=("codex:5", "a"), limit=50).select("session_id", "namespace", "producer", "input_hash", "project_key")


_LARGEST = "(SELECT session_id FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    f"""WITH {_M}, {_T}, a AS (SELECT 'messages' AS section, event_id AS id, row_number() OVER (ORDER BY seq, event_id) AS n, count(*) OVER () AS total FROM m WHERE session_id = {_LARGEST}
  UNION ALL SELECT 'tool_calls', id, row_number() OVER (ORDER BY seq, id), count(*) OVER () FROM t WHERE session_id = {_LARGEST})
SELECT section, id, total, 15 < total AS has_more FROM a WHERE n BETWEEN 6 AND 15"""
)
def session_detail(spark: SparkSession, base: str) -> DataFrame:
    """The second pages of the seven sections of the session with most calls; the test tables have rows for two of them."""
    shop = Store(spark, base)
    named = shop.rows("tool_calls", "session_id").groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first()
    return session_sections(shop, named["session_id"] if named else "", limit=10, offset=5)


# ---- words of the sources

_WORDS = ("user", "assistant", "developer", "system", "tool", "thinking", "User", "human", "model", "agent", None, "", "tool_use", "tool_result", "toolResult", "function_call", "reasoning", "preamble", "ai-summary", "compacted", "usage", "event_token_count", "file-snapshot", "diffs", "message", "messages", "session_meta", "phase_change", "turn_context", "loop", "other")
_ROLE_OF = {"user": "user", "assistant": "assistant", "developer": "developer", "system": "system", "tool": "tool", "thinking": "thinking"}
_KIND_OF = {"user": "message", "assistant": "message", "system": "system", "tool": "tool_call", "thinking": "reasoning", "tool_use": "tool_call", "tool_result": "tool_result", "toolResult": "tool_call", "reasoning": "reasoning", "preamble": "preamble", "ai-summary": "summary", "compacted": "summary", "usage": "usage", "event_token_count": "usage", "file-snapshot": "snapshot", "diffs": "snapshot", "message": "message", "session_meta": "system", "phase_change": "lifecycle", "turn_context": "lifecycle", "loop": "lifecycle"}


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


@query("FROM (VALUES " + ", ".join(f"({_quoted(w)}, '{_ROLE_OF.get(w, 'unknown')}', '{_KIND_OF.get(w, 'unknown')}')" for w in _WORDS) + ") w(word, role, kind)")
def native_words(spark: SparkSession, base: str) -> DataFrame:
    """Roles and kinds of the words that sources use."""
    words = spark.createDataFrame([(w,) for w in _WORDS], "word string")
    return words.select("word", normalize.role_of(F.col("word")).alias("role"), normalize.kind_of(F.col("word")).alias("kind"))
