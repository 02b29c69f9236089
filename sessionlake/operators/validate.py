"""Invariants of the store as queries: a row for each record that breaks a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.text import parsed_timestamp
from sessionlake.operators.store import Store
from sessionlake.schemas import MESSAGE_ROLES, PROVIDERS


def _broken(df: DataFrame, session: str, record: str, rules: dict[str, Column]) -> DataFrame:
    """``session_id, record_id, rule`` for each rule whose condition is true or unknown; all rules in one pass."""
    named = F.array_compact(F.array(*[F.when(F.coalesce(condition, F.lit(True)), F.lit(name)) for name, condition in rules.items()]))
    return df.withColumn("_rules", named).where(F.size("_rules") > 0).select(F.col(session).alias("session_id"), F.col(record).alias("record_id"), F.explode("_rules").alias("rule"))


def _unreadable(column: str) -> Column:
    """A time that is there but cannot be read."""
    said = F.coalesce(F.col(column), F.lit(""))
    return (said != "") & parsed_timestamp(F.col(column)).isNull()


def session_violations(store: Store) -> DataFrame:
    """Rules of sessions: known provider that leads the id, readable times in order, no negative counts, no parent that is the session."""
    sessions = store.rows("sessions", "provider", "started_at", "updated_at", "parent_session_id", "message_count", "tool_call_count")
    started, updated = parsed_timestamp(F.col("started_at")), parsed_timestamp(F.col("updated_at"))
    return _broken(
        sessions,
        "session_id",
        "session_id",
        {
            "session.provider": ~F.col("provider").isin(*PROVIDERS),
            "session.id_prefix": F.substring_index("session_id", ":", 1) != F.col("provider"),
            "session.started_at": _unreadable("started_at"),
            "session.updated_at": _unreadable("updated_at"),
            "session.time_order": F.coalesce(updated < started, F.lit(False)),
            "session.own_parent": F.coalesce(F.col("parent_session_id") == F.col("session_id"), F.lit(False)),
            "session.counts": F.coalesce((F.col("message_count") < 0) | (F.col("tool_call_count") < 0), F.lit(False)),
        },
    )


def message_violations(store: Store) -> DataFrame:
    """Rules of messages: a session that is here and of the same project, known role, text, readable time, a seq of their own."""
    messages = store.rows("messages", "seq", "role", "text", "ts", "project_key", "content_hash")
    sessions = store.rows("sessions", "project_key").select("session_id", F.col("project_key").alias("_project"), F.lit(True).alias("_session"))
    # rows are counted by (session, seq) first, so a long session is spread over its numbers
    shared = messages.groupBy("session_id", "seq").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    joined = messages.join(sessions, "session_id", "left").join(shared, ["session_id", "seq"], "left")
    return _broken(
        joined,
        "session_id",
        "event_id",
        {
            "message.session": F.col("_session").isNull(),
            "message.project": F.col("_session").isNotNull() & ~F.col("project_key").eqNullSafe(F.col("_project")),
            "message.role": ~F.col("role").isin(*MESSAGE_ROLES),
            "message.text": F.trim(F.coalesce("text", F.lit(""))) == "",
            "message.time": _unreadable("ts"),
            "message.seq": F.col("seq") < 0,
            "message.shared_seq": F.col("_n").isNotNull(),
            "message.hash": F.coalesce("content_hash", F.lit("")) == "",
        },
    )


def tool_call_violations(store: Store) -> DataFrame:
    """Rules of tool calls: a session that is here and of the same provider, a name, hashes of their payloads, times in order."""
    calls = store.rows("tool_calls", "session_id", "seq", "tool_name", "input_text", "output_text", "input_hash", "output_hash", "started_at", "completed_at", "provider")
    sessions = store.rows("sessions", "provider").select("session_id", F.col("provider").alias("_provider"), F.lit(True).alias("_session"))
    started, completed = parsed_timestamp(F.col("started_at")), parsed_timestamp(F.col("completed_at"))
    other = lambda text, digest: F.coalesce(F.sha2(text, 256) != F.col(digest), F.lit(False))
    return _broken(
        calls.join(sessions, "session_id", "left"),
        "session_id",
        "id",
        {
            "tool_call.session": F.col("_session").isNull(),
            "tool_call.provider": F.col("_session").isNotNull() & ~F.col("provider").eqNullSafe(F.col("_provider")),
            "tool_call.name": F.coalesce("tool_name", F.lit("")) == "",
            "tool_call.input_hash": other("input_text", "input_hash"),
            "tool_call.output_hash": other("output_text", "output_hash"),
            "tool_call.time_order": F.coalesce(completed < started, F.lit(False)),
            "tool_call.seq": F.col("seq") < 0,
        },
    )


def vector_violations(store: Store) -> DataFrame:
    """Rules of vectors: as many numbers as declared, all finite."""
    vectors = store.rows("message_vectors", "session_id", "dimensions", "vector")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(3.4028235e38)))
    record = vectors.withColumn("_id", F.col("vec_rowid").cast("string"))
    return _broken(record, "session_id", "_id", {"vector.missing": F.col("vector").isNull(), "vector.dimensions": F.coalesce(F.size("vector") != F.col("dimensions"), F.lit(False)), "vector.finite": F.coalesce(~finite, F.lit(False))})


def violations(store: Store) -> DataFrame:
    """``session_id, record_id, rule`` over all tables."""
    return reduce(DataFrame.unionByName, [session_violations(store), message_violations(store), tool_call_violations(store), vector_violations(store)])


def audit(store: Store, most_examples: int = 3) -> DataFrame:
    """``rule, n_records, n_sessions, examples``: how often each rule is broken, with its first records.

    The examples are the smallest ids, found by a rank filter that works before the shuffle.
    """
    found = violations(store)
    # counted a rule and session first: a rule that a third of all records break costs a row for each of its sessions
    totals = found.groupBy("rule", "session_id").agg(F.count("*").alias("_n")).groupBy("rule").agg(F.sum("_n").alias("n_records"), F.count("session_id").alias("n_sessions"))
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("rule").orderBy("record_id", "session_id"))).where(F.col("_r") <= most_examples)
    return totals.join(first.groupBy("rule").agg(F.sort_array(F.collect_list("record_id")).alias("examples")), "rule", "left")


def sample_by_hash(df: DataFrame, key: str, count: int, salt: str = "") -> DataFrame:
    """``count`` rows in the order of a hash of their key: the same rows whatever their order or partitioning."""
    return df.orderBy(F.xxhash64(F.concat(F.col(key).cast("string"), F.lit(salt))), key).limit(count)


def replay_differences(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, side``: rows of one run of the same input that the other does not have; empty where a replay is idempotent."""
    columns = first.columns
    tagged = first.select(*columns, F.lit(1).alias("_n")).unionByName(second.select(*columns, F.lit(-1).alias("_n")))
    differing = tagged.groupBy(*columns).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
    return differing.select(*keys, F.when(F.col("_n") > 0, "first").otherwise("second").alias("side"))
