"""The relational store: tables without re-deliveries, counts, coverage and integrity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions.text import parsed_timestamp
from sessionlake.runtime import Folder, table
from sessionlake.schemas import MESSAGE_ROLES

KEYS = {"projects": ["project_key"], "sessions": ["session_id"], "messages": ["session_id", "event_id", "seq"], "tool_calls": ["id"], "message_vectors": ["vec_rowid"], "session_events": ["session_id", "id"], "usage_records": ["session_id", "id"], "session_edges": ["session_id", "id"], "session_artifacts": ["session_id", "id"], "execution_contexts": ["session_id", "id"], "search_matches": ["search_id", "match_key"], "lineage_requests": ["request_id"]}


class Store:
    """The tables below one folder.

    A message is known by its session, event id and seq, so that those without event id stay apart.

    Re-delivered rows equal the first delivery in every column but ``ingested_at``, so a filter on any other
    column may run before they are removed, and any one of them may stay.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def rows(self, name: str, *columns: str | Column, where: Column | None = None) -> DataFrame:
        """The rows of a table, one a key: filtered, then pruned to ``columns``, then made distinct.

        A column may be an expression: what is measured of a text before the rows are made distinct is all of
        it that is shuffled.
        """
        keys = KEYS[name]
        df = table(self.spark, self.base, name)
        if where is not None:
            df = df.where(where)
        named = [c for c in columns if isinstance(c, str)]
        wanted = list(dict.fromkeys([*keys, *named])) if columns else [c for c in df.columns if c != "ingested_at"]
        return df.select(*wanted, *[c for c in columns if not isinstance(c, str)]).dropDuplicates(keys)

    def has(self, name: str) -> bool:
        """Whether the table is here."""
        return Folder(self.spark, self.base).has(f"{name}.parquet")

    def texts(self, name: str, keys_of: DataFrame, *columns: str) -> DataFrame:
        """``keys_of``, a page of rows with the table's keys, with ``columns`` of the table.

        The page is bounded, so it is sent to the scan; of the texts only those of the page are shuffled.
        """
        keys = KEYS[name]
        page = keys_of.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        found = table(self.spark, self.base, name).select(*keys, *columns).join(F.broadcast(page), same, "left_semi").dropDuplicates(keys)
        on = F.lit(True)
        for k in keys:
            on = on & keys_of[k].eqNullSafe(F.col(f"_t_{k}"))
        return keys_of.join(found.withColumnsRenamed({k: f"_t_{k}" for k in keys}), on).drop(*[f"_t_{k}" for k in keys])


def searchable() -> Column:
    """Messages that search and embedding see."""
    return F.col("role").isin(*MESSAGE_ROLES)


def table_counts(store: Store, names: tuple[str, ...] = ("projects", "sessions", "messages", "tool_calls", "message_vectors")) -> DataFrame:
    """``table_name, n_rows`` of distinct records."""
    counts = [store.rows(n, *KEYS[n]).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def child_counts(store: Store) -> DataFrame:
    """``session_id, n_messages, n_tool_calls, n_vectors`` of every session, also of those without any."""
    out = store.rows("sessions", "session_id")
    for name, alias in (("messages", "n_messages"), ("tool_calls", "n_tool_calls"), ("message_vectors", "n_vectors")):
        counts = store.rows(name, "session_id").groupBy("session_id").agg(F.count("*").alias(alias))
        out = out.join(counts, "session_id", "left").withColumn(alias, F.coalesce(alias, F.lit(0)))
    return out


def _live_keys() -> list[str]:
    return ["session_id", "seq", "role", "content_hash"]


def missing_vectors(store: Store, model: str) -> DataFrame:
    """Searchable messages without a live vector of ``model``: same session, seq, role and content hash."""
    messages = store.rows("messages", "seq", "role", "content_hash", where=searchable())
    vectors = store.rows("message_vectors", *_live_keys(), where=F.col("model") == model).select(*_live_keys()).distinct()
    return messages.join(vectors, _live_keys(), "left_anti").select("session_id", "seq", "event_id")


def stale_vectors(store: Store, model: str) -> DataFrame:
    """Vectors of ``model`` whose message is gone, or says something else by now."""
    vectors = store.rows("message_vectors", *_live_keys(), where=F.col("model") == model)
    messages = store.rows("messages", "seq", "role", "content_hash").select("session_id", "seq", F.col("role").alias("_role"), F.col("content_hash").alias("_hash"))
    joined = vectors.join(messages, ["session_id", "seq"], "left")
    return joined.where(F.col("_role").isNull() | (F.col("_role") != F.col("role")) | ~F.col("_hash").eqNullSafe(F.col("content_hash"))).select("vec_rowid", "session_id", "seq").distinct()


def vector_coverage(store: Store, model: str) -> DataFrame:
    """``searchable, matching, vectorless, stale`` for one model, in one row."""
    messages = store.rows("messages", "seq", "role", "content_hash", where=searchable())
    vectors = store.rows("message_vectors", *_live_keys(), where=F.col("model") == model)
    matching = vectors.join(messages, _live_keys(), "left_semi").agg(F.count("*").alias("matching"))
    counts = messages.agg(F.count("*").alias("searchable")).crossJoin(matching).crossJoin(stale_vectors(store, model).agg(F.count("*").alias("stale")))
    return counts.select("searchable", "matching", F.greatest(F.col("searchable") - F.col("matching"), F.lit(0)).alias("vectorless"), "stale")


def dangling_parents(store: Store) -> DataFrame:
    """Sessions that name a parent which is not here."""
    sessions = store.rows("sessions", "parent_session_id")
    named = sessions.where(F.col("parent_session_id").isNotNull() & (F.col("parent_session_id") != ""))
    return named.join(sessions.select(F.col("session_id").alias("parent_session_id")), "parent_session_id", "left_anti").select("session_id", "parent_session_id")


def complete_roots(store: Store) -> DataFrame:
    """Roots with at least one child that is here."""
    sessions = store.rows("sessions", "parent_session_id")
    roots = sessions.where(F.col("parent_session_id").isNull()).select("session_id")
    return roots.join(sessions.select(F.col("parent_session_id").alias("session_id")), "session_id", "left_semi")


def empty_sessions(store: Store) -> DataFrame:
    """Sessions without messages, tool calls and vectors."""
    out = store.rows("sessions", "session_id")
    for name in ("messages", "tool_calls", "message_vectors"):
        out = out.join(table(store.spark, store.base, name).select("session_id"), "session_id", "left_anti")
    return out


def sessions_with_message_model(store: Store, model: str) -> DataFrame:
    """Sessions of which some message was written by ``model``."""
    having = table(store.spark, store.base, "messages").where(F.col("model") == model).select("session_id")
    return store.rows("sessions", "session_id").join(having, "session_id", "left_semi")


def provider_totals(store: Store) -> DataFrame:
    """``provider, n_sessions, n_messages, n_tool_calls`` and a row of totals with a null provider, from one pass over the sessions."""
    return child_counts(store).join(store.rows("sessions", "provider"), "session_id").rollup("provider").agg(F.count("*").alias("n_sessions"), F.sum("n_messages").alias("n_messages"), F.sum("n_tool_calls").alias("n_tool_calls"))


def declared_count_gaps(store: Store) -> DataFrame:
    """Sessions whose declared counts are not those of their rows."""
    declared = store.rows("sessions", "message_count", "tool_call_count")
    joined = declared.join(child_counts(store), "session_id")
    return joined.where(~F.col("message_count").eqNullSafe(F.col("n_messages")) | ~F.col("tool_call_count").eqNullSafe(F.col("n_tool_calls"))).select("session_id", "message_count", "n_messages", "tool_call_count", "n_tool_calls")


def top_project(store: Store) -> DataFrame:
    """The project with most messages, by key where several have as many."""
    counts = store.rows("messages", "project_key").groupBy("project_key").agg(F.count("*").alias("n_messages"))
    return counts.orderBy(F.desc("n_messages"), "project_key").limit(1)


def call_durations(store: Store) -> DataFrame:
    """``tool_name, n_calls, p50_ms, p95_ms``: nearest-rank quantiles of the time from start to completion."""
    span = (F.unix_micros(parsed_timestamp(F.col("completed_at"))) - F.unix_micros(parsed_timestamp(F.col("started_at")))) / 1000.0
    timed = store.rows("tool_calls", "tool_name", "started_at", "completed_at").select("tool_name", span.alias("ms")).where(F.col("ms").isNotNull())
    return timed.groupBy("tool_name").agg(F.count("*").alias("n_calls"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ms)").alias("p50_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95_ms"))


def embedding_coverage(store: Store, model: str) -> DataFrame:
    """``n_hashes, n_hits, n_misses`` over the different content hashes of searchable messages, in one row."""
    wanted = store.rows("messages", "content_hash", where=searchable()).select("content_hash").where(F.col("content_hash").isNotNull()).distinct()
    held = table(store.spark, store.base, "message_vectors").where(F.col("model") == model).select("content_hash").distinct().withColumn("_hit", F.lit(True))
    joined = wanted.join(held, "content_hash", "left")
    hits = F.count("_hit")
    return joined.agg(F.count("*").alias("n_hashes"), hits.alias("n_hits"), (F.count("*") - hits).alias("n_misses"))


def first_seen_sessions(store: Store) -> DataFrame:
    """``session_id, position``: the sessions of the search matches in the order of their first match."""
    matches = store.rows("search_matches", "session_id")
    first = matches.groupBy("session_id").agg(F.min(F.struct("search_id", "match_key")).alias("_first"))
    ordered = first.select("session_id", "_first.search_id", "_first.match_key")
    from pyspark.sql import Window

    # the matches of a search are a bounded page; one number for each session of those pages
    return ordered.select("session_id", F.row_number().over(Window.orderBy("search_id", "match_key")).cast("long").alias("position"))
