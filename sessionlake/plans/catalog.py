"""The named queries of the core package and their DuckDB equivalents."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions import hashing, text, vectors
from sessionlake.operators import jobs, lineage, merge, normalize, redaction, search, store, trajectory, validate
from sessionlake.operators.store import Store
from sessionlake.plans import query as spec
from sessionlake.plans.query import Filters, point_lookup, select_messages, select_sessions, select_tool_calls
from sessionlake.runtime import shared_folder, table
from sessionlake.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- parent-child hierarchies

_NODES = "n AS (SELECT DISTINCT session_id AS id, nullif(parent_session_id, '') AS p FROM sessions), l AS (SELECT id, CASE WHEN p IN (SELECT id FROM n) THEN p END AS p FROM n)"


@query(
    f"""
WITH RECURSIVE {_NODES},
  up AS (SELECT id, id AS at, [id] AS path, false AS ring FROM l
    UNION ALL SELECT up.id, l.p, list_append(up.path, l.p), list_contains(up.path, l.p) FROM up JOIN l ON l.id = up.at WHERE l.p IS NOT NULL AND NOT up.ring),
  last AS (SELECT id, arg_max(path, len(path)) AS path, bool_or(ring) AS ring FROM up GROUP BY id)
SELECT last.id AS session_id,
  CASE WHEN ring THEN list_min(list_slice(path, list_position(path, path[-1]), len(path))) ELSE path[-1] END AS root_session_id,
  (CASE WHEN ring THEN -1 ELSE len(path) - 1 END)::bigint AS depth
FROM last JOIN l USING (id) WHERE l.p IS NOT NULL
"""
)
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """The root and depth of each session whose parent is a session."""
    tree = lineage.hierarchy(lineage.links(table(spark, base, "sessions")))
    return tree.where(F.col("parent").isNotNull()).select(F.col("id").alias("session_id"), F.col("root").alias("root_session_id"), "depth")


@query()
def p2_hierarchy(spark: SparkSession, base: str) -> DataFrame:
    """The place of each session: path, depth, root, interval and number of descendants, cycles."""
    return lineage.hierarchy(lineage.links(table(spark, base, "sessions"))).withColumnRenamed("id", "session_id")


@query(
    f"""
WITH RECURSIVE {_NODES},
  up AS (SELECT id, id AS at, [id] AS path, false AS ring FROM l
    UNION ALL SELECT up.id, l.p, list_append(up.path, l.p), list_contains(up.path, l.p) FROM up JOIN l ON l.id = up.at WHERE l.p IS NOT NULL AND NOT up.ring),
  last AS (SELECT id, arg_max(path, len(path)) AS path, bool_or(ring) AS ring FROM up GROUP BY id),
  rooted AS (SELECT id, path, ring, CASE WHEN ring THEN list_min(list_slice(path, list_position(path, path[-1]), len(path))) ELSE path[-1] END AS root FROM last),
  placed AS (SELECT id, root, ring, list_reverse(list_slice(path, 1, list_position(path, root))) AS path FROM rooted),
  held AS (SELECT unnest(path) AS id, count(*) - 1 AS n FROM placed GROUP BY 1)
SELECT id AS session_id, root AS root_session_id, (CASE WHEN ring THEN -1 ELSE len(path) - 1 END)::bigint AS depth, array_to_string(path, '/') AS path, n AS n_descendants FROM placed JOIN held USING (id)
"""
)
def p2_paths(spark: SparkSession, base: str) -> DataFrame:
    """The path from the root to each session, and how many sessions are below it."""
    tree = lineage.hierarchy(lineage.links(table(spark, base, "sessions")))
    return tree.select(F.col("id").alias("session_id"), F.col("root").alias("root_session_id"), "depth", F.array_join("path", "/").alias("path"), "n_descendants")


@query(
    f"""
WITH RECURSIVE {_NODES},
  r AS (SELECT DISTINCT request_id, lineage_root_session_id AS root FROM lineage_requests),
  down AS (SELECT request_id, l.id AS session_id, 0::bigint AS distance, [l.id] AS path FROM r JOIN l ON l.id = r.root
    UNION ALL SELECT request_id, l.id, distance + 1, list_append(path, l.id) FROM down JOIN l ON l.p = down.session_id WHERE NOT list_contains(path, l.id))
SELECT request_id, session_id, distance FROM down
"""
)
def p2_requests(spark: SparkSession, base: str) -> DataFrame:
    """The sessions at and below each requested lineage root."""
    tree = lineage.hierarchy(lineage.links(table(spark, base, "sessions")))
    return lineage.lineage_of_requests(tree, table(spark, base, "lineage_requests"))


# ---- typed queries. The SQL removes re-deliveries by DISTINCT over all columns but ingested_at.

_S = "s AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM sessions)"
_M = "m AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM messages)"
_T = "t AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM tool_calls)"
_V = "v AS (SELECT DISTINCT ON (vec_rowid) * EXCLUDE (ingested_at) FROM message_vectors)"
_TIME = "try_cast(CASE WHEN regexp_matches({0}, '^\\s*\\d{{4}}-\\d{{2}}-\\d{{2}}([T ]\\d{{2}}:\\d{{2}}.*)?\\s*$') THEN {0} END AS timestamptz)"
_PAGE = "message_id, m.session_id, m.seq, m.role, octet_length(encode(m.text)) AS text_bytes, m.ts, provider, agent_name"
_MESSAGES = "SELECT coalesce(event_id, m.session_id || ':' || seq) AS message_id, m.*, provider, agent_name, assignment_role, parent_session_id, started_at FROM m JOIN s USING (session_id)"


def _shown(messages: DataFrame) -> DataFrame:
    return messages.select("message_id", "session_id", "seq", "role", "text_bytes", "ts", "provider", "agent_name")


@query(f"WITH {_S}, {_M} SELECT message_id, session_id, seq, role, octet_length(encode(text)) AS text_bytes, ts, provider, agent_name FROM ({_MESSAGES}) WHERE role = 'assistant' ORDER BY session_id, seq, message_id LIMIT 101")
def messages_page(spark: SparkSession, base: str) -> DataFrame:
    """The first page of assistant messages and the row after it."""
    return _shown(spec.page(Store(spark, base), spec.Query("messages", Filters(role="assistant"))))


@query(f"WITH {_S}, {_M} SELECT message_id, session_id, seq, role, octet_length(encode(text)) AS text_bytes, ts, provider, agent_name FROM ({_MESSAGES}) WHERE (session_id, seq) > ('codex:5', 3) ORDER BY session_id, seq, message_id LIMIT 51")
def messages_next_page(spark: SparkSession, base: str) -> DataFrame:
    """The page of messages after a key."""
    return _shown(spec.page(Store(spark, base), spec.Query("messages", limit=50, after=("codex:5", 3))))


@query(f"WITH {_S}, {_M} SELECT message_id, session_id, seq, role, octet_length(encode(text)) AS text_bytes, ts, provider, agent_name FROM ({_MESSAGES}) WHERE {_TIME.format('ts')} >= '2026-03-01 00:00:00+00' AND {_TIME.format('ts')} < '2026-05-01 00:00:00+00' AND provider IN ('codex', 'claude')")
def messages_time_window(spark: SparkSession, base: str) -> DataFrame:
    """Messages of two providers in a window of time, its start included."""
    return _shown(select_messages(Store(spark, base), Filters(providers=("codex", "claude"), message_after="2026-03-01T00:00:00Z", message_before="2026-05-01T00:00:00Z"), text=False))


@query(f"WITH {_S}, {_M} SELECT message_id, session_id, seq, role, octet_length(encode(text)) AS text_bytes, ts, provider, agent_name FROM ({_MESSAGES}) WHERE parent_session_id IS NULL AND {_TIME.format('started_at')} >= '2026-02-01 00:00:00+00'")
def messages_of_roots(spark: SparkSession, base: str) -> DataFrame:
    """Messages of sessions without a parent that started after a time."""
    return _shown(select_messages(Store(spark, base), Filters(roots_only=True, session_started_after="2026-02-01T00:00:00Z"), text=False))


@query(f"""WITH RECURSIVE {_S}, {_M}, l AS (SELECT session_id AS id, nullif(parent_session_id, '') AS p FROM s),
  down AS (SELECT (SELECT min(lineage_root_session_id) FROM lineage_requests WHERE lineage_root_session_id IN (SELECT id FROM l)) AS id, 0 AS n
    UNION SELECT l.id, n + 1 FROM down JOIN l ON l.p = down.id WHERE n < 60)
SELECT message_id, session_id, seq, role, octet_length(encode(text)) AS text_bytes, ts, provider, agent_name FROM ({_MESSAGES}) WHERE session_id IN (SELECT id FROM down)""")
def messages_of_lineage(spark: SparkSession, base: str) -> DataFrame:
    """Messages of a requested lineage: of the smallest requested root that is here, and all below it."""
    shop = Store(spark, base)
    roots = shop.rows("lineage_requests", "lineage_root_session_id").select(F.col("lineage_root_session_id").alias("session_id"))
    first = roots.join(shop.rows("sessions", "session_id"), "session_id", "left_semi").agg(F.min("session_id")).first()[0]
    return _shown(select_messages(shop, Filters(lineage_root_session_id=first or ""), text=False))


@query(f"WITH {_S} SELECT session_id, project_key, provider, started_at, updated_at AS ended_at, model FROM s ORDER BY coalesce(updated_at, started_at, '') DESC, session_id LIMIT 101")
def sessions_page(spark: SparkSession, base: str) -> DataFrame:
    """The newest sessions, one more than a page."""
    return spec.page(Store(spark, base), spec.Query("sessions")).select("session_id", "project_key", "provider", "started_at", "ended_at", "model")


@query(f"WITH {_S} SELECT session_id, project_key, provider, model FROM s WHERE provider IN ('codex', 'opencode') AND parent_session_id IS NULL AND model_provider IS NOT DISTINCT FROM 'northwind-ai'")
def sessions_filtered(spark: SparkSession, base: str) -> DataFrame:
    """Root sessions of two providers by the session's own model provider."""
    return select_sessions(Store(spark, base), Filters(providers=("codex", "opencode"), roots_only=True, model_provider="northwind-ai")).select("session_id", "project_key", "provider", "model")


@query(f"WITH {_S}, {_M} SELECT session_id FROM s WHERE EXISTS (FROM m WHERE m.session_id = s.session_id AND m.model = 'cx-large')")
def sessions_by_message_model(spark: SparkSession, base: str) -> DataFrame:
    """Sessions with some message of a model."""
    return store.sessions_with_message_model(Store(spark, base), "cx-large")


@query(f"WITH {_S}, {_T} SELECT t.id, t.session_id, coalesce(t.event_id, t.id) AS event_id, t.seq, t.tool_name, t.status, coalesce(t.started_at, t.completed_at) AS called_at, octet_length(encode(input_text)) AS input_bytes, octet_length(encode(output_text)) AS output_bytes FROM t JOIN s USING (session_id) WHERE t.tool_name IN ('grep') ")
def tool_calls_of_tool(spark: SparkSession, base: str) -> DataFrame:
    """The calls of one tool with the sizes of their payloads."""
    return select_tool_calls(Store(spark, base), Filters(tool_name="grep")).select("id", "session_id", "event_id", "seq", "tool_name", "status", "called_at", F.col("input_bytes").cast("long"), F.col("output_bytes").cast("long"))


@query(f"WITH {_S}, {_T} SELECT t.id, t.session_id, t.seq, t.tool_name FROM t JOIN s USING (session_id) ORDER BY t.session_id, t.seq, t.id LIMIT 101 OFFSET 200")
def tool_calls_page(spark: SparkSession, base: str) -> DataFrame:
    """The third page of tool calls."""
    return spec.page(Store(spark, base), spec.Query("tool_calls", offset=200)).select("id", "session_id", "seq", "tool_name")


@query(f"WITH {_M}, k AS (SELECT (row_number() OVER (ORDER BY search_id, match_key) - 1)::int AS position, session_id, seq FROM (SELECT DISTINCT search_id, match_key, session_id, seq FROM search_matches) QUALIFY position < 40) SELECT position, session_id, seq, event_id, role, text FROM m JOIN k USING (session_id, seq)")
def point_lookup_batch(spark: SparkSession, base: str) -> DataFrame:
    """The messages at a page of keys, in the order of the keys."""
    shop = Store(spark, base)
    keys = shop.rows("search_matches", "session_id", "seq").orderBy("search_id", "match_key").limit(40).collect()
    return point_lookup(shop, [(r["session_id"], r["seq"]) for r in keys])


# ---- counts, coverage, integrity


@query(f"WITH {_S}, {_M}, {_T}, {_V}, p AS (SELECT DISTINCT * FROM projects) SELECT 'projects' AS table_name, count(*) AS n_rows FROM p UNION ALL SELECT 'sessions', count(*) FROM s UNION ALL SELECT 'messages', count(*) FROM m UNION ALL SELECT 'tool_calls', count(*) FROM t UNION ALL SELECT 'message_vectors', count(*) FROM v")
def stats_counts(spark: SparkSession, base: str) -> DataFrame:
    """Records a table."""
    return store.table_counts(Store(spark, base))


_CHILDREN = f"{_S}, {_M}, {_T}, {_V}, c AS (SELECT session_id, (SELECT count(*) FROM m WHERE m.session_id = s.session_id) AS n_messages, (SELECT count(*) FROM t WHERE t.session_id = s.session_id) AS n_tool_calls, (SELECT count(*) FROM v WHERE v.session_id = s.session_id) AS n_vectors FROM s)"


@query(f"WITH {_CHILDREN} FROM c")
def session_detail_counts(spark: SparkSession, base: str) -> DataFrame:
    """Rows of each kind a session."""
    return store.child_counts(Store(spark, base))


@query(f"WITH {_CHILDREN} SELECT s.session_id, message_count, n_messages, tool_call_count, n_tool_calls FROM c JOIN s USING (session_id) WHERE message_count IS DISTINCT FROM n_messages OR tool_call_count IS DISTINCT FROM n_tool_calls")
def declared_count_gaps(spark: SparkSession, base: str) -> DataFrame:
    """Sessions that declare other counts than they have."""
    return store.declared_count_gaps(Store(spark, base))


@query(f"WITH {_CHILDREN} SELECT provider, count(*) AS n_sessions, sum(n_messages)::bigint AS n_messages, sum(n_tool_calls)::bigint AS n_tool_calls FROM c JOIN s USING (session_id) GROUP BY ROLLUP (provider)")
def provider_totals(spark: SparkSession, base: str) -> DataFrame:
    """Totals a provider and over all."""
    return store.provider_totals(Store(spark, base))


_MODEL = "loc-mini-64"
_SEARCHABLE = "sm AS (SELECT * FROM m WHERE role IN ('user', 'assistant', 'reasoning')), mv AS (SELECT * FROM v WHERE model = 'loc-mini-64')"
_STALE = "st AS (SELECT DISTINCT mv.vec_rowid, mv.session_id, mv.seq FROM mv LEFT JOIN m ON m.session_id = mv.session_id AND m.seq = mv.seq WHERE m.role IS NULL OR m.role <> mv.role OR m.content_hash IS DISTINCT FROM mv.content_hash)"
_SAME = "sm.session_id = mv.session_id AND sm.seq = mv.seq AND sm.role = mv.role AND sm.content_hash = mv.content_hash"


@query(f"WITH {_M}, {_V}, {_SEARCHABLE}, {_STALE}, a AS (SELECT count(*) AS n FROM sm), b AS (SELECT count(*) AS n FROM mv WHERE EXISTS (FROM sm WHERE {_SAME})) SELECT a.n AS searchable, b.n AS matching, greatest(a.n - b.n, 0) AS vectorless, (SELECT count(*) FROM st) AS stale FROM a, b")
def vector_coverage(spark: SparkSession, base: str) -> DataFrame:
    """How many searchable messages have a live vector, and how many vectors are stale."""
    return store.vector_coverage(Store(spark, base), _MODEL)


@query(f"WITH {_M}, {_V}, {_SEARCHABLE} SELECT session_id, seq, event_id FROM sm WHERE NOT EXISTS (FROM mv WHERE {_SAME})")
def vectors_missing(spark: SparkSession, base: str) -> DataFrame:
    """Searchable messages without a live vector."""
    return store.missing_vectors(Store(spark, base), _MODEL)


@query(f"WITH {_M}, {_V}, {_SEARCHABLE}, {_STALE} FROM st")
def vectors_stale(spark: SparkSession, base: str) -> DataFrame:
    """Vectors whose message has changed or gone."""
    return store.stale_vectors(Store(spark, base), _MODEL)


@query(f"WITH {_M}, {_V}, {_SEARCHABLE}, h AS (SELECT DISTINCT content_hash FROM sm WHERE content_hash IS NOT NULL) SELECT count(*) AS n_hashes, count(*) FILTER (content_hash IN (SELECT content_hash FROM mv)) AS n_hits, count(*) FILTER (content_hash NOT IN (SELECT content_hash FROM mv WHERE content_hash IS NOT NULL)) AS n_misses FROM h")
def embedding_coverage(spark: SparkSession, base: str) -> DataFrame:
    """Different contents with and without an embedding."""
    return store.embedding_coverage(Store(spark, base), _MODEL)


@query(f"WITH {_S} SELECT session_id, parent_session_id FROM s WHERE parent_session_id <> '' AND parent_session_id NOT IN (SELECT session_id FROM s)")
def dangling_parents(spark: SparkSession, base: str) -> DataFrame:
    """Sessions with a parent that is not here."""
    return store.dangling_parents(Store(spark, base))


@query(f"WITH {_S} SELECT session_id FROM s WHERE parent_session_id IS NULL AND EXISTS (FROM s c WHERE c.parent_session_id = s.session_id)")
def complete_roots(spark: SparkSession, base: str) -> DataFrame:
    """Roots with children."""
    return store.complete_roots(Store(spark, base))


@query(f"WITH {_S} SELECT session_id FROM s WHERE NOT EXISTS (FROM messages x WHERE x.session_id = s.session_id) AND NOT EXISTS (FROM tool_calls x WHERE x.session_id = s.session_id) AND NOT EXISTS (FROM message_vectors x WHERE x.session_id = s.session_id)")
def empty_sessions(spark: SparkSession, base: str) -> DataFrame:
    """Sessions without any row of their own."""
    return store.empty_sessions(Store(spark, base))


@query(f"WITH {_M} SELECT project_key, count(*) AS n_messages FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def top_project(spark: SparkSession, base: str) -> DataFrame:
    """The project with most messages."""
    return store.top_project(Store(spark, base))


@query(f"WITH {_T}, d AS (SELECT tool_name, (epoch_us({_TIME.format('completed_at')}) - epoch_us({_TIME.format('started_at')})) / 1000.0 AS ms FROM t) SELECT tool_name, count(*) AS n_calls, quantile_disc(ms, 0.5)::double AS p50_ms, quantile_disc(ms, 0.95)::double AS p95_ms FROM d WHERE ms IS NOT NULL GROUP BY 1")
def call_durations(spark: SparkSession, base: str) -> DataFrame:
    """Nearest-rank quantiles of call times a tool."""
    return store.call_durations(Store(spark, base))


@query("SELECT session_id, row_number() OVER (ORDER BY f) AS position FROM (SELECT session_id, min((search_id, match_key)) AS f FROM search_matches GROUP BY 1)")
def first_seen_sessions(spark: SparkSession, base: str) -> DataFrame:
    """The matched sessions in the order of their first match."""
    return store.first_seen_sessions(Store(spark, base))


# ---- search

_FOLD = "lower(strip_accents(text))"
_DOCS = f"{_M}, doc AS (SELECT event_id AS key, session_id, seq, role, list_concat([1, 1, 1]::int[], list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+'), lambda x: 1)).len() AS len, regexp_extract_all({_FOLD}, '[\\p{{L}}\\p{{N}}]+') AS ts FROM m WHERE role IN ('user', 'assistant', 'reasoning'))"


def _bm25_sql(words: list[str], limit: int, where: str = "true") -> str:
    tf = ", ".join(f"len(list_filter(ts, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(words)))
    having = " AND ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"""WITH {_DOCS}, f AS (SELECT *, {tf} FROM doc), st AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM f),
      r AS (SELECT key, session_id, seq, row_number() OVER (ORDER BY round({score}, 9) DESC, key) AS rank FROM f, st WHERE {having} AND {where})
    SELECT key, session_id, seq, rank, 1.0::double / rank AS score FROM r WHERE rank <= {limit}"""


def _index(spark: SparkSession, base: str) -> search.LexicalIndex:
    """The stored index of the messages as they are now; built where there is none yet."""
    return search.LexicalIndex.of(Store(spark, base), shared_folder(spark))


@query(f"WITH {_DOCS}, st AS (SELECT count(*) AS n_messages, sum(len)::bigint AS n_occurrences FROM doc) SELECT * FROM st")
def lexical_index(spark: SparkSession, base: str) -> DataFrame:
    """How many messages and occurrences of terms the stored index holds, scope tokens included."""
    index = _index(spark, base)
    return index.postings().where(F.col("is_length")).agg(F.count("*").alias("n_messages"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_occurrences"))


@query(_bm25_sql(["merge", "planner"], 50))
def lexical_search(spark: SparkSession, base: str) -> DataFrame:
    """The first messages by BM25 with both words."""
    return _index(spark, base).search("Merge planner", limit=50)


@query(_bm25_sql(["lineage"], 30, "role = 'user'"))
def lexical_search_filtered(spark: SparkSession, base: str) -> DataFrame:
    """The first user messages by BM25."""
    return _index(spark, base).search("lineage", limit=30, where=F.col("role") == "user")


_ASKED = [((i * 37) % 17 - 8) / 8 for i in range(64)]
_LIVE = f"{_M}, {_V}, {_SEARCHABLE}, lv AS (SELECT sm.event_id AS key, mv.session_id, mv.seq, mv.role, mv.vector FROM mv JOIN sm ON {_SAME} WHERE len(mv.vector) = 64)"
_COS = f"list_reduce(list_prepend(0.0::double, list_transform(list_zip(vector::double[], {_ASKED}::double[]), lambda z: z[1] * z[2])), lambda a, b: a + b) / (sqrt(list_reduce(list_prepend(0.0::double, list_transform(vector::double[], lambda z: z * z)), lambda a, b: a + b)) * {sum(x * x for x in _ASKED) ** 0.5!r})"


def _cosine_sql(limit: int, where: str = "true") -> str:
    return f"WITH {_LIVE}, c AS (SELECT key, session_id, seq, {_COS} AS score FROM lv WHERE {where}) SELECT key, session_id, seq, row_number() OVER (ORDER BY score DESC, session_id, seq) AS rank, round(score, 6) AS score FROM c WHERE isfinite(score) QUALIFY rank <= {limit}"


@query(_cosine_sql(25))
def vector_search(spark: SparkSession, base: str) -> DataFrame:
    """The live vectors most similar to a given one."""
    return search.semantic_search(Store(spark, base), _MODEL, _ASKED, limit=25).withColumn("score", F.round("score", 6))


@query(_cosine_sql(25, "role = 'assistant'"))
def vector_search_filtered(spark: SparkSession, base: str) -> DataFrame:
    """The live vectors of assistant messages most similar to a given one."""
    return search.semantic_search(Store(spark, base), _MODEL, _ASKED, limit=25, where=F.col("role") == "assistant").withColumn("score", F.round("score", 6))


@query(
    f"WITH lex AS ({_bm25_sql(['merge', 'planner'], 50)}), sem AS ({_cosine_sql(50)}), b AS (SELECT key, rank FROM lex UNION ALL SELECT key, rank FROM sem), f AS (SELECT key, sum(1.0::double / (60 + rank)) AS score FROM b GROUP BY 1) "
    "SELECT key, row_number() OVER (ORDER BY score DESC, key) AS rank, round(score, 9) AS score, false AS degraded FROM f QUALIFY rank <= 20"
)
def fused_search(spark: SparkSession, base: str) -> DataFrame:
    """Reciprocal-rank fusion of both searches."""
    shop = Store(spark, base)
    depth = search.candidates(20, 0)
    return search.fuse(_index(spark, base).search("merge planner", limit=depth), search.semantic_search(shop, _MODEL, _ASKED, limit=depth), limit=20).withColumn("score", F.round("score", 9))


@query()
def fused_rows(spark: SparkSession, base: str) -> DataFrame:
    """A fused page with its messages: excerpts of at most 2,000 bytes and the places of the terms."""
    shop = Store(spark, base)
    depth = search.candidates(20, 0)
    hits = search.fuse(_index(spark, base).search("merge planner", limit=depth), search.semantic_search(shop, _MODEL, _ASKED, limit=depth), limit=20)
    rows = search.hydrate(hits, shop)
    return rows.select("key", "rank", "score", text.utf8_prefix(F.col("text"), 2000).alias("text"), (F.octet_length("text") > 2000).alias("text_truncated"), F.octet_length("text").alias("text_bytes"), text.highlight_ranges(F.col("text"), "merge planner").alias("ranges"))


@query(f"WITH {_M} SELECT event_id, octet_length(encode(text)) AS text_bytes, octet_length(encode(text)) > 2000 AS text_truncated FROM m WHERE text IS NOT NULL")
def search_excerpts(spark: SparkSession, base: str) -> DataFrame:
    """Sizes of the messages and whether a search row would cut them."""
    size = F.octet_length("text")
    cut = F.octet_length(text.utf8_prefix(F.col("text"), 2000)) < size
    return Store(spark, base).rows("messages", size.cast("long").alias("text_bytes"), cut.alias("text_truncated"), where=F.col("text").isNotNull()).select("event_id", "text_bytes", "text_truncated")


@query(
    f"WITH {_M}, x AS (SELECT event_id, text, strpos({_FOLD}, 'lineage') AS pos FROM m WHERE regexp_matches({_FOLD}, 'lineage')), p AS (SELECT *, greatest(pos - 40, 1) AS a, least(pos + 87, length(text) + 1) AS b FROM x) "
    "SELECT event_id, CASE WHEN a > 1 THEN '…' ELSE '' END || substr(text, a, b - a) || CASE WHEN b <= length(text) THEN '…' ELSE '' END AS snippet FROM p"
)
def search_snippets(spark: SparkSession, base: str) -> DataFrame:
    """The text around a term."""
    return Store(spark, base).rows("messages", text.snippet(F.col("text"), "lineage").alias("snippet"), where=F.instr(text.fold(F.col("text")), "lineage") > 0).select("event_id", "snippet")


@query(f"WITH {_M} SELECT role, sum(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')))::bigint AS n_terms FROM m WHERE role IN ('user', 'assistant', 'reasoning') AND text IS NOT NULL GROUP BY 1")
def indexed_terms(spark: SparkSession, base: str) -> DataFrame:
    """How many terms the index holds a role, the scope tokens left out."""
    return search.documents(Store(spark, base)).groupBy("role").agg(F.sum(F.size("terms") - 3).alias("n_terms"))


@query()
def index_terms(spark: SparkSession, base: str) -> DataFrame:
    """Occurrences and messages of every term of the inverted index, whatever its script, length and frequency."""
    ordered = search.documents(Store(spark, base)).select(F.sort_array(F.slice("terms", 4, F.greatest(F.size("terms") - 3, F.lit(0)))).alias("term"))
    # beside the one before it a term shows whether it is the message's first of its kind, so partial counts are made before the shuffle
    beside = ordered.select(F.inline(F.arrays_zip("term", F.concat(F.array(F.lit(None).cast("string")), "term").alias("before")))).where(F.col("term").isNotNull())
    return beside.groupBy("term").agg(F.count("*").alias("tf"), F.count_if(~F.col("term").eqNullSafe(F.col("before"))).alias("df"))


# ---- hashing, redaction


@query(f"WITH {_T} SELECT id, sha256(input_text) AS input_sha, sha256(output_text) AS output_sha, 'p' || sha1(project_key) AS project_token FROM t")
def payload_hashes(spark: SparkSession, base: str) -> DataFrame:
    """SHA-256 of payloads and the scope token of the project."""
    hashes = (F.sha2("input_text", 256).alias("input_sha"), F.sha2("output_text", 256).alias("output_sha"))
    return Store(spark, base).rows("tool_calls", *hashes, hashing.project_scope_token(F.col("project_key")).alias("project_token"))


@query()
def message_hashes(spark: SparkSession, base: str) -> DataFrame:
    """The content hash that each message should have."""
    computed = hashing.message_content_hash(F.col("session_id"), F.col("event_id"), F.col("seq"), F.col("role"), F.col("text")).alias("computed_hash")
    return Store(spark, base).rows("messages", computed).select("event_id", "computed_hash")


def _redact_sql(column: str) -> str:
    # RE2 has no lookahead: an assignment is either followed by white space or by a value that does not begin with the sign
    name, value = redaction.ASSIGNMENT.removeprefix("(?i)\\b(").split("=(?!=)")[0], redaction.ASSIGNMENT.rsplit("(", 1)[1].removesuffix(")")
    first = value.replace("[^", "[^=").removesuffix("+")
    assignment = (f"(?i)\\b(?:({name}=\\s+){value}|({name}=){first}{value.removesuffix('+')}*)", f"$1$2{redaction.REDACTED}")
    for pattern, replacement in [*redaction._steps()[:-1], assignment]:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{re.sub(r'[$](.)', lambda m: chr(92) + m[1], replacement)}', 'g')"
    return column


@query(f"WITH {_T} SELECT id, {_redact_sql('input_text')} AS input_text FROM t")
def redacted_inputs(spark: SparkSession, base: str) -> DataFrame:
    """Every redacted tool input, those with assignments and null ones included."""
    rows = Store(spark, base).rows("tool_calls", "input_text")
    return rows.select("id", redaction.redact(F.col("input_text")).alias("input_text"))


# ---- merging, jobs


@query(
    f"""WITH {_M}, old AS (SELECT session_id, event_id, seq, role, content_hash FROM m WHERE seq % 5 <> 0),
  new AS (SELECT session_id, event_id, seq, role, CASE WHEN seq % 7 = 0 THEN content_hash || 'x' ELSE content_hash END AS content_hash FROM m WHERE seq % 11 <> 10 AND role <> 'reasoning'),
  o AS (SELECT * FROM old WHERE session_id IN (SELECT session_id FROM new))
SELECT coalesce(o.event_id, new.event_id) AS event_id, CASE WHEN o.event_id IS NULL THEN 'insert' WHEN new.event_id IS NULL THEN 'delete'
  WHEN (o.seq, o.role, o.content_hash) IS DISTINCT FROM (new.seq, new.role, new.content_hash) THEN 'update' ELSE 'unchanged' END AS change
FROM o FULL JOIN new ON o.session_id = new.session_id AND o.event_id = new.event_id"""
)
def session_diff(spark: SparkSession, base: str) -> DataFrame:
    """Row-level changes between two states of the messages."""
    rows = Store(spark, base).rows("messages", "seq", "role", "content_hash")
    old = rows.where(F.col("seq") % 5 != 0)
    new = rows.where((F.col("seq") % 11 != 10) & (F.col("role") != "reasoning")).withColumn("content_hash", F.when(F.col("seq") % 7 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    return merge.diff(old, new, ["session_id", "event_id"], ["session_id"], ["seq", "role", "content_hash"]).select("event_id", "change")


@query("WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL) SELECT doc_id, greatest(ceil(length(text) / 12000.0), 1)::bigint AS n_chunks, length(text)::bigint AS n_chars FROM d")
def document_chunks(spark: SparkSession, base: str) -> DataFrame:
    """How the documents are cut for embedding."""
    cut = jobs.chunks(table(spark, base, "documents"), ["doc_id"], "text")
    return cut.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"))


@query("WITH x AS (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), m AS (SELECT label, p, avg(x) AS m, count(*) AS n FROM x GROUP BY 1, 2) SELECT label, list(round(m, 6) ORDER BY p) AS vector, max(n) AS n_vectors FROM m GROUP BY 1")
def mean_embeddings(spark: SparkSession, base: str) -> DataFrame:
    """The mean embedding a label."""
    return jobs.document_vectors(table(spark, base, "embeddings"), ["label"], "embedding").withColumn("vector", F.transform("vector", lambda x: F.round(x, 6)))


# ---- trajectories and normalisation

_EVENTS = f"""{_S}, {_M}, {_T}, said AS (SELECT session_id, event_id AS id, seq AS sequence, CASE role WHEN 'reasoning' THEN 'thinking' ELSE role END AS role, CASE role WHEN 'reasoning' THEN 'reasoning' ELSE 'message' END AS kind, ts AS timestamp, text FROM m),
  ev0 AS (FROM said UNION ALL SELECT session_id, event_id, seq, 'assistant', 'tool_call', coalesce(started_at, completed_at), NULL FROM t WHERE (session_id, event_id) NOT IN (SELECT (session_id, id) FROM said)),
  ev AS (SELECT session_id, id, min(sequence) AS sequence, min(role) AS role, min(kind) AS kind, arg_min(timestamp, sequence) AS timestamp, arg_min(text, sequence) AS text FROM ev0 GROUP BY 1, 2),
  sp AS (SELECT *, CASE WHEN trim(coalesce(text, ''), ' ') <> '' THEN text END AS said FROM ev),
  pl AS (SELECT t.*, ev.sequence AS pos FROM t JOIN ev ON ev.session_id = t.session_id AND ev.id = t.event_id)"""
_ENC = "replace({0}, ':', '%3A')"


def _trajectory(spark: SparkSession, base: str, **options) -> tuple[DataFrame, DataFrame]:
    shop = Store(spark, base)
    calls = shop.rows("tool_calls", "session_id", "event_id", "seq", "tool_name", "status", "input_text", "output_text", "started_at", "completed_at")
    events = trajectory.events_from_rows(shop.rows("messages", "seq", "role", "text", "ts"), calls)
    return trajectory.trajectory(shop.rows("sessions", "started_at"), events, calls, **options)


@query(
    f"""WITH {_EVENTS}, r AS (
  SELECT session_id, -1 AS source_sequence, 0 AS suborder, 'trajectory:meta:' || {_ENC.format("session_id || ':session'")} AS id, 'meta' AS role, NULL::bigint AS original_bytes, NULL::bigint AS returned_bytes FROM s
  UNION ALL SELECT session_id, sequence, CASE WHEN kind = 'reasoning' THEN 10 ELSE 20 END, 'trajectory:' || x || ':' || {_ENC.format('id')}, x, NULL, NULL FROM (SELECT *, CASE WHEN kind = 'reasoning' THEN 'reasoning' WHEN role IN ('developer', 'system') THEN 'meta' ELSE role END AS x FROM sp WHERE said IS NOT NULL AND role IN ('user', 'assistant', 'thinking', 'developer', 'system'))
  UNION ALL SELECT session_id, pos, 100, 'trajectory:tool_call:' || {_ENC.format('id')}, 'tool_call', NULL, NULL FROM pl
  UNION ALL SELECT session_id, pos, 110, 'trajectory:tool_result:' || {_ENC.format('id')}, 'tool_result', octet_length(encode(coalesce(output_text, ''))), octet_length(encode(coalesce(output_text, ''))) FROM pl WHERE coalesce(output_text, '') <> '' OR completed_at IS NOT NULL)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY source_sequence, suborder, id) - 1 AS sequence, id, role, original_bytes, returned_bytes FROM r"""
)
def trajectory_records(spark: SparkSession, base: str) -> DataFrame:
    """The ordered records of every session."""
    return _trajectory(spark, base)[0].select("session_id", "sequence", "id", "role", "original_bytes", "returned_bytes")


@query(
    f"""WITH {_EVENTS}
SELECT session_id, 'omitted' AS kind, 'event' AS source_kind, id AS source_id, 'excluded_by_option' AS reason FROM sp WHERE said IS NOT NULL AND kind = 'reasoning'
UNION ALL SELECT session_id, 'truncated', 'tool_result', id, 'tool_result_truncated' FROM pl WHERE octet_length(encode(output_text)) > 1000
UNION ALL SELECT session_id, 'omitted', 'event', id, 'not_selected_for_agent_projection' FROM sp WHERE (said IS NULL OR role NOT IN ('user', 'assistant', 'thinking', 'developer', 'system')) AND (session_id, id) NOT IN (SELECT (session_id, event_id) FROM pl)"""
)
def trajectory_losses(spark: SparkSession, base: str) -> DataFrame:
    """What a trajectory without reasoning and with results of at most 1,000 bytes leaves out."""
    return _trajectory(spark, base, reasoning=False, most_bytes=1000)[1].select("session_id", "kind", "source_kind", "source_id", "reason")


@query(
    f"""WITH {_EVENTS}, p AS (SELECT session_id, min((pos, id)) AS first, ascii(right(session_id, 1)) % 4 AS x FROM pl GROUP BY 1),
  n AS (SELECT session_id, ascii(right(session_id, 1)) % 4 AS x FROM s)
SELECT session_id, 'no_session_record' AS fault FROM n WHERE x = 1 AND (session_id IN (SELECT session_id FROM sp WHERE said IS NOT NULL AND role IN ('user', 'assistant', 'thinking', 'developer', 'system')) OR session_id IN (SELECT session_id FROM pl))
UNION SELECT session_id, 'numbering' FROM n WHERE x = 1 AND (session_id IN (SELECT session_id FROM sp WHERE said IS NOT NULL AND role IN ('user', 'assistant', 'thinking', 'developer', 'system')) OR session_id IN (SELECT session_id FROM pl))
UNION SELECT session_id, 'result_without_call' FROM pl WHERE ascii(right(session_id, 1)) % 4 = 2 AND (coalesce(output_text, '') <> '' OR completed_at IS NOT NULL)"""
)
def trajectory_faults(spark: SparkSession, base: str) -> DataFrame:
    """Sessions whose trajectory breaks a rule, after faults were planted: session records taken from a quarter of the sessions, calls renamed in another."""
    records = _trajectory(spark, base)[0]
    planted = F.ascii(F.right("session_id", F.lit(1))) % 4
    kept = records.where((planted != 1) | ~F.col("category").eqNullSafe(F.lit("session")))
    renamed = F.when((planted == 2) & (F.col("role") == "tool_call"), F.concat("tool_call_id", F.lit("?"))).otherwise(F.col("tool_call_id"))
    return trajectory.trajectory_faults(kept.withColumn("tool_call_id", renamed))


@query()
def letta_issues(spark: SparkSession, base: str) -> DataFrame:
    """What the first exchange format could not carry, by kind."""
    records = _trajectory(spark, base)[0]
    return trajectory.letta_records(records, Store(spark, base).rows("sessions", "provider", "model"))[1].groupBy("kind").agg(F.count("*").alias("n_issues"))


@query()
def atif_steps(spark: SparkSession, base: str) -> DataFrame:
    """The steps of the second exchange format."""
    return trajectory.atif_steps(_trajectory(spark, base)[0])


_LAST_SAID = "coalesce(m.{0}, (max(struct_pack(s := seq, i := event_id, v := m.{0})) FILTER (m.{0} IS NOT NULL) OVER (PARTITION BY session_id ORDER BY seq)).v)"


@query(f"WITH {_M} SELECT session_id, event_id AS id, {_LAST_SAID.format('model')} AS model, {_LAST_SAID.format('model_provider')} AS model_provider FROM m")
def context_forward_fill(spark: SparkSession, base: str) -> DataFrame:
    """The model in force at each message: its own, else the last one said up to its seq; of messages that share a seq the greater id counts as later."""
    rows = Store(spark, base).rows("messages", "seq", "model", "model_provider")
    events = rows.select("session_id", F.col("event_id").alias("id"), F.col("seq").alias("sequence"), F.lit(None).cast("string").alias("native_event_id"))
    said = rows.select("session_id", F.concat(F.lit("c"), "event_id").alias("id"), F.col("seq").alias("sequence"), F.lit("turn").alias("scope"), F.col("event_id").alias("turn_id"), "model", "model_provider", F.lit(None).cast("string").alias("reasoning_effort"))
    usage = rows.limit(0).select("session_id", "event_id", "model", "model_provider", F.lit(0).alias("order_index"))
    return normalize.event_context(events, said, usage).select("session_id", "id", "model", "model_provider")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence FROM events")
def dense_sequences(spark: SparkSession, base: str) -> DataFrame:
    """Events numbered without gaps within each user."""
    rows = table(spark, base, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.col("ts").alias("position"))
    return normalize.number_events(rows).select(F.col("id").alias("event_id"), "sequence")


@query("SELECT id, count(*) AS n_rows FROM tool_calls GROUP BY 1 HAVING count(*) > 1")
def duplicate_calls(spark: SparkSession, base: str) -> DataFrame:
    """Tool calls that were delivered more than once."""
    return normalize.duplicate_ids(table(spark, base, "tool_calls").select("id"), "id")


@query("WITH p AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence FROM events), q AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM p) SELECT event_id AS from_id, c AS to_id FROM q WHERE event_type = 'purchase' AND c IS NOT NULL")
def result_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Each purchase and the last click before it, as calls and results are paired."""
    rows = table(spark, base, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.col("ts").alias("position"), F.when(F.col("event_type") == "click", "tool_call").when(F.col("event_type") == "purchase", "tool_result").otherwise("other").alias("kind"), F.lit("x").alias("tool_call_id"))
    return normalize.result_edges(normalize.number_events(rows)).select("from_id", "to_id")


# ---- streams


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_incremental(spark: SparkSession, base: str) -> DataFrame:
    """Events by type and hour, counted by a stream that runs to the end of the table."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return ingest.event_counts(spark, base, f"{folder}/checkpoint", f"{folder}/out").withColumn("total", F.round("total", 4))


# ---- validation

_HASHED = "coalesce(sha256({0}_text) <> {0}_hash, false)"


@query(
    f"""WITH {_S}, {_M}, {_T}, {_V}, d AS (SELECT session_id, seq FROM m GROUP BY 1, 2 HAVING count(*) > 1), r AS (
  SELECT 'session.id_prefix' AS rule FROM s WHERE split_part(session_id, ':', 1) <> provider
  UNION ALL SELECT 'session.time_order' FROM s WHERE {_TIME.format('updated_at')} < {_TIME.format('started_at')}
  UNION ALL SELECT 'session.own_parent' FROM s WHERE parent_session_id = session_id
  UNION ALL SELECT 'session.started_at' FROM s WHERE coalesce(started_at, '') <> '' AND {_TIME.format('started_at')} IS NULL
  UNION ALL SELECT 'session.updated_at' FROM s WHERE coalesce(updated_at, '') <> '' AND {_TIME.format('updated_at')} IS NULL
  UNION ALL SELECT 'message.session' FROM m WHERE session_id NOT IN (SELECT session_id FROM s)
  UNION ALL SELECT 'message.project' FROM m JOIN s USING (session_id) WHERE m.project_key IS DISTINCT FROM s.project_key
  UNION ALL SELECT 'message.role' FROM m WHERE role IS NULL OR role NOT IN ('user', 'assistant', 'reasoning')
  UNION ALL SELECT 'message.text' FROM m WHERE trim(coalesce(text, ''), ' ') = ''
  UNION ALL SELECT 'message.time' FROM m WHERE coalesce(ts, '') <> '' AND {_TIME.format('ts')} IS NULL
  UNION ALL SELECT 'message.shared_seq' FROM m JOIN d ON d.session_id = m.session_id AND d.seq = m.seq
  UNION ALL SELECT 'message.hash' FROM m WHERE coalesce(content_hash, '') = ''
  UNION ALL SELECT 'tool_call.session' FROM t WHERE session_id NOT IN (SELECT session_id FROM s)
  UNION ALL SELECT 'tool_call.provider' FROM t JOIN s USING (session_id) WHERE t.provider IS DISTINCT FROM s.provider
  UNION ALL SELECT 'tool_call.input_hash' FROM t WHERE {_HASHED.format('input')}
  UNION ALL SELECT 'tool_call.output_hash' FROM t WHERE {_HASHED.format('output')}
  UNION ALL SELECT 'tool_call.time_order' FROM t WHERE {_TIME.format('completed_at')} < {_TIME.format('started_at')}
  UNION ALL SELECT 'vector.missing' FROM v WHERE vector IS NULL
  UNION ALL SELECT 'vector.dimensions' FROM v WHERE len(vector) <> dimensions
  UNION ALL SELECT 'vector.finite' FROM v WHERE len(list_filter(vector, lambda x: NOT isfinite(x))) > 0)
SELECT rule, count(*) AS n_records FROM r GROUP BY 1"""
)
def store_violations(spark: SparkSession, base: str) -> DataFrame:
    """How many records break each rule of the store."""
    return validate.violations(Store(spark, base)).groupBy("rule").agg(F.count("*").alias("n_records"))


@query()
def store_audit(spark: SparkSession, base: str) -> DataFrame:
    """The broken rules with their first records."""
    return validate.audit(Store(spark, base))


@query()
def hash_sample(spark: SparkSession, base: str) -> DataFrame:
    """A hundred messages by the order of a hash; sampling is the feature."""
    return validate.sample_by_hash(Store(spark, base).rows("messages", "seq"), "event_id", 100)


from sessionlake.plans import sourced, writes  # noqa: E402, F401  (they register their queries)
