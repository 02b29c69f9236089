"""Typed, bounded queries over the store: validation, filters, paging, projections, cursors."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.text import parsed_timestamp
from sessionlake.operators.lineage import below, links
from sessionlake.operators.store import Store
from sessionlake.runtime import table
from sessionlake.schemas import MESSAGE_ROLES, PROVIDERS, TABLES

DEFAULT_LIMIT, MOST_ROWS, MOST_FIELDS = 100, 200, 32


class QueryError(ValueError):
    """A query that says something it may not."""


@dataclass(frozen=True)
class Filters:
    """Conditions of a query; one that is None is no condition, an empty list of providers matches nothing."""

    project_key: str | None = None
    providers: tuple[str, ...] | None = None
    session_id: str | None = None
    agent_name: str | None = None
    agent_role: str | None = None
    model: str | None = None
    model_provider: str | None = None
    role: str | None = None
    tool_name: str | None = None
    tool_call_id: str | None = None
    message_after: str | None = None
    message_before: str | None = None
    session_started_after: str | None = None
    session_started_before: str | None = None
    roots_only: bool = False
    lineage_root_session_id: str | None = None


@dataclass(frozen=True)
class Query:
    """``kind`` is sessions, messages or tool_calls; ``after`` is the last key of the page before."""

    kind: str
    filters: Filters = field(default_factory=Filters)
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    after: tuple[str, int] | None = None
    fields: tuple[str, ...] | None = None


_USABLE = {
    "sessions": {"project_key", "providers", "session_id", "agent_name", "agent_role", "model", "model_provider", "session_started_after", "session_started_before", "roots_only", "lineage_root_session_id"},
    "messages": {"project_key", "providers", "session_id", "agent_name", "agent_role", "model", "model_provider", "role", "message_after", "message_before", "session_started_after", "session_started_before", "roots_only", "lineage_root_session_id"},
    "tool_calls": {"project_key", "providers", "session_id", "agent_name", "agent_role", "model", "model_provider", "tool_name", "tool_call_id"},
}
PAYLOAD_FIELDS = ("input_text", "output_text")


def _moment(name: str, value: str) -> datetime:
    try:
        return datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError as e:
        raise QueryError(f"{name} is no timestamp: {value!r}") from e


def validate(query: Query) -> Query:
    """The query itself, or a QueryError that names what is wrong."""
    if query.kind not in _USABLE:
        raise QueryError(f"unknown kind {query.kind!r}")
    given = {f.name for f in fields(Filters) if getattr(query.filters, f.name) not in (None, False)}
    if unknown := given - _USABLE[query.kind]:
        raise QueryError(f"{query.kind} has no filter {', '.join(sorted(unknown))}")
    if not 1 <= query.limit <= MOST_ROWS:
        raise QueryError(f"limit must be from 1 to {MOST_ROWS}")
    if query.offset < 0 or query.offset and query.kind == "messages":
        raise QueryError("offset must not be negative, and messages are paged by key")
    if query.after is not None and query.kind != "messages":
        raise QueryError("only messages are paged by key")
    f = query.filters
    if f.role is not None and f.role not in MESSAGE_ROLES:
        raise QueryError(f"unknown role {f.role!r}")
    if f.providers is not None and (len(set(f.providers)) != len(f.providers) or not set(f.providers) <= set(PROVIDERS)):
        raise QueryError("providers must be known and different")
    for low, high in (("message_after", "message_before"), ("session_started_after", "session_started_before")):
        ends = [_moment(n, v) for n in (low, high) if (v := getattr(f, n)) is not None]
        if len(ends) == 2 and ends[0].replace(tzinfo=None) >= ends[1].replace(tzinfo=None):
            raise QueryError(f"{low} must be before {high}")
    if query.fields is not None:
        if not 1 <= len(query.fields) <= MOST_FIELDS or len(set(query.fields)) != len(query.fields):
            raise QueryError(f"1 to {MOST_FIELDS} different fields can be named")
        if query.kind == "tool_calls" and set(query.fields) & set(PAYLOAD_FIELDS) and f.tool_call_id is None:
            raise QueryError("payloads are read for one tool call")
    return query


def _equal(pairs: list[tuple[str, object]], prefix: str = "") -> list[Column]:
    return [F.col(prefix + column) == value for column, value in pairs if value is not None]


def _within(column: str, low: str | None, high: str | None) -> list[Column]:
    """From ``low`` on and before ``high``; rows without a readable time drop out."""
    at = parsed_timestamp(F.col(column))
    out = []
    if low is not None:
        out.append(at >= F.lit(low).cast("timestamp"))
    if high is not None:
        out.append(at < F.lit(high).cast("timestamp"))
    return out


def _all(conditions: list[Column]) -> Column | None:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def _session_conditions(f: Filters, own_model: bool) -> list[Column]:
    pairs: list[tuple[str, object]] = [("agent_name", f.agent_name), ("assignment_role", f.agent_role)]
    if own_model:
        pairs += [("project_key", f.project_key), ("session_id", f.session_id), ("model", f.model), ("model_provider", f.model_provider)]
    out = _equal(pairs)
    if f.providers is not None:
        out.append(F.col("provider").isin(*f.providers) if f.providers else F.lit(False))
    if f.roots_only:
        out.append(F.col("parent_session_id").isNull())
    return out + _within("started_at", f.session_started_after, f.session_started_before)


def _of_lineage(df: DataFrame, store: Store, root: str | None) -> DataFrame:
    """Rows of sessions at or below ``root``; none where the root is absent. The links are followed down from it."""
    if root is None:
        return df
    wanted = store.spark.createDataFrame([(root,)], "ancestor string")
    found = below(links(table(store.spark, store.base, "sessions")), wanted)
    return df.join(found.select(F.col("id").alias("session_id")), "session_id", "left_semi")


_SESSION_COLUMNS = ("project_key", "provider", "agent_name", "title", "started_at", "updated_at", "source_path", "source_fingerprint", "host", "identity_scheme_version", "normalization_version", "model", "model_provider", "assignment_role", "parent_session_id", "message_count", "tool_call_count")


def select_sessions(store: Store, f: Filters) -> DataFrame:
    """The sessions of a query, with ``ended_at`` for the time of the last change."""
    rows = store.rows("sessions", *_SESSION_COLUMNS, where=_all(_session_conditions(f, own_model=True)))
    return _of_lineage(rows, store, f.lineage_root_session_id).withColumn("ended_at", F.col("updated_at"))


def select_messages(store: Store, f: Filters, text: bool = True) -> DataFrame:
    """The messages of a query with attributes of their session; a message without event id is named by session and seq.

    Without ``text`` only its size is carried, so that no text is shuffled.
    """
    own = _equal([("project_key", f.project_key), ("session_id", f.session_id), ("role", f.role), ("model", f.model), ("model_provider", f.model_provider)])
    own += _within("ts", f.message_after, f.message_before)
    messages = store.rows("messages", "seq", "role", *(["text"] if text else []), F.octet_length("text").cast("long").alias("text_bytes"), "ts", "project_key", "content_hash", "model", "model_provider", "reasoning_effort", where=_all(own))
    sessions = store.rows("sessions", "provider", "agent_name", "title", "assignment_role", "parent_session_id", "started_at", where=_all(_session_conditions(f, own_model=False)))
    joined = messages.join(_of_lineage(sessions, store, f.lineage_root_session_id), "session_id")
    return joined.withColumn("message_id", F.coalesce("event_id", F.concat("session_id", F.lit(":"), F.col("seq").cast("string"))))


def select_tool_calls(store: Store, f: Filters, payloads: bool = False) -> DataFrame:
    """The tool calls of a query with the UTF-8 sizes of their payloads; the payloads themselves only when asked for."""
    own = _equal([("project_key", f.project_key), ("session_id", f.session_id), ("model", f.model), ("model_provider", f.model_provider), ("tool_name", f.tool_name), ("id", f.tool_call_id)])
    sizes = (F.octet_length("input_text").alias("input_bytes"), F.octet_length("output_text").alias("output_bytes"))
    calls = store.rows("tool_calls", "session_id", "event_id", "seq", "tool_name", "status", "started_at", "completed_at", "project_key", "model", "model_provider", *sizes, *(PAYLOAD_FIELDS if payloads else ()), where=_all(own))
    sessions = store.rows("sessions", "provider", "agent_name", "assignment_role", where=_all(_session_conditions(f, own_model=False)))
    shaped = calls.withColumns({"event_id": F.coalesce("event_id", "id"), "called_at": F.coalesce("started_at", "completed_at")}).drop("started_at")
    return shaped.join(sessions, "session_id")


def _project(df: DataFrame, names: tuple[str, ...] | None) -> DataFrame:
    """Exactly the named fields; those a row has not are null."""
    if names is None:
        return df
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def page(store: Store, query: Query) -> DataFrame:
    """The rows of a query's page and one more, by which the caller sees whether there is another page.

    Sessions come newest first by the text of their last time, messages by session and seq, tool calls by
    session, seq and id. Only ``limit`` + 1 rows of each partition are kept for the order, and the page is
    found by its keys: texts are read afterwards, for its rows alone.
    """
    query = validate(query)
    f, more = query.filters, query.limit + 1
    if query.kind == "sessions":
        rows = select_sessions(store, f).orderBy(F.coalesce("updated_at", "started_at", F.lit("")).desc(), "session_id")
    elif query.kind == "messages":
        rows = select_messages(store, f, text=False)
        if query.after is not None:
            session, seq = query.after
            rows = rows.where((F.col("session_id") > session) | ((F.col("session_id") == session) & (F.col("seq") > seq)))
        rows = rows.orderBy("session_id", "seq", "message_id")
    else:
        rows = select_tool_calls(store, f, payloads=bool(query.fields and set(query.fields) & set(PAYLOAD_FIELDS))).orderBy("session_id", "seq", "id")
    if query.offset:
        rows = rows.offset(query.offset)
    rows = rows.limit(more)
    if query.kind == "messages" and (query.fields is None or "text" in query.fields):
        rows = store.texts("messages", rows, "text").orderBy("session_id", "seq", "message_id")
    return _project(rows, query.fields)


def point_lookup(store: Store, keys: list[tuple[str, int]]) -> DataFrame:
    """The messages at a page of (session, seq) keys, in the order of the keys; keys without a message give no row.

    ``keys`` is one page, at most MOST_ROWS long, so the key side is small by construction.
    """
    if len(keys) > MOST_ROWS:
        raise QueryError(f"at most {MOST_ROWS} keys")
    wanted = store.spark.createDataFrame([(i, s, q) for i, (s, q) in enumerate(keys)], "position int, session_id string, seq long")
    messages = store.rows("messages", "seq", "role", "text", where=F.col("session_id").isin(*{s for s, _ in keys}))
    return messages.join(F.broadcast(wanted), ["session_id", "seq"]).orderBy("position").select("position", "session_id", "seq", "event_id", "role", "text")


def fingerprint(query: Query) -> str:
    """SHA-256 of what a query asks for, its place in the pages left out."""
    said = asdict(replace(query, after=None, offset=0))
    return hashlib.sha256(json.dumps(said, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def cursor(query: Query, snapshot: str, last: tuple[str, int] | None = None) -> str:
    """An opaque text that names the next page of this query on this snapshot."""
    said = {"query": fingerprint(query), "snapshot": snapshot, "after": list(last) if last else None, "offset": None if last else query.offset + query.limit}
    return base64.urlsafe_b64encode(json.dumps(said, separators=(",", ":")).encode()).decode().rstrip("=")


def resume(query: Query, text: str, snapshot: str) -> Query:
    """The query of the page a cursor names; a cursor of another query or snapshot is refused."""
    try:
        said = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        query_of, snapshot_of = said["query"], said["snapshot"]
    except (ValueError, KeyError, TypeError) as e:
        raise QueryError("unreadable cursor") from e
    if query_of != fingerprint(query):
        raise QueryError("the cursor belongs to another query")
    if snapshot_of != snapshot:
        raise QueryError("the snapshot of the cursor has expired")
    return replace(query, after=tuple(said["after"])) if said.get("after") else replace(query, offset=int(said["offset"]))


def enrichment_page(
    enrichments: DataFrame, sessions: DataFrame, project_key: str | None = None, session_id: str | None = None, namespace: str | None = None, producer: str | None = None, input_hash: str | None = None, after: tuple[str, str] | None = None, limit: int = 100
) -> DataFrame:
    """Enrichments of sessions that are here, by session and namespace: a page after the key ``after``, and the row after it."""
    if not 1 <= limit <= MOST_ROWS:
        raise QueryError(f"limit must be from 1 to {MOST_ROWS}")
    own = _all(_equal([("session_id", session_id), ("namespace", namespace), ("producer", producer), ("input_hash", input_hash)]))
    rows = enrichments if own is None else enrichments.where(own)
    if after is not None:
        rows = rows.where((F.col("session_id") > after[0]) | ((F.col("session_id") == after[0]) & (F.col("namespace") > after[1])))
    here = sessions.select("session_id", "project_key")
    joined = rows.join(here if project_key is None else here.where(F.col("project_key") == project_key), "session_id")
    return joined.orderBy("session_id", "namespace").limit(limit + 1)


#: The sections of a session, with the order of their rows and the column that names one.
SECTIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "messages": (("seq", "event_id"), "event_id"),
    "tool_calls": (("seq", "id"), "id"),
    "session_events": (("sequence", "id"), "id"),
    "usage_records": (("order_index", "id"), "id"),
    "session_edges": (("order_index", "id"), "id"),
    "session_artifacts": (("order_index", "id"), "id"),
    "execution_contexts": (("sequence", "id"), "id"),
}


def session_detail(store: Store, session_id: str, limit: int = 100, offset: int = 0, pages: dict[str, tuple[int, int]] | None = None) -> dict[str, DataFrame]:
    """A session and its seven sections, each with its own page (``pages``: limit and offset by section) and the count of all its rows.

    The page is numbered within the session, whose rows alone are read. A table that is not here has no rows.
    """
    from pyspark.sql import Window

    of = F.col("session_id") == session_id
    out = {"session": store.rows("sessions", *_SESSION_COLUMNS, where=of)}
    for name, (order, _) in SECTIONS.items():
        most, skip = (pages or {}).get(name, (limit, offset))
        rows = store.rows(name, where=of) if store.has(name) else store.spark.createDataFrame([], TABLES[name])
        counted = rows.withColumn("total", F.count("*").over(Window.partitionBy("session_id"))).orderBy(*order).offset(skip).limit(most)
        out[name] = counted.withColumn("has_more", F.lit(skip + most) < F.col("total"))
    return out


def session_sections(store: Store, session_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """``section, id, total, has_more``: the rows on the pages of all sections of a session."""
    detail = session_detail(store, session_id, limit, offset)
    return reduce(DataFrame.unionByName, [detail[name].select(F.lit(name).alias("section"), F.col(id_).alias("id"), "total", "has_more") for name, (_, id_) in SECTIONS.items()])


def full_session(store: Store, session_id: str) -> DataFrame:
    """``session_id, depth, section, id, place``: every row of a session and of all its descendants, section by section in order."""
    from pyspark.sql import Window

    found = below(links(table(store.spark, store.base, "sessions")), store.spark.createDataFrame([(session_id,)], "ancestor string")).select(F.col("id").alias("session_id"), F.col("distance").alias("depth"))
    parts = []
    for name, (order, id_) in SECTIONS.items():
        if store.has(name):
            rows = store.rows(name, "session_id", order[0], id_).join(found, "session_id")
            place = F.row_number().over(Window.partitionBy("session_id").orderBy(*order)) - 1
            parts.append(rows.select("session_id", "depth", F.lit(name).alias("section"), F.col(id_).alias("id"), place.cast("long").alias("place")))
    return reduce(DataFrame.unionByName, parts)
