"""From source events to rows: sequences, roles, text, context, tool calls, lineage, project identity."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.hashing import message_content_hash, wide_hash_column
from sessionlake.operators.redaction import redact, redact_value
from sessionlake.schemas import SESSION_ROLES

BLOCK_TYPE = "array<struct<id:string,sequence:bigint,kind:string,text:string,markdown:string,thinking:string,nativeType:string>>"


# ---- events


def number_events(events: DataFrame, position: str = "position") -> DataFrame:
    """``sequence`` from 0 without gaps within each session, in the order of ``position`` and id."""
    return events.withColumn("sequence", (F.row_number().over(Window.partitionBy("session_id").orderBy(position, "id")) - 1).cast("long"))


def sequence_gaps(events: DataFrame) -> DataFrame:
    """``session_id, id, sequence, expected`` of the events whose sequence is not their place."""
    place = (F.row_number().over(Window.partitionBy("session_id").orderBy("sequence", "id")) - 1).cast("long")
    return events.select("session_id", "id", "sequence", place.alias("expected")).where(~F.col("sequence").eqNullSafe(F.col("expected")))


def first_by_id(rows: DataFrame, id_: str, position: str) -> DataFrame:
    """The first row of each id; partial results are made before the shuffle."""
    rest = [c for c in rows.columns if c != id_]
    return rows.groupBy(id_).agg(F.min_by(F.struct(*rest), F.struct(position, *[c for c in rest if c != position and rows.schema[c].dataType.typeName() != "map"])).alias("_r")).select(id_, *[F.col(f"_r.{c}").alias(c) for c in rest])


def duplicate_ids(rows: DataFrame, id_: str) -> DataFrame:
    """``id, n_rows`` of the ids that occur more than once."""
    return rows.groupBy(id_).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def role_of(native: Column) -> Column:
    """A session role from a source's own word: the word itself where it is one, else unknown."""
    return F.when(native.isin(*(r for r in SESSION_ROLES if r != "unknown")), native).otherwise("unknown")


#: Parts of a source's own words, in the order in which they decide, and whole words, by the kind of event they name.
KIND_PARTS = (("tool_call", ("tool",)), ("reasoning", ("thinking", "reasoning")), ("preamble", ("preamble",)), ("summary", ("summary",)), ("usage", ("token_count",)), ("snapshot", ("snapshot", "diff")), ("lifecycle", ("phase", "turn", "loop")))
KIND_WORDS = {"compacted": "summary", "usage": "usage", "user": "message", "assistant": "message", "message": "message", "system": "system", "session_meta": "system"}


def kind_of(native: Column) -> Column:
    """An event kind from a source's own word."""
    out = F.when(native.contains("tool") & native.contains("result"), "tool_result")
    for kind, parts in KIND_PARTS:
        if kind == "lifecycle":  # the least telling parts come after all whole words
            for word, of in KIND_WORDS.items():
                out = out.when(native == word, of)
        for part in parts:
            out = out.when(native.contains(part), kind)
    return out.otherwise("unknown")


def message_role(role: Column) -> Column:
    """The role under which an event becomes a message; null where it does not."""
    return F.when(role.isin("user", "assistant"), role).when(role == "thinking", "reasoning")


def _tool_like(native: Column) -> Column:
    said = F.lower(F.coalesce(native, F.lit("")))
    return said.contains("tool") | said.endswith("_call") | said.endswith("_output") | said.endswith("_result")


def event_text(content: Column, blocks: Column) -> Column:
    """An event's conversational text: its own, or that of its visible blocks without tool payloads, parted by blank lines."""
    shown = F.filter(blocks, lambda b: ~_tool_like(b["nativeType"]))
    said = F.transform(shown, lambda b: F.when(b["kind"] == "text", b["text"]).when(b["kind"] == "markdown", b["markdown"]).when(b["kind"] == "thinking", b["thinking"]))
    joined = F.array_join(F.array_compact(F.coalesce(said, F.array().cast("array<string>"))), "\n\n")
    return F.when(F.trim(F.coalesce(content, F.lit(""))) != "", content).otherwise(joined)


def content_blocks(native: Column) -> Column:
    """The content of a native JSON value as blocks: strings, lists and nested ``content`` are walked, the kind of a tool is inherited.

    JSON of unknown depth has no SQL expression; the walk runs over Arrow batches. Unreadable JSON is one text block.
    """

    def walk(value: object, native_type: str | None, out: list[dict]) -> None:
        if value is None:
            return
        if isinstance(value, list):
            for v in value:
                walk(v, native_type, out)
            return
        if not isinstance(value, dict):
            if str(value).strip():
                out.append({"kind": "text", "text": str(value), "nativeType": native_type})
            return
        own = value.get("type") if isinstance(value.get("type"), str) else native_type
        inherited = native_type if native_type and "tool" in native_type.lower() else own
        for key, kind in (("text", "text"), ("markdown", "markdown"), ("thinking", "thinking")):
            if isinstance(value.get(key), str) and value[key].strip():
                out.append({"kind": kind, kind: value[key], "nativeType": inherited})
                return
        if own in ("image", "image_url", "input_image"):
            out.append({"kind": "image", "nativeType": inherited})
        elif own in ("file", "document"):
            out.append({"kind": "file", "nativeType": inherited})
        elif "content" in value:
            walk(value["content"], inherited, out)
        elif value:
            out.append({"kind": "json", "text": None, "nativeType": inherited})

    @F.pandas_udf(BLOCK_TYPE)
    def blocks(values: pd.Series) -> pd.Series:
        def one(t: str | None):
            if t is None:
                return []
            try:
                parsed = json.loads(t)
            except ValueError:
                parsed = t
            out: list[dict] = []
            walk(parsed, None, out)
            return [{"id": str(i), "sequence": i, "text": None, "markdown": None, "thinking": None, **b} for i, b in enumerate(out)]

        return values.map(one)

    return blocks(native)


#: Keys of native values that hold machinery instead of facts.
PRUNED = ("diff", "patch", "snapshot", "ciphertext", "encrypted_content")


def projected_value(native: Column, keep_structure: bool = False) -> Column:
    """A native JSON value redacted, and unless ``keep_structure`` without machinery keys and empty values."""

    def prune(value: object) -> object:
        if isinstance(value, dict):
            kept = {k: prune(v) for k, v in value.items() if not any(p in k.lower() for p in PRUNED)}
            return {k: v for k, v in kept.items() if v not in (None, "", [], {})}
        if isinstance(value, list):
            return [v for v in map(prune, value) if v not in (None, "", [], {})]
        return value

    @F.pandas_udf("string")
    def projected(values: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                value = redact_value(json.loads(t))
            except ValueError:
                return str(redact_value(t))
            return json.dumps(value if keep_structure else prune(value), separators=(",", ":"), ensure_ascii=False)

        return values.map(one)

    return projected(native)


# ---- edges and context


def result_edges(events: DataFrame) -> DataFrame:
    """``session_id, from_id, to_id``: each tool result and the last earlier call of the same tool call id."""
    before = Window.partitionBy("session_id", "tool_call_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    call = F.last(F.when(F.col("kind") == "tool_call", F.col("id")), ignorenulls=True).over(before)
    paired = events.where(F.col("tool_call_id").isNotNull()).withColumn("_call", call)
    return paired.where((F.col("kind") == "tool_result") & F.col("_call").isNotNull()).select("session_id", F.col("id").alias("from_id"), F.col("_call").alias("to_id"))


def parents_of(edges: DataFrame) -> DataFrame:
    """``session_id, parent_session_id`` from the first ``subagent_of`` edge of each session."""
    lineage = edges.where(F.col("kind") == "subagent_of")
    return lineage.groupBy("session_id").agg(F.min_by("from_id", F.struct("order_index", "id")).alias("parent_session_id"))


_CONTEXT = ("model", "model_provider", "reasoning_effort")


def event_context(events: DataFrame, contexts: DataFrame, usage: DataFrame) -> DataFrame:
    """``session_id, id, execution_context_id`` and the model, provider and effort in force at each event.

    Contexts up to the event's sequence are carried forward, each value from the last that has it; contexts
    of the event's own turn come after those, usage records of the event last of all.
    """
    marks = contexts.select("session_id", "sequence", F.lit(0).alias("_turn"), F.col("id").alias("_context"), F.lit(None).cast("string").alias("id"), *_CONTEXT)
    points = events.select("session_id", "sequence", F.lit(1).alias("_turn"), F.lit(None).cast("string").alias("_context"), "id", *[F.lit(None).cast("string").alias(c) for c in _CONTEXT])
    line = Window.partitionBy("session_id").orderBy("sequence", "_turn", "_context", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = marks.unionByName(points).withColumns({f"_{c}": F.last(c, ignorenulls=True).over(line) for c in ("_context", *_CONTEXT)}).where(F.col("_turn") == 1)
    own = contexts.where((F.col("scope") == "turn") & F.col("turn_id").isNotNull())
    turns = events.select("session_id", "id", F.explode(F.array_distinct(F.array_compact(F.array("id", "native_event_id")))).alias("turn_id"))
    order = F.struct("sequence", F.col("c.id"))
    exact = turns.join(own.alias("c"), ["session_id", "turn_id"]).groupBy("session_id", turns["id"]).agg(
        F.max_by(F.col("c.id"), order).alias("_x_context"), *[F.max_by(F.when(F.col(f"c.{c}").isNotNull(), F.col(f"c.{c}")), F.when(F.col(f"c.{c}").isNotNull(), order)).alias(f"_x_{c}") for c in _CONTEXT]
    )
    said = usage.where(F.col("event_id").isNotNull()).groupBy("session_id", F.col("event_id").alias("id")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("order_index", c))).alias(f"_u_{c}") for c in _CONTEXT[:2]])
    joined = carried.select("session_id", "id", "__context", *[f"_{c}" for c in _CONTEXT]).join(exact, ["session_id", "id"], "left").join(said, ["session_id", "id"], "left")
    return joined.select(
        "session_id",
        "id",
        F.coalesce("_x_context", "__context").alias("execution_context_id"),
        *[F.coalesce(*([f"_u_{c}"] if c != "reasoning_effort" else []), f"_x_{c}", f"_{c}").alias(c) for c in _CONTEXT],
    )


def latest_model(contexts: DataFrame, usage: DataFrame) -> DataFrame:
    """``session_id, model, model_provider``: the last known of the contexts, else of the usage records."""
    last = lambda df, c, by: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(by, "id")))
    from_contexts = contexts.groupBy("session_id").agg(last(contexts, "model", "sequence").alias("_m"), last(contexts, "model_provider", "sequence").alias("_p"))
    from_usage = usage.groupBy("session_id").agg(last(usage, "model", "order_index").alias("_um"), last(usage, "model_provider", "order_index").alias("_up"))
    return from_contexts.join(from_usage, "session_id", "full_outer").select("session_id", F.coalesce("_m", "_um").alias("model"), F.coalesce("_p", "_up").alias("model_provider"))


# ---- rows


def message_rows(events: DataFrame) -> DataFrame:
    """The messages of events: known roles with text, redacted and trimmed, with their content hash."""
    text = F.regexp_replace(redact(event_text(F.col("content_text"), F.col("blocks"))), r"^\s+|\s+$", "")
    rows = events.select("session_id", F.col("id").alias("event_id"), F.col("sequence").alias("seq"), message_role(F.col("role")).alias("role"), text.alias("text"), F.col("timestamp").alias("ts"), "project_key")
    kept = rows.where(F.col("role").isNotNull() & (F.col("text") != ""))
    return kept.withColumn("content_hash", message_content_hash(F.col("session_id"), F.col("event_id"), F.col("seq"), F.col("role"), F.col("text")))


def tool_call_rows(calls: DataFrame, events: DataFrame) -> DataFrame:
    """The tool calls with the sequence of their event, or their own place where the event is missing; payloads redacted and hashed."""
    placed = calls.join(events.select("session_id", F.col("id").alias("event_id"), F.col("sequence").alias("_seq")), ["session_id", "event_id"], "left")
    rows = placed.withColumns({"seq": F.coalesce("_seq", "position"), "input_text": redact(F.coalesce("input_text", F.lit(""))), "output_text": redact(F.coalesce("output_text", F.lit("")))}).drop("_seq")
    return rows.withColumns({"input_hash": F.sha2("input_text", 256), "output_hash": F.sha2("output_text", 256)})


# ---- identity


def normalized_remote(remote: Column) -> Column:
    """A git remote as host/path in small letters, without user, scheme, port and ``.git``; null for an empty one."""
    said = F.trim(remote)
    clean = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^/+", ""), r"(?i)\.git(?=/*$)", ""), "/+$", ""))
    scp = r"^(?:[^@]+@)?([^:]+):(.+)$"
    url = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/:?#]*)(?::\d+)?([^?#]*).*$"
    by_url = F.when((F.regexp_extract(said, url, 1) != "") & (clean(F.regexp_extract(said, url, 2)) != ""), F.concat(F.lower(F.regexp_extract(said, url, 1)), F.lit("/"), clean(F.regexp_extract(said, url, 2))))
    by_scp = F.concat(F.lower(F.regexp_extract(said, scp, 1)), F.lit("/"), clean(F.regexp_extract(said, scp, 2)))
    plain = F.when(clean(said) != "", clean(said))
    return F.when(said == "", None).when(said.contains("://"), by_url).when(said.rlike(scp), by_scp).otherwise(plain)


def project_identity(df: DataFrame) -> DataFrame:
    """``df`` (explicit_key, git_remote, package_name, workspace_name, raw_path, machine_id) with ``project_key`` and ``confidence``.

    The first that is there wins: a given key, the git remote, the package, the workspace, the path on the machine.
    """
    named = lambda prefix, c: F.when(F.trim(F.col(c)) != "", F.concat(F.lit(prefix), F.trim(F.col(c))))
    remote = normalized_remote(F.col("git_remote"))
    path = F.coalesce(F.regexp_replace(F.when(F.trim(F.col("raw_path")) != "", F.trim(F.col("raw_path"))), "(?<=.)/+$", ""), F.lit("/unknown-project"))
    explicit, git = named("project:", "explicit_key"), F.when(remote.isNotNull(), F.concat(F.lit("git:"), remote))
    package, workspace = named("package:", "package_name"), named("workspace:", "workspace_name")
    fallback = F.concat(F.lit("path:"), F.coalesce("machine_id", F.lit("")), F.lit(":"), wide_hash_column(path))
    confidence = F.when(explicit.isNotNull(), "explicit").when(git.isNotNull(), "high").when(package.isNotNull() | workspace.isNotNull(), "medium").otherwise("low")
    return df.withColumns({"project_key": F.coalesce(explicit, git, package, workspace, fallback), "confidence": confidence})
