"""Agent trajectories: ordered records of a session, what was left out, and two exchange formats."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.text import encode_uri_component, utf8_prefix

COLUMNS = ("session_id", "source_sequence", "suborder", "id", "role", "category", "content", "tool_call_id", "name", "arguments", "status", "timestamp", "source_event_id", "original_bytes", "returned_bytes", "content_hash", "truncated")
META_ROLES, META_KINDS = ("developer", "system"), ("preamble", "system", "summary")
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"


def events_from_rows(messages: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """``session_id, id, sequence, role, kind, timestamp, text``: the events behind stored messages and tool calls, each id once."""
    said = messages.select("session_id", F.col("event_id").alias("id"), F.col("seq").alias("sequence"), F.when(F.col("role") == "reasoning", "thinking").otherwise(F.col("role")).alias("role"), F.when(F.col("role") == "reasoning", "reasoning").otherwise(F.lit("message")).alias("kind"), F.col("ts").alias("timestamp"), "text")
    called = tool_calls.select("session_id", F.col("event_id").alias("id"), F.col("seq").alias("sequence"), F.lit("assistant").alias("role"), F.lit("tool_call").alias("kind"), F.coalesce("started_at", "completed_at").alias("timestamp"), F.lit(None).cast("string").alias("text"))
    first = said.unionByName(called.join(said.select("session_id", "id"), ["session_id", "id"], "left_anti"))
    return first.groupBy("session_id", "id").agg(F.min(F.struct("sequence", "role", "kind", "timestamp", "text")).alias("_e")).select("session_id", "id", "_e.*")


def _record_id(role: str, source: Column) -> Column:
    return F.concat(F.lit(f"trajectory:{role}:"), encode_uri_component(source))


def _shape(df: DataFrame, **values: Column) -> DataFrame:
    kinds = {"source_sequence": "bigint", "suborder": "bigint", "original_bytes": "bigint", "returned_bytes": "bigint", "truncated": "boolean"}
    return df.select(*[values.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def trajectory(sessions: DataFrame, events: DataFrame, tool_calls: DataFrame, reasoning: bool = True, results: bool = True, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The records of each session, numbered from 0, and its losses.

    Records come by the sequence of their event, then by kind: the session itself, reasoning, what was said,
    calls, results. Losses say what an option left out, what was cut at ``most_bytes``, and which events no
    record stands for. Each branch is a filter of the events; only the numbering needs a session together.
    """
    text = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.col("text"))
    spoken = events.withColumn("_text", text)
    is_reasoning = (F.col("kind") == "reasoning") | (F.col("role") == "thinking")
    is_meta = ~is_reasoning & (F.col("role").isin(*META_ROLES) | F.col("kind").isin(*META_KINDS))
    is_said = ~is_reasoning & ~is_meta & (F.col("kind") != "tool_result") & F.col("role").isin("user", "assistant")
    there = F.col("_text").isNotNull()
    at = {"session_id": F.col("session_id"), "source_sequence": F.col("sequence"), "timestamp": F.col("timestamp"), "source_event_id": F.col("id"), "content": F.col("_text")}
    parts = [
        _shape(sessions, session_id=F.col("session_id"), source_sequence=F.lit(-1), suborder=F.lit(0), id=_record_id("meta", F.concat("session_id", F.lit(":session"))), role=F.lit("meta"), category=F.lit("session"), timestamp=F.col("started_at")),
        _shape(spoken.where(is_meta & there), **at, suborder=F.lit(20), id=_record_id("meta", F.col("id")), role=F.lit("meta"), category=F.lit("event")),
        *[_shape(spoken.where(is_said & there & (F.col("role") == who)), **at, suborder=F.lit(20), id=_record_id(who, F.col("id")), role=F.lit(who)) for who in ("user", "assistant")],
    ]
    losses: list[DataFrame] = []

    def lost(df: DataFrame, kind: str, source_kind: str, source: Column, reason: str, original: Column | None = None, returned: Column | None = None) -> None:
        none = F.lit(None).cast("bigint")
        losses.append(df.select("session_id", F.lit(kind).alias("kind"), F.lit(source_kind).alias("source_kind"), source.alias("source_id"), F.lit(reason).alias("reason"), (none if original is None else original).alias("original_bytes"), (none if returned is None else returned).alias("returned_bytes")))

    thought = spoken.where(is_reasoning & there)
    if reasoning:
        parts.append(_shape(thought, **at, suborder=F.lit(10), id=_record_id("reasoning", F.col("id")), role=F.lit("reasoning")))
    else:
        lost(thought, "omitted", "event", F.col("id"), "excluded_by_option")
    placed = tool_calls.join(events.select("session_id", F.col("id").alias("event_id"), F.col("sequence").alias("_at"), F.col("timestamp").alias("_event_time")), ["session_id", "event_id"])
    call = {"session_id": F.col("session_id"), "source_sequence": F.col("_at"), "source_event_id": F.col("event_id"), "tool_call_id": F.col("id"), "status": F.col("status")}
    parts.append(_shape(placed, **call, suborder=F.lit(100), id=_record_id("tool_call", F.col("id")), role=F.lit("tool_call"), name=F.col("tool_name"), arguments=F.col("input_text"), timestamp=F.coalesce("started_at", "_event_time")))
    output = F.coalesce("output_text", F.lit(""))
    observed = placed.where((output != "") | F.col("completed_at").isNotNull()).withColumn("_output", output)
    if results:
        cut = F.col("_output") if most_bytes is None else utf8_prefix(F.col("_output"), most_bytes)
        sized = observed.withColumn("_cut", cut).withColumns({"_original": F.octet_length("_output").cast("long"), "_returned": F.octet_length("_cut").cast("long")})
        parts.append(_shape(sized, **call, suborder=F.lit(110), id=_record_id("tool_result", F.col("id")), role=F.lit("tool_result"), content=F.col("_cut"), timestamp=F.col("completed_at"), original_bytes=F.col("_original"), returned_bytes=F.col("_returned"), content_hash=F.sha2("_output", 256), truncated=F.col("_returned") < F.col("_original")))
        if most_bytes is not None:
            lost(sized.where(F.col("_returned") < F.col("_original")), "truncated", "tool_result", F.col("id"), "tool_result_truncated", F.col("_original"), F.col("_returned"))
    else:
        lost(observed, "omitted", "tool_result", F.col("id"), "excluded_by_option")
    records = reduce(DataFrame.unionByName, parts)
    shown = (is_meta | is_said) & there | (is_reasoning & there)
    silent = spoken.where(~F.coalesce(shown, F.lit(False))).join(placed.select("session_id", F.col("event_id").alias("id")).distinct(), ["session_id", "id"], "left_anti")
    lost(silent, "omitted", "event", F.col("id"), "not_selected_for_agent_projection")
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("source_sequence", "suborder", "id")) - 1
    return records.withColumn("sequence", number.cast("long")), reduce(DataFrame.unionByName, losses)


def trajectory_counts(records: DataFrame, losses: DataFrame) -> DataFrame:
    """``session_id, records, omitted_facts, truncated_records``."""
    kept = records.groupBy("session_id").agg(F.count("*").alias("records"))
    counted = losses.groupBy("session_id").agg(F.sum((F.col("kind") == "omitted").cast("long")).alias("omitted_facts"), F.sum((F.col("kind") == "truncated").cast("long")).alias("truncated_records"))
    return kept.join(counted, "session_id", "left").na.fill(0, ["omitted_facts", "truncated_records"])


def trajectory_faults(records: DataFrame) -> DataFrame:
    """``session_id, fault``: sessions whose records break a rule: numbering, one session record in front, calls before their results."""
    by = Window.partitionBy("session_id").orderBy("sequence")
    calls = F.max(F.when(F.col("role") == "tool_call", F.col("sequence"))).over(Window.partitionBy("session_id", "tool_call_id"))
    placed = records.withColumns({"_place": (F.row_number().over(by) - 1).cast("long"), "_called": calls})
    place, called = F.col("_place"), F.col("_called")
    faults = F.array_compact(
        F.array(
            F.when(F.col("sequence") != place, "numbering"),
            F.when((place == 0) & ~F.col("category").eqNullSafe(F.lit("session")), "no_session_record"),
            F.when((place > 0) & F.col("category").eqNullSafe(F.lit("session")), "second_session_record"),
            F.when((F.col("role") == "tool_result") & (called.isNull() | (called > F.col("sequence"))), "result_without_call"),
            F.when(F.col("truncated") & (F.col("returned_bytes") >= F.col("original_bytes")), "truncation_sizes"),
        )
    )
    return placed.withColumn("_faults", faults).select("session_id", F.explode("_faults").alias("fault")).distinct()


def letta_records(records: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of the first exchange format, and the issues of the conversion.

    Records need an observed ISO time; the calls of one event become one assistant record without content,
    at the time of the first. Event-level meta records cannot be carried.
    """
    timed = F.coalesce(F.col("timestamp").rlike(ISO), F.lit(False))
    body = records.where(~F.col("category").eqNullSafe(F.lit("session")))
    head = sessions.select("session_id", F.lit(-1).cast("bigint").alias("sequence"), F.to_json(F.struct(F.lit("meta").alias("role"), F.col("provider").alias("source"), "model")).alias("record"))
    said = body.where(timed & F.col("role").isin("user", "assistant", "reasoning")).select("session_id", "sequence", F.to_json(F.struct("role", "content", "timestamp")).alias("record"))
    calls = body.where(timed & (F.col("role") == "tool_call"))
    grouped = calls.groupBy("session_id", F.coalesce("source_event_id", "id").alias("_group")).agg(F.min("sequence").alias("sequence"), F.min_by("timestamp", "sequence").alias("timestamp"), F.sort_array(F.collect_list(F.struct("sequence", F.col("tool_call_id").alias("id"), "name", F.col("arguments").alias("args")))).alias("_calls"), F.countDistinct("timestamp").alias("_times"), F.min_by("id", "sequence").alias("_id"))
    called = grouped.select("session_id", "sequence", F.concat(F.lit('{"role":"assistant","content":null,"tool_calls":'), F.to_json(F.transform("_calls", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["args"].alias("args")))), F.lit(',"timestamp":'), F.to_json(F.array("timestamp")).substr(F.lit(2), F.length(F.to_json(F.array("timestamp"))) - 2), F.lit("}")).alias("record"))
    returned = body.where(timed & (F.col("role") == "tool_result")).select("session_id", "sequence", F.to_json(F.struct(F.lit("tool").alias("role"), F.col("tool_call_id"), "content", "timestamp")).alias("record"))
    issue = lambda df, kind: df.select("session_id", F.lit(kind).alias("kind"), F.col("id").alias("source_record_id"))
    talking = body.where(F.col("role") == "assistant").select("session_id", F.col("source_event_id").alias("_group")).distinct()
    issues = reduce(
        DataFrame.unionByName,
        [
            issue(body.where(F.col("role") == "meta"), "event_meta_omitted"),
            issue(body.where((F.col("role") != "meta") & ~timed), "missing_or_invalid_timestamp"),
            issue(grouped.join(talking, ["session_id", "_group"], "left_semi").withColumn("id", F.col("_id")), "mixed_assistant_split"),
            issue(grouped.where(F.col("_times") > 1).withColumn("id", F.col("_id")), "tool_call_timestamps_coalesced"),
        ],
    )
    return reduce(DataFrame.unionByName, [head, said, called, returned]), issues


def atif_steps(records: DataFrame, reasoning: bool = True) -> DataFrame:
    """Steps of the second exchange format: ``session_id, step_id, source, message, reasoning_content, timestamp, tool_calls, results``.

    A step stands for an event; step ids count from 1. Arguments that are no JSON object are left out of the
    call and kept beside it as text.
    """
    body = records.where(~F.col("category").eqNullSafe(F.lit("session"))).withColumn("_event", F.coalesce("source_event_id", "id"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("arguments")), F.lit("OBJECT")), F.lit(False))
    call = F.struct("sequence", F.col("tool_call_id").alias("id"), "name", F.when(is_object, F.col("arguments")).otherwise(F.lit("{}")).alias("arguments"), F.when(~is_object, F.col("arguments")).alias("raw_arguments"))
    result = F.struct("sequence", F.col("tool_call_id").alias("source_call_id"), "content", "truncated")
    pick = lambda role, value: F.when(F.col("role") == role, value)
    steps = body.groupBy("session_id", "_event").agg(
        F.min("source_sequence").alias("_at"),
        F.min("sequence").alias("_first"),
        F.max((F.col("role") == "tool_call").cast("int")).alias("_calls"),
        F.max((F.col("role") == "user").cast("int")).alias("_user"),
        F.max((F.col("role") == "meta").cast("int")).alias("_meta"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role").isin("user", "assistant", "meta"), F.struct("sequence", "content")))), lambda x: x["content"]), "\n\n").alias("message"),
        F.array_join(F.transform(F.sort_array(F.collect_list(pick("reasoning", F.struct("sequence", "content")))), lambda x: x["content"]), "\n\n").alias("reasoning_content"),
        F.min_by("timestamp", F.when(F.col("timestamp").rlike(ISO), F.col("sequence"))).alias("timestamp"),
        F.sort_array(F.collect_list(pick("tool_call", call))).alias("tool_calls"),
        F.sort_array(F.collect_list(pick("tool_result", result))).alias("results"),
    )
    source = F.when(F.col("_calls") == 1, "agent").when(F.col("_meta") == 1, "system").when(F.col("_user") == 1, "user").otherwise("agent")
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("_at", "_first")).cast("long")
    thought = F.when((source == "agent") & (F.col("reasoning_content") != ""), F.col("reasoning_content")) if reasoning else F.lit(None).cast("string")
    return steps.select("session_id", number.alias("step_id"), source.alias("source"), "message", thought.alias("reasoning_content"), "timestamp", "tool_calls", "results")


def export_lines(page: list[dict], trajectories: dict[str, list[dict]], manifest: dict, after_session: str | None, next_key: list | None, check=lambda: None) -> Iterator[str]:
    """The frames of one export page as JSON lines: manifest, messages, trajectories of the sessions first seen here, receipt.

    The receipt holds the counts, bytes and SHA-256 of the lines before it; ``check`` raises where the
    snapshot has changed meanwhile, and an error frame then ends the stream. A page is bounded by its query.
    """
    digest, size = hashlib.sha256(), 0

    def line(frame: dict) -> str:
        nonlocal size
        out = json.dumps(frame, separators=(",", ":"), ensure_ascii=False, default=str) + "\n"
        digest.update(out.encode())
        size += len(out.encode())
        return out

    try:
        yield line({"kind": "manifest", **manifest})
        for row in page:
            yield line({"kind": "message", "message": row})
        sessions = [s for s in dict.fromkeys(r["session_id"] for r in page) if s != after_session]
        for s in sessions:
            yield line({"kind": "trajectory", "session_id": s, "records": trajectories.get(s, [])})
        check()
        yield json.dumps({"kind": "receipt", "snapshot": manifest.get("snapshot"), "counts": {"messages": len(page), "trajectories": len(sessions)}, "content": {"bytes": size, "sha256": f"sha256:{digest.hexdigest()}"}, "next": next_key}, separators=(",", ":")) + "\n"
    except Exception as e:  # the stream ends in a frame, not in a torn line
        yield json.dumps({"kind": "error", "message": str(e)}, separators=(",", ":")) + "\n"


def verify_export(lines: list[str]) -> dict:
    """The receipt of an exported page, or a ValueError that names what does not hold."""
    receipt = json.loads(lines[-1])
    if receipt.get("kind") != "receipt":
        raise ValueError(f"no receipt: {receipt.get('message', receipt.get('kind'))}")
    body = "".join(lines[:-1]).encode()
    if len(body) != receipt["content"]["bytes"] or f"sha256:{hashlib.sha256(body).hexdigest()}" != receipt["content"]["sha256"]:
        raise ValueError("the content is not that of the receipt")
    kinds = [json.loads(x)["kind"] for x in lines[:-1]]
    if kinds[:1] != ["manifest"] or kinds.count("message") != receipt["counts"]["messages"] or kinds.count("trajectory") != receipt["counts"]["trajectories"]:
        raise ValueError("the frames are not those of the receipt")
    return receipt
