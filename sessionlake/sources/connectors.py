"""Connectors: how each source's records become the same events.

A connector says where its files are, which record is what (its kind, or the reason it is dropped), and
where time, role, text and tool fields lie. The rules are a small table joined to the records by their
discriminator; a record without a rule is a named drop, never a silent one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.functions.hashing import wide_hash_column
from sessionlake.operators.normalize import content_blocks, event_text
from sessionlake.sources.files import fingerprint, parse_lines, read_lines, read_sqlite

DROP = "drop"
EVENT_COLUMNS = ("provider", "path", "fingerprint", "native_session_id", "session_id", "record_no", "discriminator", "kind", "role", "timestamp", "content_text", "tool_call_id", "tool_name", "tool_input", "tool_output", "native_event_id", "parent_event_id", "cwd", "model", "calls")
CALL = "struct<id:string,name:string,input:string,output:string,is_result:boolean>"
#: Types of content blocks that call a tool, and that bring a result.
CALL_BLOCKS, RESULT_BLOCKS = ("tool_use", "server_tool_use"), ("tool_result", "web_search_tool_result")


def _get(*paths: str) -> Column:
    """The first of several JSON paths of the record that is there, as text."""
    return F.coalesce(*[F.try_variant_get("record", p, "string") for p in paths])


def _json(*paths: str) -> Column:
    """The first of several JSON paths that is there, as JSON."""
    return F.coalesce(*[F.to_json(F.try_variant_get("record", p, "variant")) for p in paths])


def _of(item: Column, *paths: str) -> Column:
    """The first of several JSON paths of a variant that is there: text as it is, anything else as JSON."""
    return F.coalesce(*[F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.to_json(v)) for v in (F.try_variant_get(item, p, "variant") for p in paths)])


def listed_calls(record: Column | str, path: str, name: tuple[str, ...] = ("$.name", "$.function.name"), input_: tuple[str, ...] = ("$.arguments", "$.function.arguments", "$.input", "$.args")) -> Column:
    """Every call of a list of calls in a record; one without an id is named by its place."""
    items = F.coalesce(F.try_variant_get(record, path, "array<variant>"), F.array().cast("array<variant>"))
    place = F.concat(F.lit("call:"), F.coalesce(F.col("record_no").cast("string"), F.lit("")), F.lit(":"))
    one = lambda x, i: F.struct(F.coalesce(_of(x, "$.id", "$.call_id", "$.tool_call_id"), F.concat(place, i.cast("string"))).alias("id"), _of(x, *name).alias("name"), _of(x, *input_).alias("input"), F.lit(None).cast("string").alias("output"), F.lit(False).alias("is_result"))
    return F.transform(items, one).cast(f"array<{CALL}>")


def block_calls(record: Column | str, path: str, result_id: tuple[str, ...] = ("$.tool_use_id", "$.toolUseID"), output: tuple[str, ...] = ("$.content", "$.run")) -> Column:
    """Every call and every result among the content blocks of a record, in their order; blocks without an id are none."""
    items = F.coalesce(F.try_variant_get(record, path, "array<variant>"), F.array().cast("array<variant>"))
    type_ = lambda x: F.try_variant_get(x, "$.type", "string")
    is_result = lambda x: type_(x).isin(*RESULT_BLOCKS)
    one = lambda x: F.struct(
        F.when(is_result(x), _of(x, *result_id)).otherwise(_of(x, "$.id")).alias("id"), F.when(~is_result(x), _of(x, "$.name")).alias("name"), F.when(~is_result(x), _of(x, "$.input")).alias("input"), F.when(is_result(x), _of(x, *output)).alias("output"), is_result(x).alias("is_result")
    )
    calls = F.transform(F.filter(items, lambda x: F.coalesce(type_(x).isin(*CALL_BLOCKS, *RESULT_BLOCKS), F.lit(False))), one)
    return F.filter(calls, lambda c: c["id"].isNotNull()).cast(f"array<{CALL}>")


@dataclass(frozen=True)
class Connector:
    """``rules``: kind by discriminator; a kind that begins with ``drop`` names the reason.

    ``call_list`` is the path of a list of calls in a record, ``call_blocks`` that of a list of content blocks
    some of which are calls and results; every element counts.
    """

    provider: str
    glob: str
    discriminator: tuple[str, ...]
    rules: dict[str, str]
    session: tuple[str, ...]
    time: tuple[str, ...] = ("$.timestamp",)
    role: tuple[str, ...] = ("$.role",)
    content: tuple[str, ...] = ("$.content",)
    call_id: tuple[str, ...] = ("$.tool_call_id",)
    tool_name: tuple[str, ...] = ("$.name",)
    tool_input: tuple[str, ...] = ("$.arguments",)
    tool_output: tuple[str, ...] = ("$.output",)
    event_id: tuple[str, ...] = ("$.id",)
    parent_id: tuple[str, ...] = ("$.parentId",)
    cwd: tuple[str, ...] = ("$.cwd",)
    model: tuple[str, ...] = ("$.model",)
    roles: dict[str, str] = field(default_factory=dict)
    call_list: str | None = None
    call_blocks: str | None = None


def _same(kind: str, *names: str) -> dict[str, str]:
    return dict.fromkeys(names, kind)


def _dropped(*names: str) -> dict[str, str]:
    return {n: f"{DROP}:{n}" for n in names}


# The record types of each source and what they are.
CONNECTORS: dict[str, Connector] = {
    c.provider: c
    for c in (
        Connector(
            "codex", "rollout-*.jsonl", ("$.type", "$.payload.type"),
            {
                **_same("system", "session_meta", "session_meta.session_meta", "response_item.agent_message"), **_same("summary", "compacted"),
                **_same("message", "response_item.message", "message", "event_msg.agent_message", "event_msg.user_message"),
                **_same("tool_call", "response_item.function_call", "response_item.custom_tool_call", "response_item.local_shell_call", "response_item.web_search_call", "response_item.tool_search_call", "function_call"),
                **_same("tool_result", "response_item.function_call_output", "response_item.custom_tool_call_output", "response_item.local_shell_call_output", "response_item.tool_search_output", "function_call_output", "event_msg.mcp_tool_call_end", "event_msg.image_generation_end"),
                **_same("reasoning", "response_item.reasoning", "reasoning"), **_same("usage", "event_msg.token_count"),
                **_same("lifecycle", "event_msg.task_started", "event_msg.task_complete", "event_msg.turn_aborted", "event_msg.sub_agent_activity", "event_msg.thread_rolled_back"),
                **_dropped("turn_context", "world_state", "inter_agent_communication_metadata", "event_msg.thread_settings_applied", "event_msg.exec_command_end", "event_msg.patch_apply_end", "event_msg.web_search_end", "event_msg.thread_goal_updated", "event_msg.context_compacted", "event_msg.item_completed", "event_msg.thread_name_updated", "event_msg.collab_agent_spawn_end", "event_msg.collab_waiting_end", "event_msg.error"),
            },
            session=("$.payload.id",), role=("$.payload.role", "$.role"), content=("$.payload.content", "$.payload.message", "$.payload.text", "$.payload.summary", "$.content", "$.summary"), call_id=("$.payload.call_id", "$.call_id"),
            tool_name=("$.payload.name", "$.name"), tool_input=("$.payload.arguments", "$.payload.input", "$.payload.action", "$.arguments"), tool_output=("$.payload.output", "$.payload.result", "$.output"), event_id=("$.payload.id",), cwd=("$.payload.cwd",), model=("$.payload.model",),
            roles={"event_msg.agent_message": "assistant", "event_msg.user_message": "user"},
        ),
        Connector(
            "claude", "*.jsonl", ("$.type",),
            {**_same("message", "user", "assistant"), **_same("system", "system"), **_same("snapshot", "attachment", "file-history-snapshot"), **_same("summary", "ai-title", "custom-title", "summary"), **_dropped("file-history-delta", "frame-link", "last-prompt", "mode", "permission-mode", "queue-operation")},
            session=("$.agentId", "$.sessionId"), role=("$.message.role",), content=("$.message.content", "$.content"), event_id=("$.uuid",), parent_id=("$.parentUuid",), model=("$.message.model",), call_blocks="$.message.content",
        ),
        Connector(
            "grok", "chat_history.jsonl", ("$.type",),
            {**_same("message", "user", "assistant"), **_same("reasoning", "reasoning"), **_same("tool_call", "backend_tool_call"), **_same("tool_result", "tool_result"), **_same("system", "system")},
            session=(), role=("$.type",), content=("$.content", "$.summary"), tool_output=("$.content",), call_list="$.tool_calls",
        ),
        Connector(
            "kimi", "wire.jsonl", ("$.type", "$.event.type"),
            {
                **_same("message", "context.append_message"), **_same("message", "context.append_loop_event.content.part"), **_same("tool_call", "context.append_loop_event.tool.call"), **_same("tool_result", "context.append_loop_event.tool.result"),
                **_same("summary", "context.apply_compaction"), **_same("usage", "usage.record"),
                **_dropped("context.append_loop_event.step.begin", "context.append_loop_event.step.end", "micro_compaction.apply", "full_compaction.begin", "full_compaction.complete", "metadata", "config.update", "permission.set_mode", "permission.record_approval_result", "tools.set_active_tools", "tools.update_store", "goal.create", "goal.update", "goal.clear", "turn.prompt", "turn.steer", "turn.cancel", "swarm_mode.enter", "swarm_mode.exit", "plan_mode.enter", "plan_mode.exit"),
            },
            session=(), time=("$.time", "$.timestamp"), role=("$.message.role",), content=("$.message.content", "$.event.part.text", "$.event.part.think"), call_id=("$.event.toolCallId", "$.event.id"), tool_name=("$.event.name",), tool_input=("$.event.arguments", "$.event.input"), tool_output=("$.event.output", "$.event.result"),
            roles={"context.append_loop_event.content.part": "assistant"},
        ),
        Connector(
            "antigravity", "*.jsonl", ("$.type",),
            {
                **_same("message", "USER_INPUT", "PLANNER_RESPONSE"), **_same("system", "CHECKPOINT", "SYSTEM_MESSAGE"), **_same("lifecycle", "INVOKE_SUBAGENT", "ERROR_MESSAGE"),
                **_same("tool_call", "VIEW_FILE", "LIST_DIRECTORY", "GENERIC", "CODE_ACTION", "RUN_COMMAND"), **_same("tool_result", "GREP_SEARCH", "FIND", "SEARCH_WEB"), **_dropped("CONVERSATION_HISTORY"),
            },
            session=(), time=("$.created_at",), content=("$.content", "$.thinking"), event_id=("$.step_index",), tool_name=("$.type",), call_list="$.tool_calls", roles={"USER_INPUT": "user", "PLANNER_RESPONSE": "assistant"},
        ),
        *(
            Connector(
                p, "*.jsonl", ("$.type",),
                {**_same("message", "message"), **_same("system", "session"), **_same("summary", "compaction", "branch_summary"), **_same("preamble", "custom_message"), **_same("lifecycle", "thinking_level_change", "model_change", "custom", "label", "session_info"), **more},
                session=("$.id",), role=("$.message.role",), content=("$.message.content",), call_id=("$.message.toolCallId",), tool_name=("$.message.toolName",), tool_output=("$.message.content",), model=("$.message.model", "$.modelId"),
            )
            for p, more in (
                ("omp", {**_same("summary", "title", "title_change"), **_same("lifecycle", "service_tier_change", "tool_choice_change", "ttsr_injection", "mcp_tool_selection", "session_init", "mode_change", "session_metadata", "checkpoint", "mode")}),
                ("pi", {}),
                ("prime", {}),
            )
        ),
    )
}

#: SQLite sources: file name, query and columns; the rows become events as those of files do.
SQLITE: dict[str, tuple[str, str, str]] = {
    "opencode": (
        "opencode.db",
        "select p.session_id, p.id, p.message_id, p.time_created, m.data as message, p.data as part, s.directory, s.title, length(cast(p.data as blob)) as bytes from part p join message m on m.id = p.message_id join session s on s.id = p.session_id order by p.session_id, p.time_created, p.id",
        "native_session_id string, native_event_id string, message_id string, time_created long, message string, part string, directory string, title string, bytes long",
    ),
    "hermes": (
        "state.db",
        "select m.session_id, cast(m.id as text), m.role, m.content, m.tool_call_id, m.tool_calls, m.tool_name, m.timestamp, s.model from messages m join sessions s on s.id = m.session_id order by m.session_id, m.timestamp, m.id",
        "native_session_id string, native_event_id string, role string, content string, tool_call_id string, tool_calls string, tool_name string, timestamp double, model string",
    ),
    "devin": ("*.db", "select session_id, node_id, parent_node_id, data from message_nodes", "native_session_id string, node_id long, parent_node_id long, data string"),
    "cursor": ("store.db", "select id, data from blobs", "blob_id string, data binary"),
}
GARBAGE_BYTES = 1 << 20


def session_id(provider: str, native: Column) -> Column:
    """The session id of a native one: the same on every machine and path."""
    return F.concat(F.lit(f"{provider}:"), wide_hash_column(native))


def only_thinking(record: Column | str, path: str) -> Column:
    """Whether the content of a record is a list of thinking blocks and nothing else."""
    types = F.transform(F.try_variant_get(record, path, "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.type", "string"), F.lit("")))
    return F.coalesce((F.size(types) > 0) & F.forall(types, lambda t: t.isin("thinking", "redacted_thinking")), F.lit(False))


def classify(records: DataFrame, connector: Connector) -> tuple[DataFrame, DataFrame]:
    """Records as events, and a diagnostic for each that its type drops or that has no rule.

    The rules are a map of the connector, looked up in each row.
    """
    c = connector
    joined = F.concat_ws(".", *[F.try_variant_get("record", p, "string") for p in c.discriminator])
    single = F.try_variant_get("record", c.discriminator[0], "string")
    rules = F.create_map(*[F.lit(x) for pair in c.rules.items() for x in pair])
    verdict = F.coalesce(F.element_at(rules, joined), F.element_at(rules, single))
    judged = records.withColumns({"discriminator": joined, "_kind": verdict})
    dropped = judged.where(F.col("_kind").isNull() | F.startswith("_kind", F.lit(DROP)))
    diagnostics = dropped.select("path", "line_no", F.when(F.col("_kind").isNull(), F.concat(F.lit("unknown_type:"), F.coalesce("discriminator", F.lit("")))).otherwise(F.col("_kind")).alias("name"), F.lit(None).cast("string").alias("message"))
    kept = judged.where(F.col("_kind").isNotNull() & ~F.startswith("_kind", F.lit(DROP)))
    header = F.first(_get(*c.session), ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if c.session else F.lit(None).cast("string")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^/.]+)?$", 1)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    native = F.coalesce(header, stem if c.glob.startswith("*") else folder)
    own_role = F.element_at(F.create_map(*[F.lit(x) for pair in c.roles.items() for x in pair]), F.col("discriminator")) if c.roles else F.lit(None).cast("string")
    kind_role = F.when(F.col("_kind") == "reasoning", "thinking").when(F.col("_kind") == "tool_result", "tool").when(F.col("_kind").isin("system", "lifecycle", "summary"), "system").when(F.col("_kind") == "tool_call", "assistant")
    role = F.coalesce(own_role, F.when(_get(*c.role).isin("user", "assistant", "system", "developer", "tool"), _get(*c.role)), kind_role, F.lit("unknown"))
    raw = _json(*c.content)
    text = event_text(F.when(~F.startswith(raw, F.lit("[")) & ~F.startswith(raw, F.lit("{")), _get(*c.content)), content_blocks(raw))
    is_call, is_result = F.col("_kind") == "tool_call", F.col("_kind") == "tool_result"
    tool = is_call | is_result
    lists = [listed_calls("record", c.call_list)] if c.call_list else [block_calls("record", c.call_blocks)] if c.call_blocks else []
    own = F.struct(
        _get(*c.call_id).alias("id"), _get(*c.tool_name).alias("name"), F.when(~is_result, F.coalesce(_get(*c.tool_input), _json(*c.tool_input))).alias("input"), F.when(is_result, F.coalesce(_get(*c.tool_output), _json(*c.tool_output))).alias("output"), is_result.alias("is_result")
    )
    single = F.when(tool & _get(*c.call_id).isNotNull(), F.array(own)).otherwise(F.array()).cast(f"array<{CALL}>")
    calls = F.concat(single, *lists)
    last = F.try_element_at("calls", F.lit(-1))
    if c.call_blocks:  # what a message carries says what it is
        blocks_kind = F.when(F.exists("calls", lambda x: ~x["is_result"]), "tool_call").when(F.size("calls") > 0, "tool_result").when(only_thinking("record", c.call_blocks), "reasoning")
        refined = F.when(F.col("_kind") == "message", F.coalesce(blocks_kind, F.col("_kind"))).otherwise(F.col("_kind"))
    else:
        refined = F.col("_kind")
    events = kept.withColumns({"_native": native, "calls": calls}).select(
        F.lit(c.provider).alias("provider"), "path", fingerprint(F.col("size"), F.col("modified")).alias("fingerprint"), F.col("_native").alias("native_session_id"), session_id(c.provider, F.col("_native")).alias("session_id"),
        F.col("record_no").cast("long").alias("record_no"), "discriminator", refined.alias("kind"), role.alias("role"), _get(*c.time).alias("timestamp"), text.alias("content_text"),
        last["id"].alias("tool_call_id"), F.coalesce(last["name"], F.when(tool, _get(*c.tool_name))).alias("tool_name"), F.coalesce(last["input"], F.when(is_call, F.coalesce(_get(*c.tool_input), _json(*c.tool_input)))).alias("tool_input"), F.coalesce(last["output"], F.when(is_result, F.coalesce(_get(*c.tool_output), _json(*c.tool_output)))).alias("tool_output"),
        _get(*c.event_id).alias("native_event_id"), _get(*c.parent_id).alias("parent_event_id"), _get(*c.cwd).alias("cwd"), _get(*c.model).alias("model"), "calls",
    )
    return events, diagnostics


def read_source(spark: SparkSession, provider: str, root: str, paths: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The events of a JSONL source below ``root`` and its diagnostics; hostile lines and files cost themselves only."""
    c = CONNECTORS[provider]
    good, bad = parse_lines(read_lines(spark, root, c.glob, paths))
    events, dropped = classify(good, c)
    return events, bad.unionByName(dropped)


def terminal_responses(events: DataFrame) -> DataFrame:
    """Events of a source that answers in steps: of each turn's responses only the last before the next input stays a message."""
    turn = F.sum((F.col("discriminator") == "USER_INPUT").cast("int")).over(Window.partitionBy("session_id").orderBy("record_no"))
    numbered = events.withColumn("_turn", turn)
    is_response = F.col("discriminator") == "PLANNER_RESPONSE"
    last = F.max(F.when(is_response, F.col("record_no"))).over(Window.partitionBy("session_id", "_turn"))
    kind = F.when(is_response & (F.col("record_no") != last), F.when(F.col("tool_name").isNotNull() & (F.col("tool_input").isNotNull()), "tool_call").otherwise("lifecycle")).otherwise(F.col("kind"))
    return numbered.withColumn("kind", kind).drop("_turn")


def merged_calls(events: DataFrame) -> DataFrame:
    """``session_id, tool_call_id, tool_name, tool_input, tool_output, status, first_record, started_at, completed_at``: the carriers of a call as one row.

    An event may carry several calls and results; every one counts. Name and input are those of the first call
    that has them, the output is the last result's.
    """
    each = events.select("session_id", "record_no", "timestamp", F.posexplode("calls").alias("_place", "_call")).select("session_id", "timestamp", F.struct("record_no", F.col("_place").alias("place")).alias("_at"), F.col("_call.id").alias("tool_call_id"), "_call.*")
    first = lambda c, also: F.min_by(c, F.when(F.col(c).isNotNull() & also, F.col("_at")))
    called, done = ~F.col("is_result"), F.col("is_result")
    return each.groupBy("session_id", "tool_call_id").agg(
        first("name", called).alias("tool_name"),
        first("input", called).alias("tool_input"),
        F.max_by("output", F.when(F.col("output").isNotNull(), F.col("_at"))).alias("tool_output"),
        F.when(F.bool_or("is_result"), "completed").otherwise("started").alias("status"),
        F.min("_at")["record_no"].alias("first_record"),
        first("timestamp", called).alias("started_at"),
        F.max_by("timestamp", F.when(done & F.col("timestamp").isNotNull(), F.col("_at"))).alias("completed_at"),
    )


def read_opencode(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Events of a part-based SQLite source; parts of a mebibyte or more are diagnosed and left out."""
    glob, sql, schema = SQLITE["opencode"]
    rows = read_sqlite(spark, root, glob, sql, schema)
    bad = rows.where(F.col("error").isNotNull()).select("path", F.lit(0).alias("line_no"), F.lit("corrupt_database").alias("name"), F.col("error").alias("message"))
    large = rows.where(F.col("bytes") >= GARBAGE_BYTES).select("path", F.lit(0).alias("line_no"), F.lit("oversized_part").alias("name"), F.col("native_event_id").alias("message"))
    part, message = F.try_parse_json("part"), F.try_parse_json("message")
    get = lambda v, p: F.try_variant_get(v, p, "string")
    kind = F.when(get(part, "$.type") == "text", "message").when(get(part, "$.type") == "reasoning", "reasoning").when((get(part, "$.type") == "tool") & get(part, "$.state.status").isin("completed", "error"), "tool_result").when(get(part, "$.type") == "tool", "tool_call").when(get(part, "$.type") == "patch", "edit")
    kept = rows.where(F.col("error").isNull() & (F.col("bytes") < GARBAGE_BYTES)).withColumn("kind", kind).where(F.col("kind").isNotNull())
    place = F.row_number().over(Window.partitionBy("path", "native_session_id").orderBy("time_created", "native_event_id"))
    events = kept.select(
        F.lit("opencode").alias("provider"), "path", F.lit(None).cast("string").alias("fingerprint"), "native_session_id", session_id("opencode", F.col("native_session_id")).alias("session_id"), place.cast("long").alias("record_no"), get(part, "$.type").alias("discriminator"), "kind",
        F.when(F.col("kind") == "reasoning", "thinking").when(F.col("kind").isin("tool_result", "tool_call"), "assistant").otherwise(get(message, "$.role")).alias("role"), F.col("time_created").cast("string").alias("timestamp"), get(part, "$.text").alias("content_text"),
        get(part, "$.callID").alias("tool_call_id"), get(part, "$.tool").alias("tool_name"), F.to_json(F.try_variant_get(part, "$.state.input", "variant")).alias("tool_input"), get(part, "$.state.output").alias("tool_output"), "native_event_id", F.col("message_id").alias("parent_event_id"), F.col("directory").alias("cwd"), get(message, "$.modelID").alias("model"),
    )
    whole = F.array(*[F.struct(F.col("tool_call_id").alias("id"), F.col("tool_name").alias("name"), F.col("tool_input").alias("input"), output.alias("output"), F.lit(result).alias("is_result")) for output, result in ((F.lit(None).cast("string"), False), (F.col("tool_output"), True))])
    # a part holds call and result in one
    held = F.when(F.col("tool_call_id").isNull(), F.array()).when(F.col("kind") == "tool_result", whole).otherwise(F.slice(whole, 1, 1))
    return events.withColumn("calls", held.cast(f"array<{CALL}>")), bad.unionByName(large)


def read_hermes(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Events of a message-based SQLite source with epoch seconds; markers and empty turns are diagnosed."""
    glob, sql, schema = SQLITE["hermes"]
    rows = read_sqlite(spark, root, glob, sql, schema)
    bad = rows.where(F.col("error").isNotNull()).select("path", F.lit(0).alias("line_no"), F.lit("corrupt_database").alias("name"), F.col("error").alias("message"))
    there = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    kind = F.when((F.col("role") == "tool") | there("tool_call_id"), "tool_result").when((F.col("role") == "assistant") & there("tool_calls") & (F.col("tool_calls") != "[]"), "tool_call").when(F.col("role").isin("user", "assistant") & there("content"), "message")
    judged = rows.where(F.col("error").isNull()).withColumn("kind", kind)
    empty = judged.where(F.col("kind").isNull()).select("path", F.lit(0).alias("line_no"), F.concat(F.lit("drop:"), F.coalesce("role", F.lit("unknown"))).alias("name"), F.col("native_event_id").alias("message"))
    place = F.row_number().over(Window.partitionBy("path", "native_session_id").orderBy("timestamp", "native_event_id"))
    own = F.struct(F.col("tool_call_id").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("input"), F.col("content").alias("output"), F.lit(True).alias("is_result"))
    result = F.when((F.col("kind") == "tool_result") & there("tool_call_id"), F.array(own)).otherwise(F.array()).cast(f"array<{CALL}>")
    listed = F.when(F.col("kind") == "tool_call", listed_calls(F.try_parse_json("tool_calls"), "$")).otherwise(F.array().cast(f"array<{CALL}>"))
    last = F.try_element_at("calls", F.lit(-1))
    placed = judged.where(F.col("kind").isNotNull()).withColumn("record_no", place.cast("long")).withColumn("calls", F.concat(result, listed))
    events = placed.select(
        F.lit("hermes").alias("provider"), "path", F.lit(None).cast("string").alias("fingerprint"), "native_session_id", session_id("hermes", F.col("native_session_id")).alias("session_id"), "record_no", F.col("role").alias("discriminator"), "kind", F.when(F.col("kind") == "tool_result", "tool").otherwise(F.col("role")).alias("role"),
        F.date_format(F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.when(F.col("kind") != "tool_result", F.col("content")).alias("content_text"), F.coalesce("tool_call_id", last["id"]).alias("tool_call_id"), F.coalesce("tool_name", last["name"]).alias("tool_name"), last["input"].alias("tool_input"),
        F.when(F.col("kind") == "tool_result", F.col("content")).alias("tool_output"), "native_event_id", F.lit(None).cast("string").alias("parent_event_id"), F.lit(None).cast("string").alias("cwd"), "model", "calls",
    )
    return events, bad.unionByName(empty)


def node_chains(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """``native_session_id, node_id, depth`` of each head's ancestry, the root first at depth 0; a session with a cycle or a missing parent gives no row."""
    from sessionlake.operators.lineage import hierarchy, links

    key = lambda s, n: F.concat_ws("\u0001", s, n.cast("string"))
    tree = hierarchy(links(nodes.select(key(F.col("native_session_id"), F.col("node_id")).alias("session_id"), F.when(F.col("parent_node_id").isNotNull(), key(F.col("native_session_id"), F.col("parent_node_id"))).alias("parent_session_id")), version=None))
    wanted = heads.select(key(F.col("native_session_id"), F.col("node_id")).alias("id"))
    complete = nodes.where(F.col("parent_node_id").isNull()).select(key(F.col("native_session_id"), F.col("node_id")).alias("root"))
    chain = tree.where(F.col("depth") >= 0).join(wanted, "id", "left_semi").join(complete, "root", "left_semi").select(F.posexplode("path").alias("depth", "_node"))
    return chain.select(F.split("_node", "\u0001")[0].alias("native_session_id"), F.split("_node", "\u0001")[1].cast("long").alias("node_id"), "depth")


#: How injected wrappers begin; a message that is one is no turn of the user.
WRAPPERS = ("<environment_context", "<user_instructions", "<turn_aborted", "<ide_context", "<skill>", "<subagent_notification", "<goal_context", "<codex_internal_context", "<proposed_plan", "<collaboration_mode", "<personality_spec", "<model_switch", "<app-context", "# AGENTS.md instructions")
INSTRUCTIONS = r"^<[a-z][a-z0-9_-]*[_ ]instructions>"


def mark_preambles(events: DataFrame) -> DataFrame:
    """Events whose messages that begin like an injected wrapper have the kind ``preamble``; their role stays."""
    said = F.ltrim(F.coalesce("content_text", F.lit("")))
    wrapped = said.rlike(INSTRUCTIONS)
    for w in WRAPPERS:
        wrapped = wrapped | F.startswith(said, F.lit(w))
    return events.withColumn("kind", F.when((F.col("kind") == "message") & wrapped, "preamble").otherwise(F.col("kind")))


def without_hidden_reasoning(events: DataFrame) -> DataFrame:
    """Events without reasoning that has no readable text (encrypted by its source)."""
    return events.where((F.col("kind") != "reasoning") | (F.trim(F.coalesce("content_text", F.lit(""))) != ""))


def usage_of(events: DataFrame, records: DataFrame) -> DataFrame:
    """``session_id, record_no, input_tokens, output_tokens, total_tokens`` of usage events, from the names the sources give them.

    ``records`` has the parsed record of each (path, record_no). A missing total is the sum of the parts.
    """
    number = lambda *paths: F.coalesce(*[F.try_variant_get("record", p, "bigint") for p in paths])
    prefix = ("$.payload.info.last_token_usage", "$.payload.info.total_token_usage", "$.message.usage", "$.usage", "$")
    pick = lambda *names: number(*[f"{p}.{n}" for p in prefix for n in names])
    joined = events.where(F.col("kind") == "usage").select("session_id", "path", "record_no").join(records.select("path", F.col("record_no").cast("long").alias("record_no"), "record"), ["path", "record_no"])
    counted = joined.select("session_id", "record_no", pick("input_tokens", "inputTokens", "prompt_tokens").alias("input_tokens"), pick("output_tokens", "outputTokens", "completion_tokens").alias("output_tokens"), pick("total_tokens", "totalTokens").alias("_total"))
    parts = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return counted.select("session_id", "record_no", "input_tokens", "output_tokens", F.coalesce("_total", F.when(F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull(), parts)).alias("total_tokens"))


def read_cursor(spark: SparkSession, root: str, root_field: int = 1) -> DataFrame:
    """``path, position, message, complete`` of a content-addressed source: the root blob's references, in order, with the messages they name.

    ``complete`` says whether every reference of the database was found. A blob that is no JSON has a null message.
    """
    from sessionlake.sources.files import blob_references

    glob, sql, schema = SQLITE["cursor"]
    blobs = read_sqlite(spark, root, glob, sql, schema).where(F.col("error").isNull())
    parsed = blobs.withColumn("_refs", blob_references(F.col("data")))
    named = parsed.where(F.size("_refs") > 0).select("path", "blob_id", F.posexplode("_refs").alias("position", "_ref"))
    held = blobs.select("path", F.lower("blob_id").alias("_hash"), F.try_parse_json(F.decode("data", "UTF-8")).alias("_message"))
    joined = named.where(F.col("_ref.field") == root_field).join(held, (named["path"] == held["path"]) & (F.col("_ref.hash") == F.col("_hash")), "left").select(named["path"], "blob_id", "position", F.to_json("_message").alias("message"), F.col("_hash").isNotNull().alias("_found"))
    whole = F.min("_found").over(Window.partitionBy("path", "blob_id"))
    return joined.withColumn("complete", whole).select("path", "position", "message", "complete")


def read_threads(spark: SparkSession, root: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Events of exported thread documents ({id, title, messages: [{role, content}]}), and a diagnostic for each file that is none."""
    from sessionlake.sources.files import read_documents

    documents, bad = read_documents(spark, root, glob)
    thread = F.coalesce(F.try_variant_get("record", "$.id", "string"), F.regexp_extract("path", r"([^/]+?)\.json$", 1))
    messages = documents.select("path", fingerprint(F.col("size"), F.col("modified")).alias("fingerprint"), thread.alias("native_session_id"), F.posexplode(F.try_variant_get("record", "$.messages", "array<variant>")).alias("_p", "record"))
    content = _json("$.content")
    blocks = content_blocks(content)
    shaped = messages.withColumns({"calls": block_calls("record", "$.content"), "_text": event_text(F.when(~F.startswith(content, F.lit("[")), _get("$.content")), blocks)})
    kind = F.when(F.exists("calls", lambda x: ~x["is_result"]), "tool_call").when(F.size("calls") > 0, "tool_result").otherwise("message")
    last = F.try_element_at("calls", F.lit(-1))
    events = shaped.select(
        F.lit("amp").alias("provider"), "path", "fingerprint", "native_session_id", session_id("amp", F.col("native_session_id")).alias("session_id"), (F.col("_p") + 1).cast("long").alias("record_no"), _get("$.role").alias("discriminator"), kind.alias("kind"),
        F.coalesce(_get("$.role"), F.lit("unknown")).alias("role"), _get("$.meta.sentAt", "$.timestamp").alias("timestamp"), F.col("_text").alias("content_text"), last["id"].alias("tool_call_id"), last["name"].alias("tool_name"), last["input"].alias("tool_input"),
        last["output"].alias("tool_output"), _get("$.messageId").alias("native_event_id"), F.lit(None).cast("string").alias("parent_event_id"), F.lit(None).cast("string").alias("cwd"), _get("$.usage.model").alias("model"), "calls",
    )
    return events, bad
