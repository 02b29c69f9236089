"""Rebuilding conversations from message rows.

Message rows are an event log: each (session, event) may have been created, edited, retried or
deleted, and the row with the greatest version is what it finally says. Final turns are ordered by
seq and the sessions validated. Neither sorting nor validation puts a session into one task: rows are
cut into blocks of consecutive seq, each block is reduced by windows of its own, and the blocks of a
session, one row for thousands of messages, are put together by a second window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("user", "assistant", "reasoning")
#: seq numbers a block.
BLOCK = 4096

#: Java's class of Unicode white space, the no-break spaces included.
_VISIBLE = r"[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def is_blank(text: str | Column) -> Column:
    """Whether a text is null or only Unicode white space."""
    return ~F.coalesce(F.col(text).rlike(_VISIBLE) if isinstance(text, str) else text.rlike(_VISIBLE), F.lit(False))


def fold_events(messages: DataFrame, carried: list[str], version: str = "ingested_at", operation: str | None = None) -> DataFrame:
    """The final state of each (session_id, event_id): the columns ``carried`` of its newest row.

    Rows of equal version are equal re-deliveries; of others the greatest by content wins, so that the
    result does not depend on the order of rows. Where ``operation`` names a column, an event whose
    newest row says ``delete`` is gone. A null event id is an event of its own for each seq.
    """
    columns = [*carried, *([operation] if operation else [])]
    state = F.struct(F.coalesce(F.col(version).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("_version"), *[F.col(c) for c in columns])
    event = F.coalesce(F.col("event_id"), F.concat(F.lit("seq:"), F.col("seq").cast("string")))
    folded = messages.groupBy("session_id", event.alias("event_id")).agg(F.max(state).alias("_s"))
    out = folded.select("session_id", "event_id", *[F.col(f"_s.{c}").alias(c) for c in columns])
    return out.where(~F.col(operation).eqNullSafe(F.lit("delete"))).drop(operation) if operation else out


def _reply_gaps(turns: DataFrame) -> DataFrame:
    """``session_id`` of the sessions with a run of user messages that no assistant answers.

    ``turns`` has session_id, seq, cls: U a non-blank user, A a non-blank assistant, N any other
    message; blank user messages are left out.
    """
    blocked = turns.withColumn("_block", F.floor(F.col("seq") / F.lit(BLOCK)))
    back = Window.partitionBy("session_id", "_block").orderBy(F.desc("seq"), F.desc("cls"))
    said = F.when(F.col("cls") != "N", F.col("cls"))
    seen = blocked.withColumns(
        {
            "_next": F.lag("cls").over(back),
            "_answer": F.last(said, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
            "_rank": F.row_number().over(back),
        }
    )
    user = F.col("cls") == "U"
    summary = seen.groupBy("session_id", "_block").agg(
        F.max(F.coalesce(user & F.col("_next").isNotNull() & (F.col("_next") != "U") & (F.col("_answer") == "U"), F.lit(False))).alias("_gap"),
        F.max(user & (F.col("_rank") == 1)).alias("_last_is_user"),
        F.max(user & F.col("_next").isNotNull() & (F.col("_next") != "U") & F.col("_answer").isNull()).alias("_waits"),
        F.min_by("cls", F.struct("seq", "cls")).alias("_first"),
        F.min_by(said, F.when(said.isNotNull(), F.struct("seq", "cls"))).alias("_first_said"),
    )
    after = Window.partitionBy("session_id").orderBy(F.desc("_block"))
    joined = summary.withColumns({"_next_first": F.lag("_first").over(after), "_next_said": F.last("_first_said", ignorenulls=True).over(after.rowsBetween(Window.unboundedPreceding, -1))})
    unanswered = F.col("_next_said").isNull() | (F.col("_next_said") == "U")
    open_end = F.col("_last_is_user") & (F.col("_next_first").isNull() | (F.col("_next_first") != "U")) & unanswered
    return joined.where(F.col("_gap") | (F.col("_waits") & unanswered) | open_end).select("session_id").distinct()


def session_faults(sessions: DataFrame, messages: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """``session_id, no_dialogue, bad_role, bad_sequence, no_reply``, one row for each session id of ``sessions``.

    no_dialogue: no non-blank user or no non-blank assistant message; bad_role: a role outside ROLES,
    null included; bad_sequence: a seq is null, shared by two messages, or missing between 0 and the
    highest of messages and tool calls; no_reply: a run of user messages without an answer. Re-delivered
    rows count once; sessions without messages have no dialogue; null session ids give no row.
    """
    turns = fold_events(messages.where(F.col("session_id").isNotNull()).select("session_id", "event_id", "seq", "role", is_blank("text").alias("blank"), "ingested_at"), ["seq", "role", "blank"])
    said = ~F.col("blank")
    known = F.coalesce(F.col("role").isin(*ROLES), F.lit(False))
    counted = turns.select(
        "session_id",
        F.col("seq").cast("long").alias("seq"),
        F.lit(1).alias("is_message"),
        (said & F.col("role").eqNullSafe(F.lit("user"))).cast("int").alias("user"),
        (said & F.col("role").eqNullSafe(F.lit("assistant"))).cast("int").alias("assistant"),
        (~known).cast("int").alias("odd"),
    )
    calls = tool_calls.where(F.col("session_id").isNotNull()).select("session_id", F.col("seq").cast("long").alias("seq"), *[F.lit(0).alias(c) for c in ("is_message", "user", "assistant", "odd")])
    # first by (session, seq): a hot session is spread over its seq numbers and re-deliveries collapse
    slots = counted.unionByName(calls).groupBy("session_id", "seq").agg(F.sum("is_message").alias("n"), *[F.max(c).alias(c) for c in ("user", "assistant", "odd")])
    state = slots.groupBy("session_id").agg(
        F.max("user").alias("user"),
        F.max("assistant").alias("assistant"),
        F.max("odd").alias("odd"),
        F.max((F.col("n") > 1).cast("int")).alias("shared"),
        F.max(F.col("seq").isNull().cast("int")).alias("unplaced"),
        F.count("seq").alias("slots"),
        F.min("seq").alias("lowest"),
        F.max("seq").alias("highest"),
    )
    cls = F.when(said & (F.col("role") == "user"), "U").when(said & (F.col("role") == "assistant"), "A").otherwise("N")
    ordered = turns.where(F.col("seq").isNotNull() & ~(F.col("blank") & F.col("role").eqNullSafe(F.lit("user")))).select("session_id", "seq", cls.alias("cls"))
    gaps = _reply_gaps(ordered).select("session_id", F.lit(True).alias("no_reply"))
    ids = sessions.where(F.col("session_id").isNotNull()).select("session_id").distinct()
    holes = (F.col("lowest") != 0) | (F.col("slots") != F.col("highest") + 1) | (F.col("unplaced") == 1) | (F.col("shared") == 1)
    return (
        ids.join(state, "session_id", "left")
        .join(gaps, "session_id", "left")
        .select(
            "session_id",
            F.coalesce((F.col("user") == 0) | (F.col("assistant") == 0), F.lit(True)).alias("no_dialogue"),
            F.coalesce(F.col("odd") == 1, F.lit(False)).alias("bad_role"),
            F.coalesce(holes, F.lit(False)).alias("bad_sequence"),
            F.coalesce(F.col("no_reply"), F.lit(False)).alias("no_reply"),
        )
    )


def dropped_sessions(faults: DataFrame) -> DataFrame:
    """``session_id`` of the sessions with any fault."""
    return faults.where(F.col("no_dialogue") | F.col("bad_role") | F.col("bad_sequence") | F.col("no_reply")).select("session_id")


def conversations(sessions: DataFrame, messages: DataFrame, tool_calls: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """The turns of the sessions without fault: ``session_id, turn_no, seq, event_id, role, text``.

    turn_no counts from 1 by seq; blank messages are left out. A block numbers its own turns and is
    shifted by the turns of the blocks before it, so no session is sorted in one task.
    """
    faults = session_faults(sessions, messages, tool_calls) if faults is None else faults
    sound = faults.where(~(F.col("no_dialogue") | F.col("bad_role") | F.col("bad_sequence") | F.col("no_reply"))).select("session_id")
    turns = fold_events(messages, ["seq", "role", "text"]).where(~is_blank("text")).join(sound, "session_id", "left_semi")
    blocked = turns.withColumn("_block", F.floor(F.col("seq") / F.lit(BLOCK)))
    sizes = blocked.groupBy("session_id", "_block").count()
    before = F.sum("count").over(Window.partitionBy("session_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select("session_id", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("session_id", "_block").orderBy("seq", "event_id"))
    return blocked.withColumn("_own", own).join(shift, ["session_id", "_block"]).select("session_id", (F.col("_own") + F.col("_before")).cast("long").alias("turn_no"), "seq", "event_id", "role", "text")


def matched_conversations(matches: DataFrame, turns: DataFrame) -> DataFrame:
    """``search_id`` with the turns of the session of each of its matches; sessions without a sound conversation give no row."""
    wanted = matches.where(F.col("session_id").isNotNull()).select("search_id", "session_id").distinct()
    return turns.join(wanted, "session_id")
