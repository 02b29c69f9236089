"""The queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.operators.store import Store
from sessionlake.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def _provider(session: str = "session_id"):
    return F.substring_index(F.col(session), ":", 1)


# ---- 1: splitting oversized items


def _pieces(messages: DataFrame, limits: DataFrame) -> DataFrame:
    """The messages as pieces; a message is known by session, event id and seq, so that those without event id stay apart."""
    from .split import split_oversized

    known = messages.select(F.struct("session_id", "event_id", "seq").alias("_of"), "session_id", "text").withColumn("provider", _provider()).join(limits, "provider", "left")
    return split_oversized(known, "_of", "text", "max_chars", "overlap_chars").select("_of.*", F.col("*")).drop("_of")


def _limits(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "split_limits").select("provider", "max_chars", "overlap_chars")


def p1_pieces(spark: SparkSession, base: str) -> DataFrame:
    """All messages as pieces within the limit of their provider."""
    return _pieces(Store(spark, base).rows("messages", "text"), _limits(spark, base))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """The messages that come out as more than one piece."""
    from .split import split_oversized

    messages = table(spark, base, "messages").select("event_id", "session_id", "text")
    bounded = messages.withColumn("provider", _provider()).join(_limits(spark, base), "provider", "left")
    pieces = split_oversized(bounded, "event_id", "text", "max_chars", "overlap_chars")
    return pieces.where(F.col("n_pieces") > 1).select("event_id").distinct()


def p1_cuts(spark: SparkSession, base: str) -> DataFrame:
    """How many cuts fall on a boundary of each strength."""
    return p1_pieces(spark, base).where(F.col("boundary") != "end").groupBy("boundary").agg(F.count("*").alias("n_cuts"))


def p1_rebuilt(spark: SparkSession, base: str) -> DataFrame:
    """Each message put together again from its pieces without what they share, with its number of pieces above the limit: equal to the stored one."""
    pieces = p1_pieces(spark, base).withColumn("provider", _provider()).join(_limits(spark, base), "provider", "left")
    shared = F.least(F.coalesce("overlap_chars", F.lit(0)), F.col("max_chars") - 1)
    own = F.when(F.col("piece_no") == 1, F.col("piece_text")).otherwise(F.substr(F.col("piece_text"), shared + 1))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", own.alias("own")))), lambda p: p["own"]), "")
    over = F.sum((F.length("piece_text") > F.col("max_chars")).cast("long"))
    return pieces.groupBy("session_id", "event_id", "seq").agg(F.md5(whole).alias("text_md5"), F.coalesce(over, F.lit(0)).alias("n_oversized")).select("session_id", "event_id", "seq", "text_md5", "n_oversized")


# ---- 3: credentials


def _texts(spark: SparkSession, base: str, find: Callable[[DataFrame, str, list[str]], DataFrame], calls: list[str]) -> DataFrame:
    """The findings in messages.text and the named fields of tool_calls, with their source table."""
    messages = find(table(spark, base, "messages"), "event_id", ["text"])
    tools = find(table(spark, base, "tool_calls"), "id", calls)
    return messages.withColumn("source_table", F.lit("messages")).unionByName(tools.withColumn("source_table", F.lit("tool_calls")))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """The lines on which a credential begins."""
    from .secrets import find_secrets
    from .tokens import default_tokenizer

    found = _texts(spark, base, lambda df, key, fields: find_secrets(df, key, fields, default_tokenizer()), ["input_text", "output_text"])
    return found.select("source_table", "record_id", "field", "line_no").distinct()


def _rewritten(spark: SparkSession, base: str, change: Callable[[DataFrame, str, list[str]], DataFrame], calls: list[str]) -> DataFrame:
    """``source_table, record_id, field, text``: messages.text and the named fields of tool_calls after ``change``, one row per record and field."""
    store = Store(spark, base)
    messages = change(store.rows("messages", "text"), "event_id", ["text"])
    tools = change(store.rows("tool_calls", *calls), "id", calls)
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in calls])).alias("_f")
    each = tools.select(F.lit("tool_calls").alias("source_table"), F.col("id").alias("record_id"), fields).select("source_table", "record_id", "_f.field", "_f.text")
    return messages.select(F.lit("messages").alias("source_table"), F.col("event_id").alias("record_id"), F.lit("text").alias("field"), "text").unionByName(each)


def p3_redacted(spark: SparkSession, base: str) -> DataFrame:
    """The texts of the messages and of the tool calls with their credentials redacted, one row per record and field."""
    from .secrets import redact_secrets
    from .tokens import default_tokenizer

    return _rewritten(spark, base, lambda df, key, fields: redact_secrets(df, key, fields, default_tokenizer()), ["input_text", "output_text"])


# ---- 4: conversations


def _dialogue(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, base, "sessions"), table(spark, base, "messages"), table(spark, base, "tool_calls")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """The sessions to be dropped."""
    from .conversations import dropped_sessions, session_faults

    return dropped_sessions(session_faults(*_dialogue(spark, base)))


def p4_faults(spark: SparkSession, base: str) -> DataFrame:
    """Each session with its faults."""
    from .conversations import session_faults

    return session_faults(*_dialogue(spark, base))


def p4_turns(spark: SparkSession, base: str) -> DataFrame:
    """The turns of the sound conversations."""
    from .conversations import conversations

    return conversations(*_dialogue(spark, base))


def p4_matches(spark: SparkSession, base: str) -> DataFrame:
    """The sound conversations behind the search matches."""
    from .conversations import conversations, matched_conversations

    return matched_conversations(table(spark, base, "search_matches"), conversations(*_dialogue(spark, base))).select("search_id", "session_id", "turn_no", "event_id", "role")


# ---- 5: truncated outputs


def _outputs(spark: SparkSession, base: str) -> DataFrame:
    from .truncation import truncated_outputs

    return truncated_outputs(table(spark, base, "tool_calls"), "id", "provider", "tool_name", "output_text", "output_bytes", "input_text")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """The tool calls whose output was cut."""
    return _outputs(spark, base).where("is_cut").select("id")


def p5_evidence(spark: SparkSession, base: str) -> DataFrame:
    """How many cut outputs each combination of evidence stands for."""
    return _outputs(spark, base).where("is_cut").groupBy(F.array_join("evidence", "+").alias("evidence")).agg(F.count("*").alias("n_cut"))


def p5_limits(spark: SparkSession, base: str) -> DataFrame:
    """The size limits found from the hazards of the lengths."""
    from .truncation import found_limits, measured

    return found_limits(*measured(table(spark, base, "tool_calls"), "id", "provider", "tool_name", "output_text", "output_bytes", "input_text"), "provider")


def p5_rates(spark: SparkSession, base: str) -> DataFrame:
    """How often each provider and tool is cut."""
    from .truncation import truncation_rates

    return truncation_rates(_outputs(spark, base), "provider", "tool_name")


# ---- 6: similar vectors


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of a similarity of at least 0.90, each among the other's ten most similar."""
    from .neighbours import mutual_pairs, nearest_neighbours

    near = nearest_neighbours(table(spark, base, "message_vectors"), "vec_rowid", "model", "vector", k=10, least=0.90, every_member=False)
    return mutual_pairs(near, 0.90).select(F.col("id_a").alias("vec_rowid_a"), F.col("id_b").alias("vec_rowid_b"))


def p6_nearest(spark: SparkSession, base: str) -> DataFrame:
    """The ten most similar vectors of every vector whose id is divisible by 50, against all rows."""
    from .neighbours import nearest_neighbours

    return nearest_neighbours(table(spark, base, "message_vectors"), "vec_rowid", "model", "vector", k=10, enough=5000, share=0.1, queries_of=lambda i: i % 50 == 0)


# ---- 7: personal information


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """The kinds of personal information in each field."""
    from .pii import find_pii

    return _texts(spark, base, find_pii, ["output_text"]).select("source_table", "record_id", "field", "pii_type").distinct()


def p7_masked(spark: SparkSession, base: str) -> DataFrame:
    """The texts of the messages and the outputs of the tool calls with typed placeholders, one row per record and field."""
    from .pii import mask_pii

    return _rewritten(spark, base, mask_pii, ["output_text"])


# ---- 8: encoding


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    """The token ids of each document."""
    from .tokens import default_tokenizer, encode_corpus

    return encode_corpus(table(spark, base, "documents"), "doc_id", "text", default_tokenizer())


def p8_decoded(spark: SparkSession, base: str) -> DataFrame:
    """The documents after encoding and decoding; equal to the stored texts, null as empty."""
    from .tokens import decode_corpus, default_tokenizer, encode_corpus

    ids = encode_corpus(table(spark, base, "documents"), "doc_id", "text", default_tokenizer())
    return decode_corpus(ids, "doc_id", "ids", default_tokenizer())


# ---- 9: packing


def _packed(spark: SparkSession, base: str) -> tuple[DataFrame, dict[int, int]]:
    from .packing import pack
    from .tokens import default_tokenizer, token_counts

    capacities = {r[0]: r[1] for r in table(spark, base, "pack_limits").select("pack_id", "capacity_tokens").collect()}
    sizes = token_counts(table(spark, base, "documents"), "doc_id", "text", default_tokenizer())
    return pack(sizes, "doc_id", "n_tokens", capacities), capacities


def p9_containers(spark: SparkSession, base: str) -> DataFrame:
    """The container of each document, or of each piece of one above the capacity."""
    return _packed(spark, base)[0]


def p9_fill(spark: SparkSession, base: str) -> DataFrame:
    """How full the containers of each capacity are."""
    from .packing import container_fill

    return container_fill(*_packed(spark, base))


# ---- 10: languages


def _field(spark: SparkSession, base: str):
    from .language import train_from

    return train_from(table(spark, base, "lang_samples"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    """The languages of whole passages that a document's label does not name."""
    from .language import unlabelled_languages

    return unlabelled_languages(table(spark, base, "documents"), "doc_id", "text", "lang", _field(spark, base)).select("doc_id", "lang")


def p10_passages(spark: SparkSession, base: str) -> DataFrame:
    """The language of each passage, with its confidence."""
    from .language import passages

    return passages(table(spark, base, "documents"), "doc_id", "text", _field(spark, base))


def p10_segments(spark: SparkSession, base: str) -> DataFrame:
    """The runs of one language within each passage, with their confidence."""
    from .language import passage_segments

    return passage_segments(table(spark, base, "documents"), "doc_id", "text", _field(spark, base))


def p10_documents(spark: SparkSession, base: str) -> DataFrame:
    """The main language of each document, with its confidence; one row per document, short and empty ones included."""
    from .language import document_languages, passages, with_short_documents

    documents = table(spark, base, "documents")
    return with_short_documents(document_languages(passages(documents, "doc_id", "text", _field(spark, base)), "doc_id"), documents, "doc_id", "text")


QUERIES: dict[str, Query] = {q.__name__: q for q in (p1_found, p1_pieces, p1_cuts, p1_rebuilt, p3_found, p3_redacted, p4_found, p4_faults, p4_turns, p4_matches, p5_found, p5_rates, p5_evidence, p5_limits, p6_found, p6_nearest, p7_found, p7_masked, p8_ids, p8_decoded, p9_containers, p9_fill, p10_found, p10_passages, p10_segments, p10_documents)}
