"""Incremental ingest: new files of a source as a stream, merged into versioned tables batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionlake.operators.merge import VersionedTables
from sessionlake.operators.normalize import first_by_id
from sessionlake.runtime import checkpoint as checkpointed
from sessionlake.sources.connectors import CONNECTORS, classify
from sessionlake.sources.files import parse_lines

MESSAGES = ("session_id", "event_id", "seq", "role", "text", "ts")


def messages_of(events: DataFrame) -> DataFrame:
    """The messages among source events: their place in the file is their seq."""
    role = F.when(F.col("role").isin("user", "assistant"), F.col("role")).when(F.col("role") == "thinking", "reasoning")
    event = F.concat("session_id", F.lit(":event:"), F.col("record_no").cast("string"))
    rows = events.where(F.col("kind").isin("message", "reasoning")).select("session_id", event.alias("event_id"), F.col("record_no").alias("seq"), role.alias("role"), F.trim("content_text").alias("text"), F.col("timestamp").alias("ts"))
    return first_by_id(rows.where(F.col("role").isNotNull() & (F.col("text") != "")), "event_id", "seq").select(*MESSAGES)


def ingest_stream(spark: SparkSession, provider: str, root: str, tables: VersionedTables, checkpoint: str) -> StreamingQuery:
    """Read the files of a source that are new since the checkpoint and merge their sessions.

    Each batch replaces the sessions it has files of, and writes only the buckets that have them; the manifest is
    swapped once a batch, so a batch that is run again after a failure changes nothing. ``availableNow`` ends when the files are done.
    """
    c = CONNECTORS[provider]
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", c.glob).load(root)
    named = files.selectExpr("value", "_metadata.file_path as path", "_metadata.file_size as size", "_metadata.file_modification_time as modified")

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        lines = batch.select("path", "size", "modified", F.posexplode(F.split("value", "\r\n|\n")).alias("_p", "line")).where(F.trim("line") != "").withColumn("line_no", F.col("_p") + 1).drop("_p")
        good, _ = parse_lines(lines)
        incoming = checkpointed(messages_of(classify(good, c)[0]))
        tables.replace_sessions("messages", incoming)

    return named.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(spark: SparkSession, base: str, checkpoint: str, out: str) -> DataFrame:
    """Events by type and hour, counted by a stream that ends with its input.

    The whole table of counts is kept and written with each batch, so no event is too late for its hour and
    the result is that of the whole input; its size is that of the hours and types, not of the events.
    """
    schema = spark.read.parquet(f"{base}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(base)
    counted = stream.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col("w.start").alias("hour"), "event_type", "n_events", "total").write.mode("overwrite").parquet(out)

    counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
