"""Files of session histories as rows: lines with their numbers, JSON documents, SQLite tables, diagnostics."""

from __future__ import annotations

import os
import sqlite3
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ABOUT = ("_metadata.file_path as path", "_metadata.file_size as size", "_metadata.file_modification_time as modified")


def fingerprint(size: Column, modified: Column) -> Column:
    """A file's fingerprint: its size and time of change in milliseconds, as JSON."""
    return F.to_json(F.struct(size.cast("long").alias("size"), F.unix_millis(modified).alias("mtimeMs")))


def list_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``path, size, modified`` of the files below ``root`` whose name matches, without reading them; empty files hold no session and are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_lines(spark: SparkSession, root: str, glob: str = "*.jsonl", paths: list[str] | None = None) -> DataFrame:
    """``path, size, modified, line_no, line`` of the lines that are not blank, numbered from 1.

    A session's file is one record until its lines are exploded: numbering needs the whole file, and such
    files hold one session each. ``paths`` reads only those files (what a stat gate let through).
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    text = reader.text(paths, wholetext=True) if paths else reader.option("pathGlobFilter", glob).text(root, wholetext=True)
    files = text.selectExpr("value", *_ABOUT)
    lines = files.select("path", "size", "modified", F.posexplode(F.split("value", "\r\n|\n")).alias("_p", "line"))
    return lines.where(F.trim("line") != "").select("path", "size", "modified", (F.col("_p") + 1).alias("line_no"), "line")


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines that are JSON objects, with ``record`` as a variant and ``record_no`` in the file; and a diagnostic for each other line.

    A bad line costs itself only. The last line of a file that does not parse is called torn.
    """
    from pyspark.sql import Window

    parsed = lines.withColumn("record", F.try_parse_json("line"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("record"), F.lit("OBJECT")), F.lit(False))
    judged = parsed.withColumn("_object", is_object)
    by_file = Window.partitionBy("path").orderBy("line_no")
    good = judged.where("_object").withColumn("record_no", F.row_number().over(by_file)).drop("_object")
    last = F.max("line_no").over(Window.partitionBy("path"))
    bad = judged.withColumn("_last", last).where(~F.col("_object"))
    name = F.when(F.col("record").isNotNull(), "not_an_object").when(F.col("line_no") == F.col("_last"), "torn_line").otherwise("invalid_json")
    return good, bad.select("path", "line_no", name.alias("name"), F.substring("line", 1, 200).alias("message"))


def read_documents(spark: SparkSession, root: str, glob: str) -> tuple[DataFrame, DataFrame]:
    """Whole JSON files: ``path, size, modified, record``, and a diagnostic for each that is none."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    parsed = text.selectExpr("value", *_ABOUT).withColumn("record", F.try_parse_json("value"))
    bad = parsed.where(F.col("record").isNull()).select("path", F.lit(0).alias("line_no"), F.lit("invalid_json").alias("name"), F.substring("value", 1, 200).alias("message"))
    return parsed.where(F.col("record").isNotNull()).drop("value"), bad


def read_sqlite(spark: SparkSession, root: str, glob: str, query: str, schema: str) -> DataFrame:
    """The rows of ``query`` in each SQLite file below ``root``, with its ``path``; a file that is none gives a row of ``error`` only.

    A task copies the file it was given, with the write-ahead log beside it where there is one, and reads the
    copy, so the rows of a database in use that its main file does not have yet are read too. Values are read as
    text or bytes, as ``schema`` (DDL of the query's columns) says.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{glob},{glob}-wal}}").load(root)
    is_log = F.endswith("path", F.lit("-wal"))
    files = found.groupBy(F.regexp_replace("path", "-wal$", "").alias("path")).agg(F.first(F.when(~is_log, F.col("content")), ignorenulls=True).alias("content"), F.first(F.when(is_log, F.col("content")), ignorenulls=True).alias("log")).where(F.col("content").isNotNull())
    from pyspark.sql import types as T

    wanted = T._parse_datatype_string(schema)
    names = wanted.fieldNames()

    def run(batches):
        for pdf in batches:
            for path, content, log in zip(pdf["path"], pdf["content"], pdf["log"]):
                with tempfile.TemporaryDirectory() as folder:
                    copy = os.path.join(folder, "copy.db")
                    with open(copy, "wb") as f:
                        f.write(content)
                    if log:
                        with open(f"{copy}-wal", "wb") as f:
                            f.write(log)
                    try:
                        connection = sqlite3.connect(f"file:{copy}" if log else f"file:{copy}?immutable=1", uri=True)
                        try:
                            cursor = connection.execute(query)
                            while rows := cursor.fetchmany(5000):
                                out = pd.DataFrame(rows, columns=names)
                                yield out.assign(path=path, error=None)[["path", "error", *names]]
                        finally:
                            connection.close()
                    except sqlite3.Error as e:
                        yield pd.DataFrame([[path, str(e), *[None] * len(names)]], columns=["path", "error", *names])

    return files.mapInPandas(run, T.StructType([T.StructField("path", T.StringType()), T.StructField("error", T.StringType()), *wanted.fields]))


def wire_fields(data: bytes) -> list[tuple[int, int, int | bytes]]:
    """Number, wire type and value of each field of a protobuf message; a ValueError where it breaks off."""
    out: list[tuple[int, int, int | bytes]] = []
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while at < len(data) and shift < 64:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7
        raise ValueError("a number breaks off")

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if number == 0:
            raise ValueError("field 0")
        if kind == 0:
            out.append((number, kind, varint()))
            continue
        size = {1: 8, 5: 4}.get(kind) or (varint() if kind == 2 else -1)
        if size < 0 or at + size > len(data):
            raise ValueError(f"field {number} of type {kind} breaks off")
        out.append((number, kind, data[at : at + size]))
        at += size
    return out


def blob_references(data: Column) -> Column:
    """``array<struct<field,hash>>``: the 32-byte references of a root blob, as hexadecimal text; null for a broken one."""

    @F.pandas_udf("array<struct<field:int,hash:string>>")
    def references(values: pd.Series) -> pd.Series:
        def one(b: bytes | None):
            try:
                return None if b is None else [{"field": n, "hash": v.hex()} for n, kind, v in wire_fields(bytes(b)) if kind == 2 and len(v) == 32]
            except ValueError:
                return None

        return values.map(one)

    return references(data)
