"""Writing: row-level differences, upserts, enrichments, snapshots and ingest decisions.

Parquet has no update in place. A merge classifies rows by a full outer join, writes a new version of the
table beside the old one and then swaps a manifest that names the current versions, so readers see either
the old or the new snapshot.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionlake.runtime import Folder


class SnapshotError(RuntimeError):
    """The store is being written, or a snapshot is no longer the current one."""


def _changed(columns: list[str], old: str, new: str) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}")) for c in columns], F.lit(False))


def diff(stored: DataFrame, incoming: DataFrame, keys: list[str], scope: list[str], columns: list[str]) -> DataFrame:
    """``keys, change``: insert, update, unchanged or delete for each row of either side.

    Only rows in the scopes of ``incoming`` (sessions that were sent) can be deleted; other stored rows are
    left out. Columns are compared with nulls equal. Repeated keys must have been removed before.
    """
    sent = incoming.select(*scope).distinct()
    old = stored.join(sent, scope, "left_semi").select(*keys, *[c for c in columns if c not in keys], F.lit(True).alias("_there")).alias("o")
    new = incoming.select(*keys, *[c for c in columns if c not in keys], F.lit(True).alias("_there")).alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys])
    compared = [c for c in columns if c not in keys]
    change = F.when(F.col("o._there").isNull(), "insert").when(F.col("n._there").isNull(), "delete").when(_changed(compared, "o", "n"), "update").otherwise("unchanged")
    return old.join(new, on, "full_outer").select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], change.alias("change"))


#: What tells the rows of a fact table apart, and the columns whose change is an update.
FACTS = {
    "session_events": ("sequence", "fact_hash"),
    "usage_records": ("order_index", "fact_hash"),
    "session_edges": ("order_index", "fact_hash"),
    "session_artifacts": ("order_index", "fact_hash"),
    "execution_contexts": ("sequence", "fact_hash"),
}


def diff_facts(name: str, stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``session_id, id, change`` of one of the five fact tables; a fact is changed where its place or its hash is."""
    return diff(stored, incoming, ["session_id", "id"], ["session_id"], list(FACTS[name]))


def apply_diff(stored: DataFrame, incoming: DataFrame, scope: list[str]) -> DataFrame:
    """The table after ``incoming`` has replaced the rows of the scopes it sends."""
    return stored.join(incoming.select(*scope).distinct(), scope, "left_anti").unionByName(incoming, allowMissingColumns=True)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The rows of both, for each key the one of the greatest ``version``; of equal ones the incoming row."""
    columns = stored.columns
    both = stored.withColumn("_side", F.lit(0)).unionByName(incoming.select(*columns).withColumn("_side", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(version), F.col("_side")))
    return both.groupBy(*keys).agg(newest.alias("_r")).select(*[F.col(k) if k in keys else F.col(f"_r.{k}").alias(k) for k in columns])


def upsert_vectors(stored: DataFrame, incoming: DataFrame, messages: DataFrame, now: str) -> DataFrame:
    """Vectors after an upsert: only of messages that still say the same, with the first time of creation kept."""
    live = incoming.join(messages.select("session_id", "seq", "role", "content_hash"), ["session_id", "seq", "role", "content_hash"], "left_semi")
    keys = ["model", "session_id", "seq"]
    first = stored.select(*keys, F.col("created_at").alias("_first"))
    stamped = live.join(first, keys, "left").withColumn("created_at", F.coalesce("_first", F.lit(now))).withColumn("updated_at", F.lit(now)).drop("_first")
    return stored.join(live.select(*keys), keys, "left_anti").unionByName(stamped, allowMissingColumns=True)


ENRICHMENT = ["protocol_version", "schema_version", "producer", "input_hash", "payload_json"]


def enrich(stored: DataFrame, incoming: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Enrichments after an upsert, and ``session_id, namespace, outcome`` of each incoming one.

    One of an absent session is rejected, one equal to the stored row changes nothing, time included.
    """
    keys = ["session_id", "namespace"]
    old = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in ENRICHMENT], F.lit(True).alias("_there"))
    here = sessions.select("session_id").distinct().withColumn("_session", F.lit(True))
    judged = incoming.join(here, "session_id", "left").join(old, keys, "left")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ENRICHMENT])
    outcome = F.when(F.col("_session").isNull(), "rejected").when(F.col("_there").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    judged = judged.withColumn("outcome", outcome)
    written = judged.where(F.col("outcome").isin("inserted", "updated")).select(*incoming.columns)
    merged = stored.join(written.select(*keys), keys, "left_anti").unionByName(written, allowMissingColumns=True)
    return merged, judged.select(*keys, "outcome")


def to_ingest(incoming: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Incoming sessions that need work: new, or with another fingerprint or normalization version; all with ``force``."""
    if force:
        return incoming
    same = ["session_id", "source_fingerprint", "normalization_version"]
    return incoming.join(stored.select(*same), same, "left_anti")


def to_read(files: DataFrame, manifest: DataFrame, normalization_version: int) -> DataFrame:
    """Files (path, size, modified) that the manifest does not know in this state and version."""
    known = manifest.where(F.col("normalization_version") == normalization_version).select("path", "size", "modified")
    return files.join(known, ["path", "size", "modified"], "left_anti")


class VersionedTables:
    """Parquet tables below a folder, of which a manifest names the current versions.

    The folder may be on any file system Spark can write. One writer at a time: ``begin`` marks the manifest as
    being written, ``commit`` swaps in the new versions in one rename. The snapshot id changes with every commit.
    A table may be kept in buckets of its sessions; then only those are written that a change touches.
    """

    MANIFEST = "manifest.json"

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.files = Folder(spark, self.folder)

    def _read(self) -> dict:
        if not self.files.has(self.MANIFEST):
            return {"corpus": uuid.uuid4().hex, "revision": 0, "writing": False, "tables": {}}
        return json.loads(self.files.read(self.MANIFEST))

    def _write(self, manifest: dict) -> None:
        self.files.write(self.MANIFEST, json.dumps(manifest))

    def snapshot(self) -> str:
        """The id of the current snapshot; an error while it is being written."""
        m = self._read()
        if m["writing"]:
            raise SnapshotError("busy")
        return f"{m['corpus']}:{m['revision']}"

    def check(self, snapshot: str) -> None:
        """An error where ``snapshot`` is no longer the current one."""
        if self.snapshot() != snapshot:
            raise SnapshotError("expired")

    def read(self, name: str) -> DataFrame:
        """The current version of a table."""
        held = self._read()["tables"][name]
        return self.spark.read.parquet(held) if isinstance(held, str) else self._bucketed(held)

    def _bucketed(self, held: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(held["schema"]))).parquet(*sorted(held["buckets"].values()))

    def has(self, name: str) -> bool:
        return name in self._read()["tables"]

    def begin(self) -> dict:
        m = self._read()
        if m["writing"]:
            raise SnapshotError("busy")
        self._write({**m, "writing": True})
        return m

    def _place(self, m: dict, name: str) -> str:
        return f"{self.folder}/{name}-{m['revision'] + 1}-{uuid.uuid4().hex[:8]}"

    def commit(self, tables: dict[str, DataFrame]) -> str:
        """Write new versions of ``tables`` and make them current; on failure the old snapshot stays."""

        def write(m: dict) -> dict:
            paths = {}
            for name, df in tables.items():
                paths[name] = self._place(m, name)
                df.write.parquet(paths[name])
            return paths

        return self._committed(write)

    def _committed(self, write) -> str:
        m = self.begin()
        try:
            paths = write(m)
        except BaseException:
            self._write(m)
            raise
        self._write({**m, "revision": m["revision"] + 1, "tables": {**m["tables"], **paths}})
        return self.snapshot()

    def replace_sessions(self, name: str, incoming: DataFrame, scope: str = "session_id") -> str | None:
        """Make ``incoming`` the rows of the sessions it sends; None where it changes nothing.

        The table is kept in buckets by a hash of the session. The buckets of the sessions that changed are
        read, merged and written; all others stay the files they are.
        """
        bucket = F.pmod(F.xxhash64(scope), F.lit(self.buckets)).cast("int")
        held = self._read()["tables"].get(name) or {"schema": incoming.schema.json(), "buckets": {}}
        sent = {str(r[0]) for r in incoming.select(bucket).distinct().collect()}  # at most a row for each bucket
        stored = {b: path for b, path in held["buckets"].items() if b in sent}
        columns = incoming.columns
        rows = incoming
        if stored:
            old = self._bucketed({**held, "buckets": stored})
            both = old.join(incoming.select(scope).distinct(), scope, "left_semi").select(*columns)
            differing = both.withColumn("_n", F.lit(1)).unionByName(incoming.withColumn("_n", F.lit(-1))).groupBy(*columns).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
            touched = {str(r[0]) for r in differing.select(bucket).distinct().collect()}
            if not touched:
                return None
            merged = apply_diff(old.select(*columns), incoming, [scope])
            rows = merged.where(bucket.cast("string").isin(*touched))
            sent = touched

        def write(m: dict) -> dict:
            path = self._place(m, name)
            rows.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
            return {name: {**held, "buckets": {**held["buckets"], **{b: f"{path}/_bucket={b}" for b in sent}}}}

        return self._committed(write)
