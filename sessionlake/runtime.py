"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sessionlake", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the plans assume (UTC, AQE, skew handling, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=conf).getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, so that they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="sessionlake-"), f"sessionlake-{context.applicationId}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("sessionlake", os.path.relpath(full, here)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``base``; columns are pruned by the plan that uses it."""
    ship(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set, else one of our own.

    Only a session without that setting (tests, a single machine) gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        own = os.path.join(tempfile.gettempdir(), f"sessionlake-{uuid.uuid4().hex[:12]}")
        context.setCheckpointDir(own)
        return own
    return current.get()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by reliable files in the shared folder; they outlive executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


class Folder:
    """Small text files below a path of any file system Spark can write, whatever machine the driver is on."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self._conf)

    def has(self, name: str) -> bool:
        path, files = self._path(name)
        return files.exists(path)

    def stamp(self, name: str) -> str:
        """The size, number of files and time of change of what ``name`` is: another one after a change."""
        path, files = self._path(name)
        whole, newest = files.getContentSummary(path), files.getFileStatus(path).getModificationTime()
        return f"{whole.getLength()}-{whole.getFileCount()}-{newest}"

    def read(self, name: str) -> str:
        path, files = self._path(name)
        stream = files.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write beside and rename over, so that a reader sees the old text or the new one."""
        beside, files = self._path(f".{name.replace('/', '-')}.{uuid.uuid4().hex}")
        path, _ = self._path(name)
        files.mkdirs(path.getParent())
        stream = files.create(beside, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        modes = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self._jvm.java.lang.reflect.Array.newInstance(modes.OVERWRITE.getClass(), 1)
        over[0] = modes.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self._conf).rename(files.makeQualified(beside), files.makeQualified(path), over)
