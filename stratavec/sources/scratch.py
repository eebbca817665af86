"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_fallback: dict[str, str] = {}
_lock = threading.Lock()
_writers: dict[int, list] = {}  # by session: how many writes run, and the setting before the first of them


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="stratavec-")
    return f"file://{_fallback[app]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/stratavec/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the JVM may have ended before
        pass


class _ShuffleFilesDropped:
    """Jobs that run inside drop their shuffle files at their end. Writes of several threads share the setting: the
    first sets it, the last one puts back what was there."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        with _lock:
            state = _writers.setdefault(id(self.spark), [0, None])
            if not state[0]:
                state[1] = self.spark.conf.get(_CLEANUP, None)
                self.spark.conf.set(_CLEANUP, "true")
            state[0] += 1

    def __exit__(self, *_):
        with _lock:
            state = _writers[id(self.spark)]
            state[0] -= 1
            if not state[0]:
                self.spark.conf.set(_CLEANUP, state[1]) if state[1] is not None else self.spark.conf.unset(_CLEANUP)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again. This cuts the lineage in a way that outlives executors, and
    lets Spark drop the shuffle files of the job that made it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _ShuffleFilesDropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes saved tables that no later job reads."""
    for df in tables:
        remove(df.sparkSession, df._scratch_path)
