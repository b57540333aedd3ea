"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir).

Lineage is cut by writing Parquet there and reading it back, so a lost executor never costs more than its own tasks. Only a local session
that names no folder (tests) gets one made; on a cluster that is an error. A table is deleted as soon as the next one of a loop is
written, the others when the driver's file system closes.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, else the context's checkpoint folder, else (local master only) a new local one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    return context.getCheckpointDir().rstrip("/")


def _at(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def save(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and return the table read back from there. The shuffles of the writing are deleted with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    files, target = _at(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that save() wrote and nothing reads any more."""
    files, target = _at(df.sparkSession, _PATHS.pop(df))
    files.delete(target, True)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES (or one row): long texts must not make a batch larger than a Python worker's memory.

    The bound is on bytes and only ever lowered, so that other queries of the session may inherit it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
