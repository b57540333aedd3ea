"""The folder that driver and executors share, reached through Hadoop's file systems only."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder, else (local master only) a new local one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def _at(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _at(spark, path)
    return files.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    files, target = _at(spark, path)
    files.delete(target, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """A folder gets another name, under which nothing may be."""
    files, target = _at(spark, path)
    if files.exists(_at(spark, to)[1]) or not files.rename(target, _at(spark, to)[1]):
        raise ValueError(f"{to} is there")


def new_name() -> str:
    return uuid.uuid4().hex


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver's file system closes."""
    files, target = _at(spark, path)
    files.deleteOnExit(target)


def settled(df: DataFrame) -> DataFrame:
    """df with its rows written down in the shared folder: whatever reads it twice reads the same. It is deleted when the driver's file
    system closes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{new_name()}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's entries, in order; none if it isn't there. For folders with a few entries."""
    files, target = _at(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(target)) if files.exists(target) else []


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that may not be there yet; False if it is. Of several writers of one path, one gets True."""
    files, target = _at(spark, path)
    try:
        out = files.create(target, False)
    except Py4JJavaError as e:
        if files.exists(target):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    files, target = _at(spark, path)
    stream = files.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
