"""A keyed table on disk whose upsert rewrites only the files that it touches.

Rows lie in buckets by a hash of their key; a bucket has one file or a few, each with the range of its keys, and a manifest lists them. Of
the files of a bucket that gets rows, only those are rewritten whose range overlaps that of the bucket's incoming keys: rows beyond all
ranges are put into a file beside. Buckets double in number when they get large, and a bucket with many files becomes one file again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from quern.sources import shared
from quern.sources.versions import ATTEMPTS, Conflict, Versions

BUCKETS = 16  # of a new table
BUCKET_ROWS = 32_000  # rows of a bucket on average, at most
BUCKET_FILES = 8


def merge(stored: DataFrame, incoming: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """Matched keys take the incoming row, others are added. Within incoming the last row by `order` wins; without an order a key that
    comes twice is an error in the job, since it isn't known which row is the last."""
    by_key = W.Window.partitionBy(key)
    if order:
        last = incoming.withColumn("_n", F.row_number().over(by_key.orderBy(F.desc(order)))).where("_n = 1").drop("_n", *({order} - set(stored.columns)))
    else:
        twice = F.raise_error(F.concat(F.lit("no order says which row is the last of the key "), F.col(key).cast("string"))).cast("boolean")
        last = incoming.withColumn("_n", F.count("*").over(by_key)).where(F.when(F.col("_n") > 1, twice).otherwise(F.lit(True))).drop("_n")
    return stored.join(last.select(key), key, "left_anti").unionByName(last)


class BucketedTable:
    """Rows of a schema, one for each value of a key column of strings or numbers, under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.folder, self.schema, self.key, self.buckets, self.bucket_rows = spark, folder, schema, key, buckets, bucket_rows
        kind = schema[key].dataType.simpleString()
        self.log = Versions(spark, folder, f"written string, bucket int, rows long, low {kind}, high {kind}")

    def _at(self, file: Row) -> str:
        return f"data/{file.written}/bucket={file.bucket}"

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _read(self, files: list[Row]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{self._at(f)}" for f in files])

    def files(self) -> list[Row]:
        """The files of the last version: written, bucket, rows, low and high key."""
        return self.log.read(self.log.last())[0]

    def read(self) -> DataFrame:
        return self._read(self.files())

    def count(self) -> int:
        """From the manifest: nothing is read."""
        return sum(f.rows for f in self.files())

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Insert rows or replace those of the same keys; the number of input rows. The input is run once. A null key is an error."""
        checked = rows.withColumn(self.key, F.coalesce(self.key, F.raise_error(F.lit("null key")).cast(self.schema[self.key].dataType)))
        staged = f"{self.folder}/incoming-{uuid.uuid4().hex}"
        try:
            checked.write.parquet(staged)
            incoming = self.spark.read.schema(checked.schema).parquet(staged)
            if not any(self._write(incoming, order) for _ in range(ATTEMPTS)):
                raise Conflict(f"{ATTEMPTS} other writers came first")
            return incoming.count()
        finally:
            shared.delete(self.spark, staged)

    def _write(self, incoming: DataFrame, order: str | None) -> bool:
        number = self.log.last()
        files, note = self.log.read(number)
        buckets, stored = int(note or self.buckets), sum(f.rows for f in files)
        asked = incoming.groupBy(self._bucket(buckets).alias("bucket")).agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("n")).collect()
        grown = buckets
        while stored + sum(a.n for a in asked) > grown * self.bucket_rows:
            grown *= 2
        touched = self._touched(files, asked) if grown == buckets else files
        fields = self.schema.fieldNames()
        merged = merge(self._read(touched), incoming, self.key, order).select(*fields, self._bucket(grown).alias("bucket"))
        written = uuid.uuid4().hex
        merged.repartition("bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.folder}/data/{written}")
        kept, made = [f for f in files if f not in touched], []
        if asked or touched:
            back = self.spark.read.schema(T.StructType([self.schema[self.key], T.StructField("bucket", T.IntegerType())])).parquet(f"{self.folder}/data/{written}")
            made = back.groupBy("bucket").agg(F.lit(written).alias("written"), F.count("*").alias("rows"), F.min(self.key).alias("low"), F.max(self.key).alias("high"))
            made = made.select("written", "bucket", "rows", "low", "high").collect()
        if not self.log.publish(number + 1, [*kept, *made], str(grown), written):
            shared.delete(self.spark, f"{self.folder}/data/{written}")
            return False
        self.log.forget(number - 1, self._at)
        return True

    def _touched(self, files: list[Row], asked: list[Row]) -> list[Row]:
        ranges = {a.bucket: a for a in asked}
        several: dict[int, int] = {}
        for f in files:
            several[f.bucket] = several.get(f.bucket, 0) + 1
        return [f for f in files if (a := ranges.get(f.bucket)) and (f.low <= a.high and a.low <= f.high or several[f.bucket] >= BUCKET_FILES)]

    def clean(self) -> None:
        """Delete what failed writers left: files that no version has, and numbers that name nothing. Not while others write."""
        self.log.clean()
        known = {f.written for n in self.log.numbers() for f in self.log.read(n)[0]}
        for name in shared.names_in(self.spark, f"{self.folder}/data"):
            if name not in known:
                shared.delete(self.spark, f"{self.folder}/data/{name}")
