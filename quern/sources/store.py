"""The chunk table on disk: an idempotent upsert that rewrites what it touches, export and import."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.listing import batch_number
from quern.schema import CHUNK_SCHEMA
from quern.sources import archives, shared
from quern.sources.buckets import BucketedTable, merge
from quern.sources.models import embed

__all__ = ["ChunkStore", "import_archive", "merge"]


class ChunkStore:
    """One chunk table under a folder that driver and executors share: a bucketed table by chunk_id, which checks the vectors' length.

    Each write makes a new version; the one before stays until the next write, for those who still read it.
    """

    def __init__(self, spark: SparkSession, folder: str, dimension: int):
        self.spark, self.folder, self.dimension = spark, folder, dimension
        self.table = BucketedTable(spark, folder, CHUNK_SCHEMA, "chunk_id")

    def read(self) -> DataFrame:
        return self.table.read()

    def count(self) -> int:
        return self.table.count()

    def upsert(self, chunks: DataFrame, order: str | None = None) -> int:
        """Returns the number of input rows. A vector of another length fails the job before the table changes. The input is run once."""
        size = F.size("vector")
        checked = chunks.withColumn("vector", F.when(size == self.dimension, F.col("vector")).otherwise(F.raise_error(F.lit("vector length differs from the table's")).cast("array<float>")))
        return self.table.upsert(checked, order)

    def upsert_in_batches(self, chunks: DataFrame, load: Callable[[], Callable], order: str, size: int = 32, upto: Callable[[int], None] | None = None, batches: int = 1000) -> int:
        """Embed and upsert chunks (without vectors) in batches of size rows by order, a number of batches at a time.

        What was written stays if a later part fails; upto is told the rows written so far. load makes the embedder, once in each task.
        """
        placed = batch_number(chunks, order, size)
        placed = shared.settled(placed.drop("place"))
        last, n = placed.agg(F.max("batch")).first()[0], 0
        for first in range(0, (last if last is not None else -1) + 1, batches):
            part = placed.where(F.col("batch").between(first, first + batches - 1)).drop("batch")
            n += self.upsert(embed(part, batch=size, load=load), order)
            if upto:
                upto(n)
        return n

    def export(self, path: str, model: str) -> None:
        """The table as a folder of archives, written by tasks, with its metadata."""
        archives.register(self.spark)
        metadata = json.dumps({"format": "quern-1", "embeddingModel": model, "dimension": self.dimension})
        self.read().write.format(archives.NAME).option("metadata", metadata).mode("append").save(path)


def import_archive(spark: SparkSession, path: str, folder: str) -> dict:
    """Read an archive, or a folder of them, into a new table; the metadata. The table is there when all of it has been read and checked."""
    members, found = archives.directory(path)
    if not members:
        raise ValueError("archive has no chunk table")
    archives.register(spark)
    table = spark.read.format(archives.NAME).load(path)
    if "vector" not in table.columns:
        raise ValueError("chunk table has no vectors")
    meta = found or {"format": "imported", "embeddingModel": "unknown"}
    first = table.select(F.size("vector").alias("d")).where("d > 0").first()
    dimension = first.d if first else meta.get("dimension", 0)
    if not dimension or meta.setdefault("dimension", dimension) != dimension:
        raise ValueError("dimension differs from the metadata's")
    named = set(table.columns)
    fields = [(F.col(c.name) if c.name in named else F.lit(None)).cast(c.dataType.simpleString()).alias(c.name) for c in CHUNK_SCHEMA]
    stage = f"{folder}.stage-{shared.new_name()}"
    try:
        ChunkStore(spark, stage, dimension).upsert(table.select(*fields))
        shared.move(spark, stage, folder)
    finally:
        shared.delete(spark, stage)
    return meta
