"""A stored vector index with exact answers: groups around centroids, cut into shells by the distance from the centroid.

Centroids are fitted on a bounded sample; every row is indexed. The triangle inequality bounds the distance of a query to all rows of a
shell: at least its distance to the centroid less the shell's outer radius, or the inner radius less that distance. The shells of the least
bounds are compared with a query first; the k-th distance found there tells which of the others can hold a nearer row, and only these are
read. So results are those of a full scan. A shell has at most SHELL rows, however many are alike, and queries are dealt to blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.functions import scalars as S
from quern.operators import retrieval
from quern.sources import shared
from quern.sources.shared import settled

SAMPLE = 4096  # rows that centroids are fitted on
GROUPS = 256  # centroids, at most; the square root of the sample's size otherwise
ROUNDS = 8
SHELL = 1024  # rows
BLOCK_QUERIES = 256  # queries that are compared with a shell at once
PUSHED_SHELLS = 1000  # shells that are written into the filter of the scan
MARGIN = 1e-9


def _stack(vectors: list, dimension: int | None = None) -> np.ndarray:
    lengths = {None if v is None else len(v) for v in vectors} | ({dimension} if dimension is not None else set())
    if len(lengths) > 1 or None in lengths:
        raise ValueError("vector length differs from the query's" if dimension is not None else "vector length differs from the others'")
    return np.stack(vectors).astype(float) if vectors else np.zeros((0, dimension or 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _gaps(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances of each vector to each centroid."""
    return np.stack([np.sqrt(((vectors - c) ** 2).sum(axis=1)) for c in centroids], axis=1)


def fitted(sample: np.ndarray) -> np.ndarray:
    """Centroids of a sample: some rounds of k-means from evenly spread rows; ones that lose all rows go."""
    found = sample[np.linspace(0, len(sample) - 1, min(GROUPS, int(np.ceil(np.sqrt(len(sample)))))).astype(int)]
    for _ in range(ROUNDS):
        own = _gaps(sample, found).argmin(axis=1)
        found = np.stack([sample[own == g].mean(axis=0) for g in np.unique(own)])
    return found


class VectorIndex:
    """An index of rows with vectors of one length, for one metric (l2, cosine or dot), under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, metric: str, id_col: str, centroids: np.ndarray):
        self.spark, self.folder, self.metric, self.id_col, self.centroids = spark, folder, metric, id_col, centroids

    @classmethod
    def build(cls, table: DataFrame, folder: str, id_col: str = "chunk_id", vector_col: str = "vector", metric: str = "l2") -> VectorIndex:
        """Rows with a null id are left out. A null vector, or one of another length, raises in the job."""
        spark, metric = table.sparkSession, metric.lower()
        if metric not in retrieval.METRICS:
            raise ValueError(f"unknown metric {metric}")
        rows = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
        turned = _unit if metric == "cosine" else lambda v: v
        sample = turned(_stack([r.vector for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()]))
        centroids = fitted(sample) if len(sample) else np.zeros((0, 0))
        kind = table.schema[id_col].dataType.simpleString()

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                gaps = _gaps(turned(_stack(list(frame["vector"]), centroids.shape[1])), centroids)
                near = gaps.argmin(axis=1)
                yield frame.assign(group=near, away=gaps[np.arange(len(gaps)), near])

        def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            task, group, n = TaskContext.get().partitionId(), -1, 0
            for frame in frames:
                place = frame.groupby("group").cumcount().to_numpy() + np.where(frame["group"] == group, n, 0)
                yield frame.assign(shell=[f"{g:03d}-{task:06d}-{p // SHELL:08d}" for g, p in zip(frame["group"], place, strict=True)])
                if len(frame):
                    last = frame["group"].iloc[-1]
                    group, n = last, int(place[-1]) + 1

        if len(sample):
            near = settled(rows.mapInPandas(assign, f"id {kind}, vector array<float>, group int, away double"))
            dealt = near.repartitionByRange("group", "away", F.xxhash64("id")).sortWithinPartitions("group", "away")
            dealt.mapInPandas(cut, f"id {kind}, vector array<float>, group int, away double, shell string").write.parquet(f"{folder}/rows")
        else:
            spark.createDataFrame([], f"id {kind}, vector array<float>, group int, away double, shell string").write.parquet(f"{folder}/rows")
        heads = spark.read.parquet(f"{folder}/rows").groupBy("group", "shell").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high"))
        heads.write.parquet(f"{folder}/shells")
        return cls(spark, folder, metric, id_col, centroids)

    def bounds(self, queries: DataFrame) -> DataFrame:
        """query_id, shell, n and bound: the least distance that a row of a shell can have, for each query (query_id, vector)."""
        centroids, metric = self.centroids, self.metric

        def gaps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                asked = _stack(list(frame["vector"]), centroids.shape[1])
                asked = _unit(asked) if metric == "cosine" else asked
                n = len(centroids)
                yield pd.DataFrame({
                    "query_id": frame["query_id"].repeat(n).array, "group": np.tile(np.arange(n), len(frame)), "gap": _gaps(asked, centroids).ravel(),
                    "inner": (asked @ centroids.T).ravel(), "size": np.repeat(np.sqrt((asked**2).sum(axis=1)), n),
                })

        kind = queries.schema["query_id"].dataType.simpleString()
        met = queries.select("query_id", "vector").mapInPandas(gaps, f"query_id {kind}, group int, gap double, inner double, size double")
        met = met.join(self.spark.read.parquet(f"{self.folder}/shells"), "group")
        apart = F.greatest(F.lit(0.0), F.col("gap") - F.col("high"), F.col("low") - F.col("gap"))
        bound = {"l2": apart * apart, "cosine": apart * apart / 2, "dot": -(F.col("inner") + F.col("size") * F.col("high"))}[metric]
        return met.select("query_id", "shell", "n", bound.alias("bound"))

    def needed(self, queries: DataFrame, k: int) -> DataFrame:
        """The rows of bounds() that can hold one of the k nearest."""
        bounds = settled(self.bounds(queries))
        order = W.Window.partitionBy("query_id").orderBy("bound", "shell")
        first = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)  # a shell has a row at least
        first = first.withColumn("before", F.sum("n").over(order.rowsBetween(W.Window.unboundedPreceding, 0)) - F.col("n")).where(F.col("before") < k)
        far = settled(self._nearest(queries, first.withColumn("reach", F.lit(None).cast("double")), k).where(F.col("rank") == k).select("query_id", F.col("distance").alias("far")))
        reach = F.col("far") + MARGIN * (1 + F.abs("far"))
        met = bounds.join(far, "query_id", "left").withColumn("reach", reach)
        return met.where(F.col("reach").isNull() | (F.col("bound") <= F.col("reach"))).select("query_id", "shell", "n", "bound", "reach")

    def _nearest(self, queries: DataFrame, shells: DataFrame, k: int) -> DataFrame:
        """The k nearest rows of each query in the shells (query_id, shell, reach: no farther row matters, null if that isn't known)."""
        blocks = -(-queries.count() // BLOCK_QUERIES) or 1
        pairs = settled(shells.select("query_id", "shell", "reach").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")))
        wanted = pairs.select("shell", "block").distinct()
        rows = self.spark.read.parquet(f"{self.folder}/rows").select("id", "vector", "shell")
        few = [r.shell for r in wanted.select("shell").distinct().limit(PUSHED_SHELLS + 1).collect()]
        rows = rows.where(F.col("shell").isin(sorted(few))) if len(few) <= PUSHED_SHELLS else rows
        left = rows.join(wanted, "shell")
        right = pairs.withColumnsRenamed({"shell": "their_shell", "block": "their_block"}).join(queries.select("query_id", F.col("vector").alias("asked")), "query_id")
        metric, id_type, query_type = self.metric, rows.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

        def nearest(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_id": theirs["query_id"][:0], "id": mine["id"][:0], "distance": np.zeros(0)})]
            if len(mine) and len(theirs):
                asked = _stack(list(theirs["asked"]))
                theirs, mine = theirs.reset_index(drop=True), mine.sort_values("id").reset_index(drop=True)
                found = retrieval.distances(_stack(list(mine["vector"]), asked.shape[1]), asked, metric)
                edge = np.partition(found, k - 1, axis=1)[:, k - 1] if k < len(mine) else np.full(len(theirs), np.nan)
                edge = np.fmin(edge, theirs["reach"].to_numpy(float))  # nan: all
                query, row = np.nonzero(~(found > edge[:, None]))
                order = np.lexsort((row, found[query, row], query))
                query, row = query[order], row[order]
                first = np.searchsorted(query, np.arange(len(theirs)))
                best = np.arange(len(query)) - first[query] < k
                query, row = query[best], row[best]
                out.append(pd.DataFrame({"query_id": theirs["query_id"].take(query).array, "id": mine["id"].take(row).array, "distance": found[query, row]}))
            return out[-1]

        met = left.groupBy("shell", "block").cogroup(right.groupBy("their_shell", "their_block")).applyInPandas(nearest, f"query_id {query_type}, id {id_type}, distance double")
        rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy("distance", "id"))
        return met.withColumn("rank", rank).where(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """For queries (query_id, vector), the k nearest rows of each: query_id, id, distance, rank (from 1), dense_score. Queries with a
        null id are left out; query_ids are distinct. A vector of another length, or a null one, raises in the job."""
        if k <= 0:
            raise ValueError("k must be positive")
        asked = queries.where("query_id is not null").select("query_id", "vector")
        top = self._nearest(asked, self.needed(asked, k), k)
        return top.select("query_id", F.col("id").alias(self.id_col), "distance", "rank", S.dense_score(F.col("distance")).alias("dense_score"))


def temporary(table: DataFrame, id_col: str, vector_col: str, metric: str) -> VectorIndex:
    """An index for one search, deleted when the driver's file system closes."""
    folder = f"{shared.shared_dir(table.sparkSession)}/vectors-{shared.new_name()}"
    shared.delete_at_end(table.sparkSession, folder)
    return VectorIndex.build(table, folder, id_col, vector_col, metric)
