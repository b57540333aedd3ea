"""The vector index: results of a full scan, from a part of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval, vectors
from quern.operators.vectors import VectorIndex


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "chunk_id long, vector array<float>")


def want(rows, asked, k, metric):
    data = np.array([np.asarray(v, dtype=np.float32) for _, v in rows], dtype=float)
    found = retrieval.distances(data, np.array([np.asarray(v, dtype=np.float32) for _, v in asked], dtype=float), metric)
    ids = np.array([i for i, _ in rows])
    return sorted((q, int(ids[j]), n + 1) for (q, _), d in zip(asked, found, strict=True) for n, j in enumerate(np.lexsort((ids, d))[:k]))


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_exact_from_half_of_the_rows(spark, tmp_path, monkeypatch, metric):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 10
    rows = [(i, centres[i % 12] + rng.normal(size=8)) for i in range(3000)] + [(5000 + i, centres[0]) for i in range(300)]  # copies
    rows += [(9000, np.zeros(8))]
    asked = [(q, centres[q] + rng.normal(size=8) * 0.5) for q in range(12)] + [(50, rng.normal(size=8) * 10)] + ([(51, np.zeros(8))] if metric != "cosine" else [])
    # shells are cut in the workers, which don't see the change; so that there are many, ranges are many
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 5)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = VectorIndex.build(table(spark, rows), str(tmp_path / "v"), metric=metric)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    queries = table(spark, asked).withColumnRenamed("chunk_id", "query_id")
    got = sorted((r.query_id, r.chunk_id, r["rank"]) for r in index.search(queries, 10).collect())
    assert got == want(rows, asked, 10, metric)
    near = queries.where("query_id < 12")
    every, read = (t.agg(F.sum("n")).first()[0] for t in (index.bounds(near), index.needed(near, 10)))
    assert every == 12 * len(rows) and read < 0.5 * every, (read, every)
    assert index.search(queries, 5000).count() == len(asked) * len(rows)


def test_bounds_hold(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3)) for i in range(200)]
    for metric in ("l2", "cosine", "dot"):
        index = VectorIndex.build(table(spark, rows), str(tmp_path / metric), metric=metric)
        asked = table(spark, [(i, rng.normal(size=3)) for i in range(5)]).withColumnRenamed("chunk_id", "query_id")
        bounds = {(r.query_id, r.shell): r.bound for r in index.bounds(asked).collect()}
        shells = {r.id: r.shell for r in spark.read.parquet(f"{index.folder}/rows").collect()}
        for r in index.search(asked, 200).collect():
            assert bounds[r.query_id, shells[r.chunk_id]] <= r.distance + 1e-6


def test_awkward_vectors(spark, tmp_path):
    asked = table(spark, [(1, [1.0, 0.0])]).withColumnRenamed("chunk_id", "query_id")
    none = VectorIndex.build(table(spark, []), str(tmp_path / "none"))
    assert none.bounds(asked.limit(0)).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0], "x"), (None, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x")], "chunk_id long, vector array<float>, `group` string")
    index = VectorIndex.build(rows, str(tmp_path / "few"))
    assert [tuple(r)[:4] for r in index.search(asked, 5).collect()] == [(1, 1, 0.0, 1), (1, 1, 0.0, 2)]
    for bad in ([1.0], None):
        with pytest.raises(Exception, match="length"):
            VectorIndex.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, bad)], "chunk_id long, vector array<float>"), str(tmp_path / f"bad{bad}"))


def test_rows_beyond_reach_stay_in_their_shell(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3)) for i in range(300)] + [(300 + i, np.ones(3)) for i in range(30)]  # ties among the nearest
    asked = table(spark, [(0, np.ones(3)), (1, rng.normal(size=3))]).withColumnRenamed("chunk_id", "query_id")
    for metric in ("l2", "cosine", "dot"):
        index = VectorIndex.build(table(spark, rows), str(tmp_path / metric), metric=metric)
        reach = {r.query_id: r.reach for r in index.needed(asked, 7).collect()}
        got = index.search(asked, 7).collect()
        assert len(got) == 14 and all(r.distance <= reach[r.query_id] for r in got)
        if metric == "l2":
            assert sorted(r.chunk_id for r in got if r.query_id == 0) == list(range(300, 307))
