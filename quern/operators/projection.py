"""A two-dimensional map of vectors with clusters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.listing import sample, scale


def project(vectors: DataFrame, id_col: str, vector_col: str, method: str = "pca", size: int = 500, clusters: int = 4) -> DataFrame:
    """id, cluster_id, x, y of a repeatable sample. Fewer than two rows: the middle of the map, cluster 0. UMAP and t-SNE aren't offered."""
    if method.lower().replace("-", "").replace("_", "") != "pca":
        raise ValueError("only PCA is offered")
    rows = sample(vectors.select(id_col, F.col(vector_col).cast("array<double>").alias("v")), size, id_col).withColumn("features", array_to_vector("v"))
    n = rows.count()
    if n < 2:
        return rows.select(id_col, F.lit(0).alias("cluster_id"), F.lit(50.0).alias("x"), F.lit(50.0).alias("y"))
    flat = PCA(k=2, inputCol="features", outputCol="flat").fit(rows).transform(rows)
    flat = KMeans(k=min(clusters, n), seed=42, featuresCol="features", predictionCol="cluster_id").fit(flat).transform(flat)
    xy = flat.select(id_col, "cluster_id", *[vector_to_array("flat")[i].alias(c) for i, c in enumerate("xy")])
    bounds = xy.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))])
    return xy.join(F.broadcast(bounds)).select(id_col, "cluster_id", *[scale(F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}")).alias(c) for c in "xy"])
