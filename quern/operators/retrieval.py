"""Dense and full-text retrieval, weighted reciprocal rank fusion, reranking and the chunk view.

Every ranking has a total order. Query terms are broadcast up to a checked number; chunks are scanned once for each ranking.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.functions import scalars as S
from quern.operators.skew import join_in_parts
from quern.schema import SOURCE_TYPES
from quern.sources.models import answer_or_fallback, score
from quern.sources.shared import settled

if TYPE_CHECKING:
    from quern.operators.fulltext import FullTextIndex

METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "l2": S.l2_squared,
    "cosine": lambda a, b: 1 - (2 * S.cosine01(a, b) - 1),
    "dot": lambda a, b: -S.dot(a, b),
}
K1, B = 1.2, 0.75
BROADCAST_TERMS = 500_000  # (query, term) rows that may be broadcast, at about 50 bytes


def _positive(**values: int) -> None:
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")


def knn(table: DataFrame, vector: list[float], k: int, id_col: str = "chunk_id", vector_col: str = "vector", metric: str = "l2") -> DataFrame:
    """The k nearest rows: id, distance, rank (from 1), dense_score. A vector of another length raises in the job."""
    _positive(k=k)
    query = F.lit([float(x) for x in vector])
    checked = F.when(F.size(vector_col) == len(vector), F.col(vector_col)).otherwise(F.raise_error(F.lit("vector length differs from the query's")).cast("array<float>"))
    top = table.select(F.col(id_col), METRICS[metric.lower()](checked, query).alias("distance")).orderBy("distance", id_col).limit(k)
    return top.select(id_col, "distance", F.row_number().over(W.Window.orderBy("distance", id_col)).alias("rank"), S.dense_score(F.col("distance")).alias("dense_score"))


def distances(rows: np.ndarray, asked: np.ndarray, metric: str) -> np.ndarray:
    """METRICS of each query with each row, summed in the order of the vectors' places as there."""
    total, square, asked_square = np.zeros((len(asked), len(rows))), np.zeros(len(rows)), np.zeros(len(asked))
    for a, b in zip(rows.T, asked.T, strict=True):
        total += (a[None, :] - b[:, None]) ** 2 if metric == "l2" else a[None, :] * b[:, None]
        square, asked_square = square + a * a, asked_square + b * b
    if metric == "cosine":
        norms = np.sqrt(square)[None, :] * np.sqrt(asked_square)[:, None]
        near = np.clip((np.divide(total, norms, out=np.zeros_like(total), where=norms > 0) + 1) / 2, 0.0, 1.0)
        return 1 - (2 * np.where(norms > 0, near, 0.0) - 1)
    return total if metric == "l2" else -total


def knn_many(table: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "vector", metric: str = "l2") -> DataFrame:
    """For queries (query_id, vector), the k nearest rows of each: query_id, id, distance, rank (from 1), dense_score.

    Exact, by an index that is made for this search; vectors.VectorIndex keeps one. Rows and queries with a null id are left out;
    query_ids are distinct. A vector of another length, or a null one, raises in the job.
    """
    from quern.operators import vectors

    _positive(k=k)
    return vectors.temporary(table, id_col, vector_col, metric).search(queries, k)


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(S.text_of(text)), r"[^\p{L}\p{N}]+"), "")


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id and term of queries (query_id, query), each term of a query once."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))


def bm25(table: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", text_col: str = "text", broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """For queries (query_id, query), the k best rows of each: query_id, id, score (4 digits), rank. Terms are alternatives.

    Texts are tokenised twice, for the lengths and for the queries' terms; fulltext.FullTextIndex keeps both. Terms and their document
    counts are broadcast up to broadcast_terms rows; beyond, hot terms are joined in parts.
    """
    _positive(k=k)
    asked = asked_terms(queries)
    small = asked.limit(broadcast_terms + 1).count() <= broadcast_terms
    docs = table.select(F.col(id_col), terms(F.col(text_col)).alias("terms")).withColumn("dl", F.size("terms"))
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = asked.select("term").distinct()
    tokens = docs.select(id_col, "dl", F.explode("terms").alias("term"))
    postings = tokens.join(F.broadcast(wanted) if small else wanted, "term").groupBy("term", id_col, "dl").agg(F.count("*").alias("tf"))
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    return ranked(postings, counts, stats, asked, k, id_col, small)


def ranked(postings: DataFrame, counts: DataFrame, stats: DataFrame, asked: DataFrame, k: int, id_col: str, small: bool) -> DataFrame:
    """The k best rows of each query, from postings (term, id, tf, dl), counts (term, df), stats (n, avgdl: one row) and asked (query_id, term)."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = counts.join(F.broadcast(stats)).select("term", idf.alias("idf"), "avgdl", "df")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    if small:
        scored = postings.join(F.broadcast(weighed.join(F.broadcast(asked), "term")), "term").select("query_id", id_col, part.alias("part"))
    else:
        each = weighed.join(asked, "term").groupBy("term").agg(F.collect_list("query_id").alias("query_ids"), F.first("idf").alias("idf"), F.first("avgdl").alias("avgdl"), F.first("df").alias("n"))
        scored = join_in_parts(postings, settled(each), "term").select(F.explode("query_ids").alias("query_id"), id_col, part.alias("part"))
    best = scored.groupBy("query_id", id_col).agg(F.round(F.sum("part"), 4).alias("score"))
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def fuse(dense: DataFrame, text: DataFrame, top: int, alpha: float = 0.5, id_col: str = "chunk_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted RRF of rankings (id, rank): id, rank_dense, rank_text, rrf, rank. Items of weight zero stay; ties: dense order first.

    by: columns of both, such as a query_id, within each value of which rankings are fused.
    """
    _positive(top=top)
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in 0..1")
    keys = [*by, id_col]
    joined = dense.select(*keys, F.col("rank").alias("rank_dense")).join(text.select(*keys, F.col("rank").alias("rank_text")), keys, "full_outer")
    scored = joined.withColumn("rrf", S.rrf(F.col("rank_dense"), F.col("rank_text"), alpha)).withColumn("place", F.coalesce(F.col("rank_dense"), 1_000_000 + F.col("rank_text")))
    order = [F.desc("rrf"), F.asc("place")]
    if not by:
        scored = scored.orderBy(*order).limit(top)
    window = W.Window.partitionBy(*by).orderBy(*order) if by else W.Window.orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top).drop("place")


def hybrid_search(table: DataFrame, vector: list[float] | None, query: str, top_k: int = 20, mode: str | None = "hybrid", alpha: float = 0.5, id_col: str = "chunk_id", vector_col: str = "vector", text_col: str = "text", vectors: DataFrame | None = None, index: FullTextIndex | None = None) -> DataFrame:
    """Rows of table in rank order with dense_score, bm25_score (0.0 when absent from that ranking) and rank.

    mode: dense; sparse, bm25 or fts; hybrid (twice top_k candidates a side, fused). Null means hybrid; any other is an error. vectors: the
    table that holds the vectors, where it is another one. index: a stored full-text index of the table, else its texts are read.
    """
    mode = (mode or "hybrid").lower()
    if mode not in ("dense", "sparse", "bm25", "fts", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    _positive(top_k=top_k)
    wide = top_k if mode != "hybrid" else 2 * top_k
    dense = knn(table if vectors is None else vectors, vector, wide, id_col, vector_col) if mode in ("dense", "hybrid") else None
    asked = table.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    text = None if mode == "dense" else index.search(asked, wide) if index else bm25(table, asked, wide, id_col, text_col)
    ranked = dense.select(id_col, "rank") if text is None else text.select(id_col, "rank") if dense is None else fuse(dense, text, top_k, alpha, id_col).select(id_col, "rank", F.round("rrf", 6).alias("rrf"))
    out = table.drop(vector_col).join(F.broadcast(ranked), id_col)  # at most top_k rows
    zero = F.lit(0.0)
    out = out.join(F.broadcast(dense.select(id_col, "dense_score")), id_col, "left") if dense is not None else out.withColumn("dense_score", zero)
    out = out.join(F.broadcast(text.select(id_col, F.col("score").alias("bm25_score"))), id_col, "left") if text is not None else out.withColumn("bm25_score", zero)
    return out.fillna(0.0, ["dense_score", "bm25_score"]).orderBy("rank")


def query_coverage(query: str, text: Column) -> Column:
    """A deterministic scorer: the share of the query's distinct terms that a text has."""
    asked = F.array_distinct(terms(F.lit(query)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, terms(text))).cast("double"), F.size(asked).cast("double")), F.lit(0.0))


def rerank(candidates: DataFrame, score: Column, top_n: int = 6) -> DataFrame:
    """Candidates (..., rank) ordered by the unrounded score, then rank: rerank_score (4 digits), final_rank, rank_delta."""
    _positive(top_n=top_n)
    order = [F.desc("raw"), F.asc("rank")]
    top = candidates.withColumn("raw", score.cast("double")).orderBy(*order).limit(top_n)
    out = top.withColumn("final_rank", F.row_number().over(W.Window.orderBy(*order)))
    return out.select(*candidates.columns, F.round("raw", 4).alias("rerank_score"), "final_rank", (F.col("rank") - F.col("final_rank")).alias("rank_delta"))


def cut(candidates: DataFrame, top_n: int = 6) -> DataFrame:
    """Candidates without reranking: the first by rank, with the dense score as rerank_score and no change of rank."""
    _positive(top_n=top_n)
    return candidates.where(F.col("rank") <= top_n).select(*candidates.columns, F.col("dense_score").alias("rerank_score"), F.col("rank").alias("final_rank"), F.lit(0).alias("rank_delta"))


def rerank_or_keep(candidates: DataFrame, query: str, reranker: Callable[[str, list[str]], list[float]], top_n: int = 6, text_col: str = "text") -> DataFrame:
    """rerank() by a model; where it fails, the first by rank with a rerank_score of 0."""
    _positive(top_n=top_n)
    order = [F.desc_nulls_last("raw"), F.asc("rank")]  # after a failure no candidate has a score
    top = score(candidates, query, reranker, text_col).orderBy(*order).limit(top_n)
    out = top.withColumn("final_rank", F.row_number().over(W.Window.orderBy(*order)))
    return out.select(*candidates.columns, F.coalesce(F.round("raw", 4), F.lit(0.0)).alias("rerank_score"), "final_rank", (F.col("rank") - F.col("final_rank")).alias("rank_delta"))


def result_view(rows: DataFrame, model: str, table_name: str = "chunks") -> DataFrame:
    """The view of a query's results (chunk_id, text, source_title, source_type, section, position, dense_score, bm25_score, rerank_score,
    rank, final_rank, and vector if there is one), numbered by final_rank. Fields that no source fills are empty or null."""
    kinds = F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])
    n = F.size("vector") if "vector" in rows.columns else F.lit(None).cast("int")
    return rows.select(
        F.col("chunk_id").alias("id"), F.col("final_rank").alias("chunk_num"), F.coalesce("source_title", F.lit("Sconosciuto")).alias("doc_title"),
        F.coalesce(F.try_element_at(kinds, F.lower(S.text_of("source_type"))), F.lit("Libro")).alias("doc_type"), F.coalesce("section", F.lit("Sezione Generale")).alias("section"),
        S.text_of("text").alias("text"), S.snippet(F.col("text")).alias("highlight_snippet"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dense_score", "bm25_score", "rerank_score")],
        (F.col("rank") - F.col("final_rank")).alias("rank_delta"), S.token_estimate(F.col("text")).alias("token_count"), F.lit(None).cast("double").alias("overlap_pct"),
        F.lit(model).alias("embedding_model"), F.when(n > 0, F.concat(n.cast("string"), F.lit("d"))).alias("dimensions"), S.text_of("position").alias("char_offset"),
        F.lit("").alias("timestamp"), F.lit(table_name).alias("vector_table"), F.lit("").alias("parser"),
    )


def ask(table: DataFrame, question: str, vector: list[float] | None, generator: Callable[[str], str], reranker: Callable[[str, list[str]], list[float]] | None = None, top_k: int = 20, top_n: int = 6, mode: str | None = "hybrid", alpha: float = 0.7, model: str = "", index: FullTextIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """A question to a chunk table: the view of the chunks used, and one row (answer, failed).

    Retrieves top_k, reranks to top_n (no reranker: cuts by rank; one that fails: the ranking before) and asks the generator, whose failure
    gives a text made of the chunks. A table without a match gives no chunks and the fixed sentence. A blank question is an error.
    """
    if not question.strip():
        raise ValueError("blank question")
    found = hybrid_search(table, vector, question, top_k, mode, alpha, index=index)
    used = rerank_or_keep(found, question, reranker, top_n) if reranker else cut(found, top_n)
    return result_view(used, model).orderBy("chunk_num"), answer_or_fallback(used, question, generator, "final_rank")


def chunk_view(rows: DataFrame, score: str = "score") -> DataFrame:
    """rows (chunk_id, text, source_title, source_type, section, num, score): what a client is shown."""
    kinds = F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])
    blank = lambda c, d: F.when(S.text_of(c) == "", F.lit(d)).otherwise(F.col(c))
    return rows.select(
        "chunk_id", (F.col("num") + 1).alias("chunk_num"), F.coalesce(F.try_element_at(kinds, F.lower(S.text_of("source_type"))), F.lit("Libro")).alias("doc_type"),
        blank("source_title", "Sconosciuto").alias("doc_title"), blank("section", "Sezione Generale").alias("section"), S.snippet(F.col("text")).alias("snippet"),
        S.token_estimate(F.col("text")).alias("token_count"), F.coalesce(F.col(score), F.lit(0.0)).alias("score"),
    )
