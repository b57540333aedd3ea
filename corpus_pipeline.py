"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

Every stage but the last returns whole rows of its input, whatever other columns they have. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.bpe import bpe_round_trip
from quern.llm.decontaminate import drop_contaminated
from quern.llm.exact_dedup import drop_exact_duplicates
from quern.llm.near_dedup import keep_one_of_each
from quern.llm.quality import keep_good
from quern.llm.queries import tokenizer_path
from quern.llm.scratch import save


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores at 0.7 and more. Each row is judged by its own text: repeated rows share their fate, a null doc_id
    makes no difference, and a null or empty text gets the neutral score. Without labels nothing passes (0.5)."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space; null and empty texts are one group, and so are repeated rows."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts of similarity 0.8 and more, the rows of its smallest doc_id. Texts without words, null ones included, and
    rows of a null doc_id are linked with nothing and stay."""
    return keep_one_of_each(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of documents without a benchmark passage. Null texts have none; rows of a null doc_id aren't looked into and stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests, and ids: the training data, as little-endian unsigned 32-bit integers. One row for each row; a null text
    has no ids."""
    return bpe_round_trip(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", encode)]

#: SQL can't express the classifier, the near-dedup's components or BPE; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
