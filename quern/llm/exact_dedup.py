"""Op 7: exact dedup as a tree-merge of sorted digest runs, in DataFrame functions only.

Rows are dealt to runs by a hash. A run is a list of entries in the order of the digest, one for each: its count of rows and the best
identifier so far. It lies in slices by the digest's first digits, so that no run has to fit one task. In each round, FAN_IN neighbouring
runs exchange: their slices meet in one task each, are put in the order of the digest, and are merged in one pass over that order, in
which the entries of a digest stand together and the best identifier is retained. After the last round one sorted run is left. An entry's
key is the digest with a second hash and the length, so equality is verified at every level. Equal texts that fill a third of all rows are
one entry of each run from the first round on, so no task sees more than FAN_IN entries of a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import save
from quern.operators.skew import join_in_parts

FAN_IN = 16
RUNS = 256
SLICE_DIGITS = 3  # of the digest in hexadecimal: 4096 slices of the final run


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")


def _merged(entries: DataFrame, key: list[str]) -> DataFrame:
    """Runs merged in the order of the digest. Least best: most code points, then the smallest identifier."""
    order = ["run", "slice", *key]
    runs = entries.repartition("run", "slice").sortWithinPartitions(*order)
    return runs.groupBy(*order).agg(F.min("best").alias("best"), F.sum("size").alias("size"))  # reads the order, sorts nothing


def tree_merge(entries: DataFrame, key: list[str], runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """entries (run, *key, best, size), key[0] being a digest in hexadecimal: one entry per key, merged over rounds of fan_in neighbouring
    runs. The first round merges rows into runs within the tasks that have them, before anything is exchanged.
    """
    order = ["run", "slice", *key]
    entries = entries.withColumn("slice", F.substring(key[0], 1, SLICE_DIGITS)).groupBy(*order).agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    while runs > 1:
        runs = -(-runs // fan_in)
        entries = _merged(entries.withColumn("run", F.expr(f"run div {fan_in}")), key)
    return entries.drop("run", "slice")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """For docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, chars.

    Texts are equal when identical after deleting every character of `[\\x20\\x09-\\x0D]`; null counts as empty. Of equal texts the row
    with the most code points in its original text stays, then the one with the smallest doc_id (null ids last). Digests are verified by
    the length and a second hash of the normalised text. Rows that repeat a doc_id are counted each; kept marks every row with the id and
    length that stay. Other columns are dropped. Of a text of any length only digests and lengths leave the scan. An empty table gives no
    rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.length(text).cast("long").alias("chars"), _bare(text).alias("bare"))
    rows = save(rows.select("doc_id", "chars", F.sha2("bare", 256).alias("text_sha256"), F.xxhash64("bare").alias("proof"), F.length("bare").alias("length")))
    key = ["text_sha256", "proof", "length"]
    best = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), "doc_id")
    entries = rows.select(*key, F.pmod(F.xxhash64("doc_id"), F.lit(RUNS)).alias("run"), best.alias("best"), F.lit(1).cast("long").alias("size"))
    merged = save(tree_merge(entries, key))
    # the rows of a large group are cut into parts
    joined = join_in_parts(rows.withColumn("entry", F.struct(*key)), merged.select(F.struct(*key).alias("entry"), "best", "size", F.col("size").alias("n")), "entry")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("chars") == -F.col("best.chars"))
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), "text_sha256", "chars")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, the one that stays. Columns stay as they are, whatever their names.

    Null and empty texts are one group. Of rows that agree in doc_id and in length and normalised form of the text, one stays: which of
    their other columns' values stay isn't defined. An empty table stays empty.
    """
    key = F.struct(F.col("doc_id").cast("long").alias("id"), F.col("text_sha256").alias("digest"), F.col("chars").cast("long").alias("chars"))
    stays = save(exact_duplicates(docs).where("kept").groupBy(key.alias("key")).agg(F.count("*").alias("n")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.struct(F.col("doc_id").cast("long").alias("id"), F.sha2(_bare(text), 256).alias("digest"), F.length(text).cast("long").alias("chars"))
    keyed = docs.select(own.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # a row's names can't clash
    once = keyed.join(stays.where("n = 1"), "key", "left_semi").select("row.*")
    if not stays.where("n > 1").limit(1).count():
        return once
    # rows of one key are brought down to one where they are, before any two of them meet
    again = keyed.join(stays.where("n > 1"), "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
    return once.unionByName(again.select("row.*"))
