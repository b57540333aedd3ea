"""Op 9: benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a mask over consecutive words that ignores some of them, so a hit survives substitutions at the ignored places. Seeds of
the benchmark are joined to those of all texts; around each hit the item's words are compared with the text's on the same diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Masks of spaced seeds; 1: the word counts. Wherever the words that may disagree stand in a window of 8 to 13 words, one of these hits.
MASKS = ("1110111", "1111101", "10011111", "110100111", "1101010011")
SPAN = 8  # words that a text or item has at least
WINDOW = 13  # words of the window that must agree around a hit (shorter items: the item)
SHARE = 0.8
BROADCAST_SEEDS = 500_000  # seeds of the benchmark that may be broadcast, at about 100 bytes
BROADCAST_BYTES = 64 << 20  # of the texts of its items


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def _seeds(words_column: str, at: str) -> Column:
    """Hashes of the masks over the words from place `at` on (from 0); null where the words end before the mask."""
    def one(k: int, mask: str) -> Column:
        seed = F.xxhash64(F.lit(k), *[F.expr(f"get({words_column}, {at} + {i})") for i, bit in enumerate(mask) if bit == "1"])
        return F.when(F.expr(f"{at} + {len(mask)} <= size({words_column})"), seed)

    return F.array(*[one(k, m) for k, m in enumerate(MASKS)])


def _seeded(table: DataFrame, *keep: str) -> DataFrame:
    """A row for each place and mask: the place, the seed and the columns to keep."""
    places = F.when(F.size("words") >= SPAN, F.sequence(F.lit(0), F.size("words") - min(map(len, MASKS))))
    return table.select(*keep, F.explode(places).alias("place"), "words").select(*keep, "place", "words", F.explode(_seeds("words", "place")).alias("seed")).where("seed is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """For docs (doc_id, text) and benchmark (item_id, text): doc_id, item_id, item_words, matched, diagonals.

    One row for each contaminated pair. A pair is contaminated when, on a diagonal, some WINDOW consecutive words of the
    item (all, if it has fewer) agree with the text's in at least SHARE of them; places outside the text disagree. Such a diagonal always has a seed hit. matched is the largest
    number of agreeing words of the item on a diagonal, diagonals the number of such diagonals. Texts and items of fewer than SPAN words,
    null or empty ones match nothing. Equal items are reported each, rows of one item_id are one item for each text; repeated doc_ids are one document, all of whose different texts are
    read, and a diagonal counts once however many of them meet it; null ids match nothing. Other columns are dropped. Empty tables give no rows.

    A benchmark of at most broadcast_seeds seeds and BROADCAST_BYTES of words is broadcast, and only hits leave the scan of the texts. A
    larger one is joined by a shuffle of seeds, and the texts are read again for the verification. Both give the same rows. A text of any
    length is read whole.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), words(F.col("text")).alias("words")).where(F.size("words") >= SPAN).distinct()
    seeds = _seeded(items, "item_id").select("seed", "item_id", F.size("words").alias("item_words"), F.col("place").alias("item_place")).distinct()
    length = items.agg(F.coalesce(F.sum(F.expr("aggregate(words, 0L, (n, w) -> n + octet_length(w) + 16)")), F.lit(0))).first()[0]
    small = length <= BROADCAST_BYTES and seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), words(F.col("text")).alias("words")).withColumn("wording", F.xxhash64("words"))
    shift = (F.col("place") - F.col("item_place")).alias("diagonal")
    line = F.slice("words", F.greatest(F.col("diagonal"), F.lit(0)) + 1, F.col("item_words") + F.least("diagonal", F.lit(0)))
    pair = ["doc_id", "item_id", "item_words", "diagonal"]
    if small:
        hits = _seeded(texts, "doc_id").join(F.broadcast(seeds), "seed").select(*pair[:3], shift, "words")
        lines = hits.select(*pair, line.alias("line")).distinct()
        lines = lines.join(F.broadcast(items.withColumnRenamed("words", "item")), "item_id")
    else:
        hits = _seeded(texts, "doc_id", "wording").drop("words").join(seeds, "seed").select(*pair[:3], shift, "wording").distinct()
        lines = hits.join(texts, ["doc_id", "wording"]).select(*pair, line.alias("line")).join(items.withColumnRenamed("words", "item"), "item_id")
    lines = lines.where(F.size("item") == F.col("item_words"))  # of an item_id with several texts
    agree = F.expr("transform(item, (w, i) -> if(i + least(diagonal, 0) >= 0 and coalesce(get(line, i + least(diagonal, 0)) = w, false), 1, 0))")
    width = F.least(F.lit(WINDOW), F.col("item_words"))
    sums = lines.select(*pair, agree.alias("agree"), width.alias("width"))
    window = F.expr(f"exists(sequence(0, item_words - width), b -> aggregate(slice(agree, b + 1, width), 0, (n, x) -> n + x) >= {SHARE} * width)")
    verified = sums.where(window).select(*pair, F.expr("aggregate(agree, 0, (n, x) -> n + x)").cast("long").alias("agreeing"))
    verified = verified.groupBy(*pair).agg(F.max("agreeing").alias("agreeing"))  # the texts of one id
    return verified.groupBy("doc_id", "item_id", F.col("item_words").cast("long").alias("item_words")).agg(F.max("agreeing").alias("matched"), F.count("*").alias("diagonals"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated documents. Columns stay as they are, and so do rows of a null doc_id; all rows of a contaminated doc_id go.
    An empty table, or an empty benchmark, takes nothing away."""
    return docs.join(contaminated(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
