"""Op 8: sharding by a minimax contiguous partition of ordered atomic groups.

Equal texts share an atom: ATOMS ranges of the hash of the text. Atoms of over LARGE of an even shard come first, the largest ahead, the
others follow in the order of the hash, so that small atoms even out what large ones leave. The atoms' sizes are a histogram of fixed length whatever the
input, so the driver may hold it. The smallest feasible capacity is found by binary search with a greedy check, and the order is cut
within it, each cut as near to an even share of what remains as the capacity allows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.llm.scratch import save

ATOMS = 1 << 17
LARGE = 1 / 8
HOT_ROWS = 1000  # atoms with more rows are numbered in parts, 1 / MOST_PARTS of all rows if that is more
MOST_PARTS = 1 << 16


def feasible(prefix: np.ndarray, capacity: int, shards: int, start: int = 0) -> bool:
    """Greedy: can the atoms from start on be cut into so many runs, each of at most capacity?"""
    at, last = start, len(prefix) - 1
    for _ in range(shards):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
        if at >= last:
            return True
    return at >= last


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least largest shard of any contiguous partition."""
    prefix = np.concatenate(([0], np.cumsum(sizes)))
    low, high = max(int(sizes.max(initial=0)), -(-int(prefix[-1]) // shards)), int(prefix[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(prefix, middle, shards) else (middle + 1, high)
    return low


def cut(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each atom: contiguous, none over the smallest capacity, and as even as that allows."""
    prefix, capacity, at, bounds = np.concatenate(([0], np.cumsum(sizes))), smallest_capacity(sizes, shards), 0, []
    for left in range(shards, 1, -1):
        goal = prefix[at] + (prefix[-1] - prefix[at]) / left
        most = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
        end = int(np.searchsorted(prefix, goal))
        if end > at and end <= len(sizes) and goal - prefix[end - 1] < prefix[min(end, len(sizes))] - goal:
            end -= 1
        end = max(at, min(end, most))
        while end < most and not feasible(prefix, capacity, left - 1, end):
            end += 1
        bounds.append(end)
        at = end
    return np.searchsorted(np.array(bounds), np.arange(len(sizes)), side="right").astype(np.int32)


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """For docs (doc_id, text): doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the UTF-8 bytes of the text (null: none) plus 1. Equal texts share a shard (null with empty ones); sizes of shards are as
    near equal as the atoms allow. slot numbers a shard's rows from 0 without gaps, by atom, part and doc_id; rows of a large atom are dealt
    to its parts one by one, whatever their doc_id. Repeated rows get slots of their own; a null doc_id comes first in its part. Of a text of
    any length only its size and checksums leave the scan. Other columns are dropped. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 64 - ATOMS.bit_length() + 1).cast("int").alias("atom"))
    rows = save(rows.withColumn("row", F.monotonically_increasing_id()))  # written down, so the numbers stay
    counted = rows.groupBy("atom").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).toPandas().sort_values("atom")  # at most ATOMS rows
    large = counted["size"] > LARGE * counted["size"].sum() / shards
    counted = pd.concat([counted[large].sort_values(["size", "atom"], ascending=[False, True]), counted[~large]])
    counted["parts"] = np.maximum(1, -(-counted["rows"] // max(HOT_ROWS, int(counted["rows"].sum()) // MOST_PARTS)))
    counted["shard"] = cut(counted["size"].to_numpy(dtype=np.int64), shards)
    counted["base"] = counted.groupby("shard")["rows"].cumsum() - counted["rows"]
    places = spark.createDataFrame(counted[["atom", "shard", "base", "parts"]].astype({"atom": "int32", "shard": "int32", "base": "int64", "parts": "int32"}), "atom int, shard int, base long, parts int") if len(counted) else spark.createDataFrame([], "atom int, shard int, base long, parts int")
    placed = rows.join(F.broadcast(places), "atom").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))

    hot = placed.where("parts > 1").groupBy("atom", "part").agg(F.count("*").alias("n")).toPandas()  # at most 2 * MOST_PARTS rows
    hot = hot.sort_values(["atom", "part"])
    hot["before"] = hot.groupby("atom")["n"].cumsum() - hot["n"]
    offsets = spark.createDataFrame(pd.DataFrame({"atom": hot["atom"].astype("int32"), "part": hot["part"].astype("int32"), "before": hot["before"].astype("int64")}), "atom int, part int, before long") if len(hot) else spark.createDataFrame([], "atom int, part int, before long")
    number = F.row_number().over(W.Window.partitionBy("atom", "part").orderBy("doc_id", "row")) - 1
    out = placed.join(F.broadcast(offsets), ["atom", "part"], "left").withColumn("slot", (F.col("base") + F.coalesce("before", F.lit(0)) + number).cast("long"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
