"""Joins whose hot keys are cut into parts, so that no task gets more than a bounded number of one key's rows."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 256  # rows of one key in one part, at least
HOT_KEYS = 100_000  # a key is hot with more than a HOT_KEYS-th of all rows, so that there are fewer hot keys than this


def join_in_parts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined to right on key, without right's column n.

    right, a table that was written down, has one row for each key, whose column n says how many rows of the key left has at most. Left's
    rows of a hot key are dealt by a hash of the whole row to parts, to each of which right's row of that key is copied. Only the hot keys
    are broadcast: fewer than HOT_KEYS, whatever the tables. Without hot keys the join is a plain one. Null keys match nothing.
    """
    largest, total = right.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    most = max(HOT_ROWS, -(-total // HOT_KEYS))
    if largest <= most:
        return left.join(right.drop("n"), key)
    parts = F.greatest(F.ceil(F.col("n") / most), F.lit(1)).cast("int")
    taken = {c.lower() for c in (*left.columns, *right.columns)}
    number, several = (next(n for k in count() if (n := f"{name}{k}") not in taken) for name in ("part", "parts"))
    hot = right.where(F.col("n") > most).select(key, parts.alias(several))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn(number, F.pmod(F.xxhash64(*left.columns), F.coalesce(several, F.lit(1))).cast("int")).drop(several)
    copies = right.withColumn(number, F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return dealt.join(copies, [key, number]).drop(number)
