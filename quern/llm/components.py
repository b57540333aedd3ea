"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round is a grouped minimum, joined back to the edges, so no neighbour list is ever gathered: the centre of a large star is one
partly aggregated row, copied to the parts into which its edges are cut. The table of a round is deleted when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import discard, save
from quern.operators.skew import join_in_parts


ROWS_A_TASK = 100_000  # rows of a table of a round, where it has that many; small tables are a few files


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """edges (a, b) with a > b. Large: every larger neighbour goes to the least of the neighbourhood. Small: every smaller one does.

    The least of each neighbourhood is written down, so that plans stay small and its join may look at the sizes first.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = save(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n").coalesce(tasks))
    joined = join_in_parts(both, least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = save(out.where("a > b").distinct().coalesce(tasks))
    discard(least)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """For edges (a bigint, b bigint) in any direction, repeated or not: (node, component), component being the least node reachable.

    Loops are ignored; a node without an edge to another isn't returned. No edges: no rows.
    """
    edges, state = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not now[0] or now == state:
            break
        for large in (True, False):
            edges, old = _star(edges, large, max(8, -(-now[0] // ROWS_A_TASK))), edges
            discard(old)
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
