"""Op 2: near-duplicates by HyperMinHash sketches, banding and exact verification.

A text's set holds the hashes of its distinct shingles of five words. The hash's top bits choose a bucket; the smallest remainder of a
bucket is kept as its count of leading zeros (6 bits) and the MANTISSA bits below the leading one: 12 bits instead of 56. Bands of ROWS
registers propose candidates; the collision-corrected estimate drops hopeless pairs; the full sets decide.

Equal sets are one class, represented by its smallest doc_id. Classes that share a band, directly or through others, form a family,
found with star joins. A family of at most BLOCK classes is compared in one task, one of up to FAMILY blocks in a task for each two blocks:
a bounded number of comparisons for each class. Larger families are first connected in linear work, each block within itself and with
LEADERS classes of the family; then whatever shares a band with classes that it isn't connected to is compared with these, band by band
and block by block: of a group's largest part and the rest, only the rest with all. Every task has at most two blocks and emits a
spanning forest of its verified links. No pair that shares a band is skipped unless both sides are known to be linked already, or their
estimate lies six standard deviations below the limit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import connected_components
from quern.llm.scratch import bound_batches, discard, save
from quern.llm.words import mix, word_hashes
from quern.operators.skew import join_in_parts

WORDS = 5
BITS = 8
BUCKETS = 1 << BITS
ROWS = 6
BANDS = BUCKETS // ROWS  # a pair at the limit of 0.85 shares no band with probability 2e-9
MANTISSA = 6
EMPTY = np.uint16(0xFFFF)
BLOCK = 1024
FAMILY = 16
LEADERS = 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Fewer than five words: the whole sequence as one. No words: empty."""
    hashes, offsets = word_hashes(texts)
    n = len(hashes) - WORDS + 1
    full = mix(sum(hashes[k : k + n] * _ODD[k] for k in range(WORDS))) if n > 0 else hashes[:0]
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(full[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * _ODD[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(full[:0])
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The compressed sketches, a row of BUCKETS registers for each sorted set."""
    shift = np.uint64(64 - BITS)
    edges = np.arange(BUCKETS, dtype=np.uint64) << shift
    low = np.full((len(sets), BUCKETS), 0, dtype=np.uint64)
    filled = np.zeros((len(sets), BUCKETS), dtype=bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            ok = at < len(s)
            v = s[np.minimum(at, len(s) - 1)]
            filled[i] = ok & (v >> shift == np.arange(BUCKETS, dtype=np.uint64))
            low[i] = v & ((np.uint64(1) << shift) - np.uint64(1))
    width = 64 - BITS
    length = np.frexp((low >> np.uint64(5)).astype(np.float64))[1] + 5  # 52 bits are exact in a double
    zeros = (width - length).astype(np.uint64)
    body = (low << (zeros + np.uint64(BITS + 1))) >> np.uint64(64 - MANTISSA)  # below the leading one
    return np.where(filled, zeros << np.uint64(MANTISSA) | body, np.uint64(EMPTY)).astype(np.uint16)


_DONORS = np.random.Generator(np.random.PCG64(7)).integers(0, BUCKETS, (4096, BUCKETS))


def densified(sketch: np.ndarray) -> np.ndarray:
    """Empty registers take the value of the first filled one in a fixed random sequence of their own (optimal densification).

    So two short texts share a register about as often as their sets overlap, and not whenever both are empty there.
    """
    out = sketch.copy()
    open_rows = np.flatnonzero((sketch == EMPTY).any(axis=1) & (sketch != EMPTY).any(axis=1))
    for donors in _DONORS:
        if not len(open_rows):
            break
        own = out[open_rows]
        own = np.where(own == EMPTY, sketch[open_rows][:, donors], own)
        out[open_rows] = own
        open_rows = open_rows[(own == EMPTY).any(axis=1)]
    return out


def band_keys(sketch: np.ndarray) -> list[np.ndarray]:
    """Keys of the bands of each sketch; none of an empty one."""
    parts = densified(sketch)[:, : BANDS * ROWS].reshape(len(sketch), BANDS, ROWS)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sketch), BANDS))
    for k in range(ROWS):
        keys = mix(keys * _ODD[1] + parts[:, :, k].astype(np.uint64) + np.uint64(1))
    some = (sketch != EMPTY).any(axis=1)
    return [k.view(np.int64) if s else k[:0].view(np.int64) for k, s in zip(np.ascontiguousarray(keys), some, strict=True)]


def octaves(sizes: np.ndarray) -> np.ndarray:
    """For sets of these sizes, the probability that a bucket is filled and its least remainder has 0, 1, 2 ... leading zeros."""
    ends = np.append(np.exp2(-np.arange(64 - BITS, dtype=float)), 0.0)
    return np.diff(np.exp(-sizes[:, None] / BUCKETS * ends[None, :]), axis=1)


def estimate(one: np.ndarray, many: np.ndarray, chances: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of one sketch with many, and how many registers they rest on.

    chances: octaves() of the one set and of the many. Registers of different minima agree where both fall into one octave and, within
    it, share all mantissa bits; that share of the registers that agree is taken off.
    """
    either = ((one != EMPTY) | (many != EMPTY)).sum(axis=1)
    equal = ((many == one) & (one != EMPTY)).sum(axis=1)
    chance = BUCKETS * 2.0**-MANTISSA * (chances[1] @ chances[0]) if chances else 0.0
    return (equal - chance) / np.maximum(either - chance, 1e-9), either


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b|, on full sorted sets."""
    common = len(a) + len(b) - len(np.union1d(a, b))
    return bool(len(a)) and bool(len(b)) and 100 * common >= percent * (len(a) + len(b) - common)


def verified_forest(ids: np.ndarray, sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets. side: pairs within side 0 or within side 1 are another task's, unless it is None."""
    sketch, sizes, parent = registers(sets), np.array([len(s) for s in sets]), list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    level, found, spread = percent / 100, [], octaves(sizes)
    for i in range(len(ids) - 1):
        near, either = estimate(sketch[i], sketch[i + 1 :], (spread[i], spread[i + 1 :]))
        small, large = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        maybe = (near >= level - 6 * np.sqrt(level * (1 - level) / np.maximum(either, 1))) & (100 * small >= percent * large)
        if side is not None:
            maybe &= side[i + 1 :] != side[i]
        later = np.flatnonzero(maybe)
        for j in (later[np.argsort(-near[later], kind="stable")] + i + 1).tolist():
            if (a := root(i)) != (b := root(j)) and linked(sets[i], sets[j], percent):
                parent[b] = a
                found.append((int(ids[i]), int(ids[j])))
    return found


def _large_families(large: DataFrame, classes: DataFrame, compared: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) of families of over FAMILY blocks: large has (node, component, n)."""
    zero = F.lit(0)
    dealt = large.select("node", "component", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), "blocks").cast("int"))
    own = dealt.select(F.col("component").alias("one"), F.col("block").alias("two"), zero.alias("three"), zero.alias("side"), F.col("node").alias("class_id"))
    leads = dealt.where(F.pmod(F.xxhash64("node", F.lit(11)), F.ceil(F.col("n") / LEADERS)) == 0)
    leaders = leads.select(F.col("component").alias("one"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("two"), zero.alias("three"), zero.alias("side"), F.col("node").alias("class_id"))
    links = save(compared(own.unionByName(leaders).distinct()))
    found = connected_components(links)
    bands = classes.join(large.select(F.col("node").alias("class_id")), "class_id", "left_semi").select("class_id", F.explode("bands").alias("key"))
    named = save(bands.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("part", F.coalesce("component", "class_id")).drop("component"))
    parts = named.groupBy("key", "part").agg(F.count("*").alias("size"))
    groups = parts.groupBy("key").agg(F.max_by("part", F.struct("size", "part")).alias("bulk"), F.sum("size").alias("n"), F.max("size").alias("most")).where("most < n")
    groups = save(groups.withColumn("rests", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    members = save(join_in_parts(named, groups.drop("most"), "key"))
    place = lambda seed, n: F.pmod(F.xxhash64("class_id", F.lit(seed)), n).cast("int")
    each = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    rest = members.where("part <> bulk").select(F.col("key").alias("one"), place(9, "rests").alias("two"), each("blocks").alias("three"), F.lit(1).alias("side"), "class_id")
    everything = members.select(F.col("key").alias("one"), each("rests").alias("two"), place(5, "blocks").alias("three"), F.lit(2).alias("side"), "class_id")
    return links.unionByName(compared(rest.unionByName(everything)))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """For docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two texts are linked when 100 * intersection >= percent * union of their shingle sets. component_id is the smallest doc_id reachable
    over links; kept marks that row. Null or word-less text has an empty set and is linked with nothing. Repeated doc_ids are rows of one
    id: their texts' links meet in that id. A null doc_id takes part in no link, and its row has a null component_id and kept true. Other
    columns are dropped. A text of any length is one set of 8 bytes a shingle. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))

    def sketches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = shingle_sets(list(frame["text"]))
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "n_shingles": [len(s) for s in sets], "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "bands": band_keys(registers(sets))})

    base = save(docs.mapInPandas(sketches, "doc_id long, n_shingles long, digest binary, bands array<long>"))
    some = base.where("n_shingles > 0 and doc_id is not null")
    # one row of a class from each task, so that a class with a third of all rows isn't shuffled row by row
    classes = save(some.groupBy("digest").agg(F.min(F.struct("doc_id", "bands")).alias("least"), F.count("*").alias("n")).select("digest", F.col("least.doc_id").alias("class_id"), F.col("least.bands").alias("bands"), "n"))
    bands = classes.select("class_id", F.explode("bands").alias("key"))
    least = F.min("class_id").alias("first")
    shared = save(bands.groupBy("key").agg(least, F.max("class_id").alias("last"), F.count("*").alias("n")).where("first < last").select("key", "first", "n"))
    families = save(connected_components(join_in_parts(bands, shared, "key").where("class_id <> first").select(F.col("class_id").alias("a"), F.col("first").alias("b")).distinct()))
    discard(shared)
    sizes = save(families.groupBy("component").agg(F.count("*").alias("n")).withColumn("size", F.col("n")))
    sized = join_in_parts(families, sizes, "component").withColumnRenamed("size", "n")

    def sets_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"class_id": frame["doc_id"].array, "shingles": [s.tobytes() for s in shingle_sets(list(frame["text"]))]})

    full = docs.join(families.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInPandas(sets_of, "class_id long, shingles binary")

    def forest(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["class_id", "side"], kind="stable")
        side = frame["side"].to_numpy() if frame["side"].max() > 0 else None
        pairs = verified_forest(frame["class_id"].to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in frame["shingles"]], percent, side)
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    def compared(tasks: DataFrame) -> DataFrame:
        """Forests of tasks (one, two, three, side, class_id); of two sides, only pairs across are compared."""
        return tasks.join(full, "class_id").groupBy("one", "two", "three").applyInPandas(forest, "a long, b long")

    zero = F.lit(0)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    mine = sized.where(F.col("n") <= FAMILY * BLOCK).select("node", "component", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pairs = mine.select("node", "component", "block", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    links = compared(pairs.select(F.col("component").alias("one"), F.least("block", "other").alias("two"), F.greatest("block", "other").alias("three"), side.alias("side"), F.col("node").alias("class_id")))
    if sizes.where(F.col("n") > FAMILY * BLOCK).limit(1).count():
        links = links.unionByName(_large_families(save(sized.where(F.col("n") > FAMILY * BLOCK)), classes, compared))
    # a doc_id with several texts ties their classes together
    several = some.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).where("one <> other")
    ties = some.select("doc_id", "digest").join(several, "doc_id", "left_semi").join(classes.select("digest", "class_id"), "digest").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    found = connected_components(links.unionByName(ties))
    one = found.groupBy("node").agg(F.min("component").alias("component"))
    named = save(classes.join(one, classes["class_id"] == one["node"], "left").select("digest", F.coalesce("component", "class_id").alias("component_id"), "n"))
    alone = base.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = join_in_parts(some.select("doc_id", "n_shingles", "digest"), named, "digest").select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays. Columns stay as they are."""
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
