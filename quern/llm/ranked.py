"""Op 12: ranked lexical search of many items, as a threshold-seeded join.

Documents are read once: each keeps the places (in the sorted list of the items' terms) and counts of the terms that items ask for. A
term's impact on a document is its share of the score. For each term the K largest impacts are stored, with their documents: the Kth of
them, times the term's repeats in an item, is a lower bound of the item's Kth score, and the documents behind the best such bound are
scored exactly, which raises it. An item's terms are put in order of the most that each can add; those at the end of that order whose
bounds together stay below the threshold are pruned, since a document that has only them can't be among the K best. Documents that have
one of the others are candidates; a candidate whose score by these terms and the bound of the pruned ones reach the threshold is scored
exactly. Every task sends at most K rows an item.

Items are dealt to blocks of about PAIRS (item, term) pairs, whose terms and bounds are small enough to go to every task; each block reads
the documents' table anew, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.llm.scratch import bound_batches, discard, save

K = 20
PAIRS = 200_000  # (item, term) pairs of a block, about
CELLS = 2_000_000  # scores (document, item) that are in memory at once
POSTINGS = 1_000_000  # postings that are in memory at once, with their partners
TEXT_BYTES = 4 << 20
#: Terms are runs of these bytes after A-Z are lowered: letters and digits of ASCII, and all that isn't ASCII.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts, and how many each text has. None counts as empty."""
    split = [(t or b"").translate(_TO_TERMS).split() for t in texts]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    return pa.array([w for s in split for w in s], type=pa.large_binary()), sizes


def text_batches(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about TEXT_BYTES."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or b"") > TEXT_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(text or b"")
    if begin < len(texts):
        yield begin, len(texts)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, words: np.ndarray, n_docs: int, all_words: int) -> np.ndarray:
    """What a term of this weight and count adds to the score of a document of so many words."""
    m = 75 + (25 * words * n_docs) // max(all_words, 1)
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes, the number of each member's group and its place there."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Items:
    """A block of items: each one's terms with their repeats, looked up by term.

    item, term, repeats: the pairs; most: of each term, the largest impact. prune() says which pairs are needed to find candidates.
    """

    def __init__(self, item: np.ndarray, term: np.ndarray, repeats: np.ndarray, n_items: int, most: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.item, self.term, self.repeats, self.n, self.most = item[order], term[order], repeats[order], n_items, most
        self.first = np.searchsorted(self.term, np.arange(len(most) + 1))
        self.floor = np.zeros(n_items, dtype=np.int64)
        self.prune(self.floor)

    def prune(self, floor: np.ndarray) -> None:
        """floor: of each item, a score that its Kth document reaches. Pairs whose bounds, smallest first, sum to less are pruned."""
        self.floor = np.maximum(floor, 1)  # only scores above 0 count
        bound = self.repeats * self.most[self.term]
        order = np.lexsort((bound, self.item))
        sums = np.cumsum(bound[order])
        starts = np.searchsorted(self.item[order], np.arange(self.n))
        base = np.concatenate(([0], sums))[starts][self.item[order]] if len(order) else sums
        self.needed = np.ones(len(order), dtype=bool)
        self.needed[order] = sums - base >= self.floor[self.item[order]]
        self.rest = np.zeros(self.n, dtype=np.int64)
        np.add.at(self.rest, self.item[~self.needed], bound[~self.needed])
        self.small = bool(sums[-1] < 1 << 53) if len(sums) else True

    def sums(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, use: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
        """The scores (document, item) by the pairs in use, of the cells in only."""
        out = np.zeros(n_docs * self.n, dtype=float if self.small else np.int64)
        counts = self.first[term + 1] - self.first[term]
        ends = np.cumsum(counts)
        at = 0
        while at < len(term):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POSTINGS, side="right")))
            owner, place = spread(counts[at:upto])
            pair = self.first[term[at:upto]][owner] + place
            owner = owner + at
            ok = use[pair]
            cell = doc[owner[ok]] * self.n + self.item[pair[ok]]
            value = impact[owner[ok]] * self.repeats[pair[ok]]
            if only is not None:
                inside = only[cell]
                cell, value = cell[inside], value[inside]
            if self.small:  # sums below 2^53 are exact in a double
                out += np.bincount(cell, weights=value, minlength=len(out))
            else:
                np.add.at(out, cell, value)
            at = upto
        return out

    def best(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, score) of all that reach the floor: candidates by the needed terms, then scored exactly."""
        part = self.sums(doc, term, impact, n_docs, self.needed)
        maybe = (part > 0) & (part + np.tile(self.rest, n_docs) >= np.tile(self.floor, n_docs))
        some = maybe.reshape(n_docs, self.n).any(axis=1)[doc]
        part += self.sums(doc[some], term[some], impact[some], n_docs, ~self.needed, maybe)
        found = np.flatnonzero(maybe & (part >= np.tile(self.floor, n_docs)))
        return found // self.n, found % self.n, part[found].astype(np.int64)


def first_of(group: np.ndarray, *order: np.ndarray, k: int = K) -> np.ndarray:
    """Places of the k first rows of each group, by `order`, the most important last."""
    by = np.lexsort((*order, group))
    sorted_ = group[by]
    starts = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(by) else by
    return by[np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by)))) < k]


def _flat(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the frame, term, count) of all postings."""
    terms, counts = ([np.frombuffer(x, dtype="<i4") for x in frame[c]] for c in ("terms", "counts"))
    doc = np.repeat(np.arange(len(frame)), [len(t) for t in terms])
    none = np.zeros(0, dtype="<i4")
    return doc, np.concatenate([*terms, none]).astype(np.int64), np.concatenate([*counts, none]).astype(np.int64)


def _search(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best documents of each item of one block: asked (row, term, repeats), docs (row, doc_id, text)."""
    pairs = asked.toPandas()  # a block
    vocabulary, term = np.unique(pairs["term"].to_numpy(dtype=object), return_inverse=True) if len(pairs) else (np.zeros(0, dtype=object), np.zeros(0, dtype=np.int64))
    rows, item = np.unique(pairs["row"].to_numpy(), return_inverse=True)
    n_terms, values = len(vocabulary), [bytes(v) for v in vocabulary]

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = pa.array(values, type=pa.large_binary())
        for frame in frames:
            texts = list(frame["text"])
            for a, b in text_batches(texts):
                terms, sizes = terms_of(texts[a:b])
                at = pc.index_in(terms, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                key = (np.repeat(np.arange(b - a), sizes) * n_terms + at)[at >= 0]
                key, counts = np.unique(key, return_counts=True)
                ends = np.searchsorted(key, np.arange(1, b - a) * n_terms)
                part = lambda x: [p.astype("<i4").tobytes() for p in np.split(x, ends)]
                yield pd.DataFrame({"row": frame["row"].iloc[a:b].array, "doc_id": frame["doc_id"].iloc[a:b].array, "words": sizes, "terms": part(key % max(n_terms, 1)), "counts": part(counts)})

    known = save(docs.mapInPandas(index, "row long, doc_id long, words long, terms binary, counts binary"))
    told = known.agg(F.count_if(F.col("words") > 0), F.coalesce(F.sum("words"), F.lit(0))).first()
    n_docs, all_words = int(told[0]), int(told[1])

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_terms, dtype=np.int64)
        for frame in frames:
            total += np.bincount(_flat(frame)[1], minlength=n_terms)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "df": total[at]})

    df = known.select("terms", "counts").mapInPandas(held, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    weights = np.zeros(n_terms, dtype=np.int64)
    weights[df["term"].to_numpy()] = [weight(n_docs, int(x)) for x in df["df"]]

    def scored(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, terms, counts = _flat(frame)
        return doc, terms, impacts(weights[terms], counts, frame["words"].to_numpy()[doc], n_docs, all_words)

    def largest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [np.zeros(0, dtype=np.int64)] * 3
        for frame in frames:
            doc, terms, value = scored(frame)
            joined = [np.concatenate(x) for x in zip(kept, (terms, value, frame["row"].to_numpy()[doc]), strict=True)]
            stays = first_of(joined[0], joined[2], -joined[1], k=k)
            kept = [x[stays] for x in joined]
        yield pd.DataFrame(dict(zip(("term", "impact", "row"), kept, strict=True)))

    rank = F.row_number().over(W.Window.partitionBy("term").orderBy(F.desc("impact"), "row"))
    top = save(known.select("row", "words", "terms", "counts").mapInPandas(largest, "term long, impact long, row long").withColumn("place", rank).where(F.col("place") <= k))
    bounds = top.groupBy("term").agg(F.max("impact").alias("most"), F.max(F.when(F.col("place") == k, F.col("impact"))).alias("kth")).toPandas()
    most, kth = np.zeros(n_terms, dtype=np.int64), np.zeros(n_terms, dtype=np.int64)
    most[bounds["term"].to_numpy()], kth[bounds["term"].to_numpy()] = bounds["most"], bounds["kth"].fillna(0).astype(np.int64)

    items = Items(item, term, pairs["repeats"].to_numpy(dtype=np.int64), len(rows), most)
    lower = items.repeats * kth[items.term]
    floor = np.zeros(items.n, dtype=np.int64)
    np.maximum.at(floor, items.item, lower)
    items.prune(floor)

    def search(model: Items, table: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("item", "score")} | {"doc_id": pd.array([], dtype="Int64")})
            step = max(1, CELLS // max(model.n, 1))
            for frame in frames:
                for at in range(0, len(frame), step):
                    some = frame.iloc[at : at + step]
                    doc, which, score = model.best(*scored(some), len(some))
                    new = pd.DataFrame({"item": which, "score": score, "doc_id": some["doc_id"].astype("Int64").array[doc]})
                    kept = pd.concat([kept, new], ignore_index=True)
                    last = kept["doc_id"].isna().to_numpy()
                    kept = kept.iloc[first_of(kept["item"].to_numpy(), kept["doc_id"].fillna(0).to_numpy(dtype=np.int64), last, -kept["score"].to_numpy(), k=k)]
            yield kept

        best = table.mapInPandas(run, "item long, score long, doc_id long")
        order = W.Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # the documents behind each item's best bound, scored exactly, raise the threshold
    pick = np.lexsort((-lower, items.item))
    seeds = np.unique(items.term[pick[np.concatenate(([True], np.diff(items.item[pick]) > 0))]]) if len(pick) else []
    behind = top.join(F.broadcast(asked.sparkSession.createDataFrame(pd.DataFrame({"term": np.asarray(seeds, dtype=np.int64)}), "term long")), "term").select("row").distinct()
    again = search(items, known.join(behind, "row", "left_semi")).where(F.col("rank") == k).select("item", "score").toPandas()
    floor[again["item"].to_numpy()] = np.maximum(floor[again["item"].to_numpy()], again["score"].to_numpy())
    items.prune(floor)
    numbers = asked.sparkSession.createDataFrame(pd.DataFrame({"item": np.arange(len(rows)), "row": rows}), "item long, row long")  # a block
    found = save(search(items, known).join(F.broadcast(numbers), "item").select("row", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    discard(known)
    discard(top)
    return found


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, pairs: int = PAIRS) -> DataFrame:
    """The k best documents (doc_id, text) of each item (item_id, text): item_id, rank (from 1), doc_id, score.

    Terms are runs of ASCII letters and digits and of all that isn't ASCII, A-Z lowered. A score sums, over the item's terms with their
    repeats, w * ((10^9 tf) div (1000 tf + 12 m)), w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 75 + (25 n N) div L, in 64-bit integers;
    N documents have a term, L is the number of their terms. Only scores above 0 count; equal ones come by ascending doc_id, null last.
    Null and empty texts have no terms and get no rows. Every row is an item or a document of its own, repeated ids too; other columns are
    dropped. Empty tables give no rows. pairs: (item, term) pairs of a block of items.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    numbered = save(items.select(F.col("item_id"), F.col("text").cast("binary").alias("text")).withColumn("row", F.monotonically_increasing_id()))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = list(frame["text"])
            for a, b in text_batches(own):
                terms, sizes = terms_of(own[a:b])
                each = pd.DataFrame({"row": np.repeat(frame["row"].to_numpy()[a:b], sizes), "term": terms.to_numpy(zero_copy_only=False)})
                yield each.groupby(["row", "term"], sort=False).size().rename("repeats").reset_index()

    asked = save(numbered.select("row", "text").mapInPandas(split, "row long, term binary, repeats long"))
    n = asked.count()
    if not n:
        return items.select("item_id").limit(0).selectExpr("item_id", "cast(null as int) as rank", "cast(null as long) as doc_id", "cast(null as long) as score")
    blocks = -(-n // pairs)
    place = F.pmod(F.xxhash64("row"), F.lit(blocks))
    found = [_search(texts, asked.where(place == b) if blocks > 1 else asked, k) for b in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.join(numbered.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
