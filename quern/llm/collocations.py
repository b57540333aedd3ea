"""Op 13: phrase collocations, mined depth-first over position bitmaps.

Texts of a language are gathered into blocks, the shards. In a block each frequent word has a bitmap of the places where it stands, with an
empty place between two pieces. Bitmaps are compressed: only containers of CONTAINER places that have a bit are kept. A phrase's bitmap,
shifted by one place, ANDed with the bitmap of a word, is that of the longer phrase, whose popcount is the block's number of occurrences;
popcounts are summed over the blocks. All containers of many phrases are shifted and ANDed at once.

The threshold is one of the whole corpus, so a block can't apply it by itself. Words are counted first, and each block is told which of its
words are frequent; then pairs, and each block is told which of its pairs are. Longer phrases are found depth-first from there, a group of
first words at a time: a phrase is extended by a word only if its last pair is frequent. What a block is told is never more than what it has
sent, and a phrase has at most one row a block, so no key grows with the number of its occurrences and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.llm.scratch import bound_batches, discard, save
from quern.operators.listing import batch_number

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a candidate
ABSORBED = 80  # per cent of a phrase's occurrences that are inside one longer phrase
REPORTED = 2000  # phrases of a language
BLOCK_BYTES = 6 << 20
CONTAINER = 16  # places of a container
ROOT_ENTRIES = 1 << 17  # containers of first words that are extended at once
EXPANDED = 1 << 20  # pairs of containers that are ANDed at once
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, dtype=np.uint8)  # 0: in a word, 1: between words, 2: between pieces
_KIND[[9, 32]] = 1
_KIND[[*map(ord, ".,;:!?"), 10, 11, 12, 13]] = 2


def words_of(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The number of the word at each place, -1 at the places between pieces, and the words by their numbers."""
    data = _LOWER[np.frombuffer(b"\n".join([b"", *texts, b""]), dtype=np.uint8)]
    kind = _KIND[data]
    inside = kind == 0
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(~inside[1:] & inside[:-1]) + 1
    if not len(starts):
        return np.zeros(0, dtype=np.int32), pa.array([], type=pa.large_binary())
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(piece[1:] != piece[:-1])))
    stream = np.full(int(place[-1]) + 1, -1, dtype=np.int32)
    stream[place] = coded.indices.to_numpy()
    return stream, coded.dictionary


class Bitmaps:
    """Compressed bitmaps of the words of a stream, ordered by container, so that one container's words stand together."""

    def __init__(self, stream: np.ndarray):
        place = np.flatnonzero(stream >= 0)
        word, container = stream[place].astype(np.int64), place // CONTAINER
        self.n_words = int(word.max()) + 1 if len(word) else 0
        key = container * max(self.n_words, 1) + word
        order = np.argsort(key, kind="stable")
        key, bit = key[order], (1 << (place % CONTAINER)).astype(np.uint16)[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else order
        self.bits = np.bitwise_or.reduceat(bit, first) if len(key) else bit
        self.word, self.container = key[first] % max(self.n_words, 1), key[first] // max(self.n_words, 1)
        self.start = np.searchsorted(self.container, np.arange(len(stream) // CONTAINER + 3))

    def extended(self, container: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The given bitmaps' containers, shifted by one place and ANDed with the words': (which of the given, word, container, bits) of all
        that aren't empty."""
        moved, carried = (bits << np.uint16(1)).astype(np.uint16), bits >> np.uint16(CONTAINER - 1)
        whole, over = np.flatnonzero(moved), np.flatnonzero(carried)
        which = np.concatenate([whole, over])
        at, shifted = np.concatenate([container[whole], container[over] + 1]), np.concatenate([moved[whole], carried[over]])
        counts = self.start[at + 1] - self.start[at]
        ends, k = np.cumsum(counts), 0
        while k < len(at):
            upto = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + EXPANDED, side="right")))
            some = counts[k:upto]
            owner = np.repeat(np.arange(k, upto), some)
            entry = np.arange(len(owner)) + np.repeat(self.start[at[k:upto]] - (np.cumsum(some) - some), some)
            both = shifted[owner] & self.bits[entry]
            hit = np.flatnonzero(both)
            owner, entry = owner[hit], entry[hit]
            yield which[owner], self.word[entry], at[owner], both[hit]
            k = upto

    def roots(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, container, bits) of groups of words, each with all its containers."""
        order = np.argsort(self.word, kind="stable")
        word, k = self.word[order], 0
        while k < len(word):
            upto = int(np.searchsorted(word, word[min(k + ROOT_ENTRIES, len(word)) - 1], side="right"))
            some = order[k:upto]
            yield word[k:upto], self.container[some], self.bits[some]
            k = upto


def _joined(parts: list[tuple[np.ndarray, ...]], n: int) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.int64)] * n


def _counted(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each row's number among them, and their popcounts."""
    distinct, number = np.unique(key, return_inverse=True)
    return distinct, number, np.bincount(number, weights=np.bitwise_count(bits), minlength=len(distinct)).astype(np.int64)


def pair_counts(maps: Bitmaps) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word * n_words + second word, occurrences) of all pairs."""
    for word, container, bits in maps.roots():
        key, found = _joined([(word[which] * maps.n_words + second, both) for which, second, _, both in maps.extended(container, bits)], 2)
        distinct, _, n = _counted(key, found.astype(np.uint16))
        yield distinct, n


def longer_counts(maps: Bitmaps, pairs: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of words, occurrences) of the phrases of three words and more whose pairs are all among pairs, sorted keys as in pair_counts()."""

    def frequent(key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
        return pairs[at] == key if len(pairs) else np.zeros(len(key), dtype=bool)

    for word, container, bits in maps.roots():
        phrases, number = word[:, None], np.arange(len(word))  # of each bitmap, and the bitmap of each container
        for size in range(2, longest + 1):
            parts = []
            for which, last, at, both in maps.extended(container, bits):
                ok = np.flatnonzero(frequent(phrases[number[which], -1] * maps.n_words + last))
                parts.append((number[which[ok]], last[ok], at[ok], both[ok]))
            before, last, container, bits = _joined(parts, 4)
            bits = bits.astype(np.uint16)
            if not len(before):
                break
            if size == 2:  # a word has one bitmap, whatever number its containers have
                distinct, number, n = _counted(phrases[before, 0] * maps.n_words + last, bits)
                phrases = np.stack([distinct // maps.n_words, distinct % maps.n_words], axis=1)
            else:
                distinct, number, n = _counted(before * maps.n_words + last, bits)
                phrases = np.concatenate([phrases[distinct // maps.n_words], (distinct % maps.n_words)[:, None]], axis=1)
                yield phrases, n


def _packed(stream: np.ndarray) -> bytes:
    """A stream's numbers from -1 as planes of their bytes: the upper ones are nearly all 0, and compress to nearly nothing."""
    return np.ascontiguousarray((stream + 1).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int32) - 1


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of docs (lang, text): lang, words (of all occurrences), stream, vocabulary and the occurrences of each of its words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def made(lang: str) -> pd.DataFrame:
            stream, words = words_of(waiting.pop(lang))
            counts = np.bincount(stream[stream >= 0], minlength=len(words))
            return pd.DataFrame({"lang": [lang], "words": [int(counts.sum())], "stream": [_packed(stream)], "vocabulary": [words.to_pylist()], "counts": [counts]})

        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                if not text:
                    continue
                if lang in waiting and size[lang] + len(text) > BLOCK_BYTES:
                    yield made(lang)
                if lang not in waiting:
                    waiting[lang], size[lang] = [], 0
                waiting[lang].append(bytes(text))
                size[lang] += len(text) + 1
                if len(waiting) > 64:  # languages with little text each
                    yield made(max(waiting, key=size.__getitem__))
        for lang in list(waiting):
            yield made(lang)

    return docs.mapInPandas(run, "lang string, words long, stream binary, vocabulary array<binary>, counts array<long>")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, reported: int = REPORTED, absorbed: int = ABSORBED) -> DataFrame:
    """The best phrases of each language of docs (lang, text): lang, rank (from 1), phrase, a, l, r, n, score.

    A-Z are lowered; pieces end at `[.,;:!?\\x0A-\\x0D]`, words are `[^\\x20\\x09]+`. a counts a phrase's occurrences within pieces,
    overlaps included; of its cuts in two, with l and r occurrences of the parts, the one with the lowest score floor(2000000 a / (l + r))
    counts, the first of equal ones. n counts all words of the language. Phrases of 2 to `longest` words and `least` occurrences are
    candidates; one of whose occurrences `absorbed` per cent or more are inside one longer candidate is dropped. `reported` of each
    language come by score and a, largest first, then by phrase in the order of UTF-8 bytes.

    A null lang is `und`; null and empty texts have no words. Rows count each, repeated ones too; other columns are dropped. A text longer
    than a block is a block of its own. An empty table gives no rows.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words and one occurrence at least")
    bound_batches(docs.sparkSession)
    lean = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    blocks = save(_blocks(lean).withColumn("block", F.monotonically_increasing_id()))
    own = blocks.select("block", "lang", F.posexplode(F.arrays_zip("vocabulary", "counts")).alias("place", "x")).select("block", "lang", "place", F.col("x.vocabulary").alias("word"), F.col("x.counts").alias("f"))
    often = own.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least).withColumn("rarity", -F.col("f"))
    # frequent words get small numbers, which take few bytes in an exchange
    words = save(batch_number(save(often), "rarity").select("lang", "word", "f", F.col("place").cast("long").alias("id")))
    v = words.count() + 1  # ids are from 1; a pair is one number, first * v + second, which takes fewer bytes in an exchange than two
    told = own.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("known"))

    def only_frequent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, stream, places, ids in zip(frame["block"], frame["stream"], frame["places"], frame["ids"], strict=True):
                stream, places = _unpacked(stream), np.asarray(places, dtype=np.int64)
                number = np.full(max(int(stream.max(initial=-1)) + 2, 1), -1, dtype=np.int32)
                number[places] = np.arange(len(places))
                yield pd.DataFrame({"block": [block], "stream": [_packed(number[stream])], "ids": [np.asarray(ids, dtype=np.int64)]})  # -1 takes the last, which is -1

    met = blocks.select("block", "stream").join(told, "block").select("block", "stream", F.col("known.place").alias("places"), F.col("known.id").alias("ids"))
    ready = save(met.mapInPandas(only_frequent, "block long, stream binary, ids array<long>"))
    n = save(blocks.groupBy("lang").agg(F.sum("words").alias("n")))
    discard(blocks)

    def pairs_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, stream, ids in zip(frame["block"], frame["stream"], frame["ids"], strict=True):
                maps = Bitmaps(_unpacked(stream))
                for key, n in pair_counts(maps):
                    yield pd.DataFrame({"pair": ids[key // maps.n_words] * v + ids[key % maps.n_words], "block": block, "f": n})

    # a pair has one row a block: its rows are summed and known to be frequent in one exchange, and those that are go back to their blocks
    sent = ready.mapInPandas(pairs_of, "pair long, block long, f long")
    pairs = save(sent.withColumn("f", F.sum("f").over(W.Window.partitionBy("pair"))).where(F.col("f") >= least))
    phrases = pairs.groupBy("pair").agg(F.max("f").alias("f")).select(F.array(F.expr(f"pair div {v}"), F.col("pair") % v).alias("ids"), "f")

    if longest > 2:
        columns = [f"w{k}" for k in range(longest)]  # -1 after a phrase's end

        def longer_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for stream, ids, told in zip(frame["stream"], frame["ids"], frame["told"], strict=True):
                    maps, order = Bitmaps(_unpacked(stream)), np.argsort(ids, kind="stable")
                    number = lambda x: order[np.searchsorted(ids, x, sorter=order)]  # noqa: B023, E731
                    told = np.asarray(told, dtype=np.int64)
                    for found, counts in longer_counts(maps, np.sort(number(told // v) * maps.n_words + number(told % v)), longest):
                        yield pd.DataFrame({c: ids[found[:, k]] if k < found.shape[1] else np.int64(-1) for k, c in enumerate(columns)} | {"f": counts})

        back = pairs.groupBy("block").agg(F.collect_list("pair").alias("told"))
        longer = ready.join(back, "block").select("stream", "ids", "told").mapInPandas(longer_of, ", ".join(f"{c} long" for c in columns) + ", f long")
        longer = longer.groupBy(*columns).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        phrases = phrases.unionByName(longer.select(F.filter(F.array(*columns), lambda x: x >= 0).alias("ids"), "f"))
    phrases = save(phrases)
    discard(ready)
    discard(pairs)
    best = _ranked(phrases, words, reported, absorbed)
    out = save(best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    for done in (n, words, phrases):
        discard(done)
    return out


def _ranked(phrases: DataFrame, words: DataFrame, reported: int, absorbed: int) -> DataFrame:
    """From phrases (ids, f) of two words and more and words (lang, word, f, id): lang, rank, phrase, a, l, r, score."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    parts = phrases.unionByName(words.select(F.array("id").alias("ids"), "f"))
    cut = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cut = cut.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right"))
    cut = cut.join(parts.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    cut = cut.withColumn("wide_a", wide("a")).withColumn("both", wide("l") + wide("r")).withColumn("score", F.expr("(cast(2000000 as decimal(8,0)) * wide_a) div both"))
    scored = cut.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("ids", "a", "x.l", "x.r", "x.score")
    # whatever longer candidate holds a phrase, one that is longer by one word holds it too, and occurs as often
    inner = F.explode(F.array(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1)))
    around = phrases.where(F.size("ids") > 2).select(inner.alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("most"))
    stays = scored.join(around, "ids", "left").where(F.col("most").isNull() | (100 * wide("most") < absorbed * wide("a"))).drop("most")
    stays = stays.join(words.select(F.col("id").alias("first"), "lang"), F.col("ids")[0] == F.col("first")).drop("first")
    # those that may be reported, with all that are equal in score and occurrences; only these get their words
    top = stays.withColumn("rank", F.rank().over(W.Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("rank") <= reported).drop("rank")
    spelled = top.select("ids", F.posexplode("ids").alias("place", "id")).join(words.select("id", F.col("word").cast("string").alias("word")), "id")
    spelled = spelled.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = W.Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    named = top.join(spelled, "ids").withColumn("rank", F.row_number().over(order).cast("long"))
    return named.where(F.col("rank") <= reported).select("lang", "rank", "phrase", "a", "l", "r", "score")
