"""Op 11: documents packed into training sequences along a space-filling curve.

A document's tokens are hashed into a vector, which a fixed random matrix projects to few dimensions; scaled by the corpus's own means and
deviations, the point lies in a cell of a grid, and the cell's place on the Hilbert curve is the document's key. Documents are sorted by
that key in ranges, with a hash behind it, so that copies of one text, however many, don't share a range; the token counts of the ranges
before it and of the documents before it in its range place each document in one stream of tokens. The stream is cut every `length`
tokens: neighbours on the curve share sequences. What is left at its end is cut at powers of two, so that nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quern.llm.bpe import batches, load
from quern.llm.scratch import bound_batches, discard, save
from quern.llm.words import mix

LENGTH = 2048
END = 1  # the id that ends each document
FEATURES = 512  # of a hashed vector
DIMENSIONS, GRID_BITS = 4, 10  # of the curve
ROWS = 2000  # documents whose vectors are in memory at once
_MATRIX = np.random.Generator(np.random.PCG64(11)).standard_normal((FEATURES, DIMENSIONS)).astype(np.float32)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells, a row of coordinates below 2^bits each; coordinates times bits at most 62 (Skilling, 2004)."""
    axes = [c.astype(np.int64) for c in cells.T]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(axes)):
            turned = (axes[i] & q) != 0
            swapped = np.where(turned, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = axes[0] ^ np.where(turned, low, swapped)
            axes[i] = axes[i] ^ swapped
        q >>= 1
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip, q = np.zeros(len(cells), dtype=np.int64), top
    while q > 1:
        flip ^= np.where(axes[-1] & q, q - 1, 0)
        q >>= 1
    key = np.zeros(len(cells), dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for a in axes:
            key = key << 1 | ((a ^ flip) >> bit & 1)
    return key


def projected(documents: list[np.ndarray], matrix: np.ndarray = _MATRIX) -> np.ndarray:
    """A row of coordinates for each document's ids: its hashed vector, damped and of length one, times the matrix. Empty: zeros."""
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    flat = np.concatenate([*documents, np.zeros(0, dtype=np.uint32)])
    known, at = np.unique(flat, return_inverse=True) if len(flat) < 1000 else (np.arange(int(flat.max()) + 1), flat)
    hashed = mix(known.astype(np.uint64) + np.uint64(1))
    place, sign = (hashed % np.uint64(FEATURES)).astype(np.int64), np.where(hashed >> np.uint64(63), 1.0, -1.0)
    cell = np.repeat(np.arange(len(documents)) * FEATURES, sizes) + place[at]
    vectors = np.bincount(cell, weights=sign[at], minlength=len(documents) * FEATURES).reshape(len(documents), FEATURES)
    vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
    norm = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return (np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0) @ matrix).astype(np.float64)


def tail_bounds(tokens: int) -> np.ndarray:
    """Where the powers of two begin into which so many tokens fall apart, largest first, and the end."""
    return np.cumsum([0, *(1 << b for b in range(tokens.bit_length() - 1, -1, -1) if tokens >> b & 1)])


def cuts(start: int, n: int, total: int, length: int) -> list[tuple[int, int, int, int]]:
    """(begin in the document, length, sequence, offset) of the pieces of n tokens that lie from start on in a stream of total tokens."""
    full, out, at = total // length, [], start
    tail = tail_bounds(total % length)
    while at < start + n:
        if at < full * length:
            sequence, begin, end = at // length, at // length * length, (at // length + 1) * length
        else:
            k = int(np.searchsorted(tail, at - full * length, side="right")) - 1
            sequence, begin, end = full + k, full * length + int(tail[k]), full * length + int(tail[k + 1])
        upto = min(end, start + n)
        out.append((at - start, upto - at, sequence, at - begin))
        at = upto
    return out


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of all docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian bytes).

    path: a tokenizers JSON file that every executor has. A document is its ids and END; null text counts as empty and is END alone. start
    is a piece's first id in its document, offset its place in its sequence. Each sequence has `length` tokens, a power of two; those of
    the stream's end have smaller powers of two. Every row is packed, repeated rows and null ids too; a text of any length goes over as
    many sequences as it needs. Other columns are dropped. An empty table gives no rows.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    bound_batches(docs.sparkSession)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        kind = "<u2" if max(len(bpe.tokens), END + 1) <= 1 << 16 else "<u4"
        for frame in frames:
            texts = [t if isinstance(t, str) else None for t in frame["text"]]
            for a, b in batches(texts):
                for c in range(a, b, ROWS):
                    d = min(c + ROWS, b)
                    ids = [np.frombuffer(x, dtype="<u4") for x in bpe.encode_batch(texts[c:d])]
                    stored = [np.append(x, END).astype(kind).tobytes() for x in ids]
                    yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[c:d].array, "point": list(projected(ids)), "tokens": [len(x) + 1 for x in ids], "ids": stored, "narrow": kind == "<u2"})

    lean = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = lean.mapInPandas(encode, "doc_id long, point array<double>, tokens long, ids binary, narrow boolean")
    # numbers of rows, fixed by being written
    base = save(made.withColumn("row", F.monotonically_increasing_id()))
    placed, total = _placed(base.select("row", "tokens", "point"))

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, (n, begin, ids, narrow) in enumerate(zip(frame["tokens"].tolist(), frame["begin"].tolist(), frame["ids"], frame["narrow"].tolist(), strict=True)):
                wide = np.frombuffer(ids, dtype="<u2" if narrow else "<u4").astype("<u4").tobytes()
                for at, size, sequence, offset in cuts(begin, n, total, length):
                    own = wide[4 * at : 4 * (at + size)]
                    out.append((k, at, size, zlib.crc32(own), n, sequence, offset, *([own] if with_ids else [])))
            found = pd.DataFrame(out, columns=["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])])
            yield found.assign(doc_id=frame["doc_id"].array[found["k"].to_numpy(dtype=np.int64)]).drop(columns="k")

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    return base.select("row", "doc_id", "tokens", "ids", "narrow").join(placed, "row").select("doc_id", "tokens", "begin", "ids", "narrow").mapInPandas(pieces, kinds)


def _placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """For rows (row, tokens, point): row and begin, the tokens before it along the curve; and the number of all tokens."""
    each = [F.col("point")[i] for i in range(DIMENSIONS)]
    told = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)), *[f(c) for c in each for f in (F.avg, F.stddev_pop)]).first()
    mean, spread = np.array([x or 0.0 for x in told[1::2]]), np.array([x or 1.0 for x in told[2::2]])

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = np.stack(list(frame["point"])) if len(frame) else np.zeros((0, DIMENSIONS))
            share = 1 / (1 + np.exp(-1.702 * np.clip((points - mean) / spread, -20, 20)))  # about the normal distribution's
            cells = np.minimum((share * (1 << GRID_BITS)).astype(np.int64), (1 << GRID_BITS) - 1)
            yield pd.DataFrame({"row": frame["row"].array, "tokens": frame["tokens"].array, "key": hilbert_keys(cells, GRID_BITS)})

    keys = rows.mapInPandas(keyed, "row long, tokens long, key long").withColumn("tie", F.xxhash64("row"))
    raw = save(keys)  # the ranges are chosen from a sample of it
    ranged = save(raw.repartitionByRange("key", "tie").withColumn("part", F.spark_partition_id()))
    discard(raw)
    sums = ranged.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(W.Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    upto = F.sum("tokens").over(W.Window.partitionBy("part").orderBy("key", "tie", "row").rowsBetween(W.Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(before), "part").select("row", (F.col("before") + upto - F.col("tokens")).alias("begin")), int(told[0])
