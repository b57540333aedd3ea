"""Op 1: BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks up all adjacent pairs at once by binary search over the sorted pair
keys, takes each word's lowest rank, and merges that pair everywhere in the word, left to right; words without a mergeable pair leave.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import bound_batches

CACHE_WORDS = 400_000
SLICE = 2_000_000  # characters that are looked at at once
NO_RANK = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_PLACE = {c: b for b, c in enumerate(byte_symbols())}
#: The expression of words that CLIP's tokenizers have; words() finds the same ones in arrays of characters. Fixed value.
CLIP_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, NUMBER, OTHER = range(4)
_COMMON = 0x2200  # all characters that aren't rare lie below, lowered ones too
_RARE = re.compile("[^\x00-\u052f\u1e00-\u2052\u20a0-\u214f]").search


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    kinds = np.full(_COMMON, OTHER, dtype=np.uint8)
    for kind, expression in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        kinds[[i for i in range(_COMMON) if regex.match(expression, chr(i))]] = kind
    return kinds


def words(text: str) -> tuple[pa.Array, np.ndarray] | None:
    """What CLIP_WORDS finds in a lowered text, in UTF-8, and the place of the character where each begins; None if it has rare characters."""
    chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if len(chars) and chars.max() >= _COMMON:
        return None
    kind = np.concatenate((_kinds()[chars], np.zeros(3, dtype=np.uint8)))
    before = np.concatenate((np.zeros(1, dtype=np.uint8), kind[:-1]))
    begins = ((kind == LETTER) | (kind == OTHER)) & (kind != before) | (kind == NUMBER)
    # an apostrophe that begins a run of other characters may open one of the contractions
    mark = np.flatnonzero(begins[: len(chars)] & (chars == ord("'")))
    one, two = (np.concatenate((chars, np.zeros(2, dtype=np.uint32)))[mark + k] for k in (1, 2))
    is_ = lambda c, *of: np.isin(c, [ord(x) for x in of])
    size = np.where(is_(one, "s", "t", "m", "d"), 1, np.where(is_(one, "r", "v") & is_(two, "e") | is_(one, "l") & is_(two, "l"), 2, 0))
    mark, size = mark[size > 0], size[size > 0]
    begins[mark + 1] = False
    after = mark + size + 1
    begins[after] |= kind[after] == LETTER
    shown = np.flatnonzero(kind != SPACE)
    first = np.flatnonzero(begins[shown])
    own = chars[shown]
    width = 1 + (own >= 0x80).astype(np.int64) + (own >= 0x800)
    ends = np.concatenate(([0], np.cumsum(width)))
    offsets = ends[np.append(first, len(shown))]
    data = own.tobytes().decode("utf-32-le").encode()
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), shown[first]


def slices(text: str) -> list[str]:
    """A text in parts of about SLICE characters, cut at spaces."""
    out, at = [], 0
    while at < len(text):
        end = text.find(" ", at + SLICE)
        out.append(text[at : end if end >= 0 else len(text)])
        at = end if end >= 0 else len(text)
    return out


class Bpe:
    """A BPE tokenizer with word ends, read from a tokenizers JSON file. encode() and decode() agree with that library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
        self._check(spec)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.clip = split["pattern"]["Regex"] == CLIP_WORDS
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], dtype=np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.cache: dict[bytes, bytes] = {}
        self.library = None
        self.path = path

    @staticmethod
    def _check(spec: dict) -> None:
        """What encode() and decode() do by themselves must be what the file says; another kind of file is an error."""
        normal = spec["normalizer"] or {}
        steps = [(n["type"], n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [])]
        before = [(p["type"], p.get("behavior"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex")) for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        plain = not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        model = spec["model"]
        if steps != [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)] or [b[0] for b in before] != ["Split", "ByteLevel"] or before[0][1:3] != ("Removed", True) or before[1][3] or before[1][4] is not False:
            raise ValueError("only lower-casing byte-level tokenizers that split words by one expression can be read")
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or spec.get("decoder") or not plain:
            raise ValueError("only plain BPE without a decoder can be read")

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all non-empty words, given in UTF-8, one word after the other, and where each word's ids end."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[data[last]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done, whose = [symbols[:0]], [owner[:0]]
        ranks, into = self._pairs(symbols, owner, np.arange(len(owner)))
        while len(owner):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(ranks, first)
            sizes = np.diff(np.append(first, len(owner)))
            least = np.repeat(best, sizes)
            over = least == NO_RANK
            done.append(symbols[over])
            whose.append(owner[over])
            hit = (ranks == least) & ~over
            # where equal symbols follow each other, every second of a row of overlapping pairs merges
            after = np.flatnonzero(hit[1:] & hit[:-1])
            if len(after):
                place = np.arange(len(hit))
                began = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), place, 0))
                hit &= (place - began) % 2 == 0
            where = np.flatnonzero(hit)
            symbols[where] = into[where]
            keep = ~over
            keep[where + 1] = False
            symbols, owner, ranks, into = symbols[keep], owner[keep], ranks[keep], into[keep]
            # only the pairs on both sides of a new symbol are new
            new = (np.cumsum(keep) - 1)[where]
            new = np.concatenate((new, new[new > 0] - 1))
            ranks[new], into[new] = self._pairs(symbols, owner, new)
        word = np.concatenate(whose)
        return np.concatenate(done)[np.argsort(word, kind="stable")], np.cumsum(np.bincount(word, minlength=len(words)))

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs that begin at these places, NO_RANK if there is none, and the symbols that they make."""
        ranks, into = np.full(len(at), NO_RANK), np.zeros(len(at), dtype=np.int64)
        ok = np.flatnonzero((at + 1 < len(owner)) & (owner[np.minimum(at + 1, len(owner) - 1)] == owner[at])) if len(at) else at
        keys = symbols[at[ok]] << 32 | symbols[at[ok] + 1]
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[found] == keys
        ranks[ok[known]], into[ok[known]] = self.ranks[found[known]], self.made[found[known]]
        return ranks, into

    @staticmethod
    def normal(text: str) -> str | None:
        """The text as the library normalises it, but for white space; None if it has rare characters."""
        if _RARE(text) is not None:
            return None
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # single characters are lowered: the library knows no final sigma

    def split(self, text: str) -> list[bytes]:
        """The words of a text without special strings, normalised, in UTF-8."""
        normal = self.normal(text)
        if normal is not None:
            return [w.encode() for w in self.find(normal)]
        # Unicode versions differ on letters of later scripts: the library's own tables decide
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(_PLACE.__getitem__, w)) for w, _ in found]

    def _fill(self, words: set[bytes]) -> None:
        new = list(words - self.cache.keys())
        if len(self.cache) + len(new) > CACHE_WORDS:  # what is asked for now stays
            self.cache = {w: self.cache[w] for w in words & self.cache.keys()}
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            ids, ends = self.merge(part)
            data, begin = ids.astype("<u4").tobytes(), 0
            for w, end in zip(part, (4 * ends).tolist(), strict=True):
                self.cache[w] = data[begin:end]
                begin = end

    def _encode_common(self, texts: list[str]) -> list[bytes] | None:
        """Ids of normal texts, by arrays of all their characters; None if one of them has rare characters."""
        found = words("\n".join(texts))
        if found is None:
            return None
        coded, place = found[0].dictionary_encode(), found[1]
        known = coded.dictionary.to_pylist()
        self._fill(set(known))
        each = [self.cache[w] for w in known]
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 4
        begins, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(each), dtype="<u4")
        word = coded.indices.to_numpy().astype(np.int64)
        counts = sizes[word]
        ends = np.cumsum(counts)
        flat = ids[np.repeat(begins[word] - (ends - counts), counts) + np.arange(int(counts.sum()))]
        edges = np.searchsorted(place, np.cumsum([len(t) + 1 for t in texts]))
        upto = np.concatenate(([0], ends))[edges]
        return [flat[a:b].tobytes() for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; None counts as empty. Special strings in a text get their ids."""
        out, common = [b""] * len(texts), [[]]
        split: dict[int, list] = {}
        held = 0
        for i, text in enumerate(texts):
            special = bool(text) and any(s in text for s in self.special)
            normal = self.normal(text) if text and self.clip and not special else None
            for part in [] if normal is None else slices(normal):
                if held and held + len(part) > SLICE:
                    common.append([])
                    held = 0
                common[-1].append((i, part))
                held += len(part)
            if text and normal is None:
                split[i] = [self.special[p] if p in self.special else self.split(p) for p in (self.cut(text) if special else [text]) if p]
        for group in common:
            ids = self._encode_common([t for _, t in group]) if group else []
            for k, (i, part) in enumerate(group):
                if ids is not None:
                    out[i] += ids[k]
                else:
                    split.setdefault(i, []).append([w.encode() for w in self.find(part)])
        self._fill({w for pieces in split.values() for p in pieces if isinstance(p, list) for w in p})
        get = self.cache.__getitem__
        for i, pieces in split.items():
            out[i] += b"".join([np.array([p], dtype="<u4").tobytes() if isinstance(p, int) else b"".join(map(get, p)) for p in pieces])
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8: their tokens, joined by a space (the vocabulary file names no decoder)."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def batches(texts: list[str | None], size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters, so that words in flight stay bounded."""
    begin = chars = 0
    for i, text in enumerate(texts):
        if chars and chars + len(text or "") > size:
            yield begin, i
            begin, chars = i, 0
        chars += len(text or "")
    if begin < len(texts):
        yield begin, len(texts)


def bpe_round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, little-endian bytes).

    path: a tokenizers JSON file that every executor has. Null text counts as empty: 0 tokens and the digests of nothing. Rows are
    independent, so repeated rows and null ids pass through; other columns are dropped. Long texts are cut into words as they are, some
    millions of characters at a time. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for frame in frames:
            texts = [t if isinstance(t, str) else None for t in frame["text"]]
            for a, b in batches(texts):
                ids = bpe.encode_batch(texts[a:b])
                out = {
                    "doc_id": frame["doc_id"].iloc[a:b].array,
                    "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
                }
                yield pd.DataFrame(out | ({"ids": ids} if with_ids else {}))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, schema)
