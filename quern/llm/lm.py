"""Op 4: language-model scores by a weighted backoff automaton of order three.

Tokens are lower-cased (A-Z) words and one end per text. The states of the automaton are the empty history, each word (or the beginning)
and each pair of neighbours. A history h with count c(h) weighs a word that followed it in training with
(c(hw) + MU p(w)) / (c(h) + MU), p being the probability in the state of the history without its first word; any other word takes the
failure arc to that state, which weighs MU / (c(h) + MU). In the empty state p(w) = (c(w) + 1) / (N + V + 1). So the probabilities of a
state's V words and of one unknown word sum to 1. A text is walked once from left to right: the walk carries its state, takes arcs and
failure arcs, and adds up their logarithms.

The automaton is never gathered. Blocks of documents send their distinct words and pairs, as sorted keys with training counts, to the
shards of the key space; each shard adds up and answers each block in the block's order. Of the triples a block sends only those whose two
pairs other blocks have too: no other block can know the rest, so their counts are its own. A block then builds the part of the automaton
that its own texts walk through. Blocks and shards are bounded. A block sends a message to a shard only where it has keys for it, so
messages are never more than keys, and keys are no more than tokens: work and traffic grow with the corpus and not with blocks times shards.
Words are known by 64-bit keys, pairs and triples by fingerprints of 20 bits more than number the corpus's tokens: a look-up meets
another's count with a probability of about one in a million, at every size.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import bound_batches, save
from quern.llm.words import mix, word_hashes

MU = (100.0, 20.0)  # weight of the shorter history, in states of one word and of two
BLOCK_BYTES = 4 << 20
SHARD_KEYS = 1_500_000
SPARE_BITS = 20
LANE = 512  # tokens that a lane of the walk scores; it starts two tokens earlier, which is as far as a state reaches
_END = np.uint64(0x5851F42D4C957F2D)
_BEGIN = np.uint64(0x14057B7EF767814F)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_TABLE = "block long, n_tokens long, train_tokens long, body binary"
_ANSWER = "block long, shard long, kind int, known long, body binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed planes of bytes: what the high bytes don't use costs nothing."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return np.array([len(a) for a in arrays], dtype="<u4").tobytes() + zstandard.ZstdCompressor(level=1, write_checksum=False).compress(planes)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    head = 4 * len(kinds)
    planes, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[head:]), dtype=np.uint8), 0, []
    for n, kind in zip(np.frombuffer(data[:head], dtype="<u4").tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(planes[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text's words followed by the end; and where each text begins."""
    words, offsets = word_hashes(texts)
    return np.insert(words, offsets[1:], _END), offsets + np.arange(len(offsets))


def _block(ids: list, held: list[bool], texts: list[bytes | None]) -> dict:
    stream, begins = tokens(texts)
    words, code, often = np.unique(stream, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")  # frequent words have small codes, which compress
    rank = np.empty(len(order), dtype="<u4")
    rank[order] = np.arange(len(order))
    missing = np.array([x is None or x != x for x in ids])
    plain = np.array([0 if m else int(x) for x, m in zip(ids, missing, strict=True)], dtype="<i8")
    body = _pack(plain, missing.astype("u1"), np.array(held, dtype="u1"), np.diff(begins).astype("<u4"), words[order], rank[code])
    return {"block": uuid.uuid4().int >> 65, "n_tokens": len(stream), "train_tokens": int(np.diff(begins)[~np.array(held, dtype=bool)].sum()), "body": body}


class Block:
    """A block's documents, and their distinct words, pairs and triples as keys in the order in which they are sent."""

    def __init__(self, body: bytes, bits: int):
        self.ids, self.missing, held, sizes, self.words, code = _unpack(body, "<i8", "u1", "u1", "<u4", "<u8", "<u4")
        self.begins = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self.held, self.code = held == 1, code.astype(np.int64)
        self.train = np.repeat(~self.held, np.diff(self.begins))
        self.shift = np.uint64(64 - bits)
        self.start = len(self.words)  # the code of the beginning
        first = self.begins[:-1]
        self.before = np.concatenate((self.code[:1], self.code[:-1]))
        self.before[first] = self.start
        # pairs: of each token with the one before it; triples: of each token but a text's first with the pair before it
        pairs, self.pair = np.unique(self.before << 32 | self.code, return_inverse=True)
        self.pair_words = pairs >> 32, pairs & 0xFFFFFFFF
        self.pair_hash = mix(np.append(self.words, _BEGIN)[self.pair_words[0]] * _STEP + self.words[self.pair_words[1]])
        self.inner = np.ones(len(self.code), dtype=bool)
        self.inner[first] = False

    def word_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, their training counts here, and the place of each word's key."""
        keys, place = np.unique(self.words, return_inverse=True)
        return keys, np.bincount(place[self.code[self.train]], minlength=len(keys)), place

    def pair_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, place = np.unique(self.pair_hash >> self.shift, return_inverse=True)
        return keys, np.bincount(place[self.pair[self.train]], minlength=len(keys)), place

    def triples(self) -> None:
        """Distinct triples: their first pair, last word and last pair, their hashes, and the training counts here."""
        at = np.flatnonzero(self.inner)
        found, first, self.triple = np.unique(self.pair[at - 1].astype(np.int64) << 32 | self.code[at], return_index=True, return_inverse=True)
        self.triple_pair, self.triple_word, self.triple_last = found >> 32, found & 0xFFFFFFFF, self.pair[at[first]]
        self.triple_hash = mix(self.pair_hash[self.triple_pair] * _STEP + self.words[self.triple_word] + np.uint64(1))
        self.triple_own = np.bincount(self.triple[self.train[at]], minlength=len(found))

    def triple_keys(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for the triples that other blocks may have, and which these are. shared: pairs that other blocks have."""
        asked = np.flatnonzero(shared[self.triple_pair] & shared[self.triple_last])
        keys, place = np.unique(self.triple_hash[asked] >> self.shift, return_inverse=True)
        return keys, np.bincount(place, weights=self.triple_own[asked], minlength=len(keys)).astype(np.int64), place, asked


def _messages(block: int, kind: int, bits: int, shards: int, keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """One row for each shard that has some of the keys; shards are ranges of the key space."""
    home = ((keys >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(home[1:] != home[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, dtype=np.int64)
    gap = np.diff(keys, prepend=np.uint64(0))
    rows = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        steps = gap[a:b].copy()
        steps[0] = keys[a]
        rows.append((int(home[a]), block, kind, _pack(steps, counts[a:b].astype("<u4"))))
    return pd.DataFrame(rows, columns=["shard", "block", "kind", "body"])


def _answers(frame: pd.DataFrame) -> pd.DataFrame:
    """For the messages of one shard and kind: of each key twice its training count, plus one where several blocks have it."""
    asked = [_unpack(b, "<u8", "<u4") for b in frame["body"]]
    keys, code = np.unique(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in asked]), return_inverse=True)
    totals = np.bincount(code, weights=np.concatenate([c for _, c in asked]), minlength=len(keys)).astype("<u8")
    reply = totals * np.uint64(2) + (np.bincount(code, minlength=len(keys)) > 1).astype("<u8")
    cuts = np.cumsum([0] + [len(k) for k, _ in asked])
    known = np.zeros(len(frame), dtype=np.int64)
    known[0] = (totals > 0).sum()
    return pd.DataFrame({"block": frame["block"], "shard": frame["shard"], "kind": frame["kind"], "known": known, "body": [_pack(reply[code[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})


def _reply(parts: list, kind: int) -> np.ndarray:
    found = [_unpack(p["body"], "<u8")[0] for p in parts if p["kind"] == kind]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


class Automaton:
    """States, arcs and failure arcs. State 0 is the empty history, 1 + w that of word w, then those of pairs; fail and back are each
    state's failure arc and its weight. An arc from state s on word w is the key s * kinds + w, with a weight and a target.
    """

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, floor: int, mu: tuple[float, float]):
        n, ends = len(words), words[np.flatnonzero(block.words == _END)].sum()
        unigram = (words + 1) / floor
        history = np.append(words, ends).astype(float)  # of a word's state; that of the beginning counts texts
        a, b = block.pair_words
        bigram = (pairs + mu[0] * unigram[b]) / (history[a] + mu[0])
        trigram = (triples + mu[1] * bigram[block.triple_last]) / (pairs[block.triple_pair] + mu[1])
        self.kinds = n + 1
        self.begin = 1 + n
        first_pair = 2 + n
        pair_state = np.where(pairs > 0, first_pair + np.arange(len(pairs)), 1 + b)
        self.fail = np.concatenate((np.zeros(first_pair, dtype=np.int64), 1 + b))
        self.back = np.log10(np.concatenate(([1.0], mu[0] / (history + mu[0]), mu[1] / (pairs + mu[1]))))
        two, three = np.flatnonzero(pairs > 0), np.flatnonzero(triples > 0)
        keys = np.concatenate((np.arange(n), (1 + a[two]) * self.kinds + b[two], (first_pair + block.triple_pair[three]) * self.kinds + block.triple_word[three]))
        weights = np.log10(np.concatenate((unigram, bigram[two], trigram[three])))
        targets = np.concatenate((np.where(words > 0, 1 + np.arange(n), 0), pair_state[two], pair_state[block.triple_last[three]]))
        order = np.argsort(keys, kind="stable")
        self.keys, self.weights, self.targets = keys[order], weights[order], targets[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a word, and the log10 weights of the arcs taken: failure arcs down to a state that has the word."""
        weight, target, left = np.zeros(len(state)), np.empty(len(state), dtype=np.int64), np.arange(len(state))
        while len(left):
            key = state * self.kinds + word
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            has = self.keys[at] == key
            weight[left[has]] += self.weights[at[has]]
            target[left[has]] = self.targets[at[has]]
            left, state, word = left[~has], state[~has], word[~has]
            weight[left] += self.back[state]
            state = self.fail[state]
        return target, weight

    def walk(self, code: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The log10 probability of each text. All texts are walked abreast, each from left to right; long ones in several lanes, each of
        which comes to its state over the two tokens before it."""
        sizes = np.diff(begins)
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = begins[text] + nth * LANE
        end = np.minimum(start + LANE, begins[text + 1])
        lead = np.where(nth > 0, 2, 0)
        order = np.argsort(-(end - start + lead), kind="stable")
        at, stop, lead = (start - lead)[order], end[order], lead[order]
        total, state = np.zeros(len(order)), np.where(lead > 0, 0, self.begin)
        for k in range(int((stop - at).max(initial=0))):
            live = int(np.searchsorted(-(stop - at), -k, side="left"))  # lanes of more than k tokens
            state, weight = self.step(state[:live], code[at[:live] + k])
            total[:live] += np.where(lead[:live] > k, 0.0, weight)
        return np.bincount(text[order], weights=total, minlength=len(sizes))


def lm_score(docs: DataFrame, held_mod: int = 7, held_rest: int = 2, mu: tuple[float, float] = MU) -> DataFrame:
    """For docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on rows whose crc32(doc_id as text) mod held_mod isn't held_rest (a null doc_id counts as text ''). Null text counts as
    empty: one token, the end. base_score is the add-one unigram log10 probability, score the automaton's. Without training rows counts
    are 0 and the one unknown has probability 1, so scores are 0. Every row gives a row, repeated ones too, which count each; other
    columns are dropped. A text of any length is one document of one block; it is walked in lanes. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % held_mod == held_rest
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), held.alias("held"))

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, held, texts, size = [], [], [], 0
        for frame in frames:
            for i, t, h in zip(frame["doc_id"], frame["text"], frame["held"], strict=True):
                t = t if isinstance(t, bytes) else b""
                ids.append(i)
                held.append(bool(h))
                texts.append(t)
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield pd.DataFrame([_block(ids, held, texts)])
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield pd.DataFrame([_block(ids, held, texts)])

    table = save(rows.mapInPandas(blocks, _TABLE))
    total, train_total = table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("train_tokens"), F.lit(0))).first()
    shards, bits = max(1, math.ceil(total / SHARD_KEYS)), min(64, max(32, total.bit_length() + SPARE_BITS))

    def first_asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, body in zip(frame["block"], frame["body"], strict=True):
                b = Block(body, bits)
                yield _messages(block, 0, 64, shards, *b.word_keys()[:2])
                yield _messages(block, 1, bits, shards, *b.pair_keys()[:2])

    def then_asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, body, parts in zip(frame["block"], frame["body"], frame["parts"], strict=True):
                b = Block(body, bits)
                b.triples()
                shared = (_reply(parts, 1) & np.uint64(1)).astype(bool)[b.pair_keys()[2]]
                yield _messages(block, 2, bits, shards, *b.triple_keys(shared)[:2])

    def answered(messages: DataFrame) -> DataFrame:
        return save(messages.groupBy("shard", "kind").applyInPandas(_answers, _ANSWER))

    def with_answers(replies: DataFrame) -> DataFrame:
        # a block's answers are as many bytes as its distinct keys need: bounded by BLOCK_BYTES, but for a longer single text
        parts = replies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("kind", "shard", "body"))).alias("parts"))
        return table.select("block", "body").join(parts, "block")

    asked = "shard long, block long, kind int, body binary"
    one = answered(table.select("block", "body").mapInPandas(first_asked, asked))
    vocabulary = one.where("kind = 0").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    two = answered(with_answers(one.where("kind = 1")).mapInPandas(then_asked, asked))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = train_total + vocabulary + 1
        for frame in frames:
            for body, parts in zip(frame["body"], frame["parts"], strict=True):
                b = Block(body, bits)
                b.triples()
                words = (_reply(parts, 0) >> np.uint64(1)).astype(np.int64)[b.word_keys()[2]]
                pairs = _reply(parts, 1)[b.pair_keys()[2]]
                *_, place, which = b.triple_keys((pairs & np.uint64(1)).astype(bool))
                triples = b.triple_own.copy()
                triples[which] = (_reply(parts, 2) >> np.uint64(1)).astype(np.int64)[place]
                score = Automaton(b, words, (pairs >> np.uint64(1)).astype(np.int64), triples, floor, mu).walk(b.code, b.begins)
                add = lambda x: np.add.reduceat(x, b.begins[:-1])  # noqa: B023, E731
                ids = pd.array([None if m else int(i) for i, m in zip(b.ids, b.missing, strict=True)], dtype="Int64")
                yield pd.DataFrame({"doc_id": ids, "held_out": b.held, "n_tokens": np.diff(b.begins), "n_known": add((words > 0).astype(np.int64)[b.code]), "train_tokens": train_total, "base_score": add(np.log10((words + 1) / floor)[b.code]), "score": score})

    return with_answers(one.unionByName(two)).mapInPandas(walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
