"""Vectorised words and 64-bit hashes of whole UTF-8 texts.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered. A word's hash is a polynomial over a table of random 64-bit
values, read off prefix sums, so a batch of texts costs a few numpy passes and no Python loop over words.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (Stafford's variant 13)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"]


def _hash_chunk(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    data = _LOWER[data]
    gap = _SEPARATOR[data]
    before = np.empty_like(gap)
    before[0] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(gap & ~before)
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, begins)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one entry more than texts). None counts as empty."""
    hashes, offsets, at, done = [], [np.zeros(1, dtype=np.int64)], 0, 0
    while at < len(texts):
        chunk, size = [], 0
        while at < len(texts) and (not chunk or size + len(texts[at] or b"") < CHUNK_BYTES):
            chunk.append(texts[at] or b"")
            size += len(chunk[-1]) + 1
            at += 1
        h, o = _hash_chunk(chunk)
        hashes.append(h)
        offsets.append(o[1:] + done)
        done += len(h)
    return np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), np.concatenate(offsets)
