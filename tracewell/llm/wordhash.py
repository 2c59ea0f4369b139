"""Words of whole texts as 64-bit hashes, in numpy over Arrow buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 these bytes never occur
inside another character.
"""

from __future__ import annotations

import hashlib

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 18
#: Words longer than this are hashed whole by BLAKE2; a sum of powers is weak on very long words.
_LONG = 512
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a word ends where its row ends
    before = np.concatenate(([False], inside[:-1])) & ~first[:n]
    after = np.concatenate((inside[1:], [False])) & ~first[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    length = ends - starts
    with np.errstate(over="ignore"):
        i = 0
        while i < len(starts):
            j = int(np.searchsorted(ends, starts[i] + _BLOCK, "right"))
            if j <= i:  # a word longer than a block
                i += 1
                continue
            a = starts[i]
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data[a : ends[j - 1]]] * _UP[: ends[j - 1] - a], dtype=np.uint64)))
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = mix((total[e] - total[s]) * _DOWN[s] + length[i:j].astype(np.uint64))
            i = j
    for k in np.flatnonzero(length > _LONG):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out
