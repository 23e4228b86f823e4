"""Word, shingle and n-gram hashes of many texts at once, in numpy on their UTF-8 bytes.

Words are runs without ASCII white space; A-Z count as a-z.  Equal words have equal
hashes in every process.
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_RANDOM = np.random.default_rng(20111)
BYTE = _RANDOM.integers(1, 1 << 64, 256, dtype=np.uint64)
BASE, STRIDE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_powers = np.ones(1, np.uint64)


def powers(count: int) -> np.ndarray:
    """BASE to the 0, 1, ... modulo 2 to the 64."""
    global _powers
    if len(_powers) < count:
        _powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(count, 1024), BASE))))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first byte of every word, and the n + 1 word bounds of the n texts."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    solid = ~BLANK[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = bounds[:-1][bounds[:-1] < len(raw)]
    begins[inner] = solid[inner]  # a text's first byte begins a word whatever stands before it
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(bounds), np.int64)
    at = np.arange(len(raw))
    offset = at - np.maximum.accumulate(np.where(begins, at, 0))
    values = BYTE[LOWER[raw]]
    values *= powers(int(offset[solid].max()) + 1)[np.where(solid, offset, 0)]
    values[~solid] = 0
    return mix(np.add.reduceat(values, starts)), starts, np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and their n + 1 bounds; a shorter text is one run of all its words."""
    count = np.diff(bounds)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    ends = np.concatenate(([0], np.cumsum(runs)))
    first = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], runs)
    length = np.minimum(np.repeat(count, runs), size)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    total = np.zeros(len(first), np.uint64)
    for j in range(size):
        total = total * STRIDE + np.where(j < length, padded[first + j], np.uint64(0))
    return mix(total ^ length.astype(np.uint64)), ends


def byte_grams(raw: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` bytes (2 to 7) within texts and their n + 1 bounds."""
    count = np.maximum(np.diff(bounds) - size + 1, 0)
    ends = np.concatenate(([0], np.cumsum(count)))
    low = LOWER[raw].astype(np.uint64)
    gram = np.zeros(max(len(raw) - size + 1, 0), np.uint64)
    for j in range(size):
        gram |= low[j : j + len(gram)] << np.uint64(8 * j)
    first = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], count)
    return mix(gram[first] ^ (np.uint64(size) << np.uint64(60))), ends


def buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The top bits of each hash as an index."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def sum_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each text's values, 0 for a text without any."""
    out = np.zeros(len(bounds) - 1)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some])
    return out
