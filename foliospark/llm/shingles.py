"""Sets of hashed word shingles, many documents at a time."""

from __future__ import annotations

import numpy as np
import xxhash

_random = np.random.default_rng(20_240_229)
#: A random number for each byte value, and an odd base: a word's hash is their polynomial modulo 2^64, then mixed.
BYTES = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = int(_random.integers(0, 1 << 63)) * 2 + 1
INVERSE = pow(BASE, -1, 1 << 64)
PLACES = [np.uint64(int(x) | 1) for x in _random.integers(0, 1 << 63, 64)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), np.uint64(base))]).astype(np.uint64)[:n])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space, A-Z lowered) of all documents, and where each document's begin."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~BLANK[data]
    starts = np.flatnonzero(inside & (edge[:n] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTES[LOWER[data]] * powers(BASE, n))])
    hashes = mixed((sums[ends] - sums[starts]) * powers(INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Each document's distinct shingles of ``size`` words, ascending; a shorter text is one shingle, one without words none."""
    words, first = word_hashes(data, offsets)
    sums = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        sums += words[j : j + len(sums)] * PLACES[j]
    every = mixed(sums)
    out = []
    at = first.tolist()
    for a, b in zip(at, at[1:]):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for j in range(b - a):
                short += words[a + j : a + j + 1] * PLACES[size + j]
            out.append(mixed(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(shingles: np.ndarray) -> int:
    """64 bits of the set, signed."""
    x = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return x - (1 << 64) if x >> 63 else x
