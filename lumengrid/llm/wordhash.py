"""Words, word hashes and shingles of many texts at once, in numpy, straight from Arrow's buffers.

A word is a run of bytes other than space and \\t..\\r. Words are hashed with A-Z lower-cased by a multilinear hash of 64
bits (a random odd factor for each position), so two words of one text agree by chance with a probability below 2^-56.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply): every bit of the input reaches every bit of the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def factors(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_POSITION = factors(256, 11)
_ORDER = factors(64, 23)


def whole_texts(column: pa.Array, most_bytes: int = 1 << 18):
    """Yields (first row, bytes, offsets) for runs of whole texts of about ``most_bytes``; a longer text comes alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word, in order."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~SEPARATOR[data]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    before[cuts] = False
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = np.flatnonzero(inside & ~after) + 1 - starts
    first = np.cumsum(lengths) - lengths
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(first, lengths)
    longest = int(lengths.max())
    factor = _POSITION if longest <= len(_POSITION) else factors(longest, 11)
    parts = factor[place] * (LOWER[data[at]].astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(parts, first)), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text, its distinct shingle hashes, ascending; under ``size`` words make one shingle, no words none."""
    h, doc = words(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(doc, minlength=n)
    first = np.cumsum(counts) - counts
    if len(h) >= size:
        rolled = sum(h[j : len(h) - size + 1 + j] * _ORDER[j] for j in range(size))
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    sets = []
    for k, f in zip(counts.tolist(), first.tolist(), strict=True):
        if k >= size:
            sets.append(np.unique(rolled[f : f + k - size + 1]))
        elif k:
            sets.append(mix((h[f : f + k] * _ORDER[:k]).sum(dtype=np.uint64, keepdims=True) + _ORDER[16 + k : 17 + k]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
