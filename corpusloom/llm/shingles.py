"""Hashed word shingles of whole texts, vectorised over Arrow batches.

Words are maximal runs of bytes other than space and 0x09-0x0D after A-Z are lower-cased. A text of ``k``
or more words has the set of its k-word shingles; a shorter one has its whole word sequence as the only
shingle; a text without words has none. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SLICE_BYTES = 2_000_000
_STEPS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return lower, space


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    grow = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64)])
    return grow(BASE), grow(inverse)


def word_bounds(data: np.ndarray, bounds: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-blank bytes inside each text, and each text's number of runs."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[bounds[bounds <= n]] = True
    before = np.concatenate([[True], blank[:-1]])
    after = np.concatenate([blank[1:], [True]])
    starts = np.flatnonzero(~blank & (before | edge[:n]))
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


class SpanHasher:
    """Hashes of byte spans of ``data`` after A-Z are lower-cased, from one pass of prefix sums."""

    def __init__(self, data: np.ndarray):
        lower, _ = _tables()
        up, self._down = _powers(1 << max(21, len(data).bit_length()))
        terms = (lower[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)]
        self._sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(hashes + (ends - starts).astype(np.uint64) * _STEPS[63])


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts ``data[bounds[i]:bounds[i+1]]``, and each text's word count."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    starts, ends, counts = word_bounds(data, bounds, _tables()[1][data])
    return SpanHasher(data)(starts, ends), counts


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(data, bounds)
    if len(words) >= k:
        rolled = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            rolled += words[j : j + len(rolled)] * _STEPS[j]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(rolled[at : at + n - k + 1]))
        elif n:
            short = np.append(words[at : at + n] * _STEPS[:n], np.array([n], np.uint64) * _STEPS[62:63]).sum(dtype=np.uint64)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(words[:0])
        at += n
    return out


def text_slices(column: pa.Array):
    """The column's texts as ``(first row, bytes, bounds)`` slices of bounded size; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
