"""Words, lines and their fingerprints over the bytes of many texts at once.

A word is a run of bytes other than space and 0x09-0x0D. Fingerprints are 64-bit polynomial hashes over a random table,
taken from prefix sums, so that any span costs the same.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_random = np.random.default_rng(20260101)
BYTE_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(BASE, -1, 1 << 64)
_WINDOW = _random.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes hashed together; prefix sums take some thirty times as much.
TILE = 1 << 20

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for k, base in enumerate((BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


class SpanHash:
    """Hash of any span ``[start, end)`` of ``data``."""

    def __init__(self, data: np.ndarray, table: np.ndarray = BYTE_VALUE) -> None:
        power, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * power[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
            return mix(raw + (end - start).astype(np.uint64) * U64(0xD1B54A32D192ED03))


def _long_hash(data: np.ndarray) -> np.ndarray:
    """``SpanHash`` of all of ``data`` in tiles, for a span that is long itself."""
    power, _ = _power_tables(TILE + 1)
    total, factor = 0, 1
    for first in range(0, len(data), TILE):
        part = BYTE_VALUE[data[first : first + TILE]] * power[: min(TILE, len(data) - first)]
        total = (total + int(part.sum(dtype=np.uint64)) * factor) % (1 << 64)
        factor = factor * pow(BASE, TILE, 1 << 64) % (1 << 64)
    with np.errstate(over="ignore"):
        return mix(np.array([total], np.uint64) + U64(len(data)) * U64(0xD1B54A32D192ED03))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each of the spans, which ascend and do not overlap; a long text is handled tile by tile."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    if len(data) <= 2 * TILE:
        return SpanHash(data)(starts, ends)
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, base + TILE, side="right")))
        part = data[base : int(ends[last - 1])]
        out[first:last] = _long_hash(part) if len(part) > 2 * TILE else SpanHash(part)(starts[first:last] - base, ends[first:last] - base)
        first = last
    return out


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the range of its words: (starts, ends, word_bounds)."""
    inside = ~SEPARATOR[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | fresh[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, bounds)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; windows that leave their text are for the caller to skip."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += words[k : n + k] * _WINDOW[k]
    return mix(total)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingles of each text, sorted: (hashes, set_bounds).

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    starts, ends, word_bounds = word_spans(data, bounds)
    words = span_hashes(data, starts, ends)
    windows = window_hashes(words, size)
    sets = []
    limits = word_bounds.tolist()
    for first, last in zip(limits, limits[1:]):
        if last - first >= size:
            sets.append(np.unique(windows[first : last - size + 1]))
        elif last > first:
            short = words[first:last] * _WINDOW[: last - first]
            sets.append(mix(short.sum(dtype=np.uint64, keepdims=True) + U64(last - first)))
        else:
            sets.append(np.zeros(0, np.uint64))
    set_bounds = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=set_bounds[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), set_bounds
