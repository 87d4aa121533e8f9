"""Vectorised hashing of bytes and words of an Arrow text column (numpy inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
KEPT_POWERS = 1 << 19
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)

WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, null as empty, and the places where each row begins (and the end)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base, modulo 2^64."""
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept up to a fixed number, made anew for longer texts."""
    global _powers, _inverses
    if n < len(_powers):
        return _powers, _inverses
    if n >= KEPT_POWERS:
        return powers(_BASE, n + 1), powers(_INVERSE, n + 1)
    _powers, _inverses = powers(_BASE, KEPT_POWERS), powers(_INVERSE, KEPT_POWERS)
    return _powers, _inverses


class RollingHash:
    """Polynomial hashes modulo 2^64 of any ranges of a byte string."""

    def __init__(self, data: np.ndarray):
        steps, self.inverses = _grow(len(data))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= steps[: len(data)]
        np.cumsum(terms, out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of data[start:end]."""
        return mix((self.sums[end] - self.sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        """Mixed hashes of every run of size bytes."""
        n = max(0, len(self.sums) - size)
        out = self.sums[size : size + n] - self.sums[:n]
        out *= self.inverses[:n]
        out += np.uint64(size)
        return mix(out)


def word_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether a word (ASCII letters and digits, all bytes beyond ASCII) begins at each byte."""
    inside = WORD_BYTE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = rows[:-1][rows[:-1] < rows[1:]]
    begins[heads] = inside[heads]  # a row's first byte begins a word even if the row before ends in one
    return begins


def word_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and the row of each word."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    heads = rows[:-1][rows[:-1] < rows[1:]]
    start = np.flatnonzero(word_starts(data, rows))
    stops = ~WORD_BYTE[data]
    stops[heads] = True
    stop = np.append(np.flatnonzero(stops), len(data))
    # The end of a word: the next place that stops one; a head that begins the word itself is not it.
    end = stop[np.searchsorted(stop, start, side="right")]
    row = np.searchsorted(rows, start, side="right") - 1
    return RollingHash(LOWER[data]).ranges(start, end), row
