"""Vectorised work on the bytes of Arrow strings: words, hashes of slices, and bounded runs of documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Documents are worked on in runs of about so many bytes (a longer document is a run of its own).
RUN_BYTES = 1 << 20
#: Rows of a run at most, as some work has arrays of many numbers a row.
RUN_ROWS = 2048

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2 ** 64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(4)
def _byte_values(seed: int, lower: bool) -> np.ndarray:
    table = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * seed))
    if lower:
        table[65:91] = table[97:123]
    return table


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` of them at least."""
    return _powers(1 << max(21, (n - 1).bit_length()))


class Slices:
    """Hashes of any slices of a buffer, from one pass of prefix sums."""

    def __init__(self, buf: np.ndarray, seed: int = 0, lower: bool = False):
        up, self._down = powers(len(buf) + 1)
        self._sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_byte_values(seed, lower)[buf] * up[: len(buf)], out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mixed((self._sums[end] - self._sums[start]) * self._down[start] + length * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, size: int) -> np.ndarray:
        """The hash of each window of ``size`` bytes."""
        n = len(self._sums) - size
        return mixed((self._sums[size:] - self._sums[:n]) * self._down[:n]) if n > 0 else np.zeros(0, np.uint64)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def runs(buf: np.ndarray, offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of successive rows that hold about ``most`` bytes together."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), row + RUN_ROWS, n)
        yield row, buf[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, a run of bytes other than the six blanks; words do not cross rows."""
    n = len(buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = ~BLANK[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


def shingles(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle of ``size`` lower-cased words, in text order.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    start, end, row = words(buf, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = Slices(buf, lower=True).hashes(start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    total, place = np.zeros(len(word), np.uint64), np.arange(len(word)) - (np.cumsum(count) - count)[row]
    left = count[row] - place  # words from here to the row's end
    for i in range(size):
        shifted = np.zeros(len(word), np.uint64)
        shifted[: len(word) - i] = word[i:] if i else word
        total = mixed(total ^ np.where(left > i, shifted, np.uint64(0)) + np.uint64(i + 1))
    keep = (left >= size) | ((place == 0) & (count[row] < size))
    return total[keep], row[keep]
