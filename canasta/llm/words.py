"""Words of many texts at once, as hashes in numpy arrays.

Hashes are polynomials over 64-bit integers with wrap-around, finished by a mixing step: any range of a
sequence is hashed from two prefix sums, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; a single longer text is handled alone.
CHUNK_BYTES = 400_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


#: A random-looking value per byte.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


class Powers:
    """Powers of an odd base and of its inverse, as far as they were needed."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, factor, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))
        return self.up[:n], self.down[:n]


FIRST = Powers(0xD1342543DE82EF95)


class Ranges:
    """Hashes of any ranges of ``values``."""

    def __init__(self, values: np.ndarray, powers: Powers = FIRST):
        up, self.down = powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + length * _ODD)

    def windows(self, n: int) -> np.ndarray:
        """Hashes of all ranges of length ``n``, by their start."""
        count = max(0, len(self.sums) - n)
        body = (self.sums[n : n + count] - self.sums[:count]) * self.down[:count]
        return mixed(body + np.uint64(n * int(_ODD) % (1 << 64)))


@dataclass
class Words:
    """Words of consecutive texts. ``doc`` is the running number of a word's text among ``texts``;
    ``first[i]`` to ``first[i + 1]`` are the words of text i; spans are byte ranges in ``data``."""

    values: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    texts: int


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; a null row is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), rows)
        yield at, end
        at = end


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE, values: np.ndarray = BYTE_VALUES) -> Words:
    """Words of the texts between ``offsets`` in ``data``: runs of bytes that are no ``space``."""
    base = offsets[0]
    data, offsets = data[base : offsets[-1]], offsets - base
    inside = ~space[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    borders = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[borders] = inside[borders]
    before = borders[borders > 0] - 1
    ends[before] = inside[before]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = Ranges(values[data])(start, end)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(hashes, doc, first, start, end, data, len(offsets) - 1)


def word_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, words) of the chunks of a string column."""
    data, offsets = texts_of(column)
    for at, end in chunks(offsets, limit):
        yield at, end, words_of(data, offsets[at : end + 1])


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Starts of all windows of ``n`` items that lie in one text, in order."""
    counts = np.maximum(0, np.diff(first) - n + 1)
    total = int(counts.sum())
    skipped = first[:-1] - (np.cumsum(counts) - counts)
    return np.arange(total) + np.repeat(skipped, counts)
