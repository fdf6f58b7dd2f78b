"""Numpy views of Arrow text columns, and hashes of the words and byte strings in them.

All functions work on whole texts. A batch is handled in row groups of about
``GROUP_BYTES``, so the arrays a task holds follow its longest text, not the
number of rows it reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: A fixed random value for each byte, from a fixed seed.
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def row_groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of them."""
    return _powers(max(1 << 21, 1 << int(n).bit_length()))


def prefix_hash(data: np.ndarray, values: np.ndarray = _BYTE_VALUES) -> np.ndarray:
    """Running polynomial hash: entry i covers the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span, the same wherever its bytes stand."""
    down = powers(len(prefix))[1]
    length = (ends - starts).astype(np.uint64)
    return mix((prefix[ends] - prefix[starts]) * down[starts] + length * _U(0xD6E8FEB86659FD93))


def lower_values() -> np.ndarray:
    """Byte values under which A-Z hash as a-z."""
    values = _BYTE_VALUES.copy()
    values[65:91] = values[97:123]
    return values


LOWER_VALUES = lower_values()


class Words:
    """The words of a group of texts: runs of bytes for which ``is_word`` holds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        mask = is_word[data]
        before = np.empty_like(mask)
        after = np.empty_like(mask)
        if len(mask):
            before[1:], before[0] = mask[:-1], False
            after[:-1], after[-1] = mask[1:], False
            edges = offsets[1:-1]
            before[edges[edges < len(mask)]] = False
            after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(mask & ~before)
        self.ends = np.flatnonzero(mask & ~after) + 1
        #: words [first[i], first[i + 1]) belong to row i
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = span_hash(prefix_hash(data, LOWER_VALUES), self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


#: Odd multipliers, one for each place in a shingle.
_PLACES = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) * _U(2) + _U(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on, over the array as one sequence."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, k * 0x2545F4914F6CDD1D & (2**64 - 1), np.uint64)
    for j in range(k):
        acc += words[j : j + n] * _PLACES[j]
    return mix(acc)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence of fewer than 64 words, as ``shingles`` gives it for that length."""
    return shingles(words, len(words))[0]
