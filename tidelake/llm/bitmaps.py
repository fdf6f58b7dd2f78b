"""Bitmaps of fixed size that mark which keys a later pass should look at.

A bitmap has the same size for any input. It only lets through too much, so an
exact join follows it; when it fills up, the pass before that join sends more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits; 2 MB.
BITMAP_BITS = 24
_U = np.uint64


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Marks by the leading bits of a 64-bit hash column. Gathers 2^18 words at most."""
    bit = F.shiftrightunsigned(column, 64 - BITMAP_BITS)
    marks = keys.select(
        (bit / 64).cast("int").alias("place"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int")).alias("mark"),
    )
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    for r in marks.groupBy("place").agg(F.bit_or("mark").alias("marks")).collect():
        out[r["place"]] = r["marks"] & (2**64 - 1)  # as unsigned
    return out


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes whose bit is set."""
    at = hashes >> _U(64 - BITMAP_BITS)
    return np.flatnonzero((bits[at >> _U(6)] >> (at & _U(63))) & _U(1))
