"""Score formulas for split keys, and widened numeric bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 2.718281828459045 ** -256  # keeps a zero median from dividing


def date_score(is_date: Column, is_chunked: Column, is_chrono: Column) -> Column:
    date, chunked, chrono = (c.cast("int") for c in (is_date, is_chunked, is_chrono))
    return date * 0.3 + date * ((chunked + 2 * chrono) / 3) * 0.7


def distinct_match(ndv: Column, connections: int) -> Column:
    """Close to 1 where the number of values is close to the connection limit."""
    return 1 / (F.abs(ndv - connections) + 1)


def split_score(per_value: Column, within: Column, rows: int, date: Column, drift: Column, match: Column) -> Column:
    w = within.cast("int")
    return w * ((per_value / rows) * w + 3 * date + 6 * drift + 2 * match) / 12


def job_split_score(per_value: Column, job_rows: int, date: Column, part: Column, is_index: Column) -> Column:
    near = F.exp(-F.abs(1 - per_value / job_rows))
    return near * (1 + 2 * date + 3 * part + is_index.cast("int")) / 7


def drift_score(diff_mad, diff_med, low_mad, low_med, high_mad, high_med) -> Column:
    """Near 1 where every partition covers the same range of a column, near 0 where ranges move."""
    wide = diff_mad / (diff_med + TINY)
    shift = low_mad / (F.abs(low_med) + TINY) + high_mad / (F.abs(high_med) + TINY)
    return (F.exp(-10 * wide) + F.exp(-10 * shift)) / 2


def widen(x: Column, by: int) -> Column:
    """Move a bound by one unit of its leading digit: down for -1, up for +1, never below 0.

    A negative bound has no leading digit to round at and stays as it is.
    """
    unit = F.pow(F.lit(10.0), F.floor(F.log10(x + F.lit(1e-7))))
    moved = F.greatest(F.floor(x / unit + by) * unit, F.lit(0.0))
    return F.when(x < 0, x.cast("double")).otherwise(moved)
