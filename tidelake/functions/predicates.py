"""Typed comparisons and range slices as Columns."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = ("=", "!=", "<", "<=", ">", ">=")
# dashed or slashed dates only: digit strings, week dates and times with an offset are text
_DATE = re.compile(r"\d{4}([-/])\d{2}\1\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?")


def literal_class(value) -> str:
    """``num``, ``str``, ``date`` or ``timestamp``; text that reads as a date counts as one."""
    if isinstance(value, dt.datetime):
        return "timestamp"
    if isinstance(value, dt.date):
        return "date"
    if isinstance(value, str):
        text = value.strip()
        if not _DATE.fullmatch(text):
            return "str"
        try:
            dt.datetime.fromisoformat(text.replace("/", "-"))
        except ValueError:
            return "str"
        return "timestamp" if len(text) > 10 else "date"
    return "num"


def _plain(column: Column, op: str, value) -> Column:
    return {
        "=": column == value,
        "!=": column != value,
        "<": column < value,
        "<=": column <= value,
        ">": column > value,
        ">=": column >= value,
    }[op]


def _span(column: Column, op: str, first, after) -> Column:
    """Compare the unit [first, after) a typed value falls into; pushes down as a range."""
    return {
        "=": (column >= first) & (column < after),
        "!=": (column < first) | (column >= after),
        "<": column < first,
        "<=": column < after,
        ">": column >= after,
        ">=": column >= first,
    }[op]


def compare_prefix(column: Column, op: str, text: str) -> Column:
    """Compare the first ``len(text)`` characters of a text column with ``text``.

    Written without ``substring`` so that it reaches the Parquet scan.
    """
    same = column.startswith(text)
    return {
        "=": same,
        "!=": ~same,
        "<": column < text,
        "<=": (column < text) | same,
        ">": (column > text) & ~same,
        ">=": column >= text,
    }[op]


def compare(column: str | Column, value, op: str = "=", landed: bool = False) -> Column:
    """Compare a column with a literal by the literal's class.

    Numbers compare raw, text as text, dates by day and timestamps by second.
    ``landed`` columns hold dates as text, day first then time.
    """
    if op not in _OPS:
        raise ValueError(f"unknown comparison {op!r}")
    col = F.col(column) if isinstance(column, str) else column
    kind = literal_class(value)
    if kind in ("num", "str"):
        return _plain(col, op, value)
    moment = value if isinstance(value, dt.date) else dt.datetime.fromisoformat(value.strip().replace("/", "-"))
    if kind == "date":
        day = moment.date() if isinstance(moment, dt.datetime) else moment
        if landed:
            return compare_prefix(col, op, day.isoformat())
        return _span(col, op, F.lit(day), F.lit(day + dt.timedelta(days=1)))
    if moment.tzinfo is not None:
        raise ValueError("columns hold times without a zone; convert the value first")
    second = moment.replace(microsecond=0)
    if landed:
        return compare_prefix(col, op, second.strftime("%Y-%m-%d %H:%M:%S"))
    ntz = [F.lit(str(m)).cast("timestamp_ntz") for m in (second, second + dt.timedelta(seconds=1))]
    return _span(col, op, *ntz)


def landed_day(column: str | Column) -> Column:
    """The day of a date landed as text; unreadable text gives NULL."""
    return F.substring(column, 1, 10).try_cast("date")


def landed_second(column: str | Column) -> Column:
    """The second of a time landed as text; a date alone is its midnight, unreadable text gives NULL."""
    return F.substring(column, 1, 19).try_cast("timestamp_ntz")


def in_range(column: str, low, high, closed: bool = False) -> Column:
    """``low <= column < high``; ``closed`` keeps the upper end, as slices with shared ends once did."""
    col = F.col(column)
    return col.between(low, high) if closed else (col >= low) & (col < high)


def percent_sample(df: DataFrame, percent: float, low: float = 1e-6, high: float = 99.99, seed: int = 42) -> DataFrame:
    """A seeded sample of ``percent`` of the rows, clipped to [low, high] percent."""
    return df.sample(fraction=min(max(percent, low), high) / 100.0, seed=seed)


def sample_percent_for(rows: int, wanted: int = 500) -> float:
    """The percentage that gives about ``wanted`` rows."""
    return min(max(100.0 * wanted / max(rows, 1), 1e-6), 99.99)
