"""Text parsing used by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_in_kb(column: str | Column) -> Column:
    """``118.4MB`` as kilobytes; a unit other than B, KB, MB, GB gives NULL."""
    col = F.col(column) if isinstance(column, str) else column
    number = F.regexp_extract(col, r"[0-9.]+", 0).try_cast("double")
    unit = F.regexp_extract(col, r"[A-Za-z]+", 0)
    factor = (
        F.when(unit == "B", 1 / 1000)
        .when(unit == "KB", 1.0)
        .when(unit == "MB", 1000.0)
        .when(unit == "GB", 1_000_000.0)
    )
    return number * factor


def plain_log_line(column: str | Column) -> Column:
    """Lower case, only letters, digits and blanks, runs of blanks squeezed."""
    kept = F.regexp_replace(F.lower(column), "[^a-z 0-9]", "")
    return F.regexp_replace(kept, " {2,}", " ")
