"""Import styles and the slices a table is read in.

Every slice is half-open, so a value on a boundary is read once, and rows
without a key have a slice of their own.
"""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.operators.joins import null_safe_join
from tidelake.operators.ordered import ROWS_PER_BUCKET, cuts_below, running_total
from tidelake.session import materialize


def _sql_literal(value) -> str:
    """A literal any JDBC source reads; dates as JDBC escapes."""
    if isinstance(value, dt.datetime):
        return "{ts '" + value.strftime("%Y-%m-%d %H:%M:%S.%f") + "'}"
    if isinstance(value, dt.date):
        return "{ts '" + value.strftime("%Y-%m-%d") + " 00:00:00'}"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, Decimal):
        return format(value, "f")
    return repr(value)


@dataclass(frozen=True)
class Slice:
    """Rows with ``low <= key < high``, one ``point`` value, or no key at all. A bound of None is open."""

    key: str
    low: object = None
    high: object = None
    point: object = None
    no_key: bool = False

    def column(self) -> Column:
        col = F.col(self.key)
        if self.no_key:
            return col.isNull()
        if self.point is not None:
            return col == F.lit(self.point)
        bounds = [col >= F.lit(self.low)] if self.low is not None else []
        bounds += [col < F.lit(self.high)] if self.high is not None else []
        return reduce(Column.__and__, bounds) if bounds else col.isNotNull()

    def sql(self) -> str:
        if self.no_key:
            return f"{self.key} IS NULL"
        if self.point is not None:
            return f"{self.key} = {_sql_literal(self.point)}"
        bounds = [f"{self.key} >= {_sql_literal(self.low)}"] if self.low is not None else []
        bounds += [f"{self.key} < {_sql_literal(self.high)}"] if self.high is not None else []
        return " AND ".join(bounds) or f"{self.key} IS NOT NULL"


def import_style(tables: DataFrame) -> DataFrame:
    """Choose an import style for every analysed table.

    ``tables`` holds per table: num_rows, rows_per_split, rows_per_job,
    connections, split_key, job_key, job_key_ndv, job_key_type, drift,
    is_partitioned, is_view and force_pointable.
    """
    n, per_split, per_job = F.col("num_rows"), F.col("rows_per_split"), F.col("rows_per_job")
    split = F.floor(n / per_split) > 1
    job_split = (F.floor(n / per_job) > 1) & split
    ndv = F.col("job_key_ndv")
    sized = tables.select(
        "*",
        split.alias("split_required"),
        job_split.alias("job_split_required"),
        F.greatest(F.bround(n / per_job), F.lit(2.0)).cast("bigint").alias("njobs"),
        (F.col("split_key") == F.col("job_key")).alias("same_key"),
    )
    forced = F.col("force_pointable") | (
        F.col("is_partitioned") & ~F.col("same_key") & (F.col("job_key_type") != "DATE")
    )
    near = F.abs(F.col("njobs") - ndv) / (ndv + F.col("njobs")) < 0.35
    ruled = sized.select(
        "*",
        (forced | near).alias("pointable"),
        (F.col("is_view") | (F.col("drift") > 0.7)).alias("key_fixed"),
    )
    point, fixed, same = F.col("pointable"), F.col("key_fixed"), F.col("same_key")
    style = (
        F.when(~F.col("split_required"), "PLAIN")
        .when(~F.col("job_split_required"), "SPLIT")
        .when(point & fixed & ~same, "POINT+FIXED")
        .when(~point & fixed & ~same, "RANGE+FIXED")
        .when(~point & ~fixed & same, "RANGE+SAME_RANGE")
        .otherwise("JOB_SPLIT_UNKNOWN")
    )
    splits = F.when(F.col("job_split_required"), F.bround(per_job / per_split)).otherwise(F.bround(n / per_split))
    return ruled.select(
        *tables.columns,
        "split_required", "job_split_required", "njobs", "pointable", "key_fixed",
        style.alias("style"),
        F.when(F.col("split_required"), F.least(splits, F.col("connections"))).otherwise(1).cast("bigint").alias("splits"),
    )


def point_slices(df: DataFrame, key: str) -> DataFrame:
    """One row per distinct key value: the point slices of a table."""
    return df.select(F.col(key).alias("point")).distinct()


def point_ranges(points: DataFrame, njobs: int) -> DataFrame:
    """At most ``njobs`` neighbouring ranges (``from_key``, ``to_key``) that hold about equally many of the point values.

    Only the bounds are gathered, however many values there are.
    """
    known = points.filter("point IS NOT NULL").repartitionByRange(njobs, "point")
    starts = known.groupBy(F.spark_partition_id().alias("_part")).agg(F.min("point").alias("from_key"))
    after = F.lead("from_key").over(Window.partitionBy(F.lit(0)).orderBy("from_key"))  # one row per range
    return starts.select("from_key", after.alias("to_key"))


def range_slices(ranges: DataFrame, njobs: str | int = "njobs", keys: Sequence[str] = ()) -> DataFrame:
    """Cut each range (columns ``lo`` and ``hi``, dates or whole numbers) into equal half-open slices.

    The last slice ends one unit after ``hi``; slices of no width are left out.
    """
    is_day = ranges.schema["lo"].dataType.simpleString() == "date"
    jobs = F.lit(njobs) if isinstance(njobs, int) else F.col(njobs)
    span = F.datediff("hi", "lo") if is_day else F.col("hi") - F.col("lo")
    return _cut(ranges, span, jobs, is_day, keys)


def strict_slices(ranges: DataFrame, gap: int, keys: Sequence[str] = ()) -> DataFrame:
    """Cut each given date range into slices of about ``gap`` days; nothing between ranges is read."""
    span = F.datediff("hi", "lo")
    points = F.greatest(F.bround(span / F.least(F.lit(gap), span) + 0.9), F.lit(1.0))
    pieces = F.when(span == 0, 1).otherwise(F.greatest(points - 1, F.lit(1.0))).cast("bigint")
    return _cut(ranges, span, pieces, True, keys)


def _cut(ranges: DataFrame, span: Column, pieces: Column, is_day: bool, keys: Sequence[str]) -> DataFrame:
    if is_day:
        def at(offset: Column) -> Column:
            return F.date_add("lo", offset.cast("int"))
    else:
        def at(offset: Column) -> Column:
            return F.col("lo") + offset
    numbered = ranges.filter("lo IS NOT NULL AND hi IS NOT NULL").select(
        *keys, "lo", "hi", span.cast("bigint").alias("_span"), pieces.cast("bigint").alias("_n")
    )
    each = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("slice_no"))
    # as decimals, since the product of a wide span and a slice number passes a bigint
    start = F.expr("(CAST(_span AS DECIMAL(19,0)) * slice_no) div _n")
    end = F.when(F.col("slice_no") == F.col("_n") - 1, F.col("_span") + 1).otherwise(
        F.expr("(CAST(_span AS DECIMAL(19,0)) * (slice_no + 1)) div _n")
    )
    return each.select(*keys, "slice_no", at(start).alias("from_key"), at(end).alias("to_key")).filter(
        "from_key < to_key"
    )


def to_slices(slices: DataFrame, key: str, null_slice: bool = True, open_ends: bool = False) -> list[Slice]:
    """The slice list of one table, ready for a JDBC read.

    ``open_ends`` leaves the first and the last range without a bound, so that
    rows which came in since the planning are read as well.
    """
    if "point" in slices.columns:
        points = [r["point"] for r in slices.select("point").collect()]
        out = [Slice(key, point=p) for p in sorted(p for p in points if p is not None)]
    else:
        out = [
            Slice(key, low=r["from_key"], high=r["to_key"])
            for r in slices.orderBy("from_key").collect()
        ]
        if open_ends and out:
            out[0] = replace(out[0], low=None)
            out[-1] = replace(out[-1], high=None)
    return [*out, Slice(key, no_key=True)] if null_slice else out


def slice_coverage(df: DataFrame, key: str, slices: Iterable[Slice]) -> DataFrame:
    """How many rows no slice, one slice, or several slices hold.

    Values are counted first, so each distinct key is tested once. The ranges
    that hold a value are those begun at or before it less those ended by then,
    two searches in sorted bounds instead of a test of every slice.
    """
    slices = list(slices)
    col = F.col(key)
    ranges = [s for s in slices if not s.no_key and s.point is None and (s.low is None or s.high is None or s.low < s.high)]
    points = Counter(s.point for s in slices if s.point is not None)
    held = F.lit(0)
    if ranges:
        lows, highs = [s.low for s in ranges if s.low is not None], [s.high for s in ranges if s.high is not None]
        held = held + (len(ranges) - len(lows))  # open ranges have begun before any value
        if lows:
            held = held + cuts_below(F.array(*[F.lit(b) for b in sorted(lows)]), col, inclusive=True)
        if highs:
            held = held - cuts_below(F.array(*[F.lit(b) for b in sorted(highs)]), col, inclusive=True)
    for times in set(points.values()):
        held = held + F.when(col.isin([p for p, n in points.items() if n == times]), times).otherwise(0)
    held = F.when(col.isNull(), sum(s.no_key for s in slices)).otherwise(held)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return counts.groupBy(held.alias("slices_holding")).agg(F.sum("rows").alias("rows"))


def swept(df: DataFrame, key: str, slices: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Every distinct key of ``df`` with its ``rows`` and how many of the slices hold it, ``slices_holding``.

    ``slices`` has ``from_key`` and ``to_key``, half-open, of which a NULL
    leaves that side open, and, if it likes, ``point`` and ``no_key``; rows
    with a point or without a key ignore the bounds. Slices may overlap and be
    of any number: their starts and ends become events beside the counted
    keys, and a running total along the key, in buckets, is what holds a key.
    Keys are numbers, dates or timestamps.
    """
    columns = {c: F.col(c) if c in slices.columns else F.lit(None) for c in ("point", "no_key")}
    kind = df.schema[key].dataType
    cut = slices.select(F.col("from_key").cast(kind).alias("_from"), F.col("to_key").cast(kind).alias("_to"),
                        columns["point"].cast(kind).alias("_point"), F.coalesce(columns["no_key"].cast("boolean"), F.lit(False)).alias("_none"))
    ranges = cut.filter(~F.col("_none") & F.col("_point").isNull() & (F.col("_from").isNull() | F.col("_to").isNull() | (F.col("_from") < F.col("_to"))))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def events(source: DataFrame, at: str, moves: Column, here: Column, rows: Column) -> DataFrame:
        return source.select(F.col(at).alias("_at"), moves.alias("_moves"), here.alias("_here"), rows.alias("rows"))

    counted = df.groupBy(F.col(key).alias("_at")).agg(F.count(F.lit(1)).alias("rows"))
    all_ = (
        events(counted, "_at", zero, zero, F.col("rows"))
        .unionByName(events(ranges.filter("_from IS NOT NULL"), "_from", one, zero, zero))
        .unionByName(events(ranges.filter("_to IS NOT NULL"), "_to", -one, zero, zero))
        .unionByName(events(cut.filter("NOT _none AND _point IS NOT NULL"), "_point", zero, one, zero))
    )
    # ranges without a start hold from the first key on
    fixed = cut.agg(F.count_if("_none").alias("none")).join(ranges.agg(F.count_if(F.col("_from").isNull()).alias("begun")), F.lit(True)).first()
    merged = materialize(all_.groupBy("_at").agg(*[F.sum(c).alias(c) for c in ("_moves", "_here", "rows")]), "sweep-events")
    summed = running_total(merged.filter("_at IS NOT NULL"), "_at", {"_open": "_moves"}, rows_per_bucket=rows_per_bucket)
    keyed = summed.select(F.col("_at").alias(key), "rows", (F.col("_open") + F.col("_here") + fixed["begun"]).alias("slices_holding"))
    without = merged.filter("_at IS NULL").select(F.col("_at").alias(key), "rows", F.lit(fixed["none"]).cast("bigint").alias("slices_holding"))
    return keyed.unionByName(without).filter("rows > 0")


def coverage_of(df: DataFrame, key: str, slices: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """As ``slice_coverage``, for slices of any number given as rows (see ``swept``)."""
    return swept(df, key, slices, rows_per_bucket).groupBy("slices_holding").agg(F.sum("rows").alias("rows"))


def rows_in_slices(df: DataFrame, key: str, slices: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The rows that any of the slices holds, each once."""
    held = materialize(swept(df, key, slices, rows_per_bucket).filter("slices_holding > 0").select(key), "held-keys")
    return null_safe_join(df, held, [key], "left_semi")
