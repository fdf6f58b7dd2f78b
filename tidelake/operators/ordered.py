"""Work that needs an order: running totals, gaps, forward fill, exact ranks.

A plain window puts each partition into one task, and here a partition may be
the whole table or a third of it. So keys with more than ``rows_per_bucket``
rows are first cut into buckets along the order. Windows run inside a bucket;
one summary row per bucket carries the state to the next.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidelake.operators.joins import null_safe_join
from tidelake.session import materialize

BUCKET = "_bucket"
ROWS_PER_BUCKET = 1_000_000
MAX_CUTS = 1024
SAMPLES_PER_BUCKET = 5_000
_STEP = 32  # cuts are searched in two steps of about this size


def cuts_below(cuts: Column, value: Column, inclusive: bool = False) -> Column:
    """How many of the ascending ``cuts`` are below ``value``, or not above it if ``inclusive``."""
    def passed(c: Column) -> Column:
        return c <= value if inclusive else c < value

    heads = F.filter(cuts, lambda c, i: (i % _STEP == 0) & passed(c))
    block = F.size(heads)
    tail = F.filter(F.slice(cuts, (block - 1) * _STEP + 1, F.lit(_STEP)), passed)
    return F.when(block == 0, 0).otherwise((block - 1) * _STEP + F.size(tail))


def largest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the most frequent key; counts merge before the shuffle."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.agg(F.max("_rows")).first()[0] or 0


def bucket_by_order(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    fits: bool = False,
) -> tuple[DataFrame, bool]:
    """Add ``_bucket``, which never falls as ``order`` rises within a key.

    Keys that fit keep bucket 0. The flag says whether any key was cut. The
    order column is numeric, a date or a timestamp. ``fits`` says the caller
    has found no key with more than ``rows_per_bucket`` rows. One step makes at
    most ``MAX_CUTS`` buckets of a key; buckets that are still above twice the
    budget are cut again, until all fit or hold a single value.
    """
    keys = list(keys)
    largest = 0 if fits else largest_key(df, keys)
    if largest <= rows_per_bucket:
        return df.withColumn(BUCKET, F.lit(0).cast("bigint")), False
    cut = _cut_once(df, keys, order, rows_per_bucket, largest)
    while True:
        before, largest = largest, largest_key(cut, [*keys, BUCKET])
        if largest <= 2 * rows_per_bucket or largest >= before:
            return cut, True
        outer = cut.withColumnRenamed(BUCKET, "_outer")
        again = _cut_once(outer, [*keys, "_outer"], order, rows_per_bucket, largest)
        cut = again.withColumn(BUCKET, F.col("_outer") * MAX_CUTS + F.col(BUCKET)).drop("_outer")


def _cut_once(df: DataFrame, keys: list[str], order: str, rows_per_bucket: int, largest: int) -> DataFrame:
    """Add ``_bucket``, up to ``MAX_CUTS`` of them per key."""
    cuts = min(MAX_CUTS, math.ceil(2 * largest / rows_per_bucket))
    at = F.percentile_approx(order, [i / cuts for i in range(1, cuts)], 10_000).alias("_cuts")
    # a sample places the cuts, as in Spark's range partitioning; every row then goes to its bucket
    slim = df.select(*keys, order).sample(min(1.0, SAMPLES_PER_BUCKET / rows_per_bucket), seed=42)
    if not keys:
        points = slim.agg(at).first()[0] or []
        literal = F.array(*[F.lit(p) for p in points])
        return df.withColumn(BUCKET, cuts_below(literal, F.col(order)).cast("bigint"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = materialize(sizes.filter(F.col("_rows") > rows_per_bucket).select(*keys), "hot-keys")
    bounds = materialize(
        null_safe_join(slim, hot, keys, "left_semi").groupBy(*keys).agg(at), "order-cuts"
    )
    out = null_safe_join(df, bounds, keys, "left")
    bucket = F.when(F.col("_cuts").isNull(), 0).otherwise(cuts_below(F.col("_cuts"), F.col(order)))
    return out.withColumn(BUCKET, bucket.cast("bigint")).drop("_cuts")


def running_total(
    df: DataFrame,
    order: str,
    weights: Mapping[str, str | Column],
    keys: Sequence[str] = (),
    totals: Mapping[str, str | Column] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    fits: bool = False,
) -> DataFrame:
    """Inclusive running sums of ``weights`` along a unique ``order`` within ``keys``.

    ``totals`` adds sums over the whole key.
    """
    keys, totals = list(keys), dict(totals or {})
    cut, split = bucket_by_order(df, keys, order, rows_per_bucket, fits)
    part = [*keys, BUCKET]
    # without cuts the keys alone, so that later work per key needs no other shuffle
    inside = Window.partitionBy(*(keys if keys and not split else part))
    upto = inside.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if not split:
        return cut.select(
            *df.columns,
            *[F.sum(w).over(upto).alias(n) for n, w in weights.items()],
            *[F.sum(w).over(inside).alias(n) for n, w in totals.items()],
        )
    sums = cut.groupBy(*part).agg(
        *[F.sum(w).alias(f"_sum_{n}") for n, w in {**weights, **totals}.items()]
    )
    whole = Window.partitionBy(*keys)  # one row per bucket
    before = whole.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *part,
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_from_{n}") for n in weights],
        *[F.sum(f"_sum_{n}").over(whole).alias(n) for n in totals],
    )
    local = cut.select("*", *[F.sum(w).over(upto).alias(f"_in_{n}") for n, w in weights.items()])
    return null_safe_join(local, carried, part, "left").select(
        *df.columns,
        *[(F.col(f"_from_{n}") + F.col(f"_in_{n}")).alias(n) for n in weights],
        *totals,
    )


def previous_value(
    df: DataFrame,
    order: str,
    out: str,
    keys: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    fits: bool = False,
) -> DataFrame:
    """The ``order`` value of the row before, within ``keys``."""
    keys = list(keys)
    cut, split = bucket_by_order(df, keys, order, rows_per_bucket, fits)
    part = [*keys, BUCKET]
    lagged = F.lag(order).over(Window.partitionBy(*part).orderBy(order))
    if not split:
        return cut.select(*df.columns, lagged.alias(out))
    tops = cut.groupBy(*part).agg(F.max(order).alias("_top"))
    carried = tops.select(
        *part, F.lag("_top").over(Window.partitionBy(*keys).orderBy(BUCKET)).alias("_carried")
    )
    local = cut.withColumn("_local", lagged)
    return null_safe_join(local, carried, part, "left").select(
        *df.columns, F.coalesce("_local", "_carried").alias(out)
    )


def forward_fill(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Give blank text (NULL or only spaces) the last non-blank value before it."""
    keys = list(keys)
    clean = df
    for c in columns:
        clean = clean.withColumn(c, F.when(F.trim(c) != "", F.col(c)))
    cut, split = bucket_by_order(clean, keys, order, rows_per_bucket)
    part = [*keys, BUCKET]
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select(
        *[c for c in [*df.columns, BUCKET] if c not in columns],
        *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in columns],
    )
    if not split:
        return local.select(*df.columns)
    ends = cut.groupBy(*part).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_end_{c}") for c in columns]
    )
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *part, *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_from_{c}") for c in columns]
    )
    return null_safe_join(local, carried, part, "left").select(
        *[F.coalesce(c, f"_from_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def gap_groups(
    dates: DataFrame, day: str, gap: int = 6, rows_per_bucket: int = ROWS_PER_BUCKET, keys: Sequence[str] = ()
) -> DataFrame:
    """Number runs of dates within ``keys``: a date ``gap`` or more days after the one before starts a run."""
    keys = list(keys)
    known = materialize(dates.select(*keys, day).filter(F.col(day).isNotNull()).distinct(), "dates")
    fits = largest_key(known, keys) <= rows_per_bucket
    lagged = previous_value(known, day, "_prev", keys, rows_per_bucket, fits)
    starts = lagged.select(
        *keys, day,
        F.when(F.col("_prev").isNull() | (F.datediff(day, "_prev") >= gap), 1).otherwise(0).alias("_start"),
    )
    return running_total(
        starts, day, {"group_id": "_start"}, keys, rows_per_bucket=rows_per_bucket, fits=fits
    ).drop("_start")


def gap_ranges(groups: DataFrame, day: str, keys: Sequence[str] = ()) -> DataFrame:
    """First and last date of every run, the input of strict slices."""
    return groups.groupBy(*keys, "group_id").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))


def row_budget_groups(
    counts: DataFrame, key: str, count: str, budget: int, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Cut ordered keys into groups of about ``budget`` rows.

    A key opens a group when the running count passes a multiple of the
    budget, or when its own count is above the budget. Rows without a key
    form a group of their own, -1.
    """
    counts = materialize(counts, "key-counts")
    known = counts.filter(F.col(key).isNotNull())
    fits = largest_key(known, []) <= rows_per_bucket
    summed = running_total(known, key, {"running": count}, rows_per_bucket=rows_per_bucket, fits=fits)
    inside = F.col("running") % budget
    inside_before = (F.col("running") - F.col(count)) % budget
    opened = summed.withColumn(
        "_opens", ((inside < inside_before) | (F.col(count) > budget)).cast("long")
    )
    grouped = running_total(opened, key, {"group_id": "_opens"}, rows_per_bucket=rows_per_bucket, fits=fits)
    missing = counts.filter(F.col(key).isNull()).select(
        *counts.columns, F.lit(None).cast("long").alias("running"), F.lit(-1).cast("long").alias("group_id")
    )
    return grouped.drop("_opens").unionByName(missing)


def ranked_values(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    count: str | None = None,
    extra: Mapping[str, Column] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    fits: bool | None = None,
) -> DataFrame:
    """Each value once per key with the ranks it fills: ``_lo`` (0-based) up to, not including, ``_hi`` of ``_n``.

    Equal values are merged before the shuffle, so a value that fills a third
    of the rows costs one row. ``count`` is a multiplicity column, ``extra``
    further aggregates to keep per value. ``fits`` says whether every key is
    known to have at most ``rows_per_bucket`` rows; if not known it is counted.
    """
    mult = F.sum(count) if count else F.count(F.lit(1))
    kept = [agg.alias(name) for name, agg in (extra or {}).items()]
    if fits is None:
        fits = largest_key(df, keys) <= rows_per_bucket
    values = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(mult.cast("long").alias("_mult"), *kept)
    if not fits:
        values = materialize(values, "value-counts")
    ranked = running_total(
        values, value, {"_hi": "_mult"}, keys, totals={"_n": "_mult"}, rows_per_bucket=rows_per_bucket, fits=fits
    )
    return ranked.withColumn("_lo", F.col("_hi") - F.col("_mult"))


def dense_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """Each distinct value of a key once with its dense rank, ``out``, from 1; values of any type, NULL left out.

    The distinct values are range-partitioned and written, so a partition holds
    neighbours and no key is one task. A partition numbers its values itself;
    one row per key and partition carries the numbers on.
    """
    keys = list(keys)
    known = df.select(*keys, value).filter(F.col(value).isNotNull()).distinct()
    spread = known.repartitionByRange(partitions, *keys, value) if partitions else known.repartitionByRange(*keys, value)
    placed = materialize(spread.withColumn("_part", F.spark_partition_id()), "ranked-values")
    inside = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(value))
    sizes = placed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carried = sizes.select("_part", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    numbered = placed.withColumn("_in", inside)
    return null_safe_join(numbered, carried, ["_part", *keys], "left").select(*keys, value, (F.col("_from") + F.col("_in")).alias(out))


def at_fraction(value: str, fraction: float, whole: WindowSpec | None = None) -> Column:
    """The linearly interpolated quantile over ``ranked_values``: an aggregate, or one over the window ``whole``."""
    pos = f"((_n - 1) * {float(fraction)!r}D)"

    def at(rank: str) -> Column:
        hit = f"max(CASE WHEN _lo <= {rank} AND {rank} < _hi THEN CAST(`{value}` AS DOUBLE) END)"
        return _over(F.expr(hit), whole)

    low, high = at(f"floor({pos})"), at(f"ceil({pos})")
    return low + (high - low) * _over(F.expr(f"max({pos} - floor({pos}))"), whole)


def trimmed_mean(value: str, trim: float, whole: WindowSpec | None = None) -> Column:
    """As ``at_fraction``, the mean without ``floor(n * trim)`` rows at each end."""
    skip = f"floor(_n * {float(trim)!r}D)"
    kept = f"greatest(0L, least(_hi, _n - {skip}) - greatest(_lo, {skip}))"
    total = F.expr(f"sum(CAST(`{value}` AS DOUBLE) * {kept})")
    return _over(total, whole) / _over(F.expr(f"sum({kept})"), whole)


def _over(aggregate: Column, whole: WindowSpec | None) -> Column:
    return aggregate if whole is None else aggregate.over(whole)
