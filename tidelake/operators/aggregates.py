"""Counts, ranges, watermarks, modes, spreads and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidelake.operators.joins import null_safe_join
from tidelake.operators.ordered import (
    ROWS_PER_BUCKET,
    at_fraction,
    largest_key,
    ranked_values,
    running_total,
    trimmed_mean,
)
from tidelake.session import materialize
from tidelake.sources.sinks import quoted

MAD_SCALE = 1.4826  # makes the median absolute deviation a standard deviation for normal data


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("num_rows"))


def stored_row_count(spark, table: str) -> int | None:
    """The row count statistics hold for a table, or None where none were computed."""
    stats = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)}").filter("col_name = 'Statistics'")
    found = stats.select(F.regexp_extract("data_type", r"(\d+) rows", 1)).first()
    return int(found[0]) if found and found[0] else None


def key_range(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))


def key_range_widest(
    df: DataFrame, key: str, profiled: DataFrame | None = None, sample_percent: float | None = None, seed: int = 42
) -> DataFrame:
    """The widest of a scanned range, exact or sampled, and a profiled one (columns ``lo``, ``hi``)."""
    rows = df if sample_percent is None else df.sample(sample_percent / 100.0, seed=seed)
    ranges = key_range(rows, key)
    if profiled is not None:
        ranges = ranges.unionByName(profiled.select("lo", "hi"))
    return ranges.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def grouped_range(df: DataFrame, group: str, key: str) -> DataFrame:
    return df.groupBy(group).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def watermark(df: DataFrame, key: str | Column) -> DataFrame:
    return df.agg(F.max(key).alias("watermark"))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def count_per_key(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))


def group_summary(df: DataFrame, group: str, key: str, count: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum(count).alias("rows")
    )


def mode_profile(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent value (the first in order on a tie), number of values, smallest and largest."""
    counts = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    )
    # min_by over (-count, value) settles ties by value order
    return counts.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col("_c"), F.col(value))).alias("high_freq"),
        F.max("_c").alias("freq"),
        F.count(F.lit(1)).alias("n_values"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    )


def spread_of(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    trim: float = 0.2,
    count: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    fits: bool | None = None,
) -> DataFrame:
    """Trimmed mean, median, scaled MAD, sample deviation and size, exact, per key.

    ``fits`` says whether every key is known to have at most ``rows_per_bucket`` rows; if not known it is counted.
    """
    keys = list(keys)
    fits = largest_key(df, keys) <= rows_per_bucket if fits is None else fits
    ranked = ranked_values(df, value, keys, count, rows_per_bucket=rows_per_bucket, fits=fits)
    x, mult = F.col(value).cast("double"), F.col("_mult")

    def centre(whole: WindowSpec | None) -> list[Column]:
        total, rows = F.sum(x * mult), F.sum(mult)
        mean = total / rows if whole is None else total.over(whole) / rows.over(whole)
        return [
            trimmed_mean(value, trim, whole).alias("trimmed_mean"),
            at_fraction(value, 0.5, whole).alias("median"),
            mean.alias("_mean"),
        ]

    if fits:  # the rows of a key are together already, so nothing is joined or shuffled again
        centred = ranked.select("*", *centre(Window.partitionBy(*(keys or [F.lit(0)]))))
    else:  # ranks are used twice; the centres, written, are small enough to be broadcast or split
        ranked = materialize(ranked, "ranks")
        centred = _attach(ranked, materialize(ranked.groupBy(*keys).agg(*centre(None)), "centres"), keys)
    gap = x - F.col("_mean")
    away = centred.select(
        *keys, F.abs(x - F.col("median")).alias("_away"), (gap * gap * mult).alias("_square"), "_mult", "trimmed_mean", "median"
    )
    kept = {"_squares": F.sum("_square"), "trimmed_mean": F.max("trimmed_mean"), "median": F.max("median")}
    return (
        ranked_values(away, "_away", keys, "_mult", kept, rows_per_bucket, fits)
        .groupBy(*keys)
        .agg(
            F.sum(mult).alias("n"),
            F.max("trimmed_mean").alias("trimmed_mean"),
            F.max("median").alias("median"),
            (at_fraction("_away", 0.5) * MAD_SCALE).alias("mad"),
            F.when(F.sum(mult) > 1, F.sqrt(F.sum("_squares") / (F.sum(mult) - 1))).alias("sd"),
        )
    )


def spread_of_few(df: DataFrame, value: str, keys: Sequence[str], trim: float = 0.2) -> DataFrame:
    """As ``spread_of`` from one aggregate, for keys of few values, which it gathers."""
    def middle(a: str) -> str:
        return f"({a}[CAST((size({a}) - 1) DIV 2 AS INT)] + {a}[CAST(size({a}) DIV 2 AS INT)]) / 2"

    x = F.col(value).cast("double")
    skip = f"CAST(floor(_n * {float(trim)!r}D) AS INT)"
    return (
        df.filter(F.col(value).isNotNull()).groupBy(*keys)
        .agg(F.array_sort(F.collect_list(x)).alias("_all"), F.count(F.lit(1)).alias("_n"), F.stddev_samp(x).alias("sd"))
        .select(*keys, "_all", "_n", "sd", F.expr(middle("_all")).alias("median"),
                F.expr(f"slice(_all, {skip} + 1, CAST(_n AS INT) - 2 * {skip})").alias("_inner"))
        .select(*keys, F.col("_n").alias("n"), F.expr("aggregate(_inner, 0D, (s, v) -> s + v) / size(_inner)").alias("trimmed_mean"), "median",
                F.array_sort(F.transform("_all", lambda v: F.abs(v - F.col("median")))).alias("_away"), "sd")
        .select(*keys, "n", "trimmed_mean", "median", (F.expr(middle("_away")) * MAD_SCALE).alias("mad"), "sd")
    )


def _attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add per-key columns; without keys ``right`` is a single row, added as literals."""
    if keys:
        return null_safe_join(left, right, keys, "left")
    row = right.first()
    return left.select(
        "*", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in right.schema]
    )


def quantile_of(
    df: DataFrame, value: str, fraction: float, keys: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """The exact, linearly interpolated quantile per key."""
    ranked = ranked_values(df, value, keys, rows_per_bucket=rows_per_bucket)
    return ranked.groupBy(*keys).agg(at_fraction(value, fraction).alias("quantile"))


def concat_per_key(
    df: DataFrame, key: str, order: str, text: str, bytes_per_part: int, separator: str = "\n",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Texts of a key joined in order; ``order`` is unique within a key.

    A key is cut into rows numbered by ``part``: a text goes to the part in
    which it ends, in steps of half of ``bytes_per_part``. So no task holds a
    whole hot key, and a part stays within the bytes given unless one text is
    more than half of them. Numbers rise and may leave gaps.
    """
    slim = df.select(key, order, text)
    width = F.coalesce(F.octet_length(text), F.lit(0)) + len(separator.encode())
    upto = running_total(slim, order, {"_upto": width}, [key], rows_per_bucket=rows_per_bucket)
    cut = upto.withColumn("part", F.floor((F.col("_upto") - 1) / max(bytes_per_part // 2, 1)).cast("bigint"))
    pieces = F.array_sort(F.collect_list(F.struct(order, text)))
    return cut.groupBy(key, "part").agg(
        F.array_join(F.transform(pieces, lambda p: p[text]), separator).alias("joined")
    )


def small_domain_values(df: DataFrame, columns: Sequence[str], limit: int = 200) -> DataFrame:
    """Distinct values, as text, of the columns with fewer than ``limit`` of them.

    One pass with sketches drops the columns that are clearly larger; the rest
    are counted exactly.
    """
    sketch = df.agg(*[F.approx_count_distinct(c, 0.05).alias(c) for c in columns]).first()
    near = [c for c in columns if sketch[c] < 2 * limit]
    if not near:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in near])
    )
    values = materialize(df.select(cells.alias("c")).select("c.*").filter("value IS NOT NULL").distinct(), "domains")
    sizes = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < limit)
    return values.join(sizes.select("column_name"), "column_name", "left_semi")
