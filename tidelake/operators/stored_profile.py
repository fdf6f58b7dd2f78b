"""Column profiles kept per partition, so that a load profiles only what it brought.

The store is a Parquet folder with a row per partition and run: the bytes and
the file names (as a mark) the partition then had, its rows and, for every
column, the values present, their bytes, the lowest and highest, whether all
are days, and a HyperLogLog sketch. All of these merge, so a table's profile is
an aggregate over some kilobytes per partition and column, however many rows it
has.

A partition whose files have changed is profiled anew and its last run
counts; partitions the folder does not have any more are left out. A column
that older runs do not know counts as NULL there.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators.joins import filter_by_keys, null_safe_join
from tidelake.operators.profile import _TEMPORAL, _WIDTHS, as_text
from tidelake.session import materialize
from tidelake.sources.days import listed_partitions
from tidelake.sources.sinks import path_exists

#: Sketch size as a power of two; the standard error of a distinct count is 1.04 / sqrt(2 ** SKETCH_BITS).
SKETCH_BITS = 12
_TEXTS = (T.StringType, T.BinaryType)


def _sketched(column: str, kind: T.DataType) -> Column:
    """A column as a type the sketch takes, equal exactly where values are equal."""
    col = F.col(f"`{column}`")
    if isinstance(kind, (*_TEXTS, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return col.cast("bigint") if not isinstance(kind, _TEXTS) else col
    if isinstance(kind, T.BooleanType):
        return col.cast("int")
    if isinstance(kind, T.DateType):
        return F.unix_date(col)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (col + F.lit(0.0)).cast("string")  # -0.0 equals 0.0
    return col.cast("string")


def profile_partitions(df: DataFrame, partition: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per partition: ``partition``, ``num_rows`` and ``cols``, a struct per column. One pass."""
    types = {f.name: f.dataType for f in df.schema}
    columns = list(columns or df.columns)
    aggs: list[Column] = [F.count(F.lit(1)).alias("num_rows")]
    for i, c in enumerate(columns):
        col, kind = F.col(f"`{c}`"), types[c]
        width = F.sum(F.octet_length(col)) if isinstance(kind, _TEXTS) else F.count(col) * _WIDTHS.get(kind.simpleString(), 8)
        days = F.bool_and(col.cast("date").cast(kind) == col) if isinstance(kind, _TEMPORAL) else F.lit(False)
        aggs += [
            F.count(col).alias(f"_n{i}"), width.cast("bigint").alias(f"_w{i}"), F.min(col).alias(f"_lo{i}"), F.max(col).alias(f"_hi{i}"),
            days.alias(f"_d{i}"), F.hll_sketch_agg(_sketched(c, kind), F.lit(SKETCH_BITS)).alias(f"_s{i}"),
        ]
    one = df.groupBy(partition.cast("string").alias("_partition")).agg(*aggs)
    cells = [
        F.struct(F.col(f"_n{i}").alias("n"), F.col(f"_w{i}").alias("width"), F.col(f"_lo{i}").alias("lo"), F.col(f"_hi{i}").alias("hi"),
                 F.col(f"_d{i}").alias("days"), F.col(f"_s{i}").alias("sketch")).alias(c)
        for i, c in enumerate(columns)
    ]
    return one.select(F.col("_partition").alias("partition"), "num_rows", F.struct(*cells).alias("cols"))


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The last run of every partition in the store."""
    rows = spark.read.option("mergeSchema", True).parquet(store)
    last = rows.groupBy(F.col("partition").alias("_p")).agg(F.max("run").alias("_run"))
    # the winners are found without moving a sketch
    return rows.join(last, F.col("partition").eqNullSafe(F.col("_p")) & (F.col("run") == F.col("_run")), "left_semi")


def refresh(spark: SparkSession, store: str, path: str, column: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Profile the partitions of a folder whose files the store does not know and return the current rows of the store.

    ``column`` is the folder's partition column. What is new is told from the
    listing, so no row of an unchanged partition is read.
    """
    source = spark.read.parquet(path)
    kind = source.schema[column].dataType
    listed = listed_partitions(spark, path, column).select(F.col("value").cast(kind).cast("string").alias("partition"), "bytes", "mark")
    stale = listed
    if path_exists(spark, store):
        known = read_store(spark, store).select("partition", "bytes", "mark")
        stale = null_safe_join(listed, known, ["partition", "bytes", "mark"], "left_anti")
    stale = materialize(stale, "stale-partitions")
    if not stale.isEmpty():
        wanted = stale.select(F.col("partition").cast(kind).alias("_wanted"))
        rows = filter_by_keys(source, F.col(column), wanted, "_wanted")
        if not stale.filter("partition IS NULL").isEmpty():
            rows = rows.unionByName(source.filter(F.col(column).isNull()))
        chosen = list(columns or [c for c in source.columns if c != column])
        found = profile_partitions(rows, F.col(column), chosen)
        fresh = null_safe_join(found, stale, ["partition"], "inner").withColumn("run", F.lit(time.time_ns()))
        fresh.write.mode("append").parquet(store)
    there = materialize(listed.select("partition"), "listed-partitions")
    return null_safe_join(read_store(spark, store), there, ["partition"], "left_semi")


def merged_profile(stored: DataFrame) -> DataFrame:
    """As ``profile_pass``, from rows of the store: everything exact but ``num_distinct``."""
    kinds = {f.name: f.dataType["lo"].dataType for f in stored.schema["cols"].dataType}
    aggs: list[Column] = [F.coalesce(F.sum("num_rows"), F.lit(0)).alias("_rows")]
    for i, c in enumerate(kinds):
        cell = F.col("cols")[c]
        aggs += [
            F.coalesce(F.sum(cell["n"]), F.lit(0)).alias(f"_n{i}"), F.sum(cell["width"]).alias(f"_w{i}"),
            F.min(cell["lo"]).alias(f"_lo{i}"), F.max(cell["hi"]).alias(f"_hi{i}"),
            F.coalesce(F.bool_and(cell["days"]), F.lit(False)).alias(f"_d{i}"),
            F.hll_sketch_estimate(F.hll_union_agg(cell["sketch"])).alias(f"_s{i}"),
        ]
    one = stored.agg(*aggs)
    fixed = {c: _WIDTHS.get(k.simpleString(), 8) for c, k in kinds.items() if not isinstance(k, _TEXTS)}
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(kind.simpleString()).alias("data_type"),
            F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("bigint").alias("num_distinct"), (F.col("_rows") - F.col(f"_n{i}")).alias("num_nulls"),
            (F.col("_rows") > F.col(f"_n{i}")).alias("is_null_ever"),
            (F.lit(float(fixed[c])) if c in fixed else F.try_divide(F.col(f"_w{i}").cast("double"), F.col(f"_n{i}"))).alias("avg_col_len"),
            as_text(f"_lo{i}", kind).alias("low_value"), as_text(f"_hi{i}", kind).alias("high_value"),
            F.col("_rows").alias("num_rows"), F.col(f"_d{i}").alias("is_date"),
        )
        for i, (c, kind) in enumerate(kinds.items())
    ]
    return one.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def stored_ranges(stored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As ``partition_ranges``, from rows of the store."""
    kinds = {f.name: f.dataType["lo"].dataType for f in stored.schema["cols"].dataType}

    def number(value: Column, kind: T.DataType) -> Column:
        return F.unix_date(value.cast("date")).cast("double") if isinstance(kind, _TEMPORAL) else value.try_cast("double")

    cells = []
    for c in columns:
        low, high = F.col("cols")[c]["lo"], F.col("cols")[c]["hi"]
        cells.append(F.struct(
            F.lit(c).alias("column_name"), low.cast("string").alias("lo_text"), high.cast("string").alias("hi_text"),
            number(low, kinds[c]).alias("lo_num"), number(high, kinds[c]).alias("hi_num")))
    return stored.select("partition", F.explode(F.array(*cells)).alias("s")).select("partition", "s.*")
