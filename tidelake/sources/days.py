"""A landing folder with a partition per day and a manifest of the days that are whole.

A load replaces the days it brings, each as a whole, and then adds them to the
manifest with the number, the bytes and a mark of the names of their files. So
the listing and the manifest tell which days are there without reading a row: a
folder that the manifest does not know, or knows otherwise, comes from a load
that died, and a day the manifest has but the listing has not was deleted.
"""

from __future__ import annotations

import hashlib
import time
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.joins import null_safe_join
from tidelake.session import materialize
from tidelake.sources import footers
from tidelake.sources.sinks import _path, path_exists

DAY = "landing_day"
MANIFEST = "_days"  # readers skip folders that begin so
MANIFEST_SCHEMA = "day date, files bigint, bytes bigint, mark string, num_rows bigint, run bigint"
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def listed_partitions(spark: SparkSession, path: str, column: str = DAY) -> DataFrame:
    """Every partition folder, from the listing alone: value (as text, NULL for the null partition), files, bytes, and a mark of the file names."""
    fs, pattern = _path(spark, f"{path}/{column}=*/*.parquet")
    found: dict[str | None, list[tuple[str, int]]] = {}
    for f in fs.globStatus(pattern) or []:
        folder = unquote(f.getPath().getParent().getName().split("=", 1)[1])
        found.setdefault(None if folder == _NULL_FOLDER else folder, []).append((f.getPath().getName(), f.getLen()))
    rows = [(value, len(files), sum(size for _, size in files), hashlib.md5("/".join(sorted(n for n, _ in files)).encode()).hexdigest())
            for value, files in found.items()]
    return spark.createDataFrame(rows, "value string, files bigint, bytes bigint, mark string")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of every day."""
    where = f"{path}/{MANIFEST}"
    if not path_exists(spark, where):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(where)
    return rows.groupBy("day").agg(F.max_by(F.struct("files", "bytes", "mark", "num_rows", "run"), "run").alias("e")).select("day", "e.*")


def day_states(spark: SparkSession, path: str) -> DataFrame:
    """day, state and, of the last load, num_rows: ``WHOLE``, ``TORN`` by a load that died, or ``LOST``. No row of the folder is read."""
    there = listed_partitions(spark, path).select(F.col("value").cast("date").alias("day"), F.col("bytes").alias("_bytes"), F.col("mark").alias("_mark"))
    known = _manifest(spark, path).withColumnRenamed("day", "_day")
    both = there.join(known, F.col("day").eqNullSafe(F.col("_day")), "full")
    same = (F.col("mark") == F.col("_mark")) & (F.col("bytes") == F.col("_bytes"))
    state = F.when(F.col("_mark").isNull(), "LOST").when(F.coalesce(same, F.lit(False)), "WHOLE").otherwise("TORN")
    return both.select(F.coalesce("day", "_day").alias("day"), state.alias("state"), "num_rows")


def whole_days(spark: SparkSession, path: str) -> DataFrame:
    """The days that can be relied on; a day without a date is not one."""
    return day_states(spark, path).filter("state = 'WHOLE' AND day IS NOT NULL").select("day")


def newest_day(spark: SparkSession, path: str) -> DataFrame:
    """The watermark of the folder, from its listing."""
    return whole_days(spark, path).agg(F.max("day").alias("watermark"))


def land_days(rows: DataFrame, path: str, day: Column) -> DataFrame:
    """Replace the days of ``rows`` in the folder and commit them; returns their manifest entries.

    ``day`` gives a row's day. Rows are shuffled by day once, so a day has few
    files; Spark splits a large day over several tasks. A load that dies
    before the commit leaves days that count as torn, and the same call again
    replaces them.
    """
    spark = rows.sparkSession
    before = materialize(listed_partitions(spark, path).select("value", "mark"), "days-before")
    dated = rows.withColumn(DAY, day.cast("date")).hint("rebalance", DAY)
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    brought = null_safe_join(listed_partitions(spark, path), before, ["value", "mark"], "left_anti")
    days = [r["value"] for r in brought.select("value").collect()]  # of one load
    mine = F.col(DAY).isin([d for d in days if d is not None]) if None not in days else F.col(DAY).isNull() | F.col(DAY).isin([d for d in days if d])
    counts = footers.row_count(spark, path, [DAY], mine).rows.select(F.col(DAY).cast("string").alias("value"), "num_rows")
    entries = null_safe_join(brought, counts, ["value"], "inner").select(
        F.col("value").cast("date").alias("day"), "files", "bytes", "mark", "num_rows", F.lit(time.time_ns()).alias("run"))
    entries = materialize(entries, "manifest")
    entries.coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    return entries.select("day", "files", "bytes", "num_rows")
