"""Keyed tables in hash buckets, of which an upsert rewrites only those its keys fall into.

Rows lie in ``path/bucket=B/run=R``; a small list of (bucket, run) says which
run of a bucket counts. An upsert reads the touched buckets alone, writes
their new runs beside the old ones and then adds its lines to the list in one
file. Until that file is there, readers see the old runs; a run that died
before leaves folders nobody lists, which ``drop_unlisted`` deletes. Files of
other buckets are neither read nor written.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators.joins import key_set
from tidelake.plans.incremental import keyed_upsert
from tidelake.session import materialize
from tidelake.sources.sinks import _path, delete_path, path_exists

BUCKET = "bucket"
_LIST, _LAYOUT = "_runs", "_layout"
_LIST_SCHEMA = "bucket int, run bigint"
_LAYOUT_SCHEMA = "buckets int, keys array<string>, ddl string"


class Conflict(RuntimeError):
    """Another writer committed a touched bucket first; nothing was changed."""


def _bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def create_keyed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """A new keyed table of ``buckets`` buckets; a key may occur once."""
    spark = df.sparkSession
    if path_exists(spark, f"{path}/{_LAYOUT}"):
        raise ValueError(f"{path} holds a keyed table already")
    run = time.time_ns()
    _write(df, path, keys, buckets, run)
    layout = [(buckets, list(keys), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))]
    _commit(path, spark.range(buckets).select(F.col("id").cast("int").alias("bucket")), run)
    spark.createDataFrame(layout, _LAYOUT_SCHEMA).coalesce(1).write.parquet(f"{path}/{_LAYOUT}")


def _write(df: DataFrame, path: str, keys: Sequence[str], buckets: int, run: int) -> None:
    """One shuffle by bucket; Spark joins small buckets in a task and splits large ones."""
    placed = df.withColumn(BUCKET, _bucket_of(keys, buckets)).withColumn("run", F.lit(run)).hint("rebalance", BUCKET)
    placed.write.mode("append").partitionBy(BUCKET, "run").parquet(path)


def _commit(path: str, touched: DataFrame, run: int) -> None:
    """One file, which is there as a whole or not at all."""
    touched.select("bucket", F.lit(run).cast("bigint").alias("run")).coalesce(1).write.mode("append").parquet(f"{path}/{_LIST}")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The run that counts for every bucket."""
    lines = spark.read.schema(_LIST_SCHEMA).parquet(f"{path}/{_LIST}")
    return lines.groupBy("bucket").agg(F.max("run").alias("run"))


def _layout(spark: SparkSession, path: str):
    return spark.read.schema(_LAYOUT_SCHEMA).parquet(f"{path}/{_LAYOUT}").first()


def _rows_of(spark: SparkSession, path: str, layout, current: list[tuple[int, int]]) -> DataFrame:
    """Rows of the given (bucket, run) folders; at most one per bucket, so the list is as long as the layout says."""
    schema = T.StructType.fromDDL(layout["ddl"])
    folders = [f"{path}/{BUCKET}={b}/run={r}" for b, r in current]
    there = [f for f in folders if path_exists(spark, f)]  # an empty bucket has no folder
    return spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a keyed table as of its last commit."""
    current = [(r["bucket"], r["run"]) for r in _listed(spark, path).collect()]
    return _rows_of(spark, path, _layout(spark, path), current)


def upsert_keyed(spark: SparkSession, path: str, new: DataFrame, order: str | None = None) -> list[int]:
    """New rows replace the rows of their key, in the buckets they fall into; returns these buckets.

    Of several new rows of a key the one with the largest ``order`` counts;
    without an order they are refused. A bucket that someone else changed
    meanwhile raises ``Conflict`` and leaves the table as it is.
    """
    layout = _layout(spark, path)
    keys, buckets = list(layout["keys"]), layout["buckets"]
    new = materialize(new, "upsert-rows")
    touched = sorted(r[0] for r in key_set(new.select(_bucket_of(keys, buckets).alias(BUCKET)), [BUCKET]).collect())
    if not touched:
        return []
    before = {r["bucket"]: r["run"] for r in _listed(spark, path).filter(F.col("bucket").isin(touched)).collect()}
    old = _rows_of(spark, path, layout, sorted(before.items()))
    columns = [f.name for f in T.StructType.fromDDL(layout["ddl"])]
    run = time.time_ns()
    _write(keyed_upsert(old, new, keys, order).select(*[F.col(f"`{c}`") for c in columns]), path, keys, buckets, run)
    after = {r["bucket"]: r["run"] for r in _listed(spark, path).filter(F.col("bucket").isin(touched)).collect()}
    if after != before:
        raise Conflict(f"{path}: buckets {sorted(b for b in touched if after.get(b) != before.get(b))} were changed by another writer")
    _commit(path, spark.createDataFrame([(b,) for b in touched], "bucket int"), run)
    return touched


def drop_unlisted(spark: SparkSession, path: str) -> int:
    """Delete runs that do not count any more, or never did; returns how many. No reader or writer may be at work."""
    current = {(r["bucket"], r["run"]) for r in _listed(spark, path).collect()}
    fs, pattern = _path(spark, f"{path}/{BUCKET}=*/run=*")
    gone = 0
    for status in fs.globStatus(pattern) or []:
        folder = status.getPath()
        bucket, run = int(folder.getParent().getName().split("=")[1]), int(folder.getName().split("=")[1])
        if (bucket, run) not in current:
            delete_path(spark, folder.toString())
            gone += 1
    return gone
