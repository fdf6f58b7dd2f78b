"""Counts, ranges and watermarks from Parquet footers, without reading a data page.

Spark's Parquet source of the second version answers COUNT, MIN and MAX from
the statistics of row groups. It does so for whole numbers, booleans and dates,
per partition if asked. Timestamps kept as 64-bit numbers are asked for as
numbers. Text may be cut off in footers and fractions leave out NaN, so these
are scanned, as is everything a file has no statistics for.

Statistics are found by a column's place in the file. Where files of one folder
were not written alike, that place may differ; so a range is confirmed by two
reads that skip row groups by name: none holds a key beyond a bound, and a row
holds the bound itself. The first reads no page unless the bound is wrong, the
second those of the pages that can hold it. A folder with one writer needs no
confirmation.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import Any, NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SECOND_VERSION = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.BooleanType)
_TIMES = (T.TimestampType, T.TimestampNTZType)
_EPOCH = dt.datetime(1970, 1, 1)


class Facts(NamedTuple):
    """A small table of facts, and whether footers gave all of it."""

    rows: DataFrame
    from_footers: bool


def _pushed(spark: SparkSession, path: str, schema: T.StructType, by: Sequence[str], aggregates: Sequence[Column],
            where: Column | None) -> list[Row] | None:
    """The aggregates from footers alone, or None where Spark would read pages or a file lacks statistics."""
    session = spark.newSession()  # settings of its own, so that queries planned meanwhile keep theirs
    for k, v in _SECOND_VERSION.items():
        session.conf.set(k, v)
    rows = session.read.schema(schema).parquet(path)
    if where is not None:
        rows = rows.filter(where)
    asked = rows.groupBy(*by).agg(*aggregates)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    if "PushedAggregation: []" in plan or "PushedAggregation" not in plan:
        return None
    try:
        return asked.collect()
    except (PySparkException, Py4JJavaError):
        return None  # no statistics, or not of the type asked for; a real fault shows again in the scan


def _flat(schema: T.StructType, key: str) -> bool:
    """Whether a column's place among the fields is its place in the file."""
    return not any(isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)) for f in schema) and key in schema.names


def row_count(spark: SparkSession, path: str, by: Sequence[str] = (), where: Column | None = None) -> Facts:
    """``num_rows`` of a folder, or of each value of its partition columns ``by``.

    ``where`` may name partition columns only.
    """
    source = spark.read.parquet(path)
    found = _pushed(spark, path, source.schema, by, [F.count(F.lit(1)).alias("num_rows")], where)
    schema = T.StructType([source.schema[c] for c in by] + [T.StructField("num_rows", T.LongType())])
    if found is not None:
        rows = [(*r[:-1], r["num_rows"] or 0) for r in found]  # of no row group the sum is null
        return Facts(spark.createDataFrame(rows, schema), True)
    rows = source if where is None else source.filter(where)
    return Facts(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("num_rows")), False)


def key_range(spark: SparkSession, path: str, key: str, by: Sequence[str] = (), confirm: bool = True) -> Facts:
    """``lo`` and ``hi`` of a column of a folder, or of each value of its partition columns ``by``.

    ``confirm`` may be false for folders whose files were all written alike.
    Groups are not confirmed, so with ``by`` and ``confirm`` the column is scanned.
    """
    source = spark.read.parquet(path)
    key = min((n for n in source.columns if n.upper() == key.upper()), key=lambda n: n != key, default=key)  # names are case-blind, as in queries
    kind = source.schema[key].dataType
    found = None
    if _flat(source.schema, key) and isinstance(kind, _WHOLE + _TIMES) and not (by and confirm):
        asked = T.StructType([T.StructField(f.name, T.LongType()) if f.name == key and isinstance(kind, _TIMES) else f for f in source.schema])
        found = _pushed(spark, path, asked, by, [F.min(f"`{key}`").alias("lo"), F.max(f"`{key}`").alias("hi")], None)
    schema = T.StructType([source.schema[c] for c in by] + [T.StructField(c, kind) for c in ("lo", "hi")])
    if found is not None:
        rows = [(*r[:-2], _value(r["lo"], kind), _value(r["hi"], kind)) for r in found]
        if not confirm or _holds(source, key, rows[0]):
            return Facts(spark.createDataFrame(rows, schema), True)
    return Facts(source.groupBy(*by).agg(F.min(f"`{key}`").alias("lo"), F.max(f"`{key}`").alias("hi")), False)


def _value(raw: Any, kind: T.DataType) -> Any:
    if raw is None or not isinstance(kind, _TIMES):
        return raw
    value = _EPOCH + dt.timedelta(microseconds=raw)
    return value if isinstance(kind, T.TimestampNTZType) else value.replace(tzinfo=dt.timezone.utc)


def _holds(source: DataFrame, key: str, bounds: tuple) -> bool:
    """Whether no row lies outside the bounds and some row lies on each; row groups are skipped by their statistics."""
    low, high = bounds
    col = F.col(f"`{key}`")
    if low is None or high is None:
        return source.filter(col.isNotNull()).isEmpty()
    if isinstance(source.schema[key].dataType, T.BooleanType):
        return all(not source.filter(col == b).isEmpty() for b in bounds) and (low != high or source.filter(col != low).isEmpty())
    return (source.filter((col < F.lit(low)) | (col > F.lit(high))).isEmpty()
            and all(not source.filter(col == F.lit(b)).isEmpty() for b in (low, high)))


def watermark(spark: SparkSession, path: str, key: str, confirm: bool = True) -> Facts:
    """The newest value of a column of a folder, as ``watermark``."""
    found = key_range(spark, path, key, confirm=confirm)
    return Facts(found.rows.select(F.col("hi").alias("watermark")), found.from_footers)
