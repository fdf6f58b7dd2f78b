"""JDBC scans: whole table, one column split, a predicate list, a free query."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from tidelake.plans.slicing import Slice


def read_plain(spark: SparkSession, url: str, table: str, properties: Mapping[str, str] | None = None) -> DataFrame:
    """The whole table in one task."""
    return spark.read.jdbc(url, table, properties=dict(properties or {}))


def read_split(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    low,
    high,
    splits: int,
    connections: int = 20,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Split on a numeric, date or timestamp column between bounds the caller gives.

    Bounds only shape the ranges: rows outside them and rows without a key are
    read by the first and last task. Spark takes numeric bounds as whole
    numbers, so fractions are moved outwards.
    """
    low = math.floor(low) if isinstance(low, float | Decimal) else low
    high = math.ceil(high) if isinstance(high, float | Decimal) else high
    return (
        spark.read.format("jdbc")
        .options(**dict(properties or {}))
        .options(
            url=url,
            dbtable=table,
            partitionColumn=column,
            lowerBound=str(low),
            upperBound=str(high),
            numPartitions=max(1, min(splits, connections)),
        )
        .load()
    )


def read_predicates(
    spark: SparkSession,
    url: str,
    table: str,
    slices: Sequence[Slice | str],
    sub_slices: Sequence[Slice | str] = (),
    connections: int = 20,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """One task per slice, or per slice and sub-slice; at most ``connections`` run at once.

    More predicates than connections are grouped with OR, so that the number
    of partitions, and with it of open connections, stays within the limit.
    """
    texts = [s if isinstance(s, str) else s.sql() for s in slices]
    subs = [s if isinstance(s, str) else s.sql() for s in sub_slices]
    parts = [f"({a}) AND ({b})" for a in texts for b in subs] if subs else texts
    if len(parts) > connections:
        parts = [" OR ".join(f"({p})" for p in parts[i::connections]) for i in range(connections)]
    return spark.read.jdbc(url, table, predicates=parts, properties=dict(properties or {}))


def read_query(
    spark: SparkSession,
    url: str,
    query: str,
    where: str | None = None,
    column: str | None = None,
    low=None,
    high=None,
    splits: int = 1,
    connections: int = 20,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Any SELECT, with an extra condition and bounds of the caller's choice."""
    text = f"SELECT * FROM ({query}) q0 WHERE {where}" if where else query
    table = f"({text}) q"
    if column is None:
        return read_plain(spark, url, table, properties)
    return read_split(spark, url, table, column, low, high, splits, connections, properties)
