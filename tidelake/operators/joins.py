"""Equi, outer, semi and anti joins, and filters by a set of keys."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.session import materialize

# Largest key set that is turned into an IN list instead of a join; the longest list every source takes.
IN_LIST_LIMIT = 1_000
_PLAIN_TEXT = re.compile(r"[A-Za-z0-9 _:.,/+-]*")  # needs no escape in a SQL literal


def null_safe_join(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str) -> DataFrame:
    """Join on equal keys where NULL equals NULL; the left key columns are kept."""
    keys = list(keys)
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__r_{key}")
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    )
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def join_case_blind(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Inner join on upper-cased names; the key comes out upper-cased, once, as ``left_name``."""
    lhs = left.withColumn(left_name, F.upper(left_name))
    rhs = right.withColumn(left_name, F.upper(right_name))
    if right_name != left_name:
        rhs = rhs.drop(right_name)
    return lhs.join(rhs, left_name)


def lookup(df: DataFrame, mapping: DataFrame, keys: str | list[str]) -> DataFrame:
    """Left outer lookup: every row of ``df`` stays.

    No broadcast hint: Spark broadcasts the mapping when its size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    return df.join(mapping, keys, "left")


def join_partition_columns(
    stats: DataFrame, columns: DataFrame, owner: str, table: str
) -> DataFrame:
    """Partition statistics with column metadata of one table, in column order."""
    keys = ["OWNER", "TABLE_NAME", "COLUMN_NAME"]
    wanted = (F.col("OWNER") == owner) & (F.col("TABLE_NAME") == table)
    return (
        stats.filter(wanted)
        .join(columns.filter(wanted), keys)
        .select(
            "TABLE_NAME", "DATA_TYPE", "COLUMN_NAME", "PARTITION_NAME",
            "LOW_VALUE", "HIGH_VALUE", "COLUMN_ID",
        )
        .orderBy("COLUMN_ID", "PARTITION_NAME")
    )


def key_set(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """The distinct keys of ``df``, written once.

    A frequent key is merged before the shuffle. Read back, a small set has a
    known size and is broadcast, so the other side of the join is not
    shuffled; against a large one Spark may split the other side's skewed
    partitions, which it cannot with an aggregate between shuffle and join.
    """
    return materialize(df.select(*keys).distinct(), "keys")


def keys_not_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key is absent from ``right``."""
    return left.join(key_set(right, [key]), key, "left_anti")


def keys_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key is present in ``right``."""
    return left.join(key_set(right, [key]), key, "left_semi")


def natural_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that takes from ``right`` only the columns ``left`` lacks."""
    have = {c.upper() for c in left.columns}
    extra = [c for c in right.columns if c.upper() not in have]
    return left.join(right.select(key, *extra), key)


def filter_by_keys(
    df: DataFrame, value: Column, keys: DataFrame, key: str, limit: int = IN_LIST_LIMIT
) -> DataFrame:
    """Rows whose ``value`` is one of ``keys``.

    Up to ``limit`` keys become an IN list, which a JDBC or Parquet scan
    applies itself; more become a range, which the scan applies, and a semi
    join.
    """
    wanted = key_set(keys.select(F.col(key).alias("__key")).filter("__key IS NOT NULL"), ["__key"])
    texts = [r[0] for r in wanted.select(F.col("__key").cast("string")).limit(limit + 1).collect()]
    if not texts:
        return df.limit(0)
    keyed = df.withColumn("__value", value)
    kind = wanted.schema["__key"].dataType.simpleString()
    if len(texts) <= limit and kind != "binary":
        if not all(_PLAIN_TEXT.fullmatch(t) for t in texts):  # only text keys have other characters
            return df.filter(value.isin(texts))
        # one parsed expression: a list of single literals takes a second per thousand to build
        listed = ", ".join(f"CAST('{t}' AS {kind})" for t in texts)
        return keyed.filter(f"__value IN ({listed})").drop("__value")
    low, high = wanted.agg(F.min("__key"), F.max("__key")).first()
    inside = keyed.filter(F.col("__value").between(low, high))
    return inside.join(wanted, F.col("__value") == F.col("__key"), "left_semi").drop("__value")

