"""Set operations on frames, keys and column names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.operators.joins import key_set, null_safe_join


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Union by name, columns a frame lacks as NULL, duplicates removed."""
    return union_all(*frames).distinct()


def union_all(*frames: DataFrame) -> DataFrame:
    """Row-wise append by name, columns a frame lacks as NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def union_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).union(right.select(key)).distinct()


def except_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the left without those of the right; frequent keys merge before either is shuffled."""
    return null_safe_join(key_set(left, [key]), key_set(right, [key]), [key], "left_anti")


def intersect_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both sides; frequent keys merge before either is shuffled."""
    return null_safe_join(key_set(left, [key]), key_set(right, [key]), [key], "left_semi")


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side they are on; one shuffle for both sides."""
    sides = (
        left.select(key).withColumn("side", F.lit(1))
        .unionByName(right.select(key).withColumn("side", F.lit(2)))
    )
    return (
        sides.groupBy(key)
        .agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
        .filter("lo = hi")
        .select(key, F.when(F.col("lo") == 1, "left").otherwise("right").alias("side"))
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row distinct; equal rows are merged before the shuffle."""
    return df.dropDuplicates()
