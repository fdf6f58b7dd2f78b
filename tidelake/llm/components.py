"""Connected components by alternating large-star and small-star steps.

Each step is a group-by with a combinable minimum and a join. The minima are
written before they are joined, so that Spark may split the edges of a node with
very many links. The number of rounds grows with the logarithm of the longest
chain. Every round is written out, so a lost executor repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.session import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = materialize(large, "large-star")
    below = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "below")
    others = large.join(below, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(others.union(below.select("u", F.col("m").alias("v"))).distinct(), "small-star")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    ``links`` has two columns of numbers in any order. Nodes without links are not listed.
    """
    a, b = (F.col(c) for c in links.columns)
    edges = materialize(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        edges = _stars(edges)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
