"""Exact top-k inner products with a vector-approximation file.

Each component becomes floor(scale * x). A grid per dimension cuts the range of
that dimension over all vectors into ``CELLS`` cells; a vector's cells are its
approximation. For a query, the cells bound the score of every vector from
below and above. A task scans the approximations of its block, drops what the
k-th best lower bound rules out, and reads exact vectors in order of falling
upper bound until the next bound cannot reach the k-th score found.

Equal vectors have equal scores and ties go to the smaller id, so of each group
of equal vectors only the ``k + 1`` smallest ids can be in an answer; Spark
keeps these before anything is paired. Equal queries are answered once. Vectors
and queries are cut into blocks of bounded size; each pair of blocks is a task.

Defined cases: vectors that are null, or hold null or non-finite components,
take no part; vectors of different lengths are not compared; a repeated vec_id
counts once, with the smallest vector; a query's own id is never its answer;
fewer than k others give fewer ranks; other columns are ignored. Scores are
exact while they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.session import materialize

CELLS = 128
VECTOR_BLOCK = 16_384
QUERY_BLOCK = 4_096
QUERY_SLICE = 64
_READ = 64


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v) with integer components, one row per id, unusable vectors left out."""
    v = F.col("embedding")
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad)
    return usable.select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def grid_of(vectors: DataFrame) -> dict[int, list[tuple[int, int]]]:
    """By vector length: smallest and largest component of each dimension."""
    rows = (
        vectors.select(F.size("v").alias("dims"), F.posexplode("v").alias("d", "x"))
        .groupBy("dims", "d").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    )
    grid: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(rows, key=lambda r: (r["dims"], r["d"])):
        grid.setdefault(r["dims"], []).append((r["low"], r["high"]))
    return grid


def cells_of(exact: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The approximation: the cell of each component."""
    return np.minimum((exact - low) // width, CELLS - 1).astype(np.uint8)


def top_k(queries: np.ndarray, cells: np.ndarray, exact: np.ndarray, ids: np.ndarray,
          low: np.ndarray, width: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, and the ids and scores of its k best rows, ties to the smaller id."""
    floor = low + cells * width
    least, most = floor.astype(np.float64), (floor + width - 1).astype(np.float64)
    k = min(k, len(ids))
    for start in range(0, len(queries), QUERY_SLICE):
        block = queries[start : start + QUERY_SLICE].astype(np.float64)
        up, down = np.maximum(block, 0), np.minimum(block, 0)
        upper = up @ most.T + down @ least.T
        lower = up @ least.T + down @ most.T
        slack = 1e-9 * (np.abs(upper) + np.abs(lower)) + 1
        upper += slack
        lower -= slack
        reach = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k]
        for i in range(len(block)):
            open_ = np.flatnonzero(upper[i] >= reach[i])
            open_ = open_[np.argsort(-upper[i, open_], kind="stable")]
            query = queries[start + i]
            scores = np.zeros(0, np.int64)
            seen = 0
            while seen < len(open_):
                if seen >= k and upper[i, open_[seen]] < np.partition(scores, seen - k)[seen - k]:
                    break
                scores = np.concatenate([scores, exact[open_[seen : seen + _READ]] @ query])
                seen = len(scores)
            rows = open_[:seen]
            best = np.lexsort((ids[rows], -scores))[:k]
            yield start + i, ids[rows][best], scores[best]


def search(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """The ``k`` highest integer inner products of every row for which ``queries`` holds, over all other rows.

    ``vectors`` has vec_id and embedding. Returns query_id, rank, vec_id, score.
    """
    all_ = materialize(quantised(vectors, scale).withColumn("is_query", F.coalesce(queries, F.lit(False))), "vectors")
    grid = grid_of(all_)
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = all_.select("vec_id", "v").withColumn("place", place).filter(F.col("place") <= k + 1).select("vec_id", "v")
    asked = all_.filter("is_query").select("vec_id", "v")
    asked_once = materialize(asked.groupBy("v").agg(F.min("vec_id").alias("asker")), "queries")
    counts = materialize(kept, "kept")
    n_vectors, n_queries = counts.count(), asked_once.count()
    v_blocks, q_blocks = max(1, -(-n_vectors // VECTOR_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    left = counts.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(v_blocks)).cast("int").alias("vb"),
                         F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), F.size("v").alias("dims"))
    right = asked_once.select("asker", "v", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))).alias("vb"),
                              F.pmod(F.xxhash64("asker"), F.lit(q_blocks)).cast("int").alias("qb"), F.size("v").alias("dims"))

    def answer(key: tuple, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"asker": [], "vec_id": [], "score": []}
        if len(rows) and len(asks):
            bounds = np.array(grid.get(int(key[2]), []), np.int64).reshape(-1, 2)
            low = bounds[:, 0]
            width = (bounds[:, 1] - low) // CELLS + 1
            dims = len(low)
            exact = np.array(rows["v"].tolist(), np.int64).reshape(len(rows), dims)
            wanted = np.array(asks["v"].tolist(), np.int64).reshape(len(asks), dims)
            ids, askers = rows["vec_id"].to_numpy(), asks["asker"].to_numpy()
            for q, found, scores in top_k(wanted, cells_of(exact, low, width), exact, ids, low, width, k + 1):
                out["asker"] += [askers[q]] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out).astype("int64")

    keys = ("vb", "qb", "dims")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(answer, "asker bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("asker").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    members = asked.join(asked_once, "v").select(F.col("vec_id").alias("query_id"), "asker")
    answers = members.join(best, "asker").filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
