"""Hard-negative mining by segment summaries.

Each component becomes floor(scale * x). A vector is cut into segments, and for
each the mean and the deviation of its components are stored. For two vectors

    sum of n * (mean * mean - dev * dev) <= score <= sum of n * (mean * mean + dev * dev)

over the segments, n being a segment's length. ``LEVELS`` gives the number of
segments of each step: what the coarse bounds leave open is bounded again by
finer segments, and only what these leave open is scored exactly.

Vectors are packed in blocks of bounded size, one row each, with summaries and
exact components in columns of their own. A scan reads the summaries of a block
and marks in one bit per anchor and row what stays open; a second step reads
the exact components of blocks that have open rows. Positives come first; their
scores bound the range in which the negatives of an anchor are searched.

Anchors meet all vectors in pairs of blocks, so nothing is collected and no key
is hotter than a block.

Defined cases: rows with a null id, label or vector, or with null or non-finite
components, take no part; vectors of different lengths are not compared; a
repeated id counts once, with its smallest vector and then label; of equal
scores the smaller id comes first; an anchor without positives, or a positive
without negatives, gives no rows; other columns are ignored. Scores are exact
while they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.scratch import written

#: Segments of each level, coarse to fine.
LEVELS = (4, 16)
VECTOR_BLOCK, ANCHOR_BLOCK = 16_384, 1_024
#: Anchors bounded at a time.
_SLICE = 32
#: Room for rounding in stored summaries and in their products.
_SLACK = 1e-6
_NONE = np.iinfo(np.int64).min


def usable(vectors: DataFrame, anchors: Column, scale: int) -> DataFrame:
    """(vec_id, label, v, dims, is_anchor) with integer components, one row per id."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~bad)
    once = rows.groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(
        F.min(F.struct(whole.alias("v"), F.col("label").cast("bigint").alias("label"))).alias("r"))
    return once.select("vec_id", "r.label", "r.v", F.size("r.v").alias("dims"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))


def segment_bounds(dims: int, count: int) -> np.ndarray:
    """Where segments begin, and the length at the end; each level's borders are borders of the finer ones."""
    return np.unique(np.round(np.linspace(0, dims, min(count, dims) + 1)).astype(np.int64))


def summaries(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment, times the root of its length, so that plain products give the bounds."""
    at = segment_bounds(v.shape[1], count)
    if v.shape[1] == 0:
        return np.zeros((len(v), 0)), np.zeros((len(v), 0))
    n = np.diff(at)
    x = v.astype(np.float64)
    mean = np.add.reduceat(x, at[:-1], axis=1) / n
    rest = x - np.repeat(mean, n, axis=1)
    return mean * np.sqrt(n), np.sqrt(np.add.reduceat(rest * rest, at[:-1], axis=1))


def bounds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of every row of ``a`` with every row of ``b``."""
    means, devs = a[0] @ b[0].T, a[1] @ b[1].T
    size_a = np.sqrt((a[0] ** 2).sum(axis=1) + (a[1] ** 2).sum(axis=1))
    size_b = np.sqrt((b[0] ** 2).sum(axis=1) + (b[1] ** 2).sum(axis=1))
    devs += _SLACK * np.outer(size_a, size_b) + 1e-3
    return means - devs, means + devs


def may_answer(lower: np.ndarray, upper: np.ndarray, least: float, most: float, k: int) -> np.ndarray:
    """Rows that can be among the ``k`` highest scores within a range."""
    may = (upper >= least) & (lower <= most)
    sure = lower[(lower >= least) & (upper <= most)]
    if len(sure) >= k:
        may &= upper >= np.partition(sure, len(sure) - k)[len(sure) - k]
    return may


def open_rows(anchors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], allowed: np.ndarray,
              ranges: list[list[tuple[float, float]]], k: int) -> np.ndarray:
    """For every anchor, the allowed rows that the summaries leave open in any of its ranges.

    ``levels`` holds the rows' summaries and ``anchors`` exact vectors, whose own summaries are made here.
    """
    out = np.zeros(allowed.shape, bool)
    mine = [summaries(anchors, c) for c in LEVELS]
    for start in range(0, len(anchors), _SLICE):
        part = slice(start, start + _SLICE)
        lower, upper = bounds((mine[0][0][part], mine[0][1][part]), levels[0])
        for i in range(start, min(start + _SLICE, len(anchors))):
            rows = np.flatnonzero(allowed[i])
            low, high = lower[i - start, rows], upper[i - start, rows]
            for depth in range(len(LEVELS)):
                if depth:
                    fine = levels[depth]
                    low, high = (x[0] for x in bounds((mine[depth][0][i : i + 1], mine[depth][1][i : i + 1]), (fine[0][rows], fine[1][rows])))
                may = np.zeros(len(rows), bool)
                for least, most in ranges[i]:
                    may |= may_answer(low, high, least, most, k)
                rows = rows[may]
            out[i, rows] = True
    return out


def highest(scores: np.ndarray, ids: np.ndarray, least: float, most: float, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores within a range, ties to the smaller id."""
    at = np.flatnonzero((scores >= least) & (scores <= most))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def exact_scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Integer products; floats hold them exactly while they stay below 2^53."""
    top = float(np.abs(rows).max(initial=0)) * float(np.abs(anchor).max(initial=0)) * max(rows.shape[1], 1)
    if top < 2**53:
        return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return rows.astype(np.int64) @ anchor.astype(np.int64)


def _packed_ints(values: np.ndarray) -> bytes:
    """The narrowest of three integer types, named by the first byte."""
    top = max(-int(values.min(initial=0)) - 1, int(values.max(initial=0)))
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def _unpacked_ints(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(rows, -1).astype(np.int64) if rows else np.zeros((0, 0), np.int64)


def _pack(table: pa.Table, summarise: bool) -> dict[str, bytes]:
    """One block: ids, labels, exact components and, on request, summaries of every level."""
    ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
    dims = table.column("dims")[0].as_py()
    v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims)
    order = np.argsort(ids)
    out = {"ids": ids[order].astype("<i8").tobytes(), "labels": labels[order].astype("<i8").tobytes(), "exact": _packed_ints(v[order])}
    if summarise:
        parts = [x.astype("<f4").tobytes() for count in LEVELS for x in summaries(v[order], count)]
        out["summary"] = b"".join(parts)
    return out


def _levels(data: bytes, rows: int, dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for count in LEVELS:
        width = len(segment_bounds(dims, count)) - 1
        pair = []
        for _ in range(2):
            pair.append(np.frombuffer(data, "<f4", rows * width, at).reshape(rows, width).astype(np.float64))
            at += 4 * rows * width
        out.append(tuple(pair))
    return out


def blocks(rows: DataFrame, size: int, total: int, name: str, summarise: bool) -> DataFrame:
    """Rows packed into blocks of about ``size`` by a hash of the id: ``name``, dims, ids, labels, exact, summary."""
    count = max(1, -(-total // size))
    placed = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias(name), "vec_id", "label", "v", "dims")

    def run(table: pa.Table) -> pa.Table:
        made = {name: table.column(name)[0].as_py(), "dims": table.column("dims")[0].as_py(), **_pack(table, summarise)}
        return pa.Table.from_pylist([made], pa.schema([(name, pa.int32()), ("dims", pa.int32()),
                                                       *[(c, pa.binary()) for c in made if c not in (name, "dims")]]))

    summary = ", summary binary" if summarise else ""
    return placed.groupBy(name, "dims").applyInArrow(run, f"{name} int, dims int, ids binary, labels binary, exact binary{summary}")


def _ints(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_py(), "<i8")


def _ranges(goals: bytes | None, rows: int, k_positives: int, percent: int) -> list[list[tuple[float, float]]]:
    """Score ranges to search for each anchor: everything, or one below each distinct positive score."""
    if goals is None:
        return [[(-np.inf, np.inf)]] * rows
    scores = np.frombuffer(goals, "<i8").reshape(rows, k_positives)
    return [[(-(-percent * p // 100), p) for p in sorted({int(x) for x in row if x != _NONE})] for row in scores]


def _allowed(a_ids: np.ndarray, a_labels: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool) -> np.ndarray:
    if same:
        return (a_labels[:, None] == labels) & (a_ids[:, None] != ids)
    return a_labels[:, None] != labels


def _best(anchors: DataFrame, vectors: DataFrame, same: bool, k: int, k_positives: int, percent: int) -> DataFrame:
    """(anchor_id, most, vec_id, score): the ``k`` best rows of every block for each range of an anchor.

    ``most`` is the range's upper end, null for all scores.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                a_ids, ids, dims = _ints(row["a_ids"]), _ints(row["ids"]), row["dims"].as_py()
                ranges = _ranges(row["goals"].as_py(), len(a_ids), k_positives, percent)
                allowed = _allowed(a_ids, _ints(row["a_labels"]), ids, _ints(row["labels"]), same)
                found = open_rows(_unpacked_ints(row["a_exact"].as_py(), len(a_ids)), _levels(row["summary"].as_py(), len(ids), dims),
                                  allowed, ranges, k)
                if found.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["block"].as_py()], pa.int32()), pa.array([row["a_block"].as_py()], pa.int32()),
                         pa.array([dims], pa.int32()), pa.array([np.packbits(found, axis=1).tobytes()], pa.binary())],
                        ["block", "a_block", "dims", "open"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                a_ids, ids = _ints(row["a_ids"]), _ints(row["ids"])
                exact, asked = _unpacked_ints(row["exact"].as_py(), len(ids)), _unpacked_ints(row["a_exact"].as_py(), len(a_ids))
                ranges = _ranges(row["goals"].as_py(), len(a_ids), k_positives, percent)
                marks = np.frombuffer(row["open"].as_py(), np.uint8).reshape(len(a_ids), -1)
                out: list[list[np.ndarray]] = [[], [], [], []]
                for i in np.flatnonzero(marks.any(axis=1)):
                    rows = np.flatnonzero(np.unpackbits(marks[i], count=len(ids)))
                    scores = exact_scores(exact[rows], asked[i])
                    for least, most in ranges[i]:
                        at = highest(scores, ids[rows], least, most, k)
                        top = _NONE if most == np.inf else most
                        for held, value in zip(out, (np.full(len(at), a_ids[i]), np.full(len(at), top), ids[rows][at], scores[at]), strict=True):
                            held.append(value)
                if out[0]:
                    anchor, most, vec, got = (pa.array(np.concatenate(x).astype(np.int64)) for x in out)
                    yield pa.RecordBatch.from_arrays([anchor, most, vec, got], ["anchor_id", "most", "vec_id", "score"])

    key = ["block", "dims"]
    pairs = anchors.join(vectors.select(*key, "ids", "labels", "summary"), key)
    marked = written(pairs.mapInArrow(scan, "block int, a_block int, dims int, open binary"), "open")
    asked = anchors.select(*key, "a_block", "a_ids", "a_exact", "goals")
    exact = vectors.select(*key, "ids", "exact")
    rows = marked.join(asked, [*key, "a_block"]).join(exact, key)
    return rows.mapInArrow(score, "anchor_id bigint, most bigint, vec_id bigint, score bigint")


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels in a range below it.

    ``vectors`` has vec_id, embedding and label; ``anchors`` is a condition on
    vec_id. A negative scores at least ``percent`` hundredths of the positive
    and at most as much. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.
    """
    rows = written(usable(vectors, anchors, scale), "vectors")
    total, asked = rows.count(), rows.filter("is_anchor").count()
    if not asked:
        return rows.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                                 "positive_score bigint, negative_score bigint")
    packed = written(blocks(rows, VECTOR_BLOCK, total, "block", True), "summaries")
    of_anchors = written(blocks(rows.filter("is_anchor"), ANCHOR_BLOCK, asked, "a_block", False), "anchors")
    of_anchors = of_anchors.select("a_block", "dims", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("exact").alias("a_exact"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-total // VECTOR_BLOCK)) - 1))).alias("block")
    alone = of_anchors.select("*", everywhere, F.lit(None).cast("binary").alias("goals"))
    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    best = _best(alone, packed, True, positives, positives, percent).withColumn("place", F.row_number().over(order))
    chosen = written(best.filter(F.col("place") <= positives).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # the positive scores of an anchor block, in the order of its ids
    found = chosen.groupBy("anchor_id").agg(F.collect_list("positive_score").alias("scores"))
    count = max(1, -(-asked // ANCHOR_BLOCK))
    listed = rows.filter("is_anchor").select(F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias("a_block"), "dims",
                                             F.col("vec_id").alias("anchor_id")).join(found, "anchor_id", "left")

    def goals(table: pa.Table) -> pa.Table:
        out = np.full((len(table), positives), _NONE, np.int64)
        order = np.argsort(table.column("anchor_id").to_numpy())
        scores = table.column("scores").to_pylist()
        for i, at in enumerate(order):
            mine = scores[at] or []
            out[i, : len(mine)] = mine
        return pa.table({"a_block": table.column("a_block")[:1], "dims": table.column("dims")[:1],
                         "goals": pa.array([out.tobytes()], pa.binary())})

    wanted = listed.groupBy("a_block", "dims").applyInArrow(goals, "a_block int, dims int, goals binary")
    bounded = written(of_anchors.join(wanted, ["a_block", "dims"]), "goals").select("*", everywhere)
    below = Window.partitionBy("anchor_id", "most").orderBy(F.col("score").desc(), "vec_id")
    hard = _best(bounded, packed, False, negatives, positives, percent).withColumn("rank", F.row_number().over(below))
    hard = hard.filter(F.col("rank") <= negatives).withColumnRenamed("most", "positive_score")
    return chosen.join(hard, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
