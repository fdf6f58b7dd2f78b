"""Hard-negative mining against brute force; the query itself is held against its SQL."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.llm import negatives
from tidelake.llm.negatives import mine

SCHEMA = "vec_id bigint, embedding array<float>, label int, block int, dims string, most double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, "x", 0.5) for i, v, label in rows], SCHEMA)


def brute(rows, anchor, k=5, percent=80, scale=256):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(scale * float(np.float32(x))) for x in v]
        kept[i] = min(kept.get(i, (whole, label)), (whole, label))
    out = set()
    for a, (v, label) in kept.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (w, other) in kept.items() if i != a and len(w) == len(v))
        for ps, p in [(-s, i) for s, i, other in scored if other == label][:k]:
            fit = [(-s, i) for s, i, other in scored if other != label and percent * ps <= -100 * s <= 100 * ps][:k]
            out |= {(a, p, rank, i, ps, s) for rank, (s, i) in enumerate(fit, 1)}
    return out


def answers(df):
    rows = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def vectors(n, dims, seed, labels=3, spread=0.4):
    rng = np.random.default_rng(seed)
    heart = rng.normal(size=dims)
    return [(i, (heart + spread * rng.normal(size=dims)).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


AWKWARD = [
    *vectors(40, 7, 1), (100, None, 1), (110, [1.0, None], 1), (120, [math.nan] * 7, 1), (130, [math.inf] * 7, 0), (140, [1.0] * 7, None),
    (150, [], 0), (160, [], 1), (170, [], 0), (None, [1.0] * 7, 0), (180, [1.0, 2.0], 0), (190, [1.0, 2.0], 1), (191, [1.0, 2.0], 0),
    (200, [0.0] * 7, 0), (0, [0.5] * 7, 2), (3, [0.5] * 7, 1),
]


@pytest.mark.parametrize("rows", [AWKWARD, AWKWARD + AWKWARD, vectors(120, 33, 2), vectors(90, 64, 3, labels=1), vectors(30, 4, 4, spread=0.0)],
                         ids=["awkward", "repeated", "odd length", "one label", "equal vectors"])
def test_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(negatives, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 4)
    want = brute(rows, lambda i: i % 10 == 0)
    assert answers(mine(frame(spark, rows), F.col("vec_id") % 10 == 0)) == want


def test_no_rows_and_no_anchors(spark):
    assert mine(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert mine(frame(spark, vectors(20, 5, 5)), F.col("vec_id") < 0).count() == 0


@pytest.mark.parametrize("dims", [1, 3, 16, 50])
def test_bounds_hold_and_refine(dims):
    rng = np.random.default_rng(dims)
    a, b = rng.integers(-500, 500, (9, dims)), rng.integers(-500, 500, (40, dims))
    exact = a @ b.T
    widths = []
    for count in negatives.LEVELS:
        stored = tuple(x.astype(np.float32).astype(np.float64) for x in negatives.summaries(b, count))
        low, high = negatives.bounds(negatives.summaries(a, count), stored)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert widths[1] <= widths[0] + 1


def test_summaries_leave_few_rows_open_where_segments_tell_vectors_apart():
    rng = np.random.default_rng(5)
    steps = np.repeat(rng.integers(-300, 300, (2000, 16)), 4, axis=1) + rng.integers(-5, 5, (2000, 64))
    levels = [negatives.summaries(steps, c) for c in negatives.LEVELS]
    found = negatives.open_rows(steps[:10], levels, np.ones((10, 2000), bool), [[(-np.inf, np.inf)]] * 10, 5)
    scores = steps[:10] @ steps.T
    for i in range(10):
        best = np.argsort(-scores[i], kind="stable")[:5]
        assert found[i, best].all()
    assert found.sum() < 0.02 * found.size


def test_large_components_keep_whole_scores(spark):
    rows = [(0, [3e6, 1.0], 0), (1, [3e6, -1.0], 0), (2, [2.9e6, 5.0], 1), (3, [2.9e6, 4.0], 1)]
    assert answers(mine(frame(spark, rows), F.col("vec_id") == 0)) == brute(rows, lambda i: i == 0)
