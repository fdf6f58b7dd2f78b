"""Language-model scores: counts and base against brute force, the softmax against a dense loop, and held-out text."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import DOC_SCHEMA, LOWER, awkward_texts, documents
from tidelake.llm import maxent, queries


def words_of(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), None]


def brute(rows, held_out):
    """By row: tokens, known tokens and base score; and the number of training tokens."""
    counts = Counter(w for d, t in rows if not held_out(d) for w in words_of(t))
    total, known = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        w = words_of(t)
        out.append((d, held_out(d), len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (total + known + 1)) for x in w)))
    return out, total


def check(got, rows, held_out):
    want, total = brute(rows, held_out)
    def order(r):
        return (r[0] is None, r[0], r[2], round(r[4], 6))
    mine = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=order)
    for a, b in zip(mine, sorted(want, key=order), strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9, abs=1e-9)
    assert all(r["train_tokens"] == total and math.isfinite(r["score"]) and r["score"] <= 1e-6 for r in got)


@pytest.mark.parametrize("part", [maxent.PART_BYTES, 2000])
@pytest.mark.parametrize("repeat", [False, True])
def test_awkward_texts(spark, monkeypatch, part, repeat):
    monkeypatch.setattr(maxent, "PART_BYTES", part)
    rows = [*awkward_texts(), (20, "Token\x0btoken\x0cTOKEN É é"), (21, "\x00 a\x00b")]
    got = maxent.score(documents(spark, rows, repeat=repeat), F.col("doc_id") % 3 == 0).collect()
    check(got, rows * (1 + repeat), lambda d: d % 3 == 0)


def test_null_ids_are_held_out_and_kept(spark):
    rows = [(None, "one two"), (1, "one two three"), (None, "one two")]
    got = maxent.score(documents(spark, rows), F.col("doc_id") % 3 == 0).collect()
    check(got, rows, lambda d: d is None or d % 3 == 0)


def test_nothing_to_learn_from_and_empty_table(spark):
    got = maxent.score(documents(spark, awkward_texts()), F.lit(True)).collect()
    assert all((r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0) and r["score"] == pytest.approx(0, abs=1e-6) for r in got)
    assert maxent.score(spark.createDataFrame([], DOC_SCHEMA), F.lit(False)).count() == 0


def random_model(seed=3):
    rng = np.random.default_rng(seed)
    shape = (1 << maxent.BITS, maxent.CLASSES)
    base = np.log(rng.dirichlet(np.ones(maxent.CLASSES))).astype(np.float32)
    slots = np.log(rng.dirichlet(np.ones(maxent.SLOTS), maxent.CLASSES)).astype(np.float32)
    slots[maxent.RARE] = [0, *[maxent._NEVER] * (maxent.SLOTS - 1)]  # its one slot is certain
    return maxent.Model(base, slots, rng.normal(size=shape).astype(np.float32), rng.normal(size=shape).astype(np.float32))


def dense(model, ids, starts):
    """log10 probabilities by a plain loop over tokens, features and outcomes."""
    out = []
    for i, word in enumerate(ids.tolist()):
        first = max(s for s in starts if s <= i)
        before = [np.array([ids[i - b] if i - b >= first else maxent.START], np.uint32) for b in (1, 2, 3)]
        k, slot = divmod(word, maxent.SLOTS)
        of_class, of_slot = maxent.features(before, np.array([k], np.uint32))
        total = 0.0
        for base, weights, rows, right in ((model.class_base, model.class_weights, of_class, k), (model.slot_base[k], model.slot_weights, of_slot, slot)):
            z = [float(base[o]) + sum(float(weights[r[0], o]) for r in rows) for o in range(maxent.CLASSES)]
            total += z[right] - math.log(sum(math.exp(x) for x in z))
        out.append(total / math.log(10))
    return out


def test_batches_agree_with_a_dense_loop():
    rng = np.random.default_rng(1)
    model, ids, starts = random_model(), rng.integers(0, maxent.START, 60).astype("<u2"), np.array([0, 1, 17, 40])
    ids[ids > maxent.RARE * maxent.SLOTS] = maxent.RARE * maxent.SLOTS
    want = dense(model, ids, starts)
    for size in (60, 7, 1):
        got = np.concatenate([maxent.log10_probabilities(model, ids, starts, a, min(a + size, 60)) for a in range(0, 60, size)])
        assert got == pytest.approx(want, abs=2e-5)


def test_a_step_follows_the_gradient():
    rng = np.random.default_rng(2)
    zero = random_model()
    zero = maxent.Model(zero.class_base, zero.slot_base, np.zeros_like(zero.class_weights), np.zeros_like(zero.slot_weights))
    ids, starts = rng.integers(0, 40, 3000).astype("<u2"), np.array([0])
    before = maxent.log10_probabilities(zero, ids, starts, 0, 3000).sum()
    learner = maxent.Learner(zero)
    for _ in range(3):
        learner.step(ids, starts, 0, 3000)
    after = maxent.log10_probabilities(maxent.Model(zero.class_base, zero.slot_base, *learner.weights), ids, starts, 0, 3000).sum()
    assert after > before
    assert learner.touched[0].sum() == 3 * 3000 * 4 and learner.touched[1].sum() == 3 * 3000 * 3


def test_probabilities_of_all_words_sum_to_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = docs.select("doc_id", (F.col("doc_id") % 5 == 0).alias("held_out"), "text")
    schema = "part bigint, doc_id bigint, held_out boolean, tokens binary, words array<bigint>, counts array<bigint>"
    rows = maxent.written(texts.mapInArrow(maxent._parts, schema), "parts")
    listed = rows.filter("words IS NOT NULL").select("part", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    listed = listed.select("part", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    known = maxent.vocabulary(texts, listed)
    found = known.words.toPandas()
    assert len(found) == known.known and found["c"].sum() == known.train_tokens and found["word"].is_unique
    # P(word | slot) of all words of a slot and, for rare words, the unseen one
    share = (10 ** found["share"]).groupby(found["id"]).sum()
    rare = maxent.RARE * maxent.SLOTS
    share[rare] = share.get(rare, 0) + 10 ** known.unseen_share
    assert share.to_numpy() == pytest.approx(np.ones(len(share)), abs=1e-9)
    # and both softmaxes give mass to exactly the classes and slots that have words
    used = set(share.index)
    assert {k * maxent.SLOTS + s for k, s in zip(*np.nonzero(known.slot_base > -1e8), strict=True)} == used
    assert np.exp(known.class_base.astype(float)).sum() == pytest.approx(1, abs=1e-5)
    for k in {i // maxent.SLOTS for i in used}:
        assert np.exp(known.slot_base[k].astype(float)).sum() == pytest.approx(1, abs=1e-5)


def test_op12(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op12_maxent_scores"](spark, sf).collect()
    check(got, rows, lambda d: zlib.crc32(str(d).encode()) % 7 == 2)
    asked = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in asked) > 0.95 * sum(r["base_score"] for r in asked)
