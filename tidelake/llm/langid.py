"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed 1- to 3-grams of the lower-cased text, with every run of
other characters seen as blanks; a feature is its share of the text's n-grams
times its inverse document frequency, which is counted over all documents that
may be learned from. Weights come from follow-the-regularised-leader with an
elastic net on a bounded sample, one share of it per language; a held-back
fifth sets the softmax temperature. Whole texts are read, in numpy inside each
task.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text when nothing can be learned; every language is learned, a rare
one from a document at least, and the weights have a row for each; a document
listed more than once counts once in the sample, with its smallest text; rows
are scored one by one, so repeated rows need no care; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
SIZE = 1 << BITS
#: Documents a model is fitted on, and more only where there are more languages.
SAMPLE_ROWS = 2_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.3, 1.0, 0.002, 0.01
#: Features are shares of a text; this brings them to the size the penalties assume.
SCALE = 20.0
UNDETERMINED = "und"
_GROUP_CHARS = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and chars + n > _GROUP_CHARS:
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all 1-, 2- and 3-grams (three rows), the row offsets, and which rows hold a letter.

    Numbers equal to ``SIZE`` stand for no feature.
    """
    lowered = [f" {(t or '').lower()} " for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in lowered])])
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(0))
    out = np.full((3, len(codes)), SIZE, np.int32)
    key, some = np.zeros(len(codes), np.uint32), np.zeros(len(codes), bool)
    for n, odd in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
        m = len(codes) - n
        key, some = key[:m], some[:m]
        key = key + (codes[n:] + np.uint32(n + 1)) * np.uint32(odd)
        some = some | letter[n:]
        mixed = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        mixed = (mixed ^ (mixed >> np.uint32(13))) >> np.uint32(32 - BITS)
        out[n, :m] = np.where(some, mixed.astype(np.int32), SIZE)
        for back in range(1, n + 1):
            out[n, at[1:] - back] = SIZE
    return out, at, np.logical_or.reduceat(letter, at[:-1]) if len(texts) else np.zeros(0, bool)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = np.zeros(SIZE + 1, np.int64), np.zeros(SIZE + 1, bool)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, j in _groups(texts):
            found, at, _ = grams(texts[i:j])
            for a, b in zip(at[:-1], at[1:], strict=True):
                seen[:] = False
                seen[found[:, a:b]] = True
                total += seen
    used = np.flatnonzero(total[:SIZE])
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["gram", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        gram, share = [], []
        for text in texts:
            found, _, _ = grams([text])
            used, n = np.unique(found[found < SIZE], return_counts=True)
            gram.append(used.astype(np.uint16).tobytes())
            share.append((n / max(n.sum(), 1)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), pa.array(gram, pa.binary()), pa.array(share, pa.binary())],
            ["doc_id", "lang", "gram", "share"],
        )


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: weights times inverse document frequency, a row per language and a column per feature and for none
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 5) -> np.ndarray:
    """Weights (classes x (SIZE + 1)) by follow-the-regularised-leader; the last column is the bias, free of penalty."""
    z, n = np.zeros((classes, SIZE + 1)), np.zeros((classes, SIZE + 1))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs, ns = z[:, at], n[:, at]
        bias = np.arange(SIZE + 1)[at] == SIZE
        l1, l2 = np.where(bias, 0, L1), np.where(bias, 0, L2)
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1, 0)
        return -shrunk / ((BETA + np.sqrt(ns)) / ALPHA + l2)

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            at, x, y = rows[r]
            w = weights(at)
            error = _softmax(w @ x)
            error[y] -= 1
            g = error[:, None] * x[None, :]
            step = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - step * w
            n[:, at] += g * g
    return weights(slice(None))


def temperature_of(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least loss on held-back rows, searched on a logarithmic grid.

    One row in n + 2 is counted as wrong, so that n rows without an error do not make the scores certain.
    """
    n, classes = logits.shape
    if not n or classes < 2:
        return 1.0
    wrong = 1 / (n + 2)
    target = np.full((n, classes), wrong / (classes - 1))
    target[np.arange(n), truth] = 1 - wrong
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(-4, 4, 161)):
        p = np.maximum(_softmax(logits / t), 1e-12)
        best = min(best, (-(target * np.log(p)).sum(axis=1).mean(), float(t)))
    return best[1]


def train(docs: DataFrame, learnable: Column, max_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from text and lang of the documents for which ``learnable`` holds and lang is not null."""
    known = docs.filter(learnable & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1_000_000.0
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min(place).alias("first")).collect()
    if not sizes:
        return Model((), np.zeros((0, SIZE + 1), np.float32), np.zeros(0), 1.0)
    languages = tuple(sorted(r["lang"] for r in sizes))
    counts = (
        known.select("text").mapInArrow(_document_counts, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    )
    n_docs = known.count()
    idf = np.full(SIZE + 1, np.log(1 + n_docs) + 1)
    for r in counts:
        idf[r["gram"]] = np.log((1 + n_docs) / (1 + r["n"])) + 1
    # each language has an equal part of the sample, and its first document at least
    parts = [x for r in sizes for x in (F.lit(r["lang"]), F.lit(max(max_rows / len(sizes) / r["count"], (r["first"] or 0.0) + 5e-7)))]
    share = F.element_at(F.create_map(*parts), F.col("lang"))
    picked = known.filter(F.coalesce(place, F.lit(0.0)) < share).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    sample = picked.mapInArrow(_features, "doc_id bigint, lang string, gram binary, share binary").collect()
    sample.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"]))
    rows = []
    for r in sample:
        at = np.frombuffer(r["gram"], np.uint16).astype(np.int64)
        x = np.frombuffer(r["share"], np.float32) * idf[at] * SCALE
        rows.append((np.append(at, SIZE), np.append(x, 1.0), languages.index(r["lang"])))
    held = [r for i, r in enumerate(rows) if i % 5 == 0 and len(rows) >= 20]
    fit = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 20]
    weights = ftrl(fit, len(languages))
    logits = np.array([weights[:, at] @ x for at, x, _ in held]).reshape(len(held), len(languages))
    temperature = temperature_of(logits, np.array([y for _, _, y in held], int))
    bias = weights[:, SIZE].copy()
    table = weights * idf * SCALE
    table[:, SIZE] = 0
    return Model(languages, table.astype(np.float32), bias, temperature)


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The kept columns, ``lang_pred`` and ``score``: the likeliest language and its calibrated probability."""

    def scores(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found, at, letter = grams(texts)
        n = np.add.reduceat((found < SIZE).sum(axis=0), at[:-1])
        z = np.empty((len(texts), len(model.languages)))
        for k, w in enumerate(model.weights):
            z[:, k] = np.add.reduceat(w[found[0]] + w[found[1]] + w[found[2]], at[:-1], dtype=np.float64)
        p = _softmax((z / np.maximum(n, 1)[:, None] + model.bias) / model.temperature)
        best = p.argmax(axis=1)
        names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letter, strict=True)]
        return names, np.where(letter, p[np.arange(len(best)), best], 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names: list[str] = []
            score = [np.zeros(0)]
            for i, j in _groups(texts):
                if model.languages:
                    got, p = scores(texts[i:j])
                else:
                    got, p = [UNDETERMINED] * (j - i), np.zeros(j - i)
                names += got
                score.append(p)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(np.concatenate(score))],
                [*keep, "lang_pred", "score"],
            )

    types = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], "lang_pred string", "score double"])
    return docs.select(*keep, *[c for c in ["text"] if c not in keep]).mapInArrow(run, schema)
