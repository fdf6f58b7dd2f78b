"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

A text is its lower-cased words and one end token. Words are told apart by
64-bit hashes; counts are taken over all texts that may be learned from.

Classes. The most frequent words are anchors, one for each class but two. A
word's class is the anchor it follows most often, relative to how often that
anchor occurs; words that follow no anchor share a class, and so do words seen
once together with the unseen word. The most frequent words of a class have a
slot each, its other words share the last slot.

Model. log P(word | history) = log P(class | history) + log P(slot | class,
history) + log P(word | slot). The first two are softmaxes over at most 32
outcomes; a score is the outcome's log frequency plus the weights of the hashed
features that hold: the word before, the two words before, and, skipping, the
second and the third word before. The last term is a relative frequency, or for
the class of rare words the Good-Turing share of unseen words. So the
probabilities of all known words and the unseen word sum to one.

Training. Each round takes the learnable texts whose hash falls to it, so each
is learned from once. Tasks make AdaGrad steps on the weights the round began
with and hand on their changes in blocks of the weight table; Spark adds these,
weighted by how many tokens touched a row. The weights have a fixed size
(``BITS`` rows for each softmax) and are all that passes through the driver, with
the anchors and the words that have a slot.

Words do not meet documents one by one. A task cuts its documents into parts of
``PART_BYTES`` and lists the words of a part once; what is known of a word is
joined to these lists and meets a part's documents in one group.

Defined cases: a null or empty text is the end token alone; repeated rows count
and are scored each, null ids too; a null learnability counts as held out; with
nothing to learn from every word is the unseen one; a text is held whole by a
task; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.arrays import Words, row_groups, utf8
from tidelake.llm.scratch import written

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: The end token's place among word hashes.
END = np.uint64(0x51AB0E7D3C9F2264)
#: Outcomes of each softmax; the last two classes are for words that follow no anchor and for rare words.
CLASSES = SLOTS = 32
NO_ANCHOR, RARE = CLASSES - 2, CLASSES - 1
#: A history place before the text.
START = CLASSES * SLOTS
#: Rows of each weight table, as a power of two; features are 16-bit numbers.
BITS = 16
PART_BYTES = 16 << 20
ROUNDS, BATCH, RATE = 3, 4096, 0.7
#: Rows of a weight table that travel together.
BLOCK = 1024
_SALTS = 16
_NEVER = -1e9
#: Above any score that training reaches, and far below what overflows.
_HIGHEST = 60.0
_ONES = np.ones(CLASSES, np.float32)
_FEW = 4


def tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Row ranges, their bytes, and the token hashes of these rows with the place of each row's end token."""
    data, offsets = utf8(batch.column("text"))
    for i, j in row_groups(offsets):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], IS_WORD)
        ends = np.cumsum(words.counts() + 1) - 1
        out = np.empty(len(words.hashes) + j - i, np.uint64)
        own = np.ones(len(out), bool)
        own[ends] = False
        out[own], out[ends] = words.hashes, END
        yield i, j, int(offsets[j] - offsets[i]), out, ends


_PART_SCHEMA = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("tokens", pa.binary()),
                          ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_OUTPUT_ROWS = 512


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as places in their part's word list, and after them the list with its counts in learnable texts."""
    part, size = TaskContext.get().partitionId() << 32, 0
    ids: list[int | None] = []
    held: list[bool] = []
    lengths: list[np.ndarray] = []
    found: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        n = np.concatenate(lengths)
        at = np.concatenate([[0], np.cumsum(n)])
        words, place = np.unique(np.concatenate(found), return_inverse=True)
        order = np.argsort(-np.bincount(place, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        place = rank[place]
        counts = np.bincount(place[~np.repeat(np.array(held), n)], minlength=len(words))
        rows = [{"part": part, "doc_id": d, "held_out": h, "tokens": place[a:b].astype("<u4").tobytes()}
                for d, h, a, b in zip(ids, held, at[:-1], at[1:], strict=True)]
        rows.append({"part": part, "words": words[order].view(np.int64), "counts": counts})
        for i in range(0, len(rows), _OUTPUT_ROWS):
            yield pa.RecordBatch.from_pylist(rows[i : i + _OUTPUT_ROWS], _PART_SCHEMA)
        for kept in (ids, held, lengths, found):
            kept.clear()

    for batch in batches:
        all_ids, all_held = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
        for i, j, n_bytes, hashes, ends in tokens(batch):
            ids += all_ids[i:j]
            held += all_held[i:j]
            lengths.append(np.diff(ends, prepend=-1))
            found.append(hashes)
            size += n_bytes
            if size >= PART_BYTES:
                yield from flush()
                part, size = part + 1, 0
    if ids:
        yield from flush()


def _followers(anchors: np.ndarray):
    """How often each word follows each anchor in learnable texts, summed for a stretch of text."""
    order = np.argsort(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        which: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            words, place = np.unique(np.concatenate(held), return_inverse=True)
            key, n = np.unique(place * CLASSES + np.concatenate(which), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(words[key // CLASSES].view(np.int64)), pa.array((key % CLASSES).astype(np.int32)), pa.array(n)], ["word", "anchor", "n"])

        for batch in batches:
            for _, _, n_bytes, hashes, ends in tokens(batch):
                before = np.empty_like(hashes)
                before[1:] = hashes[:-1]
                before[np.concatenate([[0], ends[:-1] + 1])] = END
                near = np.minimum(np.searchsorted(anchors, before, sorter=order), len(anchors) - 1)
                at = np.flatnonzero(anchors[order[near]] == before)
                held.append(hashes[at])
                which.append(order[near[at]])
                size += n_bytes
                if size >= PART_BYTES:
                    yield flush()
                    held, which, size = [], [], 0
        if held:
            yield flush()

    return run


@dataclass(frozen=True)
class Model:
    """Log frequencies (natural) of classes and slots, and the weights of features for both."""

    class_base: np.ndarray
    slot_base: np.ndarray
    class_weights: np.ndarray
    slot_weights: np.ndarray


def histories(ids: np.ndarray, starts: np.ndarray, a: int, b: int) -> list[np.ndarray]:
    """The first, second and third word before each of the tokens [a, b)."""
    place = np.arange(a, b)
    place = place - starts[np.searchsorted(starts, place, "right") - 1]
    out = []
    for back in (1, 2, 3):
        word = np.full(b - a, START, np.uint32)
        inside = place >= back
        word[inside] = ids[np.flatnonzero(inside) + a - back]
        out.append(word)
    return out


def features(before: list[np.ndarray], classes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashed feature numbers for the class and for the slot within a class."""
    one, two, three = before

    def number(kind: int, *parts: np.ndarray) -> np.ndarray:
        x = np.full(len(one), kind * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for p in parts:
            x = (x ^ p) * np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
        return (x * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)).astype(np.uint16)

    return ([number(1, one), number(2, two), number(3, one, two), number(4, three)],
            [number(5, classes, one), number(6, classes, two), number(7, classes, one, two)])


def softmax(base: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Probabilities of all outcomes for a batch."""
    z = weights.take(rows[0], axis=0)
    z += base
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    np.minimum(z, _HIGHEST, out=z)
    np.exp(z, out=z)
    z /= (z @ _ONES)[:, None]
    return z


def _outcomes(ids: np.ndarray, starts: np.ndarray, a: int, b: int):
    """Classes and slots of the tokens [a, b), features for the class, the tokens whose class has several slots, and theirs for the slot."""
    outcome = ids[a:b].astype(np.uint32)
    classes, slots = outcome // SLOTS, outcome % SLOTS
    open_ = np.flatnonzero(classes != RARE)
    of_class, of_slot = features(histories(ids, starts, a, b), classes)
    return classes, slots, of_class, open_, [r[open_] for r in of_slot]


def log10_probabilities(model: Model, ids: np.ndarray, starts: np.ndarray, a: int, b: int) -> np.ndarray:
    """log10 P(class, slot | history) of the tokens [a, b)."""
    classes, slots, of_class, open_, of_slot = _outcomes(ids, starts, a, b)
    p = softmax(model.class_base, model.class_weights, of_class)[np.arange(b - a), classes].astype(np.float64)
    inside = softmax(model.slot_base.take(classes[open_], axis=0), model.slot_weights, of_slot)
    p[open_] *= inside[np.arange(len(open_)), slots[open_]]
    return np.log10(np.maximum(p, 1e-30))


def row_sums(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct row numbers, the sum of the values of each, and how many there are."""
    order = np.argsort(row, kind="stable")
    sorted_ = row[order]
    heads = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    lengths = np.diff(heads, append=len(row))
    total = values.take(order[heads], axis=0)
    # most rows stand there a few times, which plain additions sum faster than a reduction
    few = lengths <= _FEW
    for r in range(1, _FEW):
        more = np.flatnonzero(few & (lengths > r))
        total[more] += values.take(order[heads[more] + r], axis=0)
    many = np.flatnonzero(~few)
    if len(many):
        part = order[np.repeat(~few, lengths)]
        total[many] = np.add.reduceat(values.take(part, axis=0), np.cumsum(lengths[many]) - lengths[many], axis=0)
    return sorted_[heads], total, lengths


class Learner:
    """AdaGrad steps on a copy of the weights."""

    def __init__(self, model: Model):
        self.model = model
        self.weights = [model.class_weights.copy(), model.slot_weights.copy()]
        self.sums = [np.ones(len(w), np.float32) for w in self.weights]
        self.touched = [np.zeros(len(w), np.float32) for w in self.weights]

    def step(self, ids: np.ndarray, starts: np.ndarray, a: int, b: int) -> None:
        classes, slots, of_class, open_, of_slot = _outcomes(ids, starts, a, b)
        self._move(0, self.model.class_base, of_class, classes)
        if len(open_):
            self._move(1, self.model.slot_base.take(classes[open_], axis=0), of_slot, slots[open_])

    def _move(self, level: int, base: np.ndarray, rows: list[np.ndarray], right: np.ndarray) -> None:
        weights, sums, touched = self.weights[level], self.sums[level], self.touched[level]
        gradient = softmax(base, weights, rows)
        np.negative(gradient, out=gradient)
        gradient[np.arange(len(right)), right] += 1
        for row in rows:
            used, total, n = row_sums(gradient, row)
            size = sums.take(used) + np.einsum("ij,ij->i", total, total)
            sums[used] = size
            total *= (RATE / np.sqrt(size))[:, None]
            total += weights.take(used, axis=0)
            weights[used] = total
            touched[used] += n


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches, their tokens one after another, and where each document starts."""
    for batch in batches:
        if len(batch):
            parts = [np.frombuffer(x.as_py(), "<u2") for x in batch.column("ids")]
            yield batch, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]


_DELTA = pa.schema([("salt", pa.int32()), ("level", pa.int32()), ("block", pa.int32()), ("change", pa.binary()), ("touched", pa.binary())])
_DELTA_DDL = "salt int, level int, block int, change binary, touched binary"


def _learn(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(model)
        for _, ids, starts in _groups(batches):
            for a in range(0, len(ids), BATCH):
                learner.step(ids, starts, a, min(a + BATCH, len(ids)))
        salt = TaskContext.get().partitionId() % _SALTS
        for level, before in enumerate((model.class_weights, model.slot_weights)):
            change = (learner.weights[level] - before) * learner.touched[level][:, None]
            for block in range(0, len(before), BLOCK):
                touched = learner.touched[level][block : block + BLOCK]
                if touched.any():
                    yield pa.RecordBatch.from_pylist([{
                        "salt": salt, "level": level, "block": block // BLOCK, "change": change[block : block + BLOCK].tobytes(),
                        "touched": touched.tobytes()}], _DELTA)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks a task reads; what it holds has the size of the weights."""
    totals: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            new = [np.frombuffer(r[c], np.float32) for c in ("change", "touched")]
            old = totals.get((r["level"], r["block"]))
            totals[r["level"], r["block"]] = new if old is None else [x + y for x, y in zip(old, new, strict=True)]
    for (level, block), (change, touched) in totals.items():
        yield pa.RecordBatch.from_pylist([{"salt": 0, "level": level, "block": block, "change": change.tobytes(), "touched": touched.tobytes()}], _DELTA)


def train(encoded: DataFrame, class_base: np.ndarray, slot_base: np.ndarray) -> Model:
    """Weights after ``ROUNDS`` rounds over the rows of ``encoded`` that are not held out."""
    shape = (1 << BITS, CLASSES)
    model = Model(class_base, slot_base, np.zeros(shape, np.float32), np.zeros(shape, np.float32))
    learnable = encoded.filter(~F.col("held_out"))
    for r in range(ROUNDS):
        mine = learnable.filter(F.pmod(F.xxhash64("ids"), F.lit(ROUNDS)) == r).select("ids")
        changes = mine.mapInArrow(_learn(model), _DELTA_DDL)
        salted = changes.repartition("level", "block", "salt").mapInArrow(_added, _DELTA_DDL)
        total = salted.repartition("level", "block").mapInArrow(_added, _DELTA_DDL)
        weights = [model.class_weights.copy(), model.slot_weights.copy()]
        for row in written(total, "weights").collect():
            at = slice(row["block"] * BLOCK, (row["block"] + 1) * BLOCK)
            touched = np.frombuffer(row["touched"], np.float32)
            weights[row["level"]][at] += np.frombuffer(row["change"], np.float32).reshape(-1, CLASSES) / np.maximum(touched, 1)[:, None]
        model = Model(class_base, slot_base, *weights)
    return model


@dataclass(frozen=True)
class Vocabulary:
    """What is known of words: (word, c, id, share), the totals, and the log frequencies of classes and slots.

    ``id`` is class * SLOTS + slot, ``share`` log10 P(word | slot).
    """

    words: DataFrame
    train_tokens: int
    known: int
    unseen_share: float
    class_base: np.ndarray
    slot_base: np.ndarray


def vocabulary(docs: DataFrame, listed: DataFrame) -> Vocabulary:
    """Counts, classes and slots from the words of all parts and the learnable texts."""
    counts = written(listed.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"), "counts")
    end = F.lit(int(END.view(np.int64)))
    facts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
                       F.count(F.when(F.col("c") == 1, 1)).alias("once"), F.count(F.when(F.col("c") == 2, 1)).alias("twice")).first()
    anchors = counts.filter(F.col("word") != end).orderBy(F.col("c").desc(), "word").limit(NO_ANCHOR).collect()
    hashes = np.array([r["word"] for r in anchors], np.int64).view(np.uint64)
    place = F.lit(NO_ANCHOR)
    if anchors:
        learnable = docs.filter(~F.col("held_out")).select("text")
        follows = learnable.mapInArrow(_followers(hashes), "word bigint, anchor int, n bigint")
        follows = follows.groupBy("word", "anchor").agg(F.sum("n").alias("n"))
        often = F.element_at(F.array(*[F.lit(float(r["c"])) for r in anchors]), F.col("anchor") + 1)
        best = follows.groupBy("word").agg(F.max(F.struct((F.col("n") / often).alias("rate"), (-F.col("anchor")).alias("anchor"))).alias("m"))
        counts = counts.join(best.select("word", (-F.col("m.anchor")).alias("anchor")), "word", "left")
        place = F.coalesce("anchor", F.lit(NO_ANCHOR))
    classed = written(counts.select("word", "c", F.when(F.col("c") < 2, RARE).otherwise(place).cast("int").alias("class")), "classes")

    order = Window.partitionBy("class").orderBy(F.col("c").desc(), "word")
    heads = written(classed.filter(F.col("class") != RARE).withColumn("rank", F.row_number().over(order))
                    .filter(F.col("rank") < SLOTS).select("word", "class", "c", (F.col("rank") - 1).alias("slot")), "heads")
    mass = np.zeros(CLASSES)
    for r in classed.groupBy("class").agg(F.sum("c").alias("n")).collect():
        mass[r["class"]] = r["n"]
    slots = np.zeros((CLASSES, SLOTS))
    for r in heads.collect():
        slots[r["class"], r["slot"]] = r["c"]
    tails = mass - slots.sum(axis=1)
    slots[:, -1] = tails
    # the class of rare words has one slot, which holds the unseen word too
    slots[RARE] = 0
    slots[RARE, 0] = mass[RARE] = facts["once"] + 1
    unseen = (facts["once"] + 1) / (facts["once"] + 1 + 2 * facts["twice"] + 1) if facts["once"] else 1.0
    with np.errstate(divide="ignore", invalid="ignore"):
        class_base = np.where(mass > 0, np.log(mass / mass.sum()), _NEVER)
        slot_base = np.where(slots > 0, np.log(slots / mass[:, None]), _NEVER)
    once_share = math.log10((1 - unseen) / facts["once"]) if facts["once"] else 0.0
    tail = F.element_at(F.array(*[F.lit(float(max(t, 1))) for t in tails]), F.col("class") + 1)
    share = F.when(F.col("class") == RARE, once_share).when(F.col("slot").isNotNull(), 0.0).otherwise(F.log10(F.col("c") / tail))
    number = F.col("class") * SLOTS + F.when(F.col("class") == RARE, 0).otherwise(F.coalesce("slot", F.lit(SLOTS - 1)))
    words = classed.join(heads.select("word", "slot"), "word", "left").select("word", "c", number.cast("int").alias("id"), share.alias("share"))
    return Vocabulary(words, facts["n"], facts["v"], math.log10(unseen), class_base.astype(np.float32), slot_base.astype(np.float32))


_ENCODED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, shares double, ids binary"


def encode(rows: DataFrame, listed: DataFrame, known: Vocabulary) -> DataFrame:
    """Every document with its token ids, what does not depend on the model summed."""
    seen = listed.join(known.words, "word").select(F.col("part").alias("of_part"), "place", "c", "id", "share")
    total, unseen = known.train_tokens + known.known + 1, known.unseen_share

    def resolve(mine: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(t, "<u4") for t in mine["tokens"]]
        found = np.concatenate(parts)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]
        size = int(found.max()) + 1
        count, number, share = np.zeros(size), np.full(size, RARE * SLOTS, "<u2"), np.full(size, unseen)
        words = words[words["place"] < size]
        at = words["place"].to_numpy()
        count[at], number[at], share[at] = words["c"], words["id"], words["share"]
        base = np.log10((count + 1) / total)
        ids = number[found]
        return pd.DataFrame({
            "doc_id": mine["doc_id"].astype("Int64"), "held_out": mine["held_out"].astype(bool),
            "n_tokens": [len(p) for p in parts], "n_known": np.add.reduceat((count > 0)[found].astype(np.int64), starts),
            "base_score": np.add.reduceat(base[found], starts), "shares": np.add.reduceat(share[found], starts),
            "ids": [ids[a : a + len(p)].tobytes() for a, p in zip(starts, parts, strict=True)]})

    documents = rows.filter("words IS NULL").select("part", "doc_id", "held_out", "tokens")
    return documents.groupBy("part").cogroup(seen.groupBy("of_part")).applyInPandas(resolve, _ENCODED)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, starts in _groups(batches):
            logs = np.concatenate([log10_probabilities(model, ids, starts, a, min(a + BATCH, len(ids))) for a in range(0, len(ids), BATCH)])
            scores = np.add.reduceat(logs, starts) + batch.column("shares").to_numpy()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _KEPT], pa.array(scores)], [*_KEPT, "score"])

    return run


_KEPT = ("doc_id", "held_out", "n_tokens", "n_known", "base_score")


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), "text")
    rows = written(texts.mapInArrow(_parts, "part bigint, doc_id bigint, held_out boolean, tokens binary, words array<bigint>, counts array<bigint>"), "parts")
    listed = rows.filter("words IS NOT NULL").select("part", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    listed = listed.select("part", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    known = vocabulary(texts, listed)
    encoded = written(encode(rows, listed.select("part", "place", "word"), known), "encoded")
    model = train(encoded, known.class_base, known.slot_base)
    scored = encoded.select(*_KEPT, "shares", "ids").mapInArrow(
        _score(model), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
