"""Removal of repeated byte strings by minimiser selection with content hashes.

A byte of a document goes when it is covered by a string of ``LENGTH`` bytes
that also starts in a document with a smaller doc_id.

A bucket holds the suffixes that share their first ``GRAM`` bytes, and its
identifier is a hash of those bytes, so that every task knows it without asking.
Longer stretches are named by the identifiers of later offsets: 20 bytes and the
bucket 20 further on give 40, these and the bucket 30 further on give 50. No
sort gives new identifiers to a later round, as a refinement of bucket pointers
would.

Of the suffixes in a window only one is sent: the one with the least bucket
identifier. Neighbouring windows that agree on it form a run of up to
``LENGTH - GRAM + 1`` windows, named by the refined identifiers of its ends.

1. Runs are sorted by bucket, refined identifier and document. A run that also
   stands in a smaller document goes whole. Of the others a run is ambiguous if
   its bucket has a different run that may agree with it: any common window holds
   the bucket's bytes and at least ``SIDE`` more on one side, so a few hash bits
   of both sides rule out most runs that meet by chance.
2. Only ambiguous runs are taken apart into windows, which are sorted by their
   refined identifiers in the same way.
3. Each text meets its marks, and the covered bytes are cut out.

Sorted buckets are read as a stream with a state of a few rows, so a string in a
third of all documents needs no more memory than another one. Identifiers of
windows have 128 bits; a run's bucket and its name come from the same 64-bit
hashes of 20 bytes.

Defined cases: a null text is empty; texts below ``LENGTH`` bytes stay whole;
rows that share a doc_id are not smaller than one another and each is judged by
its own text; a document with a null doc_id stays whole and removes nothing;
very long texts are worked on in pieces; an empty table gives no rows; other
columns are ignored. What is kept is binary, as a cut may split a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.arrays import _BYTE_VALUES, mix, powers, prefix_hash, row_groups, span_hash, utf8
from tidelake.llm.bitmaps import bitmap, marked
from tidelake.llm.scratch import written

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
SIDE = (LENGTH - GRAM) // 2
#: Values of the side marks, and the one that says no window reaches that far.
SIDES, NO_SIDE = 63, 63
MARK_BITS = 15
MARK = (1 << MARK_BITS) - 1
#: Bytes of one text worked on at a time.
PIECE = 4 << 20
_U = np.uint64
_K = [_U(k) for k in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
#: A second, independent hash of bytes for the other half of an identifier.
_OTHER_VALUES = _BYTE_VALUES[::-1] * _K[0]
_POSITION = (1 << 24) - 1


class Suffixes:
    """Bucket identifiers of all suffixes of a group of texts."""

    def __init__(self, data: np.ndarray):
        self.data = data
        n = len(data)
        self.prefix, self.other = prefix_hash(data), prefix_hash(data, _OTHER_VALUES)
        self.down = powers(n + 1)[1]
        m = max(n - GRAM + 1, 0)
        self.first = mix((self.prefix[GRAM:] - self.prefix[:m]) * self.down[:m]) if m else np.zeros(0, _U)

    def refined(self, at: np.ndarray) -> np.ndarray:
        """Identifiers for ``LENGTH`` bytes: refined at offset 20, then at the last offset that fits."""
        double = mix(self.first[at] * _K[0] + self.first[at + GRAM])
        return mix(double * _K[1] + self.first[at + LENGTH - GRAM])

    def second(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """An independent identifier of each span."""
        return span_hash(self.other, starts, ends)


def runs_of(texts: Suffixes, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, last, place) of the runs: windows start..last of a row share their least bucket, at ``place``."""
    n = len(texts.data)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    key = (texts.first & ~_U(_POSITION)) | np.arange(len(texts.first), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = SPAN - width
    least = (np.minimum(key[: len(key) - rest], key[rest:]) & _U(_POSITION)).astype(np.int64)
    closed = np.zeros(n + 1, np.int32)
    np.add.at(closed, np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1]), 1)
    np.add.at(closed, offsets[1:], -1)
    fits = np.cumsum(closed)[: len(least)] == 0
    new = np.ones(len(least) + 1, bool)
    new[1:-1] = least[1:] != least[:-1]
    before, after = np.zeros(len(least), bool), np.zeros(len(least), bool)
    before[1:], after[:-1] = fits[:-1], fits[1:]
    start = np.flatnonzero(fits & (new[:-1] | ~before))
    last = np.flatnonzero(fits & (new[1:] | ~after))
    return np.searchsorted(offsets, start, "right") - 1, start, last, least[start]


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, rows, bases) of groups of texts; a very long text comes in overlapping pieces."""
    data, offsets = utf8(column)
    for i, j in row_groups(offsets):
        if offsets[j] - offsets[i] <= PIECE:
            yield data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], np.arange(i, j), np.zeros(j - i, np.int64)
            continue
        for base in range(0, int(offsets[j] - offsets[i]), PIECE):
            part = data[offsets[i] + base : min(offsets[i] + base + PIECE + LENGTH - 1, offsets[j])]
            yield part, np.array([0, len(part)]), np.array([i]), np.array([base])


def text_mark(column: pa.Array) -> np.ndarray:
    """A few bits that tell apart the texts of one doc_id."""
    data, offsets = utf8(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, j in row_groups(offsets):
        part = data[offsets[i]:offsets[j]]
        for base in range(0, max(len(part), 1), PIECE):
            cut = np.clip(offsets[i:j + 1] - offsets[i] - base, 0, PIECE)
            hashed = span_hash(prefix_hash(part[base : base + PIECE]), cut[:-1], cut[1:])
            out[i:j] = mix(out[i:j].view(np.uint64) * _K[2] + hashed).view(np.int64)
    return (out.view(np.uint64) >> _U(64 - MARK_BITS)).astype(np.int64)


def packed_place(start: np.ndarray, extra: np.ndarray, left: np.ndarray, right: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Start, further windows (5 bits), both side marks (6 bits each) and the text's mark in one number, in order of start."""
    return (start << 32) | (extra << 27) | (left << 21) | (right << 15) | mark


def _side_marks(texts: Suffixes, start: np.ndarray, last: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash bits of the bucket's bytes with ``SIDE`` more to the left, and to the right."""
    left, right = np.full(len(place), NO_SIDE, np.int64), np.full(len(place), NO_SIDE, np.int64)
    far = np.flatnonzero(place - start >= SIDE)
    left[far] = (span_hash(texts.prefix, place[far] - SIDE, place[far] + GRAM) % _U(SIDES)).astype(np.int64)
    far = np.flatnonzero(last - place + LENGTH - GRAM >= SIDE)
    right[far] = (span_hash(texts.prefix, place[far], place[far] + GRAM + SIDE) % _U(SIDES)).astype(np.int64)
    return left, right


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column("doc_id"))
        mark = text_mark(batch.column("text"))
        for data, offsets, rows, bases in _pieces(batch.column("text")):
            texts = Suffixes(data)
            row, start, last, place = runs_of(texts, offsets)
            if not len(row):
                continue
            ends = mix(texts.refined(start) * _K[2] + texts.refined(last) + ((place - start) * 64 + last - start).astype(np.uint64))
            left, right = _side_marks(texts, start, last, place)
            at = packed_place(start - offsets[row] + bases[row], last - start, left, right, mark[rows[row]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts.first[place].view(np.int64)), pa.array(ends.view(np.int64)), pa.array(ids[rows[row]]), pa.array(at)],
                ["bucket", "run", "doc_id", "at"],
            )


class Bucket:
    """What is known of a bucket while its runs stream by, sorted by run and document.

    For each side mark: the first run that has it, that run's rows so far, and
    whether a second run has it too. The rows kept are those of one document.
    """

    def __init__(self, name: int):
        self.name, self.run, self.first = name, None, 0
        self.sides: list[dict[int, list]] = [{}, {}]

    def see(self, run: int, doc: int, at: int) -> tuple[bool, list[tuple[int, int]]]:
        """Whether the row goes whole, and the rows that turn out to be ambiguous."""
        if run != self.run:
            self.run, self.first = run, doc
        if doc > self.first:
            return True, []
        found: list[tuple[int, int]] = []
        shared = False
        for side, shift in zip(self.sides, (21, 15), strict=True):
            mark = (at >> shift) & 63
            if mark == NO_SIDE:
                continue
            held = side.get(mark)
            if held is None:
                side[mark] = [run, [(doc, at)]]
            elif held[0] == run and held[1] is not None:
                held[1].append((doc, at))
            else:
                found += held[1] or []
                held[1] = None
                shared = True
        return False, [*found, (doc, at)] if shared else found


def _judge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, run, document. A run after its first document goes; the first ones may be ambiguous."""
    bucket = Bucket(0)
    for batch in batches:
        buckets, runs, ids, places = (np.asarray(batch.column(c)) for c in ("bucket", "run", "doc_id", "at"))
        alone = np.zeros(len(buckets), bool)  # the edges may go on in the next batch, so they always count
        if len(buckets) > 2:
            alone[1:-1] = (buckets[1:-1] != buckets[:-2]) & (buckets[1:-1] != buckets[2:])
        rest = np.flatnonzero(~alone)
        out: list[tuple[int, int, bool]] = []
        for b, r, doc, at in zip(buckets[rest].tolist(), runs[rest].tolist(), ids[rest].tolist(), places[rest].tolist(), strict=True):
            if b != bucket.name or bucket.run is None:
                bucket = Bucket(b)
            whole, open_ = bucket.see(r, doc, at)
            if whole:
                out.append((doc, at, True))
            out += [(d, a, False) for d, a in open_]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["doc_id", "at", "whole"]
        )


def _judge_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by window and document; a window after its first document goes."""
    window, first = None, 0
    for batch in batches:
        names = zip(*(np.asarray(batch.column(c)).tolist() for c in ("window", "second", "doc_id", "at")), strict=True)
        ids, places = [], []
        for a, b, doc, at in names:
            if (a, b) != window:
                window, first = (a, b), doc
            elif doc > first:
                ids.append(doc)
                places.append(at)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64())], ["doc_id", "at"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single windows of ambiguous runs, with both halves of their identifiers."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        for doc, mark, packed, places in zip(*(batch.column(c) for c in ("doc_id", "mark", "packed", "places")), strict=True):
            at = np.asarray(places.values)
            at = np.unique(at[(at & MARK) == mark.as_py()])
            if not len(at):
                continue
            data = np.frombuffer(open_.decompress(packed.as_py()), np.uint8)
            extra = (at >> 27) & 31
            start = np.repeat(at >> 32, extra + 1) + (np.arange((extra + 1).sum()) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1))
            for base in range(0, len(data), PIECE):
                own = start[(start >= base) & (start < base + PIECE)] - base
                if len(own):
                    texts = Suffixes(data[base : base + PIECE + LENGTH - 1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(texts.refined(own).view(np.int64)), pa.array(texts.second(own, own + LENGTH).view(np.int64)),
                         pa.array(np.full(len(own), doc.as_py())), pa.array(packed_place(own + base, 0 * own, 0 * own, 0 * own, mark.as_py()))],
                        ["window", "second", "doc_id", "at"],
                    )


def _split_by(docs: DataFrame, bits: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Documents that surely have no mark, (doc_id, text), and the others packed: (doc_id, mark, packed)."""

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = np.ones(len(batch), bool)
            none[marked(bits, np.asarray(batch.column("h")).view(np.uint64))] = False
            yield batch.select(["doc_id", "text"]).filter(pa.array(none))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            some = batch.take(pa.array(marked(bits, np.asarray(batch.column("h")).view(np.uint64))))
            data = [squeeze.compress((t.as_py() or "").encode()) for t in some.column("text")]
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), pa.array(text_mark(some.column("text"))), pa.array(data, pa.binary())], ["doc_id", "mark", "packed"]
            )

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    return keyed.mapInArrow(without, "doc_id bigint, text string"), keyed.mapInArrow(packed, "doc_id bigint, mark bigint, packed binary")


def find_marks(docs: DataFrame) -> DataFrame:
    """(doc_id, at): the windows to cut, as runs; ``at`` is packed as in ``packed_place``."""
    known = docs.filter("doc_id IS NOT NULL")
    runs = known.select("doc_id", "text").mapInArrow(_runs, "bucket bigint, run bigint, doc_id bigint, at bigint")
    sorted_runs = runs.repartition("bucket").sortWithinPartitions("bucket", "run", "doc_id", "at")
    judged = written(sorted_runs.mapInArrow(_judge_runs, "doc_id bigint, at bigint, whole boolean"), "runs")
    open_runs = judged.filter("NOT whole").select("doc_id", "at")
    asked = open_runs.groupBy("doc_id").agg(F.collect_list("at").alias("places"))
    _, packed = _split_by(known, bitmap(open_runs.select(F.xxhash64("doc_id").alias("h")), "h"))
    windows = packed.join(asked, "doc_id").mapInArrow(_windows, "window bigint, second bigint, doc_id bigint, at bigint")
    sorted_windows = windows.repartition("window").sortWithinPartitions("window", "second", "doc_id", "at")
    more = sorted_windows.mapInArrow(_judge_windows, "doc_id bigint, at bigint")
    return judged.filter("whole").select("doc_id", "at").union(written(more, "windows"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        for i in range(len(batch)):
            data = np.frombuffer(open_.decompress(batch.column("packed")[i].as_py()), np.uint8)
            places = batch.column("places")[i]
            at = np.asarray(places.values) if places.is_valid else np.zeros(0, np.int64)
            at = at[(at & MARK) == batch.column("mark")[i].as_py()]
            start = at >> 32
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, start, 1)
            np.add.at(change, start + ((at >> 27) & 31) + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            spans = [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, 1), pa.array([len(data)], pa.int64()), pa.array([spans], pa.list_(span)),
                 pa.array([data[~gone].tobytes()], pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, ``spans`` removed (start, end in bytes) and the bytes kept."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    marks = find_marks(docs)
    whole, packed = _split_by(docs, bitmap(marks.select(F.xxhash64("doc_id").alias("h")), "h"))
    places = marks.groupBy("doc_id").agg(F.collect_list("at").alias("places"))
    cut = packed.join(places, "doc_id", "left").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )
    kept = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    clean = whole.select(
        "doc_id", F.octet_length(kept).cast("bigint").alias("n_bytes"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), kept.alias("kept"),
    )
    return clean.union(cut)
