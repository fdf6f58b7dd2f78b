"""Cross-tokenizer alignment by diagonal run skipping, and counts of linked ids.

Both tokenizers cut the same bytes, so their tokens are two rising arrays of
byte ends. Offsets where both end a token cut a text into groups. As long as
tokens match one to one, the end arrays agree at a fixed shift between their
indices: probes of doubling width compare them at that shift and jump such
stretches. An irregular group is resolved in place, by moving whichever side
ends earlier, and gives the next shift. Many stretches advance at once as lanes
of numpy arrays; a lane starts at a common end near every ``LANE``-th token.

Corpus-wide counts of linked ids do not travel to each document. A task cuts
its documents into parts of ``PART_BYTES`` of text and lists the distinct pairs
of a part once; documents hold places in that list. Counts are summed per pair
over all parts, joined back to the parts that hold the pair, and meet a part's
documents in one group, which a part's size bounds.

Defined cases: a null or empty text has no tokens; neither has one whose joined
token bytes differ from a blank and the text on either side; special tokens
inside a text are plain text; repeated rows count and are answered each, null
ids too; a text is held whole by a task; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.scratch import written

#: Tokens between the places where lanes may start, and the widest probe.
LANE, WIDEST = 128, 64
#: Bytes of text aligned at a time, and in one part.
GROUP_BYTES, PART_BYTES = 4 << 20, 16 << 20
#: A run of white space from which on the fast encoder's expression may overflow its stack.
_LONG_BLANK = re.compile(r"\s{5000,}")


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rising end arrays with the same last end: which tokens of each end a group."""
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    if not len(a):
        return in_a, in_b
    tries = np.arange(LANE, len(a), LANE)
    there = np.searchsorted(b, a[tries - 1])
    starts = b[there] == a[tries - 1]
    i = np.concatenate([[0], tries[starts]])
    j = np.concatenate([[0], there[starts] + 1])
    stop = np.append(i[1:], len(a))
    # beyond the ends nothing agrees
    a, b = np.append(a, np.full(WIDEST, -1)), np.append(b, np.full(WIDEST, -2))
    while len(i):
        live, width = np.arange(len(i)), 1
        while len(live):
            steps = np.arange(width)
            x, y = i[live, None] + steps, j[live, None] + steps
            same = (a[x] == b[y]) & (x < stop[live, None])
            run = np.where(same.all(axis=1), width, same.argmin(axis=1))
            skipped = steps < run[:, None]
            in_a[x[skipped]] = in_b[y[skipped]] = True
            i[live] += run
            j[live] += run
            live = live[(run == width) & (i[live] < stop[live])]
            width = min(2 * width, WIDEST)
        left = i < stop
        i, j, stop = i[left], j[left], stop[left]
        live = np.arange(len(i))
        while len(live):
            x, y = a[i[live]], b[j[live]]
            i[live] += x < y
            j[live] += y < x
            live = live[x != y]
        in_a[i] = in_b[j] = True
        i += 1
        j += 1
        left = i < stop
        i, j, stop = i[left], j[left], stop[left]
    return in_a, in_b


def links(a: np.ndarray, b: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of tokens whose byte ranges overlap.

    Each distinct end closes one stretch of bytes that lies in one token of each
    side; every overlapping pair has exactly one such stretch as its last.
    """
    own = np.flatnonzero(~in_b)
    return (np.concatenate([np.arange(len(a)), np.searchsorted(a, b[own])]),
            np.concatenate([np.searchsorted(b, a), own]))


@lru_cache(maxsize=1)
def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [i for i in range(256) if i not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteSide:
    """A byte-level BPE file. Its merges are in id order, so ranks may take their place."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        letters = _byte_letters()
        special = {t["id"]: t["content"] for t in described["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in described["model"]["vocab"].items() if i not in special}
        size = 1 + max([*ranks.values(), *special])
        self.path, self.slow = path, None
        self.fast = tiktoken.Encoding("pair", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.full(size, b"", object)
        for i, t in special.items():
            self.bytes[i] = t.encode()
        for t, i in ranks.items():
            self.bytes[i] = t

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._whole(t) if len(t) >= 5000 and _LONG_BLANK.search(t) else self.fast.encode_ordinary(t) for t in texts]

    def _whole(self, text: str) -> list[int]:
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a process per core
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.no_truncation()
            self.slow.no_padding()
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


class PieceSide:
    """A sentencepiece file, which puts a blank before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = np.full(self.model.vocab_size(), b"", object)
        for i in range(len(self.bytes)):
            piece = self.model.id_to_piece(i)
            self.bytes[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _sides(a_path: str, pattern: str, b_path: str) -> tuple[ByteSide, PieceSide, np.ndarray, np.ndarray]:
    a, b = ByteSide(a_path, pattern), PieceSide(b_path)
    return a, b, np.array([len(t) for t in a.bytes]), np.array([len(t) for t in b.bytes])


@dataclass(frozen=True)
class Pair:
    """The files of the two tokenizers and the word pattern of the first."""

    a_path: str
    pattern: str
    b_path: str

    def align(self, texts: list[str | None]) -> Aligned:
        side_a, side_b, len_a, len_b = _sides(self.a_path, self.pattern, self.b_path)
        given = [i for i, t in enumerate(texts) if t]
        all_a = side_a.encode([f" {texts[i]}" for i in given])
        all_b = side_b.encode([texts[i] for i in given])
        empty = np.zeros(0, np.int64)
        ids_a, ids_b = [empty] * len(texts), [empty] * len(texts)
        for i, a, b in zip(given, all_a, all_b, strict=True):
            a, b, whole = np.array(a, np.int64), np.array(b, np.int64), f" {texts[i]}".encode()
            if b"".join(side_a.bytes[a].tolist()) == whole == b"".join(side_b.bytes[b].tolist()):
                ids_a[i], ids_b[i] = a, b
        a, b = np.concatenate([empty, *ids_a]), np.concatenate([empty, *ids_b])
        ends_a, ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
        first_a = np.concatenate([[0], np.cumsum([len(x) for x in ids_a])]).astype(np.int64)
        first_b = np.concatenate([[0], np.cumsum([len(x) for x in ids_b])]).astype(np.int64)
        return Aligned(a, b, first_a, first_b, ends_a, ends_b, *common_ends(ends_a, ends_b))


@dataclass(frozen=True)
class Aligned:
    """Tokens of several texts one after another; text i has tokens [first[i], first[i + 1])."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray

    def groups(self) -> np.ndarray:
        """Number of groups of each text."""
        return np.diff(np.concatenate([[0], np.cumsum(self.in_a)])[self.first_a])

    def pairs(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distinct linked pairs of each text, ``a << 32 | b``, and how often each is linked."""
        at_a, at_b = links(self.ends_a, self.ends_b, self.in_b)
        keys = self.a[at_a] << 32 | self.b[at_b]
        n = len(self.a)  # the first n belong to the tokens of a, the rest to those ends of b that a lacks
        rest = n + np.searchsorted(at_b[n:], self.first_b)
        texts = zip(self.first_a[:-1], self.first_a[1:], rest[:-1], rest[1:], strict=True)
        return [np.unique(np.concatenate([keys[p:q], keys[r:s]]), return_counts=True) for p, q, r, s in texts]

    def written_groups(self) -> tuple[np.ndarray, np.ndarray]:
        """All groups as text, ``a1,a2|b1;a3|b2,b3``, and the offset of each text in it."""
        n = len(self.a) + len(self.b)
        last_a, last_b = np.flatnonzero(self.in_a), np.flatnonzero(self.in_b)
        group_a, group_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        at_a = np.arange(len(self.a)) + np.concatenate([[0], last_b + 1])[group_a]
        at_b = np.arange(len(self.b)) + (last_a + 1)[group_b] if len(last_a) else np.zeros(0, np.int64)
        ids = np.zeros(n, np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        digits = _digits(int(ids.max(initial=0)))
        cells = np.zeros((n, digits.shape[1] + 1), np.uint8)
        cells[:, :-1] = digits[ids]
        cells[at_a, -1] = np.where(self.in_a, ord("|"), ord(","))
        cells[at_b, -1] = np.where(self.in_b, ord(";"), ord(","))
        first = self.first_a + self.first_b
        cells[first[1:][np.diff(first) > 0] - 1, -1] = 0
        used = cells != 0
        return cells[used], np.concatenate([[0], np.cumsum(used.sum(axis=1))])[first]


@lru_cache(maxsize=4)
def _digit_table(width: int) -> np.ndarray:
    numbers = np.arange(10**width)
    powers = 10 ** np.arange(width - 1, -1, -1)
    shown = (numbers[:, None] >= powers) | (powers == 1)
    return np.where(shown, numbers[:, None] // powers % 10 + ord("0"), 0).astype(np.uint8)


def _digits(largest: int) -> np.ndarray:
    """Decimal digits of all numbers up to at least ``largest``, zero where there is none."""
    return _digit_table(len(str(largest)))


def _text_groups(texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
    """Ranges of rows of about ``GROUP_BYTES`` and their size; a longer row is a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > GROUP_BYTES:
            yield start, i, size
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts), size


def alignments(docs: DataFrame, pair: Pair) -> DataFrame:
    """doc_id, a_ids, b_ids, and groups as pairs of ends into the two id lists, for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j, _ in _text_groups(texts):
                got = pair.align(texts[i:j])
                ends_a, ends_b = np.flatnonzero(got.in_a) + 1, np.flatnonzero(got.in_b) + 1
                at = np.concatenate([[0], np.cumsum(got.groups())]).astype(np.int32)
                n = np.diff(at)
                ends = pa.StructArray.from_arrays(
                    [pa.array((ends_a - np.repeat(got.first_a[:-1], n)).astype(np.int32)),
                     pa.array((ends_b - np.repeat(got.first_b[:-1], n)).astype(np.int32))], ["a_end", "b_end"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j],
                     pa.ListArray.from_arrays(got.first_a.astype(np.int32), got.a.astype(np.int32)),
                     pa.ListArray.from_arrays(got.first_b.astype(np.int32), got.b.astype(np.int32)),
                     pa.ListArray.from_arrays(at, ends)], ["doc_id", "a_ids", "b_ids", "groups"])

    schema = "doc_id bigint, a_ids array<int>, b_ids array<int>, groups array<struct<a_end: int, b_end: int>>"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


_FIXED = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64()}
_DDL = {pa.binary(): "binary", pa.string(): "string", pa.int64(): "bigint"}
#: Rows handed on at a time.
_OUTPUT_ROWS = 512


def _parts(pair: Pair, fields: dict[str, pa.DataType], finish: Callable[[Aligned], list[list]]):
    """Rows of documents, and one row after the documents of each part with its distinct pairs."""
    schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), *_FIXED.items(), *fields.items(),
                        ("place", pa.binary()), ("times", pa.binary()),
                        ("pairs", pa.list_(pa.int64())), ("linked", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = TaskContext.get().partitionId() << 32, 0
        columns: dict[str, list] = {name: [] for name in ("doc_id", *_FIXED, *fields)}
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
            linked = np.bincount(place, np.concatenate(times), len(pairs)).astype(np.int64)
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            rows = [{"part": part, **{name: values[i] for name, values in columns.items()},
                     "place": place[at[i] : at[i + 1]].astype("<u4").tobytes(), "times": times[i].astype("<u4").tobytes()}
                    for i in range(len(keys))]
            rows.append({"part": part, "pairs": pairs, "linked": linked})
            for i in range(0, len(rows), _OUTPUT_ROWS):
                yield pa.RecordBatch.from_pylist(rows[i : i + _OUTPUT_ROWS], schema)
            for held in (keys, times, *columns.values()):
                held.clear()

        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for i, j, chars in _text_groups(texts):
                got = pair.align(texts[i:j])
                counted = got.pairs()
                n_a, n_b, n_groups = np.diff(got.first_a), np.diff(got.first_b), got.groups()
                made = [ids[i:j], n_a.tolist(), n_b.tolist(), n_groups.tolist(), (n_a + n_b - n_groups).tolist(), *finish(got)]
                for name, values in zip(columns, made, strict=True):
                    columns[name] += values
                keys += [k for k, _ in counted]
                times += [n for _, n in counted]
                size += chars
                if size >= PART_BYTES:
                    yield from flush()
                    part, size = part + 1, 0
        if keys:
            yield from flush()

    ddl = ", ".join(["part bigint", "doc_id bigint", *[f"{n} {_DDL[t]}" for n, t in {**_FIXED, **fields}.items()],
                     "place binary", "times binary", "pairs array<bigint>", "linked array<bigint>"])
    return run, ddl


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, count and whether it is the highest of its b, from rows with pairs and how often each is linked.

    One b has at most as many rows as the other tokenizer has ids.
    """
    counts = found.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    highest = F.max("count").over(Window.partitionBy("b"))
    return counts.select(F.shiftright("pair", 32).alias("a"), "b", "pair", "count", (F.col("count") == highest).alias("best"))


def linked(docs: DataFrame, pair: Pair, fields: dict[str, pa.DataType], finish: Callable[[Aligned], list[list]]) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, ``fields``, n_best and count_sum of every document.

    ``finish`` makes the columns named by ``fields`` where texts are aligned.
    """
    run, ddl = _parts(pair, fields, finish)
    rows = written(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ddl), "aligned")
    listed = rows.filter("pairs IS NOT NULL").select("part", F.posexplode(F.arrays_zip("pairs", "linked")).alias("place", "p"))
    listed = listed.select("part", "place", F.col("p.pairs").alias("pair"), F.col("p.linked").alias("n"))
    counts = written(pair_counts(listed).select("pair", "count", "best"), "pair-counts")
    back = listed.select("part", "place", "pair").join(counts, "pair").select(F.col("part").alias("of_part"), "place", "count", "best")
    kept = ["doc_id", *_FIXED, *fields]

    def total(mine: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = mine[kept].copy()
        count, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        count[known["place"]], best[known["place"]] = known["count"], known["best"]
        sums, tops = [], []
        for place, times in zip(mine["place"], mine["times"], strict=True):
            at, n = np.frombuffer(place, "<u4"), np.frombuffer(times, "<u4")
            sums.append(int(count[at] @ n))
            tops.append(int(best[at] @ n))
        out["n_best"], out["count_sum"] = np.array(tops, np.int64), np.array(sums, np.int64)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    schema = ", ".join(["doc_id bigint", *[f"{n} {_DDL[t]}" for n, t in {**_FIXED, **fields}.items()], "n_best bigint", "count_sum bigint"])
    documents = rows.filter("pairs IS NULL").select("part", *kept, "place", "times")
    return documents.groupBy("part").cogroup(back.groupBy("of_part")).applyInPandas(total, schema)
