"""BPE encoding and decoding with content-defined chunk reuse.

1. Texts are told apart by a digest, so equal texts are encoded once.
2. A rolling hash cuts each distinct text into chunks whose borders move with
   the content; chunks that occur more than once are found by their digests.
3. One owner of each shared chunk encodes it, and the ids travel to all texts
   that hold the chunk. What lies between shared chunks is encoded in place.
4. Joins are repaired: around each join the window from the last separator
   before it to the first one after it is re-encoded, over as many chunks as it
   takes. Such a tokenizer never joins characters across a separator, so from
   both ends of the window on the ids agree exactly with those of the whole text.

The tokenizer file must drop blanks and line breaks and never work across them;
``Codec`` checks this on a probe. Inside a task, pieces between separators are
looked up in a bounded cache.

Defined cases: a null or empty text has no ids and decodes to an empty text;
repeated rows each get the result; very long texts are one row with all their
ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.arrays import mix, prefix_hash, powers, row_groups, utf8
from tidelake.llm.scratch import written

#: Bytes: the rolling window, the mean chunk (a power of two), the least and the largest.
ROLL, MEAN, LEAST, MOST = 16, 1024, 256, 8192
#: Pieces a task keeps before it starts its cache anew.
CACHE_PIECES = 200_000
#: Bytes of ids handed on at a time.
OUTPUT_BYTES = 4 << 20


def text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks of one text, at character borders."""
    n = len(data)
    ends: list[int] = []
    if n > ROLL:
        prefix, down = prefix_hash(data), powers(n + 1)[1]
        rolled = mix((prefix[ROLL:] - prefix[:-ROLL]) * down[: n - ROLL + 1])
        cuts = np.flatnonzero((rolled & np.uint64(MEAN - 1)) == 0) + ROLL
        cuts = cuts[cuts < n]
        cuts = cuts[(data[cuts] & 0xC0) != 0x80].tolist()
    else:
        cuts = []
    last = 0
    for cut in [*cuts, n]:
        while cut - last > MOST:
            last += MOST
            while (data[last] & 0xC0) == 0x80:
                last -= 1
            ends.append(last)
        if cut - last >= LEAST or cut == n:
            if cut > last:
                ends.append(cut)
            last = cut
    return ends


class Codec:
    """A tokenizer with a cache of pieces. ``ids`` are packed little-endian in the narrowest fitting type."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a process per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.cache: dict[str, bytes] = {"": b""}
        self.tokens: list[str] | None = None
        whole = self.tokenizer.encode("one two\nthree", add_special_tokens=False).ids
        apart = [i for w in ("one", "two", "three") for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        if whole != apart:
            raise ValueError(f"{path}: this tokenizer works across blanks or line breaks")

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; a piece holds no separator."""
        cache = self.cache
        new = list({p for p in pieces if p not in cache})
        if new:
            if len(cache) + len(new) > CACHE_PIECES:
                cache.clear()
                cache[""] = b""
                new = list(set(pieces) - {""})
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
                cache.update((p, np.array(e.ids, self.dtype).tobytes()) for p, e in zip(part, found, strict=True))
        return [cache[p] for p in pieces]

    def segment(self, text: str) -> tuple[list[str], list[bytes]]:
        parts = text.replace("\n", " ").split(" ")
        return parts, self.pieces(parts)


    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens kept. Without a decoder in the file it is the token strings with blanks between."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        if self.tokens is None:
            size = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def distinct_chunks(docs: DataFrame) -> DataFrame:
    """(text_key, chunks) of each distinct text: digest, start and end in bytes of each chunk."""
    item = pa.struct([("key", pa.binary()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in row_groups(offsets):
                rows = []
                for r in range(i, j):
                    own = data[offsets[r]:offsets[r + 1]]
                    raw, start, chunks = own.tobytes(), 0, []
                    for end in chunk_ends(own):
                        chunks.append({"key": hashlib.blake2b(raw[start:end], digest_size=16).digest(), "start": start, "end": end})
                        start = end
                    rows.append(chunks)
                yield pa.RecordBatch.from_arrays([batch.column("text_key").slice(i, j - i), pa.array(rows, pa.list_(item))], ["text_key", "chunks"])

    chunked = docs.select(text_key(F.col("text")).alias("text_key"), "text").mapInArrow(
        run, "text_key binary, chunks array<struct<key:binary,start:bigint,end:bigint>>"
    )
    return chunked.groupBy("text_key").agg(F.first("chunks").alias("chunks"))


def _packed(docs: DataFrame) -> DataFrame:
    """(text_key, packed): each distinct text once, compressed for its way through the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows = [squeeze.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(rows, pa.binary())], ["text_key", "packed"])

    packed = docs.select(text_key(F.col("text")).alias("text_key"), "text").mapInArrow(run, "text_key binary, packed binary")
    # the filter keeps both uses of this frame alike, so that Spark shuffles the texts once
    return packed.filter("text_key IS NOT NULL").groupBy("text_key").agg(F.first("packed").alias("packed"))


def _export(path: str):
    """Encode the shared chunks a text owns. ``head`` and ``tail`` are the ids' bytes of the first and last piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, open_ = codec(path), zstandard.ZstdDecompressor()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for packed, owned in zip(batch.column("packed"), batch.column("owned").to_pylist(), strict=True):
                raw = open_.decompress(packed.as_py())
                for c in owned:
                    parts, ids = tool.segment(raw[c["start"]:c["end"]].decode())
                    solo = len(parts) == 1
                    for column, value in zip(out, (c["key"], b"".join(ids), -1 if solo else len(ids[0]), -1 if solo else len(ids[-1])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.binary(), pa.int32(), pa.int32()), strict=True)], ["key", "ids", "head", "tail"]
            )

    return run


def _segments(raw: bytes, shared: list[dict]) -> Iterator[tuple[int, int, dict | None]]:
    """The shared chunks of a text in order, and the stretches between them."""
    at = 0
    for c in sorted(shared, key=lambda c: c["start"]):
        if c["start"] > at:
            yield at, c["start"], None
        yield c["start"], c["end"], c
        at = c["end"]
    if at < len(raw):
        yield at, len(raw), None


def assemble(tool: Codec, raw: bytes, shared: list[dict]) -> bytes:
    """Ids of a whole text from those of its shared chunks, with every join repaired."""
    out: list[bytes] = []
    open_ = ""  # text since the last separator: it joins what comes next

    def piece(text: str) -> bytes:
        return tool.pieces([text])[0]

    for start, end, chunk in _segments(raw, shared):
        if chunk is None or chunk["head"] < 0:
            parts, ids = tool.segment(raw[start:end].decode())
            if len(parts) == 1:
                open_ += parts[0]
                continue
            out.append(piece(open_ + parts[0]) if open_ else ids[0])
            out += ids[1:-1]
            open_ = parts[-1]
            continue
        ids, text = chunk["ids"], raw[start:end]
        if open_:
            first = min(x for x in (text.find(b" "), text.find(b"\n")) if x >= 0)
            out.append(piece(open_ + text[:first].decode()))
            ids = ids[chunk["head"]:]
        out.append(ids[: len(ids) - chunk["tail"]])
        open_ = text[max(text.rfind(b" "), text.rfind(b"\n")) + 1 :].decode()
    out.append(piece(open_))
    return b"".join(out)


def whole_ids(tool: Codec, ids: np.ndarray) -> tuple:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    return (ids.astype("<u4").tobytes(),)


def _encode(path: str, fields: dict[str, pa.DataType], finish: Callable[[Codec, np.ndarray], tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, open_ = codec(path), zstandard.ZstdDecompressor()

        def made(keys: list[bytes], rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            arrays = [pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *arrays], ["text_key", *fields])

        for batch in batches:
            size, keys, rows = 0, [], []
            for key, packed, shared in zip(batch.column("text_key"), batch.column("packed"), batch.column("shared"), strict=True):
                ids = np.frombuffer(assemble(tool, open_.decompress(packed.as_py()), shared.as_py() or []), tool.dtype)
                keys.append(key.as_py())
                rows.append(finish(tool, ids))
                size += 4 * len(ids)
                if size > OUTPUT_BYTES:
                    yield made(keys, rows)
                    size, keys, rows = 0, [], []
            yield made(keys, rows)

    return run


_DDL = {pa.binary(): "binary", pa.string(): "string", pa.int64(): "bigint"}


def encode_distinct(
    docs: DataFrame, path: str, fields: dict[str, pa.DataType] | None = None, finish: Callable[[Codec, np.ndarray], tuple] = whole_ids
) -> DataFrame:
    """text_key and ``ids`` of every distinct text.

    ``finish`` may make other columns, named and typed by ``fields``, of the
    codec and a text's ids where they are encoded, so that the ids need not
    leave the task.
    """
    fields = fields or {"ids": pa.binary()}
    chunked = written(distinct_chunks(docs), "chunks")
    held = chunked.select("text_key", F.explode("chunks").alias("c")).select("text_key", "c.*")
    seen = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_key", "start", "end")).alias("owner"))
    shared = seen.filter("n > 1").select("key", "owner.*")
    owned = shared.groupBy("text_key").agg(F.collect_list(F.struct("key", "start", "end")).alias("owned"))
    packed = _packed(docs)
    encoded = packed.join(owned, "text_key").select("packed", "owned").mapInArrow(_export(path), "key binary, ids binary, head int, tail int")
    used = held.join(encoded, "key").groupBy("text_key").agg(F.collect_list(F.struct("start", "end", "ids", "head", "tail")).alias("shared"))
    schema = ", ".join(["text_key binary", *[f"{name} {_DDL[kind]}" for name, kind in fields.items()]])
    return packed.join(used, "text_key", "left").mapInArrow(_encode(path, fields, finish), schema)


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """(text_key, ids, text): the ids decoded, special tokens kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                text = tool.decode(np.frombuffer(row.column("ids")[0].as_py(), "<u4"))
                yield pa.RecordBatch.from_arrays([row.column("text_key"), row.column("ids"), pa.array([text])], ["text_key", "ids", "text"])

    return encoded.select("text_key", "ids").mapInArrow(run, "text_key binary, ids binary, text string")


def per_document(docs: DataFrame, results: DataFrame, *keep: str) -> DataFrame:
    """The kept columns of every document beside the result for its text."""
    rows = docs.select(*keep, text_key(F.col("text")).alias("text_key"))
    return rows.join(results, "text_key").drop("text_key")


def encode(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """The kept columns and ``ids`` of every document."""
    return per_document(docs, encode_distinct(docs, path), *keep)
