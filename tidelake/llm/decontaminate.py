"""Benchmark decontamination by a prefix-filtered containment join.

An item's windows are its runs of ``WINDOW`` words, or all its words if it has
fewer. A window's tokens are its shingles of up to ``SHINGLE`` words. Tokens
are ordered by how often they occur in all documents, and since a window must
be contained whole, its rarest token is a necessary prefix: only documents that
hold this token can hold the window.

1. Bitmaps of fixed size mark the benchmark's tokens; a pass over the documents
   counts the marked ones, summed inside each task first.
2. A second pass emits, for each place in a document whose shingle is a marked
   prefix token, the hashes of the words around it.
3. These places join the windows on the prefix token. The token's position in
   the window gives the only possible start; starts outside the document fall to
   the length bound, and the window's word hashes are compared in full.

Neither side is broadcast or collected; the bitmaps have the same size for any
benchmark. Words are compared by 64-bit hashes.

Defined cases: null texts and texts without words have no windows and no hits;
windows that several items share count for each; repeated items and repeated
documents are rows of their own; an item with a null id hits but is not listed;
empty tables give no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.arrays import Words, row_groups, shingles, utf8
from tidelake.llm.bitmaps import bitmap, marked
from tidelake.session import materialize

WINDOW = 10
SHINGLE = 3
#: Words: ASCII letters and digits and all other characters from U+0080 on.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


def _word_groups(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, offsets = utf8(column)
    for i, j in row_groups(offsets):
        yield i, j, Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], IS_WORD)


def _bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Each item's windows: item_id, ``words`` (their hashes, eight bytes each) and ``tokens`` (shingle hashes in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, ids = [], batch.column("item_id")
            for i, j, words in _word_groups(batch.column("text")):
                for r in range(j - i):
                    h = words.hashes[words.first[r]:words.first[r + 1]]
                    size = min(WINDOW, len(h))
                    for s in range(len(h) - size + 1 if size else 0):
                        w = h[s:s + size]
                        items.append((ids[i + r].as_py(), _bytes(w), shingles(w, min(SHINGLE, size)).view(np.int64).tolist()))
            columns = list(zip(*items, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.list_(pa.int64()))],
                ["item_id", "words", "tokens"],
            )

    return benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(
        run, "item_id bigint, words binary, tokens array<bigint>"
    )


def token_sizes(windows: DataFrame) -> list[int]:
    """The shingle lengths that occur: below ``SHINGLE`` only for items of fewer words."""
    sizes = windows.select(F.least(F.octet_length("words") / 8, F.lit(SHINGLE)).cast("int").alias("k")).distinct()
    return sorted(r["k"] for r in sizes.collect())


def _places(words: Words, sizes: list[int], bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shingle length, tokens, word places, rows) of the marked shingles that do not cross documents."""
    for k in sizes:
        tokens = shingles(words.hashes, k)
        at = marked(bits, tokens)
        row = np.searchsorted(words.first, at, "right") - 1
        inside = at + k <= words.first[row + 1]
        yield k, tokens[at[inside]], at[inside], row[inside]


def token_counts(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """Occurrences in the documents of every marked token: token, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, _, words in _word_groups(batch.column("text")):
                found += [tokens for _, tokens, _, _ in _places(words, sizes, bits)]
            token, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    return docs.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def prefix_tokens(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each distinct window with its rarest token and where it stands: words, token, shift."""
    distinct = windows.select("words", "tokens").dropDuplicates(["words"])
    each = distinct.select("words", F.posexplode("tokens").alias("shift", "token"))
    ranked = each.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ranked.groupBy("words").agg(F.min(F.struct("n", "token", "shift")).alias("least")).select(
        "words", "least.token", "least.shift", "least.n"
    )


def candidate_places(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """One row per document: doc_id, n_words, ``places`` (token, word place, and the hashes of the words around it)."""
    reach = WINDOW - 1
    item = pa.struct([("token", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("around", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in _word_groups(batch.column("text")):
                rows: list[list[dict]] = [[] for _ in range(j - i)]
                for k, tokens, at, row in _places(words, sizes, bits):
                    low = np.maximum(at - reach, words.first[row])
                    high = np.minimum(at + k + reach, words.first[row + 1])
                    for t, a, r, x, y in zip(tokens.view(np.int64).tolist(), at.tolist(), row.tolist(), low.tolist(), high.tolist(), strict=True):
                        first = int(words.first[r])
                        rows[r].append({"token": t, "at": a - first, "start": x - first, "around": _bytes(words.hashes[x:y])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(words.counts().astype(np.int64)), pa.array(rows, pa.list_(item))],
                    ["doc_id", "n_words", "places"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, places array<struct<token:bigint,at:bigint,start:bigint,around:binary>>"
    )


def find_windows(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: row, doc_id, n_words), (hits: row, words, start, stop in words), (windows: words, item_id)."""
    windows = materialize(item_windows(benchmark), "windows")
    sizes = token_sizes(windows)
    all_bits = bitmap(windows.select(F.explode("tokens").alias("token")), "token")
    prefixes = materialize(prefix_tokens(windows, token_counts(docs, all_bits, sizes)), "prefixes")
    # a window whose rarest token occurs nowhere has no hit
    live = prefixes.filter("n > 0").drop("n")
    places = candidate_places(docs, bitmap(live, "token"), sizes).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(places, "places")
    found = rows.select("row", F.explode("places").alias("p")).select("row", "p.*")
    size = (F.octet_length("words") / 8).cast("bigint")
    start = F.col("at") - F.col("shift")
    joined = found.join(live, "token")
    # positional and length bound first, then every word of the window
    own = F.substring("around", ((start - F.col("start")) * 8 + 1).cast("int"), F.octet_length("words"))
    hits = joined.filter((start >= F.col("start")) & (own == F.col("words"))).select(
        "row", "words", start.alias("first"), (start + size).alias("stop")
    )
    return rows.select("row", "doc_id", "n_words"), hits, windows.select("words", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, ``runs`` (word ranges covered by hits), ``items`` (ids, sorted as text)."""
    rows, hits, windows = find_windows(docs, benchmark)
    hits = materialize(hits, "hits")
    none = F.array().cast("array<struct<first:bigint,stop:bigint>>")
    # a hit that begins after all hits before it have ended opens a run; the hits of a row are those of one text
    along = Window.partitionBy("row").orderBy("first", "stop")
    before = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.select("row", "first", "stop").distinct().withColumn("opens", (before.isNull() | (before < F.col("first"))).cast("int"))
    numbered = opened.withColumn("run", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("row", "run").agg(F.min("first").alias("first"), F.max("stop").alias("stop"))
    runs = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "stop"))).alias("runs"))
    items = (
        hits.select("row", "words").distinct().join(windows.filter("item_id IS NOT NULL"), "words")
        .groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    joined = rows.join(runs, "row", "left").join(items, "row", "left")
    return joined.select("doc_id", "n_words", F.coalesce("runs", none).alias("runs"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
