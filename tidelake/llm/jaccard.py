"""N-gram Jaccard join with set-relation skipping.

A set holds the distinct shingles of a document, as 64-bit hashes. Two sets
link when 100 * intersection >= PERCENT * union. The join finds all links
(``similar_links``, ``similar_answers``), or only their connected components
(``similar_groups``).

1. Equal sets are one class, and the smallest document stands for it.
2. Shingles are ordered by rarity, from counts over all documents in a table of
   fixed size. A set's prefix in this order must meet the prefix of any set it
   links with, so only prefixes are indexed.
3. Answers from a similar set: each list of the index has a hub, its smallest
   set. A set is first compared with the hub it shares most of its prefix with.
   The sets that link with one hub are a group. Where only components are asked
   for, what this settles is not computed again: later only sets of different
   components are paired. For all links, the answers inside a group are derived
   from what each member has and its hub has not, or the other way round:
   |a & b| = |a & hub| + |b & hub| - |hub| + |(a ^ hub) & (b ^ hub)|. A group is
   cut into blocks, and each two blocks are a cell of their own.
4. Block skipping: what is left of the lists is joined by blocks of set size and
   position in the prefix. Blocks that cannot reach the overlap are never
   paired, and within them only shingles that stand early enough in both sets
   for the sizes of this pair. A hub's known overlaps with both sets bound the
   pair's, and so do their bitmaps: a place that one set fills and the other
   does not is at least one shingle they do not share. Pairs that pass are
   verified on their whole sets.

Defined cases: words are lower-cased for A-Z only; fewer words than a shingle
needs are one shingle; a document without words has an empty set and links with
nothing; rows with the same doc_id are one node; a null doc_id takes part but
has no component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.arrays import Words, row_groups, sequence_hash, shingles, utf8
from tidelake.llm.bitmaps import bitmap, marked
from tidelake.llm.components import components
from tidelake.session import materialize

SHINGLE = 5
PERCENT = 80
#: Counters for rarity; a fixed number.
COUNTER_BITS = 16
#: Places of a set's bitmap for each of its shingles.
PLACES = 4
#: Members of a group in one block, and shingles compared at once in a cell.
BLOCK, AT_ONCE = 256, 4096
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def sets_of(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Row ranges and the sorted set of each of their rows."""
    data, offsets = utf8(column)
    for i, j in row_groups(offsets):
        words = Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], IS_WORD)
        every = shingles(words.hashes, k)
        rows = []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= k:
                rows.append(np.unique(every[a : b - k + 1]))
            else:
                rows.append(np.array([sequence_hash(words.hashes[a:b])] if b > a else [], np.uint64))
        yield i, j, rows


def places(shingles_: np.ndarray) -> np.ndarray:
    """A bitmap of a set: the places its shingles fill, of a power of two that is at least ``PLACES`` for each."""
    size = max(64, 1 << (PLACES * len(shingles_) - 1).bit_length()) if len(shingles_) else 64
    at = (shingles_ & np.uint64(size - 1)).astype(np.int64)
    out = np.zeros(size, bool)
    out[at] = True
    return np.packbits(out, bitorder="little")


def missing(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many places only ``a`` fills, and only ``b``; the larger bitmap is folded to the size of the smaller."""
    size = min(len(a), len(b))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (a, b))
    return int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())


def set_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest, places) of each document; equal digests mean equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets in sets_of(batch.column("text")):
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                     pa.array([places(s).tobytes() for s in sets], pa.binary())],
                    ["doc_id", "n", "digest", "places"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, digest binary, places binary")


def _plausible(pairs: DataFrame, rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose bitmaps leave room for the overlap they need. An id with several sets has no bitmap."""
    pairs = materialize(pairs, "open-pairs")
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(heads, "node"), "open-nodes")
    of_head = rows.select(F.col("doc_id").alias("node"), "digest", "places").join(asked, ["node", "digest"])
    single = F.when(F.min("digest") == F.max("digest"), F.first("places"))
    known = materialize(of_head.groupBy("node").agg(single.alias("places")), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.asarray(batch.column(c)).astype(np.int64) for c in ("n_a", "n_b")]
            need = -(-PERCENT * (n[0] + n[1]) // (100 + PERCENT))
            sides = [[None if x.as_py() is None else np.frombuffer(x.as_py(), np.uint8) for x in batch.column(c)] for c in ("x", "y")]
            off = [(0, 0) if x is None or y is None else missing(x, y) for x, y in zip(*sides, strict=True)]
            off = np.array(off, np.int64).reshape(-1, 2)
            keep = pa.array((n[0] - off[:, 0] >= need) & (n[1] - off[:, 1] >= need))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    first = pairs.join(known.select(F.col("node").alias("a"), F.col("places").alias("x")), "a")
    both = first.join(known.select(F.col("node").alias("b"), F.col("places").alias("y")), "b")
    return both.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How many documents hold a shingle of each counter, over all documents."""
    size = 1 << COUNTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, sets in sets_of(batch.column("text")):
                if sets:
                    total += np.bincount((np.concatenate(sets) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["counter", "n"])

    out = np.zeros(size, np.int64)
    for r in docs.select("text").mapInArrow(run, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).collect():
        out[r["counter"]] = r["n"]
    return out


def prefix_length(n: np.ndarray | int) -> np.ndarray | int:
    """How many of its rarest shingles a set of ``n`` must index."""
    return n - (PERCENT * n + 99) // 100 + 1


def needed(a: Column, b: Column) -> Column:
    """The least intersection with which sets of these sizes link."""
    return F.ceil(F.lit(PERCENT) * (a + b) / F.lit(100 + PERCENT))


def _prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(doc_id, digest, n, prefix): the rarest shingles of each set in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets in sets_of(batch.column("text")):
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                rows = []
                for s in sets:
                    order = np.argsort(counts[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], kind="stable")
                    rows.append(s[order[: prefix_length(len(s)) if len(s) else 0]].view(np.int64))
                at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                values = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(values))],
                    ["doc_id", "digest", "n", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, digest binary, n int, prefix array<bigint>")


def _packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, packed): the compressed texts of the wanted documents."""
    bits = bitmap(wanted.select(F.xxhash64("node").alias("h")), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at = marked(bits, np.asarray(batch.column("h")).view(np.uint64))
            texts = batch.column("text").take(pa.array(at))
            packed = [squeeze.compress((t.as_py() or "").encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(at)), pa.array(packed, pa.binary())], ["node", "packed"])

    kept = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), "text", F.xxhash64("doc_id").alias("h"))
    return kept.mapInArrow(run, "node bigint, packed binary").join(wanted, "node", "left_semi")


def verified(docs: DataFrame, pairs: DataFrame, deltas: bool = False) -> DataFrame:
    """(a, b, n_a, n_b, overlap, delta) of each pair (a, b), from the whole texts.

    With ``deltas``, ``delta`` holds the shingles that only one of two linked sets has, as 64-bit numbers.
    """
    pairs = materialize(pairs.select("a", "b"), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = materialize(_packed_texts(docs, wanted), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets: dict[bytes, np.ndarray] = {}
                sides = [part.column(c).to_pylist() for c in ("pa", "pb")]
                packed = list(dict.fromkeys([*sides[0], *sides[1]]))
                texts_ = pa.array([open_.decompress(p) for p in packed], pa.large_binary())
                for i, _, found in sets_of(texts_):
                    sets.update(zip(packed[i : i + len(found)], found, strict=True))
                overlap = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(*sides, strict=True)]
                delta = [
                    np.setxor1d(sets[x], sets[y], assume_unique=True).tobytes() if deltas and _links(len(sets[x]), len(sets[y]), m) else None
                    for x, y, m in zip(*sides, overlap, strict=True)
                ]
                size = [pa.array([len(sets[p]) for p in side], pa.int64()) for side in sides]
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), *size, pa.array(overlap, pa.int64()), pa.array(delta, pa.binary())],
                    ["a", "b", "n_a", "n_b", "overlap", "delta"],
                )

    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("pa")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("pb")), "b")
    schema = "a bigint, b bigint, n_a bigint, n_b bigint, overlap bigint, delta binary"
    return materialize(both.select("a", "b", "pa", "pb").mapInArrow(run, schema), "verified")


def _links(n_a, n_b, overlap):
    """Whether sets link, for columns, arrays and numbers."""
    return 100 * overlap >= PERCENT * (n_a + n_b - overlap)


def links_among(found: DataFrame) -> DataFrame:
    return found.filter(_links(F.col("n_a"), F.col("n_b"), F.col("overlap"))).select("a", "b")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left shares with each on the right."""
    sides = [(np.concatenate([*side, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(side)), [len(x) for x in side])) for side in (left, right)]
    shared = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(shared), AT_ONCE):
        part = shared[at : at + AT_ONCE]
        held = []
        for (values, owner), size in zip(sides, out.shape, strict=True):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[place] == values
            marks = np.zeros((size, len(part)), np.float32)
            marks[owner[hit], place[hit]] = 1
            held.append(marks)
        out += (held[0] @ held[1].T).astype(np.int64)
    return out


def _cell_answers(cell: pa.Table) -> pa.Table:
    """(node, linked): links between the members of a group's blocks ``i`` and ``j``, listed for both ends."""
    block = np.asarray(cell.column("block"))
    one = cell.column("i")[0].as_py() == cell.column("j")[0].as_py()
    left = np.flatnonzero(block == cell.column("i")[0].as_py())
    right = np.flatnonzero(block == cell.column("j")[0].as_py())
    node, n, overlap, hub_n = (np.asarray(cell.column(c)) for c in ("node", "n", "overlap", "hub_n"))
    delta = [np.frombuffer(d, np.uint64) for d in cell.column("delta").to_pylist()]
    both = overlap[left][:, None] + overlap[right][None, :] - hub_n[0] + _common([delta[x] for x in left], [delta[x] for x in right])
    links = _links(n[left][:, None], n[right][None, :], both)
    if one:
        np.fill_diagonal(links, False)
    lists = [(node[a], node[right[row]]) for a, row in zip(left, links, strict=True)]
    if not one:
        lists += [(node[b], node[left[row]]) for b, row in zip(right, links.T, strict=True)]
    lists = [(a, found) for a, found in lists if len(found)]
    return pa.table(
        {"node": pa.array([a for a, _ in lists], pa.int64()), "linked": pa.array([x for _, x in lists], pa.list_(pa.int64()))}
    )


def _group_answers(members: DataFrame, block: int) -> DataFrame:
    """(node, linked): the links between members of the same group, without those to its hub, listed for both ends."""
    sizes = materialize(members.groupBy("hub").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "groups")
    blocks = F.ceil(F.col("k") / block).cast("int")
    placed = members.join(sizes, "hub").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(
        "hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "overlap", "hub_n", "delta"
    )
    return cells.groupBy("hub", "i", "j").applyInArrow(_cell_answers, "node bigint, linked array<bigint>")


def _bounded(m: Column, n_a: Column, n_b: Column) -> Column:
    """Whether sets with ``m`` common prefix shingles can link, from their sizes alone."""
    rest = lambda n: F.ceil(F.lit(PERCENT) * n / F.lit(100)) - 1
    fits = F.lit(PERCENT) * F.greatest(n_a, n_b) <= 100 * F.least(n_a, n_b)
    return fits & (m + F.greatest(rest(n_a), rest(n_b)) >= needed(n_a, n_b))


def _size_class(n: Column) -> Column:
    """Sets that link are in the same or neighbouring classes."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / PERCENT)) + 1e-9).cast("int")


def _block_width(size_class: Column) -> Column:
    """Positions in a block: as far as a common shingle of two linked sets of this class can be displaced."""
    largest = F.pow(F.lit(100.0 / PERCENT), size_class + 1)
    return F.greatest(F.ceil(largest * F.lit(1 - PERCENT / 100)), F.lit(1)).cast("int")


def _skip_join(lists: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): pairs of different groups that may link.

    The index has one block for each shingle, size class and stretch of
    positions; the smaller set of a pair looks only into blocks it can reach. A
    pair that links shares a shingle within the first ``n - needed + 1`` of both
    sets, so sets that are alike but not alike enough mostly do not meet.
    """
    i, j, n_a, n_b = (F.col(c) for c in ("pos_a", "pos_b", "n_a", "n_b"))
    index = lists.select("token", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("group").alias("in_b"))
    index = index.withColumn("class", _size_class(n_b)).withColumn("block", F.floor(j / _block_width(F.col("class"))).cast("int"))
    probe = lists.select("token", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("group").alias("in_a"))
    probe = probe.filter(i <= n_a - needed(n_a, n_a)).withColumn("class", F.explode(F.array(_size_class(n_a), _size_class(n_a) + 1)))
    width = _block_width(F.col("class"))
    low, high = F.floor(F.greatest(i - F.ceil(n_a * (100 - PERCENT) / (100 + PERCENT)) - 1, F.lit(0)) / width), F.floor((i + width + 1) / width)
    probe = probe.withColumn("block", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    reach = F.least(i, j) + 1 + F.least(n_a - i - 1, n_b - j - 1)
    smaller_first = (n_a < n_b) | ((n_a == n_b) & (F.col("a") < F.col("b")))
    need = needed(n_a, n_b)
    close = (F.lit(PERCENT) * n_b <= 100 * n_a) & (reach >= need) & (i <= n_a - need) & (j <= n_b - need)
    joined = probe.join(index, ["token", "class", "block"]).filter(smaller_first & (F.col("in_a") != F.col("in_b")) & close)
    return joined.select("a", "b", "n_a", "n_b").distinct()


def _found(docs: DataFrame, every: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Rows with their sets, the heads of classes, the verified pairs with hubs and without, and the members of hubs.

    Members are given if ``every`` link is asked for; the pairs then lack only those inside a group.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = materialize(set_rows(docs), "sets")
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("node")).filter("node IS NOT NULL")
    heads = materialize(classes, "classes")

    prefixes = _prefixes(docs, shingle_counts(docs))
    standing = prefixes.join(heads.select(F.col("node").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    postings = standing.select(F.col("doc_id").alias("node"), "n", F.posexplode("prefix").alias("pos", "token"))
    held = postings.groupBy("token").agg(F.min(F.struct("node", (-F.col("n")).alias("n"))).alias("h"), F.max("node").alias("top"))
    hubs = held.filter("h.node <> top").select("token", F.col("h.node").alias("hub"), (-F.col("h.n")).alias("hub_n"))
    lists = materialize(postings.join(hubs, "token"), "lists")

    # each set against the hub it has most in common with; a hub brings its size, so that no join gathers its members
    common = lists.filter("node <> hub").groupBy("node", "hub", "n", "hub_n").agg(F.count(F.lit(1)).alias("m"))
    with_hub = common.filter(_bounded(F.col("m"), F.col("n"), F.col("hub_n")))
    best = with_hub.groupBy("node").agg(F.max_by("hub", F.struct("m", -F.col("hub"))).alias("hub"))
    answers = verified(docs, best.select(F.col("node").alias("a"), F.col("hub").alias("b")), deltas=every)
    members = None
    if every:
        # an id with several sets has several answers to a hub, and is in no group
        several = rows.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y").select("doc_id")
        several = materialize(several, "several")
        members = answers.filter("delta IS NOT NULL").select(
            F.col("b").alias("hub"), F.col("a").alias("node"), F.col("n_a").alias("n"), F.col("n_b").alias("hub_n"), "overlap", "delta"
        )
        for end in ("hub", "node"):
            members = members.join(several.select(F.col("doc_id").alias(end)), end, "left_anti")
        members = materialize(members.dropDuplicates(["node"]), "members")
        first = members.select("node", F.col("hub").alias("group"))
    else:
        first = components(links_among(answers)).withColumnRenamed("component", "group")

    # only lists with sets of several groups are joined
    placed = lists.select("token", "node", "n", "pos").join(first, "node", "left")
    placed = materialize(placed.withColumn("group", F.coalesce("group", "node")), "placed")
    mixed = placed.groupBy("token").agg(F.min("group").alias("x"), F.max("group").alias("y")).filter("x <> y").select("token")
    pairs = _skip_join(placed.join(mixed, "token", "left_semi"))
    # a hub's known overlaps: |a & b| <= |b & hub| + |a| - |a & hub|
    to_hub = answers.select(F.col("a").alias("x"), F.col("b").alias("hub"), "overlap")
    of_a = to_hub.select(F.col("x").alias("a"), F.col("hub").alias("hub_a"), F.col("overlap").alias("o_a"))
    of_b = to_hub.select(F.col("x").alias("b"), F.col("hub").alias("hub_b"), F.col("overlap").alias("o_b"))
    known = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    cap = F.least(F.col("o_b") + F.col("n_a") - F.col("o_a"), F.col("o_a") + F.col("n_b") - F.col("o_b"))
    settled = (F.col("hub_a") == F.col("hub_b")) & (cap < needed(F.col("n_a"), F.col("n_b")))
    direct = F.coalesce(F.col("hub_a") == F.col("b"), F.lit(False)) | F.coalesce(F.col("hub_b") == F.col("a"), F.lit(False))
    open_pairs = known.filter(~F.coalesce(settled, F.lit(False)) & ~direct).select("a", "b", "n_a", "n_b")
    return rows, heads, answers, verified(docs, _plausible(open_pairs, rows, heads)), members


def _documents(rows: DataFrame, heads: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with the head of their class and its component."""
    of_class = heads.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = rows.join(of_class, "digest", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "node")


def similar_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    rows, heads, answers, more, _ = _found(docs, every=False)
    return _documents(rows, heads, links_among(answers).union(links_among(more))).drop("node")


def _once(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _listed(links: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """(node, linked): links as pairs and those inside groups, listed for both ends."""
    one = links.select(F.col("a").alias("node"), F.array("b").alias("linked"))
    other = links.select(F.col("b").alias("node"), F.array("a").alias("linked"))
    return _group_answers(members, block).union(one).union(other)


def similar_links(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, linked): all links between different sets, each listed for both ends.

    A set is named by its smallest doc_id. Its answers are spread over several
    rows, so that no row grows with a group; no link is listed twice.
    """
    _, _, answers, more, members = _found(docs, every=True)
    return _listed(_once(links_among(answers.union(more))), members, block)


def similar_answers(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The columns of ``similar_groups`` and n_links: how many other sets the document's set links with."""
    rows, heads, answers, more, members = _found(docs, every=True)
    links = materialize(_once(links_among(answers.union(more))), "pairs-linked")
    counts = _listed(links, members, block).groupBy("node").agg(F.sum(F.size("linked")).alias("n_links"))
    found = _documents(rows, heads, links).join(counts, "node", "left")
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
