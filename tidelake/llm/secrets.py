"""Secret scans with multipart credential linking, in DataFrame functions only.

Base matches stand on their own: assignments to a secret's name, access key
ids, long hex strings. Weak parts are reported only together with what
completes them: an identifier needs a secret near it, a secret-like string an
identifier or an endpoint, an endpoint a secret or an identifier. Parts are
intervals of a text, and the scope, a paragraph, is as far as they reach. A
complement that does not overlap a part ends before it or starts after it, so
the least end and the largest start of each kind in a scope tell whether there
is one. Parts that overlap base parts are found by an interval join: both sides
are put into cells of ``CELL`` code points, so a join key never holds more parts
than a cell has room for.

Spans are in code points, end exclusive, and cover the whole match. They come
from the lengths of the pieces between matches, summed along each text.

Defined cases: a null text is empty; rows are told apart by a number of their
own, so repeated documents each get their result; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.session import materialize

#: Kinds of spans in the order in which equal starts are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE = KINDS[:3]
CELL = 200
#: Pattern, the group whose length counts, the least length, and what that group must hold.
#: Letters outside classes match in either case where a pattern starts with (?i).
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ""),
    "access": (r"AKIA[A-Z0-9]+", 0, 16, ""),
    "hex": (r"[0-9a-f]{32,}", 0, 32, ""),
    "identifier": (r"""(?i)(username|user|login|client_id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3, ""),
    "secret": (r"[A-Za-z0-9+/_]{20,}", 0, 20, "[0-9]"),
    "endpoint": (r"(?i)(https?|jdbc:[a-z0-9]+|postgres|mysql|redis|mongodb|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", 0, 10, ""),
}
#: Weak kinds, and the kinds one of which must be near.
NEEDS = {
    "identifier": ("assign", "hex", "secret"),
    "secret": ("access", "identifier", "endpoint"),
    "endpoint": ("assign", "access", "hex", "identifier"),
}
_PIECE = "array<struct<kind:int,place:int,gap:int,breaks:int,own:int,n:int>>"


def _number(kind: str) -> int:
    return KINDS.index(kind)


def _pieces(text: Column, kind: str) -> Column:
    """All matches of a kind, leftmost and non-overlapping, each with the length of what lies before it."""
    pattern, group, _, holds = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    n = lambda v: F.when(F.regexp_like(v, F.lit(holds)), F.length(v)).otherwise(0) if holds else F.length(v)
    rows = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("own"), value.alias("value"))
    made = F.transform(rows, lambda r, i: F.struct(
        F.lit(_number(kind)).alias("kind"), i.alias("place"), F.length(r["gap"]).alias("gap"),
        (F.size(F.split(r["gap"], "\n\n", -1)) - 1).alias("breaks"), F.length(r["own"]).alias("own"), n(r["value"]).alias("n"),
    ))
    return F.when(F.regexp_like(text, F.lit(pattern)), made).otherwise(F.array().cast(_PIECE))


def find_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents as (row, doc_id), and all base and weak parts as (row, start, end, kind, scope).

    The scope of a part is the number of blank lines before it. Texts are read once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = F.flatten(F.array(*[_pieces(text, k) for k in KINDS])).cast(_PIECE)
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", pieces.alias("pieces")), "pieces")
    along = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    each = rows.select("row", F.explode("pieces").alias("p")).select("row", "p.*")
    end = F.sum(F.col("gap") + F.col("own")).over(along)
    least = F.element_at(F.array(*[F.lit(PATTERNS[k][2]) for k in KINDS]), F.col("kind") + 1)
    parts = each.select(
        "row", "kind", "n", (end - F.col("own")).alias("start"), end.alias("end"), F.sum("breaks").over(along).alias("scope")
    ).filter(F.col("n") >= least)
    return rows.select("row", "doc_id"), parts.drop("n")


def linked_weak(parts: DataFrame, cell: int = CELL) -> DataFrame:
    """Weak parts with a complement in their scope: row, start, end, kind.

    Overlapping parts do not complete each other, and a weak part that overlaps
    a base part is not reported again. A scope is part of one text.
    """
    scope = Window.partitionBy("row", "scope")
    completes = F.lit(False)
    for kind, needed in NEEDS.items():
        other = F.col("kind").isin(*[_number(k) for k in needed])
        before = F.min(F.when(other, F.col("end"))).over(scope) <= F.col("start")
        after = F.max(F.when(other, F.col("start"))).over(scope) >= F.col("end")
        completes = completes | ((F.col("kind") == _number(kind)) & (F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))))
    near = materialize(parts.withColumn("completed", completes).filter("completed").select("row", "start", "end", "kind").distinct(), "completed")

    place = lambda c: F.floor(c / cell)
    covers = near.withColumn("cell", F.explode(F.sequence(place(F.col("start")), place(F.col("end") - 1)))).alias("w")
    base = parts.filter(F.col("kind") < len(BASE)).select(
        "row", F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        F.explode(F.sequence(place(F.col("start")), place(F.col("end") - 1))).alias("cell"),
    ).alias("o")
    meets = (F.col("w.row") == F.col("o.row")) & (F.col("w.cell") == F.col("o.cell")) & (F.col("o_start") < F.col("end")) & (F.col("start") < F.col("o_end"))
    hidden = covers.join(base, meets, "left_semi").select("row", "start", "end", "kind").distinct()
    return near.join(hidden, ["row", "start", "end", "kind"], "left_anti")


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and ``spans`` (start, kind number, end; see ``KINDS``), sorted.

    Base spans always stay; weak ones only when completed.
    """
    rows, parts = find_parts(docs)
    parts = materialize(parts, "parts")
    spans = parts.filter(F.col("kind") < len(BASE)).select("row", "start", "end", "kind").union(linked_weak(parts))
    lists = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.join(lists, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping or touching spans replaced by a mark."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def merge(state: Column, s: Column) -> Column:
        last = F.element_at(state, -1)
        joins = (F.size(state) > 0) & (F.try_element_at(state, F.lit(-1))["end"] >= s["start"])
        one = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))
        wider = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        return F.when(joins, F.concat(F.slice(state, F.lit(1), F.size(state) - 1), wider)).otherwise(F.concat(state, one))

    runs = F.aggregate(spans, none, merge)
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(runs, lambda r: r["end"]))
    ends = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.length(text).cast("bigint")))
    kept = F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(kept, mark))
