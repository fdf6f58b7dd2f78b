"""Catalogue search through the letter runs of all names.

Terms that are a whole name are found by equality and settled. For the others,
every distinct table and owner name is cut into its runs of the lengths that
are still asked for, and a term is looked up as the run it is. The counts of a
run tell whether a single row bears it, so no list of candidates is made or
tested: work follows the letters of the names and the number of terms, not
their product. Results are those of testing every term on every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.session import materialize, settled

_OWNER, _TABLE = "owner", "table"
#: Letters by which runs that no term begins with are left out.
_HEAD = 3


def name_index(catalogue: DataFrame) -> DataFrame:
    """(kind, text, n, id): each distinct name, lower-cased, with the catalogue rows that bear it. Written once."""
    names = F.array(F.struct(F.lit(_TABLE).alias("kind"), F.lower("table_name").alias("text")), F.struct(F.lit(_OWNER).alias("kind"), F.lower("db").alias("text")))
    each = catalogue.select(F.explode(names).alias("x")).select("x.*").filter("text IS NOT NULL")
    counted = each.groupBy("kind", "text").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counted.withColumn("id", F.monotonically_increasing_id()), "name-index")


def runs_of(names: DataFrame, terms: DataFrame) -> DataFrame:
    """(gram, text, n, id): each name under its distinct runs that have the length, and begin with the letters, of some term."""
    sizes = terms.agg(F.collect_set(F.length("term"))).first()[0]
    heads, few = settled(terms.select(F.length("term").alias("size"), F.substring("term", 1, _HEAD).alias("head")).distinct(), "term-heads")
    sized = names.select("text", "n", "id", F.explode(F.array(*[F.lit(k) for k in sizes]).cast("array<int>")).alias("size"))
    placed = sized.filter(F.col("size") <= F.length("text")).select("*", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("size") + 1)).alias("at"))
    if few:
        placed = placed.withColumn("head", F.expr(f"substring(text, at, least(size, {_HEAD}))")).join(F.broadcast(heads), ["size", "head"], "left_semi")
    grams = placed.select(F.expr("substring(text, at, size)").alias("gram"), "at", "text", "n", "id")
    return grams.filter(F.expr("instr(text, gram) = at")).drop("at")  # a run that comes again in its name counts once


def catalogue_search_indexed(catalogue: DataFrame, terms: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """As ``catalogue_search``, for terms given as rows (column ``term``); equal and NULL terms count once and not at all."""
    index = name_index(catalogue) if index is None else index
    tables, owners = (index.filter(F.col("kind") == k).drop("kind") for k in (_TABLE, _OWNER))
    wanted = terms.select(F.lower("term").alias("term")).filter("term IS NOT NULL").distinct()
    same = lambda names, n: names.select(F.col("text").alias("term"), F.col("n").alias(n))
    wanted = wanted.join(same(tables, "named"), "term", "left").join(same(owners, "owned"), "term", "left")
    wanted = materialize(wanted.withColumn("match_class", F.when(F.col("named") == 1, 1).when(F.col("owned").isNotNull(), 2)), "terms")
    whole = wanted.filter("match_class IS NOT NULL").select("term", "match_class", F.col("term").alias("text"))
    # what several rows bear as their whole name is inside more than one, too
    inside = wanted.filter("match_class IS NULL AND named IS NULL").select("term")
    asked = inside.select(F.col("term").alias("gram"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("id"), F.lit(True).alias("asked"))
    listed = runs_of(tables, inside).select("gram", "n", "id", F.lit(False).alias("asked")).union(asked)
    counted = listed.groupBy("gram").agg(F.sum("n").alias("n"), F.max("id").alias("id"), F.max("asked").alias("asked"))
    single = materialize(counted.filter("asked AND n = 1").select(F.col("gram").alias("term"), "id"), "single-hits")
    third = single.join(tables, "id").select("term", F.lit(3).alias("match_class"), "text")
    left = materialize(wanted.filter("match_class IS NULL").select("term").join(single, "term", "left_anti"), "open-terms")
    fourth = left.join(runs_of(owners, left).select(F.col("gram").alias("term"), "text"), "term").select("term", F.lit(4).alias("match_class"), "text")
    chosen = materialize(whole.union(third).union(fourth), "chosen-names")

    def rows(classes: tuple[int, int], column: str) -> DataFrame:
        named = chosen.filter(F.col("match_class").isin(*classes))
        return catalogue.join(named, F.lower(column) == F.col("text")).select("term", "match_class", "db", "table_name")

    return rows((1, 3), "table_name").unionByName(rows((2, 4), "db"))
