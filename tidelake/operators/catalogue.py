"""The source catalogue: listing, flags, search and value remaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.operators.sets import union_distinct
from tidelake.session import materialize


BROADCAST_ROWS = 100_000


def table_catalogue(tables: DataFrame, views: DataFrame) -> DataFrame:
    """Tables and views in one list of db, table_name and type, duplicates removed."""
    return union_distinct(
        tables.select("db", "table_name").withColumn("type", F.lit("Table")),
        views.select("db", "table_name").withColumn("type", F.lit("View")),
    )


def owner_counts(catalogue: DataFrame) -> DataFrame:
    """Each owner's number of tables."""
    return catalogue.groupBy("db").agg(F.count(F.lit(1)).alias("num_tables"))


def tables_per_owner(catalogue: DataFrame) -> DataFrame:
    """The catalogue with the owner's number of tables.

    The counts are written first: Spark can split a large owner's rows in a
    join, but not while an aggregate stands between shuffle and join.
    """
    return catalogue.join(materialize(owner_counts(catalogue), "owner-counts"), "db")


def ordered_catalogue(catalogue: DataFrame) -> DataFrame:
    """Owners with most tables first, then by owner and table name."""
    return tables_per_owner(catalogue).orderBy(F.desc("num_tables"), "db", "table_name")


def catalogue_flags(tables: DataFrame, rows_per_split: int = 1_000_000, rows_per_job: int | None = None) -> DataFrame:
    """Split flags from the stored row count, and whether the name looks temporary.

    This is the catalogue's quick rule, ``NUM_ROWS > limit``; the analysis of
    one table uses ``floor(N / limit) > 1`` (see ``profile.split_required``).
    """
    rows_per_job = rows_per_job or 100 * rows_per_split
    return tables.select(
        "*",
        (F.col("NUM_ROWS") > rows_per_split).alias("is_split_required"),
        (F.col("NUM_ROWS") > rows_per_job).alias("is_job_split_required"),
        F.lower("TABLE_NAME").rlike("tmp|temp").alias("is_temp"),
    )


def catalogue_search(catalogue: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Find tables for each search term, case-blind.

    Per term the first class with a hit counts: 1 one table of that name,
    2 the owner of that name, 3 one table whose name contains it, 4 owners
    whose name contains it. Terms are matched inside the catalogue scan.
    """
    name, owner = F.lower("table_name"), F.lower("db")
    listed = F.array(*[F.lit(t.lower()) for t in terms])

    def classes(t):
        return F.array_compact(
            F.array(
                F.when(name == t, 1), F.when(owner == t, 2),
                F.when(name.contains(t), 3), F.when(owner.contains(t), 4),
            )
        )

    hits = F.filter(
        F.transform(listed, lambda t: F.struct(t.alias("term"), classes(t).alias("classes"))),
        lambda h: F.size(h["classes"]) > 0,
    )
    matched = catalogue.select("db", "table_name", F.explode(hits).alias("h")).select(
        F.col("h.term").alias("term"), "db", "table_name", F.explode("h.classes").alias("match_class")
    )
    # class sizes first, a few rows for each term; then the scan again, for the chosen classes only
    sizes = matched.groupBy("term", "match_class").agg(F.count(F.lit(1)).alias("n"))
    chosen = (
        sizes.filter(F.col("match_class").isin(2, 4) | (F.col("n") == 1))
        .groupBy("term")
        .agg(F.min("match_class").alias("match_class"))
    )
    chosen = materialize(chosen, "chosen-classes")
    return matched.join(chosen, ["term", "match_class"]).select("term", "match_class", "db", "table_name")


def remap_shares(
    df: DataFrame, mapping: DataFrame, columns: Sequence[str], broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Per column, the share of values that the map knows.

    A map of up to ``broadcast_rows`` names is broadcast and no value is
    shuffled. Beyond that values are counted before the join, so a frequent
    value costs one row.
    """
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.upper(F.col(c).cast("string")).alias("v")) for c in columns])
    )
    values = df.select(cells.alias("c")).select("c.*")
    known = mapping.select(F.upper("search").alias("v")).distinct().withColumn("known", F.lit(1))
    if known.limit(broadcast_rows + 1).count() <= broadcast_rows:
        weighted, known = values.withColumn("n", F.lit(1)), F.broadcast(known)
    else:
        weighted = values.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    return (
        weighted.join(known, "v", "left")
        .groupBy("column_name")
        .agg((F.sum(F.coalesce("known", F.lit(0)) * F.col("n")) / F.sum("n")).alias("share"))
    )


def majority_remap(
    df: DataFrame, mapping: DataFrame, columns: Sequence[str] | None = None, required: str | None = None
) -> DataFrame:
    """Replace the values of every column the map knows by majority.

    A column with more than half of its upper-cased values among the map's
    ``search`` values takes the ``replace`` values, unknown ones NULL; other
    text columns come out upper-cased. Of replacements for names that differ in
    case only the smallest counts. Rows without ``required`` are dropped.
    """
    columns = list(columns or [f.name for f in df.schema if f.dataType.simpleString() == "string"])
    shares = remap_shares(df, mapping, columns).filter("share > 0.5").select("column_name").collect()
    chosen = {r["column_name"] for r in shares}
    out = df
    keys = mapping.groupBy(F.upper("search").alias("__search")).agg(F.min("replace").alias("__replace"))
    keys = materialize(keys, "remap") if chosen else keys
    for c in columns:
        if c in chosen:
            out = (
                out.join(keys, F.upper(F.col(c)) == F.col("__search"), "left")
                .withColumn(c, F.col("__replace"))
                .drop("__search", "__replace")
            )
        else:
            out = out.withColumn(c, F.upper(c))
    return out.filter(F.col(required).isNotNull()) if required else out
