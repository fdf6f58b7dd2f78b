"""The typed gold layer: rebuild, distinct by row budget, promotion."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.predicates import compare, landed_day, landed_second
from tidelake.operators.joins import filter_by_keys, key_set, null_safe_join
from tidelake.operators.ordered import cuts_below, running_total
from tidelake.operators.reports import compute_stats
from tidelake.operators.schema import align, cast_columns, cast_failures
from tidelake.plans.incremental import newest_in
from tidelake.session import materialize
from tidelake.sources.sinks import create_gold, insert_append, insert_overwrite, table_location

ROWS_PER_GROUP = 100_000_000
#: Landing rows that one task makes distinct.
ROWS_PER_TASK = 500_000
#: Tasks up to which a shuffle writes rows as they come; for more, it holds those of a whole file split and sorts them.
UNSORTED_TASKS = 200
#: Slots of a day, and the day number of rows without one.
SLOTS, _NO_DAY = 4096, -10_000_000
#: Cells that a bucket is packed from, at least, where slots allow.
CELLS_PER_BUCKET = 16


def gold_schema(types: Mapping[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in types.items()))


def rebuild(landing: DataFrame, types: Mapping[str, str], table: str, path: str) -> DataFrame:
    """Create the gold table anew from the typed, distinct rows of landing."""
    create_gold(landing.sparkSession, table, gold_schema(types), path)
    insert_overwrite(cast_columns(landing, types).dropDuplicates(), table)
    return landing.sparkSession.table(table)


def sequential_distinct(
    landing: DataFrame,
    types: Mapping[str, str],
    table: str,
    path: str,
    split_column: str,
    landed: bool = True,
    budget: int = ROWS_PER_GROUP,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """As ``rebuild``, but gold lies in buckets of about ``budget`` landing rows, in the order of their days, one file each.

    A row's slot is its parsed day and a hash of the row, so equal rows share
    one; rows without a readable day come first. Cells are whole days, or runs
    of slots of the days that are more than a sixteenth of a bucket, so their
    number follows days and buckets, not rows. They are counted, packed into
    buckets along their order, and rows go to their bucket in a single shuffle,
    after which the distinct of a bucket needs no other. Buckets of more than
    ``rows_per_task`` rows would not fit a task's memory: their rows are made
    distinct before, by slots in tasks of about that many rows (see
    ``distinct_tasks``), and the bucket's task only writes them as they come. A day above the budget spans
    several buckets. A cell that is above it by itself holds copies; its rows
    are made distinct before, where copies merge ahead of the shuffle. The
    table changes in one insert.
    """
    spark = landing.sparkSession
    distinct = distinct_by_bucket(landing, types, split_column, landed, budget, rows_per_task)
    create_gold(spark, table, gold_schema(types), path)
    insert_overwrite(distinct, table)
    return spark.table(table)


def distinct_by_bucket(
    landing: DataFrame,
    types: Mapping[str, str],
    split_column: str,
    landed: bool = True,
    budget: int = ROWS_PER_GROUP,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The typed, distinct rows of landing, a partition per bucket of days (see ``sequential_distinct``)."""
    day = landed_day(split_column) if landed else F.col(split_column).cast("date")
    typed = landing.withColumn("_day", day).select("_day", *[F.col(c).try_cast(t).alias(c) for c, t in types.items()])
    slot = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in types]), F.lit(SLOTS))
    cell = (F.coalesce(F.unix_date("_day").cast("bigint"), F.lit(_NO_DAY)) * SLOTS + slot).alias("_cell")
    placed = typed.select(cell, *[F.col(f"`{c}`") for c in types])
    by_day = materialize(placed.groupBy(_unit()).agg(F.count(F.lit(1)).alias("_cnt")), "day-counts")
    counts = _cell_counts(placed, by_day, budget)
    slots = F.explode(F.sequence("_cell", F.col("_cell") + F.col("_step") - 1))
    hot = materialize(counts.filter(F.col("_cnt") > budget).select(slots.alias("_cell")), "hot-cells")
    if not hot.isEmpty():
        copies = placed.join(hot, "_cell", "left_semi").dropDuplicates()
        placed = placed.join(hot, "_cell", "left_anti").unionByName(copies)
        counts = _cell_counts(placed, by_day, budget)
    upto = running_total(counts, "_cell", {"_upto": "_cnt"})
    packed = materialize(upto.select("_cell", "_upto", F.floor((F.col("_upto") - 1) / budget).cast("bigint").alias("_bucket")), "buckets")
    # per day, which is all a row needs to look up: the first slot of each of its buckets
    starts = packed.groupBy(_unit(), "_bucket").agg(F.min("_cell").alias("_from"))
    days = materialize(starts.groupBy("_unit").agg(F.array_sort(F.collect_list("_from")).alias("_from"), F.min("_bucket").alias("_first")), "days")
    last, total = packed.agg(F.max("_bucket"), F.max("_upto")).first()
    buckets = 1 + (last or 0)
    large = min(budget, total or 0) > rows_per_task
    if large:
        placed = placed.repartition(distinct_tasks(total, rows_per_task), "_cell").dropDuplicates()
    found = placed.withColumn("_unit", _unit()).join(days, "_unit")
    bucket = (F.col("_first") + cuts_below(F.col("_from"), F.col("_cell"), inclusive=True) - 1).cast("int")
    rows = found.select(bucket.alias("_bucket"), *[F.col(f"`{c}`") for c in types])
    dealt = rows.repartitionById(buckets, "_bucket")
    return (dealt if large else dealt.dropDuplicates()).drop("_bucket")


def distinct_tasks(rows: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """How many tasks make ``rows`` distinct: each takes up to four times its rows before they are more than ``UNSORTED_TASKS``."""
    tasks = -(-rows // rows_per_task)
    return tasks if tasks <= UNSORTED_TASKS else max(UNSORTED_TASKS, -(-tasks // 4))


def _unit() -> Column:
    """The day number of a row or cell."""
    return F.floor(F.col("_cell") / SLOTS).alias("_unit")


def _cell_counts(placed: DataFrame, by_day: DataFrame, budget: int) -> DataFrame:
    """Rows of each cell, named by its first slot, and how many slots it has.

    Days of up to a cell's share of ``budget`` are one cell and have been
    counted; only the rows of larger days are read again. A day is cut into as
    many equal runs of slots as its rows in ``by_day`` ask for.
    """
    runs = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("_cnt") * CELLS_PER_BUCKET / F.lit(float(budget)), F.lit(1.0)))))
    days = by_day.withColumn("_step", (SLOTS / F.least(runs, F.lit(float(SLOTS)))).cast("bigint"))
    whole = days.filter(F.col("_step") == SLOTS).select((F.col("_unit") * SLOTS).alias("_cell"), "_step", "_cnt")
    cut = days.filter(F.col("_step") < SLOTS).select("_unit", "_step")
    found = placed.select("_cell", _unit()).join(cut, "_unit")
    first = F.col("_cell") - F.pmod("_cell", "_step")
    return materialize(whole.unionByName(found.groupBy(first.alias("_cell"), "_step").agg(F.count(F.lit(1)).alias("_cnt"))), "cells")


def new_since(
    landing: DataFrame, gold: DataFrame, landing_key: str, gold_key: str, landed: bool = True, timed: bool = False
) -> DataFrame:
    """Landing rows after gold's newest day, or second if ``timed``; all rows when gold is empty.

    Keys landed as text are compared by what they parse to, padded or not. Rows
    whose key cannot be read come in by a rebuild only. The year, which leads
    the text in any form, is compared as text besides, so that scans can skip.
    """
    newest = gold.agg(F.max(F.col(gold_key).cast("timestamp_ntz" if timed else "date"))).first()[0]
    return landed_after(landing, landing_key, newest, landed, timed)


def landed_after(landing: DataFrame, landing_key: str, newest, landed: bool = True, timed: bool = False) -> DataFrame:
    """As ``new_since``, for a watermark that is known."""
    if newest is None:
        return landing
    if not landed:
        return landing.filter(compare(landing_key, newest, ">"))
    parsed = landed_second(landing_key) if timed else landed_day(landing_key)
    top = F.lit(str(newest.replace(microsecond=0))).cast("timestamp_ntz") if timed else F.lit(newest)
    return landing.filter((F.col(landing_key) >= f"{newest.year:04d}") & (parsed > top))


def new_partitions(landing: DataFrame, gold: DataFrame, landing_key: str, gold_key: str) -> DataFrame:
    """Landing rows whose partition gold does not have.

    Whole keys are compared as gold's type, dates and times by day. NULL, also
    from text that cannot be read, is a partition of its own.
    """
    kind = gold.schema[gold_key].dataType
    mine, theirs = F.col(landing_key).try_cast(kind), F.col(gold_key)
    if kind.typeName() in ("date", "timestamp", "timestamp_ntz"):
        text = landing.schema[landing_key].dataType.typeName() == "string"
        mine = landed_day(landing_key) if text else F.col(landing_key).cast("date")
        theirs = theirs.cast("date")
    have = key_set(gold.select(theirs.alias("_key")), ["_key"])
    new = materialize(null_safe_join(key_set(landing.select(mine.alias("_key")), ["_key"]), have, ["_key"], "left_anti"), "new-keys")
    return null_safe_join(landing.withColumn("_key", mine), new, ["_key"], "left_semi").drop("_key")


def prefix_in(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, length: int) -> DataFrame:
    """Rows whose key agrees in its first ``length`` characters with a wanted key."""
    cut = wanted.select(F.substring(F.col(wanted_key).cast("string"), 1, length).alias("k"))
    return filter_by_keys(df, F.substring(F.col(key).cast("string"), 1, length), cut, "k")


class Promoted(NamedTuple):
    """How a promotion ended, and how many values of each column could not be read."""

    status: str
    failures: dict[str, int]


def _failures(rows: DataFrame, types: Mapping[str, str]) -> dict[str, int]:
    present = {c: t for c, t in types.items() if c.upper() in {x.upper() for x in rows.columns}}
    return {r["column_name"]: r["failed"] for r in cast_failures(rows, present).collect() if r["failed"]}


def append_new(rows: DataFrame, table: str, fill_null: bool = False, allowed_fraction: float = 0.5) -> None:
    """Align new landing rows with the gold table and add them, each once, as a rebuild would."""
    schema = rows.sparkSession.table(table).schema
    insert_append(align(rows, schema, fill_null, allowed_fraction).dropDuplicates(), table)


def promote(
    spark: SparkSession,
    landing: DataFrame,
    table: str,
    path: str,
    types: Mapping[str, str],
    style: str,
    landing_key: str,
    gold_key: str | None = None,
    landed: bool = True,
    timed: bool = False,
    fill_null: bool = False,
    stats: bool = False,
) -> Promoted:
    """Bring landing into gold: full conversion at first, then only what is new, by day or by second if ``timed``.

    Rows are distinct after either step. ``stats`` computes the table's
    statistics after a change, a pass over it. The status is ``CREATED``,
    ``APPENDED``, ``UP_TO_DATE`` or ``UNKNOWN_STYLE``.
    """
    if not spark.catalog.tableExists(table):
        rebuild(landing, types, table, path)
        if stats:
            compute_stats(spark, table)
        return Promoted("CREATED", _failures(landing, types))
    gold = spark.table(table)
    gold_key = gold_key or landing_key
    if style == "INCREMENTAL":
        # gold has one writer, so footers need no confirmation
        newest = newest_in(spark, table_location(spark, table), gold_key, timed, confirm=False)
        rows = landed_after(landing, landing_key, newest, landed, timed)
    elif style == "PARTITION_UPDATE":
        rows = new_partitions(landing, gold, landing_key, gold_key)
    else:
        return Promoted("UNKNOWN_STYLE", {})
    if rows.isEmpty():
        return Promoted("UP_TO_DATE", {})
    failures = _failures(rows, types)
    append_new(rows, table, fill_null)
    if stats:
        compute_stats(spark, table)
    return Promoted("APPENDED", failures)
