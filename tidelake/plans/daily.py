"""The daily update: find new dates, guard, load their slices, verify, record."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.predicates import compare
from tidelake.operators.ordered import gap_groups, gap_ranges
from tidelake.plans import incremental as I
from tidelake.plans import slicing as S
from tidelake.session import materialize
from tidelake.sources import days as D
from tidelake.sources.sinks import land_append


def rows_in(source: DataFrame, slices: Sequence[S.Slice]) -> DataFrame:
    """Source rows in any of the slices, as one typed filter."""
    return source.filter(reduce(lambda a, b: a | b, [s.column() for s in slices]))


def daily_update(
    spark: SparkSession,
    source: DataFrame,
    lake_path: str,
    ledger_path: str,
    day: str,
    lake_day: Column | None = None,
    read: Callable[[Sequence[S.Slice]], DataFrame] | None = None,
    max_dates: int = I.MAX_NEW_DATES,
    gap: int = 6,
    days_per_slice: int = 10,
) -> Row:
    """Load the days the lake lacks and return one row: status, reason, dates, done, not_done.

    New days are the source's, without the newest, that neither lake nor
    ledger holds. They are grouped by gaps and cut into slices; ``read`` gives
    the rows of slices, by default a filter on ``source``. The ledger marks
    days as incoming before the load and as landed or missed after the check.
    A run that dies in between leaves its days as incoming, and the next run
    stops for someone to look.
    """
    there = spark.read.parquet(lake_path)
    of_lake = lake_day if lake_day is not None else F.col(day).cast("date")

    def landed(new: DataFrame) -> DataFrame:
        # only files that may hold a new day are read again: the range prunes typed days, and row groups of them
        after = spark.read.parquet(lake_path)
        low, high = new.agg(F.min("day"), F.max("day")).first()
        if lake_day is None:
            after = after.filter(compare(day, low, ">=") & compare(day, high, "<="))
        return after.select(of_lake.alias("day"))

    ledger = materialize(I.read_ledger(spark, ledger_path), "ledger")
    lake_days = materialize(there.select(of_lake.alias("day")).distinct(), "lake-days")
    return _update(
        spark, source, ledger, ledger_path, lake_days, day, lambda rows: land_append(rows, lake_path), landed,
        read, max_dates, gap, days_per_slice,
    )


def daily_update_by_days(
    spark: SparkSession,
    source: DataFrame,
    lake_path: str,
    ledger_path: str,
    day: str,
    read: Callable[[Sequence[S.Slice]], DataFrame] | None = None,
    max_dates: int = I.MAX_NEW_DATES,
    gap: int = 6,
    days_per_slice: int = 10,
    resume: bool = False,
) -> Row:
    """As ``daily_update``, for a lake with a partition per day (``days.land_days``).

    Which days the lake has, before and after the load, comes from its listing
    and manifest, so no row of the lake is read. A day left torn by a run that
    died counts as missing. ``resume`` goes on where such a run stopped
    instead of stopping for someone to look: days that are incoming and whole
    are entered as landed, the others are loaded again, each as a whole.
    """
    ledger = materialize(I.read_ledger(spark, ledger_path), "ledger")
    whole = materialize(D.whole_days(spark, lake_path), "whole-days")
    if resume:
        left = ledger.filter("state = 'incoming'").select("key_date")
        arrived = F.when(F.col("day").isNotNull(), "landed").otherwise("missed")
        settled = materialize(left.join(whole, left["key_date"] == whole["day"], "left").select("key_date", arrived.alias("state")), "settled")
        if not settled.isEmpty():
            I.update_ledger(spark, ledger_path, settled)
            ledger = materialize(I.read_ledger(spark, ledger_path), "ledger")
    return _update(
        spark, source, ledger, ledger_path, whole, day, lambda rows: D.land_days(rows, lake_path, F.col(day)),
        lambda new: D.whole_days(spark, lake_path), read, max_dates, gap, days_per_slice,
    )


def _update(
    spark: SparkSession, source: DataFrame, ledger: DataFrame, ledger_path: str, lake_days: DataFrame, day: str,
    land: Callable[[DataFrame], object], landed: Callable[[DataFrame], DataFrame],
    read: Callable[[Sequence[S.Slice]], DataFrame] | None, max_dates: int, gap: int, days_per_slice: int,
) -> Row:
    """Find new days, guard, load their slices by ``land`` and check them against the days ``landed`` gives."""
    tracked = ledger.filter("state = 'landed'").select(F.col("key_date").alias("day"))
    incoming = ledger.filter("state = 'incoming'").select(F.col("key_date").alias("day"))
    new = materialize(
        I.new_ledger_dates(source.select(F.col(day).cast("date").alias("day")), lake_days, tracked, "day"), "new-days"
    )
    guard = I.ledger_guards(lake_days, tracked, incoming, new, "day", max_dates).first()
    if guard["status"] == "STOP" or guard["new_dates"] == 0:
        return Row(status=guard["status"], reason=guard["reason"], dates=guard["new_dates"], done=0, not_done=0)

    I.update_ledger(spark, ledger_path, new.select(F.col("day").alias("key_date"), F.lit("incoming").alias("state")))
    ranges = gap_ranges(gap_groups(new, "day", gap), "day")
    slices = S.to_slices(S.strict_slices(ranges, days_per_slice), day, null_slice=False)
    rows = (read or (lambda s: rows_in(source, s)))(slices)
    # a run of new days may span days the lake already has
    land(rows.join(new.select(F.col("day").alias("_day")), F.col(day).cast("date") == F.col("_day"), "left_semi"))

    checked = materialize(I.verify_dates(new, landed(new), "day"), "checked-days")
    ended = I.verify_load(new, checked.filter("state = 'DONE'").select("day"), "day").first()
    state = F.when(F.col("state") == "DONE", "landed").otherwise("missed")
    I.update_ledger(spark, ledger_path, checked.select(F.col("day").alias("key_date"), state.alias("state")))
    return Row(status=ended["status"], reason=guard["reason"], dates=guard["new_dates"], done=ended["done"], not_done=ended["not_done"])
