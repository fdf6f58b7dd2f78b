"""Loading only what is new: watermarks, partitions, the date ledger, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.predicates import compare, landed_day, landed_second
from tidelake.operators.joins import filter_by_keys, key_set, null_safe_join
from tidelake.session import materialize
from tidelake.sources import footers
from tidelake.sources.sinks import land_append, path_exists, recover_folder, replace_folder

MAX_NEW_DATES = 20
LEDGER_SCHEMA = "key_date date, state string"


def rows_after_watermark(
    source: DataFrame, lake: DataFrame, key: str, landed: bool = False, timed: bool = False
) -> DataFrame:
    """Source rows after the lake's newest day; all of them when the lake is empty.

    ``landed`` says the lake holds the key as text, ``timed`` that the key has
    a time of day and is compared by second. The source filter is a typed
    range, which a JDBC or Parquet scan applies itself.
    """
    if landed:  # by what the text parses to: one unreadable value must not become the newest
        newest = F.max(landed_second(key) if timed else landed_day(key))
    else:
        newest = F.max(F.col(key).cast("timestamp_ntz" if timed else "date"))
    return rows_after(source, key, lake.agg(newest).first()[0])


def rows_after(source: DataFrame, key: str, top) -> DataFrame:
    """Source rows after a day or second; all of them where there is none."""
    return source if top is None else source.filter(compare(key, top, ">"))


def newest_in(spark: SparkSession, path: str, key: str, timed: bool = False, confirm: bool = True):
    """The newest day, or second, of a folder's column: from footers where they tell it, else from a scan."""
    newest = footers.watermark(spark, path, key, confirm).rows
    return newest.select(F.col("watermark").cast("timestamp_ntz" if timed else "date")).first()[0]


def load_by_watermark(
    source: DataFrame, lake_path: str, key: str, landed: bool = False, timed: bool = False
) -> str:
    """Append to the lake what came after its watermark; ``UP_TO_DATE`` when nothing did.

    The watermark of a typed key comes from footers; one landed as text is parsed.
    """
    spark = source.sparkSession
    if landed:
        rows = rows_after_watermark(source, spark.read.parquet(lake_path), key, landed, timed)
    else:
        rows = rows_after(source, key, newest_in(spark, lake_path, key, timed))
    if rows.isEmpty():
        return "UP_TO_DATE"
    land_append(rows, lake_path)
    return "LOADED"


def new_partition_keys(source: DataFrame, lake: DataFrame, key: str) -> DataFrame:
    """The partition values of the source that the lake does not have, NULL among them; written once."""
    new = null_safe_join(key_set(source, [key]), key_set(lake, [key]), [key], "left_anti")
    return materialize(new, "new-partitions")


def rows_of_new_partitions(source: DataFrame, lake: DataFrame, key: str, new: DataFrame | None = None) -> DataFrame:
    """Source rows whose partition value the lake does not have; NULL is a value of its own."""
    new = new_partition_keys(source, lake, key) if new is None else new
    rows = filter_by_keys(source, F.col(key), new, key)
    if new.filter(F.col(key).isNull()).isEmpty():
        return rows
    return rows.unionByName(source.filter(F.col(key).isNull()))


def load_new_partitions(source: DataFrame, lake_path: str, key: str) -> str:
    lake = source.sparkSession.read.parquet(lake_path)
    new = new_partition_keys(source, lake, key)
    if new.isEmpty():
        return "UP_TO_DATE"
    land_append(rows_of_new_partitions(source, lake, key, new), lake_path)
    return "LOADED"


def new_ledger_dates(source: DataFrame, lake: DataFrame, tracked: DataFrame, day: str) -> DataFrame:
    """Source dates without the newest, which may be incomplete, that neither lake nor ledger has."""
    dates = materialize(source.select(day).filter(F.col(day).isNotNull()).distinct(), "source-dates")
    newest = dates.agg(F.max(day)).first()[0]
    known = lake.select(day).union(tracked.select(day)).distinct()
    return dates.filter(F.col(day) < F.lit(newest)).join(known, day, "left_anti").orderBy(day)


def ledger_guards(
    lake: DataFrame, tracked: DataFrame, incoming: DataFrame, new: DataFrame, day: str, limit: int = MAX_NEW_DATES
) -> DataFrame:
    """One row saying whether a load may start, with the reason.

    ``STOP``: neither lake nor ledger has a date, a new date was incoming last
    time already, or there are more than ``limit`` new dates. ``WARN``: the
    lake has no date, or fewer dates than the ledger.
    """
    tagged = [d.select(F.col(day).alias("d"), F.lit(tag).alias("tag"))
              for tag, d in (("lake", lake), ("tracked", tracked), ("incoming", incoming), ("new", new))]
    flags = (
        tagged[0].union(tagged[1]).union(tagged[2]).union(tagged[3])
        .filter("d IS NOT NULL")
        .groupBy("d")
        .agg(*[F.bool_or(F.col("tag") == t).alias(t) for t in ("lake", "tracked", "incoming", "new")])
    )
    counted = flags.agg(
        F.count_if("lake").alias("lake_dates"),
        F.count_if("tracked").alias("tracked_dates"),
        F.count_if("new").alias("new_dates"),
        F.count_if(F.col("new") & F.col("incoming")).alias("repeated_dates"),
    )
    reason = (
        F.when((F.col("lake_dates") == 0) & (F.col("tracked_dates") == 0), "NO_DATES")
        .when(F.col("repeated_dates") > 0, "REPEATED_INCOMING")
        .when(F.col("new_dates") > limit, "TOO_MANY_DATES")
        .when(F.col("lake_dates") == 0, "LAKE_EMPTY")
        .when(F.col("lake_dates") < F.col("tracked_dates"), "FEWER_LAKE_DATES")
        .when(F.col("new_dates") == 0, "NOTHING_NEW")
        .otherwise("READY")
    )
    status = (
        F.when(F.col("reason").isin("NO_DATES", "REPEATED_INCOMING", "TOO_MANY_DATES"), "STOP")
        .when(F.col("reason").isin("LAKE_EMPTY", "FEWER_LAKE_DATES"), "WARN")
        .otherwise("OK")
    )
    return counted.withColumn("reason", reason).withColumn("status", status)


def verify_dates(incoming: DataFrame, lake: DataFrame, day: str) -> DataFrame:
    """Every incoming date with whether the lake has it now."""
    have = lake.select(day).distinct().withColumn("_have", F.lit(True))
    return incoming.select(day).distinct().join(have, day, "left").select(
        day, F.when(F.col("_have"), "DONE").otherwise("NOT_DONE").alias("state")
    )


def verify_load(incoming: DataFrame, lake: DataFrame, day: str) -> DataFrame:
    """One row on how a load ended.

    ``COMPLETE``: all dates arrived. ``PARTIAL``: only the newest is missing.
    ``FAILED``: anything else is missing. ``NOTHING``: no date was incoming.
    """
    missing = F.col("state") == "NOT_DONE"
    counted = verify_dates(incoming, lake, day).agg(
        F.count_if(~missing).alias("done"),
        F.count_if(missing).alias("not_done"),
        F.max(day).alias("_newest"),
        F.min(F.when(missing, F.col(day))).alias("_missing"),
    )
    status = (
        F.when((F.col("done") == 0) & (F.col("not_done") == 0), "NOTHING")
        .when(F.col("not_done") == 0, "COMPLETE")
        .when((F.col("not_done") == 1) & (F.col("_missing") == F.col("_newest")), "PARTIAL")
        .otherwise("FAILED")
    )
    return counted.select("done", "not_done", status.alias("status"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The date ledger (key_date, state); empty where none was written."""
    recover_folder(spark, path)
    if path_exists(spark, path):
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    return spark.createDataFrame([], LEDGER_SCHEMA)


def update_ledger(spark: SparkSession, path: str, dates: DataFrame) -> None:
    """Merge (key_date, state) rows into the ledger, the new state of a date replacing the old."""
    replace_folder(keyed_upsert(read_ledger(spark, path), dates, ["key_date"]), path)


def keyed_upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows replace the old rows of their key; the other old rows stay.

    Of several new rows of one key the one with the largest ``order`` counts;
    without an order they are refused.
    """
    if order:
        row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in new.columns]), order).alias("_row")
        new = new.groupBy(*keys).agg(row).select("_row.*")
    elif not new.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        raise ValueError(f"several new rows share a key {keys}; name the order that settles them")
    kept = null_safe_join(old, key_set(new, keys), keys, "left_anti")
    return kept.unionByName(new)


def estimate_new_rows(history: DataFrame, key: str, since, until, rows_per_split: int = 1_000_000) -> DataFrame:
    """Expected rows between two dates at the past daily rate, and whether a plain read will do."""
    day = F.col(key).cast("date")
    counted = history.agg(
        F.count(F.lit(1)).alias("old_rows"), F.datediff(F.max(day), F.min(day)).alias("old_days")
    )
    new_days = F.datediff(F.lit(until).cast("date"), F.lit(since).cast("date"))
    estimated = F.when(
        F.col("old_days") > 0, F.bround(F.col("old_rows") * new_days / F.col("old_days"))
    ).otherwise(F.col("old_rows")).cast("bigint")
    return counted.select("old_rows", "old_days", new_days.alias("new_days"), estimated.alias("new_rows")).withColumn(
        "read", F.when(F.col("new_rows") < rows_per_split, "PLAIN").otherwise("PLANNED")
    )


def update_style(plans: DataFrame) -> DataFrame:
    """How each table finds its new rows, from split_key_type and import style.

    A point style decides over the key's type, as the later rule does in the plan.
    """
    base = F.regexp_extract(F.upper("split_key_type"), "^[A-Z0-9]*", 0)
    return plans.withColumn(
        "update_style",
        F.when(F.col("style") == "POINT+FIXED", "PARTITION_UPDATE")
        .when(base.isin("DATE", "TIMESTAMP"), "INCREMENTAL")
        .otherwise("UNKNOWN"),
    )
