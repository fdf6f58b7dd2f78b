"""Footers, days, stored profiles and keyed buckets on edge rows, and proof of what is not read."""

import datetime as dt
import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidelake.operators import profile as P
from tidelake.operators import stored_profile as SP
from tidelake.plans import daily, upsert
from tidelake.plans import incremental as I
from tidelake.session import scratch_path
from tidelake.sources import days as D
from tidelake.sources import footers as FF
from tidelake.sources import sinks

NTZ = dt.datetime


def ruin_pages(path: str) -> int:
    """Overwrite everything before the footer of all Parquet files below a folder; sizes and names stay."""
    files = [f for f in glob.glob(f"{path.removeprefix('file:')}/**/*.parquet", recursive=True) if "/_" not in f.removeprefix(path)]
    for name in files:
        with open(name, "r+b") as f:
            f.seek(-8, os.SEEK_END)
            size = int.from_bytes(f.read(4), "little")
            end = f.seek(0, os.SEEK_END) - 8 - size
            f.seek(4)
            f.write(b"\0" * (end - 4))
        check = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
        if os.path.exists(check):
            os.remove(check)
    return len(files)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- footers ----------------------------------------------------------------

def keyed(spark, n=1000):
    return spark.range(n).select(
        F.col("id").alias("k"), (F.col("id") % 7).cast("int").alias("part"), F.expr("timestamp_ntz '2020-01-01' + make_dt_interval(0, id, 0, 0.000001)").alias("at"),
        F.expr("date_add(DATE '2020-01-01', cast(id as int))").alias("day"), F.col("id").cast("string").alias("name"),
        F.when(F.col("id") % 10 == 0, float("nan")).otherwise(F.col("id").cast("double")).alias("x"), F.lit(None).cast("int").alias("none"))


def test_no_page_is_read(spark):
    path = scratch_path(spark, "ruined")
    keyed(spark).repartition(3).write.partitionBy("part").parquet(path)
    want = {c: tuple(spark.read.parquet(path).agg(F.min(c), F.max(c)).first()) for c in ("k", "at", "day")}
    per_part = rows_of(spark.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)), F.min("k"), F.max("k")))
    assert ruin_pages(path) > 3
    assert FF.row_count(spark, path).rows.first()[0] == 1000
    for c, bounds in want.items():
        found = FF.key_range(spark, path, c, confirm=False)
        assert found.from_footers and tuple(found.rows.first()) == bounds
    counts, ranges = FF.row_count(spark, path, ["part"]), FF.key_range(spark, path, "k", ["part"], confirm=False)
    assert counts.from_footers and ranges.from_footers
    assert rows_of(counts.rows.join(ranges.rows, "part")) == per_part
    assert FF.row_count(spark, path, ["part"], F.col("part") < 2).rows.count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(path).agg(F.max("k")).collect()


@pytest.mark.parametrize("column", ["k", "at", "day", "name", "x", "none", "part"])
def test_ranges_agree_with_a_scan(spark, column):
    path = scratch_path(spark, "ranges")
    keyed(spark, 100).write.parquet(path)
    found = FF.key_range(spark, path, column)
    want = spark.read.parquet(path).agg(F.min(column), F.max(column)).first()
    assert repr(tuple(found.rows.first())) == repr(tuple(want))  # NaN included
    assert found.from_footers == (column in ("k", "at", "day", "part"))


def test_files_of_unlike_layout_are_told_by_the_confirmation(spark):
    path = scratch_path(spark, "unlike")
    spark.range(0, 100).select(F.col("id").alias("a"), (F.col("id") + 500).alias("b")).coalesce(1).write.parquet(path)
    spark.range(100, 200).select((F.col("id") + 500).alias("b"), F.col("id").alias("a")).coalesce(1).write.mode("append").parquet(path)
    for c, want in (("a", (0, 199)), ("b", (500, 699))):
        assert tuple(FF.key_range(spark, path, c).rows.first()) == want


def test_times_of_other_units_and_without_statistics_are_scanned(spark):
    path = scratch_path(spark, "units")
    sinks.land_append(spark.range(1), path)  # makes the folder
    local = path.removeprefix("file:")
    for f in glob.glob(f"{local}/*"):
        os.remove(f)
    at = [dt.datetime(2020, 1, 1), dt.datetime(2021, 5, 4, 3, 2, 1)]
    pq.write_table(pa.table({"t": pa.array(at, pa.timestamp("ms"))}), f"{local}/a.parquet")
    found = FF.key_range(spark, path, "t")
    assert not found.from_footers and tuple(found.rows.first()) == tuple(at)
    bare = scratch_path(spark, "bare")
    spark.range(50).write.option("parquet.column.statistics.enabled", "false").parquet(bare)
    found = FF.key_range(spark, bare, "id")
    assert not found.from_footers and tuple(found.rows.first()) == (0, 49)
    old = scratch_path(spark, "old-times")
    spark.sql("SELECT timestamp'2020-01-01 10:00:00' AS t").write.option("timestampType", "INT96").parquet(old)
    assert FF.watermark(spark, old, "t").rows.first()[0] == dt.datetime(2020, 1, 1, 10)


def test_empty_folders(spark):
    path = scratch_path(spark, "empty")
    keyed(spark, 5).limit(0).write.parquet(path)
    assert FF.row_count(spark, path).rows.first()[0] == 0
    assert tuple(FF.key_range(spark, path, "k").rows.first()) == (None, None)
    assert FF.watermark(spark, path, "at").rows.first()[0] is None


def test_watermark_load_takes_its_watermark_from_footers(spark):
    path = scratch_path(spark, "lake")
    sinks.land_append(keyed(spark, 10), path)
    assert I.newest_in(spark, path, "day") == dt.date(2020, 1, 10)
    assert I.newest_in(spark, path, "at", timed=True) == dt.datetime(2020, 1, 1, 9, 0, 0, 1)
    assert I.load_by_watermark(keyed(spark, 12), path, "day") == "LOADED"
    assert I.load_by_watermark(keyed(spark, 12), path, "day") == "UP_TO_DATE"
    assert spark.read.parquet(path).count() == 12


# --- days -------------------------------------------------------------------

def dated(spark, *days, rows=3):
    return spark.createDataFrame([(NTZ(2024, 1, d, h), f"{d}-{h}") for d in days for h in range(rows)], "ts timestamp_ntz, v string")


def states(spark, path):
    return {r["day"].day if r["day"] else None: (r["state"], r["num_rows"]) for r in D.day_states(spark, path).collect()}


def test_days_are_whole_torn_or_lost(spark):
    path = scratch_path(spark, "days")
    assert states(spark, path) == {}
    entries = D.land_days(dated(spark, 1, 2, 3), path, F.col("ts")).collect()
    assert sorted((r["day"].day, r["num_rows"]) for r in entries) == [(1, 3), (2, 3), (3, 3)]
    dated(spark, 2, 4).withColumn(D.DAY, F.col("ts").cast("date")).write.mode("append").partitionBy(D.DAY).parquet(path)
    sinks.delete_path(spark, f"{path}/{D.DAY}=2024-01-03")
    assert states(spark, path) == {1: ("WHOLE", 3), 2: ("TORN", 3), 3: ("LOST", 3), 4: ("TORN", None)}
    # a load of one day commits that day only, though others are torn
    D.land_days(dated(spark, 2, rows=5), path, F.col("ts"))
    assert states(spark, path) == {1: ("WHOLE", 3), 2: ("WHOLE", 5), 3: ("LOST", 3), 4: ("TORN", None)}
    assert D.newest_day(spark, path).first()[0] == dt.date(2024, 1, 2)
    D.land_days(spark.createDataFrame([(None, "x")], "ts timestamp_ntz, v string"), path, F.col("ts"))
    assert states(spark, path)[None] == ("WHOLE", 1)
    assert {r["day"].day for r in D.whole_days(spark, path).collect()} == {1, 2}
    assert spark.read.parquet(path).count() == 3 + 5 + 3 + 1


def test_daily_update_reads_no_row_of_the_lake(spark):
    lake, ledger = scratch_path(spark, "lake"), scratch_path(spark, "ledger")
    D.land_days(dated(spark, 1, 2, 3), lake, F.col("ts"))
    assert ruin_pages(lake) >= 3
    source = dated(spark, 1, 2, 3, 4, 5, 6)
    ended = daily.daily_update_by_days(spark, source, lake, ledger, "ts")
    assert (ended.status, ended.dates, ended.done) == ("COMPLETE", 2, 2)
    assert {k for k, v in states(spark, lake).items() if v == ("WHOLE", 3)} == {1, 2, 3, 4, 5}
    again = daily.daily_update_by_days(spark, source, lake, ledger, "ts")
    assert (again.status, again.reason) == ("OK", "NOTHING_NEW")


def test_a_died_run_stops_the_next_or_is_resumed(spark, monkeypatch):
    lake, ledger = scratch_path(spark, "lake"), scratch_path(spark, "ledger")
    D.land_days(dated(spark, 1), lake, F.col("ts"))
    source = dated(spark, 1, 2, 3, 4)

    def dies(rows, path, day):
        # one of two days has arrived, torn
        rows.filter("day(ts) = 2").withColumn(D.DAY, F.col("ts").cast("date")).write.mode("append").partitionBy(D.DAY).parquet(path)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(D, "land_days", dies)
        with pytest.raises(RuntimeError):
            daily.daily_update_by_days(spark, source, lake, ledger, "ts")
    stopped = daily.daily_update_by_days(spark, source, lake, ledger, "ts")
    assert (stopped.status, stopped.reason) == ("STOP", "REPEATED_INCOMING")
    resumed = daily.daily_update_by_days(spark, source, lake, ledger, "ts", resume=True)
    assert (resumed.status, resumed.dates, resumed.done) == ("COMPLETE", 2, 2)
    assert rows_of(spark.read.parquet(lake).select("ts", "v")) == rows_of(dated(spark, 1, 2, 3))


def test_a_run_that_died_after_its_commit_is_not_loaded_again(spark, monkeypatch):
    lake, ledger = scratch_path(spark, "lake"), scratch_path(spark, "ledger")
    D.land_days(dated(spark, 1), lake, F.col("ts"))
    source = dated(spark, 1, 2, 3)
    with monkeypatch.context() as m:
        m.setattr(I, "verify_dates", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            daily.daily_update_by_days(spark, source, lake, ledger, "ts")
    ended = daily.daily_update_by_days(spark, source, lake, ledger, "ts", resume=True)
    assert ended.reason == "NOTHING_NEW"
    assert {r["state"] for r in I.read_ledger(spark, ledger).collect()} == {"landed"}


# --- stored profiles --------------------------------------------------------

COLUMNS = ["k", "at", "day", "name", "none"]


def same_profile(merged, df):
    exact = {r["column_name"]: r for r in P.profile_pass(df, exact=True).collect()}
    for r in merged.collect():
        want = exact[r["column_name"]].asDict()
        got = r.asDict()
        assert abs(got.pop("num_distinct") - want["num_distinct"]) <= 0.07 * want.pop("num_distinct")
        assert got == want


def test_only_new_and_changed_partitions_are_profiled(spark):
    path, store = scratch_path(spark, "landing"), scratch_path(spark, "profiles")
    rows = keyed(spark, 700).drop("x").withColumn("part", F.when(F.col("part") != 6, F.col("part")))
    rows.filter("part <= 2 OR part IS NULL").write.partitionBy("part").parquet(path)
    assert SP.refresh(spark, store, path, "part").count() == 4
    ruin_pages(path)  # what is known must not be read again
    rows.filter("part > 2").write.mode("append").partitionBy("part").parquet(path)
    stored = SP.refresh(spark, store, path, "part")
    assert stored.count() == 7
    same_profile(SP.merged_profile(stored), rows.drop("part"))
    # a partition that is written again counts as it now is
    sinks.delete_path(spark, f"{path}/part=1")
    rows.filter("part = 1 AND k < 100").write.mode("append").partitionBy("part").parquet(path)
    sinks.delete_path(spark, f"{path}/part=2")
    stored = SP.refresh(spark, store, path, "part")
    assert stored.count() == 6 and spark.read.parquet(store).count() == 8
    same_profile(SP.merged_profile(stored), rows.filter("(part <> 2 AND (part <> 1 OR k < 100)) OR part IS NULL").drop("part"))
    assert SP.merged_profile(stored).filter("column_name = 'k'").first()["num_rows"] == 515
    ranges = SP.stored_ranges(stored, ["k", "day"])
    want = P.partition_ranges(rows.filter("part = 4"), "part", ["k", "day"])
    assert rows_of(ranges.filter("partition = '4'")) == rows_of(want)


def test_a_column_that_came_later(spark):
    path, store = scratch_path(spark, "landing"), scratch_path(spark, "profiles")
    spark.range(10).select("id", F.lit(1).alias("part")).write.partitionBy("part").parquet(path)
    SP.refresh(spark, store, path, "part")
    rows = spark.range(5).select("id", F.lit("x").alias("late"), F.lit(2).alias("part"))
    late = SP.profile_partitions(rows, F.col("part"), ["id", "late"])
    late.select("*", F.lit(1).cast("bigint").alias("bytes"), F.lit("m").alias("mark"), F.lit(1).cast("bigint").alias("run")).write.mode("append").parquet(store)
    merged = {r["column_name"]: r for r in SP.merged_profile(SP.read_store(spark, store)).collect()}
    assert (merged["late"]["num_rows"], merged["late"]["num_nulls"], merged["late"]["high_value"]) == (15, 10, "x")
    assert (merged["id"]["num_rows"], merged["id"]["num_nulls"], merged["id"]["high_value"]) == (15, 0, "9")


# --- keyed buckets ----------------------------------------------------------

def people(spark, *rows):
    return spark.createDataFrame(list(rows), "k bigint, region string, v string, at int")


def test_upsert_touches_only_its_buckets(spark):
    path = scratch_path(spark, "keyed")
    old = spark.range(200).select(F.col("id").alias("k"), F.lit("r").alias("region"), F.lit("old").alias("v"), F.lit(0).alias("at"))
    upsert.create_keyed(old, path, ["k", "region"], 8)
    before = set(upsert.read_keyed(spark, path).inputFiles())
    touched = upsert.upsert_keyed(spark, path, people(spark, (5, "r", "new", 1), (5, "r", "newer", 2), (500, "r", "added", 1), (None, None, "null", 1)), order="at")
    rows = {(r["k"], r["region"]): r["v"] for r in upsert.read_keyed(spark, path).collect()}
    assert len(rows) == 202 and rows[5, "r"] == "newer" and rows[500, "r"] == "added" and rows[None, None] == "null" and rows[6, "r"] == "old"
    gone = before - set(upsert.read_keyed(spark, path).inputFiles())
    assert {int(f.split("/bucket=")[1].split("/")[0]) for f in gone} <= set(touched)
    assert len(gone) < len(before)
    upsert.upsert_keyed(spark, path, people(spark, (None, None, "again", 1)))
    assert upsert.read_keyed(spark, path).filter("k IS NULL").first()["v"] == "again"
    assert upsert.upsert_keyed(spark, path, people(spark, (1, "r", "x", 1)).limit(0)) == []
    with pytest.raises(ValueError):
        upsert.upsert_keyed(spark, path, people(spark, (1, "r", "a", 1), (1, "r", "b", 2)))


def test_untouched_buckets_are_not_read(spark):
    path = scratch_path(spark, "keyed")
    upsert.create_keyed(spark.range(100).select("id", F.lit(0).alias("v")), path, ["id"], 4)
    current = upsert.read_keyed(spark, path)
    buckets = {r["id"]: r["b"] for r in current.select("id", upsert._bucket_of(["id"], 4).alias("b")).collect()}
    for b in set(buckets.values()) - {buckets[7]}:
        ruin_pages(f"{path}/bucket={b}")
    assert upsert.upsert_keyed(spark, path, spark.createDataFrame([(7, 1)], "id bigint, v int")) == [buckets[7]]


def test_a_died_upsert_changes_nothing_and_conflicts_are_refused(spark, monkeypatch):
    path = scratch_path(spark, "keyed")
    upsert.create_keyed(spark.range(20).select("id", F.lit(0).alias("v")), path, ["id"], 4)
    one = spark.createDataFrame([(3, 9)], "id bigint, v int")
    commit = upsert._commit
    with monkeypatch.context() as m:
        m.setattr(upsert, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            upsert.upsert_keyed(spark, path, one)
    assert upsert.read_keyed(spark, path).agg(F.sum("v")).first()[0] == 0
    write = upsert._write

    def overtaken(df, path, keys, buckets, run):
        write(df, path, keys, buckets, run)
        commit(path, spark.range(4).select(F.col("id").cast("int").alias("bucket")), run + 1)

    with monkeypatch.context() as m:
        m.setattr(upsert, "_write", overtaken)
        with pytest.raises(upsert.Conflict):
            upsert.upsert_keyed(spark, path, one)


def test_unlisted_runs_can_be_dropped(spark):
    path = scratch_path(spark, "keyed")
    upsert.create_keyed(spark.range(20).select("id", F.lit(0).alias("v")), path, ["id"], 4)
    for v in (1, 2):
        upsert.upsert_keyed(spark, path, spark.createDataFrame([(3, v)], "id bigint, v int"))
    before = rows_of(upsert.read_keyed(spark, path))
    assert upsert.drop_unlisted(spark, path) == 2
    assert rows_of(upsert.read_keyed(spark, path)) == before
    assert upsert.drop_unlisted(spark, path) == 0
