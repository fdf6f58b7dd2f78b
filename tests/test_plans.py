"""Slices, styles, guards, gold and upserts on edge rows."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelake.functions import predicates as P
from tidelake.operators import aggregates as A
from tidelake.operators import catalogue as C
from tidelake.operators import ordered as O
from tidelake.operators import profile as R
from tidelake.operators import reports as T
from tidelake.operators import schema as S
from tidelake.operators.trigrams import catalogue_search_indexed, name_index, runs_of
from tidelake.plans import gold as G
from tidelake.plans import incremental as I
from tidelake.plans import slicing as L
from tidelake.session import scratch_path
from tidelake.sources import files, sinks

D = dt.date


def days(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "day date")


# --- slices -----------------------------------------------------------------

def test_slices_hold_every_row_once_whatever_the_time_of_day(spark):
    base = dt.datetime(2020, 1, 1)
    rows = [(base + dt.timedelta(days=i, hours=h),) for i in range(31) for h in (0, 11, 23)] + [(None,)] * 4
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    for n in (1, 2, 5, 31, 100):
        ranges = df.agg(F.min(F.col("ts").cast("date")).alias("lo"), F.max(F.col("ts").cast("date")).alias("hi"))
        slices = L.to_slices(L.range_slices(ranges, n), "ts")
        got = [(r["slices_holding"], r["rows"]) for r in L.slice_coverage(df, "ts", slices).collect()]
        assert got == [(1, len(rows))]


def test_closed_slices_would_read_boundaries_twice(spark):
    df = days(spark, *[D(2020, 1, 1) + dt.timedelta(days=i) for i in range(10)])
    closed = [L.Slice("day", D(2020, 1, 1), D(2020, 1, 6)), L.Slice("day", D(2020, 1, 5), D(2020, 1, 12))]
    got = {r["slices_holding"]: r["rows"] for r in L.slice_coverage(df, "day", closed).collect()}
    assert got == {1: 9, 2: 1}


def test_number_slices(spark):
    df = spark.range(7, 1003).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("k"))
    slices = L.to_slices(L.range_slices(A.key_range(df, "k"), 13), "k")
    assert len(slices) == 14
    assert [tuple(r) for r in L.slice_coverage(df, "k", slices).collect()] == [(1, 996)]


def test_wide_number_ranges_do_not_overflow(spark):
    ranges = spark.createDataFrame([(0, 9_000_000_000_000_000_000)], "lo long, hi long")
    got = L.range_slices(ranges, 50).orderBy("slice_no").collect()
    assert len(got) == 50 and got[0]["from_key"] == 0 and got[-1]["to_key"] == 9_000_000_000_000_000_001
    assert all(a["to_key"] == b["from_key"] for a, b in zip(got, got[1:]))


def test_point_slices(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (5,), (None,)], "k int")
    slices = L.to_slices(L.point_slices(df, "k"), "k")
    assert [s.point for s in slices] == [1, 2, 5, None]
    assert [tuple(r) for r in L.slice_coverage(df, "k", slices).collect()] == [(1, 5)]


def test_coverage_counts_every_slice_that_holds_a_value(spark):
    rng = random.Random(4)
    spans = [(a, a + rng.randrange(-3, 40)) for a in (rng.randrange(300) for _ in range(150))]
    points = [rng.randrange(300) for _ in range(60)]
    slices = [L.Slice("k", low=a, high=b) for a, b in spans] + [L.Slice("k", point=p) for p in points]
    df = spark.range(-5, 320).select(F.col("id").alias("k"))
    want = Counter(sum(a <= k < b for a, b in spans) + points.count(k) for k in range(-5, 320))
    assert {r["slices_holding"]: r["rows"] for r in L.slice_coverage(df, "k", slices).collect()} == want


def test_strict_slices(spark):
    ranges = spark.createDataFrame([(1, D(2020, 1, 1), D(2020, 1, 1)), (2, D(2020, 2, 1), D(2020, 2, 26))], "g int, lo date, hi date")
    got = [tuple(r) for r in L.strict_slices(ranges, 10, ["g"]).orderBy("g", "slice_no").collect()]
    assert got[0] == (1, 0, D(2020, 1, 1), D(2020, 1, 2))
    # 25 days / 10 + 0.9 rounds to 3 points, so two slices, the last one past the end
    assert got[1:] == [(2, 0, D(2020, 2, 1), D(2020, 2, 13)), (2, 1, D(2020, 2, 13), D(2020, 2, 27))]


def test_slice_sql_text():
    s = L.Slice("D", D(2020, 1, 1), D(2020, 1, 2))
    assert s.sql() == "D >= {ts '2020-01-01 00:00:00'} AND D < {ts '2020-01-02 00:00:00'}"
    assert L.Slice("C", point="it's").sql() == "C = 'it''s'"
    assert L.Slice("C", no_key=True).sql() == "C IS NULL"


# --- comparisons ------------------------------------------------------------

@pytest.mark.parametrize("op", ["=", "!=", "<", "<=", ">", ">="])
@pytest.mark.parametrize("value", ["2020-01-15", "2020-01-15 12:00:00", D(2020, 1, 15), dt.datetime(2020, 1, 15, 12, 0, 0)])
def test_compare_agrees_with_text_prefixes(spark, op, value):
    base = dt.datetime(2020, 1, 14, 23, 59, 59)
    rows = [(base + dt.timedelta(seconds=s, milliseconds=ms),) for s in (0, 1, 43201, 43202, 86401, 90000) for ms in (0, 500)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz").withColumn("text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"))
    size = 10 if P.literal_class(value) == "date" else 19
    by_prefix = df.filter(F.expr(f"substr(text, 1, {size}) {op} '{str(value)[:size]}'")).count()
    assert df.filter(P.compare("ts", value, op)).count() == by_prefix
    assert df.filter(P.compare("text", value, op, landed=True)).count() == by_prefix


def test_literal_class():
    assert [P.literal_class(v) for v in (1, 2.5, "abc", "2020-01-01", "2020/01/01", "2020-01-01 10:00:00")] == [
        "num", "num", "str", "date", "date", "timestamp"]


def test_typed_comparison_reaches_the_scan(spark, sf):
    plan = spark.read.parquet(f"{sf}/orders.parquet").filter(P.compare("o_orderdate", "2000-01-01", ">")).select("o_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text


# --- ledger, guards, verification -------------------------------------------

def guard(spark, lake, tracked, incoming, new, **kw):
    row = I.ledger_guards(*[days(spark, *v) for v in (lake, tracked, incoming, new)], "day", **kw).first()
    return row["status"], row["reason"]


def test_guards(spark):
    a, b, c = D(2020, 1, 1), D(2020, 1, 2), D(2020, 1, 3)
    assert guard(spark, [], [], [], [a]) == ("STOP", "NO_DATES")
    assert guard(spark, [], [a], [], [b]) == ("WARN", "LAKE_EMPTY")
    assert guard(spark, [a], [a, b], [], [c]) == ("WARN", "FEWER_LAKE_DATES")
    assert guard(spark, [a, b], [a], [c], [c]) == ("STOP", "REPEATED_INCOMING")
    assert guard(spark, [a], [a], [], [b]) == ("OK", "READY")
    assert guard(spark, [a], [a], [], []) == ("OK", "NOTHING_NEW")
    many = [D(2021, 1, 1) + dt.timedelta(days=i) for i in range(21)]
    assert guard(spark, [a], [a], [], many) == ("STOP", "TOO_MANY_DATES")
    assert guard(spark, [a], [a], [], many[:20]) == ("OK", "READY")


def test_new_dates_leave_out_the_newest(spark):
    source = days(spark, D(2020, 1, 1), D(2020, 1, 2), D(2020, 1, 3), None)
    got = I.new_ledger_dates(source, days(spark, D(2020, 1, 1)), days(spark), "day").collect()
    assert [r["day"] for r in got] == [D(2020, 1, 2)]
    assert I.new_ledger_dates(days(spark, D(2020, 1, 1)), days(spark), days(spark), "day").collect() == []


def test_verification(spark):
    a, b, c = D(2020, 1, 1), D(2020, 1, 2), D(2020, 1, 3)

    def status(incoming, lake):
        return I.verify_load(days(spark, *incoming), days(spark, *lake), "day").first()["status"]

    assert status([a, b], [a, b, c]) == "COMPLETE"
    assert status([a, b], [a]) == "PARTIAL"
    assert status([b], []) == "PARTIAL"  # a single new date that did not arrive is the newest
    assert status([a, b], [b]) == "FAILED"
    assert status([a, b, c], [a]) == "FAILED"
    assert status([], [a]) == "NOTHING"


def test_ledger_round_trip(spark):
    path = scratch_path(spark, "ledger")
    assert I.read_ledger(spark, path).isEmpty()
    rows = lambda *v: spark.createDataFrame(list(v), I.LEDGER_SCHEMA)
    I.update_ledger(spark, path, rows((D(2020, 1, 1), "incoming"), (D(2020, 1, 2), "incoming")))
    I.update_ledger(spark, path, rows((D(2020, 1, 1), "landed")))
    I.update_ledger(spark, path, rows((D(2020, 1, 1), "landed")))
    got = sorted(tuple(r) for r in I.read_ledger(spark, path).collect())
    assert got == [(D(2020, 1, 1), "landed"), (D(2020, 1, 2), "incoming")]
    assert not sinks.path_exists(spark, path + ".old") and not sinks.path_exists(spark, path + ".staged")


def test_interrupted_replacement_is_taken_up(spark):
    path = scratch_path(spark, "interrupted")
    sinks.replace_folder(spark.range(5), path)
    # the old folder was moved aside, then the driver died
    fs, target = sinks._path(spark, path)
    fs.rename(target, sinks._path(spark, path + ".old")[1])
    sinks.recover_folder(spark, path)
    assert spark.read.parquet(path).count() == 5


def test_upsert_keeps_one_row_per_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (None, "m")], "k int, v string")
    got = sorted((tuple(r) for r in I.keyed_upsert(old, new, ["k"]).collect()), key=str)
    assert got == [(1, "a"), (2, "c"), (3, "d"), (None, "m")]


def test_loads_twice_change_nothing(spark):
    path = scratch_path(spark, "lake")
    source = spark.range(100).select("id", F.expr("date_add(date'2020-01-01', cast(id % 10 as int))").alias("day"))
    sinks.land_append(source.filter("day < '2020-01-05'"), path)
    assert I.load_by_watermark(source, path, "day") == "LOADED"
    assert I.load_by_watermark(source, path, "day") == "UP_TO_DATE"
    assert I.load_new_partitions(source, path, "day") == "UP_TO_DATE"
    assert spark.read.parquet(path).count() == 100


def test_watermark_of_an_empty_lake(spark):
    source = days(spark, D(2020, 1, 1), D(2020, 1, 2))
    assert I.rows_after_watermark(source, source.limit(0), "day").count() == 2


def test_update_style(spark):
    plans = spark.createDataFrame(
        [("POINT+FIXED", "DATE"), ("SPLIT", "TIMESTAMP(6)"), ("PLAIN", "NUMBER"), ("PLAIN", "DATE")], "style string, split_key_type string")
    assert [r["update_style"] for r in I.update_style(plans).collect()] == ["PARTITION_UPDATE", "INCREMENTAL", "UNKNOWN", "INCREMENTAL"]


# --- schema and gold ---------------------------------------------------------

TYPES = {"K": "bigint", "DAY": "timestamp_ntz", "AMOUNT": "decimal(10,2)", "NAME": "string"}


@pytest.fixture()
def landing(spark):
    rows = [(str(i), f"2020-01-{i % 9 + 1:02d} {'00' if i % 2 else '23'}:00:00", f"{i}.50", f"n{i}") for i in range(90)]
    rows += rows[:30] + [("x1", "not a date", "n/a", "bad"), ("x1", "not a date", "n/a", "bad"), ("7", None, None, None)]
    path = scratch_path(spark, "raw")
    sinks.land_append(spark.createDataFrame(rows, "k string, day string, amount string, name string"), path)
    return spark.read.parquet(path)


def gold_name(spark, name):
    from registered.lake import new_table

    return new_table(spark, name)


def test_sequential_distinct_equals_rebuild(spark, landing):
    whole = G.rebuild(landing, TYPES, *gold_name(spark, "t_whole"))
    for budget in (5, 20, 50, 10_000):
        parts = G.sequential_distinct(landing, TYPES, *gold_name(spark, "t_parts"), "day", budget=budget)
        assert parts.count() == whole.count() == 92
        assert parts.exceptAll(whole).isEmpty() and whole.exceptAll(parts).isEmpty()


def test_a_distinct_by_bucket_shuffles_rows_once_and_makes_a_file_a_bucket(spark):
    types = {"id": "bigint", "day": "date"}
    rows = spark.range(3000).select((F.col("id") % 900).alias("id"), F.when(F.col("id") % 3 != 0, F.lit("2020-01-01")).when(F.col("id") % 9 == 0, "n/a").otherwise("2020-01-02").alias("day"))
    hot = rows.unionByName(spark.range(4000).select(F.lit(5).cast("bigint").alias("id"), F.lit("2020-01-03").alias("day")))
    for landing, copies in ((rows, 0), (hot, 1)):
        out = G.distinct_by_bucket(landing, types, "day", budget=500)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ShufflePartitionIdPassThrough") + plan.count("Exchange shufflepartitionidpassthrough") == 1
        after = plan[: plan.lower().index("exchange shufflepartitionidpassthrough")]
        assert "Exchange" not in after.replace("BroadcastExchange", "") and "HashAggregate" in after
        want = {tuple(r) for r in landing.select("id", F.col("day").try_cast("date")).collect()}
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want
        sizes = [len(p) for p in out.rdd.glom().collect()]
        assert len(sizes) == 6 + copies and max(sizes) <= 500
    table = G.sequential_distinct(hot, types, *gold_name(spark, "t_buckets"), "day", budget=500)
    assert len(table.inputFiles()) <= 7


def test_buckets_above_a_task_are_made_distinct_before_and_only_streamed(spark):
    types = {"id": "bigint", "day": "date"}
    day = F.when(F.col("id") % 3 != 0, F.lit("2020-01-01")).when(F.col("id") % 9 == 0, "n/a").when(F.col("id") % 3 == 0, "2020-01-02")
    rows = spark.range(3000).select((F.col("id") % 900).alias("id"), day.alias("day"))
    hot = rows.unionByName(spark.range(4000).select(F.lit(5).cast("bigint").alias("id"), F.lit("2020-01-03").alias("day")))
    odd = rows.unionByName(spark.createDataFrame([(None, None), (None, None), (7, None)], "id bigint, day string"))
    for landing, buckets in ((rows, 6), (hot, 7), (odd, 7)):
        out = G.distinct_by_bucket(landing, types, "day", budget=500, rows_per_task=100)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan[: plan.lower().index("exchange shufflepartitionidpassthrough")]
        want = {tuple(r) for r in landing.select("id", F.col("day").try_cast("date")).collect()}
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want
        # the same rows lie in the same buckets as where each is small enough for its task
        parts = lambda df: [sorted(map(tuple, p), key=repr) for p in df.rdd.glom().collect()]
        assert len(parts(out)) == buckets and parts(out) == parts(G.distinct_by_bucket(landing, types, "day", budget=500))
    table = G.sequential_distinct(hot, types, *gold_name(spark, "t_streamed"), "day", budget=500, rows_per_task=100)
    assert len(table.inputFiles()) <= 7 and table.count() == table.distinct().count() == hot.select("id", F.col("day").try_cast("date")).distinct().count()
    assert G.distinct_by_bucket(rows.limit(0), types, "day", rows_per_task=100).isEmpty()


def test_cells_follow_days_and_buckets_not_rows(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(G, "materialize", lambda df, name="stage", keep=G.materialize: seen.setdefault(name, []).append(out := keep(df, name)) or out)
    types = {"id": "bigint", "day": "date"}
    day = F.when(F.col("id") % 10 == 0, "n/a").when(F.col("id") % 10 == 1, "2020-01-01").otherwise(F.date_add(F.lit(D(2020, 2, 1)), (F.col("id") % 97).cast("int")).cast("string"))
    rows = spark.range(20_000).select("id", day.alias("day"))
    hot = rows.unionByName(spark.range(9000).select(F.lit(5).cast("bigint").alias("id"), F.lit("2020-01-01").alias("day")))
    for landing, copies in ((rows, 0), (hot, 1)):
        seen.clear()
        out = G.distinct_by_bucket(landing, types, "day", budget=5000)
        # 97 days, and two that are cut: runs of slots of 5000 / 16 rows or somewhat fewer
        assert [c.count() <= 99 + 2 * 4 * 16 for c in seen["cells"]] == [True] * (1 + copies)
        assert [c.agg(F.sum("_cnt")).first()[0] for c in seen["cells"]] == [landing.count(), 20_001][: 1 + copies]
        parts = [[tuple(r) for r in p] for p in out.rdd.glom().collect()]
        assert len(parts) == 4 + copies and max(len(p) for p in parts) <= 5000 * (1 + 2 / 16)
        found = [r for p in parts for r in p]
        want = {tuple(r) for r in landing.select("id", F.col("day").try_cast("date")).collect()}
        assert len(found) == len(want) and set(found) == want
        spans = [sorted((d or D(1, 1, 1)) for _, d in p) for p in parts if p]
        assert all(a[-1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_tasks_of_a_distinct_stay_few_enough_to_shuffle_rows_as_they_come():
    assert [G.distinct_tasks(n, 500_000) for n in (1, 500_000, 500_001, 40_000_000, 100_000_000, 100_000_001, 242_000_000, 400_000_000)] == [1, 1, 2, 80, 200, 200, 200, 200]
    assert G.distinct_tasks(4_000_000_000, 500_000) == 2000


def test_sequential_distinct_of_nothing_empties_the_table(spark, landing):
    name, path = gold_name(spark, "t_emptied")
    G.rebuild(landing, TYPES, name, path)
    assert G.sequential_distinct(landing.limit(0), TYPES, name, path, "day").isEmpty()


def test_promote_steps(spark, landing):
    name, path = gold_name(spark, "t_promoted")
    early = landing.filter("day < '2020-01-05'")
    step = lambda rows, style="INCREMENTAL": G.promote(spark, rows, name, path, TYPES, style, "day", stats=True)
    clean = landing.filter("k <> 'x1' AND day IS NOT NULL")
    ended = [step(early), step(clean), step(clean), step(clean, "UNKNOWN")]
    assert [e.status for e in ended] == ["CREATED", "APPENDED", "UP_TO_DATE", "UNKNOWN_STYLE"]
    assert T.stored_stats(spark, name).first()["rows"] == spark.table(name).count()
    # rows are distinct after every step, as after a rebuild
    assert spark.table(name).distinct().count() == spark.table(name).count() == 90


def test_promotion_by_whole_partition_keys(spark):
    landing = spark.createDataFrame([("2020-01-01 00:00:00", 1), ("2020-01-02 10:00:00", 2), (None, 3), ("n/a", 4)], "p string, v int")
    gold = spark.createDataFrame([(D(2020, 1, 1),)], "p date")
    assert sorted(r["v"] for r in G.new_partitions(landing, gold, "p", "p").collect()) == [2, 3, 4]
    with_null = spark.createDataFrame([(D(2020, 1, 1),), (None,)], "p date")
    assert [r["v"] for r in G.new_partitions(landing, with_null, "p", "p").collect()] == [2]
    keys = spark.createDataFrame([(k, i) for i, k in enumerate(["1", "10", "11", "2", "", None])], "p string, v int")
    assert sorted(r["v"] for r in G.new_partitions(keys, spark.createDataFrame([("1",)], "p string"), "p", "p").collect()) == [1, 2, 3, 4, 5]
    assert sorted(r["v"] for r in G.new_partitions(keys, spark.createDataFrame([(1,)], "p int"), "p", "p").collect()) == [1, 2, 3, 4, 5]


def test_sequential_distinct_keeps_days_that_are_not_padded(spark):
    days = [f"1995-{m:02d}-15" for m in range(1, 13)] + ["1995-6-30", "1995-3-1", "n/a", None]
    rows = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "day string, v int")
    types = {"day": "date", "v": "int"}
    whole = G.rebuild(rows, types, *gold_name(spark, "t_odd_whole"))
    parts = G.sequential_distinct(rows, types, *gold_name(spark, "t_odd_parts"), "day", budget=2)
    assert parts.count() == whole.count() == 16 and parts.exceptAll(whole).isEmpty()


def test_watermark_ignores_unreadable_text(spark):
    lake = spark.createDataFrame([("2020-01-05",), ("n/a",), ("2020-1-7 10:00:00",), (None,)], "d string")
    source = spark.createDataFrame([(dt.datetime(2020, 1, 7, 12),), (dt.datetime(2020, 1, 8),)], "d timestamp_ntz")
    assert I.rows_after_watermark(source, lake, "d", landed=True).count() == 1
    assert I.rows_after_watermark(source, lake, "d", landed=True, timed=True).count() == 2


def test_null_partition_is_loaded_once(spark):
    from tidelake.session import scratch_path

    path = scratch_path(spark, "null-part")
    source = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "p string, v int")
    source.filter("p = 'a'").write.parquet(path)
    assert [I.load_new_partitions(source, path, "p") for _ in range(3)] == ["LOADED", "UP_TO_DATE", "UP_TO_DATE"]
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_upsert_settles_or_refuses_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "x", 5), (1, "y", 9), (3, "z", 1)], "k int, v string, at int")
    with pytest.raises(ValueError, match="share a key"):
        I.keyed_upsert(old, new, ["k"])
    assert sorted((r["k"], r["v"]) for r in I.keyed_upsert(old, new, ["k"], order="at").collect()) == [(1, "y"), (2, "b"), (3, "z")]


@pytest.mark.parametrize("text, kind", [
    ("2024-01-15", "date"), ("2024/01/15", "date"), ("2024-01-15 10:00:00", "timestamp"), ("20240115", "str"), ("2024-W03", "str"),
    ("2024-01/15", "str"), ("2024-02-31", "str"), ("2024-01-15T10:00:00+01:00", "str"), ("2024-1-5", "str"),
])
def test_literal_classes(text, kind):
    assert P.literal_class(text) == kind


def test_a_time_with_a_zone_is_refused():
    with pytest.raises(ValueError, match="zone"):
        P.compare("t", dt.datetime(2024, 1, 15, tzinfo=dt.timezone.utc))


def test_cast_failures_and_malformed_values(spark, landing):
    failed = {r["column_name"]: r["failed"] for r in S.cast_failures(landing, TYPES).collect()}
    assert failed == {"K": 2, "DAY": 2, "AMOUNT": 2, "NAME": 0}
    assert S.cast_columns(landing, TYPES).filter("K IS NULL").count() == 2


def test_alignment_rules(spark):
    gold = spark.createDataFrame([], "A int, B int, C int, D int").schema
    landing = spark.createDataFrame([("1", 2, 3)], "b string, A int, c int")
    with pytest.raises(S.SchemaMismatch):
        S.align(landing, gold)
    assert [tuple(r) for r in S.align(landing, gold, fill_null=True).collect()] == [(2, 1, 3, None)]
    with pytest.raises(S.SchemaMismatch):
        S.align(landing.drop("c"), gold, fill_null=True)  # two apart against two shared
    extra = landing.withColumn("d", F.lit(9)).withColumn("e", F.lit(0))
    assert [tuple(r) for r in S.align(extra, gold).collect()] == [(2, 1, 3, 9)]


def test_type_map_edges(spark):
    rows = [("A", "NUMBER", None, None), ("B", "NUMBER", 9, 0), ("C", "NUMBER", 18, 0), ("D", "NUMBER", 12, 4),
            ("E", "TIMESTAMP(6)", None, 6), ("F", "BINARY_FLOAT", None, None), ("G", "BLOB", None, None)]
    got = S.type_map(spark.createDataFrame(rows, "COLUMN_NAME string, DATA_TYPE string, DATA_PRECISION int, DATA_SCALE int"))
    types = {r["COLUMN_NAME"]: (r["landing_type"], r["gold_type"]) for r in got.collect()}
    assert types == {"A": ("decimal(38,0)",) * 2, "B": ("int",) * 2, "C": ("bigint",) * 2, "D": ("decimal(12,4)",) * 2,
                     "E": ("string", "timestamp_ntz"), "F": ("float",) * 2, "G": ("string",) * 2}


def test_guarded_drop(spark):
    name, path = gold_name(spark, "t_drop")
    sinks.land_append(spark.range(10), path)
    sinks.register_external(spark, name, path)
    assert not sinks.guarded_drop(spark, name, below=10)
    assert spark.table(name).count() == 10
    assert sinks.guarded_drop(spark, name, below=11)
    assert not spark.catalog.tableExists(name) and not sinks.path_exists(spark, path)


# --- profile -----------------------------------------------------------------

def test_load_pattern(spark):
    even = spark.createDataFrame([(i, 10) for i in range(20)], "v int, n long")
    row = R.load_pattern(even, "v", "n").first()
    assert (row["is_chunked"], row["is_chrono"]) == (False, True)  # ties go to the smallest value
    spiky = spark.createDataFrame([(i, 10 + i % 3) for i in range(20)] + [(99, 5000)], "v int, n long")
    row = R.load_pattern(spiky, "v", "n").first()
    assert (row["is_chunked"], row["is_chrono"], row["high_freq"]) == (True, False, 99)


def test_widen(spark):
    df = spark.createDataFrame([(1234, 1234), (0, 0), (5, 99), (1000, 1000), (-7, -3)], "lo int, hi int")
    got = [(r["wide_lo"], r["wide_hi"]) for r in R.widen_range(df).collect()]
    assert [round(a, 6) for a, _ in got] == [0, 0, 4, 0, -7]
    assert [round(b, 6) for _, b in got] == [2000, 0, 100, 2000, -3]


def test_split_viable(spark):
    lopsided = spark.createDataFrame([(0,), (1,), (100,)], "k int")
    assert R.split_viable(lopsided, "k").first()["viable"]
    assert not R.split_viable(lopsided, "k", 0, 1000).first()["viable"]
    assert not R.split_viable(lopsided.limit(0), "k").collect()[0]["viable"]


def test_profile_sketch_is_near_exact(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    exact = {r["column_name"]: r for r in R.column_profile(lines, exact=True).collect()}
    for r in R.column_profile(lines).collect():
        e = exact[r["column_name"]]
        assert r["num_distinct"] == pytest.approx(e["num_distinct"], rel=0.15)
        assert (r["num_nulls"], r["low_value"], r["high_value"]) == (e["num_nulls"], e["low_value"], e["high_value"])


def test_small_domains(spark):
    df = spark.range(1000).select((F.col("id") % 199).alias("near"), (F.col("id") % 200).alias("over"), "id")
    got = A.small_domain_values(df, ["near", "over", "id"], 200)
    assert got.select("column_name").distinct().collect()[0][0] == "near" and got.count() == 199
    assert A.small_domain_values(df, ["id"], 200).count() == 0


# --- catalogue and reports -----------------------------------------------------

def test_search_classes(spark):
    listed = spark.createDataFrame(
        [("FIN", "ORDERS", "Table"), ("FIN", "ORDER_LINES", "Table"), ("HR", "STAFF", "Table"), ("HR2", "FIN_VIEW", "View")],
        "db string, table_name string, type string")
    got = {(r["term"], r["match_class"], r["table_name"]) for r in C.catalogue_search(listed, ["orders", "Fin", "STAF", "hr", "order", "r2"]).collect()}
    assert ("orders", 1, "ORDERS") in got
    assert {g for g in got if g[0] == "fin"} == {("fin", 2, "ORDERS"), ("fin", 2, "ORDER_LINES")}
    assert ("staf", 3, "STAFF") in got and ("hr", 2, "STAFF") in got and ("r2", 4, "FIN_VIEW") in got
    assert not [g for g in got if g[0] == "order"]  # two partial hits and no owner


def test_remap_needs_a_majority(spark):
    df = spark.createDataFrame([("a", "x"), ("B", "y"), ("zz", "z"), (None, "w")], "c string, d string")
    mapping = spark.createDataFrame([("A", "one"), ("b", "two")], "search string, replace string")
    same = C.majority_remap(df, mapping).collect()
    assert [tuple(r) for r in same] == [("A", "X"), ("B", "Y"), ("ZZ", "Z"), (None, "W")]  # exactly half is not enough
    done = C.majority_remap(df.filter("c IS NOT NULL"), mapping, required="c")
    assert sorted(tuple(r) for r in done.collect()) == [("one", "X"), ("two", "Y")]


def test_balance(spark):
    rows = [("even", "10MB"), ("even", "11MB"), ("odd", "1B"), ("odd", "1GB"), ("odd", "2KB"), ("single", "5.5KB")]
    got = {r["table_name"]: r["in_balance"] for r in T.storage_balance(spark.createDataFrame(rows, "table_name string, size_text string")).collect()}
    assert got == {"even": True, "odd": False, "single": True}


def test_stats_csv(spark, tmp_path):
    (tmp_path / "ALL_TABLES.csv").write_text("OWNER,NUM_ROWS\nFIN,10\nHR,20\n")
    (tmp_path / "ALL_VIEWS.csv").write_text("OWNER,NUM_ROWS\nFIN,1\n")
    (tmp_path / "notes.txt").write_text("not a table")
    df = files.scan_stats_csv(spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == [("FIN", 1, "ALL_VIEWS"), ("FIN", 10, "ALL_TABLES"), ("HR", 20, "ALL_TABLES")]


def test_text_scan_and_file_sizes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.log").write_text("one\ntwo\n")
    (tmp_path / "y.log").write_text("three\n")
    assert sorted(r["line"] for r in files.scan_text(spark, str(tmp_path)).collect()) == ["one", "three", "two"]
    assert sorted(r["bytes"] for r in files.scan_file_sizes(spark, str(tmp_path)).collect()) == [6, 8]


def test_many_new_keys_use_a_join(spark):
    from tidelake.operators.joins import filter_by_keys

    df, keys = spark.range(100), spark.range(20, 60)
    few = filter_by_keys(df, F.col("id"), keys, "id", limit=100)
    many = filter_by_keys(df, F.col("id"), keys, "id", limit=10)
    assert few.count() == many.count() == 40
    assert filter_by_keys(df, F.col("id"), keys.limit(0), "id").isEmpty()
    typed = spark.range(9).select(
        F.col("id").cast("string").cast("binary").alias("b"), (F.col("id") / 7).alias("d"), (F.col("id") % 2 == 0).alias("t"),
        F.col("id").cast("decimal(9,2)").alias("n"), F.timestamp_micros(F.col("id") * 1234567891).alias("s"))
    for c in typed.columns:
        assert filter_by_keys(typed, F.col(c), typed.limit(5).select(c), c).count() >= 5
    odd = spark.createDataFrame([("it's",), ("a\\b",), ("${v}\n",), ("plain",), (None,)], "k string")
    assert filter_by_keys(odd, F.col("k"), odd, "k").count() == filter_by_keys(odd, F.col("k"), odd, "k", limit=1).count() == 4


def test_semi_and_anti_joins_split_a_hot_key(spark):
    from tidelake.operators.joins import keys_in, keys_not_in

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB"}
    before = {k: spark.conf.get(k) for k in conf}
    rows = spark.range(600_000).repartition(8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
    keys = spark.range(5000).repartition(8).select((F.col("id") % 2500 * 2 + 1).alias("k"))
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        for found, want in ((keys_in(rows, keys, "k"), 400_000), (keys_not_in(rows, keys, "k"), 200_000)):
            counted = found.agg(F.count("v"), F.max("v"))
            assert counted.collect()[0][0] == want
            assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


# --- the daily update -----------------------------------------------------------

def test_daily_update_statuses(spark):
    from tidelake.plans import daily

    base = D(2020, 1, 1)
    source = spark.range(3000).select("id", F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(id % 60, 13)").alias("ts"))
    lake, ledger = scratch_path(spark, "lake"), scratch_path(spark, "ledger")
    upto = lambda n: source.filter(P.compare("ts", base + dt.timedelta(days=n), "<"))
    sinks.land_append(upto(40), lake)
    run = lambda s, **kw: daily.daily_update(spark, s, lake, ledger, "ts", **kw)
    first = run(upto(51))
    assert (first.status, first.dates, first.done, first.not_done) == ("COMPLETE", 10, 10, 0)
    assert spark.read.parquet(lake).count() == 50 * 50  # the newest day waits
    assert run(upto(51)).reason == "NOTHING_NEW"
    late = lambda slices: daily.rows_in(upto(54), slices)
    partial = run(upto(56), read=late)  # days 50 to 54 are due, the last one does not come
    assert (partial.status, partial.done, partial.not_done) == ("PARTIAL", 4, 1)
    again = run(upto(57))
    assert (again.status, again.dates) == ("COMPLETE", 2)
    I.update_ledger(spark, ledger, spark.createDataFrame([(base + dt.timedelta(days=56), "incoming")], I.LEDGER_SCHEMA))
    stopped = run(source)
    assert (stopped.status, stopped.reason) == ("STOP", "REPEATED_INCOMING")
    states = {r["key_date"]: r["state"] for r in I.read_ledger(spark, ledger).collect()}
    assert states[base + dt.timedelta(days=54)] == "landed"
    rows = spark.read.parquet(lake)
    assert rows.count() == rows.distinct().count() == 56 * 50


def test_daily_update_does_not_reload_days_between_new_ones(spark):
    from tidelake.plans import daily

    source = spark.range(300).select("id", F.expr("date_add(date'2020-01-01', cast(id % 30 as int))").alias("day"))
    lake, ledger = scratch_path(spark, "lake"), scratch_path(spark, "ledger")
    sinks.land_append(source.filter("day(day) NOT IN (10, 13)"), lake)
    assert daily.daily_update(spark, source, lake, ledger, "day").status == "COMPLETE"
    rows = spark.read.parquet(lake)
    assert rows.count() == rows.distinct().count() == 300


# --- slices as events, dense ranks, letter triples ----------------------------

@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 40])
def test_swept_slices_agree_with_a_test_of_every_slice(spark, rows_per_bucket):
    rng = random.Random(9)
    spans = [(rng.choice([None, rng.randrange(300)]), rng.choice([None, rng.randrange(300)])) for _ in range(120)] + [(7, 7), (9, 3)]
    points = [rng.randrange(300) for _ in range(40)]
    slices = spark.createDataFrame(
        [(a, b, None, False) for a, b in spans] + [(None, None, p, None) for p in points] + [(None, None, None, True)] * 2,
        "from_key long, to_key long, point long, no_key boolean")
    keys = [rng.randrange(-5, 320) for _ in range(900)] + [None] * 5
    df = spark.createDataFrame([(k,) for k in keys], "k long")

    def held(k):
        if k is None:
            return 2
        return sum((a is None or a <= k) and (b is None or k < b) for a, b in spans) + points.count(k)

    want = Counter(held(k) for k in keys)
    got = L.coverage_of(df, "k", slices, rows_per_bucket)
    assert {r["slices_holding"]: r["rows"] for r in got.collect()} == want
    inside = L.rows_in_slices(df, "k", slices.filter("point IS NOT NULL"), rows_per_bucket)
    assert sorted(r["k"] for r in inside.collect()) == sorted(k for k in keys if k in points)


def test_a_hundred_thousand_slices(spark):
    n = 100_000
    slices = spark.range(n).select((F.col("id") * 3).alias("from_key"), (F.col("id") * 3 + 2).alias("to_key"))
    df = spark.range(3 * n).select(F.col("id").alias("k"))
    got = {r["slices_holding"]: r["rows"] for r in L.coverage_of(df, "k", slices, rows_per_bucket=50_000).collect()}
    assert got == {1: 2 * n, 0: n}
    assert L.rows_in_slices(df, "k", slices).filter("k % 3 = 2").isEmpty()


def test_slices_of_days_and_no_slices(spark):
    df = days(spark, D(2020, 1, 1), D(2020, 1, 2), None)
    none = spark.createDataFrame([], "from_key date, to_key date")
    assert [tuple(r) for r in L.coverage_of(df, "day", none).collect()] == [(0, 3)]
    assert L.rows_in_slices(df, "day", none).isEmpty()
    one = spark.createDataFrame([(D(2020, 1, 2), None)], "from_key date, to_key date")
    assert [r["day"] for r in L.rows_in_slices(df, "day", one).collect()] == [D(2020, 1, 2)]
    assert L.coverage_of(df.limit(0), "day", one).isEmpty()


def test_dense_ranks_over_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([None, f"v{rng.randrange(400):03d}"])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v string")
    want = {}
    for k in "abc":
        for n, v in enumerate(sorted({v for x, v in rows if x == k and v is not None}), 1):
            want[k, v] = n
    for partitions in (1, 5, 40):
        got = O.dense_ranks(df, ["k"], "v", "rank", partitions).collect()
        assert len(got) == len(want) and {(r["k"], r["v"]): r["rank"] for r in got} == want
    assert {r["v"]: r["rank"] for r in O.dense_ranks(df.select("v"), [], "v", "rank", 4).collect()} == {
        v: n for n, v in enumerate(sorted({v for _, v in rows if v is not None}), 1)}


def test_drift_of_a_column_with_very_many_partitions(spark):
    n = 200_000
    ranges = spark.range(n).select(
        F.col("id").cast("string").alias("partition"), F.lit("c").alias("column_name"), F.concat(F.lit("t"), F.col("id") % 1000).alias("lo_text"),
        F.concat(F.lit("u"), F.col("id") % 1000).alias("hi_text"), F.lit(None).cast("double").alias("lo_num"), F.lit(None).cast("double").alias("hi_num"))
    row = R.partition_drift(ranges, rows_per_bucket=20_000).first()
    # ranks 1 to 1000, equally often: median 500.5, scaled MAD 250 * 1.4826
    mad, med = 250 * 1.4826, 500.5
    want = (math.exp(-10 * mad / med) + math.exp(-10 * (2 * mad / med))) / 2
    assert row["column_name"] == "c" and abs(row["drift"] - want) < 1e-9


def test_search_by_letter_triples_equals_the_scan(spark):
    rows = [("Sales", "Orders"), ("Sales", "orders_2020"), ("HR", "people"), ("sal", "a"), ("Ops", "Straße"), ("Ops", "ab_ab"), (None, "alone"), ("Ops", None), ("HR", "people"), ("", "x")]
    catalogue = spark.createDataFrame(rows, "db string, table_name string")
    terms = ["orders", "sal", "SALES", "people", "a", "ab", "ab_ab", "ß", "e", "zzz", "der", "orders_2020", "alone", "o", "", "raß", "peoplex"]
    want = sorted(map(tuple, C.catalogue_search(catalogue, terms).collect()), key=repr)
    asked = spark.createDataFrame([(t,) for t in [*terms, "ORDERS", None]], "term string")
    assert sorted(map(tuple, catalogue_search_indexed(catalogue, asked).collect()), key=repr) == want
    assert catalogue_search_indexed(catalogue, asked.limit(0)).isEmpty()
    assert catalogue_search_indexed(catalogue.limit(0), asked).isEmpty()


def test_search_by_numbers_makes_no_list_of_candidates(spark):
    names = spark.range(2000).select(F.concat(F.lit("Own"), F.col("id") % 3).alias("db"), F.concat(F.lit("bolt_"), F.col("id") + 10_000).alias("table_name"))
    catalogue = names.union(spark.createDataFrame([("Own1", "ababa"), ("x", "twice"), ("y", "twice"), ("twice", "z"), ("q", None), (None, "11_999")], "db string, table_name string"))
    terms = [*map(str, range(9_990, 12_000, 3)), "aba", "twice", "wice", "own1", "wn", "bolt_11999", "bolt_1", "_11999", "11999", "1", "", "nowhere", "x"]
    want = sorted(map(tuple, C.catalogue_search(catalogue, terms).collect()), key=repr)
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    index = name_index(catalogue)
    assert index.count() == 2000 + 4 + 7  # tables, owners: each name once
    for i in (None, index):
        assert sorted(map(tuple, catalogue_search_indexed(catalogue, asked, i).collect()), key=repr) == want
    # a name has a run per place and length at most, however many terms share letters with it
    numbers = asked.filter("term RLIKE '^[0-9]{4,5}$'")
    runs = runs_of(index.filter("kind = 'table'"), numbers)
    assert runs.count() <= 2000 * 3 and runs.filter("gram = '11997'").count() == 1


def test_spread_of_few_equals_spread_of(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), float(rng.randrange(50))) for _ in range(301)] + [("c", 4.0), ("d", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    few = {r["k"]: r for r in A.spread_of_few(df, "x", ["k"]).collect()}
    want = {r["k"]: r for r in A.spread_of(df, "x", ["k"]).collect()}
    assert set(few) == set(want) == {"a", "b", "c", None}
    for k, r in want.items():
        for c in ("n", "trimmed_mean", "median", "mad", "sd"):
            assert few[k][c] == pytest.approx(r[c]), (k, c)


def test_analysis_takes_few_jobs(spark, sf):
    from tidelake.plans.imports import analyse

    orders = spark.read.parquet(f"{sf}/orders.parquet")
    context = spark.sparkContext
    for exact, most in ((False, 14), (True, 18)):
        group = f"analysis {exact}"
        context.setJobGroup(group, group)
        found = analyse(orders, partition="o_orderdate", partition_by=F.year("o_orderdate"), rows_per_split=100, exact=exact)
        jobs = len(context.statusTracker().getJobIdsForGroup(group))
        context.setLocalProperty("spark.jobGroup.id", None)
        assert found.split_key and jobs <= most, jobs
