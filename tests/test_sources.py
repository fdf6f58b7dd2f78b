"""JDBC scans against Derby inside this process, and the poll with a restart."""

import datetime as dt
import threading
import time
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelake.plans import pool
from tidelake.plans import slicing as L
from tidelake.session import scratch_path
from tidelake.sources import jdbc
from tidelake.streaming import poll

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def source(spark, sf):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    orders = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")))
    orders = orders.toDF(*[c.upper() for c in orders.columns])
    text = "O_ORDERSTATUS VARCHAR(1), O_ORDERPRIORITY VARCHAR(20)"
    orders.coalesce(1).write.option("createTableColumnTypes", text).jdbc(url, "ORDERS", properties=DRIVER)
    return url, orders.count()


def test_plain(spark, source):
    url, rows = source
    df = jdbc.read_plain(spark, url, "ORDERS", DRIVER)
    assert df.count() == rows and df.rdd.getNumPartitions() == 1


@pytest.mark.parametrize("column,low,high", [("O_ORDERKEY", 0, 1500), ("O_CUSTKEY", 10, 100), ("O_ORDERDATE", "1996-01-01", "2001-01-01")])
def test_split(spark, source, column, low, high):
    url, rows = source
    df = jdbc.read_split(spark, url, "ORDERS", column, low, high, splits=8, connections=4, properties=DRIVER)
    assert df.rdd.getNumPartitions() == 4
    assert df.count() == rows and df.select("O_ORDERKEY").distinct().count() == rows


def test_predicates_from_slices(spark, source):
    url, rows = source
    ranges = spark.createDataFrame([(dt.date(1995, 1, 1), dt.date(2001, 12, 31))], "lo date, hi date")
    slices = L.to_slices(L.range_slices(ranges, 6), "O_ORDERDATE")
    df = jdbc.read_predicates(spark, url, "ORDERS", slices, properties=DRIVER)
    assert df.rdd.getNumPartitions() == 7
    assert df.count() == rows and df.select("O_ORDERKEY").distinct().count() == rows


def test_two_level_slices_keep_the_connection_limit(spark, source):
    url, rows = source
    dates = spark.createDataFrame([(dt.date(1995, 1, 1), dt.date(2001, 12, 31))], "lo date, hi date")
    keys = spark.createDataFrame([(0, 5000)], "lo long, hi long")
    first = L.to_slices(L.range_slices(dates, 5), "O_ORDERDATE", null_slice=False)
    second = L.to_slices(L.range_slices(keys, 4), "O_CUSTKEY")
    df = jdbc.read_predicates(spark, url, "ORDERS", first, second, connections=6, properties=DRIVER)
    assert df.rdd.getNumPartitions() == 6
    assert df.count() == rows and df.select("O_ORDERKEY").distinct().count() == rows


def test_point_predicates(spark, source):
    url, rows = source
    points = jdbc.read_plain(spark, url, "ORDERS", DRIVER)
    slices = L.to_slices(L.point_slices(points, "O_ORDERSTATUS"), "O_ORDERSTATUS")
    df = jdbc.read_predicates(spark, url, "ORDERS", slices, properties=DRIVER)
    assert df.count() == rows


def test_query(spark, source):
    url, rows = source
    query = "SELECT O_ORDERKEY, O_TOTALPRICE FROM ORDERS"
    df = jdbc.read_query(spark, url, query, where="O_ORDERKEY >= 100", column="O_ORDERKEY", low=100, high=1500, splits=3, properties=DRIVER)
    assert df.columns == ["O_ORDERKEY", "O_TOTALPRICE"] and df.rdd.getNumPartitions() == 3
    assert df.count() == rows - 100
    assert jdbc.read_query(spark, url, query, properties=DRIVER).count() == rows


def test_incremental_filter_reaches_the_source(spark, source):
    from tidelake.plans.incremental import rows_after_watermark

    url, _ = source
    df = jdbc.read_plain(spark, url, "ORDERS", DRIVER)
    lake = df.filter("O_ORDERDATE < '2000-01-01'")
    new = rows_after_watermark(df, lake, "O_ORDERDATE")
    assert new.count() == df.count() - lake.count() > 0
    assert "PushedFilters: [*IsNotNull(O_ORDERDATE), *GreaterThanOrEqual(O_ORDERDATE" in new._jdf.queryExecution().executedPlan().toString()


def test_poll_takes_up_where_it_stopped(spark):
    folder, target, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    rows = spark.range(100).select("id", F.col("id").cast("string").alias("t"))

    def land(low, high):
        rows.filter((F.col("id") >= low) & (F.col("id") < high)).coalesce(1).write.mode("append").parquet(folder)

    land(0, 40)
    assert poll.poll_landing(spark, folder, rows.schema, target, state) == 1
    assert poll.poll_landing(spark, folder, rows.schema, target, state) == 0
    land(40, 70)
    land(70, 100)
    assert poll.poll_landing(spark, folder, rows.schema, target, state, files_per_batch=1) == 2
    got = poll.read_polled(spark, target)
    assert got.count() == 100 and got.distinct().count() == 100


def test_poll_counts_every_batch(spark):
    folder, target, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    spark.range(105).repartition(105, "id").sortWithinPartitions("id").write.option("maxRecordsPerFile", 1).parquet(folder)
    files = len([f for f in spark.read.parquet(folder).inputFiles()])
    assert files == 105
    assert poll.poll_landing(spark, folder, spark.range(1).schema, target, state, files_per_batch=1) == 105
    assert poll.read_polled(spark, target).count() == 105


def test_scratch_needs_a_shared_folder_and_can_be_cleared(spark):
    from tidelake import session
    from tidelake.sources.sinks import path_exists

    class Bare:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(Bare)
    assert session.local_session() is not None and session.shared_root(spark)
    other = f"{scratch_path(spark, 'kept')}"
    spark.range(3).write.parquet(other)
    assert path_exists(spark, other)


# --- analysis, plan and import together ----------------------------------------

from tidelake.plans import imports as M  # noqa: E402


def _source_frame(spark, url):
    return jdbc.read_plain(spark, url, "ORDERS", DRIVER).select(
        *[F.col("O_ORDERDATE").cast("timestamp_ntz").alias("O_ORDERDATE") if c == "O_ORDERDATE" else F.col(c)
          for c in ("O_ORDERKEY", "O_CUSTKEY", "O_ORDERSTATUS", "O_TOTALPRICE", "O_ORDERDATE", "O_ORDERPRIORITY")])


@pytest.mark.parametrize("limits,style", [
    ((100_000, None), "PLAIN"),
    ((300, 100_000), "SPLIT"),
    ((100, 300), "RANGE+FIXED"),
])
def test_import_by_plan(spark, source, limits, style):
    url, rows = source
    df = _source_frame(spark, url)
    found = M.analyse(df, rows_per_split=limits[0], rows_per_job=limits[1], connections=4,
                      split_bias=["O_ORDERKEY"], job_bias=["O_ORDERDATE"], exact=True)
    assert "O_CUSTKEY" not in [r["column_name"] for r in found.scored.collect()]  # sometimes NULL
    plan = M.plan_import(df, "ORDERS", found, is_view=True)
    assert plan.style == style
    path = scratch_path(spark, "imported")
    jobs = M.run_import(spark, url, plan, path, DRIVER)
    assert jobs == max(1, len(plan.jobs))
    got = M.read_imported(spark, path)
    assert got.count() == rows and got.select("O_ORDERKEY").distinct().count() == rows
    assert M.run_import(spark, url, plan, path, DRIVER) == 0  # nothing is run twice


def test_point_and_strict_imports(spark, source):
    url, rows = source
    df = _source_frame(spark, url)
    limits = dict(rows_per_split=100, rows_per_job=300, connections=4, exact=True)
    found = M.analyse(df, job_bias=["O_ORDERSTATUS"], split_bias=["O_ORDERKEY"], **limits)
    plan = M.plan_import(df, "ORDERS", found, is_view=True, force_pointable=True)
    assert plan.style == "POINT+FIXED" and len(plan.jobs) == 4
    path = scratch_path(spark, "points")
    M.run_import(spark, url, plan, path, DRIVER)
    assert M.read_imported(spark, path).count() == rows

    same = M.analyse(df, job_bias=["O_ORDERDATE"], split_bias=["O_ORDERDATE"], **limits)
    plan = M.plan_import(df, "ORDERS", same)
    assert plan.style == "RANGE+SAME_RANGE"
    path = scratch_path(spark, "same")
    M.run_import(spark, url, plan, path, DRIVER)
    assert M.read_imported(spark, path).count() == rows

    wanted = spark.createDataFrame([(dt.date(1996, 1, 1), dt.date(1996, 3, 31)), (dt.date(1998, 5, 5), dt.date(1998, 5, 5))], "lo date, hi date")
    found = M.analyse(df, job_bias=["O_ORDERDATE"], split_bias=["O_ORDERKEY"], **limits)
    plan = M.plan_import(df, "ORDERS", found, is_view=True, strict_ranges=wanted, days_per_slice=30)
    path = scratch_path(spark, "strict")
    M.run_import(spark, url, plan, path, DRIVER)
    day = F.col("O_ORDERDATE").cast("date")
    expected = df.filter(day.between("1996-01-01", "1996-03-31") | (day == "1998-05-05")).count()
    assert M.read_imported(spark, path).count() == expected > 0


@pytest.fixture(scope="module")
def keyed(spark):
    """A Derby table with a decimal and a fractional key, some rows without."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = spark.range(900).select(
        F.when(F.col("id") % 50 != 7, F.col("id") * 3 + F.lit("0.25").cast("decimal(38,2)")).cast("decimal(28,2)").alias("K"),
        (F.col("id") * 1.5 - 100).alias("X"), F.concat(F.lit("p"), F.col("id") % 300).alias("P"), F.col("id").alias("V"),
    )
    rows.write.option("createTableColumnTypes", "P VARCHAR(20)").jdbc(url, "KEYED", properties=DRIVER)
    return url, rows


def test_decimal_and_fractional_keys_are_split(spark, keyed):
    url, rows = keyed
    df = jdbc.read_plain(spark, url, "KEYED", DRIVER)
    for key in ("K", "X"):
        low, high = df.agg(F.min(key), F.max(key)).first()
        split = jdbc.read_split(spark, url, "KEYED", key, low, high, 4, properties=DRIVER)
        assert split.rdd.getNumPartitions() == 4 and split.count() == 900
    found = M.analyse(df, rows_per_split=100, rows_per_job=300, connections=4, split_bias=["X"], job_bias=["X"], exact=True)
    plan = M.plan_import(df, "KEYED", found)
    assert plan.style == "RANGE+SAME_RANGE" and plan.splits > 1 and len(plan.jobs) > 2
    path = scratch_path(spark, "fractional")
    M.run_import(spark, url, plan, path, DRIVER)
    assert sorted(r["V"] for r in M.read_imported(spark, path).collect()) == list(range(900))
    assert L.Slice("K", low=Decimal("1.50"), high=Decimal("1E+2")).sql() == "K >= 1.50 AND K < 100"


def test_many_points_become_ranges(spark, keyed):
    url, _ = keyed
    df = jdbc.read_plain(spark, url, "KEYED", DRIVER)
    found = M.analyse(df, rows_per_split=100, rows_per_job=300, connections=4, split_bias=["X"], job_bias=["P"], exact=True)
    plan = M.plan_import(df, "KEYED", found, is_view=True, force_pointable=True)
    assert plan.style == "POINT+FIXED" and len(plan.jobs) <= 5  # 300 values in at most 3 ranges, or 4, and the NULL slice
    path = scratch_path(spark, "point-ranges")
    M.run_import(spark, url, plan, path, DRIVER)
    assert sorted(r["V"] for r in M.read_imported(spark, path).collect()) == list(range(900))


def test_slices_without_a_split_column_are_read_together(spark, keyed):
    url, _ = keyed
    slices = (L.Slice("V", high=300), L.Slice("V", low=300, high=300), L.Slice("V", low=300, high=600), L.Slice("V", low=600), L.Slice("V", no_key=True))
    plan = M.ImportPlan("KEYED", "RANGE+FIXED", connections=2, jobs=slices)
    path = scratch_path(spark, "together")
    assert M.run_import(spark, url, plan, path, DRIVER) == 5
    assert M.run_import(spark, url, plan, path, DRIVER) == 0
    got = spark.read.parquet(path).groupBy("job").count().collect()
    assert {r["job"]: r["count"] for r in got} == {0: 300, 2: 300, 3: 300}


def test_an_import_keeps_its_plan_when_the_source_grows(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    first = spark.range(600).select(F.col("id").alias("K"), F.lit("a").alias("T"))
    first.write.jdbc(url, "GROWING", properties=DRIVER)
    limits = dict(rows_per_split=100, rows_per_job=200, connections=4, split_bias=["K"], job_bias=["K"], exact=True)

    def planned():
        df = jdbc.read_plain(spark, url, "GROWING", DRIVER)
        return M.plan_import(df, "GROWING", M.analyse(df, **limits))

    plan, path = planned(), scratch_path(spark, "growing")
    assert M.plan_from_text(M.plan_text(plan)) == plan
    part = M.replace(plan, jobs=plan.jobs)
    M.run_import(spark, url, part, path, DRIVER)
    # the last job is lost, and the source has grown past the planned range
    last = len(plan.jobs) - 2
    from tidelake.sources.sinks import path_exists

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/job={last}")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    spark.range(600, 700).select(F.col("id").alias("K"), F.lit("b").alias("T")).write.mode("append").jdbc(url, "GROWING", properties=DRIVER)
    grown = planned()
    assert grown != plan
    with pytest.raises(ValueError, match="another plan"):
        M.run_import(spark, url, grown, path, DRIVER)
    assert M.stored_plan(spark, path) == plan
    assert M.run_import(spark, url, M.stored_plan(spark, path), path, DRIVER) == 1
    assert path_exists(spark, f"{path}/job={last}/_SUCCESS")
    assert sorted(r["K"] for r in M.read_imported(spark, path).collect()) == list(range(700))


def test_main_range(spark):
    numbers = spark.createDataFrame([(0,), (1,), (90,)], "k int")
    assert M.main_range(numbers, "k", True) == (0, 90, "COMPLETE")
    assert M.main_range(numbers.filter("k < 0"), "k", True) == (None, None, "UNKNOWN")
    days = spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2020, 1, 9),)], "d date")
    assert M.main_range(days, "d", False) == (dt.date(2020, 1, 1), dt.date(2020, 1, 9), "COMPLETE")


# --- jobs side by side --------------------------------------------------------

def test_jobs_share_a_limit(spark):
    lock, now, seen = threading.Lock(), [0], []

    def job(weight):
        def run():
            with lock:
                now[0] += weight
                seen.append(now[0])
            spark.range(10).count()
            time.sleep(0.1)
            with lock:
                now[0] -= weight

        return pool.Job(weight, run)

    shared = pool.run_jobs(spark, [job(w) for w in (2, 3, 1, 4, 2, 1, 3, 9)], 4)
    assert len(seen) == 8 and max(s for s in seen if s < 9) <= 4
    assert shared.free == shared.limit == 4 and shared.highest == 4
    assert max(seen[:-1]) > 2  # some ran side by side
    assert pool.run_jobs(spark, [], 3).free == 3


def test_a_failed_job_stops_those_that_have_not_started(spark):
    ran = []

    def fails():
        raise ValueError("lost")

    with pytest.raises(ValueError):
        pool.run_jobs(spark, [pool.Job(1, fails)] + [pool.Job(1, lambda n=n: ran.append(n)) for n in range(20)], 1)
    assert ran == []


def test_split_jobs_of_an_import_run_side_by_side_and_restart(spark, keyed, monkeypatch):
    url, _ = keyed
    jobs = tuple(L.Slice("V", low=a, high=a + 250) for a in range(0, 1000, 250)) + (L.Slice("V", low=1000), L.Slice("V", no_key=True))
    plan = M.ImportPlan("KEYED", "RANGE+FIXED", "K", Decimal("0.25"), Decimal("2697.25"), 2, 4, jobs)
    path = scratch_path(spark, "side-by-side")
    limits = []

    def watched(spark, todo, limit):
        shared = pool.run_jobs(spark, todo, limit)
        limits.append((len(todo), [j.weight for j in todo], shared.highest))
        return shared

    real, dying = M._run_job, iter([False, False, True])

    def dies(*args):
        if next(dying, False):
            raise RuntimeError("lost")
        real(*args)

    monkeypatch.setattr(M, "run_jobs", watched)
    with monkeypatch.context() as m:
        m.setattr(M, "_run_job", dies)
        with pytest.raises(RuntimeError):
            M.run_import(spark, url, plan, path, DRIVER)
    again = M.run_import(spark, url, plan, path, DRIVER)
    assert 1 <= again < 6
    assert limits[-1][0] == again and limits[-1][2] <= 4 and set(limits[-1][1]) <= {1, 2}
    assert M.run_import(spark, url, plan, path, DRIVER) == 0
    assert sorted(r["V"] for r in M.read_imported(spark, path).collect()) == list(range(900))
