"""Landing, incremental loads, the date ledger and the poll."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered import register
from registered.inputs import CUTOFF, PART_SQL, order_days, table
from tidelake.functions.predicates import compare
from tidelake.operators import profile as P
from tidelake.operators.joins import filter_by_keys
from tidelake.plans import daily
from tidelake.plans import incremental as I
from tidelake.session import scratch_path
from tidelake.sources import files as S
from tidelake.sources import sinks as K
from tidelake.streaming import poll


@register("land_append", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def land_append(spark, sf):
    path = scratch_path(spark, "landing")
    orders = table(spark, sf, "orders")
    K.land_append(orders.filter(compare("o_orderdate", CUTOFF, "<")), path)
    K.land_append(orders.filter(compare("o_orderdate", CUTOFF, ">=")), path, compression="none")
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_orderdate")


@register("land_sample", """
SELECT least(count(*), 1000) AS landed, least(count(*), 1000) AS known FROM orders""")
def land_sample(spark, sf):
    path = scratch_path(spark, "sample")
    orders = table(spark, sf, "orders")
    K.land_sample(orders, path, 10)
    K.land_sample(orders, path, 1000)
    sample = spark.read.parquet(path)
    # the sample's few keys reduce the orders before anything is shuffled
    known = filter_by_keys(orders, F.col("o_orderkey"), sample, "o_orderkey")
    return sample.agg(F.count(F.lit(1)).alias("landed")).join(known.agg(F.countDistinct("o_orderkey").alias("known")), F.lit(True))


@register("text_null_roundtrip", """
SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 10 = 4 THEN '' ELSE text END AS text,
       ' "' || lang || '", ' || chr(92) || source || chr(10) || chr(92) AS note, CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS n_chars FROM documents""")
def text_null_roundtrip(spark, sf):
    path = scratch_path(spark, "text")
    key = F.col("doc_id") % 10
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.when(key == 3, None).when(key == 4, "").otherwise(F.col("text")).alias("text"),
        F.concat(F.lit(' "'), "lang", F.lit('", \\'), "source", F.lit("\n\\")).alias("note"),
        F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("n_chars"),
    )
    K.write_text(rows, path)
    return K.read_text(spark, path, rows.schema)


@register("scan_text", """
SELECT o_orderkey || '|' || o_orderpriority AS line FROM orders""")
def scan_text(spark, sf):
    path = scratch_path(spark, "lines")
    lines = table(spark, sf, "orders").select(
        F.concat_ws("|", "o_orderkey", "o_orderpriority").alias("value"), "o_orderstatus"
    )
    lines.write.partitionBy("o_orderstatus").text(path)
    return S.scan_text(spark, path).select("line")


_STATS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS data_type, count(*) - count({c}) AS num_nulls, "
    f"CAST(min({c}) AS VARCHAR) AS low_value, CAST(max({c}) AS VARCHAR) AS high_value FROM {t}"
    for t, c, kind in (("orders", "o_orderkey", "bigint"), ("orders", "o_orderpriority", "string"),
                       ("lineitem", "l_suppkey", "bigint"), ("lineitem", "l_returnflag", "string"))
)


@register("scan_stats_csv", _STATS_SQL)
def scan_stats_csv(spark, sf):
    path = scratch_path(spark, "stats")
    for name, columns in (("orders", ["o_orderkey", "o_orderpriority"]), ("lineitem", ["l_suppkey", "l_returnflag"])):
        profile = P.column_profile(table(spark, sf, name), columns)
        K.write_stats_csv(profile.select("column_name", "data_type", "num_nulls", "low_value", "high_value"), path, name)
    return S.scan_stats_csv(spark, path).withColumn("num_nulls", F.col("num_nulls").cast("bigint"))


@register("incr_watermark", """
SELECT 'rows' AS what, o_orderkey, o_orderdate FROM orders
UNION ALL SELECT 'second run: UP_TO_DATE', -1, NULL""")
def incr_watermark(spark, sf):
    path = scratch_path(spark, "lake")
    source = table(spark, sf, "orders")
    K.land_append(source.filter(compare("o_orderdate", CUTOFF, "<=")), path)
    I.load_by_watermark(source, path, "o_orderdate")
    again = I.load_by_watermark(source, path, "o_orderdate")
    rows = spark.read.parquet(path).select(F.lit("rows").alias("what"), "o_orderkey", "o_orderdate")
    note = rows.agg(F.lit(f"second run: {again}").alias("what"), F.lit(-1).cast("bigint").alias("o_orderkey"),
                    F.lit(None).cast("timestamp_ntz").alias("o_orderdate"))
    return rows.unionByName(note)


@register("incr_watermark_timed", """
WITH top AS (SELECT date_trunc('second', max(ts)) AS s FROM events WHERE ts < TIMESTAMP '2024-01-20 12:00:00')
SELECT event_id, ts FROM events, top WHERE ts < TIMESTAMP '2024-01-20 12:00:00' OR ts >= s + INTERVAL 1 SECOND""")
def incr_watermark_timed(spark, sf):
    path = scratch_path(spark, "lake")
    source = table(spark, sf, "events").select("event_id", "ts")
    K.land_append(source.filter(compare("ts", "2024-01-20 12:00:00", "<")), path)
    for _ in range(2):
        I.load_by_watermark(source, path, "ts", timed=True)
    return spark.read.parquet(path)


@register("incr_partitions", f"""
SELECT {PART_SQL.format("l_linenumber")} AS part, l_orderkey, l_linenumber, l_partkey FROM lineitem""")
def incr_partitions(spark, sf):
    path = scratch_path(spark, "lake")
    source = table(spark, sf, "lineitem").selectExpr(f"{PART_SQL.format('l_linenumber')} AS part", "l_orderkey", "l_linenumber", "l_partkey")
    K.land_append(source.filter("part IN ('1', 'n/a')"), path)
    for _ in range(3):
        I.load_new_partitions(source, path, "part")
    return spark.read.parquet(path)


@register("incr_watermark_landed", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate IS NOT NULL
UNION ALL SELECT -1, 'n/a' UNION ALL SELECT -2, NULL UNION ALL SELECT -3, '99-1-1'""")
def incr_watermark_landed(spark, sf):
    """A lake of text days, some not padded and some unreadable, against a typed source."""
    path = scratch_path(spark, "lake")
    orders = table(spark, sf, "orders").filter("o_orderdate IS NOT NULL")
    plain = F.date_format("o_orderdate", "yyyy-M-d")
    early = orders.filter(compare("o_orderdate", CUTOFF, "<="))
    odd = spark.createDataFrame([(-1, "n/a"), (-2, None), (-3, "99-1-1")], "o_orderkey bigint, day string")
    K.land_append(early.select("o_orderkey", plain.alias("day")).union(odd), path)
    for _ in range(2):
        rows = I.rows_after_watermark(orders.withColumn("day", F.col("o_orderdate")), spark.read.parquet(path), "day", landed=True)
        K.land_append(rows.select("o_orderkey", plain.alias("day")), path)
    lake = spark.read.parquet(path)
    return lake.select("o_orderkey", F.when(F.col("o_orderkey") < 0, F.col("day")).otherwise(F.date_format(F.to_date("day", "y-M-d"), "yyyy-MM-dd")).alias("day"))


# Source days, a lake without every seventh, a ledger that knows some of those, some incoming last time.
_DAYS_SQL = """source AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
lake AS (SELECT day FROM source WHERE day(day) % 7 <> 0),
tracked AS (SELECT day FROM source WHERE day(day) % 7 <> 0 OR year(day) < 1998),
newest AS (SELECT max(day) AS day FROM source),
new_ AS (SELECT day FROM source WHERE day < (SELECT day FROM newest) AND day NOT IN (SELECT day FROM lake) AND day NOT IN (SELECT day FROM tracked))"""


def _days(spark, sf):
    source = order_days(spark, sf).distinct()
    lake = source.filter("day(day) % 7 <> 0")
    tracked = source.filter("day(day) % 7 <> 0 OR year(day) < 1998")
    return source, lake, tracked


@register("ledger_new_dates", f"WITH {_DAYS_SQL} SELECT day FROM new_")
def ledger_new_dates(spark, sf):
    source, lake, tracked = _days(spark, sf)
    return I.new_ledger_dates(source, lake, tracked, "day")


@register("ledger_guards", f"""
WITH {_DAYS_SQL}, few AS (SELECT day FROM new_ WHERE month(day) = 2 AND year(day) = 1999),
n AS (SELECT (SELECT count(*) FROM lake) AS lake_dates, (SELECT count(*) FROM tracked) AS tracked_dates, (SELECT count(*) FROM new_) AS new_dates,
             (SELECT count(*) FROM few) AS few_dates, (SELECT count(*) FROM source) AS all_dates)
SELECT 'all' AS run, lake_dates, tracked_dates, new_dates, 0::BIGINT AS repeated_dates,
  CASE WHEN new_dates > 20 THEN 'TOO_MANY_DATES' WHEN lake_dates < tracked_dates THEN 'FEWER_LAKE_DATES' WHEN new_dates = 0 THEN 'NOTHING_NEW' ELSE 'READY' END AS reason,
  CASE WHEN new_dates > 20 THEN 'STOP' WHEN lake_dates < tracked_dates THEN 'WARN' ELSE 'OK' END AS status FROM n
UNION ALL SELECT 'few', lake_dates, tracked_dates, few_dates, 0, CASE WHEN lake_dates < tracked_dates THEN 'FEWER_LAKE_DATES' ELSE 'READY' END, CASE WHEN lake_dates < tracked_dates THEN 'WARN' ELSE 'OK' END FROM n
UNION ALL SELECT 'again', lake_dates, lake_dates, few_dates, few_dates, CASE WHEN few_dates > 0 THEN 'REPEATED_INCOMING' ELSE 'NOTHING_NEW' END, CASE WHEN few_dates > 0 THEN 'STOP' ELSE 'OK' END FROM n
UNION ALL SELECT 'ready', lake_dates, lake_dates, few_dates, 0, CASE WHEN few_dates > 0 THEN 'READY' ELSE 'NOTHING_NEW' END, 'OK' FROM n
UNION ALL SELECT 'empty', 0, 0, few_dates, 0, 'NO_DATES', 'STOP' FROM n
UNION ALL SELECT 'no lake', 0, tracked_dates, few_dates, 0, 'LAKE_EMPTY', 'WARN' FROM n""")
def ledger_guards(spark, sf):
    source, lake, tracked = _days(spark, sf)
    new = I.new_ledger_dates(source, lake, tracked, "day")
    few = new.filter("month(day) = 2 AND year(day) = 1999")
    none = source.filter("day IS NULL")
    runs = {
        "all": (lake, tracked, none, new),
        "few": (lake, tracked, none, few),
        "again": (lake, lake, few, few),
        "ready": (lake, lake, none, few),
        "empty": (none, none, none, few),
        "no lake": (none, tracked, none, few),
    }
    out = None
    for run, (a, b, c, d) in runs.items():
        row = I.ledger_guards(a, b, c, d, "day").select(F.lit(run).alias("run"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@register("verify_load", f"""
WITH {_DAYS_SQL}, i AS (SELECT * FROM new_), t AS (SELECT max(day) AS top, min(day) AS low FROM i)
SELECT 'complete' AS run, (SELECT count(*) FROM i) AS done, 0::BIGINT AS not_done, 'COMPLETE' AS status
UNION ALL SELECT 'partial', (SELECT count(*) FROM i) - 1, 1, 'PARTIAL'
UNION ALL SELECT 'gap', (SELECT count(*) FROM i) - 1, 1, 'FAILED'
UNION ALL SELECT 'nothing came', 0, (SELECT count(*) FROM i), 'FAILED'
UNION ALL SELECT 'nothing due', 0, 0, 'NOTHING'""")
def verify_load(spark, sf):
    source, lake, tracked = _days(spark, sf)
    new = I.new_ledger_dates(source, lake, tracked, "day")
    low, top = new.agg(F.min("day"), F.max("day")).first()
    runs = {
        "complete": (new, source),
        "partial": (new, source.filter(F.col("day") != top)),
        "gap": (new, source.filter(F.col("day") != low)),
        "nothing came": (new, lake),
        "nothing due": (new.filter("day IS NULL"), source),
    }
    out = None
    for run, (incoming, there) in runs.items():
        row = I.verify_load(incoming, there, "day").select(F.lit(run).alias("run"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@register("verify_dates", f"""
WITH {_DAYS_SQL}, i AS (SELECT * FROM new_)
SELECT day, CASE WHEN day(day) = 14 THEN 'NOT_DONE' ELSE 'DONE' END AS state FROM i""")
def verify_dates(spark, sf):
    source, lake, tracked = _days(spark, sf)
    new = I.new_ledger_dates(source, lake, tracked, "day")
    return I.verify_dates(new, source.filter("day(day) <> 14"), "day")


@register("keyed_upsert", """
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 1000
UNION ALL SELECT c_custkey, 'new', c_acctbal - 1 FROM customer WHERE c_acctbal < 1000
UNION ALL SELECT -1 - c_custkey, 'new', 0.0 FROM customer WHERE c_acctbal > 9000""")
def keyed_upsert(spark, sf):
    path = scratch_path(spark, "keyed")
    old = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    K.replace_folder(old, path)
    changed = old.filter("c_acctbal < 1000").select("c_custkey", F.lit("new").alias("c_name"), (F.col("c_acctbal") - 1).alias("c_acctbal"))
    added = old.filter("c_acctbal > 9000").select((-1 - F.col("c_custkey")).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    for rows in (changed, added, changed):
        K.replace_folder(I.keyed_upsert(spark.read.parquet(path), rows, ["c_custkey"]), path)
    return spark.read.parquet(path)


@register("poll_available_now", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def poll_available_now(spark, sf):
    source, target, state = (scratch_path(spark, n) for n in ("polled", "target", "state"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    for part in ("o_totalprice < 200000", "o_totalprice >= 200000"):
        orders.filter(part).write.mode("append").parquet(source)
        poll.poll_landing(spark, source, orders.schema, target, state)
    return poll.read_polled(spark, target)


@register("daily_update", """
WITH source AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
due AS (SELECT day FROM source WHERE day(day) = 14 AND year(day) >= 2000 AND day < (SELECT max(day) FROM source))
SELECT 'COMPLETE/READY/' || (SELECT count(*) FROM due) || ', OK/NOTHING_NEW/0' AS runs, year(o_orderdate)::INT AS year, count(*) AS rows
FROM orders GROUP BY 2""")
def daily_update(spark, sf):
    lake, ledger = scratch_path(spark, "lake"), scratch_path(spark, "ledger")
    source = table(spark, sf, "orders")
    K.land_append(source.filter("day(o_orderdate) <> 14 OR year(o_orderdate) < 2000"), lake)
    ended = [daily.daily_update(spark, source, lake, ledger, "o_orderdate") for _ in range(2)]
    runs = ", ".join(f"{r.status}/{r.reason}/{r.dates}" for r in ended)
    counted = spark.read.parquet(lake).groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.lit(runs).alias("runs"), "year", "rows")
