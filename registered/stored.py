"""Facts that are kept or read from file metadata: footers, days, profiles and buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from registered import register
from registered.inputs import CATALOGUE_SQL, catalogue, table
from registered.lake import _LINE_TYPES as _GOLD_LINES
from registered.lake import _landed_lines, new_table
from registered.summaries import _LINE_TYPES, _line_profile_sql
from tidelake.operators import ordered as O
from tidelake.operators import profile as P
from tidelake.operators import reports as R
from tidelake.operators import stored_profile as SP
from tidelake.operators.trigrams import catalogue_search_indexed as catalogue_by_index
from tidelake.plans import daily
from tidelake.plans import gold as G
from tidelake.plans import slicing as S
from tidelake.plans import upsert as U
from tidelake.session import scratch_path
from tidelake.sources import blocks as B
from tidelake.sources import days as D
from tidelake.sources import footers as FF
from tidelake.sources import sinks as K

_COUNTED = ("orders", "lineitem", "customer", "events", "documents", "pages")


@register("footer_row_count", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS num_rows, true AS from_footers FROM {t}" for t in _COUNTED))
def footer_row_count(spark, sf):
    found = {t: FF.row_count(spark, f"{sf}/{t}.parquet") for t in _COUNTED}
    return reduce(lambda a, b: a.union(b), [
        r.rows.select(F.lit(t).alias("table_name"), "num_rows", F.lit(r.from_footers).alias("from_footers")) for t, r in found.items()])


# column, table, and whether footers can tell its range
_RANGED = (("o_orderkey", "orders", True), ("o_orderdate", "orders", True), ("o_orderstatus", "orders", False), ("l_linenumber", "lineitem", True),
           ("l_shipdate", "lineitem", True), ("ts", "events", True), ("user_id", "events", True), ("c_nationkey", "customer", True))


def _shown(column: str, value: str, sql: bool) -> str:
    if column in ("o_orderdate", "l_shipdate", "ts"):
        return f"strftime({value}, '%Y-%m-%d %H:%M:%S')" if sql else f"date_format({value}, 'yyyy-MM-dd HH:mm:ss')"
    return f"CAST({value} AS VARCHAR)" if sql else f"CAST({value} AS STRING)"


@register("footer_key_range", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {_shown(c, f'min({c})', True)} AS lo, {_shown(c, f'max({c})', True)} AS hi, {str(f).lower()} AS from_footers FROM {t}"
    for c, t, f in _RANGED))
def footer_key_range(spark, sf):
    out = []
    for c, t, _ in _RANGED:
        found = FF.key_range(spark, f"{sf}/{t}.parquet", c)
        out.append(found.rows.selectExpr(f"'{c}' AS column_name", f"{_shown(c, 'lo', False)} AS lo", f"{_shown(c, 'hi', False)} AS hi",
                                         f"{found.from_footers} AS from_footers"))
    return reduce(lambda a, b: a.union(b), out)


@register("footer_partition_range", """
SELECT l_linenumber, count(*) AS num_rows, min(l_orderkey) AS lo, max(l_orderkey) AS hi, true AS from_footers FROM lineitem GROUP BY 1""")
def footer_partition_range(spark, sf):
    """Rows and range of each partition of a folder, of which no page is read again."""
    path = scratch_path(spark, "by-line")
    table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber").repartition("l_linenumber").write.partitionBy("l_linenumber").parquet(path)
    counts = FF.row_count(spark, path, ["l_linenumber"])
    ranges = FF.key_range(spark, path, "l_orderkey", ["l_linenumber"], confirm=False)
    return counts.rows.join(ranges.rows, "l_linenumber").withColumn("from_footers", F.lit(counts.from_footers and ranges.from_footers))


@register("footer_watermark", """
SELECT 'o_orderdate' AS column_name, CAST(max(o_orderdate) AS DATE) AS watermark, true AS from_footers FROM orders
UNION ALL SELECT 'l_shipdate', CAST(max(l_shipdate) AS DATE), true FROM lineitem
UNION ALL SELECT 'ts', CAST(max(ts) AS DATE), true FROM events""")
def footer_watermark(spark, sf):
    found = {c: FF.watermark(spark, f"{sf}/{t}.parquet", c) for c, t in (("o_orderdate", "orders"), ("l_shipdate", "lineitem"), ("ts", "events"))}
    return reduce(lambda a, b: a.union(b), [
        r.rows.select(F.lit(c).alias("column_name"), F.col("watermark").cast("date").alias("watermark"), F.lit(r.from_footers).alias("from_footers"))
        for c, r in found.items()])


@register("profile_merged", f"""
SELECT column_name, data_type, within_error, num_nulls, is_null_ever, avg_col_len, low_value, high_value, 3 AS profiled_first, 3 + 5 AS runs
FROM ({_line_profile_sql()}) WHERE column_name <> 'l_linenumber'""")
def profile_merged(spark, sf):
    """A profile merged from partitions that came in three loads; the last one brings a partition anew and deletes none.

    Distinct values are within four standard errors of the sketch; all else is exact.
    """
    path, store = scratch_path(spark, "profiled"), scratch_path(spark, "profiles")
    lines = table(spark, sf, "lineitem")

    def land(rows):
        rows.repartition("l_linenumber").write.mode("append").partitionBy("l_linenumber").parquet(path)

    land(lines.filter("l_linenumber <= 2 OR l_linenumber = 3 AND l_orderkey % 2 = 0"))
    first = SP.refresh(spark, store, path, "l_linenumber").count()
    land(lines.filter("l_linenumber > 3 OR l_linenumber = 3 AND l_orderkey % 2 <> 0"))
    stored = SP.refresh(spark, store, path, "l_linenumber")
    runs = spark.read.parquet(store).count()
    merged = SP.merged_profile(stored)
    columns = [c for c in _LINE_TYPES if c != "l_linenumber"]
    exact = lines.agg(*[F.count_distinct(c).alias(c) for c in columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in columns]))
    error = 4 * 1.04 / 2 ** (SP.SKETCH_BITS / 2)
    near = F.abs(F.col("num_distinct") - F.col("n")) <= F.greatest(error * F.col("n"), F.lit(1.0))
    return merged.join(exact.select(cells.alias("c")).select("c.*"), "column_name").select(
        "column_name", "data_type", near.alias("within_error"), "num_nulls", "is_null_ever", F.round("avg_col_len", 6).alias("avg_col_len"),
        "low_value", "high_value", F.lit(first).cast("int").alias("profiled_first"), F.lit(runs).cast("int").alias("runs"),
    )


@register("stored_partition_ranges", """
SELECT CAST(l_linenumber AS VARCHAR) AS partition, 'l_orderkey' AS column_name, CAST(min(l_orderkey) AS VARCHAR) AS lo_text, CAST(max(l_orderkey) AS VARCHAR) AS hi_text,
       CAST(min(l_orderkey) AS DOUBLE) AS lo_num, CAST(max(l_orderkey) AS DOUBLE) AS hi_num FROM lineitem GROUP BY 1
UNION ALL SELECT CAST(l_linenumber AS VARCHAR), 'l_returnflag', min(l_returnflag), max(l_returnflag), NULL, NULL FROM lineitem GROUP BY 1""")
def stored_partition_ranges(spark, sf):
    """The input of the drift score, from stored profiles."""
    path, store = scratch_path(spark, "ranged"), scratch_path(spark, "ranges")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber")
    lines.repartition("l_linenumber").write.partitionBy("l_linenumber").parquet(path)
    return SP.stored_ranges(SP.refresh(spark, store, path, "l_linenumber"), ["l_orderkey", "l_returnflag"])


@register("day_states", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS num_rows FROM events GROUP BY 1)
SELECT day, CASE day(day) WHEN 7 THEN 'TORN' WHEN 9 THEN 'LOST' ELSE 'WHOLE' END AS state, CASE WHEN day(day) <> 7 THEN num_rows END AS num_rows FROM d""")
def day_states(spark, sf):
    """All days of events landed by day; one then comes from a load that died, one is deleted, and two are loaded again."""
    path = scratch_path(spark, "events-by-day")
    events = table(spark, sf, "events")
    day = F.dayofmonth("ts")
    D.land_days(events.filter(day != 7), path, F.col("ts"))
    D.land_days(events.filter(day.isin(3, 4)), path, F.col("ts"))
    torn = events.filter(day == 7).withColumn(D.DAY, F.col("ts").cast("date"))
    torn.write.mode("append").partitionBy(D.DAY).parquet(path)  # as a load leaves it that dies before its commit
    for r in events.filter(day == 9).select(F.col("ts").cast("date").alias("day")).distinct().collect():
        K.delete_path(spark, f"{path}/{D.DAY}={r['day']}")
    return D.day_states(spark, path)


@register("daily_update_by_days", """
WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), due AS (SELECT day FROM days WHERE day(day) % 10 = 4 AND day < (SELECT max(day) FROM days))
SELECT 'COMPLETE/READY/' || (SELECT count(*) FROM due) || ', OK/NOTHING_NEW/0' AS runs, CAST(ts AS DATE) AS day, count(*) AS rows FROM events GROUP BY 2""")
def daily_update_by_days(spark, sf):
    """A lake by days without some of them; known days come from its listing and manifest."""
    lake, ledger = scratch_path(spark, "lake-by-day"), scratch_path(spark, "ledger")
    source = table(spark, sf, "events")
    D.land_days(source.filter("day(ts) % 10 <> 4"), lake, F.col("ts"))
    ended = [daily.daily_update_by_days(spark, source, lake, ledger, "ts") for _ in range(2)]
    runs = ", ".join(f"{r.status}/{r.reason}/{r.dates}" for r in ended)
    return spark.read.parquet(lake).groupBy(F.lit(runs).alias("runs"), F.col(D.DAY).alias("day")).agg(F.count(F.lit(1)).alias("rows"))


@register("upsert_buckets", """
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 1000
UNION ALL SELECT c_custkey, 'new', c_acctbal - 1 FROM customer WHERE c_acctbal < 1000
UNION ALL SELECT -1 - c_custkey, 'new', 0.0 FROM customer WHERE c_acctbal > 9000""")
def upsert_buckets(spark, sf):
    """The rows of keyed_upsert, by the buckets their keys fall into."""
    path = scratch_path(spark, "keyed-buckets")
    old = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    U.create_keyed(old, path, ["c_custkey"], 16)
    changed = old.filter("c_acctbal < 1000").select("c_custkey", F.lit("new").alias("c_name"), (F.col("c_acctbal") - 1).alias("c_acctbal"))
    added = old.filter("c_acctbal > 9000").select((-1 - F.col("c_custkey")).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    for rows in (changed, added, changed):
        U.upsert_keyed(spark, path, rows)
    return U.read_keyed(spark, path)


@register("upsert_untouched", """
SELECT 1 AS touched, true AS others_kept, count(*) AS rows, max(c_acctbal) + 1 AS highest FROM customer""")
def upsert_untouched(spark, sf):
    """One changed row: a single bucket gets new files, those of all others keep their names."""
    path = scratch_path(spark, "keyed-one")
    old = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    U.create_keyed(old, path, ["c_custkey"], 16)
    before = set(U.read_keyed(spark, path).inputFiles())
    top = old.agg(F.max("c_acctbal").alias("top"), F.min_by("c_custkey", -F.col("c_acctbal")).alias("key"))
    one = top.select(F.col("key").alias("c_custkey"), F.lit("new").alias("c_name"), (F.col("top") + 1).alias("c_acctbal"))
    touched = U.upsert_keyed(spark, path, one)
    rows = U.read_keyed(spark, path)
    gone = {f.split("/run=")[0] for f in before - set(rows.inputFiles())}
    kept = all(f.endswith(f"/bucket={touched[0]}") for f in gone)
    return rows.agg(F.lit(len(touched)).alias("touched"), F.lit(kept).alias("others_kept"), F.count(F.lit(1)).alias("rows"), F.max("c_acctbal").alias("highest"))


@register("gold_clustered_files", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_quantity, CASE WHEN l_orderkey % 100 = 99 THEN NULL ELSE l_shipdate END AS d FROM lineitem)) AS rows,
       true AS few_files, true AS days_apart""")
def gold_clustered_files(spark, sf):
    """A distinct by buckets leaves a file a bucket, and no two files share more than the day at their border."""
    name, path = new_table(spark, "clustered")
    landing = _landed_lines(spark, sf)
    budget = table(spark, sf, "lineitem").count() // 6
    gold = G.sequential_distinct(landing, _GOLD_LINES, name, path, "l_shipdate", budget=budget)
    buckets = -(-landing.count() // budget)
    spans = gold.filter("l_shipdate IS NOT NULL").groupBy(F.input_file_name().alias("f")).agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    after = F.lead("lo").over(Window.partitionBy(F.lit(0)).orderBy("lo", "hi"))  # one row per file
    apart = spans.select((F.coalesce(F.col("hi") <= after, F.lit(True))).alias("ok")).agg(F.bool_and("ok").alias("days_apart"))
    few = len(gold.inputFiles()) <= buckets
    return gold.agg(F.count(F.lit(1)).alias("rows"), F.lit(few).alias("few_files")).join(apart, F.lit(True))


_SLICED_SQL = """sl AS (SELECT s_suppkey AS k, s_suppkey * 37 % 2400 AS a, s_suppkey * 37 % 2400 + s_suppkey % 40 - 3 AS b FROM supplier),
ranges AS (SELECT DATE '1995-01-01' + CAST(a AS INT) AS lo, DATE '1995-01-01' + CAST(b AS INT) AS hi FROM sl WHERE a < b),
points AS (SELECT DATE '1995-01-01' + CAST(a AS INT) AS p FROM sl WHERE k % 5 = 0),
keys AS (SELECT CASE WHEN l_orderkey % 100 <> 0 THEN CAST(l_shipdate AS DATE) END AS day, count(*) AS rows FROM lineitem GROUP BY 1),
held AS (SELECT day, rows, CASE WHEN day IS NULL THEN 1 ELSE (SELECT count(*) FROM ranges WHERE lo <= day AND day < hi) + (SELECT count(*) FROM points WHERE p = day) + 1 END AS n FROM keys)"""


def _sliced(spark, sf):
    """Lines by day, and overlapping ranges with gaps, points, one range without a start and one slice for rows without a day."""
    at = lambda c: F.expr(f"date_add(DATE '1995-01-01', cast({c} as int))")
    a, b = "s_suppkey * 37 % 2400", "s_suppkey * 37 % 2400 + s_suppkey % 40 - 3"
    suppliers = table(spark, sf, "supplier")
    none = F.lit(None).cast("date")
    ranges = suppliers.select(at(a).alias("from_key"), at(b).alias("to_key"), none.alias("point"), F.lit(False).alias("no_key"))
    points = suppliers.filter("s_suppkey % 5 = 0").select(none.alias("from_key"), none.alias("to_key"), at(a).alias("point"), F.lit(False).alias("no_key"))
    ends = spark.range(2).select(none.alias("from_key"), none.alias("to_key"), none.alias("point"), (F.col("id") == 1).alias("no_key"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 100 != 0, F.col("l_shipdate").cast("date")).alias("day"))
    return lines, ranges, points, ends


@register("slice_coverage_swept", f"WITH {_SLICED_SQL} SELECT n AS slices_holding, CAST(sum(rows) AS BIGINT) AS rows FROM held GROUP BY 1")
def slice_coverage_swept(spark, sf):
    lines, ranges, points, ends = _sliced(spark, sf)
    return S.coverage_of(lines, "day", ranges.unionByName(points).unionByName(ends))


@register("rows_in_slices", f"""
WITH {_SLICED_SQL}, inside AS (SELECT day FROM held WHERE day IS NOT NULL AND n > 1)
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_orderkey % 100 <> 0 AND CAST(l_shipdate AS DATE) IN (SELECT day FROM inside)""")
def rows_in_slices(spark, sf):
    lines, ranges, points, _ = _sliced(spark, sf)
    return S.rows_in_slices(lines, "day", ranges.unionByName(points))


@register("catalogue_search_indexed", f"""
WITH {CATALOGUE_SQL}, terms AS (SELECT DISTINCT lower(term) AS term FROM (
  SELECT replace(p_name, ' ', '_') || '_' || p_partkey AS term FROM part UNION ALL SELECT p_brand FROM part
  UNION ALL SELECT substr(p_name, 3, 4) FROM part UNION ALL SELECT upper(substr(p_brand, 1, 2)) FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT substr(c_name, 2, 6) FROM customer)),
names AS (SELECT lower(table_name) AS t, count(*) AS n FROM catalogue GROUP BY 1), owners AS (SELECT lower(db) AS t, count(*) AS n FROM catalogue GROUP BY 1),
hits AS (
  SELECT term, 1 AS c, n, t FROM terms JOIN names ON t = term UNION ALL SELECT term, 2, n, t FROM terms JOIN owners ON t = term
  UNION ALL SELECT term, 3, n, t FROM terms JOIN names ON contains(t, term) UNION ALL SELECT term, 4, n, t FROM terms JOIN owners ON contains(t, term)),
sized AS (SELECT term, c, sum(n) AS n FROM hits GROUP BY 1, 2),
best AS (SELECT term, min(c) AS c FROM sized WHERE c IN (2, 4) OR n = 1 GROUP BY 1)
SELECT h.term, h.c AS match_class, db, table_name FROM best JOIN hits h ON h.term = best.term AND h.c = best.c
JOIN catalogue ON (h.c IN (1, 3) AND lower(table_name) = h.t) OR (h.c IN (2, 4) AND lower(db) = h.t)""")
def catalogue_search_indexed(spark, sf):
    """Terms from every part and customer: whole names, owners, pieces of names, short and unknown ones."""
    part, customer = table(spark, sf, "part"), table(spark, sf, "customer")
    terms = [part.select(x.alias("term")) for x in (
        F.concat_ws("_", F.regexp_replace("p_name", " ", "_"), "p_partkey"), F.col("p_brand"), F.substring("p_name", 3, 4),
        F.upper(F.substring("p_brand", 1, 2)), F.col("p_partkey").cast("string"))]
    return catalogue_by_index(catalogue(spark, sf), reduce(lambda a, b: a.union(b), terms).union(customer.select(F.substring("c_name", 2, 6))))


_KEY_DRIFT_SQL = """r AS (SELECT l_suppkey, min(l_orderkey) AS lo, max(l_orderkey) AS hi, min(l_returnflag || l_partkey) AS tlo, max(l_returnflag || l_partkey) AS thi FROM lineitem GROUP BY 1),
v AS (SELECT 'l_orderkey' AS col, lo::DOUBLE AS lo, hi::DOUBLE AS hi, (hi - lo)::DOUBLE AS df FROM r
  UNION ALL SELECT 'code', (dense_rank() OVER (ORDER BY tlo))::DOUBLE, (dense_rank() OVER (ORDER BY thi))::DOUBLE, (dense_rank() OVER (ORDER BY tlo || ' - ' || thi))::DOUBLE FROM r),
m AS (SELECT col, median(lo) AS ml, median(hi) AS mh, median(df) AS md FROM v GROUP BY 1),
s AS (SELECT v.col, 1.4826 * median(abs(lo - ml)) AS al, 1.4826 * median(abs(hi - mh)) AS ah, 1.4826 * median(abs(df - md)) AS ad FROM v JOIN m ON v.col = m.col GROUP BY 1)"""


@register("partition_drift_by_key", f"""
WITH {_KEY_DRIFT_SQL}
SELECT m.col AS column_name, round((exp(-10 * (ad / (md + exp(-256)))) + exp(-10 * (al / (abs(ml) + exp(-256)) + ah / (abs(mh) + exp(-256))))) / 2, 6) AS drift FROM m JOIN s ON m.col = s.col""")
def partition_drift_by_key(spark, sf):
    """Drift where every value of a key is a partition, with a text column that has a rank per partition."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", F.concat("l_returnflag", "l_partkey").alias("code"))
    drift = P.partition_drift(P.partition_ranges(lines, "l_suppkey", ["l_orderkey", "code"]), rows_per_bucket=500)
    return drift.select("column_name", F.round("drift", 6).alias("drift"))


@register("dense_ranks", "SELECT DISTINCT l_returnflag, l_partkey, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_partkey) AS rank FROM lineitem")
def dense_ranks(spark, sf):
    return O.dense_ranks(table(spark, sf, "lineitem"), ["l_returnflag"], "l_partkey", "rank", partitions=16)


@register("block_sample", """
SELECT true AS some_files, true AS by_fraction, true AS known, true AS whole_files, count(*) AS all_rows, true AS one_at_least FROM lineitem""")
def block_sample(spark, sf):
    """A quarter of the files: bytes read follow the files chosen; their rows are known and come once; all files give all rows."""
    path = scratch_path(spark, "blocks")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    lines.repartitionByRange(32, "l_orderkey").write.parquet(path)
    quarter, all_, least = (B.block_sample(spark, path, f) for f in (0.25, 1.0, 0.0))
    part, total = quarter.files_read / quarter.files, quarter.bytes_read / quarter.bytes
    counted = quarter.rows.agg(F.count(F.lit(1)).alias("n"))
    apart = quarter.rows.exceptAll(lines).agg(F.count(F.lit(1)).alias("strange"))
    chosen = {f.rsplit("/", 1)[-1] for f in quarter.rows.inputFiles()}
    whole = sum(r["rows"] for r in R.file_rows(spark.read.parquet(path), "lines").collect() if r["path"].rsplit("/", 1)[-1] in chosen)
    return counted.join(apart, F.lit(True)).join(all_.rows.agg(F.count(F.lit(1)).alias("all_rows")), F.lit(True)).select(
        F.lit(0 < quarter.files_read < quarter.files).alias("some_files"), F.lit(abs(part - total) < 0.1).alias("by_fraction"),
        (F.col("strange") == 0).alias("known"), (F.col("n") == whole).alias("whole_files"), "all_rows", F.lit(least.files_read == 1).alias("one_at_least"))


@register("cheap_key_range", """
SELECT 'l_orderkey' AS column_name, 'FOOTERS' AS origin, CAST(min(l_orderkey) AS DOUBLE) AS lo, CAST(max(l_orderkey) AS DOUBLE) AS hi FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'SAMPLE', min(l_extendedprice) - 1, max(l_extendedprice) + 1 FROM lineitem""")
def cheap_key_range(spark, sf):
    """Exact from footers where they tell it; else a sample of blocks, widened by a profile, here the wider."""
    path = scratch_path(spark, "cheap")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    lines.repartition(32).write.parquet(path)
    profiled = lines.agg((F.min("l_extendedprice") - 1).alias("lo"), (F.max("l_extendedprice") + 1).alias("hi"))
    found = {c: B.cheap_key_range(spark, path, c, profiled if c == "l_extendedprice" else None, 0.1) for c in lines.columns}
    return reduce(lambda a, b: a.union(b), [
        rows.select(F.lit(c).alias("column_name"), F.lit(origin).alias("origin"), F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
        for c, (rows, origin) in found.items()])
