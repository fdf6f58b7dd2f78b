"""Gold layer, tables, reports, SQL surface and log metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registered import register
from registered.inputs import (
    CATALOGUE_SQL, CUTOFF, FILES_SQL, LANDED_SQL, ORDER_TYPES, PART_SQL, STATS_SQL,
    catalogue, files, lake_stats, landed, landed_twice, table,
)
from tidelake.functions.predicates import compare, landed_day
from tidelake.operators import aggregates as A
from tidelake.operators import reports as R
from tidelake.operators.schema import cast_columns
from tidelake.plans import gold as G
from tidelake.plans import sqltools as Q
from tidelake.session import scratch_path, shared_root
from tidelake.sources import sinks as K

_ALL_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


def new_table(spark, name: str) -> tuple[str, str]:
    """A table name and folder no other run uses."""
    K.create_database(spark, "tidelake_gold", f"{shared_root(spark)}/tidelake/gold.db")
    return f"tidelake_gold.{name}_{uuid.uuid4().hex[:12]}", scratch_path(spark, name)


@register("register_external", _ALL_ORDERS)
def register_external(spark, sf):
    name, path = new_table(spark, "external")
    K.land_append(table(spark, sf, "orders"), path)
    return K.register_external(spark, name, path)


@register("gold_create", """
SELECT c AS col_name, t AS data_type, (SELECT count(*) FROM orders) AS num_rows
FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'),
             ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string')) v(c, t)""")
def gold_create(spark, sf):
    name, path = new_table(spark, "created")
    K.create_gold(spark, name, G.gold_schema(ORDER_TYPES), path)
    K.insert_append(cast_columns(landed(table(spark, sf, "orders")), ORDER_TYPES), name)
    rows = spark.table(name).agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.array(*[F.struct(F.lit(f.name).alias("col_name"), F.lit(f.dataType.simpleString()).alias("data_type"))
                  for f in spark.table(name).schema]).alias("c"),
    )
    return rows.select(F.explode("c").alias("c"), "num_rows").select("c.*", "num_rows")


@register("insert_overwrite", _ALL_ORDERS + " WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def insert_overwrite(spark, sf):
    name, path = new_table(spark, "overwritten")
    orders = table(spark, sf, "orders")
    K.create_gold(spark, name, orders.schema, path)
    K.insert_overwrite(orders, name)
    K.insert_overwrite(orders.filter(compare("o_orderdate", CUTOFF, ">=")).select(*reversed(orders.columns)), name)
    return spark.table(name)


@register("insert_append", _ALL_ORDERS + " UNION ALL " + _ALL_ORDERS + " WHERE o_orderpriority = '1-URGENT'")
def insert_append(spark, sf):
    name, path = new_table(spark, "appended")
    orders = table(spark, sf, "orders")
    K.create_gold(spark, name, orders.schema, path)
    K.insert_append(orders, name)
    K.insert_append(orders.filter("o_orderpriority = '1-URGENT'"), name)
    return spark.table(name)


@register("guarded_drop", " UNION ALL ".join(
    f"SELECT '{t}' AS source, count(*) < 5000 AS dropped, CASE WHEN count(*) < 5000 THEN 0 ELSE count(*) END AS rows_left FROM {t}"
    for t in ("orders", "supplier")
))
def guarded_drop(spark, sf):
    out = []
    for source in ("orders", "supplier"):
        name, path = new_table(spark, "guarded")
        K.land_append(table(spark, sf, source), path)
        K.register_external(spark, name, path)
        dropped = K.guarded_drop(spark, name, below=5000)
        left = table(spark, sf, source).limit(0) if dropped else spark.table(name)
        out.append(left.agg(F.lit(source).alias("source"), F.lit(dropped).alias("dropped"), F.count(F.lit(1)).alias("rows_left")))
    return out[0].unionByName(out[1])


_LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_shipdate": "timestamp_ntz",
}


def _landed_lines(spark, sf):
    """Landing lineitem with text dates, the large orders' lines twice, some without a date."""
    lines = table(spark, sf, "lineitem").select(*_LINE_TYPES)
    text = F.when(F.col("l_orderkey") % 100 != 99, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    lines = lines.withColumn("l_shipdate", text)
    return lines.unionByName(lines.filter("l_quantity >= 45"))


_DISTINCT_LINES = """
SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_quantity, CASE WHEN l_orderkey % 100 = 99 THEN NULL ELSE l_shipdate END AS l_shipdate FROM lineitem"""


@register("gold_rebuild", _DISTINCT_LINES)
def gold_rebuild(spark, sf):
    name, path = new_table(spark, "rebuilt")
    return G.rebuild(_landed_lines(spark, sf), _LINE_TYPES, name, path)


@register("gold_sequential_distinct", _DISTINCT_LINES)
def gold_sequential_distinct(spark, sf):
    name, path = new_table(spark, "sequential")
    raw = scratch_path(spark, "raw-lines")
    landing = _landed_lines(spark, sf)
    K.land_append(landing, raw)
    rows = spark.read.parquet(raw).count()
    return G.sequential_distinct(spark.read.parquet(raw), _LINE_TYPES, name, path, "l_shipdate", budget=rows // 6)


def _partly_promoted(spark, sf, name):
    table_name, path = new_table(spark, name)
    raw = scratch_path(spark, f"{name}-raw")
    K.land_append(landed(table(spark, sf, "orders")), raw)
    landing = spark.read.parquet(raw)
    G.rebuild(landing.filter(compare("o_orderdate", CUTOFF, "<", landed=True)), ORDER_TYPES, table_name, path)
    return table_name, path, landing


@register("gold_incr_watermark", _ALL_ORDERS)
def gold_incr_watermark(spark, sf):
    name, _, landing = _partly_promoted(spark, sf, "incremental")
    G.append_new(G.new_since(landing, spark.table(name), "o_orderdate", "o_orderdate"), name)
    return spark.table(name)


@register("gold_incr_partitions", f"""
SELECT DISTINCT {PART_SQL.format("o_custkey")} AS part, o_orderkey, o_orderdate FROM orders""")
def gold_incr_partitions(spark, sf):
    """Whole keys: 1 in gold hides neither 10 nor 11, nor the empty and the NULL partition. New rows come twice."""
    name, path = new_table(spark, "partitions")
    raw = scratch_path(spark, "partitions-raw")
    K.land_append(landed_twice(table(spark, sf, "orders")).selectExpr(f"{PART_SQL.format('o_custkey')} AS part", "o_orderkey", "o_orderdate"), raw)
    landing = spark.read.parquet(raw)
    types = {"part": "string", "o_orderkey": "bigint", "o_orderdate": "timestamp_ntz"}
    G.rebuild(landing.filter("part IN ('1', '2')"), types, name, path)
    for _ in range(3):
        G.promote(spark, landing, name, path, types, "PARTITION_UPDATE", "part")
    return spark.table(name)


@register("gold_incr_days", _ALL_ORDERS)
def gold_incr_days(spark, sf):
    """Landing holds timestamps as text, gold typed ones; partitions are days."""
    name, path, landing = _partly_promoted(spark, sf, "days")
    for _ in range(2):
        G.promote(spark, landing, name, path, ORDER_TYPES, "PARTITION_UPDATE", "o_orderdate")
    return spark.table(name)


@register("promote_odd_days", """
SELECT 'CREATED 1, APPENDED 0, UP_TO_DATE 0, UP_TO_DATE 0' AS steps, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
UNION ALL SELECT 'CREATED 1, APPENDED 0, UP_TO_DATE 0, UP_TO_DATE 0', -1, NULL""")
def promote_odd_days(spark, sf):
    """Days landed padded or not, each urgent order twice, one unreadable: three promotions of unchanged landing."""
    name, path = new_table(spark, "odd")
    raw = scratch_path(spark, "odd-raw")
    orders = table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-M-d")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd 00:00:00"))
    rows = orders.unionByName(orders.filter("o_orderpriority = '1-URGENT'")).select("o_orderkey", text.alias("day"))
    K.land_append(rows.union(spark.createDataFrame([(-1, "n/a")], "o_orderkey bigint, day string")), raw)
    landing = spark.read.parquet(raw)
    types = {"o_orderkey": "bigint", "day": "date"}
    early = landing.filter((landed_day("day") < F.lit(CUTOFF)) | landed_day("day").isNull())
    ended = [G.promote(spark, rows, name, path, types, "INCREMENTAL", "day") for rows in (early, landing, landing, landing)]
    steps = ", ".join(f"{r.status} {sum(r.failures.values())}" for r in ended)
    return spark.table(name).select(F.lit(steps).alias("steps"), "o_orderkey", "day")


@register("promote_timed", """
SELECT event_id, date_trunc('second', ts) AS ts FROM events""")
def promote_timed(spark, sf):
    """Gold holds part of a day; the later seconds of that day are new."""
    name, path = new_table(spark, "timed")
    landing = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    types = {"event_id": "bigint", "ts": "timestamp_ntz"}
    G.promote(spark, landing.filter("ts <= '2024-01-20 12:00:00'"), name, path, types, "INCREMENTAL", "ts", timed=True)
    for _ in range(2):
        G.promote(spark, landing, name, path, types, "INCREMENTAL", "ts", timed=True)
    return spark.table(name)


@register("promote", """
SELECT 'CREATED, APPENDED, UP_TO_DATE, UNKNOWN_STYLE' AS steps, year(o_orderdate)::INT AS year, count(*) AS rows FROM orders GROUP BY 2""")
def promote(spark, sf):
    name, path = new_table(spark, "promoted")
    landing = landed(table(spark, sf, "orders"))
    early = landing.filter(compare("o_orderdate", CUTOFF, "<", landed=True))
    steps = [
        G.promote(spark, rows, name, path, ORDER_TYPES, style, "o_orderdate")
        for rows, style in ((early, "INCREMENTAL"), (landing, "INCREMENTAL"), (landing, "INCREMENTAL"), (landing, "UNKNOWN"))
    ]
    counted = spark.table(name).groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.lit(", ".join(s.status for s in steps)).alias("steps"), "year", "rows")


@register("stats_present", f"WITH {STATS_SQL} SELECT table_name, rows <> -1 AND max_ndv <> -1 AS stat_present FROM stats")
def stats_present(spark, sf):
    return R.stats_present(lake_stats(spark, sf))


@register("compute_stats", "SELECT count(*) AS rows, true AS stat_present FROM orders")
def compute_stats(spark, sf):
    name, path = new_table(spark, "analysed")
    K.land_append(table(spark, sf, "orders"), path)
    K.register_external(spark, name, path)
    R.compute_stats(spark, name)
    stats = R.stored_stats(spark, name)
    return stats.join(R.stats_present(stats), "table_name").select("rows", "stat_present")


@register("table_info", f"""
WITH {FILES_SQL}
SELECT table_name, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS files, '/lake/' || table_name AS location FROM files GROUP BY 1""")
def table_info(spark, sf):
    return R.table_info(files(spark, sf))


@register("file_rows", "SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def file_rows(spark, sf):
    per_file = R.file_rows(table(spark, sf, "orders"), "orders").union(R.file_rows(table(spark, sf, "lineitem"), "lineitem"))
    return R.table_info(per_file).select("table_name", "rows")


@register("coverage_report", f"""
WITH {FILES_SQL}, {STATS_SQL},
sized AS (SELECT table_name, CAST(regexp_extract(size_text, '[0-9.]+') AS DOUBLE) *
  CASE regexp_extract(size_text, '[A-Za-z]+') WHEN 'B' THEN 0.001 WHEN 'KB' THEN 1.0 WHEN 'MB' THEN 1000.0 ELSE 1000000.0 END AS kb FROM files),
bal AS (SELECT table_name, CASE WHEN count(*) <= 1 THEN true ELSE stddev_samp(kb) / median(kb) < 1 END AS in_balance FROM sized GROUP BY 1),
info AS (SELECT table_name, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS files FROM files GROUP BY 1),
listing AS (SELECT DISTINCT table_name, regexp_replace(path, '/[^/]*$', '') AS file FROM files),
lake AS (SELECT DISTINCT table_name AS name FROM stats)
SELECT upper(l.table_name) AS table_name, file, in_balance, rows_.stat_present, info.bytes, info.rows, info.files
FROM listing l JOIN lake ON upper(l.table_name) = upper(lake.name)
LEFT JOIN bal ON bal.table_name = l.table_name
LEFT JOIN (SELECT table_name, rows <> -1 AND max_ndv <> -1 AS stat_present FROM stats) rows_ ON rows_.table_name = l.table_name
LEFT JOIN info ON info.table_name = l.table_name""")
def coverage_report(spark, sf):
    landed_files, stats = files(spark, sf), lake_stats(spark, sf)
    listing = landed_files.select("table_name", F.regexp_replace("path", "/[^/]*$", "").alias("file")).distinct()
    lake = stats.select(F.upper("table_name").alias("name")).distinct()
    return R.coverage_report(listing, lake, landed_files, stats)


@register("table_summary", """
SELECT c_custkey AS table_id, c_name AS table_name, CAST(round(abs(c_acctbal)) AS BIGINT) AS num_rows,
       s_name IS NOT NULL AS present, '/lake/' || s_suppkey AS location
FROM customer LEFT JOIN supplier ON upper(c_name) = upper(replace(s_name, 'Supplier', 'Customer'))""")
def table_summary(spark, sf):
    source = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("table_id"), F.col("c_name").alias("table_name"), F.round(F.abs("c_acctbal")).cast("bigint").alias("num_rows")
    )
    lake = table(spark, sf, "supplier").select(
        F.lower(F.regexp_replace("s_name", "Supplier", "Customer")).alias("table_name"), F.concat(F.lit("/lake/"), "s_suppkey").alias("location")
    )
    return R.table_summary(source, lake)


@register("param_sql", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 250000 GROUP BY 1""")
def param_sql(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("param_sql_orders")
    return Q.run_sql(
        spark,
        """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM IDENTIFIER(:source)
           WHERE array_contains(:states, o_orderstatus) AND o_totalprice >= :least GROUP BY 1""",
        {"source": "param_sql_orders", "states": ["F", "O"], "least": 250000.0},
    )


@register("wrap_custom", """
SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem WHERE l_discount > 0.05 GROUP BY 1""")
def wrap_custom(spark, sf):
    query = table(spark, sf, "lineitem").filter("l_discount > 0.05")
    return Q.wrap_custom(query, ["l_returnflag", "count(*) AS n", "round(avg(l_quantity), 6) AS mean"], "GROUP BY l_returnflag")


@register("wrap_count", "SELECT count(*) AS num_rows FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def wrap_count(spark, sf):
    return Q.wrap_count(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct())


@register("wrap_limit", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10")
def wrap_limit(spark, sf):
    return Q.wrap_limit(table(spark, sf, "customer").select("c_custkey", "c_name").orderBy("c_custkey"))


_LOG_SQL = """log AS (SELECT 'job_' || (user_id % 20) AS job_name, event_id AS line_no,
  CASE event_id % 5 WHEN 0 THEN '24/01/01 INFO mapreduce.Job:  map ' || (event_id % 101) || '% reduce ' || (user_id % 101) || '%'
    WHEN 1 THEN '24/01/01 ERROR tool.ImportTool: ' || event_type WHEN 2 THEN 'Task Id : attempt_' || event_id || ', Status : FAILED'
    WHEN 3 THEN 'Error: ' || event_type || ' Status:   FAILED' ELSE '24/01/01 INFO db.Splitter  ' || event_type END AS line FROM events)"""


@register("job_log_metrics", f"""
WITH {_LOG_SQL},
t AS (SELECT job_name, line_no, regexp_replace(regexp_replace(lower(line), '[^a-z 0-9]', '', 'g'), ' {{2,}}', ' ', 'g') AS t FROM log)
SELECT job_name, count(*) FILTER (contains(t, 'error')) AS error_count, count(*) FILTER (contains(t, 'status failed')) AS failed_count,
  CAST(arg_max(regexp_extract(t, 'map ([0-9]+) reduce ([0-9]+)', 1), line_no) FILTER (regexp_matches(t, 'map ([0-9]+) reduce ([0-9]+)')) AS INT) AS map_percent,
  CAST(arg_max(regexp_extract(t, 'map ([0-9]+) reduce ([0-9]+)', 2), line_no) FILTER (regexp_matches(t, 'map ([0-9]+) reduce ([0-9]+)')) AS INT) AS reduce_percent
FROM t GROUP BY 1""")
def job_log_metrics(spark, sf):
    key, user = F.col("event_id"), F.col("user_id")
    line = (
        F.when(key % 5 == 0, F.concat(F.lit("24/01/01 INFO mapreduce.Job:  map "), key % 101, F.lit("% reduce "), user % 101, F.lit("%")))
        .when(key % 5 == 1, F.concat(F.lit("24/01/01 ERROR tool.ImportTool: "), "event_type"))
        .when(key % 5 == 2, F.concat(F.lit("Task Id : attempt_"), key, F.lit(", Status : FAILED")))
        .when(key % 5 == 3, F.concat(F.lit("Error: "), "event_type", F.lit(" Status:   FAILED")))
        .otherwise(F.concat(F.lit("24/01/01 INFO db.Splitter  "), "event_type"))
    )
    log = table(spark, sf, "events").select(
        F.concat(F.lit("job_"), user % 20).alias("job_name"), key.alias("line_no"), line.alias("line")
    )
    return R.job_log_metrics(log)


@register("landing_to_gold", """
SELECT o_orderstatus, count(*) AS num_rows, CAST(max(o_orderdate) AS DATE) AS newest_day FROM orders GROUP BY 1""")
def landing_to_gold(spark, sf):
    name, path = new_table(spark, "orders")
    raw = scratch_path(spark, "orders-raw")
    K.land_append(landed_twice(table(spark, sf, "orders")), raw)
    landing = spark.read.parquet(raw)
    G.rebuild(landing.filter(compare("o_orderdate", CUTOFF, "<", landed=True)), ORDER_TYPES, name, path)
    newer = G.new_since(landing, spark.table(name), "o_orderdate", "o_orderdate")
    G.append_new(newer, name)
    return spark.table(name).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("num_rows"), F.max(F.col("o_orderdate").cast("date")).alias("newest_day")
    )
