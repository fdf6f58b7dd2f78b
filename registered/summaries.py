"""Aggregates and ordered work."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registered import register
from registered.inputs import FILES_SQL, files, table
from tidelake.operators import aggregates as A
from tidelake.operators import ordered as O
from tidelake.operators import profile as P
from tidelake.operators import reports as R
from tidelake.functions.predicates import sample_percent_for
from tidelake.session import materialize, scratch_path, shared_root
from tidelake.sources import sinks as K


@register("row_count", "SELECT count(*) AS num_rows FROM lineitem")
def row_count(spark, sf):
    return A.row_count(table(spark, sf, "lineitem"))


@register("key_range", "SELECT min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
def key_range(spark, sf):
    return A.key_range(table(spark, sf, "lineitem"), "l_shipdate")


@register("key_range_widest", """
SELECT least(min(l_orderkey), (SELECT min(o_orderkey) - 5 FROM orders)) AS lo,
       greatest(max(l_orderkey), (SELECT max(o_orderkey) + 5 FROM orders)) AS hi FROM lineitem""")
def key_range_widest(spark, sf):
    profiled = table(spark, sf, "orders").agg(
        (F.min("o_orderkey") - 5).alias("lo"), (F.max("o_orderkey") + 5).alias("hi")
    )
    return A.key_range_widest(table(spark, sf, "lineitem"), "l_orderkey", profiled)


@register("key_range_sampled", """
SELECT min(o_orderkey) - 5 AS lo, max(o_orderkey) + 5 AS hi, true AS inside FROM orders""")
def key_range_sampled(spark, sf):
    """A sampled range, widened by the profiled one, which here is known to be the wider."""
    lines = table(spark, sf, "lineitem")
    profiled = table(spark, sf, "orders").agg((F.min("o_orderkey") - 5).alias("lo"), (F.max("o_orderkey") + 5).alias("hi"))
    percent = sample_percent_for(lines.count(), 500)
    widest = A.key_range_widest(lines, "l_orderkey", profiled, sample_percent=percent)
    sampled = A.key_range_widest(lines, "l_orderkey", sample_percent=percent).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    inside = F.coalesce((F.col("lo") <= F.col("a")) & (F.col("b") <= F.col("hi")), F.lit(True))
    return widest.join(sampled, F.lit(True)).select("lo", "hi", inside.alias("inside"))


@register("stored_row_count", "SELECT count(*) AS num_rows FROM lineitem")
def stored_row_count(spark, sf):
    """The count that statistics hold, without a scan of the rows."""
    path = scratch_path(spark, "counted")
    K.land_append(table(spark, sf, "lineitem").select("l_orderkey"), path)
    K.create_database(spark, "tidelake_gold", f"{shared_root(spark)}/tidelake/gold.db")
    name = f"tidelake_gold.rows_{uuid.uuid4().hex[:12]}"
    K.register_external(spark, name, path)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    rows = A.stored_row_count(spark, name)
    return spark.range(1).select(F.lit(rows).cast("bigint").alias("num_rows"))


@register("grouped_range", """
SELECT CAST(l_shipdate AS DATE) AS day, min(l_orderkey) AS min_key, max(l_orderkey) AS max_key FROM lineitem GROUP BY 1""")
def grouped_range(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"), "l_orderkey")
    return A.grouped_range(lines, "day", "l_orderkey")


@register("watermark", """
SELECT 'lake' AS layer, max(strftime(o_orderdate, '%Y-%m-%d')) AS watermark FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'
UNION ALL SELECT 'source', max(strftime(o_orderdate, '%Y-%m-%d')) FROM orders""")
def watermark(spark, sf):
    orders = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    lake = A.watermark(orders.filter("o_orderdate < timestamp_ntz '2000-01-01'"), day)
    return lake.select(F.lit("lake").alias("layer"), "watermark").union(
        A.watermark(orders, day).select(F.lit("source"), "watermark")
    )


@register("distinct_keys", "SELECT DISTINCT l_suppkey FROM lineitem")
def distinct_keys(spark, sf):
    return A.distinct_keys(table(spark, sf, "lineitem"), "l_suppkey")


@register("count_per_key", "SELECT l_suppkey, count(*) AS cnt FROM lineitem GROUP BY l_suppkey")
def count_per_key(spark, sf):
    return A.count_per_key(table(spark, sf, "lineitem"), "l_suppkey")


@register("group_summary", """
WITH c AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS cnt FROM lineitem GROUP BY 1)
SELECT CAST(date_trunc('month', day) AS DATE) AS month, min(day) AS lo, max(day) AS hi, CAST(sum(cnt) AS BIGINT) AS rows FROM c GROUP BY 1""")
def group_summary(spark, sf):
    days = _ship_days(spark, sf).withColumn("month", F.trunc("day", "month"))
    return A.group_summary(days, "month", "day", "cnt")


@register("mode_profile", """
WITH c AS (SELECT l_returnflag, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_partkey) AS k FROM c)
SELECT l_returnflag, max(CASE WHEN k = 1 THEN l_partkey END) AS high_freq, max(n) AS freq, count(*) AS n_values,
       min(l_partkey) AS lo, max(l_partkey) AS hi FROM r GROUP BY 1""")
def mode_profile(spark, sf):
    return A.mode_profile(table(spark, sf, "lineitem"), "l_partkey", ["l_returnflag"])


@register("robust_spread", """
WITH r AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k,
                  count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
m AS (SELECT l_returnflag, median(l_extendedprice) AS med FROM lineitem GROUP BY 1),
d AS (SELECT l.l_returnflag, 1.4826 * median(abs(l_extendedprice - med)) AS mad FROM lineitem l JOIN m ON l.l_returnflag = m.l_returnflag GROUP BY 1)
SELECT r.l_returnflag, count(*) AS n,
       round(avg(CASE WHEN k > floor(n * 0.2) AND k <= n - floor(n * 0.2) THEN x END), 4) AS trimmed_mean,
       round(any_value(med), 4) AS median, round(any_value(mad), 4) AS mad, round(stddev_samp(x), 4) AS sd
FROM r JOIN m ON r.l_returnflag = m.l_returnflag JOIN d ON r.l_returnflag = d.l_returnflag GROUP BY 1""")
def robust_spread(spark, sf):
    out = A.spread_of(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("trimmed_mean", "median", "mad", "sd")])


@register("quantile_threshold", """
SELECT p_brand, round(quantile_cont(1.0 / (abs(p_size - 20) + 1), 0.875), 6) AS quantile FROM part GROUP BY 1""")
def quantile_threshold(spark, sf):
    scored = table(spark, sf, "part").select("p_brand", (1.0 / (F.abs(F.col("p_size") - 20) + 1)).cast("double").alias("dm"))
    out = A.quantile_of(scored, "dm", 0.875, ["p_brand"])
    return out.select("p_brand", F.round("quantile", 6).alias("quantile"))


_PROFILED = {
    "c_custkey": ("bigint", None),
    "c_name": ("string", "text"),
    "c_nationkey": ("int", None),
    "c_acctbal": ("double", "number"),
    "c_mktsegment": ("string", "text"),
}


def _profile_sql() -> str:
    parts = []
    for name, (kind, how) in _PROFILED.items():
        # a tenth of the segments is NULL
        col = "CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_mktsegment END" if name == "c_mktsegment" else name
        width = "avg(octet_length(CAST(x AS BLOB)))" if how == "text" else "4.0::DOUBLE" if kind == "int" else "8.0::DOUBLE"
        low, high = (f"CAST(CAST({f}(x) AS DECIMAL(38,6)) AS VARCHAR)" if how == "number" else f"CAST({f}(x) AS VARCHAR)" for f in ("min", "max"))
        parts.append(
            f"SELECT '{name}' AS column_name, '{kind}' AS data_type, count(DISTINCT x) AS num_distinct, count(*) - count(x) AS num_nulls, "
            f"count(*) > count(x) AS is_null_ever, round({width}, 6) AS avg_col_len, {low} AS low_value, {high} AS high_value "
            f"FROM (SELECT {col} AS x FROM customer)"
        )
    return " UNION ALL ".join(parts)


def _profiled(spark, sf):
    segment = F.when(F.col("c_custkey") % 10 != 3, F.col("c_mktsegment"))
    return table(spark, sf, "customer").withColumn("c_mktsegment", segment)


@register("column_profile", _profile_sql())
def column_profile(spark, sf):
    out = P.column_profile(_profiled(spark, sf), list(_PROFILED), exact=True)
    return out.withColumn("avg_col_len", F.round("avg_col_len", 6))


@register("column_profile_sketch", f"""
SELECT column_name, data_type, true AS within_error, num_nulls, is_null_ever, avg_col_len, low_value, high_value FROM ({_profile_sql()})""")
def column_profile_sketch(spark, sf):
    """All but the distinct values is exact; these are within four times the sketch's standard error of 5 percent."""
    customers = _profiled(spark, sf)
    sketch = P.column_profile(customers, list(_PROFILED))
    exact = P.column_profile(customers, list(_PROFILED), exact=True).select("column_name", F.col("num_distinct").alias("n"))
    near = F.abs(F.col("num_distinct") - F.col("n")) <= F.greatest(0.2 * F.col("n"), F.lit(1.0))
    return sketch.join(exact, "column_name").select(
        "column_name", "data_type", near.alias("within_error"), "num_nulls", "is_null_ever",
        F.round("avg_col_len", 6).alias("avg_col_len"), "low_value", "high_value",
    )


_LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
    "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


def _line_profile_sql() -> str:
    parts = []
    for name, kind in _LINE_TYPES.items():
        width = f"avg(octet_length(CAST({name} AS BLOB)))" if kind == "string" else "4.0::DOUBLE" if kind == "int" else "8.0::DOUBLE"
        text = "CAST(CAST({}({}) AS DECIMAL(38,6)) AS VARCHAR)" if kind == "double" else "CAST({}({}) AS VARCHAR)"
        parts.append(
            f"SELECT '{name}' AS column_name, '{kind}' AS data_type, true AS within_error, count(*) - count({name}) AS num_nulls, "
            f"count(*) > count({name}) AS is_null_ever, round({width}, 6) AS avg_col_len, {text.format('min', name)} AS low_value, "
            f"{text.format('max', name)} AS high_value FROM lineitem"
        )
    return " UNION ALL ".join(parts)


@register("column_profile_sketch_lines", _line_profile_sql())
def column_profile_sketch_lines(spark, sf):
    """As column_profile_sketch, over all rows and columns of a large table."""
    lines = table(spark, sf, "lineitem")
    sketch = P.column_profile(lines)
    exact = P.column_profile(lines, exact=True).select("column_name", F.col("num_distinct").alias("n"))
    near = F.abs(F.col("num_distinct") - F.col("n")) <= F.greatest(0.2 * F.col("n"), F.lit(1.0))
    return sketch.join(exact, "column_name").select(
        "column_name", "data_type", near.alias("within_error"), "num_nulls", "is_null_ever",
        F.round("avg_col_len", 6).alias("avg_col_len"), "low_value", "high_value",
    )


@register("storage_balance", f"""
WITH {FILES_SQL},
sized AS (SELECT table_name, CAST(regexp_extract(size_text, '[0-9.]+') AS DOUBLE) *
  CASE regexp_extract(size_text, '[A-Za-z]+') WHEN 'B' THEN 0.001 WHEN 'KB' THEN 1.0 WHEN 'MB' THEN 1000.0 ELSE 1000000.0 END AS kb FROM files)
SELECT table_name, count(*) AS files, round(median(kb), 4) AS median_kb, round(stddev_samp(kb), 4) AS sd_kb,
       CASE WHEN count(*) <= 1 THEN true ELSE stddev_samp(kb) / median(kb) < 1 END AS in_balance
FROM sized GROUP BY 1""")
def storage_balance(spark, sf):
    out = R.storage_balance(files(spark, sf))
    return out.select("table_name", "files", F.round("median_kb", 4).alias("median_kb"), F.round("sd_kb", 4).alias("sd_kb"), "in_balance")


@register("concat_per_key", """
WITH u AS (SELECT *, sum(coalesce(strlen(text), 0) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations)
SELECT conv_id, CAST((upto - 1) // 600 AS BIGINT) AS part, string_agg(text, chr(10) ORDER BY turn) AS joined FROM u GROUP BY 1, 2""")
def concat_per_key(spark, sf):
    return A.concat_per_key(table(spark, sf, "conversations"), "conv_id", "turn", "text", bytes_per_part=1200)


@register("small_domain_values", """
SELECT 'l_returnflag' AS column_name, CAST(l_returnflag AS VARCHAR) AS value FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem GROUP BY 2""")
def small_domain_values(spark, sf):
    return A.small_domain_values(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", "l_orderkey", "l_shipdate"]
    )


def _ship_days(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"))
    return A.count_per_key(lines, "day")


_SHIP_DAYS_SQL = "c AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS cnt FROM lineitem GROUP BY 1)"


@register("running_count", f"""
WITH {_SHIP_DAYS_SQL} SELECT day, cnt, CAST(sum(cnt) OVER (ORDER BY day) AS BIGINT) AS running FROM c""")
def running_count(spark, sf):
    return O.running_total(materialize(_ship_days(spark, sf), "day-counts"), "day", {"running": "cnt"})


_BUDGET = 1000


@register("row_budget_groups", f"""
WITH c AS (SELECT CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS day, count(*) AS cnt FROM lineitem GROUP BY 1),
a AS (SELECT day, cnt, CAST(sum(cnt) OVER (ORDER BY day) AS BIGINT) AS running FROM c WHERE day IS NOT NULL),
b AS (SELECT *, running % {_BUDGET} AS inside FROM a),
d AS (SELECT *, CASE WHEN inside < lag(inside) OVER (ORDER BY day) OR cnt > {_BUDGET} THEN 1 ELSE 0 END AS opens FROM b)
SELECT day, cnt, running, CAST(sum(opens) OVER (ORDER BY day) AS BIGINT) AS group_id FROM d
UNION ALL SELECT day, cnt, NULL, -1 FROM c WHERE day IS NULL""")
def row_budget_groups(spark, sf):
    day = F.when(F.col("l_orderkey") % 50 != 0, F.col("l_shipdate").cast("date"))
    counts = A.count_per_key(table(spark, sf, "lineitem").select(day.alias("day")), "day")
    return O.row_budget_groups(counts, "day", "cnt", _BUDGET)


GAP_SQL = """days AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate IS NOT NULL),
starts AS (SELECT o_custkey, day, CASE WHEN lag(day) OVER w IS NULL OR day - lag(day) OVER w >= 60 THEN 1 ELSE 0 END AS s FROM days WINDOW w AS (PARTITION BY o_custkey ORDER BY day)),
gaps AS (SELECT o_custkey, day, CAST(sum(s) OVER (PARTITION BY o_custkey ORDER BY day) AS BIGINT) AS group_id FROM starts)"""


def gap_days(spark, sf):
    """Runs of order days of every customer, over all orders."""
    days = table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return O.gap_groups(days, "day", gap=60, keys=["o_custkey"])


@register("gap_groups", f"WITH {GAP_SQL} SELECT o_custkey, day, group_id FROM gaps")
def gap_groups(spark, sf):
    return gap_days(spark, sf)


@register("forward_fill", """
WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN NULL ELSE text END AS text FROM conversations)
SELECT conv_id, turn, last_value(CASE WHEN trim(text) <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS text FROM b""")
def forward_fill(spark, sf):
    blanked = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 2 == 1, "  ").otherwise(F.col("text")).alias("text")
    )
    return O.forward_fill(blanked, ["conv_id"], "turn", ["text"])


@register("top_column", """
WITH r AS (SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS k FROM lineitem)
SELECT l_orderkey, l_partkey, l_extendedprice AS score FROM r WHERE k = 1""")
def top_column(spark, sf):
    return P.top_column(table(spark, sf, "lineitem"), "l_extendedprice", "l_partkey", ["l_orderkey"])
