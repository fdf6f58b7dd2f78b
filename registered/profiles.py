"""Profiles, scores, import styles and slices."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registered import register
from registered.inputs import table
from registered.summaries import GAP_SQL, gap_days
from tidelake.operators import aggregates as A
from tidelake.operators import ordered as O
from tidelake.operators import profile as P
from tidelake.operators.sets import union_all
from tidelake.plans import incremental as I
from tidelake.plans import slicing as S
from tidelake.plans.imports import analyse
from tidelake.session import materialize, scratch_path, shared_root
from tidelake.sources import sinks as K


@register("split_required", """
SELECT count(*) AS num_rows, floor(count(*) / 500.0) > 1 AS split_required,
       floor(count(*) / 50000.0) > 1 AND floor(count(*) / 500.0) > 1 AS job_split_required FROM lineitem""")
def split_required(spark, sf):
    return P.split_required(table(spark, sf, "lineitem"), 500, 50_000)


@register("date_only_columns", """
SELECT 'o_orderdate' AS column_name, bool_and(CAST(o_orderdate AS DATE) = o_orderdate) AS is_date FROM orders
UNION ALL SELECT 'order_text', bool_and(substr(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 12, 8) = '00:00:00') FROM orders
UNION ALL SELECT 'ts', bool_and(CAST(ts AS DATE) = ts) FROM events
UNION ALL SELECT 'ts_text', bool_and(substr(strftime(ts, '%Y-%m-%d %H:%M:%S'), 12, 8) = '00:00:00') FROM events""")
def date_only_columns(spark, sf):
    text = "yyyy-MM-dd HH:mm:ss"
    orders = table(spark, sf, "orders").select("o_orderdate", F.date_format("o_orderdate", text).alias("order_text"))
    events = table(spark, sf, "events").select("ts", F.date_format("ts", text).alias("ts_text"))
    return P.date_only_columns(orders, ["order_text"]).union(P.date_only_columns(events, ["ts_text"]))


def _pattern_sql(counts: str) -> str:
    return f"""
c AS ({counts}),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n) AS k, count(*) OVER (PARTITION BY col) AS m FROM c),
mu AS (SELECT col, avg(CASE WHEN k > floor(m * 0.2) AND k <= m - floor(m * 0.2) THEN n END) AS mu, median(n) AS med FROM r GROUP BY col),
s AS (SELECT c.col, 1.4826 * median(abs(n - med)) AS s FROM c JOIN mu ON c.col = mu.col GROUP BY c.col),
top AS (SELECT col, arg_min(v, (-n, v)) AS high_freq, min(v) AS lo, max(v) AS hi, min(n) AS least_, max(n) AS most_ FROM c GROUP BY col),
pattern AS (SELECT top.col, lo, hi, high_freq, mu AS trimmed_mean, s AS mad, most_ > mu + 3 * s OR least_ < mu - 3 * s AS is_chunked, high_freq = lo AS is_chrono
  FROM top JOIN mu ON top.col = mu.col JOIN s ON top.col = s.col)"""


_PATTERN_COUNTS = """
  SELECT 'l_shipdate' AS col, CAST(l_shipdate AS DATE) AS v, count(*) AS n FROM lineitem GROUP BY 2
  UNION ALL SELECT 'o_orderdate', CAST(o_orderdate AS DATE), count(*) FROM orders GROUP BY 2
  UNION ALL SELECT 'ts', CAST(ts AS DATE), count(*) FROM events GROUP BY 2"""


@register("load_pattern", f"""
WITH {_pattern_sql(_PATTERN_COUNTS)}
SELECT col, lo, hi, high_freq, round(trimmed_mean, 6) AS trimmed_mean, round(mad, 6) AS mad, is_chunked, is_chrono FROM pattern""")
def load_pattern(spark, sf):
    counts = union_all(*[
        table(spark, sf, t).groupBy(F.lit(c).alias("col"), F.col(c).cast("date").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        for t, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"), ("events", "ts"))
    ])
    out = P.load_pattern(counts, "v", "n", ["col"])
    return out.select("col", "lo", "hi", "high_freq", F.round("trimmed_mean", 6).alias("trimmed_mean"), F.round("mad", 6).alias("mad"), "is_chunked", "is_chrono")


# The profile of orders, with the pattern of its date and a drift by year.
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _drift_sql() -> str:
    number = {
        "o_orderkey": "o_orderkey::DOUBLE", "o_custkey": "o_custkey::DOUBLE", "o_totalprice": "o_totalprice",
        "o_orderdate": "datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))::DOUBLE",
    }
    ranges = " UNION ALL ".join(
        f"SELECT '{c}' AS col, year(o_orderdate) AS p, min({x}) AS lo, max({x}) AS hi, max({x}) - min({x}) AS df FROM orders GROUP BY 2"
        for c, x in number.items()
    )
    coded = " UNION ALL ".join(
        f"SELECT '{c}' AS col, (dense_rank() OVER (ORDER BY lo))::DOUBLE AS lo, (dense_rank() OVER (ORDER BY hi))::DOUBLE AS hi, "
        f"(dense_rank() OVER (ORDER BY lo || ' - ' || hi))::DOUBLE AS df "
        f"FROM (SELECT year(o_orderdate) AS p, min({c}) AS lo, max({c}) AS hi FROM orders GROUP BY 1)"
        for c in ("o_orderstatus", "o_orderpriority")
    )
    return f"""
numeric_ranges AS ({ranges}),
text_ranges AS ({coded}),
ranges AS (SELECT col, lo, hi, df FROM numeric_ranges UNION ALL SELECT col, lo, hi, df FROM text_ranges),
meds AS (SELECT col, median(lo) AS ml, median(hi) AS mh, median(df) AS md FROM ranges GROUP BY col),
mads AS (SELECT r.col, 1.4826 * median(abs(lo - ml)) AS al, 1.4826 * median(abs(hi - mh)) AS ah, 1.4826 * median(abs(df - md)) AS ad
  FROM ranges r JOIN meds m ON r.col = m.col GROUP BY r.col),
drift AS (SELECT m.col, (exp(-10 * (ad / (md + exp(-256)))) + exp(-10 * (al / (abs(ml) + exp(-256)) + ah / (abs(mh) + exp(-256))))) / 2 AS drift
  FROM meds m JOIN mads a ON m.col = a.col)"""


def _drift(spark, sf):
    orders = table(spark, sf, "orders")
    return P.partition_drift(P.partition_ranges(orders, F.year("o_orderdate"), _ORDER_COLUMNS))


@register("partition_drift", f"WITH {_drift_sql()} SELECT col AS column_name, round(drift, 6) AS drift FROM drift")
def partition_drift(spark, sf):
    return _drift(spark, sf).select("column_name", F.round("drift", 6).alias("drift"))


_L, _J, _C = 1000, 4000, 20


def _scores_sql() -> str:
    ndv = " UNION ALL ".join(
        f"SELECT '{c}' AS col, count(DISTINCT {c}) AS ndv, count(*) - count({c}) AS nulls FROM orders" for c in _ORDER_COLUMNS
    )
    pattern = _pattern_sql("SELECT 'o_orderdate' AS col, CAST(o_orderdate AS DATE) AS v, count(*) AS n FROM orders GROUP BY 2")
    return f"""
{pattern}, {_drift_sql()}, nd AS ({ndv}), total AS (SELECT count(*) AS n FROM orders),
prof AS (SELECT nd.col, ndv, CASE WHEN nd.col = 'o_orderdate' THEN 1 ELSE 0 END AS is_date,
   coalesce(is_chunked, false)::INT AS chunked, coalesce(is_chrono, false)::INT AS chrono,
   CASE nd.col WHEN 'o_orderdate' THEN 1.0 WHEN 'o_orderpriority' THEN 0.3 ELSE 0.0 END AS part,
   CASE WHEN nd.col = 'o_orderkey' THEN 1 ELSE 0 END AS ix, coalesce(drift, 0) AS drift,
   (CASE WHEN n // {_J} > 1 AND n // {_L} > 1 THEN {_J} ELSE n END)::DOUBLE / ndv AS r, 1.0::DOUBLE / (abs(ndv - {_C}) + 1) AS dm
  FROM nd CROSS JOIN total LEFT JOIN pattern p ON nd.col = p.col LEFT JOIN drift d ON nd.col = d.col WHERE nulls = 0),
lim AS (SELECT greatest(0.1, quantile_cont(dm, 0.875)) AS q FROM prof),
w AS (SELECT *, (r < {_L} OR dm > q)::INT AS w, is_date * 0.3::DOUBLE + is_date * ((chunked + 2 * chrono) / 3.0::DOUBLE) * 0.7::DOUBLE AS ds FROM prof, lim),
scored AS (SELECT col, ndv, r, dm, w, ds,
   w * ((r / {_L}) * w + 3 * ds + 6 * drift + 2 * dm) / 12 AS score_split,
   exp(-abs(1 - r / {_J})) * (1 + 2 * ds + 3 * part::DOUBLE + ix) / 7 AS score_job_split FROM w)"""


def _analysed_orders(spark, sf):
    return analyse(
        table(spark, sf, "orders"), partition="o_orderdate", partition_by=F.year("o_orderdate"), subpartition="o_orderpriority",
        index_columns=["o_orderkey"], rows_per_split=_L, rows_per_job=_J, connections=_C, exact=True,
    )


def _stored_analysis(spark, sf):
    """As ``_analysed_orders`` from what a catalogue would have stored; the orders handed on are empty but for their dates."""
    orders = table(spark, sf, "orders")
    stored = materialize(P.column_profile(orders, exact=True), "stored")
    stats = stored.select(
        F.upper("column_name").alias("COLUMN_NAME"), F.col("num_distinct").alias("NUM_DISTINCT"), F.col("num_nulls").alias("NUM_NULLS"),
        F.col("avg_col_len").cast("int").alias("AVG_COL_LEN"), F.col("low_value").alias("LOW_VALUE"), F.col("high_value").alias("HIGH_VALUE"),
    )
    by_year = P.partition_ranges(orders, F.year("o_orderdate"), _ORDER_COLUMNS).select(
        F.upper("column_name").alias("COLUMN_NAME"), F.col("partition").alias("PARTITION_NAME"),
        F.col("lo_text").alias("LOW_VALUE"), F.col("hi_text").alias("HIGH_VALUE"),
    )
    path = scratch_path(spark, "counted")
    K.land_append(orders, path)
    K.create_database(spark, "tidelake_gold", f"{shared_root(spark)}/tidelake/gold.db")
    name = f"tidelake_gold.counted_{uuid.uuid4().hex[:12]}"
    K.register_external(spark, name, path)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    # a scan of anything stored would find no rows
    dates_only = orders.select(*[F.col(c) if c == "o_orderdate" else F.raise_error(F.lit(f"{c} was read")).cast(t).alias(c) for c, t in orders.dtypes])
    counts = orders.groupBy(F.lit("o_orderdate").alias("column_name"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return analyse(
        dates_only, partition="o_orderdate", partition_by=F.year("o_orderdate"), subpartition="o_orderpriority", index_columns=["o_orderkey"],
        rows_per_split=_L, rows_per_job=_J, connections=_C, column_stats=stats, stored_rows=A.stored_row_count(spark, name),
        value_counts=counts, partition_stats=by_year,
    )


_SCORES = f"""
WITH {_scores_sql()}
SELECT col AS column_name, ndv AS num_distinct, round(r, 6) AS rows_in_split, round(dm, 6) AS dm_score, w = 1 AS within_limit,
       round(ds, 6) AS date_score, round(score_split, 6) AS score_split, round(score_job_split, 6) AS score_job_split FROM scored"""


@register("split_scores", _SCORES)
def split_scores(spark, sf):
    return _scores(_analysed_orders(spark, sf))


@register("split_scores_stored", _SCORES)
def split_scores_stored(spark, sf):
    """The same scores from stored statistics; reading any stored column of the source would fail."""
    return _scores(_stored_analysis(spark, sf))


def _scores(found):
    return found.scored.select(
        "column_name", "num_distinct", F.round("rows_in_split", 6).alias("rows_in_split"), F.round("dm_score", 6).alias("dm_score"),
        "within_limit", F.round("date_score", 6).alias("date_score"),
        F.round("score_split", 6).alias("score_split"), F.round("score_job_split", 6).alias("score_job_split"),
    )


@register("suggest_keys", f"""
WITH {_scores_sql()},
lifted AS (SELECT col, CASE WHEN col = 'o_custkey' THEN greatest((SELECT max(score_split) FROM scored) + 0.0001, 0.001) ELSE score_split END AS s,
                  score_job_split AS j FROM scored)
SELECT 'split' AS role, arg_min(col, (-s, col)) AS column_name, round(max(s), 6) AS score FROM lifted
UNION ALL SELECT 'job_split', arg_min(col, (-j, col)), round(max(j), 6) FROM lifted""")
def suggest_keys(spark, sf):
    out = P.suggest_keys(_analysed_orders(spark, sf).scored, split_bias=["O_CUSTKEY"])
    return out.select("role", "column_name", F.round("score", 6).alias("score"))


@register("widen_range", """
WITH r AS (SELECT l_suppkey, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem GROUP BY 1),
u AS (SELECT *, pow(10.0::DOUBLE, floor(log10(lo + 1e-7::DOUBLE))) AS ul, pow(10.0::DOUBLE, floor(log10(hi + 1e-7::DOUBLE))) AS uh FROM r)
SELECT l_suppkey, lo, hi, round(greatest(floor(lo / ul - 1) * ul, 0), 6) AS wide_lo, round(greatest(floor(hi / uh + 1) * uh, 0), 6) AS wide_hi FROM u""")
def widen_range(spark, sf):
    ranges = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))
    out = P.widen_range(ranges)
    return out.select("l_suppkey", "lo", "hi", F.round("wide_lo", 6).alias("wide_lo"), F.round("wide_hi", 6).alias("wide_hi"))


@register("split_viable", """
WITH r AS (SELECT min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders)
SELECT bool_or(o_custkey >= lo AND o_custkey <= lo + (hi - lo) / 2.0) AS lower_half, bool_or(o_custkey >= lo + (hi - lo) / 2.0 AND o_custkey <= hi) AS upper_half,
       bool_or(o_custkey >= lo AND o_custkey <= lo + (hi - lo) / 2.0) AND bool_or(o_custkey >= lo + (hi - lo) / 2.0 AND o_custkey <= hi) AS viable
FROM orders, r""")
def split_viable(spark, sf):
    return P.split_viable(table(spark, sf, "orders"), "o_custkey")


def _analysed(spark, sf):
    """Parts standing in for analysed tables of very different sizes."""
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("table_id"),
        (key * 7919 % 5000 * F.col("p_size") * 1000).alias("num_rows"),
        F.lit(1_000_000).cast("bigint").alias("rows_per_split"),
        F.lit(100_000_000).cast("bigint").alias("rows_per_job"),
        F.lit(20).cast("bigint").alias("connections"),
        F.concat(F.lit("K"), key % 3).alias("split_key"),
        F.concat(F.lit("K"), key % 2).alias("job_key"),
        (key % 7 + 1).alias("job_key_ndv"),
        F.when(key % 5 == 0, "DATE").otherwise("NUMBER").alias("job_key_type"),
        ((key % 10) / 10.0).cast("double").alias("drift"),
        (key % 4 == 0).alias("is_partitioned"),
        (key % 6 == 0).alias("is_view"),
        (key % 17 == 0).alias("force_pointable"),
    )


_ANALYSED_SQL = """t AS (SELECT p_partkey AS table_id, p_partkey * 7919 % 5000 * p_size * 1000 AS num_rows, 'K' || (p_partkey % 3) AS split_key, 'K' || (p_partkey % 2) AS job_key,
  p_partkey % 7 + 1 AS job_key_ndv, CASE WHEN p_partkey % 5 = 0 THEN 'DATE' ELSE 'NUMBER' END AS job_key_type, (p_partkey % 10) / 10.0::DOUBLE AS drift,
  p_partkey % 4 = 0 AS is_partitioned, p_partkey % 6 = 0 AS is_view, p_partkey % 17 = 0 AS force_pointable FROM part),
a AS (SELECT *, num_rows // 1000000 > 1 AS sr, num_rows // 100000000 > 1 AND num_rows // 1000000 > 1 AS jr,
  greatest(round_even(num_rows / 1e8::DOUBLE, 0), 2)::BIGINT AS njobs, split_key = job_key AS same FROM t),
b AS (SELECT *, force_pointable OR (is_partitioned AND NOT same AND job_key_type <> 'DATE') OR abs(njobs - job_key_ndv) / (job_key_ndv + njobs)::DOUBLE < 0.35 AS pointable,
  is_view OR drift > 0.7::DOUBLE AS key_fixed FROM a),
styled AS (SELECT *, CASE WHEN NOT sr THEN 'PLAIN' WHEN NOT jr THEN 'SPLIT' WHEN pointable AND key_fixed AND NOT same THEN 'POINT+FIXED'
   WHEN NOT pointable AND key_fixed AND NOT same THEN 'RANGE+FIXED' WHEN NOT pointable AND NOT key_fixed AND same THEN 'RANGE+SAME_RANGE' ELSE 'JOB_SPLIT_UNKNOWN' END AS style,
  CASE WHEN sr THEN least(CASE WHEN jr THEN 100 ELSE round_even(num_rows / 1e6::DOUBLE, 0) END, 20)::BIGINT ELSE 1 END AS splits FROM b)"""


@register("import_style", f"""
WITH {_ANALYSED_SQL}
SELECT table_id, num_rows, sr AS split_required, jr AS job_split_required, njobs, pointable, key_fixed, style, splits FROM styled""")
def import_style(spark, sf):
    return S.import_style(_analysed(spark, sf)).select(
        "table_id", "num_rows", "split_required", "job_split_required", "njobs", "pointable", "key_fixed", "style", "splits"
    )


@register("point_slices", "SELECT DISTINCT l_linenumber AS point FROM lineitem")
def point_slices(spark, sf):
    return S.point_slices(table(spark, sf, "lineitem"), "l_linenumber")


@register("range_slices", """
WITH r AS (SELECT l_suppkey, min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi, count(*) // 50 + 2 AS n FROM lineitem GROUP BY 1),
e AS (SELECT l_suppkey, lo, datediff('day', lo, hi) AS span, n, unnest(range(0, n)) AS slice_no FROM r),
c AS (SELECT l_suppkey, slice_no, lo + CAST((span * slice_no) // n AS INT) AS from_key,
      lo + CAST(CASE WHEN slice_no = n - 1 THEN span + 1 ELSE (span * (slice_no + 1)) // n END AS INT) AS to_key FROM e)
SELECT * FROM c WHERE from_key < to_key""")
def range_slices(spark, sf):
    ranges = (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey")
        .agg(F.min(F.col("l_shipdate").cast("date")).alias("lo"), F.max(F.col("l_shipdate").cast("date")).alias("hi"), F.count(F.lit(1)).alias("_c"))
        .withColumn("njobs", F.floor(F.col("_c") / 50) + 2)
    )
    return S.range_slices(ranges, "njobs", ["l_suppkey"])


@register("strict_slices", f"""
WITH {GAP_SQL},
r AS (SELECT o_custkey, group_id, min(day) AS lo, datediff('day', min(day), max(day)) AS span FROM gaps GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN span = 0 THEN 1 ELSE greatest(greatest(round_even(span / least(10, span)::DOUBLE + 0.9::DOUBLE, 0), 1) - 1, 1)::BIGINT END AS n FROM r),
e AS (SELECT *, unnest(range(0, n)) AS slice_no FROM p)
SELECT o_custkey, group_id, slice_no, lo + CAST((span * slice_no) // n AS INT) AS from_key,
       lo + CAST(CASE WHEN slice_no = n - 1 THEN span + 1 ELSE (span * (slice_no + 1)) // n END AS INT) AS to_key FROM e""")
def strict_slices(spark, sf):
    return S.strict_slices(O.gap_ranges(gap_days(spark, sf), "day", ["o_custkey"]), 10, ["o_custkey", "group_id"])


@register("slice_coverage", "SELECT 1 AS slices_holding, count(*) AS rows FROM lineitem")
def slice_coverage(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 100 != 0, F.col("l_shipdate").cast("date")).alias("day")
    )
    ranges = A.key_range(lines, "day")
    slices = S.to_slices(S.range_slices(ranges, 16), "day")
    return S.slice_coverage(lines, "day", slices)


@register("estimate_new_rows", """
SELECT count(*) AS old_rows, datediff('day', min(l_shipdate), max(l_shipdate))::INT AS old_days, 45 AS new_days,
       round_even(count(*) * 45 / datediff('day', min(l_shipdate), max(l_shipdate))::DOUBLE, 0)::BIGINT AS new_rows,
       CASE WHEN round_even(count(*) * 45 / datediff('day', min(l_shipdate), max(l_shipdate))::DOUBLE, 0) < 1000000 THEN 'PLAIN' ELSE 'PLANNED' END AS read
FROM lineitem""")
def estimate_new_rows(spark, sf):
    return I.estimate_new_rows(table(spark, sf, "lineitem"), "l_shipdate", "2002-01-01", "2002-02-15")


@register("update_style", f"""
WITH {_ANALYSED_SQL}
SELECT table_id, style, CASE table_id % 3 WHEN 0 THEN 'DATE' WHEN 1 THEN 'TIMESTAMP(6)' ELSE 'NUMBER' END AS split_key_type,
       CASE WHEN style = 'POINT+FIXED' THEN 'PARTITION_UPDATE' WHEN table_id % 3 < 2 THEN 'INCREMENTAL' ELSE 'UNKNOWN' END AS update_style
FROM styled""")
def update_style(spark, sf):
    rest = F.col("table_id") % 3
    plans = S.import_style(_analysed(spark, sf)).select(
        "table_id", "style", F.when(rest == 0, "DATE").when(rest == 1, "TIMESTAMP(6)").otherwise("NUMBER").alias("split_key_type")
    )
    return I.update_style(plans)


@register("analyse_table", f"""
WITH {_scores_sql()}
SELECT col AS column_name, round(score_split, 6) AS score_split, round(score_job_split, 6) AS score_job_split,
       col = (SELECT arg_min(col, (-score_split, col)) FROM scored) AS is_split_key,
       col = (SELECT arg_min(col, (-score_job_split, col)) FROM scored) AS is_job_key FROM scored""")
def analyse_table(spark, sf):
    found = _analysed_orders(spark, sf)
    return found.scored.select(
        "column_name", F.round("score_split", 6).alias("score_split"), F.round("score_job_split", 6).alias("score_job_split"),
        (F.col("column_name") == found.split_key).alias("is_split_key"), (F.col("column_name") == found.job_key).alias("is_job_key"),
    )
