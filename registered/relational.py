"""Scans, projections, predicates, joins, sets and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered import register
from registered.inputs import (
    CATALOGUE_SQL,
    CUTOFF,
    LANDED_SQL,
    ORDER_TYPES,
    catalogue,
    landed,
    landed_twice,
    order_days,
    table,
)
from tidelake.functions import predicates as P
from tidelake.operators import catalogue as C
from tidelake.operators import joins as J
from tidelake.operators import schema as S
from tidelake.operators import sets as U
from tidelake.plans import gold as G
from tidelake.session import materialize
from tidelake.sources.files import scan_parquet


@register("scan_parquet", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 40")
def scan(spark, sf):
    rows = scan_parquet(spark, f"{sf}/lineitem.parquet")
    return rows.filter("l_quantity >= 40").select("l_orderkey", "l_partkey", "l_quantity")


# Column metadata made of parts, so that it grows with the data.
_COLUMNS_SQL = """
  SELECT 'COL_' || p_partkey AS COLUMN_NAME,
         CASE p_partkey % 9 WHEN 0 THEN 'NUMBER' WHEN 1 THEN 'NUMBER' WHEN 2 THEN 'VARCHAR2' WHEN 3 THEN 'DATE'
              WHEN 4 THEN 'TIMESTAMP(6)' WHEN 5 THEN 'BINARY_DOUBLE' WHEN 6 THEN 'CLOB'
              WHEN 7 THEN 'NUMBER' ELSE 'NVARCHAR2' END AS DATA_TYPE,
         CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 38 + 1 END AS DATA_PRECISION,
         CASE WHEN p_size % 4 = 1 THEN 2 WHEN p_size % 4 = 2 THEN 0 ELSE NULL END AS DATA_SCALE
  FROM part"""


@register("type_map", f"""
WITH columns_ AS ({_COLUMNS_SQL}),
typed AS (SELECT *, coalesce(DATA_PRECISION, 38) AS p, coalesce(DATA_SCALE, 0) AS s FROM columns_),
number_ AS (SELECT *, CASE WHEN s > 0 THEN 'decimal(' || p || ',' || s || ')' WHEN p < 10 THEN 'int'
                           WHEN p <= 18 THEN 'bigint' ELSE 'decimal(' || p || ',0)' END AS num FROM typed)
SELECT COLUMN_NAME, DATA_TYPE, DATA_PRECISION, DATA_SCALE,
       CASE WHEN DATA_TYPE = 'NUMBER' THEN num WHEN DATA_TYPE = 'BINARY_DOUBLE' THEN 'double' ELSE 'string' END AS landing_type,
       CASE WHEN DATA_TYPE = 'NUMBER' THEN num WHEN DATA_TYPE = 'BINARY_DOUBLE' THEN 'double'
            WHEN DATA_TYPE IN ('DATE', 'TIMESTAMP(6)') THEN 'timestamp_ntz' ELSE 'string' END AS gold_type
FROM number_""")
def type_map(spark, sf):
    kinds = ["NUMBER", "NUMBER", "VARCHAR2", "DATE", "TIMESTAMP(6)", "BINARY_DOUBLE", "CLOB", "NUMBER", "NVARCHAR2"]
    size = F.col("p_size")
    columns = table(spark, sf, "part").select(
        F.concat(F.lit("COL_"), "p_partkey").alias("COLUMN_NAME"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 9 + 1).cast("int")).alias("DATA_TYPE"),
        F.when(size % 4 != 0, size % 38 + 1).alias("DATA_PRECISION"),
        F.when(size % 4 == 1, 2).when(size % 4 == 2, 0).alias("DATA_SCALE"),
    )
    return S.type_map(columns)


_RAW_PRICE_SQL = "CASE WHEN o_orderkey % 100 = 7 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END"


def _raw_orders(spark, sf):
    """Landing with every value as text, a hundredth of the prices unreadable."""
    price = F.when(F.col("o_orderkey") % 100 == 7, "n/a").otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
    rows = landed(table(spark, sf, "orders")).withColumn("o_totalprice", price)
    return rows.withColumn("o_orderkey", F.col("o_orderkey").cast("string"))


_TYPED_SQL = f"""
SELECT o_orderkey, o_custkey, o_orderstatus, TRY_CAST({_RAW_PRICE_SQL} AS DOUBLE) AS o_totalprice, o_orderdate, o_orderpriority
FROM orders"""


@register("gold_cast", _TYPED_SQL)
def gold_cast(spark, sf):
    return S.cast_columns(_raw_orders(spark, sf), ORDER_TYPES)


@register("gold_cast_append", _TYPED_SQL)
def gold_cast_append(spark, sf):
    return S.cast_for_append(_raw_orders(spark, sf), ORDER_TYPES)


@register("cast_failures", """
SELECT c AS column_name, CAST(CASE WHEN c = 'o_totalprice' THEN (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 7) ELSE 0 END AS BIGINT) AS failed
FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) v(c)""")
def cast_failures(spark, sf):
    return S.cast_failures(_raw_orders(spark, sf), ORDER_TYPES)


@register("schema_align", """
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(NULL AS DOUBLE) AS o_totalprice, o_orderdate, o_orderpriority FROM orders""")
def schema_align(spark, sf):
    gold = table(spark, sf, "orders")
    landing = landed(gold).select(F.lit(1).alias("load_id"), "o_orderpriority", "o_orderdate", "o_orderstatus", "o_custkey", "o_orderkey")
    return S.align(landing, gold.schema, fill_null=True)


@register("compare_num", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45.5")
def compare_num(spark, sf):
    return table(spark, sf, "lineitem").filter(P.compare("l_quantity", 45.5, ">")).select("l_orderkey", "l_linenumber", "l_quantity")


@register("compare_str", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def compare_str(spark, sf):
    return table(spark, sf, "orders").filter(P.compare("o_orderpriority", "1-URGENT")).select("o_orderkey", "o_orderpriority")


@register("compare_date", f"""
WITH {LANDED_SQL}
SELECT 'landing' AS layer, o_orderkey, o_orderdate AS day FROM landing WHERE substr(o_orderdate, 1, 10) <= '1995-06-30'
UNION ALL
SELECT 'gold', event_id, strftime(ts, '%Y-%m-%d') FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-15'""")
def compare_date(spark, sf):
    text = landed(table(spark, sf, "orders")).filter(P.compare("o_orderdate", "1995-06-30", "<=", landed=True))
    typed = table(spark, sf, "events").filter(P.compare("ts", "2024-01-15"))
    return text.select(F.lit("landing").alias("layer"), "o_orderkey", F.col("o_orderdate").alias("day")).union(
        typed.select(F.lit("gold"), "event_id", F.date_format("ts", "yyyy-MM-dd"))
    )


@register("compare_ts", """
SELECT event_id, ts FROM events WHERE substr(strftime(ts, '%Y-%m-%d %H:%M:%S'), 1, 19) > '2024-01-20 12:00:00'""")
def compare_ts(spark, sf):
    return table(spark, sf, "events").filter(P.compare("ts", "2024-01-20 12:00:00", ">")).select("event_id", "ts")


@register("prefix_in", f"""
WITH {LANDED_SQL},
wanted AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS k FROM orders WHERE day(o_orderdate) = 14 UNION ALL SELECT '' UNION ALL SELECT '1995')
SELECT o_orderkey, o_orderdate FROM landing WHERE substr(o_orderdate, 1, 10) IN (SELECT k FROM wanted)""")
def prefix_in(spark, sf):
    orders = table(spark, sf, "orders")
    wanted = orders.filter("day(o_orderdate) = 14").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("k"))
    # neither an empty nor a short key shortens the comparison
    wanted = wanted.union(spark.createDataFrame([("",), ("1995",)], "k string"))
    return G.prefix_in(landed(orders), "o_orderdate", wanted, "k", 10).select("o_orderkey", "o_orderdate")


@register("range_slice", """
SELECT 'half_open' AS kind, o_orderkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 5000
UNION ALL SELECT 'closed', o_orderkey FROM orders WHERE o_orderkey BETWEEN 1000 AND 5000""")
def range_slice(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return orders.filter(P.in_range("o_orderkey", 1000, 5000)).select(F.lit("half_open").alias("kind"), "o_orderkey").union(
        orders.filter(P.in_range("o_orderkey", 1000, 5000, closed=True)).select(F.lit("closed"), "o_orderkey")
    )


@register("sample_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def sample_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(20)


@register("percent_sample", """
SELECT true AS about_wanted, true AS known, true AS once, true AS clipped FROM lineitem HAVING count(*) > 0""")
def percent_sample(spark, sf):
    """A twentieth of the rows, within six standard deviations; all known, none twice; the percentage clipped."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    sample = materialize(P.percent_sample(lines, 5.0), "sample")
    rows = lines.count()
    few = P.percent_sample(lines, P.sample_percent_for(rows, rows // 10))
    spread = 6 * (rows * 0.05 * 0.95) ** 0.5
    found = sample.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey", "l_linenumber", "l_shipdate").alias("d"))
    apart = sample.exceptAll(lines).agg(F.count(F.lit(1)).alias("strange"))
    twice = lines.groupBy("l_orderkey", "l_linenumber", "l_shipdate").count().agg(F.sum(F.col("count") - 1).alias("equal"))
    part = few.agg(F.count(F.lit(1)).alias("few"))
    one = found.join(apart, F.lit(True)).join(part, F.lit(True)).join(twice, F.lit(True))
    return one.select(
        (F.abs(F.col("n") - rows * 0.05) <= spread).alias("about_wanted"), (F.col("strange") == 0).alias("known"),
        (F.col("n") - F.col("d") <= F.col("equal")).alias("once"), (F.col("few") < F.lit(rows)).alias("clipped"),
    )


@register("catalogue_flags", """
SELECT p_brand AS OWNER, CASE WHEN p_partkey % 13 = 0 THEN 'Tmp_' ELSE '' END || p_name AS TABLE_NAME,
       p_partkey * 7919 % 20000 AS NUM_ROWS,
       p_partkey * 7919 % 20000 > 100 AS is_split_required, p_partkey * 7919 % 20000 > 10000 AS is_job_split_required,
       p_partkey % 13 = 0 AS is_temp
FROM part""")
def catalogue_flags(spark, sf):
    tables = table(spark, sf, "part").select(
        F.col("p_brand").alias("OWNER"),
        F.concat(F.when(F.col("p_partkey") % 13 == 0, "Tmp_").otherwise(""), "p_name").alias("TABLE_NAME"),
        (F.col("p_partkey") * 7919 % 20000).alias("NUM_ROWS"),
    )
    return C.catalogue_flags(tables, rows_per_split=100)


_TERMS = ["small_ring_0", "BRAND#17", "widget_1", "red_widget_", "ring_40", "Brand#2", "brand", "nothing"]
_TERMS_SQL = ", ".join(f"('{t.lower()}')" for t in _TERMS)


@register("catalogue_search", f"""
WITH {CATALOGUE_SQL},
terms(term) AS (VALUES {_TERMS_SQL}),
hits AS (
  SELECT term, 1 AS match_class, db, table_name FROM terms JOIN catalogue ON lower(table_name) = term
  UNION ALL SELECT term, 2, db, table_name FROM terms JOIN catalogue ON lower(db) = term
  UNION ALL SELECT term, 3, db, table_name FROM terms JOIN catalogue ON contains(lower(table_name), term)
  UNION ALL SELECT term, 4, db, table_name FROM terms JOIN catalogue ON contains(lower(db), term)),
sizes AS (SELECT term, match_class, count(*) AS n FROM hits GROUP BY ALL),
chosen AS (SELECT term, min(match_class) AS match_class FROM sizes WHERE match_class IN (2, 4) OR n = 1 GROUP BY term)
SELECT h.term, h.match_class, h.db, h.table_name FROM hits h JOIN chosen c ON h.term = c.term AND h.match_class = c.match_class""")
def catalogue_search(spark, sf):
    return C.catalogue_search(catalogue(spark, sf), _TERMS)


@register("majority_remap", """
WITH map AS (SELECT DISTINCT c_mktsegment AS search, 'SEG_' || substr(c_mktsegment, 1, 3) AS replace_ FROM customer WHERE c_mktsegment <> 'MACHINERY')
SELECT c_custkey, upper(c_name) AS c_name, m.replace_ AS c_mktsegment
FROM customer LEFT JOIN map m ON upper(c_mktsegment) = m.search WHERE m.replace_ IS NOT NULL""")
def majority_remap(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.initcap("c_mktsegment").alias("c_mktsegment"))
    mapping = (
        table(spark, sf, "customer")
        .filter("c_mktsegment <> 'MACHINERY'")
        .select(F.lower("c_mktsegment").alias("search"), F.concat(F.lit("SEG_"), F.substring("c_mktsegment", 1, 3)).alias("replace"))
        .distinct()
    )
    return C.majority_remap(rows, mapping, required="c_mktsegment")


@register("join_catalogue", """
SELECT upper(s_name) AS table_name, s_suppkey AS file_id, c_custkey AS table_id
FROM supplier JOIN customer ON upper(replace(s_name, 'Supplier', 'Customer')) = upper(c_name)""".replace("upper(s_name) AS", "upper(c_name) AS"))
def join_catalogue(spark, sf):
    listing = table(spark, sf, "supplier").select(
        F.lower(F.regexp_replace("s_name", "Supplier", "Customer")).alias("table_name"), F.col("s_suppkey").alias("file_id")
    )
    lake = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("table_id"))
    return J.join_case_blind(listing, lake, "table_name", "name")


@register("join_lookup", """
SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey""")
def join_lookup(spark, sf):
    mapping = table(spark, sf, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.lookup(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), mapping, "c_nationkey")


@register("join_three_key", """
WITH cols AS (SELECT DISTINCT o_orderstatus AS OWNER, o_orderpriority AS TABLE_NAME, 'C' || (o_custkey % 7) AS COLUMN_NAME,
                     CASE WHEN o_custkey % 7 < 4 THEN 'NUMBER' ELSE 'DATE' END AS DATA_TYPE, o_custkey % 7 AS COLUMN_ID FROM orders WHERE o_custkey % 7 > 0),
stats AS (SELECT o_orderstatus AS OWNER, o_orderpriority AS TABLE_NAME, 'C' || (o_custkey % 7) AS COLUMN_NAME,
                 CAST(year(o_orderdate) AS VARCHAR) AS PARTITION_NAME,
                 CAST(min(o_orderkey) AS VARCHAR) AS LOW_VALUE, CAST(max(o_orderkey) AS VARCHAR) AS HIGH_VALUE FROM orders GROUP BY ALL)
SELECT s.TABLE_NAME, c.DATA_TYPE, s.COLUMN_NAME, s.PARTITION_NAME, s.LOW_VALUE, s.HIGH_VALUE, c.COLUMN_ID
FROM stats s JOIN cols c ON s.OWNER = c.OWNER AND s.TABLE_NAME = c.TABLE_NAME AND s.COLUMN_NAME = c.COLUMN_NAME
 AND s.OWNER = 'F' AND s.TABLE_NAME = '1-URGENT'""")
def join_three_key(spark, sf):
    base = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("OWNER"), F.col("o_orderpriority").alias("TABLE_NAME"),
        F.concat(F.lit("C"), F.col("o_custkey") % 7).alias("COLUMN_NAME"),
        (F.col("o_custkey") % 7).alias("COLUMN_ID"), "o_orderkey", "o_orderdate",
    )
    columns = base.filter("COLUMN_ID > 0").select(
        "OWNER", "TABLE_NAME", "COLUMN_NAME", F.when(F.col("COLUMN_ID") < 4, "NUMBER").otherwise("DATE").alias("DATA_TYPE"), "COLUMN_ID"
    ).distinct()
    stats = base.groupBy("OWNER", "TABLE_NAME", "COLUMN_NAME", F.year("o_orderdate").cast("string").alias("PARTITION_NAME")).agg(
        F.min("o_orderkey").cast("string").alias("LOW_VALUE"), F.max("o_orderkey").cast("string").alias("HIGH_VALUE")
    )
    return J.join_partition_columns(stats, columns, "F", "1-URGENT")


def _source_and_lake(spark, sf):
    days = order_days(spark, sf)
    return days.distinct(), days.filter("day(day) % 7 <> 0").distinct()


_DAYS_SQL = """source AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
lake AS (SELECT DISTINCT day FROM source WHERE day(day) % 7 <> 0)"""


@register("join_anti", f"WITH {_DAYS_SQL} SELECT day FROM source WHERE day NOT IN (SELECT day FROM lake)")
def join_anti(spark, sf):
    return J.keys_not_in(*_source_and_lake(spark, sf), "day")


@register("join_semi", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def join_semi(spark, sf):
    wanted = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return J.keys_in(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), wanted, "o_custkey")


@register("join_natural", """
SELECT l_partkey, l_orderkey, l_quantity, p_name, p_size
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def join_natural(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_quantity")
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.lit(0.0).alias("L_QUANTITY"), "p_name", "p_size"
    )
    return J.natural_join(lines, parts, "l_partkey")


@register("ordered_catalogue", f"""
WITH {CATALOGUE_SQL}
SELECT db, table_name, type, count(*) OVER (PARTITION BY db) AS num_tables FROM catalogue""")
def ordered_catalogue(spark, sf):
    return C.ordered_catalogue(catalogue(spark, sf))


@register("tables_per_owner", f"WITH {CATALOGUE_SQL} SELECT db, count(*) AS num_tables FROM catalogue GROUP BY db")
def tables_per_owner(spark, sf):
    return C.owner_counts(catalogue(spark, sf))


@register("union_distinct", f"""
WITH {CATALOGUE_SQL}
SELECT DISTINCT db, table_name, 'Table' AS type FROM catalogue WHERE type = 'Table'
UNION SELECT DISTINCT db, table_name, 'View' FROM catalogue""")
def union_distinct(spark, sf):
    listed = catalogue(spark, sf)
    tables = listed.filter("type = 'Table'")
    return C.table_catalogue(tables.union(tables), listed)


@register("union_keys", """
SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 5000""")
def union_keys(spark, sf):
    left = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    right = table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("key"))
    return U.union_keys(left, right, "key")


def _customers(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    right = table(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("key"))
    return left, right


@register("except_keys", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 450000")
def except_keys(spark, sf):
    return U.except_keys(*_customers(spark, sf), "key")


@register("intersect_keys", "SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 450000")
def intersect_keys(spark, sf):
    return U.intersect_keys(*_customers(spark, sf), "key")


@register("symmetric_difference", """
WITH a AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_totalprice > 300000),
b AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_totalprice < 30000)
SELECT key, 'left' AS side FROM a WHERE key NOT IN (SELECT key FROM b)
UNION ALL SELECT key, 'right' FROM b WHERE key NOT IN (SELECT key FROM a)""")
def symmetric_difference(spark, sf):
    keys = table(spark, sf, "orders").withColumnRenamed("o_custkey", "key")
    return U.symmetric_difference(keys.filter("o_totalprice > 300000"), keys.filter("o_totalprice < 30000"), "key")


@register("union_all", """
SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def union_all(spark, sf):
    return U.union_all(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")),
    )


@register("distinct_rows", f"""
WITH {LANDED_SQL}, twice AS (SELECT * FROM landing UNION ALL SELECT * FROM landing WHERE o_orderpriority = '1-URGENT')
SELECT DISTINCT * FROM twice""")
def distinct_rows(spark, sf):
    return U.distinct_rows(landed_twice(table(spark, sf, "orders")))
