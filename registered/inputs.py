"""Tables, and the stand-ins derived from them in Spark and in SQL alike."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUTOFF = dt.date(2000, 1, 1)
ORDER_TYPES = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}


# Partition keys of which some begin like others, one that is empty and one that is NULL.
PART_SQL = "CASE {0} % 7 WHEN 0 THEN '1' WHEN 1 THEN '10' WHEN 2 THEN '11' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN '2' ELSE 'n/a' END"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def landed(orders: DataFrame) -> DataFrame:
    """Orders as landing holds them: the date as text."""
    return orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


def landed_twice(orders: DataFrame) -> DataFrame:
    """Landing in which the urgent orders were loaded twice."""
    return landed(orders.unionByName(orders.filter("o_orderpriority = '1-URGENT'")))


LANDED_SQL = """landing AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
  FROM orders)"""


def order_days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"))


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Parts standing in for a source catalogue: brands own tables."""
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("db"),
        F.concat_ws("_", F.regexp_replace("p_name", " ", "_"), "p_partkey").alias("table_name"),
        F.when(F.col("p_size") % 5 == 0, "View").otherwise("Table").alias("type"),
    )


CATALOGUE_SQL = """catalogue AS (
  SELECT p_brand AS db, replace(p_name, ' ', '_') || '_' || p_partkey AS table_name,
         CASE WHEN p_size % 5 = 0 THEN 'View' ELSE 'Table' END AS type
  FROM part)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders standing in for landed files: a table per customer group and a size with a unit."""
    unit = F.element_at(F.array(F.lit("KB"), F.lit("MB"), F.lit("KB"), F.lit("B")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        F.concat(F.lit("tab_"), F.col("o_custkey") % 40).alias("table_name"),
        F.concat(F.lit("/lake/tab_"), F.col("o_custkey") % 40, F.lit("/part-"), "o_orderkey").alias("path"),
        F.concat((F.col("o_custkey") % 900 + 100).cast("string"), F.lit("."), F.col("o_orderkey") % 10, unit).alias("size_text"),
        (F.col("o_custkey") * 10).alias("bytes"),
        (F.col("o_orderkey") % 1000).alias("rows"),
    )


FILES_SQL = """files AS (
  SELECT 'tab_' || (o_custkey % 40) AS table_name,
         '/lake/tab_' || (o_custkey % 40) || '/part-' || o_orderkey AS path,
         (o_custkey % 900 + 100) || '.' || (o_orderkey % 10) ||
           CASE o_orderkey % 4 WHEN 0 THEN 'KB' WHEN 1 THEN 'MB' WHEN 2 THEN 'KB' ELSE 'B' END AS size_text,
         o_custkey * 10 AS bytes, o_orderkey % 1000 AS rows
  FROM orders)"""


def lake_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Customers standing in for lake table statistics; -1 means not computed."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("tab_"), key).alias("table_name"),
        F.when(key % 7 == 0, -1).otherwise(key * 3).alias("rows"),
        F.when(key % 11 == 0, -1).otherwise(key + 1).alias("max_ndv"),
    )


STATS_SQL = """stats AS (
  SELECT 'tab_' || c_custkey AS table_name,
         CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_custkey * 3 END AS rows,
         CASE WHEN c_custkey % 11 = 0 THEN -1 ELSE c_custkey + 1 END AS max_ndv
  FROM customer)"""
