"""Balance, statistics, coverage and log reports over the lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.text import plain_log_line, size_in_kb
from tidelake.operators.aggregates import spread_of
from tidelake.operators.joins import join_case_blind, null_safe_join
from tidelake.sources.sinks import quoted


def storage_balance(files: DataFrame, table: str = "table_name", size: str = "size_text") -> DataFrame:
    """Per table, whether its files are about even: one file, or sd below the median size."""
    sized = files.select(table, size_in_kb(size).alias("kb"))
    counts = sized.groupBy(table).agg(F.count(F.lit(1)).alias("files"))
    spread = spread_of(sized, "kb", [table]).select(table, F.col("median").alias("median_kb"), F.col("sd").alias("sd_kb"))
    return null_safe_join(counts, spread, [table], "left").select(
        table, "files", "median_kb", "sd_kb",
        F.when(F.col("files") <= 1, True).otherwise(F.col("sd_kb") / F.col("median_kb") < 1).alias("in_balance"),
    )


def stats_present(stats: DataFrame) -> DataFrame:
    """False where the row count or the largest distinct count is -1, the mark for not computed."""
    return stats.select(
        "table_name", ((F.col("rows") != -1) & (F.col("max_ndv") != -1)).alias("stat_present")
    )


def table_info(files: DataFrame) -> DataFrame:
    """Size, rows, files and folder per table, from one row per file (table_name, path, bytes, rows)."""
    return files.groupBy("table_name").agg(
        F.sum("bytes").alias("bytes"),
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("files"),
        F.min(F.regexp_replace("path", "/[^/]*$", "")).alias("location"),
    )


def file_rows(df: DataFrame, table: str) -> DataFrame:
    """One row per data file a Parquet scan reads: path, bytes and rows."""
    return (
        df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        .groupBy("path", "bytes")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(table).alias("table_name"), "path", "bytes", "rows")
    )


def coverage_report(listing: DataFrame, catalogue: DataFrame, files: DataFrame, stats: DataFrame) -> DataFrame:
    """File listing and lake catalogue joined case-blind, with balance, statistics and size.

    ``files`` holds one row per file: table_name, path, size_text, bytes, rows.
    """
    def upper(df: DataFrame) -> DataFrame:
        return df.withColumn("table_name", F.upper("table_name"))

    balance = upper(storage_balance(files)).select("table_name", "in_balance")
    info = upper(table_info(files))
    return (
        join_case_blind(listing, catalogue, "table_name", "name")
        .join(balance, "table_name", "left")
        .join(upper(stats_present(stats)), "table_name", "left")
        .join(info.drop("location"), "table_name", "left")
    )


def table_summary(source: DataFrame, lake: DataFrame) -> DataFrame:
    """Source tables with their rows, whether the lake has them, and where."""
    landed = lake.select(
        F.upper("table_name").alias("_name"), F.col("location").alias("_location")
    ).dropDuplicates(["_name"])
    return source.join(landed, F.upper("table_name") == F.col("_name"), "left").select(
        *source.columns,
        F.col("_name").isNotNull().alias("present"),
        F.col("_location").alias("location"),
    )


def compute_stats(spark: SparkSession, table: str) -> None:
    spark.sql(f"ANALYZE TABLE {quoted(table)} COMPUTE STATISTICS FOR ALL COLUMNS")


def stored_stats(spark: SparkSession, table: str) -> DataFrame:
    """Row count and largest distinct count the catalog holds for a table, -1 where there is none."""
    def number(rows, pattern: str) -> int:
        found = rows.select(F.regexp_extract("v", pattern, 1).try_cast("bigint")).first()
        return found[0] if found and found[0] is not None else -1

    described = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)}")
    rows = number(described.filter("col_name = 'Statistics'").select(F.col("data_type").alias("v")), r"(\d+) rows")
    ndv = -1
    for c in spark.table(table).columns:
        col = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)} {quoted(c)}")
        ndv = max(ndv, number(col.filter("info_name = 'distinct_count'").select(F.col("info_value").alias("v")), r"(\d+)"))
    return spark.range(1).select(
        F.lit(table).alias("table_name"), F.lit(rows).cast("bigint").alias("rows"), F.lit(ndv).cast("bigint").alias("max_ndv")
    )


def job_log_metrics(log: DataFrame) -> DataFrame:
    """Per job: lines with an error, failed statuses, latest map and reduce percentage.

    ``log`` holds job_name, line_no and line. Every count merges before the
    shuffle, so one chatty job does not weigh on one task.
    """
    text = log.select("job_name", "line_no", plain_log_line("line").alias("t"))
    percents = r"map (\d+) reduce (\d+)"
    at = F.when(F.col("t").rlike(percents), F.col("line_no"))
    return text.groupBy("job_name").agg(
        F.count_if(F.col("t").contains("error")).alias("error_count"),
        F.count_if(F.col("t").contains("status failed")).alias("failed_count"),
        F.max_by(F.regexp_extract("t", percents, 1).try_cast("int"), at).alias("map_percent"),
        F.max_by(F.regexp_extract("t", percents, 2).try_cast("int"), at).alias("reduce_percent"),
    )
