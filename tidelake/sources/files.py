"""Parquet, CSV and text scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_stats_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Every CSV file of a folder with its header; ``table_name`` is the file name without extension.

    Give the schema where it is known: inferring types reads the files twice.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.option("pathGlobFilter", "*.csv").csv(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    return df.select("*", name.alias("table_name"))


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """Every line of every file below ``path``, with the file it came from."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .text(path)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    )


def scan_file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Path and bytes of every file below ``path``, without reading the files' content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.col("length").alias("bytes"))
    )
