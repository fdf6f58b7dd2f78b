"""Samples that read a sample: whole files chosen by seed.

``DataFrame.sample`` reads every row to keep a few. Here the files of a folder
are listed without opening them, each is chosen by a hash of its name and the
seed, and only the chosen ones are read, so bytes follow the fraction. The
price is a bias: rows of a file came in together and are alike, so the sample
weighs as many independent pieces as it has files, not rows, and what only
other files hold, such as the newest days, is missed. Use it for estimates that
something else widens.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.aggregates import key_range_widest
from tidelake.session import materialize
from tidelake.sources import footers


class BlockSample(NamedTuple):
    """The rows of the chosen files, and how much of the folder that is."""

    rows: DataFrame
    files: int
    files_read: int
    bytes: int
    bytes_read: int


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every Parquet file below a folder; no file is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return listed.select("path", "length")


def block_sample(spark: SparkSession, path: str, fraction: float, seed: int = 42) -> BlockSample:
    """The rows of about ``fraction`` of a folder's files; at least one file."""
    share = F.pmod(F.xxhash64(F.element_at(F.split("path", "/"), -1), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    files = materialize(data_files(spark, path).select("path", "length", share.alias("share")), "data-files")
    total = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"), F.min(F.struct("share", "path", "length")).alias("first")).first()
    source = spark.read.parquet(path)
    chosen = files.filter(F.col("share") < fraction).select("path", "length").collect() or ([total["first"]] if total["n"] else [])
    if not chosen:
        return BlockSample(source.limit(0), 0, 0, 0, 0)
    rows = spark.read.schema(source.schema).option("basePath", path).parquet(*[r["path"] for r in chosen])
    return BlockSample(rows, total["n"], len(chosen), total["b"], sum(r["length"] for r in chosen))


def cheap_key_range(
    spark: SparkSession, path: str, key: str, profiled: DataFrame | None = None, fraction: float = 0.01, seed: int = 42
) -> tuple[DataFrame, str]:
    """A range (``lo``, ``hi``) without a scan, and where it is from.

    ``FOOTERS``: exact. ``SAMPLE``: of a block sample, widened by a profiled
    range (columns ``lo``, ``hi``); values outside both are missed.
    """
    found = footers.key_range(spark, path, key)
    if found.from_footers:
        return found.rows, "FOOTERS"
    return key_range_widest(block_sample(spark, path, fraction, seed).rows, key, profiled), "SAMPLE"
