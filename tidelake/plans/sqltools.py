"""Parameterised SQL and summaries of any query's output."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_sql(spark: SparkSession, text: str, params: Mapping[str, object] | None = None) -> DataFrame:
    """Run SQL with ``:name`` markers bound; lists become arrays, names go through ``IDENTIFIER(:name)``."""
    bound = {
        k: F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else v
        for k, v in (params or {}).items()
    }
    return spark.sql(text, args=bound)


def run_sql_file(spark: SparkSession, path: str, params: Mapping[str, object] | None = None) -> DataFrame:
    """As ``run_sql`` for a file any Spark file system holds."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return run_sql(spark, text, params)


def wrap_custom(query: DataFrame, columns: list[str], suffix: str = "") -> DataFrame:
    """Select SQL expressions over a query's output, with an optional clause such as GROUP BY after it."""
    text = f"SELECT {', '.join(columns)} FROM {{wrapped}} {suffix}"
    return query.sparkSession.sql(text, wrapped=query)


def wrap_count(query: DataFrame) -> DataFrame:
    return query.agg(F.count(F.lit(1)).alias("num_rows"))


def wrap_limit(query: DataFrame, rows: int = 10) -> DataFrame:
    return query.limit(rows)
