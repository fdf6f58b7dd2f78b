"""op5: exact top-k search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.registry import register, table
from tidelake.llm.vectors import search


@register("op5_topk_search", sql="""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
queries AS (SELECT vec_id AS query_id, v AS q FROM usable WHERE vec_id % 100 = 0),
scored AS (
  SELECT query_id, vec_id,
         CAST(list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i] * v[i])) AS BIGINT) AS score
  FROM queries JOIN usable ON vec_id <> query_id AND len(q) = len(v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
""")
def op5_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    return search(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)
