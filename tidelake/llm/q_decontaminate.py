"""op9: benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.decontaminate import contamination
from tidelake.llm.registry import register, table

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

HITS_SQL = rf"""doc_words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORDS}') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all({_LOWER}, '{WORDS}') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM item_words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 8, 2))) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
hits AS (
  SELECT DISTINCT doc_id, size, i, win FROM (
    SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
    FROM doc_words, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)
    WHERE len(w) >= size) SEMI JOIN windows USING (size, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits JOIN windows USING (size, win)) GROUP BY doc_id)"""


@register("op9_decontaminate", sql=f"""
WITH {HITS_SQL}
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op9_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["stop"] - r["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
