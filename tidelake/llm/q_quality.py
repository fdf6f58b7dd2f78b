"""op4: quality scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import quality
from tidelake.llm.registry import register, table

GOOD = 0.3


@register("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = quality.train(docs, table(spark, sf, "labels"), fold != 0)
    scored = quality.score(docs, model, "doc_id")
    return scored.select(
        "doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )
