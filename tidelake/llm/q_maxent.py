"""op12: language-model scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.maxent import score
from tidelake.llm.registry import register, table


@register("op12_maxent_scores")
def op12_maxent_scores(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score(table(spark, sf, "documents"), held_out)
