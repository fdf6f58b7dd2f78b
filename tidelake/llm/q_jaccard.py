"""op6: near-duplicate groups by shingle overlap, and how many sets each document links with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelake.llm.jaccard import similar_answers
from tidelake.llm.registry import register, table


@register("op6_ngram_jaccard")
def op6_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return similar_answers(table(spark, sf, "documents"))
