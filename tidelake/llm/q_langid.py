"""op3: language identification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import langid
from tidelake.llm.registry import register, table


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


@register("op3_language_id")
def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.train(docs, ~held_out())
    return langid.predict(docs, model, "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
