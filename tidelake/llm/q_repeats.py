"""op7: repeated byte strings across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.registry import register, table
from tidelake.llm.repeats import remove_repeats


@register("op7_suffix_repeats")
def op7_suffix_repeats(spark: SparkSession, sf: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf, "documents"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
