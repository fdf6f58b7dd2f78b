"""op11: cross-tokenizer alignment."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelake.llm.align import Aligned, Pair, linked
from tidelake.llm.registry import register, table

PAIR = Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def digests(got: Aligned) -> list[list]:
    """The digest of each text's groups; '' for a text without tokens."""
    written, at = got.written_groups()
    return [[hashlib.sha256(written[i:j]).hexdigest() if j > i else "" for i, j in zip(at[:-1], at[1:], strict=True)]]


@register("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return linked(table(spark, sf, "documents"), PAIR, {"groups_sha256": pa.string()}, digests)
