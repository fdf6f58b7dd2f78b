"""op1: BPE encoding and decoding."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelake.llm.bpe import Codec, encode_distinct, per_document
from tidelake.llm.registry import register, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DIGESTS = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def digests(tool: Codec, ids: np.ndarray) -> tuple:
    """Number and digest of the ids, and the digest of the text decoded from them."""
    text = tool.decode(ids)
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


@register("op1_bpe_chunks")
def op1_bpe_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return per_document(docs, encode_distinct(docs, TOKENIZER, DIGESTS, digests), "doc_id")
