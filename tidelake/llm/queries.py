"""All registered queries of this folder, and the pipeline."""

import corpus_pipeline
from tidelake.llm import (  # noqa: F401
    q_align, q_bpe, q_chat, q_decontaminate, q_jaccard, q_langid, q_maxent, q_negatives, q_quality, q_repeats, q_secrets, q_vectors, q_warc,
)
from tidelake.llm.registry import ORACLES, QUERIES, register

if "pipeline" not in QUERIES:
    register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
