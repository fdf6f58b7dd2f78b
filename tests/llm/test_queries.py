"""The registered queries: against their SQL, or against brute force where SQL cannot state them."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
from tests.harness import compare
from tests.llm.fixtures import jaccard_components, jaccard_links, repeat_spans
from tidelake.llm import queries
from tidelake.llm.q_bpe import TOKENIZER


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, con, name):
    assert compare(queries.QUERIES[name](spark, sf), queries.ORACLES[name], con) is None


def test_all_are_registered():
    assert set(queries.QUERIES) <= set(entry_points.queries())
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in queries.QUERIES) == 1
    assert "pipeline" in queries.QUERIES


def test_op1(spark, sf, texts):
    tool = Tokenizer.from_file(TOKENIZER)
    rows = queries.QUERIES["op1_bpe_chunks"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tool.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        want = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tool.decode(ids, skip_special_tokens=False).encode()))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_op3(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op3_language_id"](spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    asked = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in asked]) >= 0.97


def test_op4(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest tables have some twenty labels that are held out
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op4_quality_rules"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    asked = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(asked) > 50 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in asked]) >= 0.9


def test_op6(spark, sf, texts):
    rows = queries.QUERIES["op6_ngram_jaccard"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == jaccard_components(texts)


def test_op6_links(spark, sf, texts):
    rows = queries.QUERIES["op6_ngram_jaccard"](spark, sf).collect()
    assert {r["doc_id"]: r["n_links"] for r in rows} == {d: len(x) for d, x in jaccard_links(texts).items()}


def test_op7(spark, sf, texts):
    raw = {d: (t or "").encode() for d, t in texts.items()}
    rows = {r["doc_id"]: r for r in queries.QUERIES["op7_suffix_repeats"](spark, sf).collect()}
    for d, spans in repeat_spans(list(raw.items())):
        kept, at = b"", 0
        for a, b in [*spans, (len(raw[d]), 0)]:
            kept, at = kept + raw[d][at:a], b
        r = rows[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw[d]), len(raw[d]) - len(kept), len(spans), sha(kept))


def test_pipeline(spark, sf):
    assert queries.QUERIES["pipeline"](spark, sf).columns == ["doc_id", "n_tokens", "ids"]
