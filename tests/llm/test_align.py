"""Cross-tokenizer alignment against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.fixtures import DOC_SCHEMA, awkward_texts, documents
from tidelake.llm import align, queries
from tidelake.llm.q_align import PAIR, digests


def spans(pieces: list[bytes]) -> list[tuple[int, int]]:
    ends = np.cumsum([len(p) for p in pieces]).tolist()
    return list(zip([0, *ends], ends))


class Brute:
    """Both libraries called plainly, and every pair of tokens compared."""

    def __init__(self):
        self.a = Tokenizer.from_file(PAIR.a_path)
        self.a.encode_special_tokens = True
        letters = {v: k for k, v in align._byte_letters().items()}
        self.byte = {v: k for k, v in letters.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=PAIR.b_path)

    def tokens(self, text):
        if not text:
            return [], [], [], []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        bytes_a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        bytes_b = [bytes([i - 3]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return [], [], [], []
        return a, b, spans(bytes_a), spans(bytes_b)

    def rows(self, texts):
        found = []
        counts = Counter()
        for doc, text in texts:
            a, b, at_a, at_b = self.tokens(text)
            links, first = [], 0
            for i, (s, e) in zip(a, at_a, strict=True):
                while first < len(b) and at_b[first][1] <= s:
                    first += 1
                j = first
                while j < len(b) and at_b[j][0] < e:
                    links.append((i, b[j]))
                    j += 1
            cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
            groups = [(",".join(str(i) for i, (s, _) in zip(a, at_a, strict=True) if x <= s < y), ",".join(str(i) for i, (s, _) in zip(b, at_b, strict=True) if x <= s < y))
                      for x, y in zip([0, *cuts], cuts)] if len(a) < 3000 else None
            counts.update(links)
            found.append((doc, a, b, cuts, groups, links))
        highest: dict[int, int] = {}
        for (_, b), n in counts.items():
            highest[b] = max(highest.get(b, 0), n)
        for doc, a, b, cuts, groups, links in found:
            said = None if groups is None else hashlib.sha256(";".join(f"{x}|{y}" for x, y in groups).encode()).hexdigest() if groups else ""
            yield (doc, len(a), len(b), len(cuts), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links)), said


def check(rows, texts):
    got = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    want = sorted(Brute().rows(texts), key=lambda r: (r[0][0] is None, r[0][0]))
    assert len(got) == len(want)
    for r, (numbers, said) in zip(got, want, strict=True):
        assert (r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == numbers
        assert said is None or r["groups_sha256"] == said


AWKWARD = [
    *awkward_texts(), (20, "<|endoftext|> <s> </s> <unk> <0x41> ▁ x"), (21, "a" + " " * 9000 + "b"), (22, "\x00\x01 nul"),
    (23, "ﬁ ½ Ａ   é é ​"), (24, "   lead and trail   "), (25, "\n\n"), (None, "one two three"),
]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=90), st.lists(st.integers(1, 9), min_size=1, max_size=90), st.sampled_from([2, 7, 128]))
def test_common_ends_and_links(a, b, lane):
    a, b = np.cumsum(a), np.cumsum(b)
    n = max(a[-1], b[-1])
    a, b = np.unique(np.append(a, n)), np.unique(np.append(b, n))
    before, align.LANE = align.LANE, lane
    try:
        in_a, in_b = align.common_ends(a, b)
    finally:
        align.LANE = before
    both = np.intersect1d(a, b)
    assert a[in_a].tolist() == both.tolist() == b[in_b].tolist()
    from_a, from_b = np.append(0, a[:-1]), np.append(0, b[:-1])
    want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(from_a[i], from_b[j]) < min(a[i], b[j])]
    assert sorted(zip(*(x.tolist() for x in align.links(a, b, in_b)), strict=True)) == want


@pytest.mark.parametrize("part", [align.PART_BYTES, 500])
def test_awkward_texts(spark, monkeypatch, part):
    monkeypatch.setattr(align, "PART_BYTES", part)
    docs = documents(spark, AWKWARD)
    rows = align.linked(docs, PAIR, {"groups_sha256": align.pa.string()}, digests).collect()
    check(rows, AWKWARD)


def test_repeated_rows_are_counted_each(spark):
    docs = documents(spark, AWKWARD[:4], repeat=True)
    rows = align.linked(docs, PAIR, {"groups_sha256": align.pa.string()}, digests).collect()
    check(rows, [*AWKWARD[:4], *AWKWARD[:4]])


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOC_SCHEMA)
    assert align.linked(docs, PAIR, {"groups_sha256": align.pa.string()}, digests).count() == 0
    assert align.alignments(docs, PAIR).count() == 0


def test_groups_are_the_ids_in_order(spark):
    tool = Brute()
    for r in align.alignments(documents(spark, AWKWARD), PAIR).collect():
        a, b, at_a, at_b = tool.tokens(dict(AWKWARD)[r["doc_id"]])
        assert (r["a_ids"], r["b_ids"]) == (a, b)
        assert [at_a[g["a_end"] - 1][1] for g in r["groups"]] == [at_b[g["b_end"] - 1][1] for g in r["groups"]] \
            == sorted({e for _, e in at_a} & {e for _, e in at_b})


def test_op11(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(queries.QUERIES["op11_token_alignment"](spark, sf).collect(), texts)
