"""Small documents with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, node string, token string, score double"


def words(n: int, seed: int = 0) -> str:
    return " ".join(f"w{(i * 7919 + seed * 104729) % 9973}" for i in range(n))


def awkward_texts() -> list[tuple[int | None, str | None]]:
    base = words(60)
    near = base.replace(base.split()[30], "changed")
    return [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \t\n "), (7, "one two three"), (8, "ONE Two\tthree"),
        (9, "Größe naïve 日本語 😀 <|endoftext|> don't  stop\n\n½ ²"), (10, words(4000, 1)), (11, words(4000, 1) + " tail"),
        (12, "x" * 9000), (13, "1234 5678 !!! ***"), (14, base), (15, "same line here again and again\n" * 200), (16, words(60, 5)),
        (17, "prefix " + words(60, 5)), (18, "é" * 700 + " " + words(30, 9)), (19, words(30, 9)),
    ]


def documents(spark, texts=None, repeat: bool = False):
    texts = awkward_texts() if texts is None else texts
    rows = [(d, t, "en" if (d or 0) % 2 else "fr", "s", len(t or ""), 7, "n", "t", 0.5) for d, t in texts]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    return df.union(df) if repeat else df


def shingle_set(text: str | None, k: int = 5) -> frozenset:
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def jaccard_components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    sets = {d: shingle_set(t) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def jaccard_links(texts: dict[int, str | None]) -> dict[int, set[int]]:
    """The other sets, each named by its smallest id, that the set of a document links with."""
    heads: dict[frozenset, int] = {}
    for d in sorted(texts):
        if s := shingle_set(texts[d]):
            heads.setdefault(s, d)
    near = {a: {d for b, d in heads.items() if a != b and 100 * len(a & b) >= 80 * len(a | b)} for a in heads}
    return {d: near.get(shingle_set(t), set()) for d, t in texts.items()}


def repeat_spans(rows: list[tuple[int, bytes]], length: int = 50) -> list[tuple[int, list[tuple[int, int]]]]:
    starts = defaultdict(list)
    for d, t in rows:
        for p in range(len(t) - length + 1):
            starts[t[p : p + length]].append(d)
    first = {k: min(v) for k, v in starts.items()}
    out = []
    for d, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < d:
                gone[p : p + length] = [True] * length
        spans, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and gone[j] == gone[i]:
                j += 1
            if gone[i]:
                spans.append((i, j))
            i = j
        out.append((d, spans))
    return out
