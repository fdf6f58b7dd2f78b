"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted shallow trees on a bounded labelled sample are taken apart into the
conjunctions on their paths. A lasso-penalised logistic regression weighs these
rules, and the rules left are compiled into one Spark column expression over
the statistics, which come from numpy inside each task over whole texts.

Defined cases: a null or empty text has zero statistics and gets a score like
any other; a document labelled more than once counts once, with its smallest
non-null label; of rows that share an id the least text is learned from; with labels of one kind only every score is that label's share,
and 0.5 without labels; rows are scored one by one, so repeated rows and an
empty table need no care; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.arrays import Words, row_groups, utf8

#: Most labelled rows a model is fitted on; a hash of the document id picks them.
SAMPLE_ROWS = 12_000
TREES, DEPTH, BINS = 48, 3, 32
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\f\v", "newline": b"\n",
    "stop": b".?", "comma": b",;:", "bang": b"!", "bar": b"|", "symbol": b"#$%&*@^~<>_=+\\/{}[]", "quote": b"\"'()-",
}
STATISTICS = (
    "chars", "words", "lines", "word_chars", "upper", "digit", "stop", "comma", "bang", "bar", "symbol", "quote",
    "distinct_words", "repeats", "distinct_lines", "line_words", "short_words", "long_words", "capital_words", "marked_words",
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_IS = {name: _table(chars) for name, chars in _CLASSES.items()}
_WORD = ~_table(b" \t\n\r\f\v")
_LINE = ~_table(b"\n")
_MARK = _IS["symbol"] | _IS["bang"] | _IS["bar"]


def _distinct(words: Words, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct words of each row."""
    keyed = words.hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.bincount(rows[np.unique(keyed, return_index=True)[1]], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each row, in the order of ``STATISTICS``; shares are of characters, words or lines."""
    n = len(offsets) - 1
    rows_of = lambda w: np.repeat(np.arange(n), w.counts())
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    chars = total((data & 0xC0) != 0x80)
    words, lines = Words(data, offsets, _WORD), Words(data, offsets, _LINE)
    row, line_row = rows_of(words), rows_of(lines)
    n_words, n_lines = words.counts(), lines.counts()
    per_char, per_word, per_line = 1 / np.maximum(chars, 1), 1 / np.maximum(n_words, 1), 1 / np.maximum(n_lines, 1)
    of_words = lambda mask: np.bincount(row[mask], minlength=n) * per_word
    length = words.ends - words.starts
    again = np.zeros(len(row), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (row[1:] == row[:-1])
    share = {k: total(v[data]) * per_char for k, v in _IS.items() if k in STATISTICS}
    return np.column_stack([
        chars, n_words, n_lines, np.bincount(row, length, n) * per_word,
        *[share[k] for k in ("upper", "digit", "stop", "comma", "bang", "bar", "symbol", "quote")],
        _distinct(words, row, n) * per_word, of_words(again), _distinct(lines, line_row, n) * per_line, n_words * per_line,
        of_words(length <= 3), of_words(length >= 12), of_words(_IS["upper"][data[words.starts]]), of_words(_MARK[data[words.ends - 1]]),
    ]).astype(np.float64)


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and one double column per statistic of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in row_groups(offsets):
                found = statistics(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                kept = [batch.column(c).slice(i, j - i) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x) for x in found.T]], [*keep, *STATISTICS])

    types = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], *[f"{s} double" for s in STATISTICS]])
    return docs.select(*keep, "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Test:
    """One condition: a statistic at most, or above, a threshold."""

    statistic: int
    threshold: float
    above: bool

    def holds(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.statistic] > self.threshold) == self.above

    def column(self) -> Column:
        c = F.col(STATISTICS[self.statistic])
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Test, ...]


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score as a Spark expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for test in rule:
                holds = holds & test.column()
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(bins: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, path: Rule, out: list, depth: int) -> None:
    """Split one node by the largest drop in squared error; note each child's path and mean residual."""
    best = (1e-9, -1, -1)
    total, count = residual[rows].sum(), len(rows)
    for f in range(bins.shape[1]):
        if len(edges[f]) == 0:
            continue
        b = bins[rows, f]
        sums = np.cumsum(np.bincount(b, residual[rows], len(edges[f]) + 1))[:-1]
        counts = np.cumsum(np.bincount(b, minlength=len(edges[f]) + 1))[:-1]
        fit = (counts >= 8) & (count - counts >= 8)
        if fit.any():
            gain = np.where(fit, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(count - counts, 1), 0) - total**2 / count
            if (g := gain.max()) > best[0]:
                best = (g, f, int(gain.argmax()))
    _, f, cut = best
    if f < 0:
        return
    for above in (False, True):
        child = rows[(bins[rows, f] > cut) == above]
        step = (*path, Test(f, float(edges[f][cut]), above))
        out.append((step, child, residual[child].mean(), depth + 1))
        if depth + 1 < DEPTH:
            _grow(bins, edges, residual, child, step, out, depth + 1)


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 11) -> list[Rule]:
    """Rules on the paths of boosted trees, each tree on half the rows."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
    edges = [e[e < col.max()] for e, col in zip(edges, x.T, strict=True)]
    bins = np.column_stack([np.searchsorted(e, col, "left") for e, col in zip(edges, x.T, strict=True)])
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-score))
        nodes: list = []
        _grow(bins, edges, residual, rng.permutation(len(y))[: max(1, len(y) // 2)], (), nodes, 0)
        for path, _rows, mean, depth in nodes:
            rules[tuple(sorted(set(path), key=lambda t: (t.statistic, t.threshold, t.above)))] = None
            if depth == DEPTH:
                holds = np.logical_and.reduce([t.holds(x) for t in path])
                score += np.where(holds, 0.5 * 4 * mean, 0)
    return list(rules)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 150) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient."""
    n = len(y)
    rate = 4 * n / max(np.linalg.norm(z.T @ (z @ np.ones(z.shape[1], z.dtype))) / np.sqrt(z.shape[1]), 1) / 2
    w, b = np.zeros(z.shape[1], np.float64), float(np.log(y.mean() / (1 - y.mean())))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ v + c))) - y
        grad, grad_b = z.T @ error / n, error.mean()
        new = v - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = c - rate * grad_b
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return float(b), w


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Rules from trees, weighed by lasso; the penalty is the one with the least loss on a fifth of the rows."""
    if len(y) == 0 or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Model(float(np.log(p / (1 - p))), ())
    rules = tree_rules(x, y)
    z = np.column_stack([np.logical_and.reduce([t.holds(x) for t in r]) for r in rules]).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    _, first = np.unique(z, axis=1, return_index=True)
    first = np.sort(first)
    rules, z = [rules[i] for i in first], z[:, first]
    test = np.arange(len(y)) % 5 == 0
    best, chosen = np.inf, 0.001
    for penalty in (0.01, 0.003, 0.001, 0.0003):
        if not rules or min(y[~test].mean(), 1 - y[~test].mean()) == 0:
            break
        b, w = lasso(z[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-(z[test] @ w + b))), 1e-6, 1 - 1e-6)
        loss = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))
        if loss < best:
            best, chosen = loss, penalty
    b, w = lasso(z, y, chosen)
    return Model(b, tuple((r, float(round(v, 6))) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-3))


def train(docs: DataFrame, labels: DataFrame, learnable: Column, max_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most about ``max_rows`` labelled documents.

    ``labels`` has doc_id and quality; ``learnable`` says by doc_id which may be learned from.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learnable)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = max_rows / max(known.count(), 1)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    # at most about max_rows ids, whatever the size of the tables
    picked = F.broadcast(known.filter(place < share))
    # of rows that share an id the least text is learned from
    texts = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = with_statistics(texts, "doc_id", "quality").collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([[r[s] for s in STATISTICS] for r in rows], np.float64).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([float(r["quality"] > 0) for r in rows]))


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The kept columns and ``score``, the estimated chance that a text is good."""
    return with_statistics(docs, *keep).select(*keep, model.column().alias("score"))
