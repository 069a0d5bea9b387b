"""Quality classifier: a generalised additive model with pairwise interactions (operator 9).

Each document becomes a short vector of text statistics. Training, on a bounded labelled
sample: every feature is cut into quantile bins; rounds of cyclic boosting visit the features
in turn, fit a tree of up to four leaves to the gradient of the log loss over that feature's
bins and add its leaves, shrunk, to the feature's lookup table. Then the pairs whose two-way
grid explains most of what is left get tables of their own, boosted the same way. Scoring is
vectorised: bin every feature, add up the table entries, take the logistic function.

Edge cases: null and empty texts have the all-zero vector and get a score like any other; a
sample with one class (or none) gives the constant score of its smoothed rate; null ids are
scored and count as not held out; extra columns are ignored; repeated rows are scored alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.learning import held_out, training_rows

SAMPLE = 20_000        # labelled documents fitted on, at most
FOLDS, FOLD = 4, 2     # crc32(doc_id) mod 4 = 2 is held out
THRESHOLD = 0.7
BINS, GRID = 32, 8     # of a feature alone; of each side of a pair
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 8
RATE, RIDGE = 0.1, 1.0

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "stop", "symbol", "bang", "bar", "space", "other",
    "distinct_words", "top_word", "distinct_lines", "line_words", "symbol_words", "repeat_pairs",
)
#: byte classes: 0 lower, 1 upper, 2 digit, 3 sentence marks, 4 symbols, 5 '!', 6 '|', 7 white space, 8 beyond ASCII
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 0
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASS[[ord(c) for c in "0123456789"]] = 2
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 3
_CLASS[ord("!")], _CLASS[ord("|")] = 5, 6
_CLASS[[9, 10, 11, 12, 13, 32]] = 7
_CLASS[128:] = 8
_MARKS = tuple("#%&$*!|=~^<>{}[]\\/_+@")


def features_of(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of ``FEATURES``."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    part = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) / len(raw)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n = max(1, len(words))
    counts = Counter(words)
    marked = sum(k for w, k in counts.items() if w.endswith(_MARKS))
    same = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / n, part[1], part[2], part[3], part[4], part[5], part[6], part[7], part[8],
        len(counts) / n, max(counts.values(), default=0) / n, len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)), marked / n, same / n,
    ]


@dataclass
class Gam:
    """bias + one table per feature + one grid per pair, on the logit scale."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for k, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[k], x[:, k], side="right")]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            z += grid[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, position) of the best two-way cut of bins with gradient and hessian sums; 0: none."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    gt, ht = g.sum(), h.sum()
    gain = a * a / (b + RIDGE) + (gt - a) ** 2 / (ht - b + RIDGE) - gt * gt / (ht + RIDGE)
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return g.sum() / (h.sum() + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over one feature's bins, as a value per bin."""
    out, spans = np.zeros(len(g)), [(0, len(g))]
    for _ in range(2):
        parts = []
        for lo, hi in spans:
            at = _cut(g[lo:hi], h[lo:hi])[1]
            parts += [(lo, lo + at), (lo + at, hi)] if at else [(lo, hi)]
        spans = parts
    for lo, hi in spans:
        out[lo:hi] = _leaf(g[lo:hi], h[lo:hi])
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, value per cell) of a tree that cuts one side of a grid, then each part on the other side."""
    best_gain, best = 0.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        _, at = _cut(a.sum(axis=1), b.sum(axis=1))
        out, gain = np.zeros_like(a), -a.sum() ** 2 / (b.sum() + RIDGE)
        for rows in ([slice(0, at), slice(at, None)] if at else [slice(None)]):
            _, col = _cut(a[rows].sum(axis=0), b[rows].sum(axis=0))
            for cols in ([slice(0, col), slice(col, None)] if col else [slice(None)]):
                out[rows, cols] = _leaf(a[rows, cols], b[rows, cols])
                gain += a[rows, cols].sum() ** 2 / (b[rows, cols].sum() + RIDGE)
        if gain > best_gain:
            best_gain, best = gain, out.T if flip else out
    return best_gain, best


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of the single features, then of the strongest pairs."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(rate / (1 - rate))))
    if not len(y) or y.min() == y.max():
        return model
    k = x.shape[1]
    quantiles = lambda n: [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n + 1)[1:-1])) for f in range(k)]
    model.edges, model.coarse = quantiles(BINS), quantiles(GRID)
    bins = [np.searchsorted(model.edges[f], x[:, f], side="right") for f in range(k)]
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(n) for n in sizes]
    z = np.full(len(y), model.bias)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(k):
            g, h = slope()
            step = RATE * _tree(np.bincount(bins[f], g, sizes[f]), np.bincount(bins[f], h, sizes[f]))
            model.tables[f] += step
            z += step[bins[f]]
    wide = [np.searchsorted(model.coarse[f], x[:, f], side="right") for f in range(k)]
    shape = lambda i, j: (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell, (n, m) = wide[i] * (len(model.coarse[j]) + 1) + wide[j], shape(i, j)
        g, h = slope()
        return cell, np.bincount(cell, g, n * m).reshape(n, m), np.bincount(cell, h, n * m).reshape(n, m)

    ranked = sorted(((_grid_tree(*grids(i, j)[1:])[0], i, j) for i in range(k) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    model.grids = [np.zeros(shape(i, j)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for n, (i, j) in enumerate(model.pairs):
            cell, g, h = grids(i, j)
            step = RATE * _grid_tree(g, h)[1]
            model.grids[n] += step
            z += step.ravel()[cell]
    return model


def features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def vector(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([features_of(t) for t in batch], dtype=object)

    return vector(text)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """Fit on at most ``sample`` labelled rows; only their vectors come to the driver."""
    rows = training_rows(docs, labels, "quality", FOLDS, FOLD, sample).select(features(F.col("text")).alias("x"), "label").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T, rows["label"]))
    return fit(x[order], rows["label"].to_numpy(dtype=float)[order])


def quality(text: Column, model: Gam) -> Column:
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            x = np.array([features_of(t) for t in batch], dtype=float).reshape(len(batch), len(FEATURES))
            yield pd.Series(model.score(x))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels, sample)
    scored = docs.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), quality(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
