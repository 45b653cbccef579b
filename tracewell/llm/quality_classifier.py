"""Quality classifier: a generalised additive model with pairwise interactions.

Measures of the text are cut into bins.  Boosting goes round the features; in each turn a
shallow tree over one feature's bins is fitted to the gradient and added, damped, to that
feature's lookup table.  Then the pairs of features whose joint bins explain most of what
is left are boosted in the same way.  A score is the logistic of the sum of table entries.

Measures are computed once, in a map over the texts, and written as a table.  Training
takes at most `sample_rows` labelled rows, those with the least hash of the id; that is the
only data that the driver gets.

Null texts count as empty and are scored by the same tables.  Labels that are null are
left out; without any label every score is 0.5.  A document with several labels counts
with each.  Equal texts, and repeated rows, get equal scores.  An empty table gives an empty
result.  Other columns of the inputs are not looked at, whatever their names.  A text of any
length is one chunk of a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .quality_rules import SYMBOLS, measures
from .tables import map_batches, row_key, store

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "symbols", "digits", "points", "marks", "dup_lines", "repeat_words",
    "distinct_words", "line_words", "not_ascii", "longest_word", "top_pair",
)


def table(*values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(b"".join(values), np.uint8)] = True
    return out


UPPER, DIGIT, POINT, MARK = table(bytes(range(65, 91))), table(b"0123456789"), table(b".,;:"), table(b"!?")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x FEATURES."""
    n = len(offsets) - 1
    base = measures(data, offsets, 5)
    size = np.diff(offsets).astype(float)
    start, end, rows = bt.words(data, offsets, bt.SPACE)
    prints = bt.Fingerprints(bt.LOWER[data]).of(start, end)
    words = np.maximum(base["n_words"], 1)

    def share(which: np.ndarray, of: np.ndarray = size) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(which[data])])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(of, 1)

    def distinct(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((keys, of))
        k, r = keys[order], of[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        most = np.zeros(n)
        np.maximum.at(most, r[at], np.diff(np.append(at, len(k))))
        return bt.per_row(r[at], n), most

    pairs, first = bt.windows(prints, rows, n, 2)
    n_distinct, _ = distinct(prints, rows)
    _, top_pair = distinct(pairs, rows[first])
    longest = np.zeros(n)
    np.maximum.at(longest, rows, end - start)
    n_lines = 1 + share(table(b"\n"), np.ones(n))
    return np.stack(
        [
            np.log1p(size), np.log1p(base["n_words"]), base["word_chars"] / words, share(UPPER), share(SYMBOLS, words), share(DIGIT),
            share(POINT, words), share(MARK, words), base["n_dup_lines"] / n_lines, base["n_repeat_words"] / words, n_distinct / words,
            base["n_words"] / n_lines, share(np.arange(256) >= 128), np.log1p(longest), top_pair / words,
        ],
        1,
    )


@dataclass(frozen=True)
class Training:
    sample_rows: int = 40_000
    bins: int = 32
    pair_bins: int = 8
    pairs: int = 8
    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.1
    smoothing: float = 4.0


def tree(g: np.ndarray, h: np.ndarray, smoothing: float, depth: int = 2) -> np.ndarray:
    """Leaf values, by bin, of a greedy tree over ordered bins with these gradient and curvature sums."""

    def gain(a, b):
        return a * a / (b + smoothing)

    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        by = gain(left_g, left_h) + gain(g.sum() - left_g, h.sum() - left_h)
        cut = int(by.argmax()) + 1
        if by[cut - 1] > gain(g.sum(), h.sum()) + 1e-9:
            return np.concatenate([tree(g[:cut], h[:cut], smoothing, depth - 1), tree(g[cut:], h[cut:], smoothing, depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + smoothing))


def grid_tree(g: np.ndarray, h: np.ndarray, smoothing: float) -> np.ndarray:
    """The better of two trees over a grid of bins: cut by rows and each part by columns, or the other way."""

    def along_rows(g, h):
        left_g, left_h = np.cumsum(g.sum(1))[:-1], np.cumsum(h.sum(1))[:-1]
        total_g, total_h = g.sum(), h.sum()
        cut = int((left_g**2 / (left_h + smoothing) + (total_g - left_g) ** 2 / (total_h - left_h + smoothing)).argmax()) + 1
        out = np.empty_like(g)
        for part in (slice(0, cut), slice(cut, None)):
            out[part] = tree(g[part].sum(0), h[part].sum(0), smoothing, 1)
        return out

    if min(g.shape) < 2:
        return np.zeros_like(g)
    a, b = along_rows(g, h), along_rows(g.T, h.T).T
    return max(a, b, key=lambda x: float((x * g).sum() - (x * x * (h + smoothing / h.size)).sum() / 2))


@dataclass
class Additive:
    """Intercept and lookup tables."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, f], "right")]
        coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.pair_edges)]
        for (a, b), values in self.pairs.items():
            total += values[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray, how: Training = Training()) -> Additive:
    """Cyclic boosting of single features, then of the pairs that promise most."""
    model = Additive()
    if not len(y):
        return model
    rate = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(rate / (1 - rate)))
    n_features = x.shape[1]
    model.edges = [cuts(x[:, f], how.bins) for f in range(n_features)]
    model.pair_edges = [cuts(x[:, f], how.pair_bins) for f in range(n_features)]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(how.rounds):
        for f in range(n_features):
            g, h = slopes()
            size = len(model.tables[f])
            step = how.rate * tree(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size), how.smoothing)
            model.tables[f] += step
            total += step[bins[f]]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]
    widths = [len(e) + 1 for e in model.pair_edges]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        cell, shape = coarse[a] * widths[b] + coarse[b], (widths[a], widths[b])
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    def promise(pair: tuple[int, int]) -> float:
        g, h = sums(*pair)
        return float((g * grid_tree(g, h, how.smoothing)).sum())

    every = [(a, b) for a in range(n_features) for b in range(a + 1, n_features)]
    model.pairs = {p: np.zeros((widths[p[0]], widths[p[1]])) for p in sorted(every, key=promise, reverse=True)[: how.pairs]}
    for _ in range(how.pair_rounds):
        for (a, b), values in model.pairs.items():
            step = how.rate * grid_tree(*sums(a, b), how.smoothing)
            values += step
            total += step[coarse[a], coarse[b]]
    return model


MEASURES = "doc_id bigint, row bigint, features array<double>"


def measure(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the row's key and features of every text."""

    def step(batch: pa.RecordBatch) -> pa.Table:
        parts = [features(data, offsets) for _, data, offsets in bt.chunks(batch.column(2))]
        return pa.table([batch.column(0), batch.column(1), pa.array(list(np.concatenate(parts)), pa.list_(pa.float64()))], ["doc_id", "row", "features"])

    return map_batches(docs.select(F.col(doc).cast("bigint").alias("doc_id"), row_key(doc, text).alias("row"), text), step, MEASURES)


def train(measured: DataFrame, labels: DataFrame, how: Training = Training(), doc: str = "doc_id", label: str = "quality") -> Additive:
    """A model from measured rows and their labels; label is 1 for good, 0 for bad."""
    known = labels.select(F.col(doc).cast("bigint").alias("doc_id"), (F.col(label) > 0).cast("double").alias("y")).dropna()
    rows = measured.join(known, "doc_id").withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id", "y").limit(how.sample_rows)
    held = rows.select("features", "y").toArrow()  # sample_rows at most
    x = np.array(held.column(0).to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, held.column(1).to_numpy(), how)


SCORES = "doc_id bigint, row bigint, score double"


def score(measured: DataFrame, model: Additive) -> DataFrame:
    def step(batch: pa.RecordBatch) -> pa.Table:
        x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
        return pa.table([batch.column(0), batch.column(1), pa.array(model.score(x))], ["doc_id", "row", "score"])

    return map_batches(measured.select("doc_id", "row", "features"), step, SCORES)


def classify(docs: DataFrame, labels: DataFrame, learn_from, how: Training = Training()) -> DataFrame:
    """Scores of all documents by a model that learns from the rows where learn_from holds."""
    measured = store(measure(docs), "measures")
    return score(measured, train(measured.where(learn_from), labels, how))
