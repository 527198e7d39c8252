"""Quality classifier: an additive model of per-feature lookup tables and pairwise tables.

Shallow trees over binned features are boosted one feature after the other, round after round; the trees of a feature
add up to one lookup table. Pairs whose joint bins explain what is left best get a two-way table the same way. A score
is a sum of table cells, looked up for a whole batch at once. Features read the text alone.

Fitting sees at most ``SAMPLE`` labelled documents, those whose ids hash lowest, so its data is bounded on the driver
whatever the size of the tables; scoring covers every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, id_and_text, remainder, return_memory

SAMPLE = 20_000
BINS = 48
PAIR_BINS = 12
PAIRS = 8
ROUNDS = 150
PAIR_ROUNDS = 40
RATE = 0.1
THRESHOLD = 0.3
FOLDS = 5

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "symbols", "exclaims", "bars", "non_ascii",
    "space", "lines", "short_lines", "repeated_lines", "distinct_words", "top_word", "same_next", "marked_words",
    "capital_words", "short_words", "compressed", "periods", "longest_word", "distinct_pairs",
)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = ~(_LETTER | _DIGIT | SPACE)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*@^~+=<>_{}[]\\/")] = True


def features(text: bytes) -> list[float]:
    """One number per name in ``FEATURES``; defined for empty text too."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(counts[_LETTER].sum()))
    words = text.split()
    m = len(words)
    tally = Counter(words)
    rows = text.split(b"\n")
    lines = Counter(rows)
    size = max(n, 1)
    return [
        np.log1p(n), np.log1p(m), n / max(m, 1), counts[_UPPER].sum() / letters, counts[_DIGIT].sum() / size,
        counts[_MARK].sum() / size, counts[_SYMBOL].sum() / size, counts[33] / size, counts[124] / size,
        counts[128:].sum() / size, counts[SPACE].sum() / size, len(rows) / max(m, 1),
        sum(len(r) < 40 for r in rows) / len(rows), 1 - len(lines) / len(rows), len(tally) / max(m, 1),
        max(tally.values(), default=0) / max(m, 1), sum(map(bytes.__eq__, words, words[1:])) / max(m, 1),
        sum(not w.isalnum() for w in words if w.isascii()) / max(m, 1), sum(w.isupper() for w in words) / max(m, 1),
        sum(len(w) < 4 for w in words) / max(m, 1), len(zlib.compress(text, 1)) / size, counts[46] / max(m, 1),
        np.log1p(max(map(len, words), default=0)), len(set(zip(words, words[1:]))) / max(m, 1),
    ]


@dataclass
class Additive:
    """Bin edges, intercept, one table per feature, and (first, second, table) per pair."""

    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, k], side="right")]
        for a, b, table in self.pairs:
            out += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"),
                         np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower"))


_RIDGE = 1.0


def _leaf(g, h):
    return g / (h + _RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins (cut after the place)."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + _RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + _RIDGE) - all_g**2 / (all_h + _RIDGE)
    at = int(gain.argmax())
    return float(gain[at]), at


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over ordered bins, as the value of each bin."""
    out = np.zeros(len(g))
    _, cut = _best_cut(g, h)
    for part in (slice(0, cut + 1), slice(cut + 1, None)):
        if not len(g[part]):
            continue
        gain, inner = _best_cut(g[part], h[part])
        pieces = [part] if gain <= 0 else [slice(part.start, part.start + inner + 1), slice(part.start + inner + 1, part.stop)]
        for piece in pieces:
            out[piece] = _leaf(g[piece].sum(), h[piece].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut along one axis followed by one cut of each side along the other; gain and cell values."""
    best, value = 0.0, np.zeros(g.shape)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        _, cut = _best_cut(a.sum(1), b.sum(1))
        out, score = np.zeros(a.shape), 0.0
        for rows in (slice(0, cut + 1), slice(cut + 1, None)):
            side_g, side_h = a[rows].sum(0), b[rows].sum(0)
            _, inner = _best_cut(side_g, side_h)
            for columns in (slice(0, inner + 1), slice(inner + 1, None)):
                p, q = side_g[columns].sum(), side_h[columns].sum()
                out[rows, columns] = _leaf(p, q)
                score += p * p / (q + _RIDGE)
        if score > best:
            best, value = score, out.T if turn else out
    return best, value


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boost tables for labels 0 and 1; with one class or no rows the model is a constant."""
    k = len(FEATURES)
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Additive([np.zeros(0)] * k, [np.zeros(0)] * k, float(np.log(rate / (1 - rate))), [np.zeros(1)] * k, [])
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [_edges(x[:, j], BINS) for j in range(k)]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(k)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(y), model.intercept)

    def pull():
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(k):
            if len(model.edges[j]):
                g, h = pull()
                size = len(model.tables[j])
                step = RATE * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
                model.tables[j] = model.tables[j] + step
                margin += step[bins[j]]

    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    width = [len(e) + 1 for e in model.pair_edges]

    def grid(a, b, weights):
        return np.bincount(coarse[a] * width[b] + coarse[b], weights, width[a] * width[b]).reshape(width[a], width[b])

    g, h = pull()
    gains = sorted(((_pair_tree(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(k) for b in range(a + 1, k)), reverse=True)
    tables = {(a, b): np.zeros((width[a], width[b])) for _, a, b in gains[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for a, b in tables:
            g, h = pull()
            step = RATE * _pair_tree(grid(a, b, g), grid(a, b, h))[1]
            tables[a, b] += step
            margin += step[coarse[a], coarse[b]]
    model.pairs = [(a, b, t) for (a, b), t in tables.items()]
    return model


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(text: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in text])


def as_bytes(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, folds: int, held: int) -> DataFrame:
    """doc_id, text, label of the training documents: at most ``sample`` ids, the lowest by hash.

    Labels of held-out ids and null labels are not looked at; of repeated labels the largest counts.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (remainder("doc_id", folds) != held))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    rows = labelled(docs, labels, "quality", sample, FOLDS, 0)
    held = rows.select("doc_id", F.col("label"), _features(as_bytes(F.col("text"))).alias("x")).toPandas()
    held = held.sort_values("doc_id", kind="stable")  # the same model whatever order the tasks end in
    x = np.array(held["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, held["label"].to_numpy(float))


def scorer(model: Additive):
    """A column function: text column to score."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in text], float).reshape(-1, len(FEATURES))
        return_memory()
        return pd.Series(model.score(x))

    return lambda column: score(as_bytes(column))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    Null text is empty and gets a score. A null doc_id is never trained on; its held_out is that of the empty id.
    Repeated rows are scored alike. Without usable labels every score is the prior. Columns beside doc_id and text
    are not read; an empty table gives no rows.
    """
    score = scorer(train(docs, labels, sample))
    return id_and_text(docs).select(
        "doc_id", (remainder("doc_id", FOLDS) == 0).alias("held_out"), score(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    score = scorer(train(docs, labels, sample))
    return docs.where(score(F.col("text")) >= threshold)
