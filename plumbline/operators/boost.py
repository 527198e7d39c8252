"""Gradient-boosted trees over a binned matrix: squared loss, logistic loss, and softmax with one tree per class.

Rows are binned once: numbers at up to 255 cuts, nominal columns by the slot of their level (a split sets one level
against all others, so any number of levels costs one sum per level). Rows that agree in all bins (and in their class) are
one row with a count from then on, as no tree can tell them apart; they are kept packed, thousands to a row of the files.
Each level of a round's trees is one job: tasks add up gradients and curvatures by (output, node, feature, bin) with numpy,
Spark adds the tasks' sums, and windows over the bins find the best split of every node. The driver gets one row per node,
and trees travel to the tasks in closures. Scores so far are written with the rows every few rounds; the trees grown since
are evaluated on the way (see ``Paths``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stages import settle

# Cuts per number, rows and curvature that a leaf needs, share of a tree's answer that is taken.
CUTS = 255
MIN_ROWS = 20
MIN_CURVATURE = 1e-3
RATE = 0.3
_FLUSH = 5  # rounds between writes of the scores
_EMIT = 1 << 20
_ONE_TASK = 50_000
_TOGETHER = 1 << 18  # rows looked at together when equal ones are counted
_PACK = 1 << 20  # bytes of rows packed together
_CELLS = 1 << 17  # answers of a model that are worth a table
SQUARED, LOGISTIC, SOFTMAX = "squared", "logistic", "softmax"


@dataclass
class Tree:
    """Nodes in heap order: the children of node i are 2i + 1 and 2i + 2. A leaf has feature -1."""

    feature: np.ndarray
    bin: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))

    def leaves(self, matrix: np.ndarray, cuts: np.ndarray, ordered: int) -> np.ndarray:
        """The leaf that each row ends in; ``cuts`` are bins or numbers, as the matrix has them."""
        node = np.zeros(len(matrix), np.int64)
        rows = np.arange(len(matrix))
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            at = np.where(inner, feature, 0)
            x, cut = matrix[rows, at], cuts[node]
            left = np.where(at < ordered, x <= cut, x == cut)
            node = np.where(inner, 2 * node + 2 - left, node)


class Paths:
    """Trees answered for many rows at once, without a step per level.

    A column's values count by where they lie among the cuts that the trees have for it, its codes. For each tree, column and
    code there are the leaves (as bits, from left to right) that this column leaves open; the first leaf that all columns
    leave open is the row's. ``by`` says whether the trees' bins or their cuts are compared with the columns.
    """

    def __init__(self, trees: Sequence[Tree], ordered: int, width: int, by: str) -> None:
        self.trees, self.ordered = list(trees), ordered
        self._cuts = [getattr(t, by) for t in self.trees]
        self.marks = [np.unique(np.concatenate([np.zeros(0), *[c[t.feature == f] for t, c in zip(self.trees, self._cuts)]])) for f in range(width)]
        self.sizes = tuple(len(m) + 1 for m in self.marks)
        self._open = [self._tables(t, c) for t, c in zip(self.trees, self._cuts)]

    def _tables(self, tree: Tree, cuts: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray] | None:
        """Open leaves by column and code, and the nodes that the leaves are; none for a tree of more leaves than bits."""
        leaves: list[int] = []
        splits: list[tuple[int, int, int]] = []  # a node and its left side's leaves, from and up to

        def walk(node: int) -> None:
            if tree.feature[node] < 0:
                leaves.append(node)
                return
            first = len(leaves)
            walk(2 * node + 1)
            splits.append((node, first, len(leaves)))
            walk(2 * node + 2)

        walk(0)
        if len(leaves) > 64:
            return None
        kind = np.uint32 if len(leaves) <= 32 else np.uint64
        tables: dict[int, np.ndarray] = {}
        for node, first, last in splits:
            f = int(tree.feature[node])
            table = tables.setdefault(f, np.full(self.sizes[f], np.iinfo(kind).max, kind))
            at, codes = int(np.searchsorted(self.marks[f], cuts[node])), np.arange(self.sizes[f])
            right = codes > at if f < self.ordered else codes != at
            table[right] &= kind(np.iinfo(kind).max ^ ((1 << last) - (1 << first)))
        return list(tables.items()), np.array(leaves)

    def codes(self, columns: Sequence[np.ndarray]) -> list[np.ndarray]:
        return [self._code(f, np.arange(256))[x] if x.dtype == np.uint8 else self._code(f, x) for f, x in enumerate(columns)]

    def _code(self, f: int, x: np.ndarray) -> np.ndarray:
        marks = self.marks[f]
        code = np.searchsorted(marks, x, side="left")
        if f >= self.ordered and len(marks):
            code = np.where(marks[np.minimum(code, len(marks) - 1)] == x, code, len(marks))
        return code

    def leaves(self, k: int, codes: Sequence[np.ndarray]) -> np.ndarray:
        """The node that each row ends in, of tree ``k``."""
        known = self._open[k]
        if known is None:
            tree, cuts = self.trees[k], self._cuts[k]
            at = np.array([np.searchsorted(self.marks[f], cuts[i]) if f >= 0 else 0 for i, f in enumerate(tree.feature.tolist())])
            return tree.leaves(np.column_stack(codes), at, self.ordered)
        tables, nodes = known
        if not tables:
            return np.zeros(len(codes[0]), np.int64)
        bits = tables[0][1][codes[tables[0][0]]]
        for f, table in tables[1:]:
            bits = bits & table[codes[f]]
        return nodes[np.bitwise_count((bits & -bits) - bits.dtype.type(1))]


class Scorer:
    """Scores of raw columns by a model: one column per output. Few enough answers are looked up in a table of all."""

    def __init__(self, model: Booster, width: int) -> None:
        flat = [(c, tree) for trees in model.rounds for c, tree in enumerate(trees)]
        self.paths = Paths([t for _, t in flat], model.ordered, width, "cut")
        self._outputs, self._values, self._base = [c for c, _ in flat], [t.value for _, t in flat], np.array(model.base, float)
        self._table: np.ndarray | None = None
        self._seen, self._cells, self._most = 0, math.prod(self.paths.sizes), _CELLS
        self._strides = [math.prod(self.paths.sizes[f + 1:]) for f in range(width)]
        self._used = [set(t.feature[t.feature >= 0].tolist()) for _, t in flat]

    def _evaluated(self, codes: Sequence[np.ndarray], known: Sequence[np.ndarray] | None = None, moved: int = -1) -> np.ndarray:
        """Scores, tree by tree; trees without the ``moved`` column answer as ``known``."""
        out = np.tile(self._base, (len(codes[0]), 1))
        for k, c in enumerate(self._outputs):
            out[:, c] += self._told(k, codes) if known is None or moved in self._used[k] else known[k]
        return out

    def _told(self, k: int, codes: Sequence[np.ndarray]) -> np.ndarray:
        return self._values[k][self.paths.leaves(k, codes)]

    def _looked_up(self, n: int) -> bool:
        """Whether there is a table of all answers; it is made once as many rows were asked for."""
        self._seen += n
        if self._table is None and self._cells <= min(self._most, self._seen):
            self._table = self._evaluated(np.unravel_index(np.arange(self._cells), self.paths.sizes))
        return self._table is not None

    def _cell(self, codes: Sequence[np.ndarray]) -> np.ndarray:
        return sum(code * stride for code, stride in zip(codes, self._strides))

    def margins(self, codes: Sequence[np.ndarray]) -> np.ndarray:
        return self._table[self._cell(codes)] if self._looked_up(len(codes[0])) else self._evaluated(codes)

    def moving(self, codes: Sequence[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
        """Scores with one column's codes replaced by others, for the number of the column and those codes."""
        if self._looked_up(len(codes[0])):
            cell = self._cell(codes)
            return lambda f, other: self._table[cell + (other - codes[f]) * self._strides[f]]
        known = [self._told(k, codes) for k in range(len(self._outputs))]
        return lambda f, other: self._evaluated([*codes[:f], other, *codes[f + 1:]], known, f)

    def __call__(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        return self.margins(self.paths.codes(columns))


@dataclass
class Booster:
    loss: str
    ordered: int  # features that are numbers or ordinals; nominal ones follow
    edges: list[list[float]] = field(default_factory=list)
    base: list[float] = field(default_factory=list)
    rounds: list[list[Tree]] = field(default_factory=list)

    def margins(self, matrix: np.ndarray) -> np.ndarray:
        """Scores of raw rows: one column per output."""
        return Scorer(self, matrix.shape[1])(matrix.T)

    def answers(self, matrix: np.ndarray) -> np.ndarray:
        """Numbers (one column) or class probabilities."""
        return respond(self.loss, self.margins(matrix))

    def to_json(self) -> dict[str, Any]:
        trees = [[{k: getattr(t, k).tolist() for k in ("feature", "bin", "cut", "value")} for t in r] for r in self.rounds]
        return {"loss": self.loss, "ordered": self.ordered, "edges": self.edges, "base": self.base, "rounds": trees}

    @classmethod
    def from_json(cls, made: dict[str, Any]) -> Booster:
        rounds = [
            [Tree(np.array(t["feature"], np.int32), np.array(t["bin"], np.int32), np.array(t["cut"]), np.array(t["value"])) for t in r]
            for r in made["rounds"]
        ]
        return cls(made["loss"], made["ordered"], made["edges"], made["base"], rounds)


def respond(loss: str, margins: np.ndarray) -> np.ndarray:
    if loss == SQUARED:
        return margins
    if loss == LOGISTIC:
        p = 1 / (1 + np.exp(-np.clip(margins[:, 0], -700, 700)))
        return np.column_stack([1 - p, p])
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(loss: str, margins: np.ndarray, label: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of ``n`` rows each; ``label`` is their class, or the sum of their numbers."""
    n = n[:, None]
    if loss == SQUARED:
        return n * margins - label[:, None], n * np.ones_like(margins)
    p = respond(loss, margins)
    if loss == LOGISTIC:
        return n * (p[:, 1] - label)[:, None], n * (p[:, 0] * p[:, 1])[:, None]
    return n * (p - (label[:, None] == np.arange(p.shape[1]))), n * (p * (1 - p))


def bin_edges(df: DataFrame, columns: Sequence[str], cuts: int = CUTS) -> list[list[float]]:
    """Cuts of each column at its quantiles, all from one pass; a value with a share of its own gets its own bin."""
    if not columns:
        return []
    shares = [i / (cuts + 1) for i in range(1, cuts + 1)]
    row = df.agg(
        *[F.percentile_approx(c, shares, 10_000).alias(f"q{i}") for i, c in enumerate(columns)],
        *[F.max(c).alias(f"m{i}") for i, c in enumerate(columns)],
    ).first()
    # A cut at a value keeps that value on the lower side; one at the largest would part nothing.
    return [sorted({float(v) for v in row[f"q{i}"] or [] if v < row[f"m{i}"]}) for i in range(len(columns))]


def binned(df: DataFrame, features: Sequence[Column], label: Column, loss: str, edges: list[list[float]], base: Sequence[float]) -> DataFrame:
    """``bins`` (by feature), ``label``, ``n`` and ``margin`` (by output) of the distinct rows: what the training jobs read.

    A row has thousands of them, packed. ``n`` says how many rows agree in all bins and, where it is a class, the label;
    labels that are numbers are added up.
    """
    ordered, width, schema = len(edges), len(features), "key binary, label double, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _TOGETHER:
                yield from counted(held)
                held = []
        yield from counted(held)

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(b.num_rows for b in held)
        if not n:
            return
        columns = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(width + 1)]
        bins = np.empty((n, width), np.int32)
        for f, x in enumerate(columns[:width]):
            bins[:, f] = np.searchsorted(edges[f], x, side="left") if f < ordered else x
        codes = list(bins.T) if loss == SQUARED else [np.unique(columns[-1], return_inverse=True)[1], *bins.T]
        kinds, first, place, times = same_rows(codes)
        labels = np.bincount(place, columns[-1], minlength=len(kinds)) if loss == SQUARED else columns[-1][first]
        yield pa.RecordBatch.from_arrays([_blobs(bins[first]), pa.array(labels), pa.array(times)], names=["key", "label", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, _PACK // (4 * width + 8 * len(base) + 16))
        for batch in batches:
            for c in range(0, batch.num_rows, most):
                part = batch.slice(c, most)
                bins = np.frombuffer(b"".join(part.column("key").to_pylist()), np.int32).reshape(-1, width)
                yield _packed(bins, part.column("label").to_numpy(), part.column("n").to_numpy().astype(float), np.tile(np.array(base, float), (len(bins), 1)))

    rows = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(features)], label.cast("double").alias("label"))
    kinds = rows.mapInArrow(run, schema)
    total = F.sum("n").alias("n")
    if loss == SQUARED:
        kinds = kinds.groupBy("key").agg(F.sum("label").alias("label"), total)
    else:
        kinds = kinds.groupBy("key", "label").agg(total)
    return kinds.select("key", "label", "n").mapInArrow(packed, "bins binary, label binary, n binary, margin binary")


def same_rows(codes: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of whole numbers, given by column: one number per distinct row, its first row, which one each row is, how often it is there."""
    key, spread = np.zeros(len(codes[0]), np.int64), 1
    for code in codes:
        low = int(code.min())
        span = int(code.max()) - low + 1
        if spread * span >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            spread = int(key.max()) + 1
        key, spread = key * span + (code.astype(np.int64) - low), spread * span
    return np.unique(key, return_index=True, return_inverse=True, return_counts=True)


def _blobs(matrix: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    data = np.ascontiguousarray(matrix)
    ends = np.arange(len(data) + 1, dtype=np.int32) * (data.shape[1] * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _packed(bins: np.ndarray, label: np.ndarray, n: np.ndarray, margins: np.ndarray) -> pa.RecordBatch:
    """One row; bins are bytes where all of them are below 256."""
    parts = (bins.astype(np.uint8 if bins.max() < 256 else np.int32).T, label.astype(float), n.astype(float), margins.astype(float).T)
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts], names=["bins", "label", "n", "margin"])


def _unpacked(batches: Iterator[pa.RecordBatch], outputs: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bins by feature, labels, counts, and scores as rows by output."""
    for batch in batches:
        for k in range(batch.num_rows):
            label, n, margins = (np.frombuffer(batch.column(c)[k].as_buffer(), float) for c in (1, 2, 3))
            bins = batch.column(0)[k].as_buffer()
            kind = np.uint8 if bins.size == width * len(label) else np.int32
            yield np.frombuffer(bins, kind).reshape(width, -1), label, n, margins.reshape(outputs, -1).T


def rows_matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def matrix_lists(matrix: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    n, k = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(matrix.reshape(-1)))


def _advanced(margins: np.ndarray, pending: list[list[Tree]], paths: Paths, codes: list[np.ndarray]) -> np.ndarray:
    """The scores with the trees grown since they were written, the first ones of ``paths``."""
    out = margins.copy()
    k = 0
    for trees in pending:
        for c, tree in enumerate(trees):
            out[:, c] += tree.value[paths.leaves(k, codes)]
            k += 1
    return out


def _sums(loss: str, pending: list[list[Tree]], growing: list[Tree], active: list[list[int]], ordered: int, width: int):
    """Per task: gradient, curvature and rows by (output, node, feature, bin) of the nodes that may still split."""
    names = ["output", "node", "feature", "bin", "g", "h", "n"]
    grown = [tree for trees in pending for tree in trees]
    paths = Paths([*grown, *growing], ordered, width, "bin")
    open_ = [np.isin(np.arange(len(tree.feature)), some) for tree, some in zip(growing, active)]

    def packed(parts: list[tuple]) -> pa.RecordBatch:
        keys = np.concatenate([p[0] for p in parts], axis=1)
        sums = np.concatenate([p[1] for p in parts], axis=1)
        order = np.lexsort(keys[::-1])
        keys, sums = keys[:, order], sums[:, order]
        first = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
        sums = np.add.reduceat(sums, first, axis=1)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(k[first], pa.int32()) for k in keys), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2].astype(np.int64))],
            names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for bins, label, times, margins in _unpacked(batches, len(growing), width):
            codes = paths.codes(bins)
            g, h = gradients(loss, _advanced(margins, pending, paths, codes), label, times)
            for c in range(len(growing)):
                if not active[c]:
                    continue
                node = paths.leaves(len(grown) + c, codes)
                wanted = open_[c][node]
                some = slice(None) if wanted.all() else np.flatnonzero(wanted)
                if not wanted.any():
                    continue
                node, gc, hc, rows = node[some], g[some, c], h[some, c], times[some]
                for f in range(width):
                    b = bins[f][some]
                    span = int(b.max(initial=0)) + 1
                    key = node * span + b
                    if span * (int(node.max(initial=0)) + 1) <= 4 * len(key) + 65_536:
                        n = np.bincount(key, rows)
                        kinds = np.flatnonzero(n)
                        n = n[kinds]
                        sums = np.bincount(key, gc)[kinds], np.bincount(key, hc)[kinds]
                    else:
                        kinds, place = np.unique(key, return_inverse=True)
                        n = np.bincount(place, rows)
                        sums = np.bincount(place, gc), np.bincount(place, hc)
                    ids = np.stack([np.full(len(kinds), c), kinds // span, np.full(len(kinds), f), kinds % span])
                    held.append((ids, np.stack([*sums, n])))
                    size += len(kinds)
            if size > _EMIT:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return run


def _best(sums: DataFrame, ordered: int, penalty: float, min_rows: int, slots: int) -> DataFrame:
    """The best split of every (output, node) that has one, with the sums of both sides.

    Up to ``_ONE_TASK`` bins in all, a node's sums go to one task, which then needs no further shuffle; with more, nominal
    columns of many levels, they are spread by bin.
    """
    if slots <= _ONE_TASK:
        sums = sums.repartition("output", "node")
    total = sums.groupBy("output", "node", "feature", "bin").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    whole = Window.partitionBy("output", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = ("g", "h", "n")
    run = total.select(
        "output", "node", "feature", "bin",
        *[F.when(F.col("feature") < ordered, F.sum(c).over(upto)).otherwise(F.col(c)).alias(f"l{c}") for c in names],
        *[F.sum(c).over(whole).alias(f"a{c}") for c in names])
    sides = run.withColumns({f"r{c}": F.col(f"a{c}") - F.col(f"l{c}") for c in names})

    def worth(side: str) -> Column:
        return F.col(f"{side}g") * F.col(f"{side}g") / (F.col(f"{side}h") + penalty)

    fit = (F.least("ln", "rn") >= min_rows) & (F.least("lh", "rh") >= MIN_CURVATURE)
    gain = F.round(worth("l") + worth("r") - worth("a"), 8)  # sums differ in their last bits from run to run
    split = F.struct("feature", "bin", "lg", "lh", "rg", "rh")
    order = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    return sides.where(fit & (gain > 0)).groupBy("output", "node").agg(F.max_by(split, order).alias("split")).select(
        "output", "node", "split.*")


def boost(
    df: DataFrame, features: Sequence[Column], label: Column, loss: str, edges: list[list[float]], base: Sequence[float],
    rounds: int = 20, depth: int = 5, rate: float = RATE, penalty: float = 0.0, min_rows: int = MIN_ROWS, levels: int = 0,
) -> Booster:
    """Trees for the rows of ``df``: the first ``len(edges)`` features are ordered, the others are slots of levels.

    ``base`` has the score that each output starts from; ``levels`` is how many the nominal features have, as far as it is
    known, and only shapes the jobs. A round without any split ends the fit. Of equal gains the
    first feature and lowest bin win.
    """
    model = Booster(loss, len(edges), [list(e) for e in edges], [float(b) for b in base])
    data, width = settle(binned(df, features, label, loss, edges, model.base)), len(features)
    slots = levels + sum(len(e) + 1 for e in edges)
    pending: list[list[Tree]] = []
    for _ in range(rounds):
        growing = [Tree.empty(depth) for _ in base]
        active: list[list[int]] = [[0] for _ in base]
        for level in range(depth):
            sums = data.mapInArrow(
                _sums(loss, pending, growing, active, model.ordered, width),
                "output int, node int, feature int, bin int, g double, h double, n long")
            active = [[] for _ in base]
            for r in _best(sums, model.ordered, penalty, min_rows, slots).collect():  # a row per node that splits
                tree, node, f = growing[r["output"]], r["node"], r["feature"]
                tree.feature[node], tree.bin[node] = f, r["bin"]
                tree.cut[node] = edges[f][r["bin"]] if f < model.ordered else r["bin"]
                for child, side in ((2 * node + 1, "l"), (2 * node + 2, "r")):
                    tree.value[child] = -rate * r[f"{side}g"] / (r[f"{side}h"] + penalty)
                    active[r["output"]].append(child)
            if not any(active):
                break
        if all(t.feature[0] < 0 for t in growing):
            break
        model.rounds.append(growing)
        pending.append(growing)
        if len(pending) == _FLUSH:
            data = settle(data.mapInArrow(_flushed(pending, model.ordered, width), data.schema))
            pending = []
    return model


def _flushed(pending: list[list[Tree]], ordered: int, width: int):
    paths = Paths([tree for trees in pending for tree in trees], ordered, width, "bin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, label, n, margins in _unpacked(batches, len(pending[0]), width):
            yield _packed(bins.T, label, n, _advanced(margins, pending, paths, paths.codes(bins)))

    return run


def answer(model: Booster, features: Sequence[Column]) -> Column:
    """The model's numbers or probabilities as an array column."""
    scorer = Scorer(model, len(features))

    @F.arrow_udf("array<double>")
    def scored(*columns: pa.Array) -> pa.Array:
        if not len(columns[0]):
            return pa.array([], pa.list_(pa.float64()))
        return matrix_lists(respond(model.loss, scorer([c.to_numpy(zero_copy_only=False) for c in columns])))

    return scored(*[c.cast("double") for c in features])
