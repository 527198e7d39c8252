"""What a model relies on, why it said what it said, and what drives a metric."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import numeric, quoted
from ..functions.hashing import hash_text
from ..functions.stages import settle
from .boost import Booster, Scorer, matrix_lists, respond, rows_matrix
from .learn import LABEL, PREDICTION, ROW, TrainedModel, hold_out, label_index
from .prep import FEATURES, Roles, encode, encoded_names, learn

# Shuffles per feature, smallest segment worth reporting.
REPEATS = 10
MIN_LEAF = 0.05
BLOCK = 1000
BACKGROUND = 100
_LISTED = 100


#: What Spark's xxhash64 multiplies and adds.
_PRIMES = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _PRIMES[1]
    x = (x ^ (x >> np.uint64(29))) * _PRIMES[2]
    return x ^ (x >> np.uint64(32))


def copy_hashes(copies: int, rows: np.ndarray) -> Iterator[np.ndarray]:
    """``xxhash64(copy, row)`` as Spark has it, for the int copies from 0 and long row numbers."""
    one, two, three, four, five = _PRIMES
    number = np.arange(copies, dtype=np.uint64) * one
    seeds = _finished(_rotated((np.uint64(42) + five + np.uint64(4)) ^ number, 23) * two + three)
    mixed = _rotated(rows.astype(np.int64).view(np.uint64) * two, 31) * one
    for k in range(copies):
        yield _finished(_rotated((seeds[k : k + 1] + five + np.uint64(8)) ^ mixed, 27) * one + four).view(np.int64)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first of them, never cut within a value of it."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(pair) for pair in zip(held, columns)] if held else columns
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if cut:
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held:
        yield held


def permuted_sums(df: DataFrame, scorer: Scorer, columns: Sequence[str], slots: Sequence[int], repeats: int, n: int, loss: str,
                  regression: bool) -> DataFrame:
    """``(copy, n, total)``: squared gaps (hits of a classifier) with one feature at a time taken from a shuffled row.

    Rows are hashed into blocks of about a thousand and shuffled inside their block, so a copy never needs a table-wide sort
    and no task holds more than one block beside a batch. ``copy`` is -1 for the untouched rows, else
    ``feature number * repeats + repeat``. A copy is an order of its block's rows and made where it is scored: only
    sums leave a task.
    """
    blocks = max(1, n // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies = len(slots) * repeats
        seen, totals = -1, np.zeros(copies + 1)

        def total(margins: np.ndarray, label: np.ndarray) -> float:
            if regression:
                gap = label - margins[:, 0]
                return float(gap @ gap)
            return float((respond(loss, margins).argmax(1) == label).sum())  # the first of equals

        for block, row, label, *values in _whole_blocks(batches):
            codes = scorer.paths.codes(values)
            known = ~np.isnan(label)
            some = slice(None) if known.all() else known
            seen = max(seen, 0) + int(known.sum())
            moving = scorer.moving(codes)
            totals[0] += total(moving(0, codes[0])[some], label[some])
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for k, hashes in enumerate(copy_hashes(copies, row)):
                order = np.concatenate([np.argsort(hashes[a:b]) + a for a, b in zip(cuts, cuts[1:])])
                f = slots[k // repeats]
                totals[k + 1] += total(moving(f, codes[f][order])[some], label[some])
        if seen >= 0:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, copies, dtype=np.int32)), pa.array(np.full(copies + 1, seen)), pa.array(totals)], names=["copy", "n", "total"])

    block = F.pmod(F.xxhash64(F.col(ROW)), F.lit(blocks)).alias("_block")
    rows = df.select(block, ROW, F.col(LABEL).cast("double"), *columns).repartition("_block").sortWithinPartitions("_block", ROW)
    return rows.mapInArrow(run, "copy int, n long, total double").groupBy("copy").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def permutation_importance(model: TrainedModel, repeats: int = REPEATS) -> DataFrame:
    """``(feature, importance)``: mean drop of accuracy or R² on held-out rows, which are encoded once."""
    features = list(model.roles.names)
    labelled = model.with_label(model.test).select(*[F.col(quoted(c)) for c in features], LABEL, ROW)
    regression = model.task == "regression"
    whole = labelled.agg(F.count(F.lit(1)).alias("n"), F.var_pop(LABEL).alias("spread")).first()
    made = encoded_names(model.plan)
    # Slots of the encoding: numbers, then ordinals, then nominals.
    ordered = [*model.roles.numeric, *model.roles.ordinal, *model.roles.nominal]
    sums = settle(permuted_sums(
        encode(labelled, model.plan), Scorer(model.booster, len(made)), made, [ordered.index(c) for c in features], repeats,
        whole["n"], model.booster.loss, regression))
    score = F.try_divide("total", "n")
    if regression:
        score = 1 - F.try_divide(score, F.lit(whole["spread"]).cast("double"))
    per_copy = sums.select("copy", score.alias("score"))
    base = per_copy.where("copy = -1").select("score").scalar()
    names = F.array(*[F.lit(c) for c in features])
    return (
        per_copy.where("copy >= 0")
        .select(F.get(names, F.floor(F.col("copy") / repeats).cast("int")).alias("feature"), (base - F.col("score")).alias("drop"))
        .groupBy("feature")
        .agg(F.avg("drop").alias("importance"))
    )


def path_tables(model: Booster, background: np.ndarray) -> list[tuple[int, list[tuple], np.ndarray]]:
    """For every leaf: its output, its conditions by feature, and what a row that meets some of them gains per feature.

    A leaf speaks for a mix of the row and a background row if every feature of its path comes from one that meets the
    condition. Features that only the row meets must come from the row, those that only the other meets must not; over
    all orders of the features that gives each of a and b such features the weight (a-1)! b! / (a+b)! or its counterpart.
    Summed over the background rows, which differ by the conditions they meet alone, this is one table per leaf.
    """
    out = []
    for trees in model.rounds:
        for output, tree in enumerate(trees):
            stack: list[tuple[int, dict]] = [(0, {})]
            while stack:
                node, path = stack.pop()
                f = int(tree.feature[node])
                if f >= 0:
                    for child, left in ((2 * node + 1, True), (2 * node + 2, False)):
                        stack.append((child, path | {f: _narrowed(path.get(f), f < model.ordered, float(tree.cut[node]), left)}))
                elif path and tree.value[node]:
                    conditions = list(path.items())
                    out.append((output, conditions, _leaf_table(_met(conditions, background), len(conditions), float(tree.value[node]))))
    return out


def _narrowed(known: tuple | None, ordered: bool, cut: float, left: bool) -> tuple:
    """A feature's condition after one more split: above and up to a number, or one level, or none of some levels."""
    if ordered:
        low, high = known[1:] if known else (-math.inf, math.inf)
        return ("range", low, min(high, cut)) if left else ("range", max(low, cut), high)
    if left:
        return ("is", cut)
    return known if known and known[0] == "is" else ("not", (*(known[1] if known else ()), cut))


def _met(conditions: list[tuple], matrix: np.ndarray) -> np.ndarray:
    """Which of the conditions each row meets, as bits of a number."""
    found = np.zeros(len(matrix), np.int64)
    for bit, (f, (kind, *given)) in enumerate(conditions):
        x = matrix[:, f]
        if kind == "range":
            ok = (x > given[0]) & (x <= given[1])
        else:
            ok = x == given[0] if kind == "is" else ~np.isin(x, given[0])
        found |= ok.astype(np.int64) << bit
    return found


def _leaf_table(others: np.ndarray, width: int, value: float) -> np.ndarray:
    """Mean contribution of each condition's feature, for every set of conditions that a row may meet."""
    kinds, counts = np.unique(others, return_counts=True)
    table = np.zeros((1 << width, width))
    for own in range(1 << width):
        for other, times in zip(kinds.tolist(), counts.tolist()):
            if own | other != (1 << width) - 1:
                continue  # a condition that neither meets: the leaf is out of reach
            mine, theirs = own & ~other, other & ~own
            a, b = mine.bit_count(), theirs.bit_count()
            if not a + b:
                continue
            whole = math.factorial(a + b)
            for bit in range(width):
                if mine >> bit & 1:
                    table[own, bit] += times * value * math.factorial(a - 1) * math.factorial(b) / whole
                elif theirs >> bit & 1:
                    table[own, bit] -= times * value * math.factorial(a) * math.factorial(b - 1) / whole
    return table / len(others)


def contributions(model: Booster, tables: list[tuple], matrix: np.ndarray) -> np.ndarray:
    """Rows x outputs x features."""
    out = np.zeros((len(matrix), len(model.base), matrix.shape[1]))
    for output, conditions, table in tables:
        gains = table[_met(conditions, matrix)]
        for bit, (f, _) in enumerate(conditions):
            out[:, output, f] += gains[:, bit]
    return out


def shapley(model: TrainedModel, rows: DataFrame, row_key: str, background: int = BACKGROUND) -> DataFrame:
    """``(row key, class, feature, contribution, base_value, prediction)`` for every given row.

    Shapley values of the model's score against the mean over some held-out rows, in closed form from the leaves' paths.
    The score is the predicted number (class is null), the log odds of the second of two classes (class 1), or of
    more classes the score of each (class 0, 1, ...). Contributions add up to prediction minus base value.
    """
    plan, booster = model.plan, model.booster
    names = [F.col(c) for c in encoded_names(plan)]
    sample = model.test.orderBy(hash_text(7, F.col(ROW)), ROW).limit(background).select(*[F.col(quoted(c)) for c in model.roles.names])
    known = encode(sample, plan).select(F.array(*names).alias("x")).collect()  # at most ``background`` rows
    matrix = np.array([r["x"] for r in known], float).reshape(len(known), len(names))
    tables = path_tables(booster, matrix)
    outputs, p = len(booster.base), len(names)

    @F.arrow_udf("array<double>")
    def explained(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.float64()))
        x = rows_matrix(column)
        return matrix_lists(np.column_stack([contributions(booster, tables, x).reshape(len(x), -1), booster.margins(x)]))

    given = rows.select(F.col(quoted(row_key)).alias("_key"), *[F.col(quoted(c)) for c in model.roles.names])
    told = encode(given, plan).select("_key", explained(F.array(*names)).alias("_told"))
    # Slots of the encoding: numbers, then ordinals, then nominals.
    ordered = [*model.roles.numeric, *model.roles.ordinal, *model.roles.nominal]
    base = booster.margins(matrix).mean(0)
    number = {"squared": F.lit(None).cast("int"), "logistic": F.lit(1)}
    parts = F.array(*[
        F.struct(
            number.get(booster.loss, F.lit(o)).alias("class"), F.lit(c).alias("feature"), F.get("_told", F.lit(o * p + i)).alias("contribution"),
            F.lit(float(base[o])).alias("base_value"), F.get("_told", F.lit(outputs * p + o)).alias("prediction"))
        for o in range(outputs) for i, c in enumerate(ordered)
    ])
    return told.select(F.col("_key").alias(row_key), F.inline(parts))


class MetricTree:
    """A shallow tree that explains one column by the others."""

    def __init__(self, df: DataFrame, target: str, roles: Roles, continuous: bool, max_depth: int = 3,
                 keys: Sequence[str] | None = None) -> None:
        if not roles.names:
            raise ValueError("There is no usable feature column to explain the metric with.")
        self.target, self.continuous = target, continuous
        self.features = [*roles.numeric, *roles.nominal, *roles.ordinal]
        # Categories keep one readable column each: their place in sorted order.
        coded = Roles(roles.numeric, (), roles.nominal + roles.ordinal)
        present = df.where(F.col(quoted(target)).isNotNull())
        plan = learn(present, coded, scale=False)
        self._levels, self._sizes = plan.levels, plan.sizes
        self.classes: list[Any] = []
        if not continuous:
            self.classes = sorted(r[0] for r in present.select(quoted(target)).distinct().collect())
            present = present.withColumn(LABEL, label_index(present, target, self.classes))
        else:
            present = present.withColumn(LABEL, numeric(present, target))
        rows = hold_out(present, keys or [*self.features, target])
        gather = VectorAssembler(inputCols=encoded_names(plan), outputCol=FEATURES)
        learner = (DecisionTreeRegressor if continuous else DecisionTreeClassifier)(
            featuresCol=FEATURES, labelCol=LABEL, maxDepth=max_depth, minWeightFractionPerNode=MIN_LEAF, seed=0,
            leafCol="_leaf", maxBins=256,
        )
        encoded = gather.transform(encode(rows, plan))
        self._data = settle(encoded.select(FEATURES, LABEL, "in_test"))  # read by both fits and every score
        self.model = learner.fit(self._data)
        self.importances = dict(
            sorted(zip(self.features, map(float, self.model.featureImportances.toArray())), key=lambda kv: (-kv[1], kv[0]))
        )
        # The check of fit on unseen rows uses a second tree that never saw them.
        self._checked = learner.fit(self._data.where("not in_test"))

    def _score(self, model, data: DataFrame) -> float:
        scored = model.transform(data)
        if self.continuous:
            gap = F.col(LABEL) - F.col("prediction")
            value = 1 - F.try_divide(F.avg(gap * gap), F.var_pop(LABEL))
        else:
            value = F.avg((F.col(LABEL) == F.col("prediction")).cast("double"))
        found = scored.agg(value.alias("s")).first()["s"]
        return 0.0 if found is None else float(found)

    def fit_score(self) -> float:
        return self._score(self.model, self._data)

    def held_out_score(self) -> float:
        return self._score(self._checked, self._data.where("in_test"))

    def _sides(self, name: str, cut: float) -> tuple[str, str]:
        """Both sides of a split in words. Up to ``_LISTED`` levels are listed, more are told by the last on the lower side."""
        if name not in self._levels:
            return f"{name} <= {cut:.6g}", f"{name} > {cut:.6g}"
        last, table = int(math.floor(cut)), self._levels[name]
        if self._sizes[name] <= _LISTED:
            levels = [r["level"] for r in table.orderBy("slot").collect()]
            return f"{name} in {levels[: last + 1]}", f"{name} in {levels[last + 1:]}"
        edge = table.where(F.col("slot") == last).first()["level"]
        return f"{name} up to {edge!r}", f"{name} after {edge!r}"

    def rules(self) -> list[tuple[int, str]]:
        """``(leaf number, rule text)`` in tree order; at most 2^depth of them."""
        out: list[tuple[int, str]] = []

        def walk(node, path: list[str]) -> None:
            if node.subtreeDepth() == 0:
                out.append((len(out), " and ".join(path) or "all rows"))
                return
            split = node.split()
            name, cut = self.features[split.featureIndex()], split.threshold()
            low, high = self._sides(name, cut)
            walk(node.leftChild(), [*path, low])
            walk(node.rightChild(), [*path, high])

        walk(self.model._call_java("rootNode"), [])
        return out

    def segments(self) -> DataFrame:
        """``(leaf, rule, n, mean)``: the rows of each leaf and their mean target (class index for categories)."""
        spark = self._data.sparkSession
        text = spark.createDataFrame(self.rules(), "leaf int, rule string")
        stats = self.model.transform(self._data).groupBy(F.col("_leaf").cast("int").alias("leaf")).agg(
            F.count(F.lit(1)).alias("n"), F.avg(LABEL).alias("mean")
        )
        return stats.join(text, "leaf")
