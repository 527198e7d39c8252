"""Supervised models: checks, a reproducible split, boosted trees, held-out metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import NUMERIC, field_type, numeric, quoted
from ..functions.hashing import hash_text
from ..functions.joins import lookup
from ..functions.ordering import COUNT, boundaries, place, with_range
from ..functions.stages import settle
from . import boost
from .prep import OWN, Plan, Roles, encode, encoded_names, learn

# Rows needed to train, share held out, rows below which trust is moderate.
MIN_TRAIN_ROWS = 30
TEST_SHARE = 0.25
SEED = 0
_SPLIT_DIGITS = 4  # leading hex digits: 65,536 ranges

LABEL, PREDICTION, ROW = "_label", "_prediction", "_row"
_INPUT, _ANSWER = OWN + "input", OWN + "answer"
ALGORITHM = "gradient_boosted_trees"


def class_counts(df: DataFrame, target: str) -> DataFrame:
    t = F.col(quoted(target))
    return df.where(t.isNotNull()).groupBy(t.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def hold_out(df: DataFrame, keys: Sequence[str], by: str | None = None, seed: int = SEED) -> DataFrame:
    """Add ``in_test``: within each class, the quarter of rows with the lowest key hash.

    Counts per hash range find the range that holds each class's cut; only that range's
    rows, a tiny slice, are sorted.
    """
    rows = df.withColumn("_h", hash_text(seed, *[F.col(quoted(k)) for k in keys]))
    rows = rows.withColumn("_hr", F.substring("_h", 1, _SPLIT_DIGITS))
    rows = rows.withColumn("_class", F.col(quoted(by)).cast("string") if by else F.lit("all"))
    counts = rows.groupBy("_class", "_hr").agg(F.count(F.lit(1)).alias("_n"))
    per = Window.partitionBy("_class")
    upto = F.sum("_n").over(per.orderBy("_hr").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    size = F.sum("_n").over(per)
    edges = settle(
        counts.select("_class", "_hr", "_n", upto.alias("_upto"), F.ceil(size * TEST_SHARE).alias("_want"), size.alias("_size"))
        .where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        .select(
            F.col("_class").alias("_ec"), F.col("_hr").alias("_er"),
            (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_need"), "_size",
        )
    )
    same = F.col("_class").eqNullSafe(F.col("_ec")) & (F.col("_hr") == F.col("_er"))
    near = rows.select("_class", "_hr", "_h").join(edges, same)
    # Equal hashes are counted, not listed: rows that share a key stay on one side together.
    slots = near.groupBy("_class", "_h", "_need", "_size").agg(F.count(F.lit(1)).alias("_c"))
    seen = F.sum("_c").over(per.orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = (
        slots.withColumn("_seen", seen)
        .where((F.col("_seen") >= F.col("_need")) & (F.col("_seen") - F.col("_c") < F.col("_need")))
        .select("_class", F.col("_h").alias("_cut"), "_size")
    )
    marked = lookup(rows, "_class", cuts, "_class", "_size", {"_cut": "_cut"})
    return marked.withColumn("in_test", F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False))).drop(
        "_h", "_hr", "_class", "_cut"
    )


@dataclass
class TrainedModel:
    plan: Plan
    booster: boost.Booster
    roles: Roles
    target: str
    task: str
    algorithm: str
    classes: list[Any] = field(default_factory=list)
    data: DataFrame | None = None  # feature columns, target, in_test, row number: written once
    n_rows: int = 0

    @property
    def test(self) -> DataFrame:
        return self.data.where("in_test")

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``_prediction`` (class index or value) and, for classifiers, ``_proba`` (array)."""
        missing = [c for c in self.roles.names if c not in df.columns]
        if missing:
            raise ValueError(f"Feature columns are missing: {missing}")
        # The caller's columns travel as one struct, so none of them can meet a working column.
        row = F.struct(*[F.col(quoted(c)) for c in df.columns]).alias(_INPUT)
        encoded = encode(df.select(row, *[F.col(quoted(c)) for c in self.roles.names]), self.plan)
        out = encoded.select(_INPUT, boost.answer(self.booster, [F.col(c) for c in encoded_names(self.plan)]).alias(_ANSWER))
        if self.task == "classification":
            likeliest = F.array_position(_ANSWER, F.array_max(_ANSWER)) - 1  # the first of equals
            made = [likeliest.cast("double").alias(PREDICTION), F.col(_ANSWER).alias("_proba")]
        else:
            made = [F.get(_ANSWER, F.lit(0)).alias(PREDICTION)]
        kept = [c for c in df.columns if c not in (PREDICTION, "_proba")]
        return out.select(*[F.col(_INPUT).getField(c).alias(c) for c in kept], *made)

    def predicted_value(self, kind: T.DataType) -> Column:
        if self.task == "regression":
            return F.col(PREDICTION)
        values = F.array(*[F.lit(c) for c in self.classes])
        return F.get(values, F.col(PREDICTION).cast("int")).cast(kind)

    def with_label(self, df: DataFrame) -> DataFrame:
        if self.task == "regression":
            return df.withColumn(LABEL, numeric(df, self.target))
        return df.withColumn(LABEL, label_index(df, self.target, self.classes))


def label_index(df: DataFrame, target: str, classes: Sequence[Any]) -> Column:
    kind = field_type(df, target)
    values = F.array(*[F.lit(c) for c in classes]).cast(T.ArrayType(kind))
    return (F.array_position(values, F.col(quoted(target))) - 1).cast("double")


def check_training(df: DataFrame, target: str, task: str) -> tuple[str | None, int, list[Any]]:
    """``(reason to decline, usable rows, classes)``."""
    kind = field_type(df, target)
    if task == "regression":
        if not isinstance(kind, NUMERIC):
            raise ValueError(f"A regression target must be numeric; {target!r} is not.")
        n = df.where(numeric(df, target).isNotNull()).count()
        classes: list[Any] = []
    else:
        counts = class_counts(df, target)
        totals = counts.agg(F.sum("n"), F.count(F.lit(1)), F.min("n"), F.min_by("class", F.struct("n", "class"))).first()
        n, n_classes, least, rare = totals[0] or 0, totals[1], totals[2], totals[3]
    if n == 0:
        raise ValueError(f"{target!r} has no values to learn from.")
    if n < MIN_TRAIN_ROWS:
        return f"only {n} usable rows, and training needs {MIN_TRAIN_ROWS}", n, []
    if task == "classification":
        if n_classes < 2:
            return f"{target!r} has a single class, so there is nothing to tell apart", n, []
        if least < 2:
            return f"class {rare!r} occurs once, so it cannot be both learned and checked", n, []
        classes = sorted(r["class"] for r in counts.select("class").collect())
    return None, n, classes


def train(
    df: DataFrame,
    target: str,
    task: str,
    roles: Roles,
    keys: Sequence[str] | None = None,
    rounds: int = 20,
    depth: int = 5,
) -> TrainedModel | tuple[str, int]:
    """A fitted model, or ``(reason, rows)`` when the data cannot carry one.

    Boosted trees in all cases: squared loss for numbers, logistic for two classes, and for more classes softmax with one
    tree per class and round.
    """
    if not roles.names:
        raise ValueError("There is no usable feature column to train on.")
    reason, n, classes = check_training(df, target, task)
    if reason:
        return reason, n
    keys = list(keys or [*roles.names, target])
    wanted = list(dict.fromkeys([*roles.names, target, *keys]))
    usable = df.where(F.col(quoted(target)).isNotNull()).select(*[F.col(quoted(c)) for c in wanted])
    split = hold_out(usable, keys, target if task == "classification" else None)
    data = settle(split.withColumn(ROW, F.monotonically_increasing_id()))
    fit_rows = data.where("not in_test")
    if task == "regression":
        labelled = fit_rows.withColumn(LABEL, numeric(fit_rows, target)).where(F.col(LABEL).isNotNull())
        loss, base = boost.SQUARED, [float(labelled.agg(F.avg(LABEL)).first()[0])]
    else:
        labelled = fit_rows.withColumn(LABEL, label_index(fit_rows, target, classes))
        sizes = {int(r[LABEL]): r["count"] for r in labelled.groupBy(LABEL).count().collect()}  # a row per class
        loss, base = start(sizes, len(classes))
    plan = learn(labelled, roles, scale=False)
    rows = encode(labelled, plan)
    names = encoded_names(plan)
    ordered = len(roles.numeric + roles.ordinal)
    edges = boost.bin_edges(rows, names[:ordered])
    booster = boost.boost(rows, [F.col(c) for c in names], F.col(LABEL), loss, edges, base, rounds, depth,
                          levels=sum(plan.sizes.get(c, 0) for c in roles.nominal))
    return TrainedModel(plan, booster, roles, target, task, ALGORITHM, classes, data, n)


def start(sizes: dict[int, int], classes: int) -> tuple[str, list[float]]:
    """Loss and first scores from the training rows of each class: log odds of two, log shares of more."""
    n = sum(sizes.values())
    if classes == 2:
        return boost.LOGISTIC, [math.log(max(sizes.get(1, 0), 0.5) / max(sizes.get(0, 0), 0.5))]
    return boost.SOFTMAX, [math.log(max(sizes.get(c, 0), 0.5) / n) for c in range(classes)]


# --- metrics on a frame of labels and predictions -----------------------------------------


def confusion(df: DataFrame, label: str, prediction: str, count: str | None = None) -> DataFrame:
    """``(label, prediction, n)``: at most classes² rows. A row of ``df`` stands for as many as its ``count`` says."""
    return df.groupBy(F.col(quoted(label)).alias("label"), F.col(quoted(prediction)).alias("prediction")).agg(
        (F.sum(count) if count else F.count(F.lit(1))).alias("n")
    )


def classification_metrics(cells: DataFrame) -> DataFrame:
    """``(n, accuracy, precision, recall, f1, baseline_accuracy)``, weighted by class size."""
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    actual = cells.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    called = cells.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("called"))
    per = actual.join(called, "class", "left").select(
        "support",
        "hits",
        F.coalesce(F.try_divide(F.col("hits"), F.col("called")), F.lit(0.0)).alias("p"),
        (F.col("hits") / F.col("support")).alias("r"),
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    n = F.sum("support")
    return per.withColumn("f", f1).agg(
        n.alias("n"),
        (F.sum("hits") / n).alias("accuracy"),
        (F.sum(F.col("support") * F.col("p")) / n).alias("precision"),
        (F.sum(F.col("support") * F.col("r")) / n).alias("recall"),
        (F.sum(F.col("support") * F.col("f")) / n).alias("f1"),
        (F.max("support") / n).alias("baseline_accuracy"),
    )


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(n, mae, rmse, r2)``."""
    y, p = F.col(quoted(label)), F.col(quoted(prediction))
    n = F.count(y)
    sse = F.sum((y - p) * (y - p))
    return df.agg(
        n.alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.try_divide(sse, n)).alias("rmse"),
        (1 - F.try_divide(sse, F.var_pop(y) * n)).alias("r2"),
    )


def class_auc(df: DataFrame, count: str | None = None) -> DataFrame:
    """From ``(class, positive, score)``: ``(class, n_pos, n_neg, auc)``, one-vs-rest, ties halved.

    Scores are counted per (class, score) and cut where they lie, so no class is ranked in one task. A row of ``df`` stands
    for as many as its ``count`` says.
    """
    counts = df.groupBy("class", "positive", "score").agg((F.sum(count) if count else F.count(F.lit(1))).alias(COUNT))
    cuts = boundaries(df, ["score"])["score"]
    placed = place(with_range(counts, "score", cuts), "score", ["class"])
    c = F.col(COUNT).cast("double")
    rank = F.col("less") + (F.col("ties") + 1) / 2
    pos = F.sum(F.when(F.col("positive"), c).otherwise(0.0))
    sums = placed.groupBy("class").agg(
        pos.alias("n_pos"), F.sum(c).alias("n"), F.sum(F.when(F.col("positive"), c * rank).otherwise(0.0)).alias("rs")
    )
    p, q = F.col("n_pos"), F.col("n") - F.col("n_pos")
    return sums.select(
        "class", p.cast("long").alias("n_pos"), q.cast("long").alias("n_neg"),
        F.try_divide(F.col("rs") - p * (p + 1) / 2, p * q).alias("auc"),
    )


def holdout_metrics(model: TrainedModel) -> dict[str, Any]:
    """All held-out numbers of a model; only aggregates reach the driver.

    Rows are scored once: those of a class that got the same chances are counted, and all numbers of a classifier follow
    from the counts.
    """
    features = [F.col(quoted(c)) for c in model.roles.names]
    scored = model.score(model.with_label(model.test).select(*features, LABEL))
    if model.task == "regression":
        return regression_metrics(scored, LABEL, PREDICTION).first().asDict()
    scored = settle(scored.groupBy(LABEL, PREDICTION, "_proba").agg(F.count(F.lit(1)).alias(COUNT)))
    cells = settle(confusion(scored, LABEL, PREDICTION, COUNT))
    counts = {(int(r["label"]), int(r["prediction"])): r["n"] for r in cells.collect()}
    values = classification_metrics(cells).first().asDict()
    k = len(model.classes)
    values["confusion_matrix"] = [[counts.get((i, j), 0) for j in range(k)] for i in range(k)]
    tall = scored.select(LABEL, COUNT, F.posexplode("_proba").alias("class", "score")).select(
        "class", (F.col(LABEL) == F.col("class")).alias("positive"), "score", F.col(COUNT).alias("times")
    )
    aucs = class_auc(tall.where("class = 1") if k == 2 else tall, "times").collect()
    weight = sum(r["n_pos"] for r in aucs)
    known = all(r["auc"] is not None and not math.isnan(r["auc"]) for r in aucs) and weight
    values["roc_auc"] = sum(r["auc"] * r["n_pos"] for r in aucs) / weight if known else None
    return values


def add_predictions(model: TrainedModel, df: DataFrame, column: str) -> DataFrame:
    scored = model.score(df)
    kind = field_type(df, model.target) if model.target in df.columns else T.StringType()
    made = scored.withColumn(column, model.predicted_value(kind if model.task == "classification" else T.DoubleType()))
    return made.drop(PREDICTION, "_proba") if column not in (PREDICTION, "_proba") else made
