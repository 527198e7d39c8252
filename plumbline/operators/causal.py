"""Effect of a treatment on an outcome by backdoor linear adjustment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import numeric, quoted, require
from ..functions.hashing import gaussian
from ..functions.joins import lookup
from ..functions.stages import settle

# Rows needed to answer, rows for moderate trust, tolerated shift of the effect.
MIN_ROWS = 50
MODERATE_ROWS = 500
TOLERANCE = 0.5
RANDOM_CAUSES = 10
#: Cells of category combinations that one process absorbs by itself; more are swept by Spark.
CELLS = 50_000
#: Sweeps end when no entry of the products, columns scaled to variance one, moves by more than this.
STILL = 1e-12


@dataclass
class Estimate:
    n: int
    treatment_values: int
    effect: float | None = None
    new_effect: float | None = None
    passed: bool | None = None


def complete_rows(
    df: DataFrame, treatment: str, outcome: str, numbers: Sequence[str], categories: Sequence[str]
) -> DataFrame:
    require(df, treatment, outcome, *numbers, *categories)
    picked = [numeric(df, treatment).alias("_t"), numeric(df, outcome).alias("_y")]
    picked += [numeric(df, c).alias(f"_n{i}") for i, c in enumerate(numbers)]
    picked += [F.col(quoted(c)).cast("string").alias(f"_c{i}") for i, c in enumerate(categories)]
    return df.select(*picked).dropna()


def covariance(rows: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Sample covariance of numeric columns: p × p numbers, computed by Spark in the JVM."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v").transform(rows).select("v")
    sd = vectors.select(Summarizer.std(F.col("v")).alias("sd")).first()["sd"].toArray()
    r = Correlation.corr(vectors, "v").first()[0].toArray()
    return np.nan_to_num(r) * np.outer(sd, sd)


def absorbed(rows: DataFrame, columns: Sequence[str], categories: Sequence[str]) -> np.ndarray:
    """Covariance of the columns once the means of every category's levels are taken out, for any number of levels.

    With one category these are deviations from group means. With more, each category's means are taken out in turn until
    the products stand still, which gives the residuals of the regression on 0/1 columns for all levels. Only sums by
    combination of levels take part, so rows are read once.
    """
    whole = covariance(rows, columns)
    if not categories:
        return whole
    size = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    scale = np.sqrt(np.where(np.diag(whole) > 0, np.diag(whole), 1.0))
    scaled = [(F.col(c) - F.lit(size[f"m{k}"])) / F.lit(float(scale[k])) for k, c in enumerate(columns)]
    cells = settle(rows.groupBy(*categories).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s{k}") for k, c in enumerate(scaled)]))
    p = len(columns)
    if len(categories) == 1:
        taken = _products(cells, [F.col(f"_s{k}") / F.col("_n") for k in range(p)], p)
    elif cells.limit(CELLS + 1).count() <= CELLS:
        taken = _swept_here(cells, categories, p)
    else:
        taken = _swept(cells, categories, p)
    left = whole / np.outer(scale, scale) - taken / max(1, size["n"] - 1)
    # What the levels explain in full leaves rounding errors behind, which are no variation.
    gone = np.diag(left) < 1e-10
    left[gone, :] = left[:, gone] = 0.0
    return left * np.outer(scale, scale)


def _products(cells: DataFrame, fitted: Sequence[Column], p: int) -> np.ndarray:
    """Sum over cells of fitted value times cell sum, for every two columns."""
    pairs = [(a, b) for a in range(p) for b in range(a, p)]
    row = cells.agg(*[F.sum(fitted[a] * F.col(f"_s{b}")).alias(f"{a}_{b}") for a, b in pairs]).first()
    out = np.zeros((p, p))
    for a, b in pairs:
        out[a, b] = out[b, a] = row[f"{a}_{b}"]
    return out


def _swept_here(cells: DataFrame, categories: Sequence[str], p: int) -> np.ndarray:
    """The sweeps over a small table of cells, in memory."""
    table = cells.toPandas()
    n, sums = table["_n"].to_numpy(float), table[[f"_s{k}" for k in range(p)]].to_numpy(float)
    codes = [np.unique(table[c].to_numpy(str), return_inverse=True)[1] for c in categories]
    sizes = [np.bincount(code, n) for code in codes]
    fitted, before = np.zeros_like(sums), None
    while True:
        for code, size in zip(codes, sizes):
            rest = np.zeros((len(size), p))
            np.add.at(rest, code, sums - n[:, None] * fitted)
            fitted += (rest / size[:, None])[code]
        now = fitted.T @ sums
        if before is not None and np.abs(now - before).max() <= STILL * max(1.0, n.sum()):
            return (now + now.T) / 2
        before = now


def _swept(cells: DataFrame, categories: Sequence[str], p: int) -> np.ndarray:
    """The same sweeps as group means joined back to the cells; each sweep is written out."""
    total = float(cells.agg(F.sum("_n")).first()[0])
    names = ["_n", *[f"_s{k}" for k in range(p)]]
    now_cells = cells.select(*categories, *names, *[F.lit(0.0).alias(f"_f{k}") for k in range(p)])
    before = None
    while True:
        for c in categories:
            means = now_cells.groupBy(c).agg(
                F.count(F.lit(1)).alias("_cells"),
                *[(F.sum(F.col(f"_s{k}") - F.col("_n") * F.col(f"_f{k}")) / F.sum("_n")).alias(f"_d{k}") for k in range(p)])
            joined = lookup(now_cells, c, means, c, "_cells", {f"_d{k}": f"_d{k}" for k in range(p)})
            now_cells = settle(joined.select(*categories, *names, *[(F.col(f"_f{k}") + F.col(f"_d{k}")).alias(f"_f{k}") for k in range(p)]))
        now = _products(now_cells, [F.col(f"_f{k}") for k in range(p)], p)
        if before is not None and np.abs(now - before).max() <= STILL * max(1.0, total):
            return now
        before = now


def _coefficient(cov: np.ndarray, predictors: list[int], outcome: int) -> float:
    """Least-squares coefficient of the first predictor (constant columns drop out)."""
    sub = cov[np.ix_(predictors, predictors)]
    scale = np.sqrt(np.where(np.diag(sub) > 0, np.diag(sub), 1.0))
    beta = np.linalg.pinv(sub / np.outer(scale, scale), rcond=1e-12, hermitian=True) @ (
        cov[predictors, outcome] / scale
    )
    return float(beta[0] / scale[0])


def causal_effect(
    df: DataFrame, treatment: str, outcome: str, numbers: Sequence[str] = (), categories: Sequence[str] = ()
) -> Estimate:
    """Adjusted effect, and the same effect with random common causes added one at a time.

    All regressions come from one covariance pass: the random columns ride along. Categories, of any number of levels,
    are absorbed rather than turned into columns.
    """
    rows = complete_rows(df, treatment, outcome, numbers, categories)
    shape = rows.agg(F.count(F.lit(1)).alias("n"), (F.max("_t") > F.min("_t")).alias("varies")).first()
    out = Estimate(shape["n"], 2 if shape["varies"] else 1)
    if out.n < MIN_ROWS or not shape["varies"]:
        return out
    base = ["_t", *[f"_n{i}" for i in range(len(numbers))]]
    # Noise depends on a row's values and, among equal rows, on its number: the same in any layout of the table.
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_times"))
    numbered = counted.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).drop("_times")
    noise = {f"_z{s}": gaussian(s, F.col("_turn"), *[F.col(c) for c in rows.columns]) for s in range(RANDOM_CAUSES)}
    wide = settle(numbered.withColumns(noise))
    cov = absorbed(wide, [*base, "_y", *noise], [f"_c{i}" for i in range(len(categories))])
    y = len(base)
    out.effect = _coefficient(cov, list(range(len(base))), y)
    shifted = [_coefficient(cov, [*range(len(base)), y + 1 + s], y) for s in range(RANDOM_CAUSES)]
    out.new_effect = float(np.mean(shifted))
    out.passed = abs(out.new_effect - out.effect) < TOLERANCE * (abs(out.effect) + 1e-9)
    return out
