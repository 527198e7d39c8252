"""Association tests between two columns, and the matrix of all pairs.

Spark reduces each question to sufficient statistics (moments, rank sums, cell counts);
the driver turns those few numbers into a statistic, a p-value and an effect size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.clean import numeric, present, quoted
from ..functions.joins import lookup
from ..functions.ordering import (
    COUNT, RANGE, boundaries, column_ranks, cumulate, place, quantiles_of, value_counts, with_range,
)
from ..functions.stages import settle

# Decision thresholds of the routing rules.
ALPHA = 0.05
MIN_ROWS = 10
SHAPIRO_MAX_N = 50
MIN_GROUP = 20
MIN_EXPECTED = 5.0


@dataclass
class Test:
    """One routed test: what was run, its numbers, and the checks behind the choice."""

    method: str
    n: int
    values: dict[str, Any] = field(default_factory=dict)
    checks: dict[str, Any] = field(default_factory=dict)
    measure: str = "none"

    @property
    def effect(self) -> float | None:
        return self.values.get("effect_size")


# --- normality -----------------------------------------------------------------------


def k_squared(n: Column, skew: Column, kurt: Column) -> Column:
    """D'Agostino-Pearson K² from the count, population skewness and excess kurtosis."""
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2.0 * (beta2 - 1)) - 1
    scale = F.sqrt(2.0 / (w2 - 1))
    ratio = F.when(y == 0, 1.0).otherwise(y) / scale
    z_skew = F.log(ratio + F.sqrt(ratio * ratio + 1)) / F.sqrt(0.5 * F.log(w2))

    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurt + 3 - mean) / F.sqrt(var)
    root_b1 = (
        6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = 6.0 + 8.0 / root_b1 * (2.0 / root_b1 + F.sqrt(1 + 4.0 / (root_b1 * root_b1)))
    denom = 1 + x * F.sqrt(2.0 / (a - 4))
    cube = F.signum(denom) * F.pow((1 - 2.0 / a) / F.abs(denom), F.lit(1.0 / 3))
    z_kurt = ((1 - 2.0 / (9.0 * a)) - cube) / F.sqrt(2.0 / (9.0 * a))
    return z_skew * z_skew + z_kurt * z_kurt


def normal_by_moments(n: Column, skew: Column, kurt: Column) -> Column:
    """K² has two degrees of freedom, so its p-value is ``exp(-K²/2)``."""
    return F.exp(-k_squared(n, skew, kurt) / 2) > ALPHA


def shapiro_normal(values: np.ndarray) -> bool:
    x = np.asarray(values, dtype=float)
    return bool(len(x) >= 3 and np.ptp(x) > 0 and tails.shapiro_p(x) > ALPHA)


def _shapiro_group(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"normal": [shapiro_normal(pdf["v"].to_numpy())]})


# --- continuous × continuous -----------------------------------------------------------


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r over the rows that have both; NULL where one of them is constant there."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def number_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(numeric(df, x).alias("x"), numeric(df, y).alias("y")).dropna()


def pearson(pairs: DataFrame) -> DataFrame:
    """``(n, r, normal_x, normal_y)``; normality by moments, meaningful above 50 rows."""
    flags = {}
    stats = [F.count(F.lit(1)).alias("n"), correlation("x", "y").alias("r")]
    for c in ("x", "y"):
        stats += [
            F.skewness(c).alias(f"s_{c}"),
            F.kurtosis(c).alias(f"k_{c}"),
            (F.max(c) > F.min(c)).alias(f"varies_{c}"),
        ]
        flags[f"normal_{c}"] = F.when(
            F.col(f"varies_{c}") & (F.col("n") > SHAPIRO_MAX_N),
            normal_by_moments(F.col("n"), F.col(f"s_{c}"), F.col(f"k_{c}")),
        ).otherwise(False)
    return pairs.agg(*stats).select("n", "r", *[c.alias(k) for k, c in flags.items()])


def attach_ranks(df: DataFrame, columns: Sequence[str], ranks: DataFrame) -> DataFrame:
    """Add ``_rank_<i>``, the average rank of each column's value."""
    for i, c in enumerate(columns):
        own = ranks.where(F.col("column") == c)
        df = lookup(df, c, own, "value", "ties", {"avg_rank": f"_rank_{i}"}, settled=True)
    return df


def spearman(pairs: DataFrame) -> DataFrame:
    """``(n, rho)``: average ranks, joined back per distinct value, then correlated."""
    ranked = attach_ranks(pairs, ["x", "y"], column_ranks(pairs, ["x", "y"]))
    return ranked.agg(F.count(F.lit(1)).alias("n"), correlation("_rank_0", "_rank_1").alias("rho"))


def test_numbers(df: DataFrame, x: str, y: str) -> Test:
    pairs = number_pairs(df, x, y)
    base = pearson(pairs).first()
    n = base["n"]
    if n < MIN_ROWS:
        return Test("declined", n)
    normal = bool(base["normal_x"] and base["normal_y"])
    if n <= SHAPIRO_MAX_N:
        sample = pairs.toPandas()  # at most 50 rows
        normal = shapiro_normal(sample["x"]) and shapiro_normal(sample["y"])
    r = base["r"] if normal else spearman(pairs).first()["rho"]
    r = None if r is None else max(-1.0, min(1.0, r))  # a last digit too much
    if r is None or math.isnan(r):
        return Test("degenerate", n, {"statistic": 0.0, "p_value": 1.0, "effect_size": 0.0, "n": n},
                    {"constant_value_column": True})
    return Test(
        "pearson" if normal else "spearman",
        n,
        {"statistic": r, "p_value": tails.correlation_p(r, n), "effect_size": abs(r), "r_squared": r * r, "n": n},
        {"both_normal": normal},
        "pearson_r" if normal else "spearman_rho",
    )


# --- categorical × continuous ------------------------------------------------------------


def group_pairs(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.select(present(df, group).alias("g"), numeric(df, value).alias("v")).dropna()


def group_moments(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("v").alias("mean"),
        F.var_samp("v").alias("var"),
        F.skewness("v").alias("skew"),
        F.kurtosis("v").alias("kurt"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
    )


def anova(groups: DataFrame) -> DataFrame:
    """``(k, n, f, eta_squared, omega_squared)`` from group sizes, means and variances."""
    total = groups.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    d = F.col("_gap")
    sums = groups.withColumn("_gap", F.col("mean") - total.scalar()).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * d * d).alias("ssb"),
        F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("var")).otherwise(0.0)).alias("ssw"),
    )
    k, n, ssb, ssw = (F.col(c) for c in ("k", "n", "ssb", "ssw"))
    within = F.when(n > k, ssw / (n - k))
    omega = F.try_divide(ssb - (k - 1) * within, ssb + ssw + within)
    return sums.select(
        "k",
        "n",
        F.try_divide(F.try_divide(ssb, k - 1), within).alias("f"),
        F.coalesce(F.try_divide(ssb, ssb + ssw), F.lit(0.0)).alias("eta_squared"),
        F.coalesce(F.greatest(F.lit(0.0), omega), F.lit(0.0)).alias("omega_squared"),
    )


def welch(groups: DataFrame) -> DataFrame:
    """``(t, df)`` of the two groups in key order."""
    first = F.min_by(F.struct("n", "mean", "var"), "g")
    second = F.max_by(F.struct("n", "mean", "var"), "g")
    pair = groups.agg(first.alias("a"), second.alias("b"))
    va, vb = F.col("a.var") / F.col("a.n"), F.col("b.var") / F.col("b.n")
    return pair.select(
        F.try_divide(F.col("a.mean") - F.col("b.mean"), F.sqrt(va + vb)).alias("t"),
        F.try_divide(
            (va + vb) * (va + vb), F.try_divide(va * va, F.col("a.n") - 1) + F.try_divide(vb * vb, F.col("b.n") - 1)
        ).alias("df"),
    )


def rank_groups(pairs: DataFrame) -> DataFrame:
    """``(g, n, rank_sum, total, tie_term)``; ``rank_sum`` is of ranks minus their mean.

    Rows are counted per (group, value) first, so no raw row is ranked or moved.
    """
    cuts = boundaries(pairs, ["v"])["v"]
    counts = with_range(pairs.groupBy("g", "v").agg(F.count(F.lit(1)).alias(COUNT)), "v", cuts)
    placed = place(counts, "v")
    c, t = F.col(COUNT).cast("double"), F.col("ties").cast("double")
    centred = F.col("less") + (t + 1) / 2 - (F.col("total") + 1) / 2
    return placed.groupBy("g").agg(
        F.sum(COUNT).alias("n"),
        F.sum(c * centred).alias("rank_sum"),
        F.max("total").alias("total"),
        F.sum(c * (t * t - 1)).alias("tie_part"),
    )


def kruskal(ranked: DataFrame) -> DataFrame:
    """``(k, n, h, epsilon_squared, tie_term)``."""
    sums = ranked.agg(
        F.count(F.lit(1)).alias("k"),
        F.max("total").alias("n"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("ss"),
        F.sum("tie_part").alias("tie_term"),
    )
    n = F.col("n").cast("double")
    h = F.try_divide(12.0 * F.col("ss") / (n * (n + 1)), 1 - F.try_divide(F.col("tie_term"), n * n * n - n))
    return sums.select("k", "n", h.alias("h"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(h, n - 1))).alias(
        "epsilon_squared"), "tie_term")


def mann_whitney(ranked: DataFrame) -> DataFrame:
    """``(u, n1, n2, tie_term)``: U of the first group in key order."""
    first, second = F.min_by(F.struct("n", "rank_sum", "total"), "g"), F.max_by("n", "g")
    row = ranked.agg(first.alias("a"), second.alias("n2"), F.sum("tie_part").alias("tie_term"))
    n1 = F.col("a.n")
    u = F.col("a.rank_sum") + n1 * (F.col("a.total") + 1) / 2 - n1 * (n1 + 1) / 2
    return row.select(u.alias("u"), n1.alias("n1"), "n2", "tie_term")


def levene(pairs: DataFrame) -> DataFrame:
    """``(k, n, w)``: equality of spread around group medians, groups of two or more."""
    counts = value_counts(pairs, "v", ["g"])
    medians = quantiles_of(place(counts, "v", ["g"]), "v", [0.5], ["g"]).where("n >= 2")
    z = F.abs(F.col("v") - F.col("q0"))
    c = F.col(COUNT)
    spread = (
        lookup(counts, "g", medians, "g", "n", {"q0": "q0"})
        .where("q0 is not null")
        .groupBy("g")
        .agg(F.sum(c).alias("n"), F.sum(c * z).alias("sz"), F.sum(c * z * z).alias("szz"))
        .select("g", "n", (F.col("sz") / F.col("n")).alias("mean"),
                ((F.col("szz") - F.col("sz") * F.col("sz") / F.col("n")) / (F.col("n") - 1)).alias("var"))
    )
    return anova(spread).select("k", "n", F.col("f").alias("w"))


def test_groups(df: DataFrame, group: str, value: str) -> Test:
    pairs = group_pairs(df, group, value)
    groups = group_moments(pairs)
    big = F.when(F.col("hi") == F.col("lo"), False).when(
        F.col("n") > SHAPIRO_MAX_N, normal_by_moments(F.col("n"), F.col("skew"), F.col("kurt"))
    )
    shape = groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.min("n").alias("smallest"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.coalesce(F.every(F.coalesce(big, F.lit(True))), F.lit(False)).alias("big_normal"),
        F.count_if((F.col("n") <= SHAPIRO_MAX_N) & (F.col("hi") > F.col("lo"))).alias("n_small"),
    ).first()
    k, n = shape["k"], shape["n"]
    if k < 2:
        return Test("declined_groups", n, {"n_groups": k})
    if shape["lo"] == shape["hi"]:
        return Test("degenerate", n, {"statistic": 0.0, "p_value": 1.0, "effect_size": 0.0, "n_groups": k},
                    {"constant_value_column": True})
    if n < MIN_ROWS:
        return Test("declined", n)
    normal = shape["big_normal"]
    if normal and shape["n_small"]:
        few = groups.where(F.col("n") <= SHAPIRO_MAX_N).select("g")
        small = pairs.join(few, "g", "left_semi")  # at most 50 rows per group
        tested = small.groupBy("g").applyInPandas(_shapiro_group, "normal boolean")
        normal = bool(tested.agg(F.every("normal")).first()[0])
    sized = shape["smallest"] >= MIN_GROUP
    lev = levene(pairs).first()
    equal = False
    if lev["k"] and lev["k"] >= 2 and lev["n"] > lev["k"] and lev["w"] is not None:
        equal = tails.f_sf(lev["w"], lev["k"] - 1, lev["n"] - lev["k"]) > ALPHA
    checks = {"all_groups_normal": normal, "equal_variance": equal, "enough_samples": sized}
    values: dict[str, Any] = {}
    if normal and sized and (k == 2 or equal):
        fit = anova(groups).first()
        if k == 2:
            method, w = "welch_t_test", welch(groups).first()
            stat, p = w["t"], tails.t_two_sided(w["t"], w["df"])
        else:
            method, stat, p = "anova", fit["f"], tails.f_sf(fit["f"], k - 1, n - k)
        measure, effect = "eta_squared", fit["eta_squared"]
        values["omega_squared"] = fit["omega_squared"]
        checks["parametric"] = True
    else:
        ranked = rank_groups(pairs)
        h = kruskal(ranked).first()
        if k == 2:
            method, m = "mann_whitney", mann_whitney(ranked).first()
            stat, p = m["u"], tails.mann_whitney_p(m["u"], m["n1"], m["n2"], m["tie_term"])
        else:
            method, stat, p = "kruskal_wallis", h["h"], tails.chi2_sf(h["h"], k - 1)
        measure, effect = "epsilon_squared", h["epsilon_squared"]
        checks["parametric"] = False
    values |= {"statistic": stat, "p_value": p, "n_groups": k, "effect_size": effect}
    return Test(method, n, values, checks, measure)


# --- categorical × categorical --------------------------------------------------------


def category_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.lit(0).alias("pair"), present(df, a).alias("a"), present(df, b).alias("b")).dropna()


def contingency(pairs: DataFrame) -> DataFrame:
    """Per pair: ``n, r, c, chi2, yates, min_expected, cramers_v`` and the first cell's odds ratio.

    Only the observed cells exist as rows; the expected mass of the empty ones is what
    the observed ones leave over.
    """
    cells = pairs.groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy("pair", "a").agg(F.sum("o").alias("row_total"))
    cols = cells.groupBy("pair", "b").agg(F.sum("o").alias("col_total"))
    size = rows.groupBy("pair").agg(
        F.sum("row_total").alias("n"), F.count(F.lit(1)).alias("r"), F.min("row_total").alias("min_row"),
        F.sum(1.0 / F.col("row_total")).alias("inv_row"),
    )
    width = cols.groupBy("pair").agg(
        F.count(F.lit(1)).alias("c"), F.min("col_total").alias("min_col"),
        F.sum(1.0 / F.col("col_total")).alias("inv_col"), F.max("b").alias("last_b"),
    )
    full = cells.join(rows, ["pair", "a"]).join(cols, ["pair", "b"]).join(size, "pair").join(width, "pair")
    e = F.col("row_total").cast("double") * F.col("col_total") / F.col("n")
    gap = F.col("o") - e
    sums = full.groupBy("pair", "n", "r", "c", "min_row", "min_col", "inv_row", "inv_col").agg(
        F.sum(gap * gap / e).alias("seen"),
        F.sum(e).alias("covered"),
        F.max(F.abs(gap)).alias("gap"),
        F.min_by(F.struct("o", "row_total", "col_total"), F.struct("a", "b")).alias("cell"),
        F.min_by(F.col("b") == F.col("last_b"), F.struct("a", "b")).alias("cell_is_second"),
    )
    n = F.col("n").cast("double")
    chi2 = F.col("seen") + (n - F.col("covered"))
    two = (F.col("r") == 2) & (F.col("c") == 2)
    trimmed = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    corrected = F.when(two, trimmed * trimmed * n * F.col("inv_row") * F.col("inv_col")).otherwise(chi2)
    dim = F.least("r", "c") - 1
    # The four counts of a 2×2 table follow from one cell and the margins.
    o, rt, ct = F.col("cell.o"), F.col("cell.row_total"), F.col("cell.col_total")
    first = F.when(F.col("cell_is_second"), rt - o).otherwise(o)
    col1 = F.when(F.col("cell_is_second"), F.col("n") - ct).otherwise(ct)
    return sums.select(
        "pair", "n", "r", "c", chi2.alias("chi2"), corrected.alias("statistic"),
        (F.col("min_row").cast("double") * F.col("min_col") / n).alias("min_expected"),
        F.coalesce(F.sqrt(F.try_divide(corrected, n * dim)), F.lit(0.0)).alias("cramers_v"),
        F.when(two, first).alias("n11"),
        F.when(two, rt - first).alias("n12"),
        F.when(two, col1 - first).alias("n21"),
        F.when(two, F.col("n") - rt - (col1 - first)).alias("n22"),
    )


def odds_ratio(a: float, b: float, c: float, d: float) -> float:
    if b * c == 0:
        return math.nan if a * d == 0 else math.inf
    return a * d / (b * c)


def _category_test(row: Any) -> Test:
    n, ok = row["n"], row["min_expected"] >= MIN_EXPECTED
    small = not ok and row["r"] == 2 and row["c"] == 2
    if small:
        four = [row[f"n{i}"] for i in (11, 12, 21, 22)]
        method, stat, p = "fisher_exact", odds_ratio(*four), tails.fisher_exact_p(*four)
    else:
        method, stat = "chi_square", row["statistic"]
        p = tails.chi2_sf(stat, (row["r"] - 1) * (row["c"] - 1))
    values = {"statistic": stat, "p_value": p, "effect_size": row["cramers_v"],
              "table_shape": [row["r"], row["c"]]}
    return Test(method, n, values, {"expected_counts_ok": ok}, "cramers_v")


def test_categories(df: DataFrame, a: str, b: str) -> Test:
    row = contingency(category_pairs(df, a, b)).first()
    if row is None or row["r"] < 2 or row["c"] < 2:
        return Test("degenerate", row["n"] if row else 0,
                    {"statistic": 0.0, "p_value": 1.0, "effect_size": 0.0}, {"constant_column": True})
    if row["n"] < MIN_ROWS:
        return Test("declined", row["n"])
    return _category_test(row)


def test_pair(df: DataFrame, a: str, b: str, continuous: Sequence[str]) -> Test:
    """Route by kind: number × number, group × number, category × category."""
    if a in continuous and b in continuous:
        return test_numbers(df, a, b)
    if a in continuous or b in continuous:
        return test_groups(df, *((b, a) if a in continuous else (a, b)))
    return test_categories(df, a, b)


# --- two samples before and after a cut -------------------------------------------------


def two_samples(df: DataFrame) -> DataFrame:
    """From ``(side, v)`` with side 1 or 0: ``n1, n2, u, tie_term, d`` (Mann-Whitney U of side 1, KS D)."""
    counts = df.groupBy("v").agg(
        F.sum("side").alias("c1"), F.sum(1 - F.col("side")).alias("c2")
    )
    run = cumulate(with_range(counts, "v", boundaries(df, ["v"])["v"]), "v", ["c1", "c2"])
    t = (F.col("c1") + F.col("c2")).cast("double")
    below = (F.col("upto_c1") + F.col("upto_c2")) - t
    n1, n2 = F.col("all_c1"), F.col("all_c2")
    centred = below + (t + 1) / 2 - (n1 + n2 + 1) / 2
    row = run.agg(
        F.max("all_c1").alias("n1"),
        F.max("all_c2").alias("n2"),
        F.sum(F.col("c1") * centred).alias("s"),
        F.sum(t * t * t - t).alias("tie_term"),
        F.max(F.abs(F.try_divide(F.col("upto_c1"), n1) - F.try_divide(F.col("upto_c2"), n2))).alias("d"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    u = F.col("s") + n1 * (n1 + n2 + 1) / 2 - n1 * (n1 + 1) / 2
    return row.select("n1", "n2", u.alias("u"), "tie_term", "d")


# --- all pairs --------------------------------------------------------------------------


def partner_ranks(df: DataFrame, columns: Sequence[str], gaps: Sequence[str]) -> DataFrame:
    """``(column, slot, value, ties, avg_rank)``: ranks of each column's values, among all its rows and among fewer.

    Slot 0 counts all rows that have the column; slot j + 1 those that also have ``gaps[j]``. Values are counted once by
    the pattern of what their rows lack, and each pattern adds to the slots it belongs to, so rows are read once.
    """
    cuts = boundaries(df, columns)
    has = F.array_compact(F.array(F.lit(0), *[F.when(F.col(quoted(g)).isNotNull(), j + 1) for j, g in enumerate(gaps)]))
    ranged, parts = df.select(*[F.col(quoted(c)) for c in columns], has.alias("_slots")), []
    for i, c in enumerate(columns):
        ranged = with_range(ranged, c, cuts[c], f"_r{i}")
        parts.append(f"'{c}', {quoted(c)}, _r{i}")
    tall = ranged.select("_slots", F.expr(f"stack({len(columns)}, {', '.join(parts)}) as (column, value, {RANGE})"))
    patterns = tall.where("value is not null").groupBy("column", "value", RANGE, "_slots").agg(F.count(F.lit(1)).alias(COUNT))
    counts = patterns.select("column", "value", RANGE, COUNT, F.explode("_slots").alias("slot")).groupBy(
        "column", "slot", "value", RANGE).agg(F.sum(COUNT).alias(COUNT))
    placed = place(counts, "value", ["column", "slot"])
    return placed.select("column", "slot", "value", "ties", (F.col("less") + (F.col("ties") + 1) / 2.0).alias("avg_rank"))


def ranked_columns(df: DataFrame, columns: Sequence[str], gaps: Sequence[str]) -> tuple[DataFrame, dict[tuple[str, int], float]]:
    """Rows with ``_rank_<i>_<slot>`` (see ``partner_ranks``), written once, and tie terms by column and slot."""
    ranks = settle(partner_ranks(df, columns, gaps))
    t = F.col("ties").cast("double")
    found = ranks.groupBy("column", "slot").agg(F.sum(t * t * t - t).alias("tie_term")).collect()  # a row per pair at most
    each = F.map_from_entries(F.collect_list(F.struct("slot", "avg_rank")))  # one entry per slot
    table = settle(ranks.groupBy("column", "value").agg(each.alias("ranks"), F.max("ties").alias("ties")))
    for i, c in enumerate(columns):
        df = lookup(df, c, table.where(F.col("column") == c), "value", "ties", {"ranks": f"_ranks_{i}"}, settled=True)
    slots = [(i, s) for i, c in enumerate(columns) for s in range(len(gaps) + 1) if s == 0 or gaps[s - 1] != c]
    spread = df.select(
        *[F.col(quoted(c)) for c in df.columns if not c.startswith("_ranks_")],
        *[F.try_element_at(F.col(f"_ranks_{i}"), F.lit(s)).alias(f"_rank_{i}_{s}") for i, s in slots])
    return settle(spread), {(r["column"], r["slot"]): r["tie_term"] for r in found}


def association_matrix(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str]) -> list[dict]:
    """``col_a, col_b, method, effect_size`` of every pair, in column order.

    All columns are handled together, with missing values or without: one moments pass, one table of ranks for each
    column and each partner that lacks values, one grouped pass for all category × number pairs, one contingency pass.
    Pairs with few common rows and the rare pairs that need group medians take the single-pair route.
    """
    order = [c for c in df.columns if c in continuous or c in categorical]
    clean = df.select(*[(numeric(df, c) if c in continuous else present(df, c)).alias(c) for c in order])
    shape = clean.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(quoted(c)).alias(f"n_{i}") for i, c in enumerate(order)],
    ).first()
    nums = [c for c in order if c in continuous]
    cats = [c for c in order if c in categorical]
    gaps = [c for i, c in enumerate(order) if shape[f"n_{i}"] < shape["n"]]
    out: dict[tuple[str, str], tuple[str, float | None]] = {}
    if shape["n"] > SHAPIRO_MAX_N:
        if nums:
            ranked, ties = ranked_columns(clean, nums, gaps)
            out |= _number_matrix(ranked, nums, gaps)
            if cats:
                out |= _group_matrix(ranked, nums, cats, gaps, ties, order)
        if len(cats) > 1:
            out |= _category_matrix(clean, cats, order)
    rows = []
    for a, b in combinations(order, 2):
        if (a, b) not in out:
            try:
                test = test_pair(clean, a, b, continuous)
                out[a, b] = (test.method, test.effect)
            except Exception as exc:
                out[a, b] = (f"skipped: {exc}", None)
        method, effect = out[a, b]
        rows.append({"col_a": a, "col_b": b, "method": method, "effect_size": effect})
    return rows


def _slot(gaps: Sequence[str], partner: str) -> int:
    return gaps.index(partner) + 1 if partner in gaps else 0


def _number_matrix(ranked: DataFrame, nums: list[str], gaps: list[str]) -> dict:
    pairs = list(combinations(nums, 2))
    if not pairs:
        return {}
    # Normality is asked for among the rows of a pair; columns whose partner lacks nothing share their answer.
    asked = sorted({(c, p if p in gaps else c) for a, b in pairs for c, p in ((a, b), (b, a))})
    stats = []
    for i, (c, p) in enumerate(asked):
        x = F.when(F.col(quoted(p)).isNotNull(), F.col(quoted(c)))
        stats.append(F.struct(F.count(x), F.max(x) > F.min(x), F.skewness(x), F.kurtosis(x)).alias(f"m{i}"))
    row = ranked.agg(*stats).first()
    moments = [(i, *row[f"m{i}"]) for i in range(len(asked))]
    flags = ranked.sparkSession.createDataFrame(moments, "i int, n long, varies boolean, skew double, kurt double").select(
        "i", "n", F.when(F.col("varies") & (F.col("n") > SHAPIRO_MAX_N),
                         normal_by_moments(F.col("n"), F.col("skew"), F.col("kurt"))).otherwise(False).alias("normal"))
    known = {asked[r["i"]]: (r["n"], bool(r["normal"])) for r in flags.collect()}
    chosen = []
    for a, b in pairs:
        (n, a_normal), (_, b_normal) = (known[c, p if p in gaps else c] for c, p in ((a, b), (b, a)))
        n = min(n, known[b, a if a in gaps else b][0])
        if n > SHAPIRO_MAX_N:
            chosen.append((a, b, "pearson" if a_normal and b_normal else "spearman"))
    if not chosen:
        return {}

    def rank(c: str, partner: str) -> str:
        return f"_rank_{nums.index(c)}_{_slot(gaps, partner)}"

    row = ranked.agg(*[
        correlation(quoted(a), quoted(b)).alias(f"p{i}") if method == "pearson"
        else correlation(rank(a, b), rank(b, a)).alias(f"p{i}")
        for i, (a, b, method) in enumerate(chosen)
    ]).first()
    out = {}
    for i, (a, b, method) in enumerate(chosen):
        r = row[f"p{i}"]
        out[a, b] = ("degenerate", 0.0) if r is None or math.isnan(r) else (method, min(1.0, abs(r)))
    return out


def _pair(order: list[str], a: str, b: str) -> tuple[str, str]:
    return (a, b) if order.index(a) < order.index(b) else (b, a)


def _group_matrix(
    ranked: DataFrame, nums: list[str], cats: list[str], gaps: list[str], ties: dict[tuple[str, int], float], order: list[str],
) -> dict:
    # A number's ranks among the rows that have the category travel with that category's row.
    wide = ", ".join(
        f"'{c}', cast({quoted(c)} as string), " + ", ".join(f"_rank_{i}_{_slot(gaps, c)}" for i in range(len(nums)))
        for c in cats
    )
    keep = [F.col(quoted(c)).alias(f"v{i}") for i, c in enumerate(nums)]
    tall = ranked.select(
        F.expr(f"stack({len(cats)}, {wide}) as (cat, g, {', '.join(f'r{i}' for i in range(len(nums)))})"), *keep
    ).where("g is not null")
    aggs = []
    for i in range(len(nums)):
        aggs += [
            F.count(f"v{i}").alias(f"n{i}"),
            F.avg(f"v{i}").alias(f"mean{i}"), F.var_samp(f"v{i}").alias(f"var{i}"),
            F.skewness(f"v{i}").alias(f"skew{i}"), F.kurtosis(f"v{i}").alias(f"kurt{i}"),
            F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}"), F.sum(f"r{i}").alias(f"rs{i}"),
        ]
    fields = ("n", "mean", "var", "skew", "kurt", "lo", "hi", "rs")
    stacked = ", ".join(f"{i}, " + ", ".join(f"{f}{i}" for f in fields) for i in range(len(nums)))
    groups = tall.groupBy("cat", "g").agg(*aggs).select(
        "cat", "g", F.expr(f"stack({len(nums)}, {stacked}) as (num, {', '.join(fields)})")
    ).where("n > 0")
    per = Window.partitionBy("cat", "num")
    total = F.sum("n").over(per)
    centred = F.col("rs") - F.col("n") * (total + 1) / 2
    grand = F.sum(F.col("n") * F.col("mean")).over(per) / total
    scored = groups.select(
        "cat", "num", "n", "lo", "hi", total.alias("total"),
        (centred * centred / F.col("n")).alias("h_part"),
        (F.col("n") * (F.col("mean") - grand) * (F.col("mean") - grand)).alias("ssb"),
        F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("var")).otherwise(0.0).alias("ssw"),
        F.when(F.col("hi") == F.col("lo"), False)
        .when(F.col("n") > SHAPIRO_MAX_N, normal_by_moments(F.col("n"), F.col("skew"), F.col("kurt")))
        .alias("normal"),
    )
    rows = scored.groupBy("cat", "num").agg(
        F.count(F.lit(1)).alias("k"), F.max("total").alias("n"), F.min("n").alias("smallest"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("h_part").alias("h_part"),
        F.sum("ssb").alias("ssb"), F.sum("ssw").alias("ssw"),
        F.every(F.coalesce("normal", F.lit(True))).alias("maybe_normal"),
        F.count_if(F.col("normal").isNull()).alias("untested"),
    ).collect()
    out = {}
    for r in rows:
        num, k, n = nums[r["num"]], r["k"], float(r["n"])
        pair = _pair(order, r["cat"], num)
        if n <= SHAPIRO_MAX_N:
            continue  # small samples: the single-pair route decides
        if k < 2:
            out[pair] = ("skipped: fewer than 2 groups", None)
        elif r["lo"] == r["hi"]:
            out[pair] = ("degenerate", 0.0)
        elif r["maybe_normal"] and r["smallest"] >= MIN_GROUP and (k > 2 or r["untested"]):
            continue  # needs Levene or Shapiro: the single-pair route decides
        elif r["maybe_normal"] and r["smallest"] >= MIN_GROUP:
            out[pair] = ("welch_t_test", r["ssb"] / (r["ssb"] + r["ssw"]))
        else:
            h = 12 * r["h_part"] / (n * (n + 1)) / (1 - ties[num, _slot(gaps, r["cat"])] / (n**3 - n))
            out[pair] = ("mann_whitney" if k == 2 else "kruskal_wallis", min(1.0, max(0.0, h / (n - 1))))
    return out


def _category_matrix(clean: DataFrame, cats: list[str], order: list[str]) -> dict:
    pairs = list(combinations(cats, 2))
    spec = ", ".join(
        f"{i}, cast({quoted(a)} as string), cast({quoted(b)} as string)" for i, (a, b) in enumerate(pairs)
    )
    tall = clean.selectExpr(f"stack({len(pairs)}, {spec}) as (pair, a, b)").where("a is not null and b is not null")
    out = {}
    for row in contingency(tall).collect():
        pair = _pair(order, *pairs[row["pair"]])
        if row["n"] <= SHAPIRO_MAX_N:
            continue
        if row["r"] < 2 or row["c"] < 2:
            out[pair] = ("degenerate", 0.0)
        else:
            test = _category_test(row)
            out[pair] = (test.method, test.effect)
    return out
