import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import Session
from plumbline.functions import tails
from plumbline.operators import associate as assoc


def test_tails_against_published_values():
    assert tails.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.f_sf(3.4928, 2, 20) == pytest.approx(0.05, abs=1e-5)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-7)
    assert tails.kolmogorov_sf(1.3581) == pytest.approx(0.05, abs=1e-4)
    assert tails.ks_two_sample_p(0.6, 10, 10) == pytest.approx(0.05244755, abs=1e-7)
    assert tails.fisher_exact_p(8, 2, 1, 5) == pytest.approx(0.0349650, abs=1e-6)
    # Shapiro & Wilk's weights of eleven men: W = 0.79, p = 0.0067.
    men = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0])
    assert tails.shapiro_p(men) == pytest.approx(0.0067, abs=1e-4)


def test_mann_whitney_exact_by_enumeration():
    x, y = [1.0, 4.0, 9.0], [2.0, 3.0, 5.0, 8.0]
    pool = sorted(x + y)

    def u(sample):
        return sum(pool.index(v) + 1 for v in sample) - len(sample) * (len(sample) + 1) / 2

    mean = len(x) * len(y) / 2
    seen = abs(u(x) - mean)
    every = [abs(u(c) - mean) for c in itertools.combinations(pool, len(x))]
    want = sum(d >= seen - 1e-9 for d in every) / len(every)
    assert tails.mann_whitney_p(u(x), 3, 4, 0) == pytest.approx(want)


def _table(spark, frame):
    session = Session(spark)
    table = session.add_table(spark.createDataFrame(frame), "t")
    table.classify_as_nominal()
    return table


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(3)
    n = 900
    g = rng.choice(["a", "b", "c"], n)
    frame = pd.DataFrame({
        "x": rng.normal(size=n), "g": g, "h": rng.choice(["p", "q"], n, p=[0.3, 0.7]),
        "skewed": rng.exponential(size=n) + (g == "c"),
    })
    frame["y"] = 0.6 * frame["x"] + rng.normal(size=n)
    return frame


def test_pearson_route(spark, mixed):
    got = _table(spark, mixed[["x", "y"]]).analyze_association("x", "y")
    assert got.method == "pearson"
    assert got.values["statistic"] == pytest.approx(np.corrcoef(mixed["x"], mixed["y"])[0, 1])
    assert got.values["p_value"] < 1e-20 and got.trust.level.value == "high"


def test_spearman_route_with_nulls(spark, mixed):
    frame = mixed[["x", "skewed"]].copy()
    frame.loc[::7, "skewed"] = None
    got = _table(spark, frame).analyze_association("x", "skewed")
    assert got.method == "spearman"
    assert got.values["statistic"] == pytest.approx(frame.dropna().corr("spearman").iloc[0, 1])


def _kruskal(values, groups):
    ranks = pd.Series(values).rank().to_numpy()
    n = len(values)
    h = 12 / (n * (n + 1)) * sum(ranks[groups == g].sum() ** 2 / (groups == g).sum() for g in np.unique(groups)) - 3 * (n + 1)
    _, t = np.unique(values, return_counts=True)
    return h / (1 - (t**3 - t).sum() / (n**3 - n))


def test_kruskal_route(spark, mixed):
    got = _table(spark, mixed[["g", "skewed"]]).analyze_association("skewed", "g")
    h = _kruskal(mixed["skewed"].to_numpy(), mixed["g"].to_numpy())
    assert got.method == "kruskal_wallis"
    assert got.values["statistic"] == pytest.approx(h)
    assert got.values["effect_size"] == pytest.approx(h / (len(mixed) - 1))


def test_welch_and_anova_routes(spark, mixed):
    welch = _table(spark, mixed[["h", "x"]]).analyze_association("h", "x")
    a, b = mixed.loc[mixed.h == "p", "x"], mixed.loc[mixed.h == "q", "x"]
    t = (a.mean() - b.mean()) / math.sqrt(a.var() / len(a) + b.var() / len(b))
    assert welch.method == "welch_t_test" and welch.values["statistic"] == pytest.approx(t)
    anova = _table(spark, mixed[["g", "x"]]).analyze_association("g", "x")
    assert anova.method == "anova"
    groups = [p["x"].to_numpy() for _, p in mixed.groupby("g")]
    grand = mixed["x"].mean()
    ssb = sum(len(v) * (v.mean() - grand) ** 2 for v in groups)
    ssw = sum(((v - v.mean()) ** 2).sum() for v in groups)
    assert anova.values["statistic"] == pytest.approx((ssb / 2) / (ssw / (len(mixed) - 3)))
    assert anova.values["effect_size"] == pytest.approx(ssb / (ssb + ssw))


def test_small_groups_are_checked_with_shapiro(spark):
    rng = np.random.default_rng(11)
    frame = pd.DataFrame({"g": np.repeat(["a", "b", "c"], 25), "v": np.concatenate([rng.normal(m, 1, 25) for m in (0, 0, 2)])})
    got = _table(spark, frame).analyze_association("g", "v")
    flags = [tails.shapiro_p(p["v"].to_numpy()) > 0.05 for _, p in frame.groupby("g")]
    assert got.metadata["assumption_checks"]["all_groups_normal"] == all(flags)
    assert got.method == ("anova" if all(flags) and got.metadata["assumption_checks"]["equal_variance"] else "kruskal_wallis")


def test_fisher_when_expected_counts_are_small(spark):
    frame = pd.DataFrame({"a": ["x"] * 10 + ["y"] * 6, "b": ["m"] * 8 + ["n"] * 2 + ["m"] + ["n"] * 5})
    got = _table(spark, frame).analyze_association("a", "b")
    assert got.method == "fisher_exact"
    assert got.values["statistic"] == pytest.approx(20.0)
    assert got.values["p_value"] == pytest.approx(0.0349650, abs=1e-6)


@pytest.mark.parametrize("cells", [(30, 10, 15, 45), (0, 10, 15, 45), (30, 0, 15, 45), (30, 10, 0, 45), (30, 10, 15, 0)])
def test_two_by_two_cells_and_yates(spark, cells):
    rows = [(a, b) for (a, b), n in zip(itertools.product("xy", "mn"), cells) for _ in range(n)]
    row = assoc.contingency(assoc.category_pairs(spark.createDataFrame(rows, "a string, b string"), "a", "b")).first()
    assert tuple(row[f"n{i}"] for i in (11, 12, 21, 22)) == cells
    o = np.array(cells, float).reshape(2, 2)
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    gap = np.abs(o - e)
    assert row["statistic"] == pytest.approx((((gap - np.minimum(0.5, gap)) ** 2) / e).sum())
    assert row["chi2"] == pytest.approx(((o - e) ** 2 / e).sum())
    assert row["min_expected"] == pytest.approx(e.min())


def test_degenerate_and_declined(spark):
    flat = pd.DataFrame({"g": ["a", "b"] * 4, "v": [1.0] * 8})
    table = _table(spark, flat)
    table._types["v"] = "continuous"
    got = table.analyze_association("g", "v")
    assert got.method == "degenerate" and got.trust.level.value == "high"
    for n, declined in ((9, True), (10, False)):
        frame = pd.DataFrame({"x": np.arange(n) ** 1.5, "y": np.arange(n)[::-1] * 1.0})
        few = _table(spark, frame)
        few._types = {"x": "continuous", "y": "continuous"}
        assert few.analyze_association("x", "y").declined is declined
    lone = _table(spark, pd.DataFrame({"g": ["a"] * 30, "v": np.arange(30.0)}))
    assert lone.analyze_association("g", "v").declined
    with pytest.raises(ValueError):
        lone.analyze_association("g", "g")


def test_matrix_equals_pair_by_pair(spark, mixed):
    frame = mixed.copy()
    frame["gappy"] = frame["skewed"].where(np.arange(len(frame)) % 5 > 0)
    df = spark.createDataFrame(frame)
    numbers, coded = ["x", "y", "skewed", "gappy"], ["g", "h"]
    for row in assoc.association_matrix(df, numbers, coded):
        test = assoc.test_pair(df, row["col_a"], row["col_b"], numbers)
        assert row["method"] == test.method, row
        assert row["effect_size"] == pytest.approx(test.effect), row


def test_matrix_with_gaps_everywhere(spark, mixed, monkeypatch):
    """Every column lacks values in rows of its own; none of the large pairs goes one by one."""
    rng = np.random.default_rng(8)
    frame = mixed.copy()
    for c in list(frame.columns):
        gone = rng.random(len(frame)) < 0.15
        frame[c] = frame[c].where(~gone) if frame[c].dtype != object else frame[c].where(~gone, None)
    frame["rare"] = frame["x"].where(np.arange(len(frame)) < 30)  # too few rows for the joint route
    numbers, coded = ["x", "y", "skewed", "rare"], ["g", "h"]
    df = spark.createDataFrame(frame[numbers + coded])
    expected = {(a, b): assoc.test_pair(df, a, b, numbers) for a, b in itertools.combinations(numbers + coded, 2)}
    single, one = [], assoc.test_pair
    monkeypatch.setattr(assoc, "test_pair", lambda d, a, b, c: single.append((a, b)) or one(d, a, b, c))
    for row in assoc.association_matrix(df, numbers, coded):
        test = expected[row["col_a"], row["col_b"]]
        assert row["method"] == test.method, row
        assert row["effect_size"] == pytest.approx(test.effect), row
    joint = {("x", "y"), ("x", "skewed"), ("y", "skewed"), ("g", "h"), ("skewed", "g"), ("skewed", "h")}
    assert not joint & set(single) and any("rare" in pair for pair in single)


def test_two_samples_by_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 30, 200) * 1.0, rng.integers(5, 40, 300) * 1.0
    df = spark.createDataFrame([(1, float(v)) for v in a] + [(0, float(v)) for v in b], "side int, v double")
    row = assoc.two_samples(df).first()
    u = sum((x > b).sum() + 0.5 * (x == b).sum() for x in a)
    d = max(abs((a <= v).mean() - (b <= v).mean()) for v in np.union1d(a, b))
    assert row["u"] == pytest.approx(u) and row["d"] == pytest.approx(d)


def test_levene_uses_groups_of_two_or_more(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 6.0), ("b", 2.0), ("b", 9.0), ("c", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    row = assoc.levene(df.select("g", F.col("v"))).first()
    z = {"a": np.abs(np.array([1, 2, 6.0]) - 2), "b": np.abs(np.array([2, 9.0]) - 5.5)}
    grand = np.concatenate(list(z.values())).mean()
    ssb = sum(len(v) * (v.mean() - grand) ** 2 for v in z.values())
    ssw = sum(((v - v.mean()) ** 2).sum() for v in z.values())
    assert row["k"] == 2 and row["w"] == pytest.approx((ssb / 1) / (ssw / 3))
