"""Hand-made fixtures for nulls, NaN, ties, junk text and decline limits."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import Session, TrustLevel
from plumbline.functions.clean import present
from plumbline.operators import basket, causal, cluster, customers, describe, features, learn, prep, relate, typing
from plumbline.results import Trust, combine, decline, from_sample_size, json_safe, operation_key

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [("a", 1.0), ("a", NAN), ("b", INF), ("b", 4.0), (None, 9.0), ("c", None), ("d", 2.0)]
    return spark.createDataFrame(rows, "k string, x double")


def _values(df, column):
    return [r[column] for r in df.select(column).collect()]


def test_nan_and_infinity_are_missing(dirty):
    assert _values(dirty.select(present(dirty, "x").alias("x")), "x") == [1.0, None, None, 4.0, 9.0, None, 2.0]
    row = {r["column"]: r for r in describe.missing_counts(dirty).collect()}["x"]
    assert (row["n_missing"], row["n_rows"]) == (3, 7)


def test_group_aggregates_with_missing_groups_and_values(dirty):
    got = {agg: _values(features.group_aggregate(dirty.withColumn("i", F.monotonically_increasing_id()), "k", "x", agg)
                        .orderBy("i"), f"x_{agg}_by_k") for agg in features.AGGREGATES}
    assert got["sum"] == [1.0, 1.0, 4.0, 4.0, None, 0.0, 2.0]
    assert got["mean"] == [1.0, 1.0, 4.0, 4.0, None, None, 2.0]
    assert got["std"] == [None] * 7
    assert got["median"] == [1.0, 1.0, 4.0, 4.0, None, None, 2.0]


def test_row_aggregates_skip_missing(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (2.0, 5.0, NAN)], "a double, b double, c double")
    got = {agg: _values(features.row_aggregate(df, ["a", "b", "c"], agg, "out"), "out") for agg in features.AGGREGATES}
    assert got["sum"] == [4.0, 0.0, 7.0]
    assert got["mean"] == [2.0, None, 3.5]
    assert got["count"] == [2.0, 0.0, 2.0]
    assert got["median"] == [2.0, None, 3.5]
    assert got["std"][0] == pytest.approx(math.sqrt(2)) and got["std"][1] is None
    assert (got["min"], got["max"]) == ([1.0, None, 2.0], [3.0, None, 5.0])


def test_fractions_sum_to_one_or_are_missing(spark):
    df = spark.createDataFrame([(1.0, 3.0), (0.0, 0.0), (None, 2.0)], "a double, b double")
    out = features.normalize_fractions(df, ["a", "b"])
    assert _values(out, "a_frac") == [0.25, None, None]
    assert _values(out, "b_frac") == [0.75, None, 1.0]


def test_transforms_outside_their_domain(spark):
    df = spark.createDataFrame([("4",), ("-1",), ("0",), ("junk",), (None,)], "x string")
    got = {f: _values(features.transform_column(df, "x", f, "out"), "out") for f in features.UNARY_FUNCS}
    assert got["sqrt"] == [2.0, None, 0.0, None, None]
    assert got["log"][1:] == [None, None, None, None]
    assert got["reciprocal"] == [0.25, -1.0, None, None, None]
    assert got["log1p"][1] is None and got["square"][:3] == [16.0, 1.0, 0.0]
    x = np.array([4.0, -1.0, 0.0])
    assert np.allclose(got["zscore"][:3], (x - x.mean()) / x.std())
    with pytest.raises(ValueError):
        features.transform_column(df, "x", "cube")
    with pytest.raises(ValueError):
        features.need_numbers(df.where("x = 'junk'"), "x")


def test_division_by_zero_is_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (6.0, 3.0)], "a double, b double")
    assert _values(features.combine_columns(df, "a", "b", "divide"), "a_divide_b") == [None, 2.0]


@pytest.mark.parametrize("bins,strategy", [(2, "quantile"), (4, "quantile"), (7, "quantile"), (3, "uniform"), (5, "uniform")])
def test_bins_match_pandas(spark, bins, strategy):
    rng = random.Random(bins)
    x = [float(rng.choice([0, 1, 1, 2, 5, 8, 13, 21])) for _ in range(60)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    got = _values(features.bin_column(df, "x", bins, strategy).orderBy("i"), "x_bin")
    series = pd.Series(x)
    cut = pd.qcut(series, bins, labels=False, duplicates="drop") if strategy == "quantile" else pd.cut(series, bins, labels=False)
    assert got == [None if pd.isna(v) else int(v) for v in cut]


def test_bins_of_a_constant(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "x double")
    assert _values(features.bin_column(df, "x", 4, "quantile"), "x_bin") == [None] * 4
    assert _values(features.bin_column(df, "x", 4, "uniform"), "x_bin") == [1] * 4


def test_calendar_parts_of_junk_dates(spark):
    df = spark.createDataFrame([("2024-02-29 13:45:00",), ("junk",), (None,)], "t string")
    row = features.expand_datetime(df, "t", features.DATE_PARTS).collect()
    assert [row[0][f"t_{p}"] for p in features.DATE_PARTS] == [2024, 1, 2, 9, 29, 3, 60, 13, False, False, True]
    assert row[1]["t_year"] is None and row[1]["t_is_weekend"] is False


@pytest.mark.parametrize("bad", ["", "a; b", "(SELECT 1)", "no_such + 1", "read_csv('x')", "reflect('a', 'b')", "sum(a)"])
def test_bad_expressions_are_refused(spark, bad):
    with pytest.raises(ValueError):
        features.compute_feature(spark.createDataFrame([(1,)], "a int"), "f", bad)


def test_outliers_by_hand(spark):
    x = [1.0] * 10 + [2.0] * 10 + [3.0] * 10 + [100.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    out = describe.flag_outliers(df, "x").orderBy("i").collect()
    assert [r["x_outlier_method"] for r in out][-2:] == ["both", None]
    assert sum(r["x_is_outlier"] for r in out) == 1
    flat = describe.flag_outliers(spark.createDataFrame([(3.0,)] * 5, "x double"), "x")
    assert not any(_values(flat, "x_is_outlier"))


def test_profile_numbers(spark):
    x = [1.0, 2.0, 2.0, 9.0, None]
    table = Session(spark).add_table(spark.createDataFrame([(v, "t") for v in x], "x double, w string"), "t")
    table._types["x"] = "continuous"
    got = table.profile().values
    s = pd.Series(x).dropna()
    skew = ((s - s.mean()) ** 3).mean() / ((s - s.mean()) ** 2).mean() ** 1.5
    assert got["x"] == {"type": "continuous", "n_missing": 1, "missing_rate": 0.2, "n_unique": 3, "min": 1.0, "max": 9.0,
                        "mean": 3.5, "median": 2.0, "std": pytest.approx(s.std()), "skew": pytest.approx(skew)}
    assert got["w"]["top_values"] == {"t": 5}


def test_types_at_their_limits(spark):
    df = spark.createDataFrame(
        [(i, i % 15, float(i % 12), float(i) if i < 11 else 1.0, i % 2 == 0, str(i), "x", dt.date(2020, 1, 1)) for i in range(20)],
        "many int, few int, steps double, mostly double, flag boolean, id string, word string, day date")
    assert typing.detect_types(df) == {"many": "continuous", "few": "categorical", "steps": "continuous", "mostly": "continuous",
                   "flag": "categorical", "id": "identifier", "word": "categorical", "day": "datetime"}


def _rfm_by_hand(frame):
    snap = frame["d"].max() + pd.Timedelta(days=1)
    agg = frame.groupby("c").agg(r=("d", lambda s: (snap - s.max()).days), f=("d", "count"), m=("v", "sum"))

    def score(s, back=False):
        return pd.qcut(s.rank(method="first"), 5, labels=[5, 4, 3, 2, 1] if back else [1, 2, 3, 4, 5]).astype(int)

    out = pd.DataFrame({"r": score(agg["r"], True), "f": score(agg["f"]), "m": score(agg["m"])})
    out["fm"] = ((out["f"] + out["m"]) / 2).round().astype(int)
    return out


@pytest.mark.parametrize("n", [5, 7, 23])
def test_rfm_matches_quantile_bins(spark, n):
    rng = random.Random(n)
    rows = [(c, dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 9)), float(rng.randint(1, 50)))
            for c in range(n) for _ in range(rng.randint(1, 4))]
    frame = pd.DataFrame(rows, columns=["c", "d", "v"])
    got = customers.rfm(spark.createDataFrame(rows, "c long, d timestamp_ntz, v double"), "c", "d", "v").toPandas()
    want = _rfm_by_hand(frame)
    assert got.set_index("customer").sort_index()[["r", "f", "m", "fm"]].to_numpy().tolist() == want.to_numpy().tolist()


def test_rfm_declines_four_customers(spark):
    rows = [(c, dt.datetime(2024, 1, c + 1), 1.0) for c in range(4)]
    table = Session(spark).add_table(spark.createDataFrame(rows, "c long, d timestamp_ntz, v double"), "t")
    assert table.rfm("c", "d", "v").declined


def test_retention(spark):
    rows = [("a", "2024-01-05"), ("a", "2024-02-01"), ("a", "2024-02-20"), ("b", "2024-01-31"), ("c", "2024-02-03"),
            ("c", "2024-04-01"), (None, "2024-01-01"), ("d", "junk")]
    table = Session(spark).add_table(spark.createDataFrame(rows, "c string, d string"), "t")
    got = table.retention_cohorts("c", "d")
    assert got.values["cohorts"] == {"2024-01": {0: 2, 1: 1}, "2024-02": {0: 1, 2: 1}}
    assert got.values["retention_rates"]["2024-01"] == {0: 1.0, 1: 0.5}
    once = Session(spark).add_table(spark.createDataFrame(rows[3:5], "c string, d string"), "once")
    assert once.retention_cohorts("c", "d").declined


def test_basket_rules_with_several_consequents(spark):
    carts = ["abc", "abc", "abd", "acd", "bcd", "ab", "e", "abce"]
    rows = [(i, item) for i, cart in enumerate(carts) for item in cart + cart[0]]
    pairs = basket.item_rows(spark.createDataFrame(rows, "t long, i string"), "t", "i")
    n = basket.count_transactions(pairs)
    sets = basket.itemsets(pairs, n, 0.25)

    def support(items):
        return sum(set(items) <= set(c) for c in carts) / len(carts)

    want = {c for k in range(1, 5) for c in itertools.combinations("abcde", k) if support(c) >= 0.25}
    assert {tuple(r["items"]) for r in sets.collect()} == want
    got = {(tuple(r["antecedents"]), tuple(r["consequents"])): (r["support"], r["confidence"], r["lift"])
           for r in basket.rules(sets, 0.5).collect()}
    expected = {}
    for s in want:
        for k in range(1, len(s)):
            for a in itertools.combinations(s, k):
                c = tuple(x for x in s if x not in a)
                if support(s) / support(a) >= 0.5:
                    expected[a, c] = (support(s), support(s) / support(a), support(s) / support(a) / support(c))
    assert got.keys() == expected.keys() and any(len(c) == 2 for _, c in got)
    for k in got:
        assert got[k] == pytest.approx(expected[k])
    table = Session(spark).add_table(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "t long, i string"), "t")
    assert table.market_basket("t", "i", min_support=0.5).declined


@pytest.mark.parametrize("n,declined,level", [(49, True, "none"), (50, False, "low"), (600, False, "moderate")])
def test_causal_limits(spark, n, declined, level):
    rng = np.random.default_rng(0)
    c = rng.normal(size=n)
    g = rng.choice(["u", "v", "w"], n)
    t = c + rng.normal(size=n)
    y = 2 * t + 3 * c + 5 * (g == "v") + rng.normal(0, 0.1, n)
    frame = pd.DataFrame({"t": t, "y": y, "c": c, "g": g})
    got = Session(spark).add_table(spark.createDataFrame(frame), "t").causal_effect("t", "y", ["c", "g"])
    assert got.declined is declined and got.trust.level.value == level
    if not declined:
        assert got.values["effect"] == pytest.approx(2.0, abs=0.1)
        x = np.c_[t, c, g == "v", g == "w", np.ones(n)].astype(float)
        assert got.values["effect"] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0][0], rel=1e-6)


def test_causal_declines_a_constant_treatment(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(80)], "t double, y double")
    assert Session(spark).add_table(df, "t").causal_effect("t", "y", []).declined


@pytest.mark.parametrize("here", [True, False])
def test_crossed_categories_are_absorbed(spark, monkeypatch, here):
    """As the regression with a 0/1 column for each level of both categories, in memory and by joins."""
    monkeypatch.setattr(causal, "CELLS", 10**9 if here else 0)
    rng = np.random.default_rng(6)
    n = 700
    g, h = rng.integers(0, 12, n), rng.integers(0, 7, n)
    c = rng.normal(size=n)
    t = 0.3 * g - 0.2 * h + c + rng.normal(size=n)
    y = 1.5 * t + g * 0.7 - h + 2 * c + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "y": y, "c": c, "g": g.astype(str), "h": h.astype(str)}))
    x = np.column_stack([t, c, np.eye(12)[g], np.eye(7)[h]])
    expected = np.linalg.lstsq(x, y, rcond=None)[0][0]
    rows = causal.complete_rows(df, "t", "y", ["c"], ["g", "h"])
    cov = causal.absorbed(rows, ["_t", "_n0", "_y"], ["_c0", "_c1"])
    assert causal._coefficient(cov, [0, 1], 2) == pytest.approx(expected, abs=1e-8)
    explained = df.withColumn("t", F.col("g").cast("double"))
    cov = causal.absorbed(causal.complete_rows(explained, "t", "y", ["c"], ["g"]), ["_t", "_n0", "_y"], ["_c0"])
    assert cov[0, 0] == 0.0 and causal._coefficient(cov, [0, 1], 2) == 0.0


def test_a_hundred_thousand_levels(spark):
    """Each level has an effect of its own, which would hide the treatment's."""
    rows = spark.range(200_000).select(
        (F.col("id") % 100_000).cast("string").alias("level"), ((F.col("id") * 7919 % 1009) / 500.0).alias("t"), "id")
    df = rows.select("level", "t", (3 * F.col("t") + F.col("level").cast("double") % 97 + (F.col("id") * 31 % 11) / 100.0).alias("y"))
    found = causal.causal_effect(df, "t", "y", [], ["level"])
    assert found.n == 200_000 and found.effect == pytest.approx(3.0, abs=0.02) and found.passed


def test_preparation_unseen_and_missing(spark):
    df = spark.createDataFrame(
        [(1.0, "lo", "r"), (3.0, "hi", "r"), (None, None, None), (5.0, "mid", "g")], "x double, o string, n string")
    roles = prep.Roles(("x",), ("n",), ("o",))
    plan = prep.learn(df, roles, scale=False)
    got = [r[prep.FEATURES].toArray().tolist() for r in prep.assemble(prep.encode(df, plan), plan).select(prep.FEATURES).collect()]
    assert got == [[1.0, 1.0, 0.0, 1.0], [3.0, 0.0, 0.0, 1.0], [3.0, 0.0, 0.0, 1.0], [5.0, 2.0, 1.0, 0.0]]
    new = spark.createDataFrame([(2.0, "never", "never")], df.schema)
    assert prep.assemble(prep.encode(new, plan), plan).first()[prep.FEATURES].toArray().tolist() == [2.0, -1.0, 0.0, 0.0]


def test_unrefined_columns_stop_modelling():
    with pytest.raises(ValueError):
        prep.feature_roles({"a": "categorical", "b": "continuous"})
    assert prep.feature_roles({"a": "identifier", "b": "continuous", "c": "datetime"}).names == ("b",)


def test_kmeans_finds_blobs_and_profiles(spark):
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(m, 0.2, (60, 2)) for m in ((0, 0), (5, 5), (0, 5))])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["x", "y"]).assign(w=np.repeat(["p", "q", "r"], 60)))
    table = Session(spark).add_table(df, "t")
    table.set_column_type("w", "categorical_nominal")
    got = table.cluster()
    assert got.values["n_clusters"] == 3 and got.values["silhouette"] > 0.8
    assert sorted(got.values["cluster_sizes"].values()) == [60, 60, 60]
    shown = table.profile_clusters().values["clusters"]
    assert {e["dominant_categories"]["w"] for e in shown.values()} == {"p", "q", "r"}
    with pytest.raises(ValueError):
        cluster.kmeans(df.limit(3), prep.Roles(("x", "y")), k=5)
    one = Session(spark).add_table(df.limit(1).select("x", "y"), "one")
    one._types = {"x": "continuous", "y": "continuous"}
    assert one.cluster().declined


def test_components_match_eigenvectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))
    out, ratios, loadings = cluster.principal_components(df, prep.Roles(("a", "b", "c")), 2)
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    order = np.argsort(values)[::-1][:2]
    assert np.allclose(ratios, values[order] / values.sum())
    assert np.allclose(np.abs(loadings), np.abs(vectors[:, order]))
    assert np.allclose(np.abs(out.select("pca_0").toPandas().to_numpy()[:, 0]), np.abs(z @ vectors[:, order[0]]))


def test_importance_finds_the_signal_and_noise_has_no_skill(spark):
    rng = np.random.default_rng(2)
    x1, x2 = rng.normal(size=400), rng.normal(size=400)
    table = Session(spark).add_table(spark.createDataFrame(pd.DataFrame({"x1": x1, "x2": x2, "y": (x1 > 0).astype(int)})), "sig")
    table.set_column_type("y", "categorical_nominal")
    table.train_classifier("y", rounds=5)
    found = table.feature_importance("y").values["importances"]
    assert found["x1"] > 0.3 and abs(found["x2"]) < 0.05
    again = table.feature_importance("y").values["importances"]
    assert found == again
    noise = pd.DataFrame({"x": rng.normal(size=400), "y": (rng.random(400) < 0.8).astype(int)})
    dull = Session(spark).add_table(spark.createDataFrame(noise), "noise")
    dull.set_column_type("y", "categorical_nominal")
    dull.train_classifier("y", rounds=5)
    assert dull.evaluate("y").trust.level is TrustLevel.LOW


def test_contributions_add_up_for_every_row(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"i": range(200), "a": rng.normal(size=200), "b": rng.normal(size=200), "c": rng.choice(["u", "v"], 200)})
    frame["y"] = 3 * frame["a"] + (frame["c"] == "u") + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame(frame)
    roles = prep.Roles(("a", "b"), ("c",))
    model = learn.train(df, "y", "regression", roles, ["i"], rounds=5)
    from plumbline.operators.interpret import shapley
    got = shapley(model, df.where("i < 20"), "i").toPandas()
    scored = model.score(df.where("i < 20")).select("i", "_prediction").toPandas().set_index("i")["_prediction"]
    per = got.groupby("i").agg(total=("contribution", "sum"), base=("base_value", "first"), pred=("prediction", "first"))
    assert len(per) == 20
    assert np.allclose(per["total"], per["pred"] - per["base"])
    assert np.allclose(per["pred"], scored.reindex(per.index))


def test_metric_tree(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"x": rng.normal(size=500), "g": rng.choice(["a", "b", "c"], 500), "i": range(500)})
    frame["y"] = 10.0 * (frame["g"] == "c") + (frame["x"] > 1) + rng.normal(0, 0.1, 500)
    table = Session(spark).add_table(spark.createDataFrame(frame.drop(columns="i")), "t")
    table.classify_as_nominal()
    got = table.explain_metric("y")
    assert next(iter(got.values["drivers"])) == "g" and got.values["explained"] > 0.9
    assert got.values["explained_held_out"] > 0.9
    parts = got.frame.collect()
    assert sum(r["n"] for r in parts) == 500 and min(r["n"] for r in parts) >= 25
    assert any("g in ['c']" in r["rule"] for r in parts)


def test_training_declines(spark):
    base = [(i, float(i)) for i in range(40)]
    df = spark.createDataFrame([(i, v, "x", "rare" if i == 0 else "common") for i, v in base], "i int, v double, one string, rare string")
    roles = prep.Roles(("v",))
    assert "single class" in learn.train(df, "one", "classification", roles)[0]
    assert "once" in learn.train(df, "rare", "classification", roles)[0]
    assert "30" in learn.train(df.limit(29), "v", "regression", prep.Roles(("i",)))[0]
    with pytest.raises(ValueError):
        learn.train(df, "one", "regression", roles)


def test_auc_and_metrics_by_hand(spark):
    rows = [(0, True, 0.9), (0, False, 0.9), (0, True, 0.2), (0, False, 0.1), (0, False, 0.2)]
    auc = learn.class_auc(spark.createDataFrame(rows, "class int, positive boolean, score double")).first()["auc"]
    pos, neg = [0.9, 0.2], [0.9, 0.1, 0.2]
    assert auc == pytest.approx(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / 6)
    cells = spark.createDataFrame([(0, 0, 5), (0, 1, 1), (1, 1, 2), (1, 0, 2)], "label int, prediction int, n long")
    got = learn.classification_metrics(cells).first()
    assert got["accuracy"] == pytest.approx(0.7) and got["baseline_accuracy"] == pytest.approx(0.6)
    assert got["precision"] == pytest.approx(0.6 * 5 / 7 + 0.4 * 2 / 3)


def test_relations_with_no_key_columns(spark):
    graph = relate.find_edges({"a": spark.createDataFrame([(1.0,)], "x double")})
    assert graph.tables == {"a": 1} and graph.relationships == []


def test_trust_rules():
    assert [from_sample_size(n).level.value for n in (29, 30, 99, 100)] == ["low", "moderate", "moderate", "high"]
    both = combine(from_sample_size(10), from_sample_size(1000))
    assert both.level is TrustLevel.LOW and both.basis == ("n=10", "n=1000")
    assert combine(from_sample_size(1000), decline("no")).declined
    assert combine().level is TrustLevel.UNASSESSED
    assert Trust(TrustLevel.HIGH).capped(TrustLevel.MODERATE).level is TrustLevel.MODERATE


def test_json_and_keys():
    assert json_safe({"a": NAN, "b": [INF, np.int64(3)], "d": dt.date(2020, 1, 2)}) == {"a": None, "b": [None, 3], "d": "2020-01-02"}
    assert operation_key("x", {"a": 1, "b": 2}, "f") == operation_key("x", {"b": 2, "a": 1}, "f")
    assert operation_key("x", {"a": 1}, "f") != operation_key("x", {"a": 1}, "g")


def test_edges_by_all_pairs_of_columns(spark):
    """Signatures lose no edge: children far smaller and far larger than a signature, at, above and below the coverage."""
    rng = random.Random(8)
    ids = rng.sample(range(10**9), 6_000)
    parents = spark.createDataFrame([(v, f"name {v}", v % 50, "x" * 300 + str(v)) for v in ids], "id long, name string, part int, note string")
    rows = [(i, rng.choice(ids), ids[i % 40], ids[i] if i % 100 < 95 else -i, ids[i] if i % 100 < 90 else -i,
             f"name {ids[i]}" if i % 50 else None, rng.randrange(50)) for i in range(5_000)]
    children = spark.createDataFrame(rows, "own long, any_id long, few long, edge long, short long, named string, part long")
    empty = spark.createDataFrame([], "id long, name string")
    tables = {"parents": parents, "children": children, "empty": empty}
    values, kinds, keys = {}, {}, set()
    for t, df in tables.items():
        for f in df.schema.fields:
            got = [r[0] for r in df.select(f.name).collect()]
            values[t, f.name], kinds[t, f.name] = {v for v in got if v is not None}, f.dataType.simpleString() == "string"
            if got and len(set(got)) == len(got) and None not in got:
                keys.add((t, f.name))
    expected = set()
    for c, p in itertools.permutations(values, 2):
        if p in keys and kinds[c] == kinds[p] and len(values[c]) >= 2 and (c not in keys or relate.strong_name(c[1], p[0])):
            share = len(values[c] & values[p]) / len(values[c])
            if share >= 0.95:
                expected.add((*c, *p, round(share, 4)))
    found = {(e.child_table, e.child_column, e.parent_table, e.parent_column, e.coverage) for e in relate.find_edges(tables).relationships}
    assert found == expected and len(expected) >= 4
    assert not any("note" in (c[1], p[1]) for c, p in relate.candidate_pairs(tables))
    assert relate.find_edges({"empty": empty}).relationships == []
