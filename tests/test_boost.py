"""Boosted trees against a brute-force booster, and encodings with many levels."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import Session
from plumbline.functions.hashing import hash_text
from plumbline.operators import boost, cluster, interpret, learn, prep


def _brute(x, y, edges, ordered, k, rounds, depth, rate, min_rows):
    """Softmax boosting by trying every split of every node on the rows themselves; trees as nested tuples."""
    base = np.log(np.bincount(y, minlength=k) / len(y))
    margins = np.tile(base, (len(y), 1))
    trees = []

    def side(rows, f, cut):
        return rows[f] <= cut if f < ordered else rows[f] == cut

    def grow(index, g, h, level):
        value = -rate * g[index].sum() / h[index].sum()
        best = None
        if level < depth:
            for f in range(x.shape[1]):
                cuts = list(enumerate(edges[f])) if f < ordered else [(int(v), v) for v in np.unique(x[index, f])]
                for number, cut in cuts:
                    left = x[index, f] <= cut if f < ordered else x[index, f] == cut
                    a, b = index[left], index[~left]
                    if min(len(a), len(b)) < min_rows or min(h[a].sum(), h[b].sum()) < 1e-3:
                        continue
                    gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[index].sum() ** 2 / h[index].sum()
                    key = (round(gain, 8), -f, -number)
                    if key[0] > 0 and (best is None or key > best[0]):
                        best = (key, f, cut, a, b)
        if best is None:
            return value
        return (best[1], best[2], grow(best[3], g, h, level + 1), grow(best[4], g, h, level + 1))

    def value(tree, row):
        while isinstance(tree, tuple):
            f, cut, a, b = tree
            tree = a if side(row, f, cut) else b
        return tree

    for _ in range(rounds):
        p = np.exp(margins) / np.exp(margins).sum(1, keepdims=True)
        grown = [grow(np.arange(len(y)), p[:, c] - (y == c), p[:, c] * (1 - p[:, c]), 0) for c in range(k)]
        grown = [t if isinstance(t, tuple) else 0.0 for t in grown]
        trees.append(grown)
        margins += np.array([[value(t, row) for t in grown] for row in x])

    def probabilities(rows):
        m = base + sum(np.array([[value(t, row) for t in grown] for row in rows]) for grown in trees)
        return np.exp(m) / np.exp(m).sum(1, keepdims=True)

    return probabilities


def test_softmax_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 650
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 12, n), rng.integers(0, 5, n)]).astype(float)
    y = ((x[:, 0] > 0.3).astype(int) + (x[:, 2] == 3) + (rng.random(n) < 0.15)).clip(0, 2)
    names = ["a", "b", "c"]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=y.astype(float), part=np.arange(n) < 500))
    fit = df.where("part").repartition(5)
    edges = boost.bin_edges(fit, names[:2])
    base = np.log(np.bincount(y[:500]) / 500)
    model = boost.boost(fit, [F.col(c) for c in names], F.col("y"), boost.SOFTMAX, edges, base, rounds=7, depth=3)
    assert [len(r) for r in model.rounds] == [3] * 7
    expected = _brute(x[:500], y[:500], edges, 2, 3, 7, 3, boost.RATE, boost.MIN_ROWS)(x[500:])
    got = model.answers(x[500:])
    loss = [-np.log(p[np.arange(150), y[500:]]).mean() for p in (got, expected)]
    assert loss[0] == pytest.approx(loss[1], abs=1e-6) and np.allclose(got, expected, atol=1e-6)
    assert loss[0] < 0.8 * -np.log(np.exp(base)[y[500:]]).mean()
    again = boost.Booster.from_json(model.to_json())
    assert np.array_equal(again.answers(x), model.answers(x))
    scored = df.where("not part").select("y", boost.answer(model, [F.col(c) for c in names]).alias("p")).toPandas()
    assert np.allclose(np.stack(scored["p"]), got)


def test_edges_of_odd_columns(spark):
    df = spark.createDataFrame([(float(i % 3), 1.0, float(i)) for i in range(3000)], "few double, one double, many double")
    few, one, many = boost.bin_edges(df, ["few", "one", "many"])
    assert few == [0.0, 1.0] and one == [] and len(many) == boost.CUTS


def test_three_classes_train_boosted_trees(spark):
    rng = np.random.default_rng(2)
    n = 600
    x, g = rng.normal(size=n), rng.choice(list("pqr"), n)
    y = np.where(g == "p", "low", np.where(x > 0, "high", "mid"))
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "x": x, "g": g, "y": y}))
    model = learn.train(df, "y", "classification", prep.Roles(("x",), ("g",)), ["i"], rounds=8, depth=3)
    assert model.algorithm == "gradient_boosted_trees" and model.booster.loss == boost.SOFTMAX
    assert learn.holdout_metrics(model)["accuracy"] > 0.97
    scored = learn.add_predictions(model, df, "p")
    assert scored.where("p = y").count() > 0.97 * n


def test_many_levels_train_and_cluster(spark):
    """120,000 levels: more than are broadcast, so the join with the level table is shuffled."""
    n = 240_000
    df = spark.range(n).select(
        "id", F.concat(F.lit("level "), F.col("id") % 120_000).alias("g"), (F.col("id") % 2).cast("double").alias("x"),
        F.when(F.col("id") % 120_000 == 7, "rare").when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("y"))
    # A level that holds a third of all rows tells its class.
    df = df.withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("g")))
    plan = prep.learn(df, prep.Roles(("x",), ("g",)), scale=False)
    levels = plan.levels["g"]
    assert plan.sizes["g"] > 75_000 and levels.count() == plan.sizes["g"]
    first = levels.orderBy("slot").limit(3).collect()
    assert [r["level"] for r in first] == ["hot", "level 1", "level 10"] and [r["slot"] for r in first] == [0, 1, 2]
    model = learn.train(df, "y", "classification", prep.Roles(("x",), ("g",)), ["id"], rounds=2, depth=2)
    assert learn.holdout_metrics(model)["accuracy"] > 0.99
    small = df.where("id < 60000")
    data, plan = prep.matrix(small, prep.Roles(("x",), ("g",)))
    assert data.first()[prep.FEATURES].size == 1 + plan.sizes["g"]
    found = cluster.kmeans(small.where("id < 3000"), prep.Roles(("x",), ("g",)), k=2, restarts=1)
    assert sum(found.sizes.values()) == 3000


def test_ordinals_in_order_and_unseen(spark):
    df = spark.createDataFrame([(i, [2, 10, 30][i % 3], ["b", "a", None][i % 3]) for i in range(9)], "i int, o int, n string")
    plan = prep.learn(df, prep.Roles((), ("n",), ("o",)), scale=False)
    new = spark.createDataFrame([(0, 10, "a"), (1, 30, "zz"), (2, None, None), (3, 11, "b")], df.schema)
    rows = prep.encode(new, plan).orderBy("i").collect()
    names = prep.encoded_names(plan)
    assert [[r[c] for c in names] for r in rows] == [[1.0, 0.0], [2.0, 2.0], [1.0, 0.0], [-1.0, 1.0]]  # "10" is the first of equally frequent texts


def test_saved_models_answer_alike(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7), "uvw"[i % 3], float(i % 7) * 2 + (i % 3)) for i in range(300)], "i int, x double, g string, y double")
    path = str(tmp_path / "in.parquet")
    df.write.parquet(path)
    session = Session.create(spark, [path], str(tmp_path))
    table = session.table(session.tables[0])
    table.set_column_type("g", "categorical_nominal")
    table._types |= {"i": "identifier", "x": "continuous", "y": "continuous"}
    table.train_regressor("y", "m", rounds=5, depth=3)
    before = {r["i"]: r["_prediction"] for r in table.model("m").score(df).collect()}
    session.save()
    session.save_model(table, "m")
    again = Session.open(spark, session.key, str(tmp_path)).table(table.name).model("m")
    assert {r["i"]: r["_prediction"] for r in again.score(df).collect()} == before


def test_contributions_equal_all_subsets(spark):
    """Against the definition: every subset of features from the row, the rest from each background row."""
    rng = np.random.default_rng(3)
    n = 500
    frame = pd.DataFrame({"i": np.arange(n), "a": rng.normal(size=n), "b": rng.normal(size=n), "c": rng.choice(list("uvw"), n), "o": rng.integers(0, 4, n)})
    score = frame["a"] * (frame["c"] == "u") + frame["b"] * frame["o"]
    frame["y"] = np.where(score > 1, "hi", np.where(score < -1, "lo", "mid"))
    frame["z"] = score
    frame["two"] = np.where(score > 0, "yes", "no")
    df = spark.createDataFrame(frame)
    roles = prep.Roles(("a", "b"), ("c",), ("o",))
    names = ["a", "b", "o", "c"]
    for target, task, outputs in (("y", "classification", 3), ("z", "regression", 1), ("two", "classification", 1)):
        model = learn.train(df, target, task, roles, ["i"], rounds=4, depth=4)
        got = interpret.shapley(model, df.where("i < 6"), "i", background=9).toPandas()
        assert len(got) == 6 * outputs * 4 and sorted(got["feature"].unique()) == sorted(names)
        sample = model.test.orderBy(hash_text(7, F.col(learn.ROW)), learn.ROW).limit(9)
        rows, others = (
            np.array([r["x"] for r in prep.encode(d, model.plan).select(F.array(*prep.encoded_names(model.plan)).alias("x")).collect()])
            for d in (df.where("i < 6").orderBy("i"), sample))

        def value(row, subset):
            mixed = others.copy()
            mixed[:, list(subset)] = row[list(subset)]
            return model.booster.margins(mixed).mean(0)

        for i, row in enumerate(rows):
            for f, name in enumerate(names):
                rest = [k for k in range(4) if k != f]
                expected = sum(
                    (value(row, (*s, f)) - value(row, s)) * math.factorial(len(s)) * math.factorial(3 - len(s)) / 24
                    for size in range(4) for s in itertools.combinations(rest, size))
                mine = got[(got["i"] == i) & (got["feature"] == name)]
                if outputs == 3:
                    mine = mine.sort_values("class")
                    assert mine["class"].tolist() == [0, 1, 2]
                assert np.allclose(mine["contribution"], expected, atol=1e-9), (target, i, name)
        sums = got.groupby(["i", got["class"].fillna(-1)]).agg(c=("contribution", "sum"), b=("base_value", "first"), p=("prediction", "first"))
        assert np.allclose(sums["c"], sums["p"] - sums["b"])


def _random_tree(rng, depth, width, ordered, cuts):
    tree = boost.Tree.empty(depth)

    def grow(node, level):
        tree.value[node] = rng.normal()
        if level < depth and (level < 2 or rng.random() < 0.8):
            f = int(rng.integers(width))
            tree.feature[node], tree.bin[node] = f, rng.integers(cuts)
            tree.cut[node] = tree.bin[node] / 2 if f < ordered else tree.bin[node]
            grow(2 * node + 1, level + 1)
            grow(2 * node + 2, level + 1)

    grow(0, 0)
    return tree


@pytest.mark.parametrize("depth", [0, 3, 6, 8])
@pytest.mark.parametrize("cuts", [3, 400])
def test_paths_end_in_the_same_leaves(depth, cuts):
    rng = np.random.default_rng(3)
    trees = [_random_tree(rng, depth, 4, 2, cuts) for _ in range(6)]
    x = np.column_stack([rng.integers(-2, cuts, (5000, 2)) / 2, rng.integers(0, cuts + 2, (5000, 2))]).astype(float)
    x[:50, 0], x[50:99, 1] = np.nan, np.inf
    paths = boost.Paths(trees, 2, 4, "cut")
    codes = paths.codes(x.T)
    for k, tree in enumerate(trees):
        assert np.array_equal(paths.leaves(k, codes), tree.leaves(x, tree.cut, 2))
    model = boost.Booster(boost.SOFTMAX, 2, [], [0.5, -1.0], [trees[:2], trees[2:4], trees[4:]])
    expected = np.tile([0.5, -1.0], (5000, 1))
    for pair in model.rounds:
        for c, tree in enumerate(pair):
            expected[:, c] += tree.value[tree.leaves(x, tree.cut, 2)]
    scorer = boost.Scorer(model, 4)
    for _ in range(30):  # by the trees, then by the table of all answers where that is small
        assert np.array_equal(scorer(x.T), expected)


@pytest.mark.parametrize("loss", [boost.SQUARED, boost.LOGISTIC])
def test_equal_rows_are_learned_from_once(spark, loss):
    rng = np.random.default_rng(4)
    n, columns = 30_000, ["a", "b", "c"]
    x = np.column_stack([rng.integers(0, 6, n), rng.integers(0, 4, n), rng.integers(0, 3, n)]).astype(float)
    y = x[:, 0] * x[:, 1] + rng.integers(0, 9, n) if loss == boost.SQUARED else (x[:, 0] + rng.integers(0, 5, n) > 5).astype(float)
    df = spark.createDataFrame(pd.DataFrame(x, columns=columns).assign(y=y)).repartition(5)
    edges, base = boost.bin_edges(df, columns[:2]), [float(y.mean())]
    features = [F.col(c) for c in columns]
    kept = boost.binned(df, features, F.col("y"), loss, edges, base).collect()
    times = np.concatenate([np.frombuffer(r["n"]) for r in kept])
    assert times.sum() == n and len(times) == (72 if loss == boost.SQUARED else len(np.unique(np.column_stack([x, y]), axis=0)))
    model = boost.boost(df, features, F.col("y"), loss, edges, base, rounds=2, depth=2)
    tree, bins = model.rounds[0][0], [np.searchsorted(edges[f], x[:, f]) if f < 2 else x[:, 2].astype(int) for f in range(3)]
    g = base[0] - y if loss == boost.SQUARED else 1 / (1 + np.exp(-base[0])) - y
    gains = {}
    for f in range(3):
        for b in range(bins[f].max() + 1):
            left = bins[f] <= b if f < 2 else bins[f] == b
            if boost.MIN_ROWS <= left.sum() <= n - boost.MIN_ROWS:
                gains[f, b] = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum()
    assert (tree.feature[0], tree.bin[0]) == max(gains, key=gains.get)


def test_more_columns_than_one_number_tells_apart():
    rng = np.random.default_rng(5)
    columns = [rng.integers(-1, 2, 4000) * (1 << 20) for _ in range(6)]
    kinds, first, place, times = boost.same_rows(columns)
    rows = np.column_stack(columns)
    assert len(kinds) == len(np.unique(rows, axis=0)) and times.sum() == 4000 and np.array_equal(rows[first[place]], rows)


def test_held_out_rows_are_scored_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 2000
    x, g = rng.integers(0, 5, n).astype(float), rng.choice(list("pq"), n)
    y = np.where(x + (g == "p") + rng.integers(0, 4, n) > 4, "high", "low")
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "x": x, "g": g, "y": y}))
    model = learn.train(df, "y", "classification", prep.Roles(("x",), ("g",)), ["i"], rounds=3, depth=2)
    test = model.score(model.with_label(model.test)).select(learn.LABEL, learn.PREDICTION, "_proba").toPandas()
    label, chance = test[learn.LABEL].to_numpy(), np.stack(test["_proba"])[:, 1]
    calls = spark.sparkContext.accumulator(0)

    def watched(booster, features):
        scorer = boost.Scorer(booster, len(features))

        @F.arrow_udf("array<double>")
        def scored(*columns):
            calls.add(len(columns[0]))
            return boost.matrix_lists(boost.respond(booster.loss, scorer([c.to_numpy(zero_copy_only=False) for c in columns])))

        return scored(*[c.cast("double") for c in features])

    monkeypatch.setattr(boost, "answer", watched)
    found = learn.holdout_metrics(model)
    assert calls.value == len(test) == found["n"]
    assert found["accuracy"] == pytest.approx((label == test[learn.PREDICTION]).mean())
    one, none = chance[label == 1], chance[label == 0]
    pairs = (one[:, None] > none).mean() + (one[:, None] == none).mean() / 2
    assert found["roc_auc"] == pytest.approx(pairs)
    cells = np.zeros((2, 2), int)
    np.add.at(cells, (label.astype(int), test[learn.PREDICTION].astype(int)), 1)
    assert found["confusion_matrix"] == cells.tolist()


def test_hashes_are_those_of_spark(spark):
    rows = [0, 1, -5, 2**40 + 3, -(2**63), 2**63 - 1]
    found = spark.createDataFrame([(k, r) for k in range(4) for r in rows], "copy int, r long").selectExpr("copy", "r", "xxhash64(copy, r) AS h").collect()
    made = list(interpret.copy_hashes(4, np.array(rows)))
    assert {(r["copy"], r["r"]): r["h"] for r in found} == {(k, r): int(made[k][i]) for k in range(4) for i, r in enumerate(rows)}


@pytest.mark.parametrize("task", ["regression", "classification"])
@pytest.mark.parametrize("cells", [1 << 17, 0])
def test_importance_is_that_of_shuffled_rows(spark, monkeypatch, task, cells):
    """Every copy made and scored on its own, from the order that Spark's hashes give each block."""
    monkeypatch.setattr(boost, "_CELLS", cells)
    monkeypatch.setattr(interpret, "BLOCK", 100)
    rng = np.random.default_rng(7)
    n, names = 2600, ("x", "g", "o")
    x, g, o = rng.integers(0, 7, n).astype(float), rng.choice(["p", "q", None], n), rng.integers(0, 3, n)
    y = x * (g == "p") + o + rng.integers(0, 3, n)
    y = y.astype(float) if task == "regression" else np.where(y > 5, "high", np.where(y > 2, "mid", "low"))
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "x": x, "g": g, "o": o, "y": y})).repartition(3)
    model = learn.train(df, "y", task, prep.Roles(("x",), ("g",), ("o",)), ["i"], rounds=3, depth=3)
    found = {r["feature"]: r["importance"] for r in interpret.permutation_importance(model, 4).collect()}
    test = model.with_label(model.test)
    size = test.count()
    rows = test.selectExpr(*names, learn.LABEL, learn.ROW, f"pmod(xxhash64({learn.ROW}), {size // 100}) AS block").toPandas().sort_values(["block", learn.ROW])
    order = spark.createDataFrame(rows[[learn.ROW, "block"]]).crossJoin(spark.range(12).selectExpr("CAST(id AS int) AS copy")).selectExpr(
        "copy", "block", learn.ROW, f"xxhash64(copy, {learn.ROW}) AS h").toPandas().sort_values(["copy", "block", "h"])
    known = rows.set_index(learn.ROW)
    copies = [rows.assign(copy=-1)]
    for k, own in order.groupby("copy"):
        copies.append(rows.assign(copy=k, **{names[k // 4]: known.loc[own[learn.ROW], names[k // 4]].to_numpy()}))
    table = pd.concat(copies)
    table["g"] = table["g"].astype(object).where(table["g"].notna(), None)
    scored = model.score(spark.createDataFrame(table)).toPandas()
    hit = (scored[learn.LABEL] - scored[learn.PREDICTION]) ** 2 if task == "regression" else (scored[learn.LABEL] == scored[learn.PREDICTION]).astype(float)
    means = hit.groupby(scored["copy"]).mean()
    score = 1 - means / rows[learn.LABEL].var(ddof=0) if task == "regression" else means
    expected = {c: score[-1] - score[range(4 * k, 4 * k + 4)].mean() for k, c in enumerate(names)}
    assert found == pytest.approx(expected, abs=1e-9) and found["x"] > 0.01
