"""All k-means models in one pass against separate fits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import functions as F

from plumbline.operators import cluster, prep

ROLES = prep.Roles(("x", "y"), ("g",), ("o",))


def _frame(spark, n=900, seed=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 3, (5, 2))
    at = rng.integers(0, 5, n)
    points = middles[at] + rng.normal(0, 0.7, (n, 2))
    return spark.createDataFrame(pd.DataFrame(points, columns=["x", "y"]).assign(
        i=range(n), g=np.where(rng.random(n) < 0.1, "z", np.array(list("abcde"))[at]), o=rng.integers(0, 4, n))).repartition(3)


def test_costs_and_silhouettes_of_separate_fits(spark):
    df = _frame(spark)
    data, _ = prep.matrix(df, ROLES)
    data = data.select(prep.FEATURES).cache()
    rows = cluster._encoded(df, ROLES)
    ks = [2, 3, 5]
    fitted = cluster._fitted(rows, ks, 4)
    scores = cluster._silhouettes(rows, [fitted[k][0] for k in ks], 900)
    for k, score in zip(ks, scores):
        separate = min((KMeans(featuresCol=prep.FEATURES, k=k, seed=s).fit(data) for s in range(4)), key=lambda m: m.summary.trainingCost)
        assert fitted[k][1] <= separate.summary.trainingCost * 1.001
        mine = cluster._gaps(*_dense(rows), fitted[k][0])
        assert mine.min(1).sum() == pytest.approx(fitted[k][1], rel=1e-6)
        # The same partition has the same silhouette.
        labels = spark.createDataFrame(
            [(v, int(c)) for v, c in zip([r[0] for r in _vectors(spark, rows)], mine.argmin(1))], ["features", "prediction"])
        assert score == pytest.approx(ClusteringEvaluator().evaluate(labels), abs=1e-9)


def _dense(rows):
    table = rows.data.toArrow().combine_chunks().to_batches()[0]
    return cluster._split(table, rows.width)


def _vectors(spark, rows):
    from pyspark.ml.linalg import Vectors

    x, slots = _dense(rows)
    hot = np.zeros((len(x), rows.slots))
    for j in range(slots.shape[1]):
        known = slots[:, j] >= 0
        hot[np.flatnonzero(known), slots[known, j]] = 1.0
    return [(Vectors.dense([*a, *b]),) for a, b in zip(x, hot)]


def test_models_in_several_groups_are_the_same(spark, monkeypatch):
    df = _frame(spark, 300, 1)
    whole = cluster.kmeans(df, ROLES, restarts=3)
    monkeypatch.setattr(cluster, "CENTRE_ENTRIES", 100)
    parts = cluster.kmeans(df, ROLES, restarts=3)
    assert whole.k == parts.k and whole.sizes == parts.sizes and whole.silhouette == pytest.approx(parts.silhouette)
    assert sum(whole.sizes.values()) == 300 and whole.labelled.columns == [*df.columns, "cluster"]


def test_few_and_equal_rows(spark):
    one = spark.createDataFrame([(1.0,)], "x double")
    assert cluster.kmeans(one, prep.Roles(("x",))).sizes == {0: 1}
    two = cluster.kmeans(spark.createDataFrame([(1.0,), (2.0,)], "x double"), prep.Roles(("x",)), restarts=2)
    assert sum(two.sizes.values()) == 2
    same = cluster.kmeans(spark.createDataFrame([(5.0,)] * 20, "x double"), prep.Roles(("x",)), restarts=2)
    assert sum(same.sizes.values()) == 20 and same.silhouette is None
    assert same.labelled.where(F.col("cluster").isNull()).count() == 0
