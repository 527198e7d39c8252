"""Principal components by growing blocks against a dense decomposition."""

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import cluster, prep


def _data(n=1_500, levels=60, seed=5):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 3, n)
    return pd.DataFrame({
        "a": a, "b": 0.5 * a + rng.normal(0, 1, n), "c": rng.exponential(2, n),
        "g": [f"l{v:02}" for v in rng.integers(0, levels, n)], "h": rng.choice(list("xyz"), n, p=[0.6, 0.3, 0.1])})


def _dense(data):
    z = data[["a", "b", "c"]].to_numpy()
    z = (z - z.mean(0)) / z.std(0)
    hot = [pd.get_dummies(data[c]).to_numpy(float) for c in ("g", "h")]
    full = np.hstack([z, *hot])
    centred = full - full.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / (len(full) - 1))
    return centred, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("block", [2, 100])
def test_equals_dense_decomposition(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "BLOCK", block)
    data = _data()
    df = spark.createDataFrame(data).repartition(3)
    out, ratios, loadings = cluster.principal_components(df, prep.Roles(("a", "b", "c"), ("g", "h")), 4)
    centred, values, vectors = _dense(data)
    assert ratios == pytest.approx(list(values[:4] / values.sum()), rel=1e-8)
    assert np.abs(np.sum(loadings * vectors[:, :4], axis=0)) == pytest.approx([1.0] * 4, abs=1e-8)
    got = out.toPandas().sort_values(["a", "b"])
    want = np.abs(centred @ vectors[:, :4])[data.sort_values(["a", "b"]).index]
    assert np.allclose(np.abs(got[[f"pca_{j}" for j in range(4)]].to_numpy()), want, atol=1e-5)
    assert out.columns == [*df.columns, "pca_0", "pca_1", "pca_2", "pca_3"]


def test_fifty_thousand_columns(spark):
    df = spark.range(100_000).selectExpr(
        "cast(id % 50000 as string) g", "sin(id) a", "sin(id) + 0.3 * cos(id * 7) b", "cast(id % 7 as double) c")
    out, ratios, loadings = cluster.principal_components(df, prep.Roles(("a", "b", "c"), ("g",)), 2)
    assert loadings.shape == (50_003, 2) and 0.4 < ratios[0] < 0.6 and out.where("pca_0 is null or pca_1 is null").count() == 0
    assert out.selectExpr("var_samp(pca_0) / var_samp(pca_1) as r").first().r == pytest.approx(ratios[0] / ratios[1], rel=1e-6)


def test_constant_rows_and_too_many_components(spark):
    same = spark.createDataFrame([(5.0, "u")] * 10, "x double, g string")
    out, ratios, _ = cluster.principal_components(same, prep.Roles(("x",), ("g",)), 2)
    assert ratios == [0.0, 0.0] and out.where("abs(pca_0) + abs(pca_1) > 1e-12").count() == 0
    with pytest.raises(ValueError):
        cluster.principal_components(same, prep.Roles(("x",)), 2)
