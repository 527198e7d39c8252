import datetime as dt

import numpy as np
import pandas as pd
import pytest

from plumbline import Session
from plumbline.functions import arima, pelt
from plumbline.operators import series as ts

START = dt.datetime(2020, 1, 1)


def _df(spark, values, key="a"):
    rows = [(key, START + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, v double").repartition(3)


def _by_hand(x, p):
    n = len(x)
    kernel = np.ones(p) / p if p % 2 else np.r_[0.5, np.ones(p - 1), 0.5] / p
    h = p // 2
    trend = np.full(n, np.nan)
    trend[h : n - h] = np.convolve(x, kernel, mode="valid")
    front, back = h, n - 1 - h

    def line(lo, hi):
        at = np.arange(lo, hi)
        return np.linalg.lstsq(np.c_[at, np.ones(len(at))], trend[lo:hi], rcond=None)[0]

    k, c = line(front, min(front + p, back))
    k2, c2 = line(max(front, back - p), back)
    trend[:front] = np.arange(front) * k + c
    trend[back + 1 :] = np.arange(back + 1, n) * k2 + c2
    means = np.array([(x - trend)[i::p].mean() for i in range(p)])
    seasonal = np.resize(means - means.mean(), n)
    return trend, seasonal, x - trend - seasonal


@pytest.mark.parametrize("n,period", [(4, 2), (5, 2), (6, 3), (7, 3), (9, 4), (17, 7), (48, 12), (61, 12)])
def test_decompose_matches_definition(spark, n, period):
    x = np.sin(np.arange(n) * 2 * np.pi / period) * 5 + 0.3 * np.arange(n) + (np.arange(n) % 5)
    points = ts.ordered(_df(spark, x), "t", "v")
    got = ts.decompose(points).orderBy("pos").toPandas()
    trend, seasonal, resid = _by_hand(x, period)
    assert (got["period"] == period).all()
    assert np.allclose(got["trend"], trend)
    assert np.allclose(got["seasonal"], seasonal)
    assert np.allclose(got["trend"] + got["seasonal"] + got["resid"], x)


def test_decompose_in_small_blocks_is_the_same(spark):
    x = np.random.default_rng(0).normal(size=120).cumsum()
    points = ts.ordered(_df(spark, x), "t", "v")
    whole = ts.decompose(points).orderBy("pos").toPandas()
    cut = ts.decompose(points, block=13).orderBy("pos").toPandas()
    assert np.allclose(whole["trend"], cut["trend"]) and np.allclose(whole["resid"], cut["resid"])


def _loglik(w, phi, theta):
    """Exact Gaussian likelihood from the full covariance matrix, σ² profiled out."""
    m = len(w)
    g = np.zeros(m)
    g[0] = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
    g[1] = (1 + phi * theta) * (phi + theta) / (1 - phi**2)
    for i in range(2, m):
        g[i] = phi * g[i - 1]
    cov = g[np.abs(np.subtract.outer(np.arange(m), np.arange(m)))]
    _, logdet = np.linalg.slogdet(cov)
    return m * np.log(w @ np.linalg.solve(cov, w) / m) + logdet


def test_arima_likelihood_is_exact():
    w = np.random.default_rng(2).normal(size=40)
    grid = np.array([(0.5, 0.3), (-0.4, 0.8), (0.9, -0.6), (0.0, 0.0)])
    total, logs, _ = arima.fold([arima.summarize(w, 0.0, 0, grid)])
    got = len(w) * np.log(total / len(w)) + logs
    assert np.allclose(got, [_loglik(w, p, q) for p, q in grid])
    three = [arima.summarize(w[:9], 0.0, 0, grid), arima.summarize(w[9:17], w[8], 9, grid), arima.summarize(w[17:], w[16], 17, grid)]
    whole = arima.summarize(w, 0.0, 0, grid)
    assert np.allclose(arima.compose(three), whole)
    assert np.allclose(arima.compose([three[0], arima.compose(three[1:])]), whole)
    halves = [arima.summarize(w[:17], 0.0, 0, grid), arima.summarize(w[17:], w[16], 17, grid)]
    for a, b in zip(arima.fold(halves), arima.fold([arima.summarize(w, 0.0, 0, grid)])):
        assert np.allclose(a, b)


def test_long_series_forecast_equals_short_route(spark, monkeypatch):
    monkeypatch.setattr(ts, "MERGE", 2)
    rng = np.random.default_rng(4)
    e = rng.normal(size=160)
    w = np.zeros(160)
    for i in range(1, 160):
        w[i] = 0.6 * w[i - 1] + e[i] + 0.3 * e[i - 1]
    points = ts.ordered(_df(spark, w.cumsum()), "t", "v")
    short = ts.forecast(points, 5).orderBy("step").toPandas()
    long = ts.forecast(points, 5, block=37).orderBy("step").toPandas()
    assert np.allclose(short["forecast"], long["forecast"]) and np.allclose(short["upper"], long["upper"])
    assert short["phi"][0] == pytest.approx(0.6, abs=0.2)
    assert (np.diff(short["upper"] - short["lower"]) > 0).all()


def test_forecast_declines_short_history(spark):
    session = Session(spark)
    table = session.add_table(_df(spark, range(11)), "s")
    assert table.forecast("t", "v").declined
    assert not session.add_table(_df(spark, range(30)), "s2").forecast("t", "v", 3).declined


def _pelt_by_hand(x, penalty):
    """Best segmentation over all allowed cuts, straight from the cost's definition."""
    n = len(x)
    gaps = (x[:, None] - x[None, :]) ** 2
    med = np.median(gaps[np.triu_indices(n, 1)])
    k = np.exp(-np.clip(gaps / (med or 1.0), 1e-2, 1e2))
    np.fill_diagonal(k, 1.0)
    best, cuts = {0: 0.0}, {0: []}
    for end in [*range(5, n, 5), n]:
        found = []
        for s in range(0, end - 1, 5):
            if s in best and end - s >= 2:
                cost = (end - s) - k[s:end, s:end].sum() / (end - s)
                found.append((best[s] + cost + penalty, cuts[s] + ([s] if s else [])))
        best[end], cuts[end] = min(found)
    return cuts[n]


@pytest.mark.parametrize("seed", range(6))
def test_pelt_finds_the_best_segmentation(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(m, 1, rng.integers(10, 40)) for m in rng.choice([0, 3, 6], 4)])
    assert pelt.change_points(x, 3.0) == _pelt_by_hand(x, 3.0)


def test_median_gap_of_many_points():
    x = np.random.default_rng(1).normal(size=2501)
    i, j = np.triu_indices(len(x), 1)
    assert pelt.median_square_gap(x) == pytest.approx(np.median((x[i] - x[j]) ** 2))


def test_changepoint_and_comparison_of_a_step(spark):
    x = np.r_[np.zeros(30), np.full(30, 10.0)] + np.random.default_rng(0).normal(0, 0.5, 60)
    table = Session(spark).add_table(_df(spark, x), "step")
    found = table.detect_changepoints("t", "v", penalty=3.0)
    assert found.values["changepoints"] == [(START + dt.timedelta(days=30)).isoformat()]
    compared = table.compare_periods("t", "v")
    assert compared.metadata["n_before"] == 30 and compared.values["mannwhitney_p"] < 1e-8
    assert compared.values["ks_p"] < 1e-10
    given = table.compare_periods("t", "v", split="2020-01-11")
    assert given.metadata["n_before"] == 10
    assert table.compare_periods("t", "v", split="2019-01-01").declined


def test_many_series_at_once(spark):
    parts = [_df(spark, np.arange(30) + 5 * i, key) for i, key in enumerate("ab")]
    points = ts.ordered(parts[0].union(parts[1]), "t", "v", "k")
    sizes = {r["series"]: (r["n"], r["period"]) for r in ts.series_period(points).collect()}
    assert sizes == {"a": (30, 12), "b": (30, 12)}
    assert ts.decompose(points).where("abs(resid) > 1e-8").count() == 0


def test_ordered_skips_missing_and_junk(spark):
    rows = [("2020-01-02", "3"), ("2020-01-01", "1"), ("junk", "9"), ("2020-01-03", "x"), (None, "2")]
    got = ts.ordered(spark.createDataFrame(rows, "t string, v string"), "t", "v").orderBy("pos").collect()
    assert [(r["v"], r["pos"]) for r in got] == [(1.0, 0), (3.0, 1)]
    assert pd.DataFrame(got).shape[0] == 2
