"""Exact quantiles by brackets against numpy, whatever the sizes that decide the passes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import selection
from plumbline.operators import describe, typing

SHARES = [0.0, 0.25, 0.5, 0.999, 1.0]


def _columns(n=5_000, seed=3):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "smooth": rng.normal(0, 1e6, n),
        "tied": rng.integers(0, 4, n).astype(float),
        "spike": np.where(rng.random(n) < 0.6, 7.0, rng.normal(7, 1e-9, n)),
        "two": np.where(np.arange(n) < n // 2, -1e300, 1e300),
        "same": np.full(n, -0.5),
        "heavy": rng.standard_cauchy(n),
    })


def _check(df, data, shares=SHARES):
    found = selection.exact_quantiles(df, list(data.columns), shares)
    for c in data:
        with np.errstate(over="ignore"):
            assert found[c] == pytest.approx(np.quantile(data[c], shares), rel=1e-12, abs=1e-12), c


def test_equals_numpy(spark):
    data = _columns()
    _check(spark.createDataFrame(data).repartition(3), data)


@pytest.mark.parametrize("gathered, grid", [(40, 20), (150, 50)])
def test_many_narrowing_passes(spark, monkeypatch, gathered, grid):
    monkeypatch.setattr(selection, "GATHERED", gathered)
    monkeypatch.setattr(selection, "GRID", grid)
    monkeypatch.setattr(selection, "SKETCH", 200)
    monkeypatch.setattr(selection, "SLACK", 0.02)
    data = _columns(3_000)
    _check(spark.createDataFrame(data).repartition(3), data, [0.3, 0.97])


def test_a_wrong_sketch_changes_nothing(spark):
    data = pd.DataFrame({"x": np.arange(500.0)})
    df = spark.createDataFrame(data)
    for ends in ([400.0, 410.0], [0.0, 1.0], [-5.0, -5.0], [900.0, 900.0], [250.0, 240.0]):
        assert selection.settle_quantiles(df, {"x": 500}, {"x": ends}, [0.5]) == {"x": [249.5]}


def test_missing_empty_and_single(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "a double, b double")
    assert selection.exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [2.5]}
    assert selection.exact_quantiles(df.limit(0), ["a"], [0.5]) == {}
    assert selection.exact_quantiles(df, [], [0.5]) == {}
    rows = {r["column"]: r for r in describe.profile_numeric(df, ["a", "b"]).collect()}
    assert rows["a"]["median"] == 2.5 and rows["a"]["skew"] == 0.0 and rows["b"]["median"] is None and rows["b"]["n"] == 0


def test_profile_of_names_and_bad_numbers(spark):
    df = spark.range(101).select(
        F.col("id").alias("a b`c"), F.when(F.col("id") < 3, float("nan")).when(F.col("id") < 5, float("inf")).otherwise(F.col("id")).alias("x"))
    rows = {r["column"]: r for r in describe.profile_numeric(df, ["a b`c", "x"]).collect()}
    assert rows["a b`c"]["median"] == 50.0 and rows["x"]["n"] == 96 and rows["x"]["median"] == 52.5


def test_distinct_counts_of_every_type(spark):
    df = spark.range(200).selectExpr(
        "cast(id % 7 as int) i", "id % 3 = 0 flag", "if(id % 2 = 0, 0.0D, -0.0D) zeros", "cast(id % 5 as float) / 3 f",
        "if(id < 4, double('nan'), id % 9 + 0.5D) bad", "cast(id % 11 as decimal(9, 2)) d", "date_add(date'2020-01-01', int(id % 13)) day",
        "timestamp_micros(id % 17) at", "cast(timestamp_micros(id % 6) as timestamp_ntz) plain", "cast(id % 4 as string) `te'xt`",
        "concat(repeat('x', 100), id % 12) long", "array(id % 8) many", "if(id < 0, 1, null) nothing", "binary(cast(id % 10 as string)) raw")
    got = {r["column"]: r["n_distinct"] for r in typing.distinct_counts(df, df.columns).collect()}
    assert got == {"i": 7, "flag": 2, "zeros": 1, "f": 5, "bad": 9, "d": 11, "day": 13, "at": 17, "plain": 6, "te'xt": 4,
                   "long": 12, "many": 8, "raw": 10}
