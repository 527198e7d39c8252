import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import hashing, ordering
from plumbline.functions.joins import lookup
from plumbline.operators import learn


@pytest.fixture(scope="module")
def ties(spark):
    """A third of the rows share one value; the rest are spread with repeats and nulls."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        v = 7.0 if i % 3 == 0 else (None if i % 17 == 0 else float(rng.randint(0, 400)) / 4)
        rows.append((i, rng.choice("abc") if i % 29 else None, v))
    frame = pd.DataFrame(rows, columns=["k", "g", "v"])
    return spark.createDataFrame(rows, "k long, g string, v double").repartition(5).persist(), frame


def test_average_ranks(ties):
    df, frame = ties
    got = {r["v"]: r["avg_rank"] for r in ordering.rank_table(df, "v").collect()}
    want = frame.dropna(subset=["v"]).assign(r=frame["v"].rank()).groupby("v")["r"].first()
    assert got == want.to_dict()


def test_ranks_inside_groups_keep_the_missing_group(ties):
    df, frame = ties
    got = {(r["g"], r["v"]): r["avg_rank"] for r in ordering.rank_table(df, "v", ["g"]).collect()}
    part = frame.dropna(subset=["v"]).copy()
    part["g"] = part["g"].fillna("?")
    part["r"] = part.groupby("g")["v"].rank()
    want = part.groupby(["g", "v"])["r"].first()
    assert {(g or "?", v): r for (g, v), r in got.items()} == want.to_dict()


def test_quantiles_match_linear_interpolation(ties):
    df, frame = ties
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    row = ordering.quantiles(df, "v", probs).first()
    assert np.allclose([row[f"q{i}"] for i in range(6)], frame["v"].quantile(probs))
    grouped = {r["g"]: r["q0"] for r in ordering.quantiles(df.where("g is not null"), "v", [0.3], ["g"]).collect()}
    want = frame.dropna().groupby("g")["v"].quantile(0.3).to_dict()
    assert grouped == pytest.approx(want)


def test_column_quantiles_and_ranks(ties):
    df, frame = ties
    both = df.withColumn("w", F.col("v") * -2 + F.col("k"))
    frame = frame.assign(w=frame["v"] * -2 + frame["k"])
    got = {r["column"]: r["q0"] for r in ordering.column_quantiles(both, ["v", "w"], [0.5]).collect()}
    assert got == pytest.approx({"v": frame["v"].median(), "w": frame["w"].median()})
    ranks = ordering.column_ranks(both, ["v", "w"]).where("column = 'w'").collect()
    want = frame.dropna(subset=["w"]).assign(r=frame["w"].rank()).groupby("w")["r"].first().to_dict()
    assert {r["value"]: r["avg_rank"] for r in ranks} == want


def test_positions_break_ties_by_key(ties):
    df, frame = ties
    got = {r["key"]: r["position"] for r in ordering.ordinal_positions(df.where("v is not null"), ["v"], "k").collect()}
    part = frame.dropna(subset=["v"]).sort_values(["v", "k"]).reset_index(drop=True)
    assert got == {k: i + 1 for i, k in enumerate(part["k"])}


def test_positions_by_text_key(spark):
    rows = [(f"c{i:04d}", float(i % 3)) for i in range(500)] + [("é", 1.0), ("zz", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["key"]: r["position"] for r in ordering.ordinal_positions(df, ["v"], "k").collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0].encode()))
    assert got == {k: i + 1 for i, (k, _) in enumerate(order)}


def test_cumulate(ties):
    df, frame = ties
    counts = ordering.value_counts(df, "v").withColumn("twice", F.col("_count") * 2)
    got = {r["v"]: (r["upto__count"], r["upto_twice"], r["all__count"])
           for r in ordering.cumulate(counts, "v", ["_count", "twice"]).collect()}
    sizes = frame["v"].value_counts().sort_index().cumsum()
    assert got == {v: (n, 2 * n, sizes.iloc[-1]) for v, n in sizes.items()}


@pytest.mark.parametrize("broadcast_rows", [0, 100_000])
def test_lookup_with_a_hot_and_a_missing_key(ties, broadcast_rows):
    df, frame = ties
    table = df.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("last"))
    got = lookup(df, "v", table, "v", "n", {"last": "last"}, broadcast_rows=broadcast_rows)
    want = frame.assign(last=frame.groupby("v")["k"].transform("max"))
    assert {(r["k"], r["last"]) for r in got.collect()} == {
        (k, None if pd.isna(x) else int(x)) for k, x in zip(want["k"], want["last"])}


def test_split_is_a_quarter_of_each_class_and_repeatable(ties):
    df, frame = ties
    first = {r["k"]: r["in_test"] for r in learn.hold_out(df, ["k"], "g").collect()}
    again = {r["k"]: r["in_test"] for r in learn.hold_out(df.repartition(3), ["k"], "g").collect()}
    assert first == again
    known = frame.dropna(subset=["g"])
    for g, part in known.groupby("g"):
        assert sum(first[k] for k in part["k"]) == int(np.ceil(len(part) / 4))


def test_fingerprint_ignores_order_and_sees_changes(ties):
    df, _ = ties
    base = hashing.fingerprint_text(df)
    assert hashing.fingerprint_text(df.orderBy("k")) == base
    assert hashing.fingerprint_text(df.withColumn("v", F.when(F.col("k") == 9, 1.25).otherwise(F.col("v")))) != base


def test_raw_rows_are_never_pulled_into_one_partition(ties):
    """Only range sizes, at most one row per shuffle partition, may meet in one place."""
    df, _ = ties
    numbered = ordering.ordinal_positions(df.where("v is not null"), ["v"], "k")
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    grouped = ordering.rank_table(df, "v", ["g"])
    assert "SinglePartition" not in grouped._jdf.queryExecution().executedPlan().toString()
