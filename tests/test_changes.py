"""Change points at every length: blocks that propose, histograms that decide."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import pelt
from plumbline.operators import series as ts


def points(spark, parts):
    rows = [(key, i, i, float(v), len(x)) for key, x in parts.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series string, t long, pos long, v double, n long")


def steps(levels, width, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(level, 1.0, width) for level in levels])


def starts(found, key):
    return sorted(r["n"] for r in found if r["series"] == key), sum(r["n"] for r in found if r["series"] == key)


def test_blocks_agree_with_the_whole_series(spark):
    x = steps([0, 8, 2, 9, -4, 3, 12, 0], 250)
    parts = {"steps": x, "flat": np.full(900, 2.0), None: steps([0, 9], 400, 1)}
    whole = ts.changepoints(points(spark, parts)).collect()
    blocks = ts.changepoints(points(spark, parts).repartition(5), block=300, chunk=4).collect()
    for key in parts:
        assert starts(blocks, key) == starts(whole, key)
        assert starts(blocks, key)[1] == len(parts[key])
    ends = {r["segment"]: r["mean"] for r in blocks if r["series"] == "steps"}
    assert [round(ends[i]) for i in range(8)] == [0, 8, 2, 9, -4, 3, 12, 0]


def test_intervals_are_chosen_as_by_all_partitions():
    rng = np.random.default_rng(4)
    centres = np.array([0.0, 1.0, 5.0])
    for _ in range(20):
        table = rng.integers(0, 6, (6, 3)) + np.eye(3, dtype=int)[rng.integers(0, 3, 6)]
        kernel = np.exp(-np.clip((centres[:, None] - centres) ** 2, *pelt.CLIP))

        def cost(a, b):
            h = table[a:b].sum(0)
            return h.sum() - (h @ kernel @ h + (1 - np.exp(-0.01)) * h.sum()) / h.sum()

        ways = [[i for i in range(1, 6) if chosen >> i - 1 & 1] for chosen in range(32)]
        total = lambda w: sum(cost(a, b) + 1.5 for a, b in zip([0, *w], [*w, 6]))  # noqa: B023, E731
        assert total(pelt.best_intervals(table, centres, 1.0, 1.5)) == pytest.approx(min(map(total, ways)))


@pytest.mark.parametrize("n", [50_001, 200_000])
def test_long_series_are_answered(spark, n):
    level = F.when(F.col("id") < n // 3, 0.0).when(F.col("id") < 2 * (n // 3), 6.0).otherwise(-5.0)
    long = spark.range(n).select(F.lit("a").alias("series"), F.col("id").alias("t"), F.col("id").alias("pos"),
                                 (level + F.randn(3)).alias("v"), F.lit(n).cast("long").alias("n"))
    found = ts.changepoints(long, block=5_000).orderBy("segment").collect()
    assert sum(r["n"] for r in found) == n and not ts.changepoint_status(long).first()["declined"]
    assert [round(r["mean"]) for r in found] == [0, 6, -5]
    assert abs(found[0]["n"] - n // 3) <= 5 and abs(found[1]["n"] - n // 3) <= 10


@pytest.mark.parametrize("kind", ["far", "heavy"])
def test_far_off_points_do_not_hide_a_shift(spark, kind):
    rng = np.random.default_rng(9)
    x = steps([0, 5, -3], 1_000, 7)
    if kind == "far":
        x[rng.choice(len(x), len(x) // 100, replace=False)] = 1e6
    else:
        x = np.repeat([0.0, 5.0, -3.0], 1_000) + rng.standard_t(1.2, len(x))
    exact = ts.changepoints(points(spark, {"a": x})).orderBy("segment").collect()
    blocks = ts.changepoints(points(spark, {"a": x}), block=700).orderBy("segment").collect()
    ends = lambda found: np.cumsum([r["n"] for r in found])
    assert len(exact) == len(blocks) >= 3 and abs(ends(exact) - ends(blocks)).max() <= 5
    assert abs(ends(blocks) - [1_000, 2_000, 3_000]).max() <= 5


def test_block_size_does_not_decide(spark):
    """Strong, weak and short segments: the same whatever the blocks, and as one search over the whole series."""
    rng = np.random.default_rng(11)
    levels = np.repeat([0.0, 0.45, 8.0, 3.2, 0.4, 0.4], [4_000, 3_000, 60, 2_440, 2_500, 1_000])
    x = levels + rng.normal(0, 1, len(levels))
    whole = ts.changepoints(points(spark, {"a": x})).orderBy("segment").collect()
    assert len(whole) == 5 and max(r["n"] for r in whole) < 4_200
    for block in (500, 5_000):
        found = ts.changepoints(points(spark, {"a": x}), block=block).orderBy("segment").collect()
        assert [(r["start"], r["n"]) for r in found] == [(r["start"], r["n"]) for r in whole], block


def test_the_best_split_by_all_splits():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 40), rng.normal(2, 1, 30)])
    centres, where = np.unique(x, return_inverse=True)
    table = np.zeros((14, len(centres)))
    np.add.at(table, (np.arange(70) // 5, where), 1)

    def cost(part):
        k = np.exp(-np.clip(0.3 * (part[:, None] - part) ** 2, *pelt.CLIP))
        np.fill_diagonal(k, 1.0)
        return len(part) - k.sum() / len(part)

    best = min(range(1, 14), key=lambda i: cost(x[: 5 * i]) + cost(x[5 * i :]))
    assert pelt.best_split(table, centres, 0.3, list(range(1, 14))) == best
    assert pelt.best_split(table, centres, 0.3, []) is None
