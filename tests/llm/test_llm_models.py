"""Top-k search against all scores; classifiers on held-out rows and on degenerate tables."""

import math
import random

import pytest

from plumbline.llm import quality, topk, toxicity

VECTORS = "vec_id long, embedding array<float>, shard int, score string, ids string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 1, "s", "x") for i, e in rows], VECTORS)


def vector_rows(n=230, width=6):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.1, 0.77]) for _ in range(width)]) for i in range(n)]
    rows += [(50, rows[3][1]), (7, rows[7][1]), (None, rows[1][1]), (400, None), (401, [0.5, None, 0.0, 0.0, 0.0, 0.0]), (450, [float("nan")] * 6),
             (402, [float("inf")] + [0.0] * 5), (403, []), (404, [1.0, 2.0]), (500, [1e18] * 6), (501, [1e18] * 6)]
    return rows


def best(rows, k):
    good = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, v in ((q, v) for q, v in good if q % 50 == 0):
        found = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in good if i != q and len(u) == len(v))
        out += [(q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def as_float(rows):
    import numpy as np

    return [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows]


@pytest.mark.parametrize("tile,fan", [(topk.TILE, topk.FAN), (4, 2)])
def test_top_k(spark, tile, fan):
    rows = [r for r in vector_rows() if r[0] != 50 or r[1] is vector_rows()[0]] + [(50, vector_rows()[50][1])]
    table = vectors(spark, rows).repartition(3)
    got = topk.top_k(table.where("vec_id % 50 = 0"), table, tile=tile, fan=fan)
    assert sorted(map(tuple, got.collect())) == best(as_float(rows), topk.K)


def test_top_k_few_and_none(spark):
    assert topk.every_fiftieth(vectors(spark, [])).count() == 0
    few = vectors(spark, [(0, [1.0]), (1, [2.0]), (2, [-1.0])])
    assert [tuple(r) for r in topk.every_fiftieth(few).orderBy("rank").collect()] == [(0, 1, 1, 131072), (0, 2, 2, -65536)]


DOCS = "doc_id long, text string, label int, score string, features string, part int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", "f", 0) for i, t in rows], DOCS)


def sentence(rng):
    return " ".join(rng.choice(["the", "of", "quiet", "river", "town", "bread", "walks", "under", "green"]) for _ in range(rng.randint(20, 60))) + "."


def quality_rows(n=700):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = rng.choice(["spam spam spam " * 15, "BUY NOW!! " * 12, "### $$$ %%% &&& " * 9]) if bad else sentence(rng)
        rows.append((i, text))
        labels.append((i, int(not bad), 0))
    return rows + [(None, None), (5000, ""), (5001, "long " * 40_000), rows[1]], labels + [(None, 1, 0), (7, None, None), (8, 0, 0), (8, 0, 0)]


def test_quality_on_held_out_rows(spark):
    rows, labels = quality_rows()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score_quality(documents(spark, rows), marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 700]
    assert len(held) > 80 and sum((r.doc_id % 4 != 0) == bool(r.predicted) for r in held) >= 0.98 * len(held)
    kept = quality.keep_good(documents(spark, rows), marks)
    assert kept.columns == documents(spark, []).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)


def test_quality_without_usable_labels(spark):
    rows, labels = quality_rows(20)
    for marks in ([], [(1, 1, 0)], [(None, None, None)]):
        got = quality.score_quality(documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
        assert len({r.score for r in got}) == 1 and len(got) == len(rows)
    assert quality.score_quality(documents(spark, []), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = sentence(rng) + (f" you {rng.choice(['grubber', 'snotling', 'mudheads'])} {sentence(rng)}" if toxic else "")
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    rows += [(None, None), (2000, ""), (2001, "grubber " * 30_000), rows[5]]
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(documents(spark, rows), marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 200 and sum((r.doc_id % 5 == 0) == bool(r.predicted) for r in held) >= 0.98 * len(held)
    one_class = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert len({r.score for r in toxicity.score_toxicity(documents(spark, rows), one_class).collect()}) == 1
    assert toxicity.score_toxicity(documents(spark, []), marks).count() == 0


def test_toxicity_features_name_every_number():
    lexicon = toxicity.Lexicon({b"scum": 5.0}, {b"grub*": 4.0})
    values = dict(zip(toxicity.FEATURES, toxicity.features(b"You SCUM!! grubbers, sc0m s0ft", lexicon), strict=True))
    assert values["word_hits"] == values["stem_hits"] == 1 and values["near_second"] == 2 / 5 and values["top_weight"] == 5.0
    assert len(toxicity.features(b"", lexicon)) == len(toxicity.FEATURES) and len(quality.features(b"")) == len(quality.FEATURES)
