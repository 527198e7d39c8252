"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings that occur in many toxic and in few other training documents. The
features are lexicon densities, how near lexicon words stand to the second person, capitals, punctuation and signs
of obfuscation. The lexicon, the trees and the calibration are each fitted on a third of the sample of their own, so
none of them sees labels that another has learned by heart.

Fitting sees at most ``SAMPLE`` labelled documents, those whose ids hash lowest; scoring covers every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stages import settle
from .common import id_and_text, remainder
from .quality import as_bytes, labelled

SAMPLE = 24_000
THRESHOLD = 0.7
FOLDS, HELD = 3, 1
LEXICON = 5_000
LEAST_DOCUMENTS = 6
LEAST_SHARE = 0.8
STEMS = (4, 5, 6)
NEAR = 8
TREES, DEPTH = 20, 4

#: Second-person forms of English, French, German and Spanish (fixed values).
SECOND_PERSON = frozenset(
    b"you your yours yourself you're u tu te toi ton ta tes vous votre vos "
    b"du dich dir dein deine euch ihr usted ustedes ti tuyo vosotros os".split()
)
#: Digits and signs that stand for letters in obfuscated words (fixed values).
LEET = bytes.maketrans(b"013457@$!|", b"oieastasil")
_INSIDE = re.compile(rb"[a-z][0-9@$!|*]+[a-z]")
_STRETCHED = re.compile(rb"([a-z])\1\1")
_MARKS = b".,;:!?\"'()[]{}*#%&-_"

FEATURES = (
    "word_hits", "stem_hits", "top_weight", "hits", "hit_share", "weight", "weight_share", "disguised_hits", "near_second", "second_share", "upper",
    "capital_words", "exclaims", "questions", "marks", "runs_of_marks", "inside_signs", "stretched", "log_words", "digits",
)


@dataclass(frozen=True)
class Lexicon:
    """Words and beginnings (by length) with their log odds of being in a toxic document."""

    words: dict[bytes, float]
    stems: dict[bytes, float]


def tokens(text: bytes) -> list[bytes]:
    return [w.strip(_MARKS) for w in text.lower().split()]


def entries(text: bytes) -> set[bytes]:
    """What a document offers the lexicon: its words, and its words' beginnings marked by a trailing ``*``."""
    words = set(tokens(text)) - {b""}
    return words | {w[:n] + b"*" for w in words for n in STEMS if len(w) > n}


def features(text: bytes, lexicon: Lexicon) -> list[float]:
    """One number per name in ``FEATURES``; defined for empty text too."""
    raw = text.split()
    m, size = max(len(raw), 1), max(len(text), 1)
    words = tokens(text)
    distinct = set(words)
    found = {w: lexicon.words[w] for w in distinct & lexicon.words.keys()}
    stems = {}
    for w in distinct - found.keys():
        for n in STEMS:
            if len(w) > n and (odds := lexicon.stems.get(w[:n] + b"*")) is not None:
                stems[w] = max(odds, stems.get(w, odds))
    low = text.lower()
    inside = _INSIDE.findall(low)
    disguised = 0
    if inside:
        plain = {w.translate(LEET).strip(_MARKS) for w in distinct if _INSIDE.search(w)}
        disguised = sum(w in lexicon.words or any(w[:n] + b"*" in lexicon.stems for n in STEMS) for w in plain)
    hits = found | stems
    near, second = 0, 0
    if hits:
        at = np.array([i for i, w in enumerate(words) if w in hits], np.int64)
        you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON], np.int64)
        second = len(you)
        ahead, behind = np.searchsorted(you, at - NEAR), np.searchsorted(you, at + NEAR, side="right")
        near = int((behind > ahead).sum())
        count = len(at)
    else:
        second, count = sum(w in SECOND_PERSON for w in words), 0
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()))
    weight = sum(hits.values())
    return [
        len(found), len(stems), max(hits.values(), default=0.0), count, count / m, weight, weight / m, disguised, near / m, second / m, counts[65:91].sum() / letters,
        sum(w.isupper() and len(w) > 1 for w in raw) / m, counts[33] / m, counts[63] / m,
        (counts[33:48].sum() + counts[58:65].sum()) / size, (low.count(b"!!") + low.count(b"??")) / m, len(inside) / m,
        len(_STRETCHED.findall(low)) / m, np.log1p(len(raw)), counts[48:58].sum() / size,
    ]


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _entries(text: pd.Series) -> pd.Series:
    return pd.Series([sorted(entries(t)) for t in text])


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> Lexicon:
    """At most ``size`` entries: those in ``LEAST_DOCUMENTS`` documents and more, nearly all of them toxic."""
    base = rows.agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    rate = ((base["toxic"] or 0) + 0.5) / (base["n"] + 1)
    counted = (
        rows.select("label", F.explode(_entries(as_bytes(F.col("text")))).alias("entry"))
        .groupBy("entry").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n"))
        .where((F.col("toxic") >= LEAST_DOCUMENTS) & (F.col("toxic") >= LEAST_SHARE * F.col("n")))
        .orderBy(F.desc("toxic"), "entry").limit(size).collect()
    )
    odds = {bytes(r["entry"]): float(np.log((r["toxic"] + 0.5) / (r["n"] - r["toxic"] + 0.5)) - np.log(rate / (1 - rate))) for r in counted}
    return Lexicon({k: v for k, v in odds.items() if k[-1:] != b"*"}, {k: v for k, v in odds.items() if k[-1:] == b"*"})


def featurizer(lexicon: Lexicon):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def extract(text: pd.Series) -> pd.Series:
        return pd.Series([np.array(features(t, lexicon), float) for t in text])

    return lambda column: extract(as_bytes(column))


@dataclass
class Toxicity:
    """A fitted model: the lexicon, the trees (None: constant) and the calibration's steps."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    bounds: list[float]
    values: list[float]

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` (doc_id, text) as doc_id, score."""
        if self.trees is None:
            return docs.select("doc_id", F.lit(self.values[0]).alias("score"))
        ready = docs.select("doc_id", array_to_vector(featurizer(self.lexicon)(F.col("text"))).alias("features"))
        raw = self.trees.transform(ready).select("doc_id", vector_to_array("probability")[1].alias("p"))
        return raw.select("doc_id", self._calibrated(F.col("p")).alias("score"))

    def _calibrated(self, p):
        """Linear between the steps of the isotonic fit, flat outside them."""
        bounds, values = self.bounds, self.values

        @F.pandas_udf("double")
        def interpolate(column: pd.Series) -> pd.Series:
            return pd.Series(np.interp(column.to_numpy(float), bounds, values))

        return interpolate(p)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Toxicity:
    rows = settle(labelled(docs, labels, "toxic", sample, FOLDS, HELD).withColumn(
        "part", F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(3))))
    counts = {(r["part"], r["label"]): r["n"] for r in rows.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, total = sum(n for (_, label), n in counts.items() if label), sum(counts.values())
    if not all(counts.get((part, label)) for part in (0, 1, 2) for label in (0, 1)):
        return Toxicity(Lexicon({}, {}), None, [0.0], [(toxic + 0.5) / (total + 1)])
    lexicon = learn_lexicon(rows.where("part = 0"))
    extract = featurizer(lexicon)
    ready = settle(rows.where("part > 0").select(
        "doc_id", "part", F.col("label").cast("double").alias("label"), extract(F.col("text")).alias("x")))
    ready = ready.orderBy("doc_id").select("part", "label", array_to_vector("x").alias("features"))  # bounded by the sample
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(ready.where("part = 1"))
    scored = trees.transform(ready.where("part = 2")).select("label", vector_to_array("probability")[1].alias("features"))
    isotonic = IsotonicRegression(featuresCol="features", labelCol="label").fit(scored)
    return Toxicity(lexicon, trees, isotonic.boundaries.toArray().tolist(), np.clip(isotonic.predictions.toArray(), 0, 1).tolist())


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    Null text is empty and gets a score. A null doc_id is never trained on. Repeated rows are scored alike. Where the
    sample lacks a class, every score is the share of toxic labels. Columns beside doc_id and text are not read; an
    empty table gives no rows.
    """
    scored = train(docs, labels, sample).score(id_and_text(docs))
    return scored.select(
        "doc_id", (remainder("doc_id", FOLDS) == HELD).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
