"""From raw documents to packed training sequences, as five stages over the ``documents`` table.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of their input. Where a stage drops rows it drops whole documents; a secret is cut out of its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.stages import new_path
from plumbline.llm import exact_dedup, packing, quality, secret_scan, simhash_dedup
from plumbline.llm.common import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.drop_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints (op10's 4-word shingles and four bits; looser copies stay), the document with the smallest doc_id."""
    return simhash_dedup.drop_near_copies(docs)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets found in its text replaced by a mark and n_chars following the text."""
    clean = secret_scan.redact(docs, new_path(spark, "ledger"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("secrets", cut_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: A fitted model, fingerprints and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE = {}
