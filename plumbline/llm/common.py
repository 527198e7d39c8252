"""What several of the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import quoted

#: ASCII white space: what separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, null text as empty; whatever else the table holds is out of the way."""
    return docs.select(
        F.col(quoted(id_column)).cast("long").alias("doc_id"),
        F.coalesce(F.col(quoted(text_column)).cast("string"), F.lit("")).alias("text"),
    )


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, nor would have with more underscores behind."""
    taken = [c.lower() for c in df.columns]
    return [next(n for k in range(len(taken) + 1) if not any(t.startswith(n := f"_{name}{k}") for t in taken)) for name in names]


def docs_columns(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def text_bytes(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("text", F.col("text").cast("binary"))


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def return_memory() -> None:
    """Hand Arrow's free buffers back to the system: a worker lives on between stages, and a batch of texts is large."""
    pa.default_memory_pool().release_unused()


def regrouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` arrive in batches; pass them on in tables that never cut a run of one key in two.

    Memory holds one run beside the batch at hand.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        if held and held[-1].column(key)[-1] != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = keys[len(keys) - 1]
        if keys[0] != last:
            codes = np.flatnonzero(np.asarray(pa.compute.not_equal(keys, last)))
            cut = int(codes[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def offsets_and_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets (one more than rows) and the joined bytes of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or buffers[2] is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data
