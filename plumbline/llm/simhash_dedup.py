"""SimHash near-duplicates: fingerprints of word shingles, linked by pivot distance tables (see ``hamming``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from ..functions.stages import settle
from .components import components
from .common import docs_columns, return_memory, spare_names, text_bytes
from .hamming import BLOCK, PIVOTS, links

WORDS = 4
LIMIT = 4
SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is set if it is in over half the shingle hashes; no word gives zero."""
    parts = text.lower().split()  # bytes: A-Z only, and ASCII white space
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends, starts, at = [], [0], -1
    for part in parts:
        at += len(part) + 1
        ends.append(at)
        starts.append(at + 1)
    n = max(1, len(parts) - words + 1)
    first = ends[words - 1 :] if len(parts) >= words else [len(joined)]
    counts = np.zeros(64, np.int64)
    for c in range(0, n, _CHUNK):
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[c : min(n, c + _CHUNK)], first[c : c + _CHUNK])], np.uint64)
        counts += _bit_counts(hashes)
    set_bits = np.flatnonzero(2 * counts > n)
    return int(sum(1 << int(k) for k in set_bits))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit: runs of 255 are added in bytes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    out = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        out = out + np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    return out


def _prints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    return text_bytes(docs).mapInArrow(_prints(words, seed), "doc_id long, fp long")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, limit: int = LIMIT, block: int = BLOCK, pivot_count: int = PIVOTS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (hex), component_id (smallest doc_id reachable over links).

    A null text counts as empty; texts without a word have fingerprint zero and link like any other. A null doc_id
    takes part but is never the smallest unless its component has no other. Repeated rows stay repeated; an empty
    table gives no rows.
    """
    prints = settle(fingerprints(docs, words))
    return prints.join(_named(prints, limit, block, pivot_count), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(prints: DataFrame, limit: int, block: int, pivot_count: int) -> DataFrame:
    """fp, root (a fingerprint of the component), component_id; one row per distinct fingerprint, settled."""
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = settle(components(links(classes, limit, block, pivot_count), "a", "b"))
    rooted = classes.join(roots, F.col("fp") == F.col("vertex"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return settle(rooted.join(settle(smallest), "root").select("fp", "root", "component_id"))


def drop_near_copies(
    docs: DataFrame, words: int = WORDS, limit: int = LIMIT, block: int = BLOCK, pivot_count: int = PIVOTS,
) -> DataFrame:
    """One row of ``docs`` per component, with all its columns: the one whose doc_id names the component.

    Should several rows have that doc_id, the one with the smallest fingerprint stays, and any one of equals.
    """
    print_name, turn = spare_names(docs, "fp", "turn")

    @F.pandas_udf("long")
    def own(text: pd.Series) -> pd.Series:
        found = pd.Series(np.array([fingerprint(t, words) for t in text], np.uint64).view(np.int64))
        return_memory()
        return found

    # Each text is fingerprinted once; the rows are written with it.
    marked = settle(docs.withColumn(print_name, own(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))
    prints = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(print_name).alias("fp"))
    named = _named(prints, limit, block, pivot_count)
    stay = (
        prints.join(named, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root").agg(F.min("fp").alias("fp"), F.first("component_id").alias("id"))
        .select(F.col("fp").alias(f"{print_name}_"), F.col("id").alias(f"{turn}_"))
    )
    rows = marked.join(
        settle(stay), (F.col(print_name) == F.col(f"{print_name}_")) & F.col("doc_id").cast("long").eqNullSafe(F.col(f"{turn}_")))
    order = Window.partitionBy(print_name, "doc_id").orderBy("doc_id")
    return rows.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).select(*docs_columns(docs))
