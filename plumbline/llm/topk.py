"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, a merge tree per query.

Vectors become integer matrices of at most ``TILE`` rows, packed by the tasks that read them. Queries and candidates
meet tile by tile: each query tile is sent to every shard of candidate tiles, which is the stated query set
against all rows, in blocks. A tile product keeps its best k per query, and the lists of a query are merged in
groups of ``FAN``, level by level, so no task gets all lists of a query at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stages import settle

K = 5
TILE = 4096
QUERY_TILE = 1024
SHARD_TILES = 4
FAN = 32
SCALE = 256
_TILE_ROWS = "n int, width int, largest double, ids binary, matrix binary"
_EXACT = float(2**53)
_LONG = 2**63 - 1


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as doubles; a product by a power of two and the floor are exact."""
    return np.floor(values.astype(np.float64) * scale)


def _pack(rows: int, scale: int):
    """Arrow batches of (vec_id, embedding) to tiles of vectors of one width; unusable vectors drop out."""

    def tiles(width: int, ids: list, vectors: list) -> pa.RecordBatch:
        ids, vectors = np.concatenate(ids), np.concatenate(vectors)
        cuts = range(0, len(ids), rows)
        return pa.RecordBatch.from_arrays([
            pa.array([len(ids[c : c + rows]) for c in cuts], pa.int32()), pa.array([width] * len(cuts), pa.int32()),
            pa.array([float(np.abs(vectors[c : c + rows]).max(initial=0)) for c in cuts]),
            pa.array([ids[c : c + rows].tobytes() for c in cuts], pa.binary()),
            pa.array([vectors[c : c + rows].tobytes() for c in cuts], pa.binary()),
        ], names=["n", "width", "largest", "ids", "matrix"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            lists = batch.column(1)
            lengths = np.asarray(lists.value_lengths().fill_null(-1))
            flat = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan))
            ids = np.asarray(batch.column(0))
            starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))[:-1]]).astype(np.int64)
            for width in np.unique(lengths[lengths >= 0]).tolist():
                at = np.flatnonzero(lengths == width)
                matrix = integers(flat[starts[at][:, None] + np.arange(width)], scale)
                good = np.isfinite(matrix).all(1)
                parts = held.setdefault(width, [0, [], []])
                parts[0] += int(good.sum())
                parts[1].append(ids[at][good])
                parts[2].append(matrix[good])
                if parts[0] >= rows:
                    yield tiles(width, *held.pop(width)[1:])
        for width, (n, ids, vectors) in held.items():
            if n:
                yield tiles(width, ids, vectors)

    return pack


def _tiles(vectors: DataFrame, rows: int, scale: int) -> DataFrame:
    return vectors.mapInArrow(_pack(rows, scale), _TILE_ROWS)


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k highest (score, id) of one query against one tile, ties to the smaller id, without the query's own row."""
    usable = np.flatnonzero(ids != own)
    if len(usable) > k:
        values = scores[usable]
        edge = np.partition(values, len(values) - k)[len(values) - k]
        usable = usable[values >= edge]
    order = np.lexsort((ids[usable], -scores[usable])) if scores.dtype != object else sorted(
        range(len(usable)), key=lambda i: (-scores[usable[i]], ids[usable[i]]))
    return [(int(scores[usable[i]]), int(ids[usable[i]])) for i in order[:k]]


def _multiply(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("shard", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("over", pa.float64())])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()
                width = get("width")
                q_ids, c_ids = np.frombuffer(get("q_ids"), np.int64), np.frombuffer(get("ids"), np.int64)
                q = np.frombuffer(get("q_matrix")).reshape(-1, width)
                c = np.frombuffer(get("matrix")).reshape(-1, width)
                if get("q_largest") * get("largest") * max(width, 1) < _EXACT:
                    scores = q @ c.T
                else:  # Python integers: as exact, and slow
                    whole = np.frompyfunc(int, 1, 1)
                    scores = whole(q).astype(object) @ whole(c).astype(object).T if width else np.zeros((len(q), len(c)))
                out = [(int(own), get("shard"), i, max(-_LONG - 1, min(_LONG, s)), float(s))
                       for own, line in zip(q_ids, scores) for s, i in _best(line, c_ids, int(own), k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return multiply


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, scale: int = SCALE, tile: int = TILE, fan: int = FAN) -> DataFrame:
    """The ``k`` best ``vectors`` of each row of ``queries``: query_id, rank, vec_id, score.

    Both have ``vec_id`` and ``embedding``. Components x count as floor(scale * x); the score is the integer inner
    product, one beyond the long range is shown as the range's end but ranked by its size. Vectors that are null or
    hold null, NaN or infinite components take no part, nor do rows with a null id; vectors of different widths do not
    meet. A query never meets rows of its own id. Ties go to the smaller id; a repeated row counts as often as it is
    there; a query with nobody to meet has no rows, nor has an empty table.
    """
    def usable(df):
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
            F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())

    candidates = settle(_tiles(usable(vectors), tile, scale))
    shards = max(1, -(-candidates.count() // SHARD_TILES))
    shard = F.pmod(F.xxhash64("ids"), F.lit(shards))
    asked = _tiles(usable(queries), QUERY_TILE, scale).select(
        F.col("width").alias("q_width"), F.col("largest").alias("q_largest"), F.col("ids").alias("q_ids"),
        F.col("matrix").alias("q_matrix"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("q_shard"),
    )
    pairs = candidates.withColumn("shard", shard).join(
        asked.hint("merge"), (F.col("shard") == F.col("q_shard")) & (F.col("width") == F.col("q_width")))
    lists = pairs.mapInArrow(_multiply(k), "query_id long, shard long, vec_id long, score long, over double")

    def merged(lists: DataFrame, *group: str) -> DataFrame:
        w = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("over"), "vec_id")
        return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    while shards > fan:
        shards = -(-shards // fan)
        lists = merged(lists.withColumn("shard", F.floor(F.col("shard") / fan)), "query_id", "shard").drop("rank")
    return merged(lists, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def every_fiftieth(vectors: DataFrame) -> DataFrame:
    """The stated query set: ids divisible by 50."""
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)
