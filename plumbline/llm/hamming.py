"""Links between 64-bit fingerprints that differ in few bits, found with pivot distance tables.

Every distinct fingerprint carries its Hamming distances to a fixed set of reference fingerprints. Within a block
of fingerprints two of them can be ``limit`` bits apart only if no coordinate of their tables differs by more
(triangle inequality), so pairs are discarded by the largest coordinate difference and the survivors verified. A
pivot table alone would have to compare all pairs; the blocks come from the pigeonhole principle: cut the bits in
``limit + 1`` segments, and a pair within the limit agrees on one of them. A block with more than ``BLOCK``
members is cut again by the same argument over the bits that its members are not yet known to share, so no task
gets an unbounded block and no pair is lost. A block hands on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stages import settle
from .common import regrouped

BLOCK = 1024
PIVOTS = 16

#: Row k of the 64 x 64 Walsh matrix as bits: any two rows differ in 32 places, so the references are well spread.
_WALSH = [sum(((bin(row & column).count("1") & 1) << column) for column in range(64)) for row in range(64)]


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: evenly chosen rows of the Walsh matrix."""
    return np.array([_WALSH[(i * 64 // count + i) % 64] for i in range(count)], np.uint64)


def distance_table(fingerprints: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fingerprints[:, None] ^ references[None, :]).astype(np.int8)


def _segments(bits: list[int], parts: int) -> list[list[int]]:
    return [list(s) for s in np.array_split(np.array(bits), parts)]


def near_pairs(fingerprints: np.ndarray, table: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j in the order of the first coordinate) within ``limit`` bits, pivots first, then verified."""
    order = np.argsort(table[:, 0], kind="stable")
    fingerprints, table = fingerprints[order], table[order]
    ends = np.searchsorted(table[:, 0], table[:, 0].astype(np.int16) + limit, side="right")
    lefts, rights, start = [], [], 0
    n = len(fingerprints)
    while start < n:
        stop, room = start, 1 << 20  # pairs looked at together
        while stop < n and (room := room - int(ends[stop] - stop)) > 0:
            stop += 1
        stop = max(stop, start + 1)
        widths = ends[start:stop] - np.arange(start, stop) - 1
        i = np.repeat(np.arange(start, stop), widths)
        j = np.arange(len(i)) - np.repeat(np.cumsum(widths) - widths, widths) + i + 1
        for k in range(1, table.shape[1]):
            if not len(i):
                break
            near = np.abs(table[i, k] - table[j, k]) <= limit
            i, j = i[near], j[near]
        near = np.bitwise_count(fingerprints[i] ^ fingerprints[j]) <= limit
        lefts.append(order[i[near]])
        rights.append(order[j[near]])
        start = stop
    return np.concatenate(lefts), np.concatenate(rights)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each member's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        root = root[root]
        if (root == before).all():
            return root


def _link(limit: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in regrouped(batches, "block"):
            keys = run.column("block").to_numpy()
            prints = run.column("fp").to_numpy().view(np.uint64)
            flat = np.frombuffer(b"".join(run.column("table").to_pylist()), np.int8)
            table = flat.reshape(len(keys), -1)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            one, other = [], []
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
                if b - a < 2:
                    continue
                i, j = near_pairs(prints[a:b], table[a:b], limit)
                if len(i):
                    root = forest(b - a, i, j)
                    member = np.flatnonzero(root != np.arange(b - a))
                    one.append(prints[a:b][member])
                    other.append(prints[a:b][root[member]])
            if one:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).view(np.int64)) for x in (one, other)], names=["a", "b"])

    return link


def _cut(limit: int):
    """One row per (fingerprint, segment): the block is a hash of the block so far and the segment's bits.

    ``known`` has a bit for each position on which the members of the block agree.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy().view(np.uint64)
            known = batch.column("known").to_numpy().view(np.uint64)
            block = batch.column("block").to_numpy().view(np.uint64)
            for have in np.unique(known):
                at = np.flatnonzero(known == have)
                bits = [k for k in range(64) if not int(have) >> k & 1]
                for number, segment in enumerate(_segments(bits, limit + 1)):
                    mask = np.uint64(sum(1 << int(k) for k in segment))
                    with np.errstate(over="ignore"):
                        key = (block[at] + np.uint64(number + 1)) * np.uint64(0x9E3779B97F4A7C15)
                        key = (key ^ (key >> np.uint64(29)) ^ (prints[at] & mask)) * np.uint64(0xBF58476D1CE4E5B9)
                        key ^= key >> np.uint64(32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(prints[at].view(np.int64)), batch.column("table").take(pa.array(at)),
                        pa.array(np.full(len(at), have | mask, np.uint64).view(np.int64)), pa.array(key.view(np.int64)),
                    ], names=["fp", "table", "known", "block"])

    return cut


def _with_tables(count: int):
    references = pivots(count)

    def add(batches):
        for batch in batches:
            prints = batch.column("fp").to_numpy().view(np.uint64)
            rows = distance_table(prints, references)
            zero = pa.array(np.zeros(len(prints), np.int64))
            table = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("fp"), table, zero, zero], names=["fp", "table", "known", "block"])

    return add


_ROWS = "fp long, table binary, known long, block long"


def links(fingerprints: DataFrame, limit: int, block: int = BLOCK, count: int = PIVOTS) -> DataFrame:
    """``a``, ``b``: enough links between distinct ``fp`` within ``limit`` bits to span every connected group."""
    rows = fingerprints.select("fp").mapInArrow(_with_tables(count), _ROWS)
    out = None
    while True:
        rows = settle(rows.mapInArrow(_cut(limit), _ROWS))
        sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > block)
        large = settle(sizes.select("block"))
        some = large.limit(1).count() > 0
        # All 64 bits known: the block is one fingerprint, however often it came.
        small = rows.join(large, "block", "left_anti") if some else rows
        ready = small.repartition("block").sortWithinPartitions("block").mapInArrow(_link(limit), "a long, b long")
        out = ready if out is None else out.unionByName(ready)
        if not some:
            return out
        rows = rows.join(large, "block", "left_semi").where(F.col("known") != -1).select("fp", "table", "known", "block")
