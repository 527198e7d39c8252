"""Interpolated modified Kneser-Ney bigrams, counted in Spark, kept as sorted hash arrays that workers map into memory.

Counting: tasks turn their text into word hashes (whole batches at once), fold equal n-grams and send each shard one
packed block per flush, so what moves is arrays, not rows per token. A first job counts words; a second counts
(previous word, word) pairs, sharded by the previous word. Words that make up more than a thousandth of all tokens
(so fewer than a thousand of them) have their successors spread over ``SPREAD`` shards, and their few sums are added
up afterwards. A third, small shuffle adds up in how many different contexts each word occurs.

Storing: per shard, sorted 64-bit hashes with counts beside them, as raw files in the shared folder: words (count,
number of contexts), contexts (total, left-over weight) and pairs (count). Scoring tasks look a batch's hashes up in
sorted order in the mapped files; only touched pages are read. On a store that cannot be mapped, a task copies the
shards it needs, one at a time, to scratch of its own.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stages import new_path, settle
from .common import SPACE, id_and_text, offsets_and_bytes, remainder

FOLDS, HELD = 7, 2
SPREAD = 64
HOT_SHARE = 1000
FLUSH_TOKENS = 1_500_000
#: Bytes of text that one shard's counts come from.
SHARD_BYTES = 16 << 20
_BATCH_BYTES = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
END, START = _U(0x243F6A8885A308D3), _U(0x13198A2E03707344)
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """base**i and base**-i modulo 2**64, kept for the longest batch met."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up[:n], cls.down[:n]


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a batch of texts, each text closed by END, and where each text's tokens start."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    word = ~SPACE[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _Powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=sums[1:])
    hashes = _mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    texts = len(offsets) - 1
    per_text = np.searchsorted(first, offsets)
    out = np.empty(len(hashes) + texts, np.uint64)
    closing = per_text[1:] + np.arange(texts)
    out[closing] = END
    rest = np.ones(len(out), bool)
    rest[closing] = False
    out[rest] = hashes
    return out, np.concatenate([[0], closing + 1])


def _previous(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty_like(hashes)
    out[1:] = hashes[:-1]
    out[starts[:-1]] = START
    return out


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """By the upper 32 bits, in hash order: shard s has the s-th range of hashes."""
    return ((hashes >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _place(before: np.ndarray, word: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The hash range of a pair: its previous word's, spread by the word where the previous word is hot."""
    if not len(hot):
        return before
    is_hot = np.isin(before, hot)
    spread = _mix(before + (word % _U(SPREAD) + _U(1)) * _U(_BASE))
    return np.where(is_hot, spread, before)


def _pair_key(before: np.ndarray, word: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Upper 16 bits from the place, so that a shard's keys are together, the rest from both words."""
    return (place & _U(0xFFFF << 48)) | (_mix(before * _U(0xD1342543DE82EF95) + word) >> _U(16))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``_BATCH_BYTES`` of text (one text at least) with their tokens."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pa.compute.binary_length(batch.column("text")), np.int64))
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, done + _BATCH_BYTES, side="right")))
            part = batch.slice(start, stop - start)
            yield part, *tokens(*offsets_and_bytes(part.column("text")))
            start = stop


def _fold(key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with summed weights (counts)."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    if weight is None:
        return key[first], np.diff(np.append(first, len(key)))
    return key[first], np.add.reduceat(weight[order].astype(np.int64), first)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, in the type each has."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


_BLOCK_SCHEMA = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("block", pa.binary())])
_BLOCKS = "shard long, n long, m long, block binary"


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOCK_SCHEMA)], schema=_BLOCK_SCHEMA)


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        yield int(s), slice(int(cuts[s]), int(cuts[s + 1]))


def _count_words(shards: int):
    def flush(held: list) -> Iterator[pa.RecordBatch]:
        word, n = _fold(np.concatenate(held))
        yield from _rows([(s, len(word[p]), 0, _packed(word[p], n[p].astype(np.uint32)))
                          for s, p in _by_shard(_shard_of(word, shards), shards)])

    def run(batches):
        held, size = [], 0
        for _, hashes, _ in _batches(batches):
            held.append(hashes)
            size += len(hashes)
            if size >= FLUSH_TOKENS:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _count_pairs(shards: int, hot: np.ndarray):
    """Blocks of pairs: m distinct previous words with their numbers of entries, then n words and their counts."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        before, word = (np.concatenate(x) for x in zip(*held))
        place = _place(before, word, hot)
        order = np.lexsort((word, before, _shard_of(place, shards)))
        before, word, place = before[order], word[order], place[order]
        new = np.concatenate([[True], (before[1:] != before[:-1]) | (word[1:] != word[:-1]) | (place[1:] != place[:-1])])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(word))).astype(np.uint32)
        before, word, place = before[first], word[first], place[first]
        rows = []
        for s, p in _by_shard(_shard_of(place, shards), shards):
            heads, runs = _runs(before[p])
            rows.append((s, len(word[p]), len(heads), _packed(heads, runs.astype(np.uint32), word[p], n[p])))
        yield from _rows(rows)

    def run(batches):
        held, size = [], 0
        for _, hashes, starts in _batches(batches):
            held.append((_previous(hashes, starts), hashes))
            size += len(hashes)
            if size >= FLUSH_TOKENS:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key)))


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _write(folder: str, name: str, *arrays: np.ndarray) -> None:
    """One file per array, put in place by a rename, so a repeated task leaves whole files."""
    files, root = _open(folder)
    for k, array in enumerate(arrays):
        there, draft = f"{root}/{name}.{k}", f"{root}/{name}.{k}.{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            out.write(memoryview(np.ascontiguousarray(array)).cast("B") if len(array) else b"")
        files.move(draft, there)


class Mapped:
    """A file of one shard as an array: mapped where the store is mounted, else copied to the task's scratch."""

    def __init__(self, folder: str, present: dict[str, frozenset[int]]):
        self.files, self.root = _open(folder)
        self.present = present
        self.scratch = None if isinstance(self.files, pafs.LocalFileSystem) else tempfile.TemporaryDirectory()
        self.held: dict[str, np.ndarray] = {}

    def get(self, name: str, kind) -> np.ndarray:
        if name not in self.held:
            path = f"{self.root}/{name}"
            if self.scratch is not None:
                for old in list(self.held) if len(self.held) >= 8 else []:  # what is copied stays few
                    self.held.pop(old)
                    os.unlink(f"{self.scratch.name}/{old}")
                local = f"{self.scratch.name}/{name}"
                with self.files.open_input_stream(path) as source, open(local, "wb") as out:
                    while piece := source.read(1 << 22):
                        out.write(piece)
                path = local
            self.held[name] = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        return self.held[name]

    def find(self, name: str, shards: int, shard: np.ndarray, key: np.ndarray, kinds: tuple) -> list[np.ndarray]:
        """Values of sorted keys, zero where a key is not there; ``shard`` goes up with the keys."""
        out = [np.zeros(len(key), kind) for kind in kinds]
        for s, p in _by_shard(shard, shards):
            if s not in self.present[name]:
                continue
            keys = self.get(f"{name}-{s}.0", np.uint64)
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, key[p]), len(keys) - 1)
            hit = keys[at] == key[p]
            for k, (values, kind) in enumerate(zip(out, kinds)):
                values[p][hit] = self.get(f"{name}-{s}.{k + 1}", kind)[at[hit]]
        return out


_SUMS = "shard long, tokens long, kinds long, c1 long, c2 long, c3 long, c4 long, hot array<struct<word:long,n:long>>"


def _histogram(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _parts(group, *kinds):
    """The arrays of all blocks of a group; lengths are n, or m for kinds given as (m, kind)."""
    out = [[] for _ in kinds]
    for n, m, block in zip(group["n"], group["m"], group["block"]):
        at = 0
        for k, kind in enumerate(kinds):
            size, kind = (m, kind[1]) if isinstance(kind, tuple) else (n, kind)
            out[k].append(np.frombuffer(block, kind, size, at))
            at += size * np.dtype(kind).itemsize
    return [np.concatenate(x) for x in out]


def _merge_words(folder: str, hot_from: int):
    """Adds up counts of a shard of words, writes them, and hands on sums and the words that may be hot."""
    import pandas as pd

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        word, n = _fold(*_parts(group, np.uint64, np.uint32))
        _write(folder, f"words-{shard}", word, n.astype(np.uint64))
        large = np.flatnonzero(n >= hot_from)
        hot = [{"word": int(w), "n": int(c)} for w, c in zip(word[large].view(np.int64), n[large])]
        return pd.DataFrame([{"shard": shard, "tokens": int(n.sum()), "kinds": len(word), "c1": 0, "c2": 0, "c3": 0, "c4": 0, "hot": hot}])

    return merge


_PAIR_SUMS = (
    "shard long, c1 long, c2 long, c3 long, c4 long, hot array<struct<word:long,total:long,n1:long,n2:long,n3:long>>, "
    "n long, block binary, target long")


def _merge_pairs(folder: str, shards: int, hot: np.ndarray):
    """Adds up counts of a shard of pairs, writes pairs and contexts, and hands on contexts per word."""
    import pandas as pd

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        heads, runs, word, n = _parts(group, (0, np.uint64), (0, np.uint32), np.uint64, np.uint32)
        before = np.repeat(heads, runs)
        order = np.lexsort((word, before))
        before, word, n = before[order], word[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (word[1:] != word[:-1])]))
        n = np.add.reduceat(n, first)
        before, word = before[first], word[first]
        key = _pair_key(before, word, _place(before, word, hot))
        order = np.argsort(key)
        _write(folder, f"pairs-{shard}", key[order], n[order].astype(np.uint32))
        at = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        context = before[at]
        total, n1, n2, n3 = (np.add.reduceat(x.astype(np.int64), at) for x in (n, n == 1, n == 2, n >= 3))
        own = np.isin(context, hot)
        sums = [{"word": int(w), "total": int(t), "n1": int(a), "n2": int(b), "n3": int(c)}
                for w, t, a, b, c in zip(context[own].view(np.int64), total[own], n1[own], n2[own], n3[own])]
        cold = ~own
        _write(folder, f"contexts-{shard}", context[cold], total[cold].astype(np.uint64),
               *(x[cold].astype(np.uint32) for x in (n1, n2, n3)))
        word, contexts = _fold(word)
        out = [{"shard": shard, **dict(zip(("c1", "c2", "c3", "c4"), _histogram(n))), "hot": sums, "n": 0, "block": None, "target": None}]
        out += [{"shard": shard, "c1": 0, "c2": 0, "c3": 0, "c4": 0, "hot": [], "n": len(word[p]), "target": s,
                 "block": _packed(word[p], contexts[p].astype(np.uint32))} for s, p in _by_shard(_shard_of(word, shards), shards)]
        return pd.DataFrame(out)

    return merge


def _merge_contexts(folder: str):
    """Adds up in how many contexts each word of a shard occurs and writes it."""
    import pandas as pd

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["target"].iloc[0])
        word, n = _fold(*_parts(group.assign(m=0), np.uint64, np.uint32))
        _write(folder, f"follows-{shard}", word, n.astype(np.uint64))
        return pd.DataFrame([{"shard": shard, "tokens": int(n.sum()), "kinds": len(word), **dict(zip(("c1", "c2", "c3", "c4"), _histogram(n))),
                              "hot": [{"word": 0, "n": int((n >= 3).sum())}]}])

    return merge


def discounts(c1: int, c2: int, c3: int, c4: int) -> tuple[float, float, float]:
    """For counts 1, 2, 3 and more, from how many n-grams occur one to four times; kept between 0 and the count.

    Where the text is too small for the estimate, a half of one is taken off.
    """
    if not c1 or not c2 or not c3:
        return 0.5, 0.5, 0.5
    y = c1 / (c1 + 2 * c2)
    raw = (1 - 2 * y * c2 / c1, 2 - 3 * y * c3 / c2, 3 - 4 * y * c4 / c3)
    return tuple(min(max(d, 0.0), float(k + 1)) if d > 0 else 0.5 for k, d in enumerate(raw))


@dataclass(frozen=True)
class Model:
    """Where the arrays lie and the few numbers beside them."""

    folder: str
    shards: int
    tokens: int
    kinds: int
    pair_discounts: tuple
    word_discounts: tuple
    contexts_total: int
    left_over: float  # weight of the uniform distribution in that of the words
    hot: dict  # previous word: (total, n1, n2, n3)
    present: dict  # kind of array: the shards that have any (at most 2**16 numbers)


def _shards(sums: DataFrame) -> frozenset[int]:
    return frozenset(r["shard"] for r in sums.select("shard").distinct().collect())


def train(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Model:
    """Count all texts of ``docs``; nothing is left out, whatever their number."""
    spark = docs.sparkSession
    folder = new_path(spark, "bigrams")
    if "://" not in folder:
        folder = folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}"
    spark.createDataFrame([(0,)], "x int").write.parquet(f"{folder}/made")  # the folder itself, on any store
    plain = id_and_text(docs).select(F.col("text").cast("binary").alias("text"))
    size = id_and_text(docs).agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    shards = max(4, min(1 << 16, -(-size // shard_bytes)))

    words = plain.mapInArrow(_count_words(shards), _BLOCKS)
    hot_from = max(1, size // (16 * HOT_SHARE))  # a word and its space take a byte at least, so N is size / 16 or more in prose
    sums = settle(words.groupBy("shard").applyInPandas(_merge_words(folder, hot_from), _SUMS))
    total = sums.agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    n, v = total["n"] or 0, total["v"] or 0
    frequent = (sums.select(F.explode("hot").alias("h")).where(F.col("h.n") * HOT_SHARE > n)
                .select("h.word").limit(HOT_SHARE).collect()) if n else []
    hot = np.array([r["word"] for r in frequent] + [int(START.view(np.int64))], np.int64).view(np.uint64)

    pairs = plain.mapInArrow(_count_pairs(shards, hot), _BLOCKS)
    merged = settle(pairs.groupBy("shard").applyInPandas(_merge_pairs(folder, shards, hot), _PAIR_SUMS))
    counted = merged.agg(*[F.sum(c).alias(c) for c in ("c1", "c2", "c3", "c4")]).first()
    hot_rows = (merged.select(F.explode("hot").alias("h")).groupBy("h.word")
                .agg(*[F.sum(f"h.{c}").alias(c) for c in ("total", "n1", "n2", "n3")]).collect())  # fewer than a thousand
    follows = settle(merged.where("target IS NOT NULL").groupBy("target").applyInPandas(_merge_contexts(folder), _SUMS))
    w = follows.agg(*[F.sum(c).alias(c) for c in ("tokens", "kinds", "c1", "c2", "c3", "c4")], F.sum(F.col("hot")[0]["n"]).alias("more")).first()
    word_discounts = discounts(*[w[c] or 0 for c in ("c1", "c2", "c3", "c4")])
    left = sum(d * (w[c] or 0) for d, c in zip(word_discounts, ("c1", "c2", "more")))
    return Model(
        folder, shards, n, v, discounts(*[counted[c] or 0 for c in ("c1", "c2", "c3", "c4")]), word_discounts,
        w["tokens"] or 0, left / w["tokens"] if w["tokens"] else 1.0,
        {r["word"] & _MASK: (r["total"], r["n1"], r["n2"], r["n3"]) for r in hot_rows},
        {"words": _shards(sums), "pairs": (both := _shards(merged)), "contexts": both, "follows": _shards(follows)},
    )


def _less(n: np.ndarray, by: tuple) -> np.ndarray:
    return np.maximum(n - np.array([0.0, *by])[np.minimum(n, 3).astype(np.int64)], 0.0)


def _score(model: Model):
    hot = np.sort(np.array([*model.hot], np.uint64))
    hot_values = np.array([model.hot[int(h)] for h in hot], float).reshape(-1, 4)

    def log_probabilities(mapped: Mapped, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's probability, and each token's count in training."""
        s = model.shards
        words, inverse = np.unique(np.append(hashes, START), return_inverse=True)
        shard = _shard_of(words, s)
        (count,) = mapped.find("words", s, shard, words, (np.uint64,))
        (follow,) = mapped.find("follows", s, shard, words, (np.uint64,))
        follow = follow.astype(np.int64)
        base = (_less(follow, model.word_discounts) / max(model.contexts_total, 1)) + model.left_over / (model.kinds + 1)
        total, n1, n2, n3 = (x.astype(float) for x in mapped.find(
            "contexts", s, shard, words, (np.uint64, np.uint32, np.uint32, np.uint32)))
        if len(hot):
            at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
            own = hot[at] == words
            total[own], n1[own], n2[own], n3[own] = hot_values[at[own]].T
        d = model.pair_discounts
        known = np.maximum(total, 1)
        left = np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / known, 1.0)
        token = inverse[:-1]
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[starts[:-1]] = inverse[-1]
        place = _place(words[before], hashes, hot)
        key = _pair_key(words[before], hashes, place)
        order = np.lexsort((key, _shard_of(place, s)))
        (found,) = mapped.find("pairs", s, _shard_of(place, s)[order], key[order], (np.uint32,))
        pair = np.zeros(len(key), np.int64)
        pair[order] = found
        p = _less(pair, d) / known[before] + left[before] * base[token]
        return np.log10(p), count.astype(np.int64)[token]

    def run(batches):
        mapped = Mapped(model.folder, model.present)
        scale = math.log10(model.tokens + model.kinds + 1)
        for part, hashes, starts in _batches(batches):
            logs, count = log_probabilities(mapped, hashes, starts)
            sizes = np.diff(starts)
            rows = pa.array(np.full(part.num_rows, model.tokens, np.int64))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("held_out"), pa.array(sizes),
                pa.array(np.add.reduceat((count > 0).astype(np.int64), starts[:-1])), rows,
                pa.array(np.add.reduceat(np.log10(count + 1.0), starts[:-1]) - sizes * scale),
                pa.array(np.add.reduceat(logs, starts[:-1])),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, held_out): token counts, add-one and model log10 probabilities."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("text")).mapInArrow(_score(model), schema)


def score_held_out(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Train on the documents whose id hash modulo ``FOLDS`` is not ``HELD`` and score them all.

    Null text is empty: its one token is the end. A null doc_id hashes as the empty text. Repeated rows count and are
    scored as often as they are there. Without training text every token gets the uniform share of one unknown word.
    An empty table gives no rows. The perplexity of a text is 10 ** (-score / n_tokens).
    """
    marked = id_and_text(docs).withColumn("held_out", remainder("doc_id", FOLDS) == HELD)
    return score(marked, train(marked.where(~F.col("held_out")), shard_bytes))
