"""Packing documents into token sequences by the sum-of-squares rule.

Documents become token ids by a public tokenizer (a parameter) with an end id after each; only documents longer
than a sequence are cut. Pieces are dealt by hash into groups of about ``GROUP``, a number taken from their count,
so a task's work is bounded at any size. Within a group the pieces, longest first, each go where the sum over gaps
of squared counts of open sequences with that gap becomes smallest; a new sequence is opened only if none fits.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stages import settle
from .common import text_bytes

LENGTH = 2048
END_ID = 0
GROUP = 8192
TOKENIZER = "word_bpe_49k.json"
#: Per generation; the older of two is dropped when the younger is full.
_CACHE_ENTRIES = 300_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts from ids of their white-space chunks, which are kept for the next text.

    Exact for tokenizers that drop white space and never look across it. Texts without combining marks and special
    strings are lower-cased (A-Z) beforehand, as the tokenizer would do itself, so that fewer chunks differ.
    """

    _loaded: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer, self.ids, self.older = Tokenizer.from_file(path), {}, {}
        tokens = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(tokens.values()) + 1, bool)
        self.closing[[i for token, i in tokens.items() if token.endswith("</w>")]] = True

    @classmethod
    def at(cls, path: str) -> WordEncoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, chunks: list[bytes]) -> None:
        """Words of Latin letters go many at a time: each is one group of tokens, whose last closes a word."""
        rest = []
        for c in range(0, len(chunks), 512):
            words, plain = [], []
            for chunk in chunks[c : c + 512]:
                word = chunk.decode()
                simple = word.isalpha() and (word.isascii() or max(word) < "\u0250")
                (plain if simple else rest).append(chunk)
                if simple:
                    words.append(word)
            if not words:
                continue
            (ids,) = self._ids([" ".join(words)])
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(words):
                rest += plain
                continue
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            self.ids.update(zip(plain, (raw[a:b] for a, b in zip([0, *ends], ends))))
        for chunk, ids in zip(rest, self._ids([c.decode() for c in rest])):
            self.ids[chunk] = ids.tobytes()

    def _know(self, chunks: set[bytes]) -> list[bytes]:
        """Of ``chunks``, those that are in neither generation of the cache; what the older one has moves up."""
        new = []
        for chunk in chunks:
            if chunk not in self.ids:
                known = self.older.get(chunk)
                if known is None:
                    new.append(chunk)
                else:
                    self.ids[chunk] = known
        return new

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text:
            text = text.lower()
        chunks = text.split()
        if len(self.ids) > _CACHE_ENTRIES:
            self.ids, self.older = {}, self.ids
        new = self._know(set(chunks))
        if new:
            ended = {c for c in new if len(c) > 1 and c[-1] in b".,!?;:" and (65 <= c[-2] <= 90 or 97 <= c[-2] <= 122)}
            plain = {c for c in new if c not in ended} | {c[:-1] for c in ended} | {c[-1:] for c in ended}
            self._encode(self._know(plain))
            for c in ended:  # a mark after a letter is a token group of its own
                self.ids[c] = self.ids[c[:-1]] + self.ids[c[-1:]]
        return b"".join(map(self.ids.__getitem__, chunks))


def _cut(path: str, length: int, end_id: int, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.at(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    out.append((*row, part) if with_ids else row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return cut


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, on request ids (little-endian unsigned 32-bit)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return text_bytes(docs).mapInArrow(_cut(path or tokenizer_path(), length, end_id, with_ids), schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ``lengths`` should come longest first, none above ``capacity``.

    ``count[g]`` open bins have gap g. Moving one from gap g to g - x changes the sum of squares by
    2 (count[g - x] - count[g]) + 2, without the first term where the bin becomes full. Ties go to the smaller gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins = 0
    for i, x in enumerate(lengths):
        x = int(x)
        fits = False
        if x < capacity:
            there = count[x:capacity]
            change = 2 * (count[: capacity - x] - there) + 2
            change[0] = 1 - 2 * there[0]  # count[0] stays 0: full bins are not open
            rest = int(np.where(there > 0, change, np.iinfo(np.int64).max).argmin())
            fits = there[rest] > 0
        if fits:
            target = open_bins[x + rest].pop()
            count[x + rest] -= 1
            where[i], offset[i] = target, capacity - x - rest
        else:
            rest, target = capacity - x, bins
            where[i], bins = target, bins + 1
        if rest:
            open_bins[rest].append(target)
            count[rest] += 1
    return where, offset


def _place(capacity: int):
    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset = sum_of_squares(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=group["pack"].to_numpy(np.int64) * 2**32 + where, offset=offset).drop(columns="pack")

    return place


def place(cut: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to settled pieces."""
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("pack", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("pack").applyInPandas(_place(length), schema)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. A null doc_id and repeated rows are packed like any others; an empty
    table gives no rows. Sequences are gapless from offset 0 and hold at most ``length`` ids.
    """
    return place(settle(pieces(docs, path, length, end_id)), length, group)


def sequences(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_pieces, ids (little-endian unsigned 32-bit)."""
    placed = place(settle(pieces(docs, path, length, end_id, with_ids=True)), length, group)
    return placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select(
        "sequence_id", F.size("parts").alias("n_pieces"),
        F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"),
    )
