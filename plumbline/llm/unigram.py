"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces and log scores come from a public model file (a parameter); nothing is trained here. A text is
normalised as the file says it should be (here: a marker in front, spaces as markers), cut before markers, and each
stretch gets the segmentation with the highest total score. Cutting there is exact because no piece has a marker
behind another character; the loader checks that. A character that no piece covers becomes its UTF-8 bytes' pieces.

Stretches are segmented many at a time: all of one batch walk the trie together, position by position.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

MODEL = "piece_bpe_32k.model"
MARKER = "▁".encode()
_CACHE_ENTRIES = 300_000
_LONG_STRETCH = 256
#: Stretches segmented at once, and texts whose stretches are gathered for that.
_TOGETHER = 16_384
_TEXTS = 512
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: How far below the lowest score an uncovered character lies.
_PENALTY = 10.0


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def read_pieces(path: str) -> list[tuple[bytes, float, int]]:
    """Piece, score and kind, in the order of their ids."""
    with open(path, "rb") as file:
        data = file.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            entry = dict(_fields(value))
            out.append((entry.get(1, b""), struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0, entry.get(3, NORMAL)))
    return out


class DoubleArray:
    """A trie in two arrays: a node's child for byte c is at base[node] + c + 1 if check there is the node.

    The child for the end of a key is at base[node] and holds the key's value.
    """

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self._size = 0
        self.base, self.check, self.value = (np.zeros(0, np.int32) for _ in range(3))
        self._grow(1 << 16)
        self.check[0] = 0
        self._free = 1
        stack = [(0, 0, len(order), 0)]
        while stack:
            node, low, high, depth = stack.pop()
            children, at = [], low
            ending = -1
            if at < high and len(keys[order[at]]) == depth:
                ending, at = order[at], at + 1
                children.append((0, ending, ending))
            while at < high:
                code, end = keys[order[at]][depth], at
                while end < high and keys[order[end]][depth] == code:
                    end += 1
                children.append((code + 1, at, end))
                at = end
            base = self._place([c for c, _, _ in children])
            self.base[node] = base
            for code, a, b in children:
                self.check[base + code] = node
                if code == 0:
                    self.value[base] = ending
                else:
                    stack.append((base + code, a, b, depth + 1))
        self.base, self.check, self.value = (x[: self._size + 258] for x in (self.base, self.check, self.value))

    def _grow(self, size: int) -> None:
        for name in ("base", "check", "value"):
            old = getattr(self, name)
            new = np.full(size, -1, np.int32)
            new[: len(old)] = old
            setattr(self, name, new)

    def _place(self, codes: list[int]) -> int:
        while self._free < len(self.check) and self.check[self._free] != -1:
            self._free += 1
        base = max(1, self._free - codes[0])
        while True:
            if base + 300 > len(self.check):
                self._grow(2 * len(self.check))
            if all(self.check[base + c] == -1 for c in codes):
                self._size = max(self._size, base + codes[-1])
                return base
            base += 1

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Children of nodes for bytes, -1 where there is none."""
        to = self.base[nodes] + codes + 1
        return np.where(self.check[to] == nodes, to, -1)

    def ends(self, nodes: np.ndarray) -> np.ndarray:
        """Key numbers that end at nodes, -1 where none does."""
        to = self.base[nodes]
        return np.where(self.check[to] == nodes, self.value[to], -1)


class Unigram:
    _loaded: dict[str, Unigram] = {}

    def __init__(self, pieces: list[tuple[bytes, float, int]]):
        self.pieces = pieces
        usable = [i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p]
        for i in usable:
            body = pieces[i][0].replace(MARKER, b"\0").lstrip(b"\0")
            if b"\0" in body:
                raise ValueError("A piece has a marker behind another character; stretches would not be exact.")
        self.ids = np.array(usable, np.int32)
        self.trie = DoubleArray([pieces[i][0] for i in usable])
        self.scores = np.array([pieces[i][1] for i in usable])
        self.lengths = np.array([len(pieces[i][0]) for i in usable], np.int32)
        self.longest = int(self.lengths.max(initial=0))
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.floor = float(self.scores.min(initial=0.0)) - _PENALTY
        self.lists = tuple(x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value))
        self.score_list = self.scores.tolist()
        self.written = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARKER, b" ") if kind in (NORMAL, USER) else b""
            for p, _, kind in pieces
        ]
        self.cache: dict[bytes, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Unigram:
        if path not in cls._loaded:
            cls._loaded[path] = cls(read_pieces(path))
        return cls._loaded[path]

    def segment(self, stretches: list[bytes]) -> list[np.ndarray]:
        """Best ids of each stretch. Of equal totals the one found first stays, whose pieces begin earlier."""
        slow = {i: self._one(s) for i, s in enumerate(stretches) if len(s) > _LONG_STRETCH}
        if slow:
            rest = iter(self.segment([s for i, s in enumerate(stretches) if i not in slow]))
            return [slow[i] if i in slow else next(rest) for i in range(len(stretches))]
        sizes = np.array([len(s) for s in stretches], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        data = np.frombuffer(b"\0".join(stretches) + b"\0", np.uint8).astype(np.int32)
        total = len(data)
        best = np.full(total, -np.inf)
        best[offsets[:-1]] = 0.0
        back, piece = np.zeros(total, np.int32), np.full(total, -1, np.int32)
        width = np.ones(total, np.int32)  # bytes of the character that begins here
        width[data >= 0xC0], width[data >= 0xE0], width[data >= 0xF0] = 2, 3, 4
        begins = (data & 0xC0) != 0x80
        for position in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > position)
            start = offsets[live] + position
            start = start[begins[start] & (best[start] > -np.inf)]
            if not len(start):
                continue
            stop = offsets[np.searchsorted(offsets, start, side="right")] - 1
            here = best[start]
            single = np.zeros(len(start), bool)  # a piece covers the first character alone
            nodes, who = np.zeros(len(start), np.int64), np.arange(len(start))
            for depth in range(self.longest):
                at = start[who] + depth
                inside = at < stop[who]
                who, nodes, at = who[inside], nodes[inside], at[inside]
                nodes = self.trie.step(nodes, data[at])
                alive = nodes >= 0
                who, nodes, at = who[alive], nodes[alive], at[alive]
                if not len(who):
                    break
                key = self.trie.ends(nodes)
                hit = key >= 0
                w, k, to = who[hit], key[hit], at[hit] + 1
                single[w[width[start[w]] == depth + 1]] = True
                score = here[w] + self.scores[k]
                better = score > best[to]
                to, k = to[better], k[better]
                best[to], back[to], piece[to] = score[better], self.lengths[k], k
            alone = np.flatnonzero(~single)
            to = start[alone] + width[start[alone]]
            score = here[alone] + self.floor
            better = score > best[to]
            to, alone = to[better], alone[better]
            best[to], back[to], piece[to] = score[better], width[start[alone]], -1
        return [self._path(back, piece, data, int(a), int(a + n)) for a, n in zip(offsets, sizes)]

    def _one(self, stretch: bytes) -> np.ndarray:
        """The same for one long stretch, byte after byte; what is held grows with its length only."""
        base, check, value = self.lists
        n = len(stretch)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            here, first = best[start], stretch[start]
            if here == -np.inf or first & 0xC0 == 0x80:
                continue
            width = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            node, single = 0, False
            for at in range(start, n):
                to = base[node] + stretch[at] + 1
                if check[to] != node:
                    break
                node = to
                end = base[node]
                if check[end] == node:
                    key = value[end]
                    single |= at + 1 == start + width
                    score = here + self.score_list[key]
                    if score > best[at + 1]:
                        best[at + 1], back[at + 1], piece[at + 1] = score, at + 1 - start, key
            to = min(start + width, n)
            if not single and here + self.floor > best[to]:
                best[to], back[to], piece[to] = here + self.floor, to - start, -1
        return self._path(np.array(back), np.array(piece), np.frombuffer(stretch, np.uint8), 0, n)

    def _path(self, back, piece, data, first: int, at: int) -> np.ndarray:
        ids: list[int] = []
        while at > first:
            step = int(back[at])
            if piece[at] >= 0:
                ids.append(int(self.ids[piece[at]]))
            else:
                raw = data[at - step : at].tolist()
                ids += [self.bytes[b] for b in reversed(raw)] if self.bytes else [self.unknown]
            at -= step
        return np.array(ids[::-1], "<u4")

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text; an empty text has none."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of several texts; stretches that are not known yet are segmented together."""
        if len(self.cache) > _CACHE_ENTRIES:
            self.cache = {}
        cut = [self.stretches(t) if t else [] for t in texts]
        new = [s for s in set().union(*cut) if s not in self.cache]
        for c in range(0, len(new), _TOGETHER):
            part = new[c : c + _TOGETHER]
            self.cache.update(zip(part, (ids.tobytes() for ids in self.segment(part))))
        return [b"".join(map(self.cache.__getitem__, c)) for c in cut]

    @staticmethod
    def stretches(text: bytes) -> list[bytes]:
        """The marked text, cut before every run of markers."""
        if b"  " not in text and MARKER not in text and text[:1] != b" " and text[-1:] != b" ":
            return [MARKER + s for s in text.split(b" ")]
        marked = MARKER + text.replace(b" ", MARKER)
        out, held = [], b""
        for part in marked.split(MARKER)[1:]:
            held += MARKER
            if part:
                out.append(held + part)
                held = b""
        return out + [held] if held else out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text: byte pieces as bytes, other pieces as written, markers as spaces, without the one in front."""
        text = b"".join(map(self.written.__getitem__, ids.tolist()))
        return text[1:] if text[:1] == b" " else text


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.at(path)
        for batch in batches:
            texts = batch.column(1)
            encoded = []
            for c in range(0, len(texts), _TEXTS):
                encoded += model.encode_all(texts.slice(c, _TEXTS).to_pylist())
            values = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.at(path)
        for batch in batches:
            texts = [model.decode(np.asarray(i.values)).decode("utf-8", "replace") if i.is_valid else "" for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, ids. A null or empty text has no ids; an empty table gives no rows."""
    return text_bytes(docs).mapInArrow(_encode(path or model_path()), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``tokens`` (doc_id, ids): doc_id, text. Null ids are an empty text.

    The inverse of ``encode`` but for marker characters in the original, which come back as spaces.
    """
    rows = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(path or model_path()), "doc_id long, text string")


def _both(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.at(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            (ids,) = (b.column(1) for b in _encode(path)(iter([batch])))
            same = [model.decode(np.asarray(i.values)) == t.replace(MARKER, b" ") for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids.value_lengths(), ids, pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids", "restored"])

    return run


def encode_and_check(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids, and whether decoding them gives the text back."""
    schema = "doc_id long, n_ids int, ids array<int>, restored boolean"
    return text_bytes(docs).mapInArrow(_both(path or model_path()), schema)
