"""Token counts from a byte-level BPE tokenizer file, compiled to two deterministic transducers.

* The splitter reads character classes and marks where a word of the tokenizer's pattern begins; a mark may lie one
  character back, which is all the lookahead the pattern needs. It has eleven states, so a chunk of text is a map from
  entry state to exit state. The maps of all chunks of a batch compose in a parallel prefix scan, after which every
  chunk runs from its known entry state.
* The merger reads a word's bytes. Each transition is annotated with the change in the number of tokens emitted for
  the word so far, so the sum along a word is its count. A state is what later bytes can still depend on: the longest
  suffix that some token continues, with last token and relative count at each place where such a token may begin.
  Two tokens may stand side by side exactly if no merge crosses their seam before both are whole. States are made
  when first met and the table starts anew beyond a fixed size, so its memory does not grow with the corpus.

Both are exact: nothing is cached by word, and no text is cut but before white space that follows something else, where
a word always begins. Special tokens inside texts count as one token each and separate the text around them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
_CHUNK = 128
#: Characters looked at together; a longer text is cut at white space.
_TOGETHER = 1 << 20
_LONG_WORD = 64
_STATES = 300_000

LETTER, STMD, R, V, L, E, NUMBER, OTHER, QUOTE, SPACE, WHITE, END = range(12)
_CLASSES = 12
_FRESH, _LETTERS, _NUMBERS, _OTHERS, _SPACED, _WHITES, _QUOTED, _QUOTED_R, _QUOTED_V, _QUOTED_L, _SHORT = range(11)
_SPLIT_STATES = 11
_HERE, _BACK = 1, 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _split_step(state: int, kind: int) -> tuple[int, int]:
    """Next state, and where a word begins: here, one character back, or both."""
    is_letter, is_white = kind <= E, kind in (SPACE, WHITE)
    first = (_LETTERS if is_letter else
             {NUMBER: _NUMBERS, OTHER: _OTHERS, QUOTE: _QUOTED, SPACE: _SPACED, WHITE: _WHITES, END: _FRESH}[kind])
    if state in (_QUOTED_R, _QUOTED_V, _QUOTED_L):
        if kind == (L if state == _QUOTED_L else E):
            return _SHORT, 0
        to, mark = _split_step(_LETTERS, kind)  # the quote stood alone and its letter began a word
        return to, mark | _BACK
    if state == _LETTERS and is_letter or state == _NUMBERS and kind == NUMBER or state == _OTHERS and kind in (OTHER, QUOTE):
        return state, 0
    if state in (_SPACED, _WHITES):
        if is_white:
            return first, 0
        if kind == END:
            return _FRESH, _HERE
        if state == _SPACED:  # the last space belongs to the word that follows
            return _OTHERS if kind == QUOTE else first, _BACK
        return first, _HERE | _BACK
    if state == _QUOTED:
        if kind in (STMD, R, V, L):
            return {STMD: _SHORT, R: _QUOTED_R, V: _QUOTED_V, L: _QUOTED_L}[kind], 0
        if kind in (OTHER, QUOTE):
            return _OTHERS, 0
    return first, _HERE


def _letters_of_bytes() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _kinds(path: str) -> np.ndarray:
    """Class of every code point, and of END behind them.

    Where a character is too new for one Unicode table at hand but in the other, the tokenizer itself is asked.
    """
    import regex
    from tokenizers import Tokenizer

    points = np.r_[0:0xD800, 0xE000:0x110000]
    every = "".join(map(chr, points))
    kinds = np.full(0x110001, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for match in regex.finditer(pattern, every):
            kinds[points[match.start() : match.end()]] = kind
    disputed = [chr(p) for p in np.flatnonzero(kinds[:-1] != OTHER) if unicodedata.category(chr(p)) == "Cn"]
    splitter = Tokenizer.from_file(path).pre_tokenizer
    for at in range(0, len(disputed), 1000):
        part = disputed[at : at + 1000]
        begins = {span[0] for _, span in splitter.pre_tokenize_str("".join(f"\na{c}\n1{c}\n!{c}" for c in part))}
        for i, c in enumerate(part):
            joined = [kind for kind, place in ((LETTER, 2), (NUMBER, 5), (OTHER, 8)) if 9 * i + place not in begins]
            kinds[ord(c)] = joined[0] if joined else WHITE
    for kind, members in ((STMD, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e"), (QUOTE, "'"), (SPACE, " ")):
        kinds[[ord(c) for c in members]] = kind
    kinds[0x110000] = END
    return kinds


class Splitter:
    """Marks the places where words begin."""

    def __init__(self, kinds: np.ndarray):
        self.kinds = kinds
        steps = [_split_step(s, k) for k in range(_CLASSES) for s in range(_SPLIT_STATES)]
        self.next = np.array([s for s, _ in steps], np.uint8)
        self.mark = np.array([m for _, m in steps], np.uint8)

    def begins(self, codes: np.ndarray) -> np.ndarray:
        """For code points with END between and behind texts: whether a word (or an END) begins there."""
        n = len(codes)
        chunks = -(-n // _CHUNK)
        padded = np.full(chunks * _CHUNK, END, np.uint8)
        padded[:n] = self.kinds[codes]
        # One row per place in the chunk, as offsets into the transition table.
        rows = np.ascontiguousarray(padded.reshape(chunks, _CHUNK).T).astype(np.int16) * _SPLIT_STATES
        maps = np.tile(np.arange(_SPLIT_STATES, dtype=np.uint8), (chunks, 1))
        for row in rows:
            maps = self.next[row[:, None] + maps]
        reach = 1
        while reach < chunks:  # maps[i] becomes the map of all chunks up to i
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), 1)
            reach *= 2
        state = np.concatenate([[np.uint8(_FRESH)], maps[:-1, _FRESH]])
        marks = np.empty(rows.shape, np.uint8)
        for row, out in zip(rows, marks):
            at = row + state
            out[:] = self.mark[at]
            state = self.next[at]
        marks = marks.T.reshape(-1)[:n]
        begin = (marks & _HERE).astype(bool)
        begin[:-1] |= (marks[1:] & _BACK).astype(bool)
        return begin


class Transitions:
    """(state, byte) → next state and change of the count, as an open hash table in arrays that many keys probe at once."""

    def __init__(self, bits: int = 16):
        self.shift = 64 - bits
        self.used = 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.to = np.zeros(1 << bits, np.int32)
        self.change = np.zeros(1 << bits, np.int8)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where it is not there."""
        last = len(self.keys) - 1
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)
        held = self.keys[at]
        open_ = np.flatnonzero(held != keys)
        while len(open_):
            ended = held[open_] == -1
            at[open_[ended]] = -1
            open_ = open_[~ended]
            at[open_] = (at[open_] + 1) & last
            held[open_] = self.keys[at[open_]]
            open_ = open_[held[open_] != keys[open_]]
        return at

    def add(self, key: int, to: int, change: int) -> None:
        if 2 * self.used >= len(self.keys):
            old = self.keys >= 0
            entries = zip(self.keys[old].tolist(), self.to[old].tolist(), self.change[old].tolist())
            self.__init__(65 - self.shift)
            for entry in entries:
                self.add(*entry)
        last = len(self.keys) - 1
        at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> self.shift
        while self.keys[at] != -1:
            at = (at + 1) & last
        self.keys[at], self.to[at], self.change[at] = key, to, change
        self.used += 1


class Merger:
    """Counts the tokens of a word's bytes by transitions that carry the change of the count."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        byte_of = {c: b for b, c in enumerate(_letters_of_bytes())}
        self.ids = {bytes(byte_of[c] for c in word): i for word, i in vocabulary.items()}
        self.pairs: dict[tuple[int, int], int] = {}  # rank of the merge of two tokens
        made: dict[int, tuple[int, int, int]] = {}  # token → rank of its merge, its two parts
        for rank, merge in enumerate(merges):
            left, right = (bytes(byte_of[c] for c in part) for part in (merge.split(" ") if isinstance(merge, str) else merge))
            a, b, whole = self.ids[left], self.ids[right], self.ids[left + right]
            self.pairs.setdefault((a, b), rank)
            made.setdefault(whole, (rank, a, b))
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("The vocabulary lacks single bytes.")
        reached = {i for word, i in self.ids.items() if len(word) == 1} | set(made)
        if any(a not in reached or b not in reached or max(made.get(a, (-1,))[0], made.get(b, (-1,))[0]) >= rank
               for rank, a, b in made.values()):
            raise ValueError("A merge comes before the merges of its parts.")
        self.ids = {word: i for word, i in self.ids.items() if i in reached}
        # Per token, what stands at its right (left) end while it is put together: rank from which on, and token.
        self.right = {i: self._spine(i, made, 2) for i in reached}
        self.left = {i: self._spine(i, made, 1) for i in reached}
        self.alone = {i: all(self._beside(a, b, rank) for rank, a, b in self._parts(i, made)) for i in reached}
        self.open = {word[:k] for word in self.ids for k in range(len(word))}  # what some token continues
        self._clear()

    @staticmethod
    def _spine(token: int, made: dict, side: int) -> list[tuple[int, int]]:
        out = []
        while token in made:
            out.append((made[token][0], token))
            token = made[token][side]
        return [*out, (-1, token)][::-1]

    @staticmethod
    def _parts(token: int, made: dict) -> Iterator[tuple[int, int, int]]:
        stack = [token]
        while stack:
            if (entry := made.get(stack.pop())) is not None:
                yield entry
                stack += entry[1:]

    def _beside(self, left: int, right: int, until: int = 1 << 60) -> bool:
        """Whether merging two tokens' joined bytes leaves the seam between them alone up to a rank.

        Both sides grow in order of rank; a merge across the seam happens if its rank comes before the next one of
        either side, or with the right side's, as the leftmost of equal merges goes first.
        """
        a, b = self.right[left], self.left[right]
        i = j = 0
        while True:
            next_a = a[i + 1][0] if i + 1 < len(a) else until
            next_b = b[j + 1][0] if j + 1 < len(b) else until
            across = self.pairs.get((a[i][1], b[j][1]))
            if across is not None and across < until and across < next_a and across <= next_b:
                return False
            if min(next_a, next_b) >= until:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def _clear(self) -> None:
        self.allowed: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.table = Transitions()
        self._intern((b"", -1, 0))

    def _intern(self, key: tuple) -> int:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.keys)
            self.keys.append(key)
        return found

    def _fits(self, left: int, right: int) -> bool:
        """Whether a token may follow another one, or (-1) begin a word."""
        if left < 0:
            return self.alone[right]
        pair = (left, right)
        found = self.allowed.get(pair)
        if found is None:
            found = self.allowed[pair] = self.alone[right] and self._beside(left, right)
        return found

    def _make(self, state: int, byte: int) -> None:
        """The transition of a state for a byte.

        A state is its suffix, then last token and relative count for every place in it, -2 where no token can begin.
        """
        key = self.keys[state]
        word = key[0] + bytes([byte])
        for k in range(len(word)):
            left = key[2 * k + 1]
            if left != -2 and (token := self.ids.get(word[k:])) is not None and self._fits(left, token):
                change = key[2 * k + 2] + 1
                break
        else:
            raise ValueError("No token fits; the merges are not those of a byte-level tokenizer.")
        k = next(k for k in range(len(word) + 1) if word[k:] in self.open)
        new = [word[k:]]
        for j in range(k, len(word)):
            alive = key[2 * j + 1] != -2 and word[j:] in self.open
            new += (key[2 * j + 1], key[2 * j + 2] - change) if alive else (-2, 0)
        to = self._intern((*new, token, 0))
        self.table.add(state * 256 + byte, to, change)

    def _bounded(self, live: np.ndarray) -> np.ndarray:
        """The live states, renumbered in a new table if the old one has grown too large."""
        if len(self.keys) <= _STATES:
            return live
        kinds, place = np.unique(live, return_inverse=True)
        keys = [self.keys[k] for k in kinds]
        self._clear()
        return np.array([self._intern(k) for k in keys], np.int64)[place]

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each word of ``data``; all words advance together, byte by byte, long ones alone."""
        out = np.zeros(len(starts), np.int64)
        for i in np.flatnonzero(lengths > _LONG_WORD):
            out[i] = self._long(data[starts[i] : starts[i] + lengths[i]].tobytes())
        order = np.flatnonzero(lengths <= _LONG_WORD)
        order = order[np.argsort(-lengths[order].astype(np.int16), kind="stable")]
        starts, lengths = starts[order], lengths[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for j in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -j, side="left"))
            state = self._bounded(state[:live])
            keys = state * 256 + data[starts[:live] + j]
            at = self.table.slots(keys)
            new = keys[at < 0]
            if len(new):
                for key in np.unique(new).tolist():
                    self._make(key >> 8, key & 255)
                at = self.table.slots(keys)
            total[:live] += self.table.change[at]
            state = self.table.to[at].astype(np.int64)
        out[order] = total
        return out

    def _long(self, word: bytes) -> int:
        known: dict[int, tuple[int, int]] = {}
        state = total = 0
        for byte in word:
            if len(self.keys) > _STATES:
                state, known = int(self._bounded(np.array([state]))[0]), {}
            key = state * 256 + byte
            step = known.get(key)
            if step is None:
                at = int(self.table.slots(np.array([key]))[0])
                if at < 0:
                    self._make(state, byte)
                    at = int(self.table.slots(np.array([key]))[0])
                step = known[key] = int(self.table.to[at]), int(self.table.change[at])
            state = step[0]
            total += step[1]
        return total


class Counter:
    _loaded: dict[str, Counter] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            setup = json.load(file)
        model, before = setup["model"], setup["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and not setup["normalizer"]
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and not any(t[k] for t in setup["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not plain:
            raise ValueError("Only plain byte-level BPE files can be compiled.")
        self.splitter = Splitter(_kinds(path))
        self.merger = Merger(model["vocab"], model["merges"])
        special = sorted((t["content"] for t in setup["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    @classmethod
    def at(cls, path: str) -> Counter:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; memory follows the longest text (without white space, else a million characters)."""
        total = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owners: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            pieces = [text]
            if self.special and self.special.search(text):
                pieces = self.special.split(text)
                total[i] += len(pieces) - 1
            for piece in pieces:
                for part in _cut(piece):
                    parts.append(part)
                    owners.append(i)
                    held += len(part)
                    if held >= _TOGETHER:
                        np.add.at(total, owners, self._count(parts))
                        parts, owners, held = [], [], 0
        if parts:
            np.add.at(total, owners, self._count(parts))
        return total

    def _count(self, parts: list[str]) -> np.ndarray:
        joined = "".join(parts)
        sizes = np.array([len(p) for p in parts], np.int64)
        data = np.frombuffer(joined.encode(), np.uint8)
        codes = np.full(len(joined) + len(parts), 0x110000, np.uint32)
        place = np.arange(len(joined)) + np.repeat(np.arange(len(parts)), sizes)
        codes[place] = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        begins = np.flatnonzero(self.splitter.begins(codes))
        width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        width[codes == 0x110000] = 0
        offset = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        stops = np.concatenate([begins[1:], [len(codes)]])
        words = codes[begins] != 0x110000
        begins, stops = begins[words], stops[words]
        tokens = self.merger.counts(data, offset[begins], offset[stops] - offset[begins])
        owner = np.searchsorted(np.cumsum(sizes + 1), begins, side="right")
        return np.bincount(owner, tokens, len(parts)).astype(np.int64)


_SEAM = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n\t])")


def _cut(text: str) -> Iterator[str]:
    """A long text in parts, cut only before white space that follows another character."""
    at = 0
    while len(text) - at > _TOGETHER:
        seam = _SEAM.search(text, at + _TOGETHER // 2)
        if not seam:
            break
        yield text[at : seam.start()]
        at = seam.start()
    if at < len(text):
        yield text[at:]


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.at(path)
        for batch in batches:
            raw = batch.column(1).to_pylist()
            tokens = counter.count([t.decode("utf-8", "replace") for t in raw])
            sizes = pa.array([len(t) for t in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    A null text counts as empty and has no token; a null doc_id stays null; repeated rows stay repeated; an empty table
    gives no rows. Other columns of ``docs`` are not looked at. Nothing is shuffled.
    """
    counts = text_bytes(docs).mapInArrow(_counted(path or tokenizer_path()), "doc_id long, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
