"""Exact deduplication with Patricia tries as owners of texts.

Each input task first folds its own copies in a small trie, so a text held by a third of all rows leaves a task
once. What is left is dealt out by length and SHA-256 of the text; each partition inserts the full byte strings
into a compressed radix trie whose terminal nodes hold the identifier that stays and the number of rows. A trie
over its byte budget writes its largest subtree to task-private scratch, as a Spark sort does, and finishes it
afterwards. Only (length, hash, owner, count) leaves the tries; rows find their owner by a join on length and hash,
in which no text moves and which Spark can split where one text is frequent.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stages import settle
from .common import docs_columns, id_and_text, return_memory, spare_names

FOLD_BYTES = 16 << 20
TRIE_BYTES = 64 << 20

_FOLDED = "size long, hash binary, text binary, owner long, n long"
_OWNED = "size long, hash binary, owner long, n long"


class _Node:
    __slots__ = ("label", "kids", "owner", "n", "spilled")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner, self.n, self.spilled = label, {}, None, 0, None


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, by bisection."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


class Patricia:
    """Byte strings with the owner that ``choose`` prefers among their identifiers and the number of rows."""

    def __init__(self, choose: Callable, budget: int | None = None, scratch: str | None = None):
        self.root, self.choose, self.budget, self.scratch = _Node(b""), choose, budget, scratch
        self.bytes, self.files = 0, []

    def insert(self, key: bytes, owner: int | None, n: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = _Node(key[at:])
                self.bytes += len(key) - at + 200
                node = kid
                break
            if kid.spilled is not None:
                pickle.dump((key, owner, n), kid.spilled)
                return
            if key.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
                continue
            cut = _shared(kid.label, key, at)
            fork = _Node(kid.label[:cut])
            kid.label = kid.label[cut:]
            fork.kids[kid.label[0]] = kid
            node.kids[key[at]] = fork
            self.bytes += 200
            node, at = fork, at + cut
        node.owner = owner if not node.n else self.choose(node.owner, owner)
        node.n += n
        if self.budget and self.bytes > self.budget:
            self._spill()

    def _walk(self, node: _Node, before: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(node, before)]
        while stack:
            node, before = stack.pop()
            if node.n:
                yield before, node.owner, node.n
            stack += [(kid, before + kid.label) for kid in node.kids.values() if kid.spilled is None]

    def _spill(self) -> None:
        """Write out the largest subtree at the first fork; a trie that is one long string stays."""
        node, before = self.root, b""
        while len(node.kids) == 1 and not node.n and (only := next(iter(node.kids.values()))).spilled is None:
            node, before = only, before + only.label
        weights = {k: sum(len(key) - len(before) + 200 for key, _, _ in self._walk(kid, before + kid.label))
                   for k, kid in node.kids.items() if kid.spilled is None}
        if not weights:
            self.budget *= 2
            return
        largest = max(weights, key=weights.get)
        kid, file = node.kids[largest], tempfile.TemporaryFile(dir=self.scratch)
        for record in self._walk(kid, before + kid.label):
            pickle.dump(record, file)
        self.files.append(file)
        stub = _Node(kid.label[:1])  # all that starts with this byte goes to the file
        stub.spilled = file
        node.kids[largest] = stub
        self.bytes = sum(len(key) + 200 for key, _, _ in self._walk(self.root, b""))

    def terminals(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Every string once, spilled subtrees after the rest; the trie is used up."""
        yield from self._walk(self.root, b"")
        self.root = None
        for file in self.files:
            file.seek(0)
            sub = Patricia(self.choose, self.budget, self.scratch)
            while True:
                try:
                    sub.insert(*pickle.load(file))
                except EOFError:
                    break
            file.close()
            yield from sub.terminals()


def _chooser(keep: str) -> Callable:
    best = {"smallest": min, "largest": max}[keep]
    return lambda a, b: b if a is None else a if b is None else best(a, b)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 64 + (row[0] if len(schema) == 5 else 0)
        if weight > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_FOLDED_ARROW = pa.schema([("size", pa.int64()), ("hash", pa.binary()), ("text", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])
_OWNED_ARROW = pa.schema([("size", pa.int64()), ("hash", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])


def _fold(keep: str):
    choose = _chooser(keep)

    def fold(batches):
        def rows():
            trie = Patricia(choose)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    trie.insert(text.as_py(), doc_id, 1)
                    if trie.bytes > FOLD_BYTES:
                        yield from trie.terminals()
                        trie = Patricia(choose)
            yield from trie.terminals()

        yield from _batches(((len(t), hashlib.sha256(t).digest(), t, o, n) for t, o, n in rows()), _FOLDED_ARROW)
        return_memory()

    return fold


def _own(keep: str, budget: int):
    choose = _chooser(keep)

    def own(batches):
        with tempfile.TemporaryDirectory() as scratch:
            trie = Patricia(choose, budget, scratch)
            for batch in batches:
                owners, counts = batch.column("owner").to_pylist(), batch.column("n").to_pylist()
                for text, owner, n in zip(batch.column("text"), owners, counts):
                    trie.insert(text.as_py(), owner, n)

            def rows():
                met = set()
                for text, owner, n in trie.terminals():
                    key = (len(text), hashlib.sha256(text).digest())
                    if key in met:
                        raise ValueError("Two different texts have the same length and SHA-256.")
                    met.add(key)
                    yield *key, owner, n

            yield from _batches(rows(), _OWNED_ARROW)
        return_memory()

    return own


def owners(docs: DataFrame, keep: str = "smallest", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: size, hash, owner, n."""
    plain = id_and_text(docs).withColumn("text", F.col("text").cast("binary"))
    folded = plain.mapInArrow(_fold(keep), _FOLDED)
    return folded.repartition("size", "hash").mapInArrow(_own(keep, budget), _OWNED)


def exact_dedup(docs: DataFrame, keep: str = "smallest", budget: int = TRIE_BYTES) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal byte by byte; a null text is empty. ``keep`` says whether the smallest or the largest doc_id of
    equal texts stays. A null doc_id never wins against a number. Of several rows with the same doc_id and text one
    counts as kept and each has its own row. An empty table gives no rows; other columns are not read.
    """
    owned = settle(owners(docs, keep, budget)).withColumnsRenamed({"owner": "keep_id", "n": "group_size"})
    rows = (
        id_and_text(docs)
        .select("doc_id", F.octet_length("text").cast("long").alias("size"), F.unhex(F.sha2("text", 256)).alias("hash"))
        .groupBy("doc_id", "size", "hash").agg(F.count(F.lit(1)).cast("int").alias("times"))
    )
    return (
        settle(rows).join(owned, ["size", "hash"])
        .select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("turn"))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"),
            F.lower(F.hex("hash")).alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, keep: str = "smallest", budget: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per distinct text, chosen as in ``exact_dedup``.

    Of repeated rows with the doc_id that stays, any one stays.
    """
    size, digest, owner, turn = spare_names(docs, "size", "hash", "owner", "turn")
    owned = settle(owners(docs, keep, budget)).select(
        F.col("size").alias(f"{size}_"), F.col("hash").alias(f"{digest}_"), F.col("owner").alias(owner))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({size: F.octet_length(text).cast("long"), digest: F.unhex(F.sha2(text, 256))})
    stay = rows.join(owned, (F.col(size) == F.col(f"{size}_")) & (F.col(digest) == F.col(f"{digest}_"))
                     & F.col("doc_id").cast("long").eqNullSafe(F.col(owner)))
    order = Window.partitionBy(size, digest, "doc_id").orderBy("doc_id")
    return stay.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).select(*docs_columns(docs))
