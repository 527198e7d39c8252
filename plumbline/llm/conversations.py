"""Repair of conversation structure: the cheapest edits that bring a conversation's roles into order.

Legal role initials are ``(s?(ua)+)?``. A row is kept, given another role or deleted, and rows without text may be put in
between; blank and repeated rows must go. The search is a Viterbi pass over the rows in order with four states: nothing
yet, behind the system row, behind a user row, behind an assistant row.

Every state's survivor is a tip of a backpointer tree whose inner nodes count what refers to them. A node that nothing
refers to any more goes, one with a single reference is joined with what refers to it, and the letters of the root are
handed out as soon as all survivors share them. A survivor that must end dearer than another one goes, so that a state
which only deletions lead to does not hold up the rest. So a conversation holds one byte per unresolved edit and one
running hash per survivor, never its texts.

Equal costs are decided by the complete unresolved audits. Two survivors have used up the same rows and their inserts
come before the rows that need them, so neither audit begins the other: their order is settled where they part and is
carried along as a rank. Candidates with the same forerunner differ in their last letters only.

A conversation's rows pass one task in order, as the SHA-256 of its text cannot be computed otherwise; they stream
through it, after Spark's sort, and are never held together. Whatever else costs time (hashes, faults, repeats) is
computed before, by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, and marks that end a sentence.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT = b"K", b"R", b"D", b"I"
REROLE_COST = INSERT_COST = TRUNCATED_COST = 3
DELETE_COST = 4
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_ROLE = {_USER: b"user", _ASSISTANT: b"assistant"}
#: Faults of a row, the first that applies.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
_OUT = pa.schema([
    ("n_rows", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
])


class Node:
    """A run of edits in the backpointer tree; its children are the references to it."""

    __slots__ = ("letters", "parent", "children")

    def __init__(self, letters: bytes, parent: Node | None):
        self.letters, self.parent, self.children = bytearray(letters), parent, set()


class Survivors:
    """The best way into each state so far: cost, tree tip, hash of the text repaired so far, and rank of the audit."""

    def __init__(self):
        self.root = Node(b"", None)
        self.tips = {_START: self.root}
        self.cost = {_START: 0}
        self.rank = {_START: 0}
        self.hash = {_START: (hashlib.sha256(), False)}

    def _ways(self, role: bytes, fault: int) -> dict[int, list[tuple[int, int, bytes, int]]]:
        """Per state after the row: cost, rank of the forerunner, letters, forerunner."""
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        ways: dict[int, list] = {}

        def way(to: int, start: int, letters: bytes, cost: int) -> None:
            ways.setdefault(to, []).append((self.cost[start] + cost, self.rank[start], letters, start))

        for state in self.tips:
            way(state, state, DELETE, DELETE_COST)
            if fault in (BLANK, DUPLICATE):
                continue
            if state == _START and role[:1] == b"s":
                way(_SYSTEM, state, KEEP, extra)
            direct = _ASSISTANT if state == _USER else _USER
            for to in (_USER, _ASSISTANT):
                before, put = (b"", 0) if to == direct else (INSERT, INSERT_COST)
                if role[:1] == _ROLE[to][:1]:
                    way(to, state, before + KEEP, put + extra)
                way(to, state, before + REROLE, put + REROLE_COST + extra)
        return ways

    @staticmethod
    def _hopeful(chosen: dict[int, tuple]) -> dict[int, tuple]:
        """Without the states from which every way on costs more than from another one.

        An insert leads from a user row to an assistant's and back. Behind an assistant row all that may follow a system
        row is legal, and all that may follow nothing but a kept system row, which could be deleted instead.
        """
        cost = {state: chosen[state][0] if state in chosen else 1 << 60 for state in range(4)}
        answered = min(cost[_ASSISTANT], cost[_USER] + INSERT_COST)
        most = {_START: answered + DELETE_COST, _SYSTEM: answered, _USER: cost[_ASSISTANT] + INSERT_COST,
                _ASSISTANT: cost[_USER] + INSERT_COST}
        return {state: way for state, way in chosen.items() if way[0] <= most[state]}

    def take(self, role: bytes, text: bytes, fault: int) -> bytes:
        """Go on over one row; returns the edits that are settled by now."""
        chosen = self._hopeful({to: min(options) for to, options in self._ways(role, fault).items()})
        order = sorted(chosen, key=lambda to: chosen[to][1:3])
        self.cost = {to: way[0] for to, way in chosen.items()}
        self.rank = {to: place for place, to in enumerate(order)}
        self.hash = {to: self._hashed(to, way[2], self.hash[way[3]], role, text) for to, way in chosen.items()}
        self._grow(chosen)
        settled = bytes(self.root.letters)
        self.root.letters.clear()
        return settled

    @staticmethod
    def _hashed(to: int, letters: bytes, so_far: tuple, role: bytes, text: bytes) -> tuple:
        if letters == DELETE:
            return so_far
        running, begun = so_far[0].copy(), so_far[1]
        if letters[:1] == INSERT:
            other = _ASSISTANT if to == _USER else _USER
            running.update((b"\n" if begun else b"") + _ROLE[other] + b":")
            begun = True
        running.update((b"\n" if begun else b"") + (role if letters[-1:] == KEEP else _ROLE[to]) + b":" + text)
        return running, True

    def _grow(self, chosen: dict[int, tuple]) -> None:
        users: dict[int, list[int]] = {}
        for to, way in chosen.items():
            users.setdefault(way[3], []).append(to)
        tips = {}
        gone = [node for state, node in self.tips.items() if state not in users]
        for start, ends in users.items():
            node = self.tips[start]
            if len(ends) == 1:
                node.letters += chosen[ends[0]][2]
                tips[ends[0]] = node
                continue
            for to in ends:
                tips[to] = Node(chosen[to][2], node)
                node.children.add(tips[to])
        self.tips = tips
        for node in gone:
            self._drop(node)

    def _drop(self, node: Node) -> None:
        """Take a tip without successors away; a node left with one reference is joined with it."""
        while (parent := node.parent) is not None:
            parent.children.discard(node)
            if parent.children:
                break
            node = parent
        if parent is None or len(parent.children) != 1:
            return
        (only,) = parent.children
        parent.letters += only.letters
        parent.children = only.children
        for child in only.children:
            child.parent = parent
        for state, tip in self.tips.items():
            if tip is only:
                self.tips[state] = parent

    def unresolved(self, state: int) -> bytes:
        """The complete edits of a survivor that are not handed out yet."""
        parts, node = [], self.tips[state]
        while node is not None:
            parts.append(bytes(node.letters))
            node = node.parent
        return b"".join(reversed(parts))

    def finish(self) -> tuple[int, bytes, str]:
        """Cost, the edits not handed out before, and the hash of the repaired text."""
        ends = []
        for state in self.tips:
            # What still has to be put behind: an assistant's answer, or a whole exchange behind a system row.
            put = {_START: 0, _SYSTEM: 2, _USER: 1, _ASSISTANT: 0}[state]
            ends.append((self.cost[state] + put * INSERT_COST, self.rank[state], put, state))
        cost, _, put, state = min(ends)
        running, begun = self.hash[state]
        for role in (_USER, _ASSISTANT)[2 - put :]:
            running.update((b"\n" if begun else b"") + _ROLE[role] + b":")
            begun = True
        return cost, self.unresolved(state) + INSERT * put, running.hexdigest()


class _Conversation:
    """Counts and survivors of one conversation while its rows pass."""

    def __init__(self, key):
        self.key = key
        self.survivors = Survivors()
        self.audit = bytearray()
        self.faults = [0, 0, 0, 0]
        self.rows = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def take(self, turn: int | None, role: bytes, initial: bytes, text: bytes, fault: int) -> None:
        self.rows += 1
        self.faults[fault] += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if self.before is not None and self.before + initial not in (b"su", b"ua", b"au"):
            self.illegal += 1
        self.before = initial
        self.audit += self.survivors.take(role, text, fault)

    def row(self) -> tuple:
        cost, rest, digest = self.survivors.finish()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.rows, gaps, *self.faults[1:], self.illegal, cost, (self.audit + rest).decode(), digest)


def _streamed(key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *_OUT.names]
        ready: list[tuple] = []
        now: _Conversation | None = None
        for batch in batches:
            keys, live, turns, roles, initials, texts, faults = (c.to_pylist() for c in batch.columns)
            for i, key in enumerate(keys):
                if now is None or key != now.key:
                    if now is not None:
                        ready.append((now.key, *now.row()))
                    now = _Conversation(key)
                if live[i]:
                    now.take(turns[i], roles[i], initials[i], texts[i], faults[i])
            if len(ready) >= 1000:
                yield _packed(ready, key_type, names)
                ready = []
        if now is not None:
            ready.append((now.key, *now.row()))
        if ready:
            yield _packed(ready, key_type, names)

    return run


def _packed(rows: list[tuple], key_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = [pa.array(columns[0], key_type), *(pa.array(c, f.type) for c, f in zip(columns[1:], _OUT))]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def plain_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` alone, a null role or text as one space; other columns fall away."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``plain_rows`` with planted faults and ``live``, by the crc32 of ``conv_id:turn`` modulo 20.

    0 takes the row away (it stays with ``live`` false, so that its conversation is not lost), 1 empties its text, 2 takes
    the marks that end sentences, 3 repeats the row, 4 makes it a user's. A null conv_id or turn counts as one space.
    """
    def part(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    marked = rows.withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return marked.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("live"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")


def _judged(rows: DataFrame) -> DataFrame:
    """Rows in order within their conversation, with their first fault."""
    placed = rows.select("conv_id", "turn", "role", "text", "live").repartition("conv_id")
    # The partitions by conversation serve this window too, so it adds a sort but no shuffle.
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("live").desc(), F.col("turn").asc_nulls_first())
    numbered = placed.withColumn("first", F.row_number().over(same) == 1)
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(F.length(stripped) == 0, BLANK).when(~F.col("first"), DUPLICATE)
        .when(~F.right(stripped, F.lit(1)).isin(*ENDS), TRUNCATED).otherwise(SOUND)
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("first").desc()]
    return numbered.withColumn("fault", fault.cast("byte")).sortWithinPartitions(*order)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: counts of its faults, the cheapest edits, and the hash of what they make of it.

    ``rows`` has conv_id, turn, role, text as ``plain_rows`` gives them, and may have ``live``: a row that is not live
    only makes its conversation known. Rows go by turn, nulls first, then by role and text; rows equal in all of these
    are repeats. A null conv_id is a conversation of its own. Blank, duplicate and truncated count rows by their first
    fault; a role whose initial is none of s, u, a cannot be kept. A conversation without rows has zeros, no edits and
    the hash of nothing; an empty table gives no rows.
    """
    if "live" not in rows.columns:
        rows = rows.withColumn("live", F.lit(True))
    columns = _judged(rows).select(
        "conv_id", "live", "turn", F.col("role").cast("binary"), F.substring("role", 1, 1).cast("binary").alias("initial"),
        F.col("text").cast("binary"), "fault")
    schema = ("conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
              "audit string, repaired_sha256 string")
    return columns.mapInArrow(_streamed(pa.int64()), schema)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows behind their conversation's audit, which comes first: the repaired rows."""
    key = audit = at = place = state = None
    names = ["conv_id", "position", "edit", "turn", "role", "text"]
    for batch in batches:
        out: list[tuple] = []
        keys, audits, live, turns, roles, texts = (c.to_pylist() for c in batch.columns)

        def put(edit: str, turn: int | None, role: str, text: str) -> None:
            nonlocal place
            out.append((key, place, edit, turn, role, text))
            place += 1

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = _ASSISTANT if state == _USER else _USER
                put("I", None, _ROLE[state].decode(), "")
                at += 1

        for i in range(batch.num_rows):
            if audits[i] is not None:
                key, audit, at, place, state = keys[i], audits[i], 0, 0, _START
                continue
            if not live[i]:
                continue
            edit, role = audit[at], roles[i]
            if edit == "I":
                inserts()
                edit = audit[at]
            at += 1
            if edit != "D":
                if edit == "K" and role[:1] == "s":
                    state = _SYSTEM
                else:
                    state = _ASSISTANT if state == _USER else _USER
                put(edit, turns[i], role if edit == "K" else _ROLE[state].decode(), texts[i])
            if set(audit[at : at + 3]) == {"I"} and at + 2 >= len(audit):
                inserts()  # nothing else is left: they stand behind the last row
        if out:
            columns = list(zip(*out))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def repaired_rows(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The conversations as ``repairs`` (the result of ``repair`` on the same rows) leaves them.

    conv_id, position (from 0), edit (K kept, R other role, I put in), turn (null if put in), role, text; deleted rows are
    gone. Rows stream behind their conversation's audit, in the order of ``repair``.
    """
    if "live" not in rows.columns:
        rows = rows.withColumn("live", F.lit(True))
    nothing = F.lit(None)
    both = repairs.select(
        "conv_id", "audit", F.lit(True).alias("live"), nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"),
        nothing.cast("string").alias("text"),
    ).unionByName(rows.select("conv_id", nothing.cast("string").alias("audit"), "live", "turn", "role", "text"))
    ordered = both.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(_applied, "conv_id long, position long, edit string, turn long, role string, text string")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` of every conversation after the faults of ``damaged`` were planted."""
    return repair(damaged(plain_rows(conversations))).select("conv_id", *(n for n in _OUT.names if n != "n_rows"))
