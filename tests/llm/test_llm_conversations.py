"""Repair of conversations against all edit sequences, and the bound on unresolved edits."""

import hashlib
import itertools
import random
import re
import zlib

from plumbline.llm import conversations
from plumbline.llm.conversations import Survivors

LEGAL = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def _faults(rows):
    """First fault of each row (role, text) in order."""
    out, seen = [], set()
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def _all_ways(rows):
    """Every audit that keeps to the grammar, up to two inserts in a place: (cost, audit, repaired text)."""
    faults = _faults(rows)
    found = []

    def go(i, initials, cost, audit, lines):
        # No prefix that the grammar cannot complete is followed up.
        if initials and not re.fullmatch(r"s|s?(ua)*u?", initials):
            return
        if i == len(rows) and LEGAL.fullmatch(initials):
            found.append((cost, audit, "\n".join(lines)))
        if audit[-2:] != "II":
            for role in ("user", "assistant"):
                go(i, initials + role[0], cost + 3, audit + "I", [*lines, role + ":"])
        if i == len(rows):
            return
        role, text = rows[i]
        go(i + 1, initials, cost + 4, audit + "D", lines)
        if faults[i] in (1, 2):
            return
        extra = 3 if faults[i] == 3 else 0
        if role[:1] in ("s", "u", "a"):
            go(i + 1, initials + role[0], cost + extra, audit + "K", [*lines, f"{role}:{text}"])
        for new in ("user", "assistant"):
            go(i + 1, initials + new[0], cost + 3 + extra, audit + "R", [*lines, f"{new}:{text}"])

    go(0, "", 0, "", [])
    return min(found)


def _expected(rows):
    """rows: (turn, role, text) after damage, in order."""
    plain = [(role, text) for _, role, text in rows]
    faults = _faults(plain)
    cost, audit, text = _all_ways(plain)
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(plain))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def _order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role.encode(), text.encode())


def test_repair_against_all_edit_sequences(spark):
    rng = random.Random(3)
    table, expected = [], {}
    for conv in range(260):
        rows = []
        for _ in range(rng.randrange(6)):
            turn = rng.choice([None, *range(7)])
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "usher", None])
            text = rng.choice(["Yes.", "No!", "Why? ", "cut off", "", " \t\x0b\n", "é…", "end.\r\n", None, "Yes."])
            rows.append((turn, role, text))
        table += [(conv, *r, "x") for r in rows] or [(conv, None, None, None, "dead")]
        plain = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
        expected[conv] = _expected(sorted(plain, key=_order))
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, first string")
    live = conversations.plain_rows(df.where("first <> 'dead'")).selectExpr("*", "true AS live").unionByName(
        conversations.plain_rows(df.where("first = 'dead'")).selectExpr("*", "false AS live"))
    repairs = conversations.repair(live)
    got = {r["conv_id"]: tuple(r)[2:] for r in repairs.collect()}
    assert got == expected
    # The rows that the edits leave are the text that was hashed.
    lines = {}
    for r in conversations.repaired_rows(live, repairs).orderBy("conv_id", "position").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(v).encode()).hexdigest() for c, v in lines.items()} == {
        c: e[-1] for c, e in expected.items() if e[-1] != EMPTY}


def test_damage_then_repair(spark):
    rng = random.Random(4)
    table = []
    for conv in [*range(120), None]:
        for turn in [*range(rng.randrange(1, 6)), *([None] if rng.random() < 0.2 else [])]:
            table.append((conv, turn, rng.choice(["user", "assistant", "system", None]), rng.choice(["Yes. No!", "Why", None, "A?"]), 1))
    expected = {}
    for conv, turn, role, text, _ in table:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        rows = expected.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, live int")
    got = conversations.repair_damaged(df).collect()
    assert len(got) == len(expected) and any(not rows for rows in expected.values())
    for r in got:
        assert tuple(r)[1:] == _expected(sorted(expected[r["conv_id"]], key=_order))
    assert conversations.repair_damaged(df.limit(0)).collect() == []


def _nodes(root):
    count, stack = 0, [root]
    while stack:
        node = stack.pop()
        count += 1
        stack += node.children
    return count


def test_settled_edits_leave_memory():
    for roles, bound in ((["user", "assistant"], 8), (["system", "user", "tool", "assistant", "assistant"], 40)):
        survivors, handed = Survivors(), b""
        for i in range(5000):
            handed += survivors.take(roles[i % len(roles)].encode(), b"Yes.", 3 if i % 7 == 0 else 0)
            assert max(len(survivors.unresolved(s)) for s in survivors.tips) <= bound
            assert _nodes(survivors.root) <= 8
        cost, rest, _ = survivors.finish()
        assert len(handed) >= 4900


def test_long_unresolved_ties_stay_linear():
    """Rows of one role never settle; their edits are one byte each in a tree of a few nodes."""
    survivors, handed = Survivors(), b""
    for _ in range(30_000):
        handed += survivors.take(b"user", b"Yes.", 0)
    assert _nodes(survivors.root) <= 8
    cost, rest, _ = survivors.finish()
    audit = (handed + rest).decode()
    assert cost == 3 * 15_000 and LEGAL.fullmatch(_initials(audit)) and audit <= "KR" * 15_000


def _initials(audit):
    out = ""
    for edit in audit:
        out += "" if edit == "D" else ("u" if edit == "K" else "a" if out[-1:] == "u" else "u")
    return out

