"""Exact and near deduplication against brute force, with nulls, ties, repeats, clashing columns and empty tables."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from plumbline.llm import exact_dedup, hamming, simhash_dedup
from plumbline.llm.components import components

DOCS = "doc_id long, text string, hash string, turn int, fp long, _size0 string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "h", 1, 5, "s") for i, t in rows], DOCS)


ROWS = [
    (1, "same"), (9, "same"), (4, "same"), (2, "other"), (2, "other"), (None, "other"), (None, None), (None, ""), (7, "x" * 300_000),
    (8, "x" * 300_000), (3, "sam"), (5, "same "), (None, "lonely"), (6, "Same"), (2, "unrelated"),
]


def expected(rows, best):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        owner = best(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        left = [owner]
        for i in ids:
            kept = i == owner and bool(left)
            if kept:
                left.pop()
            out.append((i, owner, len(ids), kept, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
def test_exact_groups(spark, keep, best):
    got = exact_dedup.exact_dedup(docs(spark, ROWS).repartition(3), keep)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS, best)


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    assert exact_dedup.drop_copies(docs(spark, [])).count() == 0


def test_drop_copies_keeps_one_row_and_all_columns(spark):
    table = docs(spark, ROWS)
    got = exact_dedup.drop_copies(table, keep="largest")
    assert got.columns == table.columns
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == sorted(
        ((max((i for i, u in ROWS if (u or "") == t and i is not None), default=None), t) for t in {t or "" for _, t in ROWS}), key=str)


@pytest.mark.parametrize("budget", [None, 2_000, 20_000])
def test_trie_with_spill(budget, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() for _ in range(2000)] + [b"a" * 5000, b"a" * 5000 + b"b"]
    trie = exact_dedup.Patricia(min, budget, str(tmp_path))
    want = {}
    for i, t in enumerate(texts):
        trie.insert(t, i, 1)
        owner, n = want.get(t, (i, 0))
        want[t] = (min(owner, i), n + 1)
    if budget == 2_000:
        assert trie.files
    found = list(trie.terminals())
    assert len(found) == len(want) and {t: (o, n) for t, o, n in found} == want
    assert not list(tmp_path.iterdir())


def brute_fingerprint(text):
    words = [w for w in text.lower().replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(values, near):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def near_rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = [(None, None), (3, ""), (4, " \n"), (5, "one"), (6, "ONE"), (7, "two three")]
    for k in range(40):
        base = rng.choices(words, k=150)
        for c in range(3):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(150)] = rng.choice(words)
            rows.append((100 + 10 * k + c, " ".join(copy)))
    rows += [rows[-1], (2, rows[-1][1]), (999, "long " * 50_000)]
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates(spark, block):
    rows = near_rows()
    prints = [brute_fingerprint(t or "") for _, t in rows]
    root = groups(prints, lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root)), key=str)
    got = simhash_dedup.near_duplicates(docs(spark, rows).repartition(3), block=block)
    assert sorted(map(tuple, got.collect()), key=str) == want
    if block == 1024:
        kept = simhash_dedup.drop_near_copies(docs(spark, rows))
        assert kept.columns == docs(spark, []).columns
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(least.values(), key=str)


def test_near_empty(spark):
    assert simhash_dedup.near_duplicates(docs(spark, [])).count() == 0
    assert simhash_dedup.drop_near_copies(docs(spark, [])).count() == 0


def test_pivots_lose_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 300, np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, k % 7, replace=False))) for k in range(300)]
    prints = np.unique(np.concatenate([base, base ^ np.array(flips, np.uint64)]))
    for limit in (0, 3, 4):
        i, j = hamming.near_pairs(prints, hamming.distance_table(prints, hamming.pivots()), limit)
        got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
        want = {(a, b) for b in range(len(prints)) for a in range(b) if int(prints[a] ^ prints[b]).bit_count() <= limit}
        assert got == want and len(i) == len(got)


def test_large_block_is_cut_without_losing_links(spark):
    rng = random.Random(2)
    center = 0x0123456789ABCDEF
    prints = sorted({center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(200)})
    table = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    found = components(hamming.links(table, 4, block=20), "a", "b").collect()
    root = {r.vertex % 2**64: r.root for r in found}
    want = groups(prints, lambda a, b: bin(a ^ b).count("1") <= 4)
    for i in range(len(prints)):
        for j in range(i):
            same = root.get(prints[i], prints[i]) == root.get(prints[j], prints[j])
            assert same == (want[i] == want[j])


def test_components_of_chain_star_and_cycle(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (300, 300), (7, 6)]
    table = spark.createDataFrame(links + [(None, 5), (5, None)], "a long, b long")
    got = {r.vertex: r.root for r in components(table, "a", "b").collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200, 202: 200}
    assert got == want
    assert components(table.where("a < 0"), "a", "b").count() == 0
