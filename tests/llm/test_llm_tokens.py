"""Packing, unigram tokens and the language model against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import kneser_ney, packing, unigram

SCHEMA = "doc_id long, text string, piece int, ids string, held_out string, shard int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "i", "h", 2) for i, t in rows], SCHEMA)


def prose(seed=1, n=40):
    rng = random.Random(seed)
    words = ["The", "the", "naïve", "Don't", "x2y", "--", "日本語", "é.", "STOP!!", "weiter", "ß", "H̱i", "and,", "a.b", "<|endoftext|>", "I'll"]
    return [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 30, 900])))) for i in range(n)]


ROWS = [*prose(), (None, None), (None, "tab\there\nline  two "), (3, "repeat"), (3, "repeat"), (99, "word " * 30_000)]


def test_pieces_match_the_tokenizer(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, t in ROWS:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    packed = packing.pack(docs(spark, ROWS).repartition(3))
    rows = packed.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_sequences_hold_the_ids(spark):
    rows = [(i, t) for i, t in ROWS if i != 99][:12]
    whole = packing.sequences(docs(spark, rows), length=64).collect()
    assert sum(len(r.ids) // 4 for r in whole) == sum(r.length for r in packing.pack(docs(spark, rows), length=64).collect())
    assert max(len(r.ids) for r in whole) <= 256


def test_sum_of_squares_by_the_definition():
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 20) for _ in range(200)), reverse=True)
    where, offset = packing.sum_of_squares(np.array(lengths), 20)
    gaps = {}
    for x, b, o in zip(lengths, where.tolist(), offset.tolist()):
        counts = Counter(g for g in gaps.values() if 0 < g < 20)

        def squares(gap):
            after = counts.copy()
            after[gap] -= 1
            after[gap - x] += gap > x
            return sum(n * n for n in after.values())

        fits = {g for g in counts if g >= x}
        if fits:
            assert gaps[b] in fits and squares(gaps[b]) == min(map(squares, fits)) and o == 20 - gaps[b]
        else:
            assert b not in gaps and o == 0
        gaps[b] = gaps.get(b, 20) - x


def test_no_documents(spark):
    empty = docs(spark, [])
    assert packing.pack(empty).count() == unigram.encode_and_check(empty).count() == kneser_ney.score_held_out(empty).count() == 0


def best_by_all_cuts(model, stretch):
    pieces = {model.pieces[i][0]: (model.pieces[i][1], i) for i in model.ids.tolist()}
    text = stretch.decode()
    best = [(0.0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 60), end):
            part = text[start:end].encode()
            if part in pieces:
                found = (best[start][0] + pieces[part][0], best[start][1] + [pieces[part][1]])
            elif end - start == 1:
                found = (best[start][0] + model.floor, best[start][1] + [model.bytes[b] for b in part])
            else:
                continue
            if best[end] is None or found[0] > best[end][0]:
                best[end] = found
    return best[-1][1]


def test_unigram_is_viterbi():
    model = unigram.Unigram.at(unigram.model_path())
    stretches = sorted({s for _, t in prose(7) for s in model.stretches((t or "x").encode())} | {"▁▁▁".encode(), "▁\U0001F600\t\né".encode()})
    for found, alone, stretch in zip(model.segment(stretches), map(model._one, stretches), stretches):
        assert found.tolist() == alone.tolist() == best_by_all_cuts(model, stretch)


def test_double_array_finds_exactly_its_keys():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"zz"]
    trie = unigram.DoubleArray(keys)

    def find(key):
        node = np.zeros(1, np.int64)
        for c in key:
            node = trie.step(node, np.array([c]))
            if node[0] < 0:
                return -1
        return int(trie.ends(node)[0])

    assert [find(k) for k in keys] == list(range(6))
    assert find(b"abcd") == find(b"z") == find(b"\xff") == find(b"") == -1


def test_encode_and_decode(spark):
    rows = [*ROWS, (5, " lead and  double   "), (6, "x" * 3000), (7, "日本" * 500), (8, "\x00\x01")]
    got = unigram.encode_and_check(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.restored and r.n_ids == len(r.ids) for r in got)
    back = unigram.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in got] + [(1, None)], "doc_id long, ids array<int>"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in [*rows, (1, "")]), key=str)


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\0end"]


@pytest.mark.parametrize("shard_bytes", [kneser_ney.SHARD_BYTES, 200])
def test_kneser_ney(spark, shard_bytes):
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 90}É" for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 40, 200])))) for i in range(60)]
    rows += [(None, None), (None, "W1É\tw2É x"), (7, rows[7][1]), (1000, "unseen words only"), (1001, "w1É " * 4000)]
    held = {i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows}
    count, pairs = Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            w = words_of(t)
            count.update(w)
            pairs.update(zip(["\0start", *w], w))
    n, v = sum(count.values()), len(count)
    follows, total, ns = Counter(w for _, w in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, _), c in pairs.items():
        total[a] += c
        ns[a][min(c, 3) - 1] += 1
    d2, d1 = (kneser_ney.discounts(*[sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in (pairs, follows))
    less = lambda c, d: c - d[min(c, 3) - 1] if c else 0.0
    left = sum(d1[min(c, 3) - 1] for c in follows.values()) / sum(follows.values())

    def p(a, w):
        low = less(follows[w], d1) / sum(follows.values()) + left / (v + 1)
        if not total[a]:
            return low
        return less(pairs[a, w], d2) / total[a] + sum(x * y for x, y in zip(d2, ns[a])) / total[a] * low

    assert abs(sum(p("w1é", w) for w in count) + p("w1é", "\0new") - 1) < 1e-9
    got = kneser_ney.score_held_out(docs(spark, rows).repartition(3), shard_bytes).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t in rows:
        w = words_of(t)
        want[i].append((held[i], len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w),
                        sum(math.log10(p(a, x)) for a, x in zip(["\0start", *w], w))))
    for r in got:
        assert any(tuple(r)[1:5] == x[:4] and np.allclose(tuple(r)[5:], x[4:], rtol=1e-9) for x in want[r.doc_id])
