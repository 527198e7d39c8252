"""Token counts against the tokenizers' library; spelling variants against all pairs."""

import random
import zlib
from collections import Counter as Tally

import numpy as np
import pytest

from plumbline.llm import spelling, token_counts

ODD = [
    "", " ", "\n \n", "'s", "''s", "'re 'r 've'll'  'll\n's", "a  b   c\n\n d \t\t'x 's'sa'S", "12'34 １２ ½ é'll",
    "x<|endoftext|>y <|endoftext|> ", "a  b c\x85d \x1c e", "'" * 50, "ab" * 500, "z" * 300 + "'ve" + "q" * 90,
    " ᲊx꟎1 ͸", "漢字かな 😀😀 ́", "a" * 20_000,
]


def _library(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_counts.tokenizer_path())
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _mixed(count, seed=1):
    rng = random.Random(seed)
    parts = ["'", "s", "t", "r", "e", "v", "l", "m", "d", " ", "\n", "\t", "a", "1", "!", "é", "漢", "😀", "A", "re", "ll", "the", "ing"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(count)]


def test_token_counts_as_the_library_gives_them(spark):
    texts = ODD + _mixed(2000)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "y"), (0, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts.count_tokens(docs).collect()
    assert len(got) == len(rows) and len(token_counts.count_tokens(docs.limit(0)).collect()) == 0
    by_id = {r["doc_id"]: r for r in got if r["doc_id"]}
    for i, (text, tokens) in enumerate(zip(texts, _library(texts))):
        if i:
            assert by_id[i]["n_tokens"] == tokens, text
            assert by_id[i]["n_bytes"] == len(text.encode()) and by_id[i]["over_limit"] == (tokens > 1024)


def test_token_counts_survive_a_small_state_table_and_cuts(monkeypatch):
    monkeypatch.setattr(token_counts, "_STATES", 50)
    monkeypatch.setattr(token_counts, "_TOGETHER", 200)
    counter = token_counts.Counter(token_counts.tokenizer_path())
    texts = ODD + _mixed(300, 2) + [" ".join(_mixed(100, 3))]
    assert counter.count(texts).tolist() == _library(texts)


def test_chunk_maps_do_not_depend_on_the_chunk(monkeypatch):
    splitter = token_counts.Counter.at(token_counts.tokenizer_path()).splitter
    codes = np.array([ord(c) for c in "".join(_mixed(200, 4))] + [0x110000], np.uint32)
    monkeypatch.setattr(token_counts, "_CHUNK", len(codes))  # one chunk: no scan at all
    whole = splitter.begins(codes)
    for size in (1, 2, 7, 128):
        monkeypatch.setattr(token_counts, "_CHUNK", size)
        assert (splitter.begins(codes) == whole).all()


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(token_counts.tokenizer_path("word_bpe_49k.json"))


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _variants(tally, ratio=5):
    out = {}
    for word, n in tally.items():
        near = [w for w in tally if w != word and _near(word, w)]
        best = min(near, key=lambda w: (-tally[w], w), default=None)
        form = best if best is not None and tally[best] >= ratio * n else None
        out[word] = (form, n, len(near), tally[form] if form else None)
    rows = set()
    for word, (form, n, near, form_n) in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        rows.add((word, form, root, n, near, form_n))
    return rows


def test_variants_against_all_pairs(spark):
    rng = random.Random(5)
    alphabet = "abcdeéÀÿ÷"
    base = ["".join(rng.choices(alphabet, k=rng.randint(6, 9))) for _ in range(60)]
    tally = {}
    for word in base:
        for step in range(12):
            k, kind = rng.randrange(len(word)), rng.randrange(4)
            word = (word[:k] + rng.choice(alphabet) + word[k:] if kind == 0 else word[:k] + word[k + 1 :] if kind == 1
                    else word[:k] + rng.choice(alphabet) + word[k + 1 :] if kind == 2 else "".join(rng.sample(word, len(word))))
            if len(word) >= 6:
                tally[word] = rng.choice([5, 5, 25, 125, 700, 4000])
    for i in range(40):  # words of equal letter counts, which no plane parts
        tally["".join(rng.sample("abcdeabcde", 10))] = 5 + i
    words = spark.createDataFrame(list(tally.items()), "word string, n long")
    for cell in (spelling.CELL, 20):
        assert {tuple(r) for r in spelling.group_variants(words, cell=cell).collect()} == _variants(tally)
    assert spelling.group_variants(words.limit(0)).collect() == []


def test_words_of_documents(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["Straßen", "straßen", "Élan×vital", "worders", "wordérs", "o'clockwise", "abc12defghi"], k=80)) for _ in range(40)]
    rows = [(i, t, "u") for i, t in enumerate(texts)] + [(None, "worders " * 9, "v"), (77, None, "w"), (78, "", "w"), (0, texts[0], "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    import re

    tally = Tally()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            tally[word] += 1
    tally = {w: n for w, n in tally.items() if len(w) >= 6 and n >= 5}
    assert {tuple(r) for r in spelling.variants_of(docs).collect()} == _variants(tally)
    assert spelling.variants_of(docs.where("text is null")).collect() == []
