"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

An edit that inserts or deletes a character changes one letter count by one, a replacement lowers one count and raises
another, so words one edit apart lie within an L1 distance of two (one, if their lengths differ). For each length there
is a tree whose planes cut the words by the count of one letter. A word searches the tree of its own length with one
step up and one step down to spend, and that of the next length with one step up. What is left is verified letter by
letter.

The upper planes of a tree are laid from a sample of the words and cut it into cells; every word goes to its home cell,
and as a query to every cell that its box meets (at most about a quarter of the square of the number of planes on a
path, and usually few). Within a cell's task the tree goes on, for all queries together. Tasks hand back one row per
word and cell with the number of near words and the best of them, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stages import settle
from .common import id_and_text

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words a cell should hold, sampled words per cell, and words at which a tree in a task stops.
CELL = 1 << 16
_SAMPLED = 64
_LEAF = 24
#: Letters a to z have a count each; the others share eight by their last three bits, which keeps distances bounds.
_DIMS = 34
_PAIRS = 1 << 16


def runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``word``: every maximal run of letters, A-Z in lower case; a null text has none."""
    lower = F.translate("text", _UPPER, _LOWER)
    words = F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))
    return id_and_text(docs).select("doc_id", F.explode(words).alias("word"))


def damaged(words: DataFrame, divisor: int = 199) -> DataFrame:
    """One character less where ``divisor`` divides h, the crc32 of ``doc_id:word``: the one at h modulo the length.

    A null doc_id counts as empty text.
    """
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
    hashed = words.withColumn("h", F.crc32(key.cast("binary")))
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return hashed.select("doc_id", F.when(F.col("h") % divisor == 0, cut).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """``word``, ``n``: distinct words long and frequent enough; counts add up before they are shuffled."""
    return (
        words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_count)
    )


def _letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of character codes (all are below 256)."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """Counts of a to z, and of all other characters by their last three bits."""
    plain = (letters >= 97) & (letters <= 122)
    dims = np.where(plain, letters.astype(np.int64) - 97, 26 + (letters & 7))
    out = np.zeros((len(letters), _DIMS), np.int32)
    np.add.at(out, (np.arange(len(letters))[:, None], dims), 1)
    return out


def _plane(points: np.ndarray) -> tuple[int, int] | None:
    """Letter and count that cut the points most evenly: below the count, and from it on."""
    best, half = None, 0
    for dim in np.argsort(-points.var(axis=0), kind="stable")[:6].tolist():
        values = np.sort(points[:, dim])
        middle = int(values[len(values) // 2])
        for cut in (middle, middle + 1):
            below = int(np.searchsorted(values, cut))
            if min(below, len(values) - below) > half:
                best, half = (dim, cut), min(below, len(values) - below)
    return best


def lay(points: np.ndarray, most: int) -> tuple | int:
    """A tree of planes over points, as (letter, count, below, from); leaves hold at most ``most`` and are numbers."""
    leaves = 0

    def grow(part: np.ndarray):
        nonlocal leaves
        plane = _plane(part) if len(part) > most else None
        if plane is None:
            leaves += 1
            return leaves - 1
        below = part[:, plane[0]] < plane[1]
        return (*plane, grow(part[below]), grow(part[~below]))

    return grow(points)


def cells(tree: tuple | int, points: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell for every cell that a point can reach with so many steps up and down; its own cell for none."""
    rows, found = [], []
    stack = [(tree, np.arange(len(points)), np.full(len(points), up), np.full(len(points), down))]
    while stack:
        node, who, ups, downs = stack.pop()
        if not len(who):
            continue
        if isinstance(node, int):
            rows.append(who)
            found.append(np.full(len(who), node))
            continue
        for child, need_up, need_down in _sides(node[1], points[who, node[0]]):
            ok = (need_up <= ups) & (need_down <= downs)
            stack.append((node[2 + child], who[ok], (ups - need_up)[ok], (downs - need_down)[ok]))
    return np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*found, np.zeros(0, np.int64)])


def _sides(cut: int, value: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each side of a plane: the steps up and down that a point needs to come there."""
    zero = np.zeros_like(value)
    yield 0, zero, np.maximum(value - cut + 1, 0)
    yield 1, np.maximum(cut - value, 0), zero


def near_in_cell(queries: np.ndarray, targets: np.ndarray, longer: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of queries and targets one edit apart, in blocks; targets have the queries' length or one more."""
    up, down = 1, 0 if longer else 1
    points, aims = letter_counts(queries), letter_counts(targets)
    n = len(queries)
    stack = [(np.arange(len(targets)), np.arange(n), np.full(n, up), np.full(n, down))]
    while stack:
        inside, who, ups, downs = stack.pop()
        if not len(who) or not len(inside):
            continue
        plane = _plane(aims[inside]) if len(inside) > _LEAF else None
        if plane is None:
            # A leaf without a plane holds words of equal counts only; it is met in blocks as well.
            wide = max(1, _PAIRS // len(inside))
            for at in range(0, len(who), wide):
                some = who[at : at + wide]
                for first in range(0, len(inside), _PAIRS):
                    part = inside[first : first + _PAIRS]
                    q, t = np.repeat(some, len(part)), np.tile(part, len(some))
                    gap = np.abs(points[q] - aims[t]).sum(1)
                    q, t = q[gap <= up + down], t[gap <= up + down]
                    ok = one_edit(queries[q], targets[t])
                    yield q[ok], t[ok]
            continue
        dim, cut = plane
        below = aims[inside, dim] < cut
        for child, need_up, need_down in _sides(cut, points[who, dim]):
            ok = (need_up <= ups) & (need_down <= downs)
            stack.append((inside[~below if child else below], who[ok], (ups - need_up)[ok], (downs - need_down)[ok]))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a and b differ by exactly one replaced character, or by one that b has more."""
    if not len(a):
        return np.zeros(0, bool)
    width = a.shape[1]
    if b.shape[1] == width:
        return (a != b).sum(1) == 1
    front = np.cumprod(a == b[:, :width], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    return front + back >= width


def _trees(words: DataFrame, cell: int) -> dict[int, tuple]:
    """Planes for each length with more words than a cell should hold.

    They come from about ``_SAMPLED`` words per cell, by lowest hash: a row in a thousand of the vocabulary.
    """
    sized = words.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("words"))
    large = {r["size"]: r["words"] for r in sized.where(F.col("words") > cell).collect()}
    trees = {}
    for size, count in large.items():
        wanted = -(-count // cell) * _SAMPLED
        of_size = words.where(F.length("word") == size)
        sample = [r["word"] for r in of_size.orderBy(F.xxhash64("word"), "word").limit(wanted).select("word").toLocalIterator()]
        trees[size] = lay(letter_counts(_letters(sample)), max(1, len(sample) * cell // count))
    return trees


def _routed(trees: dict[int, tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array(batch.column(0).to_pylist(), object)
            counts = np.asarray(batch.column(1))
            sizes = np.array([len(w) for w in words], np.int64)
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                points = letter_counts(_letters(list(words[mine])))
                # Home cells, other cells of the own length, cells of the next length.
                home = cells(trees.get(size, 0), points, 0, 0)
                own = np.empty(len(mine), np.int64)
                own[home[0]] = home[1]
                same = cells(trees.get(size, 0), points, 1, 1)
                other = same[1] != own[same[0]]
                above = cells(trees.get(size + 1, 0), points, 1, 0)
                row = np.concatenate([home[0], same[0][other], above[0]])
                cell = np.concatenate([home[1], same[1][other], above[1]])
                aim = np.repeat([size, size, size + 1], [len(home[0]), int(other.sum()), len(above[0])])
                is_home = np.arange(len(row)) < len(home[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(aim, pa.int32()), pa.array(cell, pa.int32()), pa.array(is_home),
                     pa.array(words[mine][row], pa.string()), pa.array(counts[mine][row], pa.int64())],
                    names=["size", "cell", "home", "word", "n"])

    return run


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """Per word of a cell: how many near words it met here, and the best of them."""
    words, counts, home = rows["word"].to_numpy(object), rows["n"].to_numpy(), rows["home"].to_numpy(bool)
    size = int(rows["size"].iloc[0])
    lengths = np.array([len(w) for w in words])
    targets = np.flatnonzero(home)
    met = np.zeros(len(rows), np.int64)
    best = np.full(len(rows), -1, np.int64)
    rank = np.empty(len(rows), np.int64)  # larger count first, then the smaller word
    by_word = np.argsort(words, kind="stable")
    rank[by_word[np.argsort(-counts[by_word], kind="stable")]] = np.arange(len(rows))
    if len(targets):
        aims = _letters(list(words[targets]))
        for longer in (False, True):
            asking = np.flatnonzero(lengths == (size - 1 if longer else size))
            if not len(asking):
                continue
            for q, t in near_in_cell(_letters(list(words[asking])), aims, longer):
                q, t = asking[q], targets[t]
                for a, b in ((q, t), (t, q)) if longer else ((q, t),):
                    np.add.at(met, a, 1)
                    order = np.lexsort((-rank[b], a))  # the last of each run is the best
                    a, b = a[order], b[order]
                    last = np.flatnonzero(np.r_[a[1:] != a[:-1], np.ones(min(1, len(a)), bool)])
                    a, b = a[last], b[last]
                    better = (best[a] < 0) | (rank[b] < rank[best[a]])
                    best[a[better]] = b[better]
    hit = np.flatnonzero(met)
    return pd.DataFrame({"word": words[hit], "n_near": met[hit], "best": words[best[hit]], "best_n": counts[best[hit]]})


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """Per word that has near words among ``words`` (word, n; settled): n_near, and of them the most frequent.

    Returns word, n_near, best, best_n; of equally frequent ones the first in code-point order.
    """
    routed = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(
        _routed(_trees(words, cell)), "size int, cell int, home boolean, word string, n long")
    found = routed.groupBy("size", "cell").applyInPandas(_search, "word string, n_near long, best string, best_n long")
    choice = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), choice.alias("choice")).select(
        "word", "n_near", F.col("choice.best").alias("best"), (-F.col("choice.less")).alias("best_n"))


def _roots(formed: DataFrame) -> DataFrame:
    """``word``, ``root`` for words that have a form; chains are followed by doubling, as counts grow along them."""
    steps = settle(formed.select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        joined = steps.join(on, F.col("root") == F.col("_at"), "left")
        after = settle(joined.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        steps = after.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 5, cell: int = CELL) -> DataFrame:
    """Per row of ``words`` (word, n): word, form, root, n, n_near, form_n.

    ``form`` is the near word with the largest n if that is at least ``ratio`` times the word's own, ``root`` the end of
    the chain of forms. Words must be distinct runs of the letters of ``RUN``; an empty table gives no rows.
    """
    words = settle(words)
    near = settle(near_words(words, cell))
    rows = settle(words.join(near, "word", "left").withColumn("formed", F.col("best_n") >= ratio * F.col("n")).select(
        "word", F.when(F.col("formed"), F.col("best")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("formed"), F.col("best_n")).alias("form_n")))
    roots = _roots(rows.where(F.col("form").isNotNull()))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_of(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5) -> DataFrame:
    """Variants among the words of whole documents after the damage of ``damaged``.

    A null or empty text has no words; documents without a doc_id take part; repeated rows count again; columns beside
    doc_id and text are not looked at.
    """
    return group_variants(vocabulary(damaged(runs(docs)), min_length, min_count), ratio)
