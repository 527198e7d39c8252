"""K-means with automatic k, cluster profiles, principal components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import numeric, quoted
from ..functions.stages import settle
from .prep import Plan, Roles, encode, encoded_names, learn

LABEL = "cluster"
K_RANGE = (2, 10)
STARTS = 3
#: Rounds over all rows and over the sample, movement that counts as none, rows of the sample, and how many numbers the
#: centres of the models in one pass may have together.
ROUNDS, SAMPLE_ROUNDS, STILL, SAMPLE, CENTRE_ENTRIES = 40, 100, 1e-4, 2_000, 1 << 20
#: Directions in a block, blocks held at once, passes, and the share of the widest variance that may be left over.
BLOCK, AXIS_BLOCKS, AXIS_PASSES, AXIS_STILL = 24, 6, 80, 1e-9


@dataclass
class Clustering:
    labelled: DataFrame
    k: int
    silhouette: float | None
    sizes: dict[int, int] = field(default_factory=dict)


@dataclass
class _Rows:
    """Encoded rows in files: ``x`` (scaled numbers) and ``slots`` (one per nominal column, -1 for an unseen level)."""

    data: DataFrame
    plan: Plan
    width: int
    slots: int


def _columns(plan: Plan) -> tuple[Column, Column]:
    ordered = len(plan.roles.numeric + plan.roles.ordinal)
    names, offset, slots = encoded_names(plan), 0, []
    for i, c in enumerate(plan.roles.nominal):
        size = plan.sizes.get(c, 0)
        at = F.col(names[ordered + i])
        slots.append(F.when(at < size, at.cast("int") + offset).otherwise(-1))
        offset += size
    x = F.array(*[F.col(c) for c in names[:ordered]]) if ordered else F.array().cast("array<double>")
    return x.alias("x"), (F.array(*slots) if slots else F.array().cast("array<int>")).alias("slots")


def _encoded(df: DataFrame, roles: Roles) -> _Rows:
    if not roles.names:
        raise ValueError("There is no usable feature column.")
    plan = learn(df, roles, True)
    data = settle(encode(df, plan).select(*_columns(plan)))
    return _Rows(data, plan, len(roles.numeric + roles.ordinal), sum(plan.sizes.get(c, 0) for c in roles.nominal))


def _split(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
    return x, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _squares(x: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (x * x).sum(1) + (slots >= 0).sum(1)


def _products(x: np.ndarray, slots: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Rows times centres; a nominal column adds the centre's entry at the row's slot."""
    out = x @ centres[:, : x.shape[1]].T
    for j in range(slots.shape[1]):
        known = slots[:, j] >= 0
        out[known] += centres[:, x.shape[1] + slots[known, j]].T
    return out


def _gaps(x: np.ndarray, slots: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres."""
    return np.maximum(_squares(x, slots)[:, None] - 2 * _products(x, slots, centres) + (centres * centres).sum(1), 0.0)


def _seeded(x: np.ndarray, slots: np.ndarray, k: int, seed: int, slots_in_all: int) -> np.ndarray:
    """Greedy k-means++ and rounds on a sample, the best of ``STARTS``: where the rounds over all rows start."""
    made = [_start(x, slots, k, np.random.default_rng([seed, start]), slots_in_all) for start in range(STARTS)]
    return min(made, key=lambda centres: _gaps(x, slots, centres).min(1).sum())


def _start(x: np.ndarray, slots: np.ndarray, k: int, rng: np.random.Generator, slots_in_all: int) -> np.ndarray:

    def dense(index: np.ndarray) -> np.ndarray:
        out = np.zeros((len(index), x.shape[1] + slots_in_all))
        out[:, : x.shape[1]] = x[index]
        for j in range(slots.shape[1]):
            known = slots[index, j] >= 0
            out[np.flatnonzero(known), x.shape[1] + slots[index[known], j]] = 1.0
        return out

    chosen = [int(rng.integers(len(x)))]
    nearest = _gaps(x, slots, dense(np.array(chosen)))[:, 0]
    for _ in range(k - 1):
        total = nearest.sum()
        tries = rng.choice(len(x), 2 + int(np.log(k)), p=nearest / total if total > 0 else None)
        left = np.minimum(nearest[:, None], _gaps(x, slots, dense(tries)))
        best = int(left.sum(0).argmin())  # of a few draws, the one that leaves least
        chosen.append(int(tries[best]))
        nearest = left[:, best]
    centres = dense(np.array(chosen))
    for _ in range(SAMPLE_ROUNDS):
        label = _gaps(x, slots, centres).argmin(1)
        moved = centres.copy()
        for c in np.unique(label):
            own = label == c
            moved[c] = 0.0
            moved[c, : x.shape[1]] = x[own].sum(0)
            given = slots[own]
            np.add.at(moved[c], x.shape[1] + given[given >= 0], 1.0)
            moved[c] /= own.sum()
        if np.abs(moved - centres).max() <= STILL:
            break
        centres = moved
    return centres


_COST, _COUNT, _SQUARE = -1, -2, -3


def _sums(models: list[np.ndarray], width: int):
    """Per task: for every centre of every model the sums of its rows by dimension, their number, squares and cost."""
    starts = np.concatenate([[0], np.cumsum([len(m) for m in models])]).tolist()
    centres = np.concatenate(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), width + 3))
        seen: dict[int, float] = {}  # centre and slot → rows; no more than the rows have slots
        span = centres.shape[1] + 1
        for batch in batches:
            if not batch.num_rows:
                continue
            x, slots = _split(batch, width)
            gaps, squares = _gaps(x, slots, centres), _squares(x, slots)
            for a, b in zip(starts, starts[1:]):
                own = gaps[:, a:b].argmin(1)
                label, size = own + a, len(centres)
                for f in range(width):
                    total[:, f] += np.bincount(label, x[:, f], size)
                total[:, width] += np.bincount(label, gaps[np.arange(len(x)), label], size)
                total[:, width + 1] += np.bincount(label, minlength=size)
                total[:, width + 2] += np.bincount(label, squares, size)
                for j in range(slots.shape[1]):
                    known = slots[:, j] >= 0
                    keys, times = np.unique(label[known] * span + slots[known, j], return_counts=True)
                    for key, n in zip(keys.tolist(), times.tolist()):
                        seen[key] = seen.get(key, 0.0) + n
        dims = [*range(width), _COST, _COUNT, _SQUARE]
        where, column = np.nonzero(total)
        keys = np.fromiter(seen, np.int64, len(seen))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([where, keys // span]), pa.int32()),
            pa.array(np.concatenate([np.array(dims)[column], width + keys % span]), pa.int32()),
            pa.array(np.concatenate([total[where, column], np.fromiter(seen.values(), float, len(seen))])),
        ], names=["centre", "dim", "value"])

    return run


def _pass(rows: _Rows, models: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """Sums, sizes and squares of every model's clusters and its cost, all models in one job."""
    tall = rows.data.mapInArrow(_sums(models, rows.width), "centre int, dim int, value double")
    found = tall.groupBy("centre", "dim").agg(F.sum("value").alias("value")).toPandas()  # as many as the centres have entries
    sums = np.zeros((sum(len(m) for m in models), rows.width + rows.slots))
    special = {kind: np.zeros(len(sums)) for kind in (_COST, _COUNT, _SQUARE)}
    centre, dim, value = (found[c].to_numpy() for c in ("centre", "dim", "value"))
    sums[centre[dim >= 0], dim[dim >= 0]] = value[dim >= 0]
    for kind, out in special.items():
        out[centre[dim == kind]] = value[dim == kind]
    out, at = [], 0
    for m in models:
        part = slice(at, at + len(m))
        out.append((sums[part], special[_COUNT][part], special[_SQUARE][part], float(special[_COST][part].sum())))
        at += len(m)
    return out


def _fitted(rows: _Rows, sizes: Sequence[int], restarts: int) -> dict[int, tuple[np.ndarray, float]]:
    """Per k the centres of the restart with the least cost; all restarts of all k go round together.

    Models that stand still drop out. So many models share a pass that their centres stay within a fixed size.
    """
    order = F.xxhash64("x", "slots")
    sample = rows.data.orderBy(order, "x", "slots").limit(SAMPLE).toArrow()
    x, slots = _split(sample.combine_chunks().to_batches()[0], rows.width)
    wide = rows.width + rows.slots
    keys = [(k, seed) for k in sizes for seed in range(restarts)]
    best: dict[int, tuple[np.ndarray, float]] = {}
    together = max(1, CENTRE_ENTRIES // (max(sizes) * max(1, wide)))
    for at in range(0, len(keys), together):
        open_ = {key: _seeded(x, slots, *key, rows.slots) for key in keys[at : at + together]}
        for turn in range(ROUNDS):
            for key, (sums, counts, _, cost) in zip(list(open_), _pass(rows, list(open_.values()))):
                old = open_[key]
                new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], old)
                open_[key] = new
                if np.sqrt(((new - old) ** 2).sum(1)).max() <= STILL or turn == ROUNDS - 1:
                    del open_[key]
                    if key[0] not in best or cost < best[key[0]][1]:
                        best[key[0]] = (old, cost)
            if not open_:
                break
    return best


def _silhouettes(rows: _Rows, models: list[np.ndarray], n: int) -> list[float | None]:
    """Mean silhouette with squared distances, from cluster sums; undefined for one cluster or all singletons."""
    known = _pass(rows, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(models))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, slots = _split(batch, rows_width)
            squares = _squares(x, slots)
            for i, (centres, (sums, counts, psi, _)) in enumerate(zip(models, known)):
                label = _gaps(x, slots, centres).argmin(1)
                used = np.flatnonzero(counts)
                mean = squares[:, None] + (psi[used] / counts[used]) - 2 * _products(x, slots, sums[used] / counts[used][:, None])
                own = np.searchsorted(used, label)
                at = np.arange(len(x))
                size = counts[label]
                a = np.maximum(mean[at, own], 0.0) * size / np.maximum(size - 1, 1)
                mean[at, own] = np.inf
                b = np.maximum(mean.min(1), 0.0)
                top = np.maximum(a, b)
                totals[i] += np.where((size > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models)), pa.int32()), pa.array(totals)], names=["model", "total"])

    rows_width = rows.width
    found = rows.data.mapInArrow(run, "model int, total double").groupBy("model").agg(F.sum("total").alias("total"))
    totals = {r["model"]: r["total"] for r in found.collect()}
    return [totals[i] / n if 2 <= np.count_nonzero(known[i][1]) <= n - 1 else None for i in range(len(models))]


def kmeans(df: DataFrame, roles: Roles, k: int | None = None, restarts: int = 10) -> Clustering:
    """Label rows; without ``k`` the best silhouette among 2 … 10 decides, smallest k first.

    Restarts begin with k-means++ and rounds on ``SAMPLE`` rows of lowest hash; the rounds that follow see all rows.
    """
    rows = _encoded(df.drop(LABEL), roles)
    n = rows.data.count()
    if k is not None and k > n:
        raise ValueError(f"{k} clusters were asked for, but there are only {n} rows.")
    if n < 2:
        return Clustering(df.withColumn(LABEL, F.lit(0)), 1, None, {0: n})
    sizes = [k] if k is not None else list(range(K_RANGE[0], min(K_RANGE[1], n - 1) + 1)) or [2]
    fitted = _fitted(rows, sizes, restarts)
    scores = _silhouettes(rows, [fitted[s][0] for s in sizes], n)
    chosen = max(range(len(sizes)), key=lambda i: (-np.inf if scores[i] is None else scores[i], -i))
    centres, width = fitted[sizes[chosen]][0], rows.width

    @F.arrow_udf("int")
    def nearest(x: pa.Array, slots: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.int32())
        both = _split(pa.RecordBatch.from_arrays([x, slots], names=["x", "slots"]), width)
        return pa.array(_gaps(*both, centres).argmin(1), pa.int32())

    labelled = encode(df.drop(LABEL), rows.plan).withColumn(LABEL, nearest(*_columns(rows.plan))).drop(*encoded_names(rows.plan))
    counts = {int(r[LABEL]): r["count"] for r in labelled.groupBy(LABEL).count().collect()}
    return Clustering(labelled, sizes[chosen], scores[chosen], dict(sorted(counts.items())))


def profile_numbers(df: DataFrame, columns: Sequence[str], label: str = LABEL) -> DataFrame:
    """``(label, size, mean_<c>…)`` per cluster."""
    return df.where(F.col(quoted(label)).isNotNull()).groupBy(quoted(label)).agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(numeric(df, c)).alias(f"mean_{c}") for c in columns]
    )


def profile_categories(df: DataFrame, columns: Sequence[str], label: str = LABEL) -> DataFrame:
    """``(label, column, dominant)``: most frequent value, smallest on ties."""
    pairs = ", ".join(f"'{c}', cast({quoted(c)} as string)" for c in columns)
    tall = df.select(F.col(quoted(label)), F.expr(f"stack({len(columns)}, {pairs}) as (column, value)"))
    counts = tall.dropna().groupBy(quoted(label), "column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(quoted(label), "column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("dominant")
    )


def _gram(rows: _Rows, block: np.ndarray) -> np.ndarray:
    """Transposed rows times (rows times the block): one job, and each task hands on as many numbers as the block has."""
    width, wide = rows.width, block.shape[1]
    turned = np.ascontiguousarray(block.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((turned.shape[1], wide))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, slots = _split(batch, width)
            y = _products(x, slots, turned)
            total[:width] += x.T @ y
            for j in range(slots.shape[1]):
                known = slots[:, j] >= 0
                np.add.at(total, width + slots[known, j], y[known])
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), *[pa.array(total[at, i]) for i in range(wide)]], names=["dim", *[f"c{i}" for i in range(wide)]])

    tall = rows.data.mapInArrow(run, "dim int, " + ", ".join(f"c{i} double" for i in range(wide)))
    found = tall.groupBy("dim").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(wide)]).toArrow()
    out = np.zeros(block.shape)
    if found.num_rows:
        out[found["dim"].to_numpy()] = np.stack([found[f"c{i}"].to_numpy() for i in range(wide)], axis=1)
    return out


def _axes(rows: _Rows, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """``(loadings, variances, means, total variance)`` of the ``n`` widest directions.

    A block of directions grows by what it leaves unexplained, one pass over the rows each time, until the wanted
    directions stand still; the driver holds a few blocks, never a square of the columns. Up to ``BLOCK`` columns take
    one pass, because the first block then spans them all.
    """
    wide = rows.width + rows.slots
    if not 1 <= n <= wide:
        raise ValueError(f"{n} components were asked for, but there are {wide} encoded columns.")
    (sums, counts, squares, _), = _pass(rows, [np.zeros((1, wide))])
    size = float(counts[0])
    means = sums[0] / max(size, 1.0)
    spread = max(size - 1.0, 1.0)

    def times(block: np.ndarray) -> np.ndarray:
        return (_gram(rows, block) - size * np.outer(means, means @ block)) / spread

    step = min(wide, max(n + 6, BLOCK))
    basis = np.eye(wide) if step == wide else np.linalg.qr(np.random.default_rng(0).normal(size=(wide, step)))[0]
    image = times(basis)
    for _ in range(AXIS_PASSES):
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        axes = basis @ turn[:, :step]
        left = image @ turn[:, :step] - axes * values[:step]
        if np.linalg.norm(left[:, :n], axis=0).max() <= AXIS_STILL * max(values[0], 1e-300):
            break
        if basis.shape[1] + step > AXIS_BLOCKS * step:
            basis, image = basis @ turn[:, : 2 * step], image @ turn[:, : 2 * step]
        for _ in range(2):
            left -= basis @ (basis.T @ left)
        fresh, sizes, _ = np.linalg.svd(left, full_matrices=False)
        fresh = fresh[:, sizes > AXIS_STILL * 1e-3 * max(values[0], 1e-300)]
        if not fresh.shape[1]:
            break
        basis, image = np.hstack([basis, fresh]), np.hstack([image, times(fresh)])
    total = (float(squares[0]) - size * float(means @ means)) / spread
    return axes[:, :n], np.maximum(values[:n], 0.0), means, total


def principal_components(df: DataFrame, roles: Roles, n: int = 2) -> tuple[DataFrame, list[float], np.ndarray]:
    """Add ``pca_0 …``; also the explained variance ratios and the loadings.

    A component's sign is fixed by making its largest loading positive.
    """
    rows = _encoded(df, roles)
    loadings, variances, means, total = _axes(rows, n)
    at = np.abs(loadings).argmax(0)
    loadings = loadings * np.where(loadings[at, np.arange(n)] >= 0, 1.0, -1.0)
    width, turned, middle = rows.width, np.ascontiguousarray(loadings.T), means @ loadings

    @F.arrow_udf("array<double>")
    def scores(x: pa.Array, slots: pa.Array) -> pa.Array:
        size = len(x)
        offsets = pa.array(np.arange(size + 1) * n, pa.int32())
        if not size:
            return pa.ListArray.from_arrays(offsets, pa.array([], pa.float64()))
        both = _split(pa.RecordBatch.from_arrays([x, slots], names=["x", "slots"]), width)
        return pa.ListArray.from_arrays(offsets, pa.array((_products(*both, turned) - middle).ravel()))

    scored = encode(df, rows.plan).withColumn("_scores", scores(*_columns(rows.plan)))
    out = scored.withColumns({f"pca_{j}": F.col("_scores")[j] for j in range(n)})
    ratios = [float(v) / total if total > 0 else 0.0 for v in variances]
    return out.drop(*encoded_names(rows.plan), "_scores"), ratios, loadings
