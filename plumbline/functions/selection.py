"""Exact quantiles of whole columns without shuffling the rows.

Each pass over the table is one aggregate whose tasks hand on sketches and counts. A sketch names two values around the
wanted positions, the next pass counts what lies below, on and between them, and a bracket with few rows inside hands
those on. Larger ones are narrowed by another sketch of their inside: each pass keeps about a hundredth, so a trillion
rows take five. The sketches only decide how many passes there are; the counts decide the answer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import quoted
from .stages import at_once

#: Size of a sketch, slack in shares of the rows on both sides of a sketched one, rows inside a bracket that may be handed
#: to the driver, values around which a larger bracket is narrowed, brackets in one pass.
SKETCH, SLACK, GATHERED, GRID, TOGETHER = 4_000, 0.002, 20_000, 400, 16


@dataclass
class _Bracket:
    """Positions ``first`` and ``last`` (from 0) of a column's order, between the values ``low`` and ``high``."""

    column: str
    first: int
    last: int
    low: float
    high: float
    inside: int  # at most so many rows lie strictly between
    found: tuple[float, float] | None = None


def _inside(b: _Bracket) -> Column:
    x = F.col(quoted(b.column))
    return F.when((x > b.low) & (x < b.high), x)


def _sketched(x: Column, shares: Sequence[float]) -> Column:
    return F.when(F.count(x) > 0, F.kll_sketch_get_quantile_double(
        F.kll_sketch_agg_double(x, F.lit(SKETCH)), F.array(*[F.lit(float(s)) for s in shares])))


def sketch(x: Column, shares: Sequence[float]) -> Column:
    """Two values for each share of a double column, a little below and above it."""
    return _sketched(x, [s for share in shares for s in (max(0.0, share - SLACK), min(1.0, share + SLACK))])


def _bracket(column: str, n: int, share: float, low: float, high: float) -> _Bracket:
    at = (n - 1) * share
    return _Bracket(column, math.floor(at), math.ceil(at), low, high, math.ceil(n * 4 * SLACK) + 2)


def _gathered(df: DataFrame, brackets: dict[int, _Bracket]) -> dict[int, list[float]]:
    """The values inside small brackets, in order."""
    if not brackets:
        return {}
    parts = ", ".join(f"{i}, v{i}" for i in brackets)
    rows = df.select(*[_inside(b).alias(f"v{i}") for i, b in brackets.items()]).where(F.coalesce(*[F.col(f"v{i}") for i in brackets]).isNotNull())
    found = rows.selectExpr(f"stack({len(brackets)}, {parts}) as (bracket, value)").where("value is not null").toArrow()
    ids, values = (found[c].to_numpy() for c in ("bracket", "value"))
    return {i: np.sort(values[ids == i]).tolist() for i in brackets}


def _narrow(df: DataFrame, brackets: list[_Bracket]) -> None:
    """One pass: settle brackets or move their ends towards the wanted positions."""
    small = {i: b for i, b in enumerate(brackets) if b.inside <= GATHERED}
    wide = {i: b for i, b in enumerate(brackets) if b.inside > GATHERED}
    counts = []
    for i, b in enumerate(brackets):
        x = F.col(quoted(b.column))
        counts += [F.count_if(x < b.low).alias(f"below{i}"), F.count_if(x == b.low).alias(f"low{i}"), F.count(_inside(b)).alias(f"in{i}"),
                   F.count_if(x == b.high).alias(f"high{i}")]
    row, held, grids = at_once(
        df.agg(*counts).first,
        lambda: _gathered(df, small),
        lambda: df.agg(*[_sketched(_inside(b), [i / GRID for i in range(GRID + 1)]).alias(f"values{i}") for i, b in wide.items()]).first() if wide else {},
    )
    for i, b in enumerate(brackets):
        start, upto = row[f"below{i}"] + row[f"low{i}"], row[f"below{i}"] + row[f"low{i}"] + row[f"in{i}"]
        gathered = i in small
        values = held[i] if gathered else grids[f"values{i}"] or []
        end = upto + (row[f"high{i}"] if b.high > b.low else 0)
        if b.first < row[f"below{i}"] or b.last >= end:  # a sketch missed its promise: begin again with all rows
            b.low, b.high, b.inside = -math.inf, math.inf, max(b.last, GATHERED) + 1
            continue

        def value(position: int) -> float:
            return b.low if position < start else b.high if position >= upto else values[position - start]

        if gathered or all(not start <= p < upto for p in (b.first, b.last)):
            b.found = value(b.first), value(b.last)
            continue
        size = row[f"in{i}"]
        left = math.floor((max(b.first, start) - start) / size * GRID) - 2
        right = math.ceil((min(b.last, upto - 1) - start + 1) / size * GRID) + 2
        if b.first >= start and left >= 0:
            b.low = values[left]
        if b.last < upto and right <= GRID:
            b.high = values[right]
        b.inside = math.ceil(size * ((min(right, GRID) - max(left, 0)) / GRID + 4 * SLACK)) + 2


def settle_quantiles(df: DataFrame, sizes: dict[str, int], ends: dict[str, Sequence[float]], shares: Sequence[float]) -> dict[str, list[float]]:
    """Linearly interpolated quantiles per column, from its number of values and the result of :func:`sketch`."""
    found: dict[str, list[float]] = {c: [] for c, n in sizes.items() if n}
    open_ = [_bracket(c, sizes[c], s, *ends[c][2 * i : 2 * i + 2]) for c in found for i, s in enumerate(shares)]
    every = list(open_)
    while open_:
        for at in range(0, len(open_), TOGETHER):
            _narrow(df, open_[at : at + TOGETHER])
        open_ = [b for b in open_ if b.found is None]
    for b, share in zip(every, list(shares) * len(found)):
        at = (sizes[b.column] - 1) * float(share)
        low, high = b.found
        found[b.column].append(low + (high - low) * (at - math.floor(at)) + 0.0)
    return found


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float]]:
    """``{column: quantiles}`` of double columns without NaN; a column without values is left out."""
    columns = list(columns)
    if not columns:
        return {}
    row = df.agg(*[a for i, c in enumerate(columns) for a in (
        F.count(quoted(c)).alias(f"n{i}"), sketch(F.col(quoted(c)), shares).alias(f"q{i}"))]).first()
    return settle_quantiles(df, {c: row[f"n{i}"] for i, c in enumerate(columns)},
                            {c: row[f"q{i}"] for i, c in enumerate(columns)}, shares)
