"""Distributed ranks, positions and exact quantiles.

A global ``Window.orderBy`` would pull the table into one task. Here rows are first
reduced to distinct values with counts, the value range is cut at boundaries taken
from one ``percentile_approx`` pass, ranks are counted inside each range, and the
ranges (at most one per shuffle partition) are stitched with cumulative offsets.
The range of a row is a pure function of its value, so retries and re-planning can
not move it. A value repeated billions of times is one row by then.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import NUMERIC, TEMPORAL, field_type, key_number, quoted
from .stages import settle

_MAX_RANGES = 20_000
_TEXT_CUTS, _TEXT_SAMPLE = 127, 4096
COUNT, RANGE = "_count", "_range"


def range_count(df: DataFrame) -> int:
    return max(2, min(_MAX_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))


def boundaries(df: DataFrame, columns: Iterable[str], ranges: int | None = None) -> dict[str, list[float]]:
    """Increasing cut points per numeric column, from one aggregation over the table."""
    columns = list(columns)
    ranges = ranges or range_count(df)
    shares = [i / ranges for i in range(1, ranges)]
    accuracy = max(10_000, 10 * ranges)
    row = df.agg(
        *[
            F.percentile_approx(F.col(quoted(c)).cast("double"), shares, accuracy).alias(f"b{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    return {c: sorted(set(row[f"b{i}"] or [])) for i, c in enumerate(columns)}


def with_range(df: DataFrame, column: str, cuts: Sequence[float], out: str = RANGE) -> DataFrame:
    """Number of cut points at or below the value, found by binary search in the JVM."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    stage = Bucketizer(splits=splits, inputCol=column, outputCol=out, handleInvalid="keep")
    # Never null, so that no null filter is pushed into one of two otherwise equal branches.
    return stage.transform(df).withColumn(out, F.coalesce(F.col(out).cast("int"), F.lit(0)))


def with_cell(df: DataFrame, key: str) -> DataFrame:
    """Add ``_cell``, a number that never decreases as the key grows; only the layout of the work depends on it.

    Text is cut at whole texts, so keys that begin alike spread as well as others.
    """
    if isinstance(field_type(df, key), NUMERIC + TEMPORAL):
        ranged = df.withColumn("_keynum", key_number(df, key))
        return with_range(ranged, "_keynum", boundaries(ranged, ["_keynum"])["_keynum"], "_cell").drop("_keynum")
    text = F.col(quoted(key)).cast("string")
    return df.withColumn("_cell", F.coalesce(_text_cell(text, text_boundaries(df, key)), F.lit(0)))


def text_boundaries(df: DataFrame, key: str) -> list[str]:
    """At most ``_TEXT_CUTS`` increasing texts from a random sample of rows, in the order Spark compares text."""
    text = F.col(quoted(key)).cast("string").alias("k")
    sample = df.select(text).where(F.col("k").isNotNull()).orderBy(F.rand(7)).limit(_TEXT_SAMPLE).collect()
    found = sorted({r["k"] for r in sample}, key=lambda k: k.encode())
    step = max(1, len(found) // (_TEXT_CUTS + 1))
    return found[step::step][:_TEXT_CUTS]


def _text_cell(text: Column, cuts: Sequence[str], first: int = 0) -> Column:
    """How many cuts are at or below the text, by comparing with the middle one, then in one half."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    return F.when(text < F.lit(cuts[middle]), _text_cell(text, cuts[:middle], first)).otherwise(
        _text_cell(text, cuts[middle + 1:], first + middle + 1))


def _cols(names: Iterable[str]) -> list[Column]:
    return [F.col(quoted(n)) for n in names]


def place(counts: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``less``, ``ties`` and ``total`` to pre-counted rows.

    ``counts`` carries ``by`` columns, ``value``, ``_count`` and ``_range``; several
    rows may share a value. ``less`` counts smaller values inside the ``by`` group,
    ``ties`` the equal ones, ``total`` the whole group.
    """
    by = list(by)
    inside = Window.partitionBy(*_cols(by), F.col(RANGE)).orderBy(quoted(value))
    ordered = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = inside.rangeBetween(Window.currentRow, Window.currentRow)  # one sort serves both
    sizes = counts.groupBy(*_cols(by), RANGE).agg(F.sum(COUNT).alias("_size"))
    stitch = Window.partitionBy(*_cols(by)) if by else Window.partitionBy(F.lit(0))
    running = stitch.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select(
        *_cols(by),
        F.col(RANGE),
        (F.sum("_size").over(running) - F.col("_size")).alias("_offset"),
        F.sum("_size").over(stitch).alias("total"),
    )
    placed = counts.withColumns(
        {"_upto": F.sum(COUNT).over(ordered), "ties": F.sum(COUNT).over(same)}
    )
    # Null-safe keys keep the rows of a missing group; ranges are never null.
    left, right = placed.alias("p"), offsets.alias("o")
    on = F.col(f"p.{RANGE}") == F.col(f"o.{RANGE}")
    for name in by:
        on = on & F.col(f"p.{quoted(name)}").eqNullSafe(F.col(f"o.{quoted(name)}"))
    return left.join(right, on).select(
        *[F.col(f"p.{quoted(c)}") for c in counts.columns],
        (F.col("_upto") - F.col("ties") + F.col("_offset")).alias("less"),
        F.col("ties"),
        F.col("total"),
    )


def value_counts(
    df: DataFrame, value: str, by: Sequence[str] = (), cuts: Sequence[float] | None = None
) -> DataFrame:
    """Distinct non-null values with counts and ranges, ready for :func:`place`."""
    rows = df.where(F.col(quoted(value)).isNotNull())
    if cuts is None:
        cuts = boundaries(rows, [value])[value]
    counts = rows.groupBy(*_cols(by), F.col(quoted(value))).agg(F.count(F.lit(1)).alias(COUNT))
    return with_range(counts, value, cuts)


def rank_table(df: DataFrame, value: str, by: Sequence[str] = (), cuts: Sequence[float] | None = None) -> DataFrame:
    """One row per distinct value: ``less``, ``ties``, ``total`` and the average rank."""
    placed = place(value_counts(df, value, by, cuts), value, by)
    return placed.withColumn("avg_rank", F.col("less") + (F.col("ties") + 1) / 2.0)


def quantiles_of(placed: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles ``q0, q1, …`` from the output of :func:`place`."""
    picks, outs = [], [*_cols(by), F.col("n")]
    v, less, upto = F.col(quoted(value)), F.col("less"), F.col("less") + F.col("ties")
    for i, p in enumerate(probs):
        at = (F.col("total") - 1) * F.lit(float(p))
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (less <= pos) & (pos < upto)
            picks.append(F.max(F.when(hit, v)).alias(f"_{side}{i}"))
        frac = (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
        outs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(f"q{i}"))
    return placed.groupBy(*_cols(by)).agg(F.max("total").alias("n"), *picks).select(*outs)


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of a double column, overall or per group."""
    return quantiles_of(place(value_counts(df, value, by), value, by), value, probs, by)


def column_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values of many double columns: ``(column, value, _range, _count)``.

    Each column is cut at its own boundaries; all columns share one shuffle.
    """
    columns = list(columns)
    cuts = boundaries(df, columns)
    ranged, parts = df.select(*_cols(columns)), []
    for i, c in enumerate(columns):
        ranged = with_range(ranged, c, cuts[c], f"_r{i}")
        parts.append(f"'{c}', {quoted(c)}, _r{i}")
    longform = ranged.selectExpr(f"stack({len(columns)}, {', '.join(parts)}) as (column, value, {RANGE})")
    return longform.where("value is not null").groupBy("column", "value", RANGE).agg(F.count(F.lit(1)).alias(COUNT))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of many double columns in one job: ``(column, n, q0, …)``."""
    return quantiles_of(place(column_counts(df, columns), "value", ["column"]), "value", probs, ["column"])


def column_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, ties, total, avg_rank)`` per distinct value of each column, written once."""
    placed = place(column_counts(df, columns), "value", ["column"])
    return settle(
        placed.select("column", "value", "ties", "total", (F.col("less") + (F.col("ties") + 1) / 2.0).alias("avg_rank"))
    )


def _number(cells: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """Add ``position`` (1-based, by value then key) and ``n_positions`` to rows with ``_range`` and ``_cell``.

    A heavily repeated value is cut into cells by ranges of the key; a cell starts after
    the smaller values and after the earlier cells of its own value.
    """
    at = [*by, value, "_cell"]
    counts = cells.groupBy(*_cols(at), RANGE).agg(F.count(F.lit(1)).alias(COUNT))
    earlier = (
        Window.partitionBy(*_cols(by), RANGE, quoted(value))
        .orderBy("_cell")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = place(counts, value, by).select(
        *[F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(at)],
        F.col("total").cast("long").alias("n_positions"),
        (F.col("less") + F.coalesce(F.sum(COUNT).over(earlier), F.lit(0))).alias("_start"),
    )
    numbered = cells.withColumn("_rn", F.row_number().over(Window.partitionBy(*_cols(at)).orderBy(quoted(key))))
    on = F.lit(True)
    for i, c in enumerate(at):
        on = on & F.col(quoted(c)).eqNullSafe(F.col(f"_k{i}"))
    joined = numbered.join(starts, on)
    kept = [c for c in cells.columns if c not in (RANGE, "_cell")]
    return joined.select(*_cols(kept), (F.col("_start") + F.col("_rn")).cast("long").alias("position"), "n_positions")


def ordinal_positions(df: DataFrame, values: Sequence[str], key: str) -> DataFrame:
    """``(key, column, value, position, n_positions)``: each row's place in the order of each value column.

    All value columns are ordered in one job, without a global sort; ties go by key.
    """
    ranged = with_cell(df, key)
    cuts = boundaries(df, values)
    parts = []
    for i, v in enumerate(values):
        ranged = with_range(ranged, v, cuts[v], f"_r{i}")
        parts.append(f"'{v}', cast({quoted(v)} as double), _r{i}")
    cells = ranged.select(
        F.col(quoted(key)).alias("key"), "_cell", F.expr(f"stack({len(values)}, {', '.join(parts)}) as (column, value, {RANGE})")
    )
    return _number(cells, ["column"], "value", "key")


def series_positions(df: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """All columns plus ``position`` and ``n_positions`` within each ``by`` group, by (value, key)."""
    cells = with_range(with_cell(df, key), value, boundaries(df, [value])[value])
    return _number(cells, by, value, key)


def cumulate(counts: DataFrame, value: str, measures: Sequence[str]) -> DataFrame:
    """Running sums of several measures in value order (one row per distinct value, ``_range`` given).

    Adds ``upto_<m>`` and ``all_<m>`` for each measure.
    """
    inside = Window.partitionBy(RANGE).orderBy(quoted(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(0))
    before = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy(RANGE).agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    offsets = sizes.select(
        F.col(RANGE).alias("_r"),
        *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(whole).alias(f"all_{m}") for m in measures],
    )
    local = counts.withColumns({f"_u_{m}": F.sum(m).over(inside) for m in measures})
    return local.join(offsets, F.col(RANGE) == F.col("_r")).select(
        *[F.col(quoted(c)) for c in counts.columns],
        *[(F.col(f"_u_{m}") + F.col(f"_o_{m}")).alias(f"upto_{m}") for m in measures],
        *[F.col(f"all_{m}") for m in measures],
    )
