"""New feature columns: arithmetic, transforms, bins, calendar parts, group and row aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import finite, moment, numeric, present, quoted, require
from ..functions.guard import check_expression
from ..functions.joins import lookup
from ..functions.ordering import quantiles

BINARY_OPS = ("add", "subtract", "multiply", "divide", "ratio")
UNARY_FUNCS = ("log", "log1p", "sqrt", "square", "reciprocal", "abs", "zscore")
AGGREGATES = ("mean", "sum", "min", "max", "std", "median", "count")
DATE_PARTS = (
    "year", "quarter", "month", "week", "day", "dayofweek", "dayofyear", "hour",
    "is_weekend", "is_month_start", "is_month_end",
)
DEFAULT_DATE_PARTS = ("year", "month", "dayofweek", "is_weekend")


def _one_of(value: str, allowed: Sequence[str], what: str) -> None:
    if value not in allowed:
        raise ValueError(f"Unknown {what} {value!r}; choose one of {list(allowed)}.")


def need_numbers(df: DataFrame, *columns: str) -> None:
    """Raise when a numeric input has no numeric value at all; one pass for all inputs."""
    require(df, *columns)
    row = df.agg(*[F.count(numeric(df, c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    empty = [c for i, c in enumerate(columns) if row[i] == 0]
    if empty:
        raise ValueError(f"No numeric values in {empty}.")


def combine_columns(df: DataFrame, a: str, b: str, op: str, name: str | None = None) -> DataFrame:
    _one_of(op, BINARY_OPS, "operation")
    x, y = numeric(df, a), numeric(df, b)
    results = {
        "add": lambda: x + y,
        "subtract": lambda: x - y,
        "multiply": lambda: x * y,
        "divide": lambda: F.try_divide(x, y),
        "ratio": lambda: F.try_divide(x, y),
    }
    return df.withColumn(name or f"{a}_{op}_{b}", finite(results[op]()))


def transform_column(df: DataFrame, column: str, func: str, name: str | None = None) -> DataFrame:
    _one_of(func, UNARY_FUNCS, "transform")
    x = numeric(df, column)
    if func == "zscore":
        stats = df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
        out = F.try_divide(x - stats.select("mean").scalar(), stats.select("sd").scalar())
    else:
        out = {
            "log": lambda: F.when(x > 0, F.log(x)),
            "log1p": lambda: F.when(x > -1, F.log1p(x)),
            "sqrt": lambda: F.when(x >= 0, F.sqrt(x)),
            "square": lambda: x * x,
            "reciprocal": lambda: F.try_divide(F.lit(1.0), x),
            "abs": lambda: F.abs(x),
        }[func]()
    return df.withColumn(name or f"{func}_{column}", finite(out))


def bin_edges(df: DataFrame, column: str, n_bins: int, strategy: str) -> list[float]:
    """Inner bin edges: at most ``n_bins - 1`` numbers."""
    if n_bins < 2:
        raise ValueError("n_bins must be at least 2.")
    _one_of(strategy, ("quantile", "uniform"), "strategy")
    clean = df.select(numeric(df, column).alias("x"))
    if strategy == "uniform":
        lo, hi = clean.agg(F.min("x"), F.max("x")).first()
        if lo is None:
            raise ValueError(f"No numeric values in [{column!r}].")
        if lo == hi:
            pad = 0.001 * abs(lo) if lo else 0.001
            lo, hi = lo - pad, hi + pad
        return [lo + (hi - lo) * i / n_bins for i in range(1, n_bins)]
    row = quantiles(clean, "x", [i / n_bins for i in range(n_bins + 1)]).first()
    if row is None:
        raise ValueError(f"No numeric values in [{column!r}].")
    edges = sorted({row[f"q{i}"] for i in range(n_bins + 1)})
    return edges[1:-1] if len(edges) > 1 else [float("nan")]


def bin_column(
    df: DataFrame, column: str, n_bins: int = 4, strategy: str = "quantile", name: str | None = None
) -> DataFrame:
    """0-based bin index: the number of inner edges strictly below the value."""
    edges = bin_edges(df, column, n_bins, strategy)
    x = numeric(df, column)
    if edges == [float("nan")] or any(e != e for e in edges):
        index = F.lit(None).cast("bigint")  # a single distinct value has no quantile bins
    elif not edges:
        index = F.when(x.isNotNull(), F.lit(0).cast("bigint"))
    else:
        below = F.lit(0)
        for e in edges:
            below = below + F.when(x > e, 1).otherwise(0)
        index = F.when(x.isNotNull(), below.cast("bigint"))
    return df.withColumn(name or f"{column}_bin", index)


def expand_datetime(df: DataFrame, column: str, parts: Sequence[str] | None = None) -> DataFrame:
    parts = list(parts or DEFAULT_DATE_PARTS)
    for p in parts:
        _one_of(p, DATE_PARTS, "datetime part")
    t = moment(df, column)
    made = {
        "year": lambda: F.year(t),
        "quarter": lambda: F.quarter(t),
        "month": lambda: F.month(t),
        "week": lambda: F.weekofyear(t),
        "day": lambda: F.dayofmonth(t),
        "dayofweek": lambda: F.weekday(t),
        "dayofyear": lambda: F.dayofyear(t),
        "hour": lambda: F.hour(t.cast("timestamp_ntz")),
        "is_weekend": lambda: F.coalesce(F.weekday(t) >= 5, F.lit(False)),
        "is_month_start": lambda: F.coalesce(F.dayofmonth(t) == 1, F.lit(False)),
        "is_month_end": lambda: F.coalesce(F.to_date(t) == F.last_day(t), F.lit(False)),
    }
    return df.withColumns({f"{column}_{p}": made[p]() for p in parts})


def _group_stat(x: Column, agg: str) -> Column:
    return {
        "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count,
    }[agg](x)


def group_aggregate(
    df: DataFrame,
    group_by: str,
    value: str,
    agg: str = "mean",
    name: str | None = None,
    add_deviation: bool = False,
) -> DataFrame:
    """Give every row its group's statistic.

    Groups are reduced before the shuffle and joined back, so a group holding a third
    of all rows is never gathered in one place; medians come from ranged counts.
    """
    _one_of(agg, AGGREGATES, "aggregate")
    require(df, group_by, value)
    g = F.col(quoted(group_by))
    x = present(df, value) if agg == "count" else numeric(df, value)
    out = name or f"{value}_{agg}_by_{group_by}"
    known = df.where(g.isNotNull())
    stats: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    if agg != "median":
        stat = _group_stat(x, agg).cast("double")
        stats.append((F.coalesce(stat, F.lit(0.0)) if agg == "sum" else stat).alias("_stat"))
    if add_deviation:
        stats.append(F.avg(numeric(df, value)).alias("_mean"))
    table = known.groupBy(g.alias("_g")).agg(*stats)
    if agg == "median":
        clean = known.select(g.alias("_g"), numeric(df, value).alias("_x"))
        med = quantiles(clean, "_x", [0.5], ["_g"]).select("_g", F.col("q0").alias("_stat"))
        table = table.join(med, "_g", "left")
    outs = {"_stat": "_stat", **({"_mean": "_mean"} if add_deviation else {})}
    joined = lookup(df, group_by, table, "_g", "_rows", outs)
    added = {out: finite(F.col("_stat"))}
    if add_deviation:
        added[f"{value}_dev_from_{group_by}"] = finite(numeric(df, value) - F.col("_mean"))
    kept = [c for c in df.columns if c not in added]
    return joined.select(*[F.col(quoted(c)) for c in kept], *[c.alias(n) for n, c in added.items()])


def row_aggregate(df: DataFrame, columns: Sequence[str], agg: str = "sum", name: str | None = None) -> DataFrame:
    _one_of(agg, AGGREGATES, "aggregate")
    if len(columns) < 2:
        raise ValueError("row_aggregate needs at least 2 columns.")
    xs = [numeric(df, c) for c in columns]
    zero = F.lit(0.0)
    n = sum((F.when(x.isNotNull(), 1.0).otherwise(0.0) for x in xs), zero)
    total = sum((F.coalesce(x, zero) for x in xs), zero)
    mean = F.try_divide(total, n)

    def spread() -> Column:
        squares = sum((F.coalesce((x - mean) * (x - mean), zero) for x in xs), zero)
        return F.when(n > 1, F.sqrt(squares / (n - 1)))

    def middle() -> Column:
        ordered = F.sort_array(F.filter(F.array(*xs), lambda v: v.isNotNull()))
        size = F.size(ordered)
        lo = F.get(ordered, F.floor((size - 1) / 2).cast("int"))
        hi = F.get(ordered, F.floor(size / 2).cast("int"))
        return F.when(size > 0, (lo + hi) / 2)

    made = {
        "mean": lambda: mean,
        "sum": lambda: total,
        "min": lambda: F.least(*xs),
        "max": lambda: F.greatest(*xs),
        "std": spread,
        "median": middle,
        "count": lambda: n,
    }
    return df.withColumn(name or f"{agg}_of_{len(columns)}_cols", finite(made[agg]()))


def normalize_fractions(df: DataFrame, columns: Sequence[str], suffix: str = "_frac") -> DataFrame:
    if len(columns) < 2:
        raise ValueError("normalize_fractions needs at least 2 columns.")
    total = sum((F.coalesce(numeric(df, c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return df.withColumns({f"{c}{suffix}": finite(F.try_divide(numeric(df, c), total)) for c in columns})


def compute_feature(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add or replace a column from one SQL scalar expression (window functions allowed)."""
    check_expression(df, expression)
    return df.withColumn(name, F.expr(expression))
