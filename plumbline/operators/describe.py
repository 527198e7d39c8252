"""Profiles and outlier flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import numeric, present, quoted
from ..functions.selection import exact_quantiles, settle_quantiles, sketch
from ..functions.stages import at_once
from .typing import distinct_counts, distinct_values

TOP_VALUES = 5
IQR_FENCE = 1.5
Z_LIMIT = 3.0


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_rows, n_missing, missing_rate)`` from one wide aggregate."""
    columns = list(columns or df.columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(present(df, c)).alias(f"n{i}") for i, c in enumerate(columns)],
    )
    pairs = ", ".join(f"'{c}', n_rows, n_rows - n{i}" for i, c in enumerate(columns))
    tidy = wide.selectExpr(f"stack({len(columns)}, {pairs}) as (column, n_rows, n_missing)")
    rate = F.when(F.col("n_rows") > 0, F.col("n_missing") / F.col("n_rows")).otherwise(0.0)
    return tidy.withColumn("missing_rate", rate)


def _moments(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    aggs = []
    for i, c in enumerate(columns):
        x = numeric(df, c)
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.min(x).alias(f"lo{i}"),
            F.max(x).alias(f"hi{i}"),
            F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"sd{i}"),
            F.skewness(x).alias(f"sk{i}"),
        ]
    return aggs


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, median)``, exact, every column in the same two passes."""
    clean = df.select(*[numeric(df, c).alias(c) for c in columns])
    found = exact_quantiles(clean, columns, [0.5])
    return df.sparkSession.createDataFrame([(c, q[0]) for c, q in found.items()], "column string, median double")


def profile_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n, min, max, mean, std, skew, median)``: moments and sketches first, then the middles of all columns exactly."""
    columns = list(columns)
    clean = df.select(*[numeric(df, c).alias(c) for c in columns])
    row, near = at_once(  # sketches would take the moments out of generated code
        df.agg(*_moments(df, columns)).first,
        clean.agg(*[sketch(F.col(quoted(c)), [0.5]).alias(c) for c in columns]).first,
    )
    middle = settle_quantiles(clean, {c: row[f"n{i}"] for i, c in enumerate(columns)}, {c: near[c] for c in columns}, [0.5])
    out = []
    for i, c in enumerate(columns):
        n, skew = row[f"n{i}"], row[f"sk{i}"]
        skew = None if not n else 0.0 if n <= 2 or skew is None else skew
        out.append((c, n, *(row[f"{k}{i}"] for k in ("lo", "hi", "mean", "sd")), skew, middle.get(c, [None])[0]))
    return df.sparkSession.createDataFrame(
        out, "column string, n long, min double, max double, mean double, std double, skew double, median double")


def profile_values(df: DataFrame, columns: Sequence[str], top_for: Sequence[str]) -> DataFrame:
    """``(column, n_unique, top)``: distinct counts, and for some columns the top values with counts."""
    counts = unique_counts(df, columns)
    tops = (
        top_values(df, top_for)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))
        if top_for
        else None
    )
    return counts.join(tops, "column", "left") if tops is not None else counts.withColumn("top", F.lit(None))


def top_values(df: DataFrame, columns: Sequence[str], top: int = TOP_VALUES) -> DataFrame:
    """``(column, rank, value, n)``: most frequent values; equal counts go by value."""
    found = distinct_values(df, columns)
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "column", "rank", "value", "n"
    )


def unique_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    return distinct_counts(df, columns).withColumnRenamed("n_distinct", "n_unique")


def outlier_limits(df: DataFrame, column: str) -> dict[str, float | None]:
    """Fences and z-score scale: six numbers, all that reaches the driver."""
    clean = df.select(numeric(df, column).alias("x"))
    quarts = exact_quantiles(clean, ["x"], [0.25, 0.75]).get("x")
    row = clean.agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.count("x").alias("n")).first()
    q1, q3 = quarts or (None, None)
    spread = None if q1 is None else IQR_FENCE * (q3 - q1)
    return {
        "low": None if q1 is None else q1 - spread,
        "high": None if q1 is None else q3 + spread,
        "mean": row["mean"],
        "std": row["std"],
        "n": row["n"],
    }


def flag_outliers(df: DataFrame, column: str, limits: dict[str, float | None] | None = None) -> DataFrame:
    """Add ``<column>_is_outlier`` and ``<column>_outlier_method`` (iqr, zscore, both or null)."""
    limits = limits or outlier_limits(df, column)
    x = numeric(df, column)
    by_iqr = by_z = F.lit(False)
    if limits["low"] is not None:
        by_iqr = F.coalesce((x < limits["low"]) | (x > limits["high"]), F.lit(False))
    if limits["std"]:
        by_z = F.coalesce(F.abs((x - limits["mean"]) / limits["std"]) > Z_LIMIT, F.lit(False))
    method = F.when(by_iqr & by_z, "both").when(by_iqr, "iqr").when(by_z, "zscore")
    return df.withColumns(
        {f"{column}_is_outlier": by_iqr | by_z, f"{column}_outlier_method": method}
    )


def outlier_counts(flagged: DataFrame, column: str) -> DataFrame:
    method = F.col(quoted(f"{column}_outlier_method"))
    return flagged.agg(
        F.count_if(method.isNotNull()).alias("n_outliers"),
        F.count_if(method.isin("iqr", "both")).alias("n_outliers_iqr"),
        F.count_if(method.isin("zscore", "both")).alias("n_outliers_zscore"),
        F.count_if(method == "both").alias("n_outliers_both"),
    )
