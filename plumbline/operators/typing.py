"""Semantic column types: continuous, categorical (nominal/ordinal), datetime, identifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import NUMERIC, TEMPORAL, field_type, micros, present

CONTINUOUS, CATEGORICAL = "continuous", "categorical"
NOMINAL, ORDINAL = "categorical_nominal", "categorical_ordinal"
DATETIME, IDENTIFIER = "datetime", "identifier"
SETTABLE = (NOMINAL, ORDINAL)

# Thresholds of the detection rule.
MAX_CATEGORICAL_DISTINCT = 15
CONTINUOUS_RATIO = 0.5
IDENTIFIER_RATIO = 0.9

# Sketches err by about 5 %: these estimates are beyond doubt on their side of a threshold.
_CLEARLY_MANY = 200
_CLEARLY_REPEATED = 0.6
_LONG_TEXT = 64


def values_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value)`` pairs with values as text."""
    clean = [present(df, c).cast("string").alias(f"_{i}") for i, c in enumerate(columns)]
    pairs = ", ".join(f"'{c}', _{i}" for i, c in enumerate(columns))
    return df.select(*clean).selectExpr(f"stack({len(columns)}, {pairs}) as (column, value)")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)``: every column's distinct non-null values, one shuffle for all of them."""
    found = values_long(df, columns).where("value is not null")
    return found.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n_distinct)``, exact, for all columns in one job.

    Whole numbers, real numbers and text have a column each, so that no number is turned into text; long text is
    counted by its digest. 0.0 and -0.0 are one value.
    """
    cells = []
    for i, c in enumerate(columns):
        kind, value = field_type(df, c), present(df, c)
        whole = real = text = F.lit(None)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            whole = value
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            real = value
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            whole = micros(df, c)
        else:
            text = value.cast("string")
            text = F.when(F.length(text) > _LONG_TEXT, F.concat(F.lit("md5:"), F.md5(text))).otherwise(text)
        cells += [whole.cast("long").alias(f"w{i}"), real.cast("double").alias(f"r{i}"), text.cast("string").alias(f"t{i}")]
    parts = ", ".join(f"{i}, w{i}, r{i}, t{i}" for i in range(len(columns)))
    tall = df.select(*cells).selectExpr(f"stack({len(columns)}, {parts}) as (at, whole, real, text)")
    known = tall.where("whole is not null or real is not null or text is not null")
    counts = known.groupBy("at", "whole", "real", "text").agg(F.lit(1).alias("one")).groupBy("at").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = F.array(*[F.lit(c) for c in columns])
    return counts.select(names[F.col("at")].alias("column"), "n_distinct")


def _decide(kind: T.DataType, n_rows: int, n_distinct: int) -> str:
    share = n_distinct / n_rows if n_rows else 0.0
    if isinstance(kind, NUMERIC):
        real = isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType))
        many = n_distinct > MAX_CATEGORICAL_DISTINCT or (real and share > CONTINUOUS_RATIO)
        return CONTINUOUS if many else CATEGORICAL
    return IDENTIFIER if share > IDENTIFIER_RATIO else CATEGORICAL


def detect_types(df: DataFrame) -> dict[str, str]:
    """Type of every column of a table.

    One pass of small sketches settles every column that is far from its threshold; only
    the rest, few-valued numbers and nearly unique text, are counted exactly.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    counted = [c for c, k in kinds.items() if isinstance(k, NUMERIC + (T.StringType,))]
    types = {c: DATETIME if isinstance(k, TEMPORAL) else CATEGORICAL for c, k in kinds.items()}
    if counted:
        row = df.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.approx_count_distinct(present(df, c)).alias(f"d{i}") for i, c in enumerate(counted)],
        ).first()
        unsure = []
        for i, c in enumerate(counted):
            guess = row[f"d{i}"]
            if isinstance(kinds[c], NUMERIC) and guess >= _CLEARLY_MANY:
                types[c] = CONTINUOUS
            elif isinstance(kinds[c], T.StringType) and guess <= _CLEARLY_REPEATED * row["n"]:
                types[c] = CATEGORICAL
            else:
                unsure.append(c)
        if unsure:
            exact = {r["column"]: r["n_distinct"] for r in distinct_counts(df, unsure).collect()}
            types |= {c: _decide(kinds[c], row["n"], exact.get(c, 0)) for c in unsure}
    return types


def categorical_worklist(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unrefined categorical columns: distinct count and the ten smallest values as text."""
    distinct = distinct_values(df, columns)
    counts = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    first = Window.partitionBy("column").orderBy("value")
    sample = (
        distinct.withColumn("rank", F.row_number().over(first))
        .where("rank <= 10")
        .groupBy("column")
        .agg(F.array_sort(F.collect_list("value")).alias("sample"))
    )
    return counts.join(sample, "column")
