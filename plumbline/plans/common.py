"""Shared helpers of the query catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import quoted
from ..sources.readers import read_table

Query = Callable[[SparkSession, str], DataFrame]

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round doubles (and turn -0.0 into 0.0) so that summation order does not show."""
    return df.withColumns({c: F.round(F.col(quoted(c)).cast("double"), digits) + F.lit(0.0) for c in columns})


def register_views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
