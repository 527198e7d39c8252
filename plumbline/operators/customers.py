"""Customer value segments and monthly retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import micros, moment, numeric, quoted, require
from ..functions.ordering import ordinal_positions
from ..functions.stages import settle

SCORES = 5
DAY = 86_400_000_000
MIN_CUSTOMERS = 5


def customer_totals(df: DataFrame, customer: str, date: str, money: str) -> DataFrame:
    """``(customer, recency, frequency, monetary)`` over complete rows.

    Recency is in whole days before the day after the last activity of the table.
    """
    require(df, customer, date, money)
    rows = df.select(
        F.col(quoted(customer)).alias("customer"), micros(df, date).alias("t"), numeric(df, money).alias("m")
    ).dropna()
    totals = rows.groupBy("customer").agg(
        F.max("t").alias("last"), F.count(F.lit(1)).alias("frequency"), F.sum("m").alias("monetary")
    )
    snapshot = totals.agg((F.max("last") + DAY).alias("s")).scalar()
    return totals.select(
        "customer", F.floor((snapshot - F.col("last")) / DAY).alias("recency"), "frequency", "monetary"
    )


def quintile(position: Column, n: Column) -> Column:
    """Score 1-5 of a 1-based position among n: the smallest k with position ≤ 1 + k(n - 1)/5."""
    steps = SCORES * (position - 1)
    ceiling = F.floor((steps + n - 2) / (n - 1))
    return F.when(n <= 1, 1).otherwise(F.greatest(F.lit(1), ceiling)).cast("int")


def segment(r: Column, fm: Column) -> Column:
    # Segment names and the score limits that define them, first match wins.
    return (
        F.when((r >= 4) & (fm >= 4), "Champions")
        .when((r >= 3) & (fm >= 3), "Loyal")
        .when((r >= 4) & (fm >= 1), "Potential Loyalist")
        .when((r <= 2) & (fm >= 3), "At Risk")
        .when((r <= 2) & (fm <= 2), "Hibernating")
        .otherwise("Others")
    )


def rfm(df: DataFrame, customer: str, date: str, money: str) -> DataFrame:
    """One row per customer: recency, frequency, monetary, scores ``r f m fm`` and the segment."""
    totals = settle(customer_totals(df, customer, date, money))
    measures = ("recency", "frequency", "monetary")
    placed = ordinal_positions(totals, measures, "customer")
    score = quintile(F.col("position"), F.col("n_positions"))
    scores = placed.groupBy("key").agg(
        *[F.max(F.when(F.col("column") == m, score)).alias(m[0]) for m in measures]
    )
    scored = totals.join(scores, totals["customer"] == scores["key"]).drop("key")
    scored = scored.withColumn("r", SCORES + 1 - F.col("r"))
    fm = F.bround((F.col("f") + F.col("m")) / 2, 0).cast("int")
    return scored.withColumn("fm", fm).withColumn("segment", segment(F.col("r"), F.col("fm")))


def rfm_segments(scored: DataFrame) -> DataFrame:
    """``(segment, customers, value)``."""
    return scored.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.sum("monetary"), 2).alias("value")
    )


def retention(df: DataFrame, customer: str, date: str) -> DataFrame:
    """``(cohort, months_since, customers, rate)``; cohort is the month of first activity.

    Activity is reduced to distinct (customer, month) pairs before anything is grouped
    by customer, so a very busy customer is a handful of rows.
    """
    require(df, customer, date)
    t = moment(df, date)
    active = (
        df.select(F.col(quoted(customer)).alias("customer"), (F.year(t) * 12 + F.month(t) - 1).alias("month"))
        .dropna()
        .distinct()
    )
    first = F.min("month").over(Window.partitionBy("customer"))
    cells = (
        active.withColumn("start", first)
        .groupBy("start", (F.col("month") - F.col("start")).alias("months_since"))
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    size = F.max(F.when(F.col("months_since") == 0, F.col("customers"))).over(Window.partitionBy("start"))
    label = F.format_string("%04d-%02d", F.floor(F.col("start") / 12), F.col("start") % 12 + 1)
    return cells.select(
        label.alias("cohort"), "months_since", "customers", F.round(F.col("customers") / size, 4).alias("rate")
    )
