"""Frequent itemsets and association rules."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import quoted, require
from ..functions.stages import settle


def item_rows(df: DataFrame, transaction: str, item: str) -> DataFrame:
    """Distinct ``(txn, item)`` with the item as text."""
    require(df, transaction, item)
    return (
        df.select(F.col(quoted(transaction)).alias("txn"), F.col(quoted(item)).cast("string").alias("item"))
        .dropna()
        .distinct()
    )


def count_transactions(rows: DataFrame) -> int:
    return rows.select("txn").distinct().count()


def itemsets(rows: DataFrame, n_transactions: int, min_support: float = 0.01) -> DataFrame:
    """``(items, freq, support)`` of every itemset in at least ``min_support`` of the baskets.

    Items too rare on their own are dropped before baskets are built: they can be in no
    frequent set, and what remains of a basket is at most the list of frequent items.
    """
    least = max(1, math.ceil(min_support * n_transactions - 1e-9))
    single = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    kept = rows.join(single.select("item"), "item", "left_semi")
    baskets = settle(kept.groupBy("txn").agg(F.array_sort(F.collect_set("item")).alias("items")).select("items"))
    n_kept = baskets.count()
    share = (least - 0.5) / max(1, n_kept)  # FPGrowth counts against the baskets it sees
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, share)).fit(baskets)
    sets = model.freqItemsets.where(F.col("freq") >= least)
    support = F.col("freq") / F.lit(float(n_transactions))
    # The model mines again on every read, and rules read the sets three times.
    return settle(sets.select(F.array_sort("items").alias("items"), "freq", support.alias("support")))


def rules(sets: DataFrame, min_confidence: float = 0.2) -> DataFrame:
    """Every split of a frequent itemset into antecedents and consequents above the confidence."""
    splits = (
        sets.where(F.size("items") > 1)
        .withColumn("mask", F.explode(F.expr("sequence(1L, shiftleft(1L, size(items)) - 2L)")))
        .select(
            "items",
            "support",
            F.expr("filter(items, (x, i) -> getbit(mask, i) = 1)").alias("antecedents"),
            F.expr("filter(items, (x, i) -> getbit(mask, i) = 0)").alias("consequents"),
        )
    )
    left = sets.select(F.col("items").alias("antecedents"), F.col("support").alias("antecedent_support"))
    right = sets.select(F.col("items").alias("consequents"), F.col("support").alias("consequent_support"))
    confidence = F.col("support") / F.col("antecedent_support")
    return (
        splits.join(left, "antecedents")
        .where(confidence >= min_confidence)
        .join(right, "consequents")
        .select(
            "antecedents",
            "consequents",
            "support",
            confidence.alias("confidence"),
            (confidence / F.col("consequent_support")).alias("lift"),
        )
    )


def top_rules(found: DataFrame, max_rules: int = 50) -> DataFrame:
    """Best rules by lift; equal lifts go by support, then by the items."""
    return found.orderBy(F.desc("lift"), F.desc("support"), "antecedents", "consequents").limit(max_rules)
