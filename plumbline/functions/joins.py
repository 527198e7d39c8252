"""Joining a per-key table back to rows when some keys hold a large share of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import quoted
from .stages import settle

# A key above 1/HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
BROADCAST_ROWS = 100_000
_SPREAD = 4096


def lookup(
    df: DataFrame, key: str, table: DataFrame, table_key: str, weight: str, outs: dict[str, str],
    settled: bool = False, broadcast_rows: int = BROADCAST_ROWS, size: int | None = None,
) -> DataFrame:
    """Left-join ``table`` (one row per key) to ``df``, adding ``outs`` (table column → new name).

    The table is written first unless it was read from files already, and counted: up to
    ``broadcast_rows`` rows it is broadcast and the rows of ``df`` do not move. Beyond that
    only the hot keys by ``weight`` (the rows of ``df`` per key) are broadcast, fewer than a
    thousand by their definition; rows of hot or missing keys then pass the shuffle join
    under spread-out keys that match nothing, so no partition collects them. ``size`` is the
    number of rows of ``table`` where it is known.
    """
    if not settled:
        table = settle(table)
    k = F.col(quoted(key))
    payload = [F.col(quoted(c)).alias(f"_v{i}") for i, c in enumerate(outs)]
    kept = [c for c in df.columns if c not in outs.values()]

    def finish(joined: DataFrame, values: Column) -> DataFrame:
        return joined.select(
            *[F.col(quoted(c)) for c in kept],
            *[values.getField(f"_v{i}").alias(n) for i, n in enumerate(outs.values())],
        )

    if (table.limit(broadcast_rows + 1).count() if size is None else size) <= broadcast_rows:
        small = table.select(F.col(quoted(table_key)).alias("_small"), F.struct(*payload).alias("_values"))
        return finish(df.join(F.broadcast(small), k == F.col("_small"), "left"), F.col("_values"))

    total = table.agg(F.sum(weight).alias("t")).first()["t"]
    is_hot = F.col(weight) * HOT_SHARE > total
    hot = table.where(is_hot).select(F.col(quoted(table_key)).alias("_hot"), F.struct(*payload).alias("_hot_values"))
    # One struct key: compared as a whole, so the shuffle really hashes value and salt together.
    cold = table.where(~is_hot).select(
        F.struct(F.col(quoted(table_key)).alias("k"), F.lit(0).alias("s")).alias("_cold"),
        F.struct(*payload).alias("_cold_values"),
    )
    found = df.join(F.broadcast(hot), k == F.col("_hot"), "left")
    settled_rows = k.isNull() | F.col("_hot_values").isNotNull()
    salt = F.when(settled_rows, F.pmod(F.monotonically_increasing_id(), F.lit(_SPREAD)).cast("int") + 1).otherwise(0)
    spread = found.withColumn("_probe", F.struct(k.alias("k"), salt.alias("s")))
    joined = spread.join(cold, F.col("_probe") == F.col("_cold"), "left")
    return finish(joined, F.coalesce("_hot_values", "_cold_values"))
