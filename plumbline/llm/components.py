"""Connected components of a link table, as joins and grouped minima.

Rounds of the large-star and small-star steps: every vertex hands the smallest vertex it knows to its larger, then
to its smaller neighbours, until each component is a star around its smallest vertex. The minimum of a vertex is a
partial aggregate, so a hub moves one row per task; the join back to the links has both sides shuffled by the join,
so Spark can split a hub's partition. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stages import settle


def _smallest(links: DataFrame) -> DataFrame:
    """``u``, ``m``: each vertex with the smallest of itself and its neighbours."""
    return settle(links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(down)
    handed = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(least.select("u", F.col("m").alias("v")))


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                    F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["x"], row["s"]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``vertex``, ``root`` for every vertex that has a link to another one; root is the smallest of its component.

    Vertices are longs; links to itself, repeated links and links with a null end add nothing.
    """
    links = settle(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    )
    before = _state(links)
    if not before[0]:
        return links.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    while True:
        links = settle(_small_star(settle(_large_star(links).distinct())).where(F.col("u") != F.col("v")).distinct())
        now = _state(links)
        if now == before:
            break
        before = now
    stars = links.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("vertex"), "root").distinct())
