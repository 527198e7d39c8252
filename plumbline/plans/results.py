"""Trust levels, JSON envelopes and fingerprints for many results at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..results import level_column
from .common import Query, table


def trust_levels(spark, sf_dir):
    """How far a per-customer figure can be trusted, from the number of orders behind it."""
    sizes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("level", level_column(F.col("n"), 5, 10))


def json_rows(spark, sf_dir):
    """Strict JSON per group; what is missing is null."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("value") < 0, F.col("value"))).alias("lowest")
    )
    body = F.to_json(F.struct("event_type", "n", "lowest"), {"ignoreNullFields": "false"})
    return rows.select(body.alias("body"))


def fingerprint(spark, sf_dir):
    return hashing.fingerprint(table(spark, sf_dir, "orders"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (trust_levels, json_rows, fingerprint)}

# A cell's text in the fingerprint: type, length, value; the types are those of the table's schema.
_CELLS = ", ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE '{kind}:' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    for c, kind in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
                    ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"))
)

ORACLE: dict[str, str] = {
    "fingerprint": f"""
        SELECT count(*) AS n_rows, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS checksum, bit_xor(h) AS parity
        FROM (SELECT CAST('0x' || substr(md5(concat_ws(',', {_CELLS})), 1, 15) AS BIGINT) AS h FROM orders)""",
    "trust_levels": """
        SELECT o_custkey, count(*) AS n, CASE WHEN count(*) < 5 THEN 'low' WHEN count(*) < 10 THEN 'moderate' ELSE 'high' END
               AS level FROM orders GROUP BY o_custkey""",
    "json_rows": """
        SELECT CAST(json_object('event_type', event_type, 'n', count(*), 'lowest', max(CASE WHEN value < 0 THEN value END))
                    AS VARCHAR) AS body FROM events GROUP BY event_type""",
}
