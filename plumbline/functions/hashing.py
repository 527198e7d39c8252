"""Deterministic sampling, splitting and fingerprints from content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clean import field_type, quoted

def hash_text(seed: int, *columns: Column) -> Column:
    """First 15 hex digits of ``md5('seed:col:col…')``: the same in any SQL engine, and ordered like the number."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.substring(F.md5(text), 1, 15)


def gaussian(seed: int, *columns: Column) -> Column:
    """Standard normal noise by the Box-Muller transform of two hashes."""
    bits = F.lit(2**52)
    u, v = (
        (F.pmod(F.xxhash64(F.lit(k), *columns), bits).cast("double") + 0.5) / float(2**52)
        for k in (2 * seed + 1, 2 * seed + 2)
    )
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * F.pi() * v)


def _cell(df: DataFrame, name: str) -> Column:
    """A value with its type and length, so that no two rows of values share a text; NULL differs from any value."""
    kind, column = field_type(df, name), F.col(quoted(name))
    if isinstance(kind, T.BinaryType):
        text = F.hex(column)
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(F.struct(column), {"ignoreNullFields": "false"})
    else:
        text = column.cast("string")
    there = F.concat(F.lit(f"{kind.simpleString()}:"), F.length(text).cast("string"), F.lit(":"), text)
    return F.when(column.isNull(), F.lit("-")).otherwise(there)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, checksum, parity)``; any changed or moved value changes it, row order does not."""
    row = F.md5(F.concat_ws(",", *[_cell(df, c) for c in df.columns]))
    return df.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("long").alias("h")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("checksum"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("parity"),
    )


def fingerprint_text(df: DataFrame) -> str:
    row = fingerprint(df).first()
    return f"{','.join(df.columns)}|{row['n_rows']}|{row['checksum']}|{row['parity']}"
