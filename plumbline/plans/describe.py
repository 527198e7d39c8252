"""Profiles, typing and outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.stages import at_once
from ..operators import describe, typing
from .common import TABLES, Query, rounded, table

_NUMERIC = {
    "lineitem": ("l_quantity", "l_extendedprice", "l_partkey", "l_suppkey"),
    "orders": ("o_totalprice", "o_custkey"),
    "events": ("value", "user_id"),
}
_OTHERS = {
    "lineitem": ("l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus"),
    "orders": ("o_orderstatus", "o_orderpriority"),
    "events": ("event_type", "props"),
}
# Raw columns of each test table: (name, is text, is real, is number, is temporal).
COLUMNS = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:f c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:f",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:f",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:f o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:f l_extendedprice:f "
                "l_discount:f l_tax:f l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:f props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "embeddings": "vec_id:i embedding:o label:i",
    "pages": "page_id:i url:s html:s",
    "benchmark": "item_id:i text:s",
    "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:s text:s",
}


def columns_of(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in COLUMNS[name].split()]


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def profile_numeric(spark, sf_dir):
    frames = at_once(*[
        lambda t=t, cols=cols: describe.profile_numeric(table(spark, sf_dir, t), cols).withColumn("table", F.lit(t))
        for t, cols in _NUMERIC.items()
    ])
    return rounded(_union(frames), 4, "min", "max", "mean", "std", "skew", "median")


def _profile_sql(t: str, c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return (
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(x) AS n, round(min(x), 4) + 0.0 AS min, "
        f"round(max(x), 4) + 0.0 AS max, round(avg(x), 4) + 0.0 AS mean, round(stddev_samp(x), 4) + 0.0 AS std, "
        f"round(avg((x - m) ** 3) / sqrt(avg((x - m) ** 2)) ** 3, 4) + 0.0 AS skew, "
        f"round(median(x), 4) + 0.0 AS median "
        f"FROM (SELECT {x} AS x, avg({x}) OVER () AS m FROM {t}) s"
    )


def profile_top_values(spark, sf_dir):
    frames = [
        describe.top_values(table(spark, sf_dir, t), cols)
        .select(F.lit(t).alias("table"), "column", F.col("rank").cast("long").alias("rank"), "value", "n")
        for t, cols in _OTHERS.items()
    ]
    return _union(frames)


def _top_sql(t: str, c: str) -> str:
    return (
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", row_number() OVER (ORDER BY n DESC, value) AS rank, "
        f"value, n FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL "
        f"GROUP BY 1) s QUALIFY rank <= 5"
    )


def profile_missing(spark, sf_dir):
    frames = []
    for t in ("customer", "orders", "lineitem", "events"):
        df = table(spark, sf_dir, t)
        frames.append(
            describe.missing_counts(df)
            .join(describe.unique_counts(df), "column")
            .select(F.lit(t).alias("table"), "column", "n_rows", "n_missing", "missing_rate", "n_unique")
        )
    return _union(frames)


def _missing_sql(t: str, c: str) -> str:
    return (
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing, "
        f"CAST((count(*) - count({c})) / count(*) AS DOUBLE) AS missing_rate, "
        f"count(DISTINCT {c}) AS n_unique FROM {t}"
    )


def outliers_value(spark, sf_dir):
    df = describe.flag_outliers(table(spark, sf_dir, "events"), "value")
    return df.select("event_id", "value_is_outlier", "value_outlier_method")


def outlier_counts(spark, sf_dir):
    df = describe.flag_outliers(table(spark, sf_dir, "events"), "value")
    return describe.outlier_counts(df, "value")


_OUTLIER_SQL = """
    SELECT event_id, iqr OR z AS value_is_outlier,
           CASE WHEN iqr AND z THEN 'both' WHEN iqr THEN 'iqr' WHEN z THEN 'zscore' END AS value_outlier_method
    FROM (SELECT event_id, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS iqr,
                 abs((value - m) / s) > 3 AS z
          FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
                               avg(value) AS m, stddev_samp(value) AS s FROM events) stats) flags"""


def column_types(spark, sf_dir):
    found = at_once(*[lambda t=t: typing.detect_types(table(spark, sf_dir, t)) for t in TABLES])
    rows = [(t, c, kind) for t, kinds in zip(TABLES, found) for c, kind in kinds.items()]
    return spark.createDataFrame(rows, "`table` string, column string, type string")


def _type_sql(t: str, c: str, kind: str) -> str:
    head = f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", "
    if kind == "t":
        return head + "'datetime' AS type"
    if kind == "o":
        return head + "'categorical' AS type"
    d = f"count(DISTINCT {c})"
    rule = {
        "i": f"CASE WHEN {d} > 15 THEN 'continuous' ELSE 'categorical' END",
        "f": f"CASE WHEN {d} > 15 OR {d} / count(*) > 0.5 THEN 'continuous' ELSE 'categorical' END",
        "s": f"CASE WHEN {d} / count(*) > 0.9 THEN 'identifier' ELSE 'categorical' END",
    }[kind]
    return head + f"{rule} AS type FROM {t}"


_WORKLIST = {"orders": ("o_orderstatus", "o_orderpriority"), "part": ("p_brand", "p_type", "p_name")}


def categorical_worklist(spark, sf_dir):
    return _union(
        [
            typing.categorical_worklist(table(spark, sf_dir, t), cols).select(
                F.lit(t).alias("table"), "column", "distinct", F.concat_ws("|", "sample").alias("sample")
            )
            for t, cols in _WORKLIST.items()
        ]
    )


def _worklist_sql(t: str, c: str) -> str:
    return (
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS \"distinct\", "
        f"array_to_string(list_sort(list(v))[1:10], '|') AS sample "
        f"FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL) s"
    )


QUERIES: dict[str, Query] = {
    "profile_numeric": profile_numeric,
    "profile_top_values": profile_top_values,
    "profile_missing": profile_missing,
    "outliers_value": outliers_value,
    "outlier_counts": outlier_counts,
    "column_types": column_types,
    "categorical_worklist": categorical_worklist,
}

ORACLE: dict[str, str] = {
    "profile_numeric": " UNION ALL ".join(_profile_sql(t, c) for t, cs in _NUMERIC.items() for c in cs),
    "profile_top_values": " UNION ALL ".join(_top_sql(t, c) for t, cs in _OTHERS.items() for c in cs),
    "profile_missing": " UNION ALL ".join(
        _missing_sql(t, c) for t in ("customer", "orders", "lineitem", "events") for c, _ in columns_of(t)
    ),
    "outliers_value": _OUTLIER_SQL,
    "outlier_counts": f"""
        SELECT count(value_outlier_method) AS n_outliers,
               count(*) FILTER (WHERE value_outlier_method IN ('iqr', 'both')) AS n_outliers_iqr,
               count(*) FILTER (WHERE value_outlier_method IN ('zscore', 'both')) AS n_outliers_zscore,
               count(*) FILTER (WHERE value_outlier_method = 'both') AS n_outliers_both
        FROM ({_OUTLIER_SQL}) o""",
    "column_types": " UNION ALL ".join(_type_sql(t, c, k) for t in TABLES for c, k in columns_of(t)),
    "categorical_worklist": " UNION ALL ".join(_worklist_sql(t, c) for t, cs in _WORKLIST.items() for c in cs),
}
