"""Keys, foreign keys and joins over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relate
from .common import Query, table
from .describe import columns_of

_STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _tables(spark, sf_dir, names=_STAR):
    return {n: table(spark, sf_dir, n) for n in names}


def column_stats(spark, sf_dir):
    return relate.column_stats(_tables(spark, sf_dir)).select(
        "table", "column", "n_rows", "n_non_null", "n_distinct", "is_key"
    )


def fk_edges(spark, sf_dir):
    return relate.edges_frame(spark, relate.find_edges(_tables(spark, sf_dir)))


def fk_edge_counts(spark, sf_dir):
    """Shared distinct values of every candidate pair: the evidence behind the edges."""
    tables = _tables(spark, sf_dir)
    pairs = relate.distinct_pairs(tables)
    stats = relate.stats_from(pairs, tables).collect()
    counts = relate.coverage_counts(pairs, stats)
    child, parent = F.split("child", "\u0001"), F.split("parent", "\u0001")
    return counts.where("child <> parent").select(
        child[0].alias("child_table"), child[1].alias("child_column"),
        parent[0].alias("parent_table"), parent[1].alias("parent_column"), "shared",
    )


_NATURAL = {"nation": "n_regionkey", "customer": "c_nationkey", "orders": "o_custkey"}


def _natural_graph(tables):
    """The true keys only, so that the joined rows can be stated in SQL."""
    edge = relate.Edge
    return relate.Graph(
        {},
        [
            edge("orders", "o_custkey", "customer", "c_custkey", 1.0, False),
            edge("customer", "c_nationkey", "nation", "n_nationkey", 1.0, False),
            edge("nation", "n_regionkey", "region", "r_regionkey", 1.0, False),
        ],
    )


def join_fk(spark, sf_dir):
    tables = _tables(spark, sf_dir, ("orders", "customer", "nation", "region"))
    joined = relate.join_tables(tables, list(tables), _natural_graph(tables))
    return joined.select(
        "o_orderkey", "o_custkey", "o_totalprice", "c_name", "c_mktsegment", "n_name", "r_name"
    )


def join_detected(spark, sf_dir):
    """Join by the first detected edge: order lines to their part by whatever key is found first."""
    tables = _tables(spark, sf_dir, ("nation", "region"))
    joined = relate.join_tables(tables, ["nation", "region"], relate.find_edges(tables), "inner")
    return joined


def join_same_names(spark, sf_dir):
    """A table with the same column names twice: the second set is prefixed."""
    tables = _tables(spark, sf_dir, ("documents", "labels"))
    graph = relate.Graph({}, [relate.Edge("labels", "doc_id", "documents", "doc_id", 1.0, True)])
    joined = relate.join_tables(tables, ["labels", "documents"], graph)
    return joined.select("doc_id", "documents_doc_id", "quality", "toxic", "lang", "n_chars")


def join_fan_out(spark, sf_dir):
    tables = _tables(spark, sf_dir, ("orders", "lineitem"))
    graph = relate.Graph({}, [relate.Edge("lineitem", "l_orderkey", "orders", "o_orderkey", 1.0, False)])
    joined = relate.join_tables(tables, ["orders", "lineitem"], graph, "inner")
    out = relate.fan_out(tables["orders"], joined)
    return out.withColumn("ratio", F.round("ratio", 8))


QUERIES: dict[str, Query] = {
    "column_stats": column_stats,
    "fk_edges": fk_edges,
    "fk_edge_counts": fk_edge_counts,
    "join_fk": join_fk,
    "join_detected": join_detected,
    "join_same_names": join_same_names,
    "join_fan_out": join_fan_out,
}

_KEYED = [(t, c, k) for t in _STAR for c, k in columns_of(t) if k in "is"]
_STATS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n_non_null, "
    f"count(DISTINCT {c}) AS n_distinct, count(*) > 0 AND count(DISTINCT {c}) = count(*) AS is_key FROM {t}"
    for t, c, _ in _KEYED
)
_VALUES_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{k}' AS kind, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL"
    for t, c, k in _KEYED
)
_SHARED_SQL = f"""
    WITH stats AS ({_STATS_SQL}), vals AS ({_VALUES_SQL}),
         keys AS (SELECT v.* FROM vals v JOIN stats s ON v.t = s."table" AND v.c = s."column" WHERE s.is_key),
         kids AS (SELECT v.* FROM vals v JOIN stats s ON v.t = s."table" AND v.c = s."column"
                  WHERE s.n_distinct >= 2),
         shared AS (SELECT k.t AS child_table, k.c AS child_column, p.t AS parent_table, p.c AS parent_column,
                           count(*) AS shared
                    FROM kids k JOIN keys p ON k.kind = p.kind AND k.v = p.v
                    WHERE NOT (k.t = p.t AND k.c = p.c) GROUP BY ALL)"""

ORACLE: dict[str, str] = {
    "column_stats": _STATS_SQL,
    "fk_edge_counts": f"{_SHARED_SQL} SELECT * FROM shared",
    "fk_edges": f"""{_SHARED_SQL}
        SELECT h.child_table, h.child_column, h.parent_table, h.parent_column,
               round(h.shared / s.n_distinct, 4) AS coverage, lower(h.child_column) = lower(h.parent_column) AS name_match
        FROM shared h JOIN stats s ON h.child_table = s."table" AND h.child_column = s."column"
        WHERE h.shared / s.n_distinct >= 0.95 AND NOT s.is_key""",
    "join_fk": """
        SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment, n_name, r_name
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey""",
    "join_detected": "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_same_names": """
        SELECT l.doc_id, d.doc_id AS documents_doc_id, quality, toxic, lang, n_chars
        FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id""",
    "join_fan_out": """
        SELECT (SELECT count(*) FROM orders) AS rows_before, count(*) AS rows_after,
               round(count(*) / (SELECT count(*) FROM orders), 8) AS ratio
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
}
