"""Read-only SQL: what Spark's own parser makes of a text decides whether it may run."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

_ON_FILES = "spark.sql.runSQLOnFiles"

# Plan nodes of a pure query. Anything else (DDL, DML, SET, scripts) is refused.
_FORBIDDEN_NODES = ("Command", "Statement", "Transform", "Insert", "Create", "Drop", "Alter", "Set",
                    "Replace", "Truncate", "Merge", "Update", "Delete", "Cache", "Load", "Analyze", "Write")
_QUERY_NODES_WITH_SUCH_NAMES = ("SetOperation", "WithWindowDefinition")
_FORBIDDEN_FUNCTIONS = frozenset({"reflect", "try_reflect", "java_method", "read_files"})

# Words a feature expression may not contain, as the feature contract lists them.
EXPRESSION_BLOCKLIST = frozenset((
    "select", "insert", "update", "delete", "drop", "alter", "create", "attach", "detach", "copy", "install",
    "load", "pragma", "call", "export", "import", "set", "reset", "read_csv", "read_csv_auto", "read_parquet",
    "read_json", "read_json_auto", "read_text", "read_blob", "glob", "system", "getvariable",
)) | _FORBIDDEN_FUNCTIONS


def _nodes(plan):
    yield plan
    for children in (plan.children(), plan.innerChildren()):
        it = children.iterator()
        while it.hasNext():
            child = it.next()
            if "logical" in child.getClass().getName() or hasattr(child, "innerChildren"):
                yield from _nodes(child)


def check_query(spark: SparkSession, query: str, tables: Iterable[str] | None = None) -> None:
    """Raise unless ``query`` is one SELECT/VALUES query, over no relations but ``tables`` where these are given."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    nodes = list(_nodes(plan))
    for node in nodes:
        name = node.getClass().getSimpleName()
        if name in _QUERY_NODES_WITH_SUCH_NAMES:
            continue
        if any(part in name for part in _FORBIDDEN_NODES):
            raise ValueError(f"Only read-only queries may run here; {name} is not one.")
    words = {w.lower() for w in re.findall(r"[A-Za-z_]\w*", _without_strings(query))}
    bad = words & _FORBIDDEN_FUNCTIONS
    if bad:
        raise ValueError(f"Functions {sorted(bad)} may not be used.")
    if tables is not None:
        unknown = _relations(nodes) - {t.lower() for t in tables}
        if unknown:
            raise ValueError(f"Unknown tables {sorted(unknown)}; known: {sorted(tables)}.")


def _relations(nodes: list) -> set[str]:
    """Names that the parsed query reads from, without those it defines by WITH."""
    read, defined = set(), set()
    for node in nodes:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            read.add(node.multipartIdentifier().mkString(".").lower())
        elif kind == "UnresolvedWith":
            for i in range(node.cteRelations().size()):
                defined.add(node.cteRelations().apply(i)._1().lower())
    return read - defined


def _without_strings(text: str) -> str:
    return re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", text)


def run_query(spark: SparkSession, query: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The analysed query over ``tables`` alone; a path can not stand in for one.

    Names are resolved in a copy of the session, so the caller's views and settings are neither seen nor touched.
    """
    check_query(spark, query, tables)
    own = spark._jsparkSession.cloneSession()
    own.conf().set(_ON_FILES, "false")
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset
    for name, df in tables.items():
        rows.ofRows(own, df._jdf.queryExecution().logical()).createOrReplaceTempView(name)
    analysed = own.sql(query).queryExecution().analyzed()
    return DataFrame(rows.ofRows(spark._jsparkSession, analysed), spark)


def _expressions(node) -> Iterator:
    yield node
    below = node.children().iterator()
    while below.hasNext():
        yield from _expressions(below.next())


#: Parts of an expression that give more or less than one value per row.
_NOT_A_ROW_VALUE = ("Subquery", "Exists", "Star", "Generator", "Aggregate")


def check_expression(df: DataFrame, expression: str) -> None:
    """Raise unless ``expression`` is one scalar expression that binds to the table's columns.

    The parsed tree decides: which functions are called, which names are read, and whether a part of it is a query.
    """
    try:
        tree = df.sparkSession._jsparkSession.sessionState().sqlParser().parseExpression(expression or "")
        bound = df.selectExpr(f"({expression}) as feature")._jdf.queryExecution().analyzed()
    except Exception as exc:
        raise ValueError(f"This is not one expression over the table's columns: {exc}") from exc
    kinds, names = set(), set()
    for node in _expressions(tree):
        kind = node.getClass().getSimpleName()
        kinds.add(kind)
        if kind in ("UnresolvedAttribute", "UnresolvedFunction"):
            parts = node.nameParts()
            names |= {parts.apply(i).lower() for i in range(parts.size())}
    if names & EXPRESSION_BLOCKLIST:
        raise ValueError(f"A feature can not be built with {sorted(names & EXPRESSION_BLOCKLIST)}.")
    whole = {n.getClass().getSimpleName() for n in _nodes(bound)}
    if any(part in kind for kind in kinds | whole for part in (*_NOT_A_ROW_VALUE, "Generate")):
        raise ValueError("A feature expression must give one value per row.")
