"""What a user can ask in SQL: each query runs through the read-only guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.guard import run_query
from ..sources.readers import empty_table, insert_rows
from .common import Query, table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _sql(name: str, views: str, spark_sql: str, duck_sql: str | None = None) -> None:
    def run(spark, sf_dir):
        return run_query(spark, spark_sql, {v: table(spark, sf_dir, v) for v in views.split()})

    QUERIES[name] = run
    ORACLE[name] = duck_sql or spark_sql


_sql("sql_projection", "customer", """
    SELECT c_custkey, trim(c_name) AS name, CAST(c_acctbal AS BIGINT) AS balance, upper(c_mktsegment) AS segment
    FROM customer""", """
    SELECT c_custkey, trim(c_name) AS name, CAST(trunc(c_acctbal) AS BIGINT) AS balance,
           upper(c_mktsegment) AS segment FROM customer""")
_sql("sql_exclude", "orders", "SELECT * EXCEPT (o_orderdate, o_orderstatus) FROM orders",
     "SELECT * EXCLUDE (o_orderdate, o_orderstatus) FROM orders")
_sql("sql_filter", "lineitem", """
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    WHERE l_shipdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
      AND l_tax IS NOT NULL""", """
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_discount BETWEEN 0.05::DOUBLE AND 0.07::DOUBLE
      AND l_quantity < 24 AND l_tax IS NOT NULL""")
_sql("sql_join_inner", "customer orders", """
    SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
_sql("sql_join_left", "customer orders", """
    SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders
    ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey""")
_sql("sql_join_full", "supplier lineitem", """
    SELECT s_suppkey, k FROM (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) s
    FULL JOIN (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 45) l ON s_suppkey = k""")
_sql("sql_join_right", "nation supplier", """
    SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000""")
_sql("sql_join_semi", "orders lineitem", """
    SELECT o_orderkey, o_totalprice FROM orders LEFT SEMI JOIN
    (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') r ON o_orderkey = l_orderkey""", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN
    (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
_sql("sql_join_anti", "customer orders", """
    SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN
    (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') f ON c_custkey = o_custkey""", """
    SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS
    (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
_sql("sql_join_range", "nation customer", """
    SELECT n_nationkey, b.lo, count(*) AS n FROM customer
    JOIN nation ON c_nationkey = n_nationkey
    JOIN (SELECT * FROM VALUES (-1000.0D, 0.0D), (0.0D, 5000.0D), (5000.0D, 10000.0D) AS t(lo, hi)) b
    ON c_acctbal >= b.lo AND c_acctbal < b.hi GROUP BY n_nationkey, b.lo""", """
    SELECT n_nationkey, b.lo, count(*) AS n FROM customer
    JOIN nation ON c_nationkey = n_nationkey
    JOIN (SELECT * FROM (VALUES (-1000.0::DOUBLE, 0.0::DOUBLE), (0.0, 5000.0), (5000.0, 10000.0)) AS t(lo, hi)) b
    ON c_acctbal >= b.lo AND c_acctbal < b.hi GROUP BY n_nationkey, b.lo""")
_sql("sql_join_cross", "region nation", """
    SELECT r_regionkey, r_name, n_nations FROM region CROSS JOIN (SELECT count(*) AS n_nations FROM nation) one_row""")
_sql("sql_join_asof", "events orders", """
    SELECT event_id, last(order_day, true) OVER (PARTITION BY user_id ORDER BY moment, is_event
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS previous, is_event
    FROM (SELECT event_id, user_id, ts AS moment, 1 AS is_event, CAST(NULL AS STRING) AS order_day FROM events
          UNION ALL
          SELECT NULL, user_id, ts, 0, date_format(ts, 'yyyy-MM-dd') FROM events WHERE event_type = 'purchase') u
    """, """
    SELECT event_id, last_value(order_day IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY moment, is_event
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS previous, is_event
    FROM (SELECT event_id, user_id, ts AS moment, 1 AS is_event, CAST(NULL AS VARCHAR) AS order_day FROM events
          UNION ALL
          SELECT NULL, user_id, ts, 0, strftime(ts, '%Y-%m-%d') FROM events WHERE event_type = 'purchase') u
    """)
_sql("sql_aggregate", "lineitem", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty,
           round(avg(l_extendedprice), 4) AS price, count(DISTINCT l_suppkey) AS suppliers,
           count(*) FILTER (WHERE l_discount > 0.05) AS discounted
    FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty,
           round(avg(l_extendedprice), 4) AS price, count(DISTINCT l_suppkey) AS suppliers,
           count(*) FILTER (WHERE l_discount > 0.05::DOUBLE) AS discounted
    FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""")
_sql("sql_grouping_sets", "lineitem", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem
    GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
_sql("sql_cube", "orders", """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
_sql("sql_rollup", "orders", """
    SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders
    GROUP BY ROLLUP (year(o_orderdate), o_orderstatus)""", """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus, count(*) AS n FROM orders
    GROUP BY ROLLUP (year(o_orderdate), o_orderstatus)""")
_sql("sql_window", "orders", """
    SELECT o_orderkey, row_number() OVER w AS nth, rank() OVER v AS spend_rank,
           round(sum(o_totalprice) OVER w, 2) AS running, lag(o_orderkey) OVER w AS before
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
                       v AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)""", """
    SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS nth, CAST(rank() OVER v AS INTEGER) AS spend_rank,
           round(sum(o_totalprice) OVER w, 2) AS running, lag(o_orderkey) OVER w AS before
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
                       v AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)""")
_sql("sql_top_k", "orders", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
_sql("sql_distinct", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
_sql("sql_union", "customer supplier", """
    SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION
    SELECT s_nationkey, 'supplier' FROM supplier""")
_sql("sql_intersect", "lineitem part", """
    SELECT p_partkey AS k FROM part WHERE p_size > 20 INTERSECT SELECT l_partkey FROM lineitem WHERE l_tax > 0.05D""",
     """
    SELECT p_partkey AS k FROM part WHERE p_size > 20 INTERSECT
    SELECT l_partkey FROM lineitem WHERE l_tax > 0.05::DOUBLE""")
_sql("sql_except", "lineitem part", """
    SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1""")
_sql("sql_values", "orders", """
    SELECT v.label, count(*) AS n FROM orders JOIN (VALUES ('1-URGENT', 'now'), ('2-HIGH', 'soon')) AS v(p, label)
    ON o_orderpriority = v.p GROUP BY v.label""")
_sql("sql_unnest", "lineitem", """
    SELECT i, count(*) AS n FROM (SELECT explode(sequence(1, l_linenumber)) AS i FROM lineitem) s GROUP BY i""", """
    SELECT CAST(i AS INTEGER) AS i, count(*) AS n
    FROM (SELECT unnest(range(1, l_linenumber + 1)) AS i FROM lineitem) s GROUP BY i""")
_sql("sql_scalar_functions", "part", """
    SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size_class, nullif(p_size, 1) AS size_or_null,
           regexp_extract(p_brand, '([0-9]+)', 1) AS brand_no, coalesce(nullif(p_brand, 'Brand#11'), 'house') AS brand
    FROM part""")
_sql("sql_cte_subquery", "orders", """
    WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
    SELECT o_custkey, round(total, 2) AS total FROM spend WHERE total > (SELECT avg(total) FROM spend)""")
_sql("count_rows", "lineitem", "SELECT count(*) AS n_rows FROM lineitem")
_sql("count_non_null", "events", """
    SELECT count(value) AS n_non_null, count(*) AS n_rows, count(*) - count(value) AS n_null FROM events""")
_sql("create_table_select", "lineitem", """
    SELECT l_orderkey AS order_id, CAST(sum(l_quantity) AS BIGINT) AS units FROM lineitem GROUP BY l_orderkey""")


def insert_into_typed(spark, sf_dir):
    """A typed empty table filled by position from a SELECT, then from VALUES."""
    target = empty_table(spark, [("id", "bigint"), ("label", "varchar(40)"), ("balance", "double")])
    customer = {"customer": table(spark, sf_dir, "customer")}
    filled = insert_rows(target, run_query(spark, "SELECT c_custkey, trim(c_name), c_acctbal FROM customer", customer))
    return insert_rows(filled, run_query(spark, "VALUES (-1, 'extra', 1.5), (-2, 'other', 2.5)", {}))


def write_back_flag(spark, sf_dir):
    """A derived column by row, added without moving any row."""
    df = table(spark, sf_dir, "customer")
    return df.withColumn("in_debt", F.col("c_acctbal") < 0).select("c_custkey", "in_debt")


QUERIES["insert_into_typed"] = insert_into_typed
ORACLE["insert_into_typed"] = """
    SELECT c_custkey AS id, trim(c_name) AS label, c_acctbal AS balance FROM customer
    UNION ALL SELECT -1, 'extra', 1.5 UNION ALL SELECT -2, 'other', 2.5"""
QUERIES["write_back_flag"] = write_back_flag
ORACLE["write_back_flag"] = "SELECT c_custkey, c_acctbal < 0 AS in_debt FROM customer"
