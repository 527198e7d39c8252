"""Segments, retention, baskets and adjusted effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import basket, causal, customers
from .common import Query, rounded, table


def rfm_scores(spark, sf_dir):
    scored = customers.rfm(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice")
    return rounded(scored, 2, "monetary")


def rfm_segments(spark, sf_dir):
    scored = customers.rfm(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice")
    return customers.rfm_segments(scored)


def retention_orders(spark, sf_dir):
    return customers.retention(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


def retention_events(spark, sf_dir):
    return customers.retention(table(spark, sf_dir, "events"), "user_id", "ts")


def _basket_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return basket.item_rows(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_type")


def _sets(spark, sf_dir, support):
    rows = _basket_rows(spark, sf_dir)
    return basket.itemsets(rows, basket.count_transactions(rows), support)


def basket_itemsets(spark, sf_dir):
    found = _sets(spark, sf_dir, 0.01).where(F.size("items") <= 2)
    return rounded(found.select(F.concat_ws("|", "items").alias("items"), "freq", "support"), 9, "support")


def basket_itemsets_all(spark, sf_dir):
    found = _sets(spark, sf_dir, 0.01)
    return found.select(F.concat_ws("|", "items").alias("items"), "freq")


def basket_rules(spark, sf_dir):
    found = basket.rules(_sets(spark, sf_dir, 0.01), 0.2)
    pairs = found.where((F.size("antecedents") == 1) & (F.size("consequents") == 1))
    flat = pairs.select(
        F.element_at("antecedents", 1).alias("antecedent"), F.element_at("consequents", 1).alias("consequent"),
        "support", "confidence", "lift",
    )
    return rounded(flat, 9, "support", "confidence", "lift")


def _flat(found):
    return found.withColumns({c: F.concat_ws("|", c) for c in ("antecedents", "consequents")})


def basket_rules_all(spark, sf_dir):
    """Rules with any number of items on either side."""
    found = _flat(basket.rules(_sets(spark, sf_dir, 0.01), 0.2))
    return rounded(found, 9, "support", "confidence", "lift")


def basket_top_rules(spark, sf_dir):
    """The report itself: at most fifty rules, best lift first, itemsets of any size."""
    found = basket.top_rules(basket.rules(_sets(spark, sf_dir, 0.005), 0.2))
    return rounded(_flat(found), 9, "support", "confidence", "lift")


def causal_linear(spark, sf_dir):
    found = causal.causal_effect(table(spark, sf_dir, "lineitem"), "l_discount", "l_extendedprice", ["l_quantity"])
    frame = spark.createDataFrame([(found.n, found.effect)], "n long, effect double")
    return rounded(frame, 4, "effect")


def causal_absorbed(spark, sf_dir):
    """A confounder with as many levels as there are parts."""
    found = causal.causal_effect(
        table(spark, sf_dir, "lineitem"), "l_discount", "l_extendedprice", ["l_quantity"], ["l_partkey"])
    frame = spark.createDataFrame([(found.n, found.effect)], "n long, effect double")
    return rounded(frame, 4, "effect")


def causal_adjusted(spark, sf_dir):
    """Numeric and categorical confounders, with the random-common-cause check."""
    found = causal.causal_effect(
        table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_discount", "l_tax"],
        ["l_returnflag", "l_linestatus"],
    )
    return spark.createDataFrame(
        [(found.n, found.effect, found.new_effect, found.passed)],
        "n long, effect double, new_effect double, passed boolean",
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        rfm_scores, rfm_segments, retention_orders, retention_events, basket_itemsets, basket_itemsets_all,
        basket_rules, basket_rules_all, basket_top_rules, causal_linear, causal_absorbed, causal_adjusted,
    )
}

_RFM_SQL = """
    WITH t AS (SELECT o_custkey AS customer, max(o_orderdate) AS last, count(*) AS frequency, sum(o_totalprice) AS monetary
               FROM orders GROUP BY 1),
         a AS (SELECT customer, CAST(floor(epoch((SELECT max(last) FROM t) + INTERVAL 1 DAY - last) / 86400) AS BIGINT)
                      AS recency, frequency, monetary FROM t),
         p AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY recency, customer) AS pr,
                      row_number() OVER (ORDER BY frequency, customer) AS pf,
                      row_number() OVER (ORDER BY monetary, customer) AS pm FROM a),
         s AS (SELECT *, 6 - greatest(1, (5 * (pr - 1) + n - 2) // (n - 1)) AS r,
                      greatest(1, (5 * (pf - 1) + n - 2) // (n - 1)) AS f,
                      greatest(1, (5 * (pm - 1) + n - 2) // (n - 1)) AS m FROM p),
         x AS (SELECT *, CASE WHEN (f + m) % 2 = 0 THEN (f + m) // 2
                              WHEN ((f + m) // 2) % 2 = 0 THEN (f + m) // 2 ELSE (f + m) // 2 + 1 END AS fm FROM s),
         rfm AS (SELECT customer, recency, frequency, monetary, r, f, m, fm,
                        CASE WHEN r >= 4 AND fm >= 4 THEN 'Champions' WHEN r >= 3 AND fm >= 3 THEN 'Loyal'
                             WHEN r >= 4 AND fm >= 1 THEN 'Potential Loyalist' WHEN r <= 2 AND fm >= 3 THEN 'At Risk'
                             WHEN r <= 2 AND fm <= 2 THEN 'Hibernating' ELSE 'Others' END AS segment FROM x)"""


def _retention_sql(source: str, customer: str, date: str) -> str:
    return f"""
        WITH a AS (SELECT DISTINCT {customer} AS c, date_trunc('month', {date}) AS mo FROM {source}),
             f AS (SELECT c, min(mo) AS start FROM a GROUP BY c),
             k AS (SELECT start, datediff('month', start, mo) AS months_since, count(DISTINCT c) AS customers
                   FROM a JOIN f USING (c) GROUP BY 1, 2)
        SELECT strftime(start, '%Y-%m') AS cohort, CAST(months_since AS INTEGER) AS months_since, customers,
               round(customers / max(customers) FILTER (WHERE months_since = 0) OVER (PARTITION BY start), 4) AS rate FROM k"""


def _baskets_sql(support: float) -> str:
    return f"""
        WITH b AS (SELECT DISTINCT l_orderkey AS t, p_type AS i FROM lineitem JOIN part ON l_partkey = p_partkey),
             n AS (SELECT count(DISTINCT t) AS n FROM b),
             one AS (SELECT i, count(*) AS freq FROM b GROUP BY i HAVING count(*) >= {support} * (SELECT n FROM n)),
             two AS (SELECT x.i AS i, y.i AS j, count(*) AS freq FROM b x JOIN b y ON x.t = y.t AND x.i < y.i
                     GROUP BY 1, 2 HAVING count(*) >= {support} * (SELECT n FROM n))"""


def _all_sets_sql(support: float) -> str:
    """Every itemset grown from the frequent items, and every split of it into a rule."""
    return f"""
        WITH RECURSIVE b AS (SELECT l_orderkey AS t, list_sort(list(DISTINCT p_type)) AS items
                             FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
             n AS (SELECT count(*) AS n FROM b),
             one AS (SELECT i FROM (SELECT unnest(items) AS i FROM b) u GROUP BY i
                     HAVING count(*) >= {support} * (SELECT n FROM n)),
             grown AS (SELECT [i] AS s FROM one UNION ALL
                       SELECT list_append(g.s, o.i) FROM grown g JOIN one o ON o.i > g.s[len(g.s)]),
             sets AS (SELECT s, count(*) AS freq FROM grown JOIN b ON list_has_all(b.items, s) GROUP BY s
                      HAVING count(*) >= {support} * (SELECT n FROM n)),
             rules AS (SELECT array_to_string(a.s, '|') AS antecedents, array_to_string(c.s, '|') AS consequents,
                              w.freq / n AS support, (w.freq / n) / (a.freq / n) AS confidence,
                              (w.freq / n) / (a.freq / n) / (c.freq / n) AS lift, a.s AS al, c.s AS cl
                       FROM sets w, sets a, sets c, n
                       WHERE len(a.s) + len(c.s) = len(w.s) AND list_has_all(w.s, a.s) AND list_has_all(w.s, c.s)
                         AND NOT list_has_any(a.s, c.s) AND (w.freq / n) / (a.freq / n) >= 0.2)"""


_RULE_COLUMNS = """antecedents, consequents, round(support, 9) + 0.0 AS support, round(confidence, 9) + 0.0 AS confidence,
               round(lift, 9) + 0.0 AS lift"""

ORACLE: dict[str, str] = {
    "basket_itemsets_all": _all_sets_sql(0.01) + " SELECT array_to_string(s, '|') AS items, freq FROM sets",
    "basket_rules_all": _all_sets_sql(0.01) + f" SELECT {_RULE_COLUMNS} FROM rules",
    "basket_top_rules": _all_sets_sql(0.005) + f"""
        SELECT {_RULE_COLUMNS} FROM (SELECT * FROM rules ORDER BY lift DESC, support DESC, al, cl LIMIT 50) r""",
    "rfm_scores": f"""{_RFM_SQL}
        SELECT customer, recency, frequency, round(monetary, 2) + 0.0 AS monetary, CAST(r AS INTEGER) AS r,
               CAST(f AS INTEGER) AS f, CAST(m AS INTEGER) AS m, CAST(fm AS INTEGER) AS fm, segment FROM rfm""",
    "rfm_segments": f"""{_RFM_SQL}
        SELECT segment, count(*) AS customers, round(sum(monetary), 2) AS value FROM rfm GROUP BY segment""",
    "retention_orders": _retention_sql("orders", "o_custkey", "o_orderdate"),
    "retention_events": _retention_sql("events", "user_id", "ts"),
    "basket_itemsets": f"""{_baskets_sql(0.01)}
        SELECT i AS items, freq, round(freq / n, 9) + 0.0 AS support FROM one, n
        UNION ALL SELECT i || '|' || j, freq, round(freq / n, 9) + 0.0 FROM two, n""",
    "basket_rules": f"""{_baskets_sql(0.01)},
        r AS (SELECT i AS a, j AS c, freq FROM two UNION ALL SELECT j, i, freq FROM two)
        SELECT a AS antecedent, c AS consequent, round(r.freq / n, 9) + 0.0 AS support,
               round(r.freq / x.freq, 9) + 0.0 AS confidence, round(r.freq / x.freq * n / y.freq, 9) + 0.0 AS lift
        FROM r, n, one x, one y WHERE x.i = r.a AND y.i = r.c AND r.freq / x.freq >= 0.2""",
    "causal_absorbed": """
        WITH d AS (SELECT l_discount - avg(l_discount) OVER w AS t, l_quantity - avg(l_quantity) OVER w AS q,
                          l_extendedprice - avg(l_extendedprice) OVER w AS y FROM lineitem WINDOW w AS (PARTITION BY l_partkey)),
             f AS (SELECT sum(t * q) / sum(q * q) AS b FROM d)
        SELECT count(*) AS n, round(sum((t - b * q) * y) / sum((t - b * q) * (t - b * q)), 4) + 0.0 AS effect FROM d, f""",
    "causal_linear": """
        WITH f AS (SELECT regr_slope(l_discount, l_quantity) AS bt, regr_slope(l_extendedprice, l_quantity) AS bo,
                          avg(l_quantity) AS mq, avg(l_discount) AS mt, avg(l_extendedprice) AS my FROM lineitem)
        SELECT count(*) AS n, round(regr_slope(l_extendedprice - my - bo * (l_quantity - mq),
                                               l_discount - mt - bt * (l_quantity - mq)), 4) + 0.0 AS effect
        FROM lineitem, f""",
}
