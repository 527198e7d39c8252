"""Statistics of the association tests over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import associate as assoc
from .common import Query, rounded, table


def _rank_sql(column: str, source: str, keep: str) -> str:
    """Average ranks (ties share their mean rank)."""
    return (
        f"SELECT {keep}, rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0 AS r, "
        f"count(*) OVER (PARTITION BY {column}) AS ties FROM {source}"
    )


def assoc_pearson(spark, sf_dir):
    pairs = assoc.number_pairs(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(assoc.pearson(pairs), 8, "r").select("n", "r", "normal_x", "normal_y")


def _k2_sql(n: str, skew: str, kurt: str) -> str:
    """K² spelled out step by step over one row."""
    return f"""
        SELECT *, z1 * z1 + z2 * z2 AS k2 FROM (
        SELECT *, ln(y / alpha + sqrt((y / alpha) ** 2 + 1)) / sqrt(0.5 * ln(w2)) AS z1,
               ((1 - 2 / (9 * a)) - sign(1 + x * sqrt(2 / (a - 4)))
                * ((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4)))) ** (1.0 / 3)) / sqrt(2 / (9 * a)) AS z2
        FROM (SELECT *, sqrt(2 / (w2 - 1)) AS alpha, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS a
        FROM (SELECT *, sqrt(2 * (beta2 - 1)) - 1 AS w2 FROM (
        SELECT *, {skew} * sqrt(({n} + 1) * ({n} + 3) / (6 * ({n} - 2))) AS y,
               3 * ({n} * {n} + 27 * {n} - 70) * ({n} + 1) * ({n} + 3)
                 / (({n} - 2) * ({n} + 5) * ({n} + 7) * ({n} + 9)) AS beta2,
               ({kurt} - 3 * ({n} - 1) / ({n} + 1))
                 / sqrt(24 * {n} * ({n} - 2) * ({n} - 3) / (({n} + 1) ** 2 * ({n} + 3) * ({n} + 5))) AS x,
               6 * ({n} * {n} - 5 * {n} + 2) / (({n} + 7) * ({n} + 9))
                 * sqrt(6 * ({n} + 3) * ({n} + 5) / ({n} * ({n} - 2) * ({n} - 3))) AS b1
        FROM mom) q1) q2) q3) q4"""


def assoc_normality(spark, sf_dir):
    """K² of order totals per priority."""
    groups = assoc.group_moments(assoc.group_pairs(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"))
    k2 = assoc.k_squared(F.col("n"), F.col("skew"), F.col("kurt"))
    return rounded(groups.select("g", "n", k2.alias("k2")), 4, "k2")


def assoc_spearman(spark, sf_dir):
    pairs = assoc.number_pairs(table(spark, sf_dir, "events"), "user_id", "value")
    return rounded(assoc.spearman(pairs), 8, "rho")


def assoc_spearman_ties(spark, sf_dir):
    pairs = assoc.number_pairs(table(spark, sf_dir, "lineitem"), "l_discount", "l_quantity")
    return rounded(assoc.spearman(pairs), 8, "rho")


def assoc_welch(spark, sf_dir):
    groups = assoc.group_moments(assoc.group_pairs(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_extendedprice"))
    return rounded(assoc.welch(groups), 5, "t", "df")


def assoc_anova(spark, sf_dir):
    groups = assoc.group_moments(assoc.group_pairs(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"))
    return rounded(assoc.anova(groups), 8, "f", "eta_squared", "omega_squared")


def assoc_levene(spark, sf_dir):
    return rounded(
        assoc.levene(assoc.group_pairs(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")), 6, "w"
    )


def assoc_mwu(spark, sf_dir):
    ranked = assoc.rank_groups(assoc.group_pairs(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_discount"))
    return rounded(assoc.mann_whitney(ranked), 1, "u", "tie_term")


def assoc_kruskal(spark, sf_dir):
    ranked = assoc.rank_groups(assoc.group_pairs(table(spark, sf_dir, "events"), "event_type", "value"))
    return rounded(assoc.kruskal(ranked), 7, "h", "epsilon_squared").drop("tie_term")


def assoc_kruskal_ties(spark, sf_dir):
    ranked = assoc.rank_groups(assoc.group_pairs(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity"))
    return rounded(assoc.kruskal(ranked), 7, "h", "epsilon_squared").drop("tie_term")


def assoc_chi2(spark, sf_dir):
    out = assoc.contingency(assoc.category_pairs(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"))
    return rounded(out.select("n", "r", "c", "chi2", "cramers_v", "min_expected"), 6, "chi2", "cramers_v", "min_expected")


def assoc_chi2_yates(spark, sf_dir):
    out = assoc.contingency(assoc.category_pairs(table(spark, sf_dir, "labels"), "quality", "toxic"))
    cells = ["n11", "n12", "n21", "n22"]
    return rounded(out.select("n", "statistic", "cramers_v", *cells), 8, "statistic", "cramers_v")


def assoc_fisher(spark, sf_dir):
    """The 2×2 cells and sample odds ratio of document labels (the p-value is a driver scalar)."""
    out = assoc.contingency(assoc.category_pairs(table(spark, sf_dir, "labels"), "quality", "toxic"))
    four = [F.col(f"n{i}").cast("double") for i in (11, 12, 21, 22)]
    return rounded(out.select("n", F.try_divide(four[0] * four[3], four[1] * four[2]).alias("odds_ratio")), 8, "odds_ratio")


#: Column → divisor and remainder of the order keys that lack it.
_GAPS = {"o_custkey": (20, 3), "o_totalprice": (19, 1), "o_orderstatus": (23, 5), "o_orderpriority": (21, 8)}


def assoc_matrix(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"
    )
    rows = assoc.association_matrix(df, ["o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"])
    schema = "col_a string, col_b string, effect_size double"
    tidy = spark.createDataFrame([(r["col_a"], r["col_b"], r["effect_size"]) for r in rows], schema)
    return rounded(tidy, 8, "effect_size")


def assoc_matrix_gaps(spark, sf_dir):
    """The same columns with about one value in twenty missing, from other rows in each column."""
    key = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select(
        *[F.when(key % m != r, F.col(c)).alias(c) for c, (m, r) in _GAPS.items()])
    rows = assoc.association_matrix(df, ["o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"])
    schema = "col_a string, col_b string, effect_size double"
    tidy = spark.createDataFrame([(r["col_a"], r["col_b"], r["effect_size"]) for r in rows], schema)
    return rounded(tidy, 8, "effect_size")


def assoc_routes(spark, sf_dir):
    """The test chosen for one pair of each kind."""
    cases = [
        ("lineitem", "l_quantity", "l_extendedprice", ["l_quantity", "l_extendedprice"]),
        ("lineitem", "l_linestatus", "l_discount", ["l_discount"]),
        ("orders", "o_orderpriority", "o_totalprice", ["o_totalprice"]),
        ("lineitem", "l_returnflag", "l_linestatus", []),
    ]
    rows = []
    for t, a, b, continuous in cases:
        test = assoc.test_pair(table(spark, sf_dir, t), a, b, continuous)
        rows.append((t, a, b, test.method, test.n, test.values["p_value"], test.effect))
    return spark.createDataFrame(
        rows, '"table" string, a string, b string, method string, n long, p_value double, effect_size double'.replace('"', "`")
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        assoc_pearson, assoc_normality, assoc_spearman, assoc_spearman_ties, assoc_welch, assoc_anova, assoc_levene,
        assoc_mwu, assoc_kruskal, assoc_kruskal_ties, assoc_chi2, assoc_chi2_yates, assoc_fisher, assoc_matrix, assoc_matrix_gaps,
        assoc_routes,
    )
}


def _moments_sql(source: str, columns: dict[str, str]) -> str:
    parts = ["count(*) AS n"]
    for name, c in columns.items():
        parts.append(f"avg((d_{name}) ** 3) / sqrt(avg(d_{name} ** 2)) ** 3 AS s_{name}")
        parts.append(f"avg((d_{name}) ** 4) / avg(d_{name} ** 2) ** 2 AS k_{name}")
    inner = ", ".join(f"{c} - avg({c}) OVER () AS d_{n}" for n, c in columns.items())
    return f"SELECT {', '.join(parts)} FROM (SELECT {inner} FROM {source}) d"


def _kruskal_sql(g: str, v: str, source: str) -> str:
    return f"""
        WITH r AS ({_rank_sql(v, source, f'{g} AS g')}),
             t AS (SELECT count(*) AS n, sum(ties::DOUBLE * ties - 1) AS tie FROM r),
             s AS (SELECT g, count(*) AS m, sum(r) AS rs FROM r GROUP BY g),
             h AS (SELECT count(*) AS k, any_value(n) AS n,
                          (12.0 / (any_value(n) * (any_value(n) + 1.0)) * sum(rs * rs / m) - 3 * (any_value(n) + 1))
                          / (1 - any_value(tie) / (any_value(n)::DOUBLE ** 3 - any_value(n))) AS h FROM s, t)
        SELECT k, n, round(h, 7) + 0.0 AS h, round(greatest(0, least(1, h / (n - 1))), 7) + 0.0 AS epsilon_squared FROM h"""


def _chi2_sql(a: str, b: str, source: str) -> str:
    return f"""
        WITH cells AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {source} GROUP BY 1, 2),
             ra AS (SELECT a, sum(o) AS ta FROM cells GROUP BY a), rb AS (SELECT b, sum(o) AS tb FROM cells GROUP BY b),
             grid AS (SELECT a, b, coalesce(o, 0) AS o, ta, tb, (SELECT sum(o) FROM cells) AS n,
                             ta * tb::DOUBLE / (SELECT sum(o) FROM cells) AS e
                      FROM ra CROSS JOIN rb LEFT JOIN cells USING (a, b))"""


_FISHER_CELLS = """
    WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS n11,
                      count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS n12,
                      count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS n21,
                      count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS n22 FROM labels)"""

_PEARSON_MOM = _moments_sql("lineitem", {"x": "l_quantity", "y": "l_extendedprice"})


def _matrix_sql(source) -> str:
    """Effect sizes of the four order columns, each pair over its own rows: rho, epsilon squared, Cramér's V."""
    x, y, status, priority = _GAPS
    rho = f"""
        SELECT '{x}' AS col_a, '{y}' AS col_b, round(abs(corr(x.r, y.r)), 8) + 0.0 AS effect_size
        FROM ({_rank_sql(x, source(x, y), 'o_orderkey')}) x JOIN ({_rank_sql(y, source(x, y), 'o_orderkey')}) y USING (o_orderkey)"""
    epsilon = [
        f"SELECT '{v}', '{g}', e FROM (SELECT round(epsilon_squared, 8) + 0.0 AS e FROM ("
        + _kruskal_sql(g, v, source(v, g)).replace(", 7)", ", 12)") + ") q) w"
        for v in (x, y) for g in (status, priority)
    ]
    cramer = (f"SELECT '{status}', '{priority}', e FROM (" + _chi2_sql(status, priority, source(status, priority))
              + " SELECT round(sqrt(sum((o - e) ** 2 / e) / (any_value(n) * 2)), 8) + 0.0 AS e FROM grid) w")
    return " UNION ALL ".join([rho, *epsilon, cramer])



ORACLE: dict[str, str] = {
    "assoc_pearson": f"""
        WITH mom AS ({_PEARSON_MOM}),
             kx AS ({_k2_sql('n::DOUBLE', 's_x', 'k_x')}), ky AS ({_k2_sql('n::DOUBLE', 's_y', 'k_y')})
        SELECT (SELECT count(*) FROM lineitem) AS n,
               (SELECT round(corr(l_quantity, l_extendedprice), 8) + 0.0 FROM lineitem) AS r,
               (SELECT exp(-k2 / 2) > 0.05 FROM kx) AS normal_x, (SELECT exp(-k2 / 2) > 0.05 FROM ky) AS normal_y""",
    "assoc_normality": f"""
        WITH mom AS (SELECT g, count(*) AS n, avg(d ** 3) / sqrt(avg(d ** 2)) ** 3 AS s, avg(d ** 4) / avg(d ** 2) ** 2 AS k
                     FROM (SELECT o_orderpriority AS g, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority)
                           AS d FROM orders) d GROUP BY g)
        SELECT g, n, round(k2, 4) + 0.0 AS k2 FROM ({_k2_sql('n::DOUBLE', 's', 'k')}) f""",
    "assoc_spearman": f"""
        SELECT count(*) AS n, round(corr(x.r, y.r), 8) + 0.0 AS rho
        FROM ({_rank_sql('user_id', 'events', 'event_id')}) x JOIN ({_rank_sql('value', 'events', 'event_id')}) y
        USING (event_id)""",
    "assoc_spearman_ties": """
        SELECT count(*) AS n, round(corr(rx, ry), 8) + 0.0 AS rho FROM (
        SELECT rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS rx,
               rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ry
        FROM lineitem) r""",
    "assoc_welch": """
        WITH s AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v
                   FROM lineitem GROUP BY 1),
             p AS (SELECT a.n AS na, a.m AS ma, a.v / a.n AS va, b.n AS nb, b.m AS mb, b.v / b.n AS vb
                   FROM s a JOIN s b ON a.g < b.g)
        SELECT round((ma - mb) / sqrt(va + vb), 5) + 0.0 AS t,
               round((va + vb) ** 2 / (va ** 2 / (na - 1) + vb ** 2 / (nb - 1)), 5) + 0.0 AS df FROM p""",
    "assoc_anova": """
        WITH g AS (SELECT o_orderpriority AS g, count(*) AS m, avg(o_totalprice) AS mean, var_samp(o_totalprice) AS var
                   FROM orders GROUP BY 1),
             s AS (SELECT count(*) AS k, sum(m)::BIGINT AS n,
                          sum(m * (mean - (SELECT avg(o_totalprice) FROM orders)) ** 2) AS ssb, sum((m - 1) * var) AS ssw
                   FROM g)
        SELECT k, n, round((ssb / (k - 1)) / (ssw / (n - k)), 8) + 0.0 AS f, round(ssb / (ssb + ssw), 8) + 0.0 AS eta_squared,
               round(greatest(0, (ssb - (k - 1) * ssw / (n - k)) / (ssb + ssw + ssw / (n - k))), 8) + 0.0 AS omega_squared
        FROM s""",
    "assoc_levene": """
        WITH z AS (SELECT o_orderpriority AS g, abs(o_totalprice - median(o_totalprice) OVER (PARTITION BY o_orderpriority))
                   AS z FROM orders),
             s AS (SELECT g, count(*) AS m, avg(z) AS mean, var_samp(z) AS var FROM z GROUP BY g)
        SELECT count(*) AS k, sum(m)::BIGINT AS n,
               round((sum(m * (mean - (SELECT avg(z) FROM z)) ** 2) / (count(*) - 1))
                     / (sum((m - 1) * var) / (sum(m) - count(*))), 6) + 0.0 AS w FROM s""",
    "assoc_mwu": f"""
        WITH r AS ({_rank_sql('l_discount', 'lineitem', 'l_linestatus AS g')})
        SELECT round(sum(r) FILTER (WHERE g = (SELECT min(g) FROM r))
                     - any_value(n1) * (any_value(n1) + 1) / 2.0, 1) + 0.0 AS u, any_value(n1) AS n1,
               count(*) - any_value(n1) AS n2, round(sum(ties::DOUBLE * ties - 1), 1) + 0.0 AS tie_term
        FROM r, (SELECT count(*) AS n1 FROM lineitem WHERE l_linestatus = (SELECT min(l_linestatus) FROM lineitem)) c""",
    "assoc_kruskal": _kruskal_sql("event_type", "value", "events"),
    "assoc_kruskal_ties": _kruskal_sql("l_returnflag", "l_quantity", "lineitem"),
    "assoc_chi2": f"""{_chi2_sql('l_returnflag', 'l_linestatus', 'lineitem')}
        SELECT any_value(n)::BIGINT AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS c,
               round(sum((o - e) ** 2 / e), 6) + 0.0 AS chi2,
               round(sqrt(sum((o - e) ** 2 / e) / (any_value(n) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 6)
                 + 0.0 AS cramers_v,
               round(min(e), 6) + 0.0 AS min_expected FROM grid""",
    "assoc_chi2_yates": f"""{_chi2_sql('quality', 'toxic', 'labels')}
        SELECT any_value(n)::BIGINT AS n, round(sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e), 8) + 0.0 AS statistic,
               round(sqrt(sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e) / any_value(n)), 8) + 0.0 AS cramers_v,
               sum(o) FILTER (WHERE a = 0 AND b = 0)::BIGINT AS n11, sum(o) FILTER (WHERE a = 0 AND b = 1)::BIGINT AS n12,
               sum(o) FILTER (WHERE a = 1 AND b = 0)::BIGINT AS n21, sum(o) FILTER (WHERE a = 1 AND b = 1)::BIGINT AS n22
        FROM grid""",
    "assoc_fisher": f"""{_FISHER_CELLS}
        SELECT n, round(n11 * n22 / nullif(n12 * n21, 0)::DOUBLE, 8) + 0.0 AS odds_ratio FROM c""",
    "assoc_matrix": _matrix_sql(lambda a, b: "orders"),
    "assoc_matrix_gaps": _matrix_sql(
        lambda a, b: "(SELECT * FROM orders WHERE " + " AND ".join(f"o_orderkey % {m} <> {r}" for m, r in (_GAPS[a], _GAPS[b])) + ") o"),
}
