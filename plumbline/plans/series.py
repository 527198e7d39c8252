"""Daily and monthly series built from whole tables, one per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series
from .common import Query, rounded, table


def _daily_orders(spark, sf_dir):
    daily = series.bucketed(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "day")
    return series.ordered(daily, "o_orderdate", "o_totalprice")


def _monthly_by_priority(spark, sf_dir):
    monthly = series.bucketed(
        table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "month", series="o_orderpriority")
    return series.ordered(monthly, "o_orderdate", "o_totalprice", "o_orderpriority")


def series_period(spark, sf_dir):
    monthly = series.bucketed(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "year", series="o_custkey")
    return series.series_period(series.ordered(monthly, "o_orderdate", "o_totalprice", "o_custkey"))


_PARTS = ("v", "trend", "seasonal", "resid")


def decompose_daily(spark, sf_dir):
    out = series.decompose(_daily_orders(spark, sf_dir))
    return rounded(out.select("pos", "period", *_PARTS), 5, *_PARTS)


def decompose_by_priority(spark, sf_dir):
    out = series.decompose(_monthly_by_priority(spark, sf_dir))
    return rounded(out.select("series", "pos", "period", *_PARTS), 5, *_PARTS)


def forecast_by_key(spark, sf_dir):
    return series.forecast(_monthly_by_priority(spark, sf_dir), 10)


def forecast_status(spark, sf_dir):
    monthly = series.bucketed(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "month", series="o_custkey")
    return series.forecast_status(series.ordered(monthly, "o_orderdate", "o_totalprice", "o_custkey"))


def changepoints_by_key(spark, sf_dir):
    hourly = series.bucketed(table(spark, sf_dir, "events"), "ts", "value", "hour", "mean", series="event_type")
    return rounded(series.changepoints(series.ordered(hourly, "ts", "value", "event_type")), 6, "mean")


def changepoints_planted(spark, sf_dir):
    """A series with levels 0, 12 and 5 and a known wobble, searched in blocks of 400 points."""
    key = F.col("o_orderkey")
    level = F.when(key < 600, 0.0).when(key < 1000, 12.0).otherwise(5.0)
    rows = table(spark, sf_dir, "orders").select(
        F.timestamp_seconds(key).alias("t"), (level + (key * 7919 % 101) / 25.0).alias("v"))
    found = series.changepoints(series.ordered(rows, "t", "v"), block=400)
    return rounded(found.select("segment", "n", "mean"), 6, "mean")


_COMPARED = ("mean_before", "mean_after", "delta", "pct_change", "cohens_d", "d")


def _compare(spark, sf_dir, source, time, value):
    df = table(spark, sf_dir, source)
    out = series.compare_windows(df, time, value, series.median_time(df, time, value))
    return rounded(rounded(out, 6, *_COMPARED), 1, "u", "tie_term")


def compare_periods(spark, sf_dir):
    return _compare(spark, sf_dir, "orders", "o_orderdate", "o_totalprice")


def compare_periods_ties(spark, sf_dir):
    return _compare(spark, sf_dir, "lineitem", "l_shipdate", "l_quantity")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        series_period, decompose_daily, decompose_by_priority, forecast_by_key, forecast_status, changepoints_by_key,
        changepoints_planted, compare_periods, compare_periods_ties,
    )
}


def _decompose_sql(points: str, period: int) -> str:
    """Additive decomposition of ``points(series, t, v)`` at a known even period."""
    h = period // 2
    return f"""
        WITH p AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series) AS n FROM ({points}) s
                   WINDOW w AS (PARTITION BY series ORDER BY t)),
             ma AS (SELECT *, CASE WHEN pos >= {h} AND pos < n - {h} THEN
                        (sum(v) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)
                         - 0.5 * (lag(v, {h}) OVER (PARTITION BY series ORDER BY pos)
                                  + lead(v, {h}) OVER (PARTITION BY series ORDER BY pos))) / {period} END AS tr FROM p),
             f AS (SELECT series, regr_slope(tr, pos) FILTER (WHERE pos >= {h} AND pos < least({h + period}, n - 1 - {h})) AS hs,
                          regr_intercept(tr, pos) FILTER (WHERE pos >= {h} AND pos < least({h + period}, n - 1 - {h})) AS hi,
                          regr_slope(tr, pos) FILTER (WHERE pos >= greatest({h}, n - 1 - {h} - {period}) AND pos < n - 1 - {h}) AS ts,
                          regr_intercept(tr, pos) FILTER (WHERE pos >= greatest({h}, n - 1 - {h} - {period}) AND pos < n - 1 - {h})
                            AS ti FROM ma GROUP BY series),
             t AS (SELECT ma.*, CASE WHEN pos < {h} THEN hs * pos + hi WHEN pos > n - 1 - {h} THEN ts * pos + ti ELSE tr END
                   AS trend FROM ma JOIN f USING (series)),
             m AS (SELECT series, pos % {period} AS ph, avg(v - trend) AS m FROM t GROUP BY 1, 2),
             c AS (SELECT series, ph, m - avg(m) OVER (PARTITION BY series) AS seasonal FROM m)
        SELECT t.series, pos, CAST({period} AS INTEGER) AS period, round(v, 5) + 0.0 AS v, round(trend, 5) + 0.0 AS trend,
               round(seasonal, 5) + 0.0 AS seasonal, round(v - trend - seasonal, 5) + 0.0 AS resid
        FROM t JOIN c ON t.series = c.series AND t.pos % {period} = c.ph"""


def _compare_sql(source: str, time: str, value: str) -> str:
    return f"""
        WITH c AS (SELECT quantile_cont(epoch_us({time})::DOUBLE, 0.5) AS cut FROM {source}),
             s AS (SELECT {value} AS v, epoch_us({time})::DOUBLE < cut AS b,
                          rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0 AS r,
                          count(*) OVER (PARTITION BY {value}) AS ties,
                          count(*) FILTER (WHERE epoch_us({time})::DOUBLE < cut) OVER (ORDER BY {value}) AS cb,
                          count(*) FILTER (WHERE epoch_us({time})::DOUBLE >= cut) OVER (ORDER BY {value}) AS ca FROM {source}, c),
             a AS (SELECT count(*) FILTER (WHERE b) AS n_before, count(*) FILTER (WHERE NOT b) AS n_after,
                          avg(v) FILTER (WHERE b) AS mb, avg(v) FILTER (WHERE NOT b) AS ma,
                          var_samp(v) FILTER (WHERE b) AS vb, var_samp(v) FILTER (WHERE NOT b) AS va,
                          sum(r) FILTER (WHERE b) AS rs, sum(ties::DOUBLE * ties - 1) AS tie_term FROM s),
             k AS (SELECT max(abs(cb / n_before - ca / n_after)) AS d FROM s, a)
        SELECT n_before, n_after, round(mb, 6) + 0.0 AS mean_before, round(ma, 6) + 0.0 AS mean_after,
               round(ma - mb, 6) + 0.0 AS delta, round((ma - mb) / mb * 100, 6) + 0.0 AS pct_change,
               round((ma - mb) / sqrt((va + vb) / 2), 6) + 0.0 AS cohens_d,
               round(rs - n_before * (n_before + 1) / 2.0, 1) + 0.0 AS u, round(tie_term, 1) + 0.0 AS tie_term,
               round(d, 6) + 0.0 AS d FROM a, k"""


_PERIOD_RULE = "CASE WHEN n >= 24 THEN 12 WHEN n >= 14 THEN 7 WHEN n >= 8 THEN 4 ELSE greatest(2, n // 2) END"

ORACLE: dict[str, str] = {
    "changepoints_planted": """
        SELECT CAST(level AS INTEGER) AS segment, count(*) AS n, round(avg(v), 6) + 0.0 AS mean
        FROM (SELECT (o_orderkey >= 600)::INTEGER + (o_orderkey >= 1000)::INTEGER AS level,
                     CASE WHEN o_orderkey < 600 THEN 0.0::DOUBLE WHEN o_orderkey < 1000 THEN 12 ELSE 5 END
                     + (o_orderkey * 7919 % 101) / 25.0::DOUBLE AS v FROM orders) p GROUP BY level""",
    "series_period": f"""
        SELECT series, n, CAST({_PERIOD_RULE} AS INTEGER) AS period FROM
        (SELECT o_custkey AS series, count(DISTINCT year(o_orderdate)) AS n FROM orders GROUP BY 1) s""",
    "decompose_daily": "SELECT * EXCLUDE (series) FROM (" + _decompose_sql(
        "SELECT 0 AS series, date_trunc('day', o_orderdate) AS t, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2", 12) + ") q",
    "decompose_by_priority": _decompose_sql(
        "SELECT o_orderpriority AS series, date_trunc('month', o_orderdate) AS t, sum(o_totalprice) AS v FROM orders "
        "GROUP BY 1, 2", 12),
    "forecast_status": f"""
        SELECT series, n, CAST({_PERIOD_RULE} AS INTEGER) AS period, n < 12 OR n < 2 * ({_PERIOD_RULE}) AS declined FROM
        (SELECT o_custkey AS series, count(DISTINCT date_trunc('month', o_orderdate)) AS n FROM orders GROUP BY 1) s""",
    "compare_periods": _compare_sql("orders", "o_orderdate", "o_totalprice"),
    "compare_periods_ties": _compare_sql("lineitem", "l_shipdate", "l_quantity"),
}
