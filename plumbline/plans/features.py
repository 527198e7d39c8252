"""Feature columns over whole tables, each with the SQL that states its meaning."""

from __future__ import annotations

from ..operators import features as fx
from .common import Query, rounded, table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_LINE_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
_KEYS_SQL = ", ".join(_LINE_KEYS)


def _feature(name: str, source: str, keys: tuple[str, ...], make, outputs: dict[str, str], digits: int = 6,
             relation: str | None = None, exact: tuple[str, ...] = ()) -> None:
    """Register ``make(df)`` over ``source``; ``outputs`` maps each new column to its SQL."""

    def run(spark, sf_dir):
        made = make(table(spark, sf_dir, source)).select(*keys, *outputs)
        return rounded(made, digits, *[c for c in outputs if c not in exact])

    QUERIES[name] = run
    columns = ", ".join(
        f"{sql} AS {c}" if c in exact else f"round(CAST({sql} AS DOUBLE), {digits}) + 0.0 AS {c}"
        for c, sql in outputs.items()
    )
    ORACLE[name] = f"SELECT {', '.join(keys)}, {columns} FROM {relation or source}"


_COMBINE = {
    "add": "l_extendedprice + l_tax",
    "subtract": "l_extendedprice - l_tax",
    "multiply": "l_extendedprice * l_tax",
    "divide": "l_extendedprice / nullif(l_tax, 0)",
    "ratio": "l_extendedprice / nullif(l_tax, 0)",
}
for _op, _sql in _COMBINE.items():
    _feature(
        f"feat_combine_{_op}", "lineitem", _LINE_KEYS,
        lambda df, op=_op: fx.combine_columns(df, "l_extendedprice", "l_tax", op),
        {f"l_extendedprice_{_op}_l_tax": _sql}, digits=5,
    )

_TRANSFORM = {
    "log": "CASE WHEN o_totalprice > 0 THEN ln(o_totalprice) END",
    "log1p": "CASE WHEN o_totalprice > -1 THEN ln(1 + o_totalprice) END",
    "sqrt": "CASE WHEN o_totalprice >= 0 THEN sqrt(o_totalprice) END",
    "reciprocal": "1.0 / nullif(o_totalprice, 0)",
    "abs": "abs(o_totalprice)",
    "zscore": "(o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()",
}
for _fn, _sql in _TRANSFORM.items():
    _feature(
        f"feat_transform_{_fn}", "orders", ("o_orderkey",),
        lambda df, fn=_fn: fx.transform_column(df, "o_totalprice", fn),
        {f"{_fn}_o_totalprice": _sql}, digits=7,
    )
_feature(
    "feat_transform_square", "events", ("event_id",), lambda df: fx.transform_column(df, "value", "square"),
    {"square_value": "value * value"}, digits=5,
)


def _quantile_bins(column: str, source: str, n: int) -> str:
    edges = ", ".join(f"quantile_cont({column}, {i / n})" for i in range(n + 1))
    return (
        f"(SELECT *, len([e FOR e IN edges[2:len(edges) - 1] IF e < {column}]) AS bin FROM {source}, "
        f"(SELECT list_sort(list_distinct([{edges}])) AS edges FROM {source})) s"
    )


_feature(
    "feat_bin_quantile", "orders", ("o_orderkey",), lambda df: fx.bin_column(df, "o_totalprice", 4, "quantile"),
    {"o_totalprice_bin": "CAST(bin AS BIGINT)"}, relation=_quantile_bins("o_totalprice", "orders", 4),
    exact=("o_totalprice_bin",),
)
_feature(
    "feat_bin_quantile_ties", "lineitem", _LINE_KEYS, lambda df: fx.bin_column(df, "l_discount", 7, "quantile"),
    {"l_discount_bin": "CAST(bin AS BIGINT)"}, relation=_quantile_bins("l_discount", "lineitem", 7),
    exact=("l_discount_bin",),
)
_feature(
    "feat_bin_uniform", "events", ("event_id",), lambda df: fx.bin_column(df, "value", 5, "uniform"),
    {"value_bin": "CAST(" + " + ".join(
        f"CASE WHEN value > lo + (hi - lo) * {i} / 5 THEN 1 ELSE 0 END" for i in range(1, 5)) + " AS BIGINT)"},
    relation="events, (SELECT min(value) AS lo, max(value) AS hi FROM events) r",
    exact=("value_bin",),
)

_PARTS = {
    "year": "year(ts)", "quarter": "quarter(ts)", "month": "month(ts)", "week": "weekofyear(ts)",
    "day": "day(ts)", "dayofweek": "isodow(ts) - 1", "dayofyear": "dayofyear(ts)", "hour": "hour(ts)",
    "is_weekend": "isodow(ts) >= 6", "is_month_start": "day(ts) = 1",
    "is_month_end": "CAST(ts AS DATE) = last_day(ts)",
}
_feature(
    "feat_datetime_parts", "events", ("event_id",), lambda df: fx.expand_datetime(df, "ts", list(_PARTS)),
    {f"ts_{p}": (s if p.startswith("is_") else f"CAST({s} AS INTEGER)") for p, s in _PARTS.items()},
    exact=tuple(f"ts_{p}" for p in _PARTS),
)
_feature(
    "feat_datetime_default", "orders", ("o_orderkey",), lambda df: fx.expand_datetime(df, "o_orderdate"),
    {f"o_orderdate_{p}": _PARTS[p].replace("ts", "o_orderdate") if p.startswith("is_")
     else f"CAST({_PARTS[p].replace('ts', 'o_orderdate')} AS INTEGER)" for p in fx.DEFAULT_DATE_PARTS},
    exact=tuple(f"o_orderdate_{p}" for p in fx.DEFAULT_DATE_PARTS),
)

_GROUP = {
    "mean": "avg(o_totalprice)", "sum": "sum(o_totalprice)", "min": "min(o_totalprice)",
    "max": "max(o_totalprice)", "std": "stddev_samp(o_totalprice)",
    "median": "quantile_cont(o_totalprice, 0.5)", "count": "count(o_totalprice)",
}
for _agg, _sql in _GROUP.items():
    _feature(
        f"feat_group_{_agg}", "orders", ("o_orderkey",),
        lambda df, agg=_agg: fx.group_aggregate(df, "o_custkey", "o_totalprice", agg),
        {f"o_totalprice_{_agg}_by_o_custkey": f"{_sql} OVER (PARTITION BY o_custkey)"},
    )
_feature(
    "feat_group_deviation", "lineitem", _LINE_KEYS,
    lambda df: fx.group_aggregate(df, "l_returnflag", "l_extendedprice", "max", add_deviation=True),
    {
        "l_extendedprice_max_by_l_returnflag": "max(l_extendedprice) OVER (PARTITION BY l_returnflag)",
        "l_extendedprice_dev_from_l_returnflag":
            "l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag)",
    },
    digits=4,
)

_ROW = ["l_quantity", "l_discount", "l_tax"]
_ROW_SQL = "[l_quantity, l_discount, l_tax]"
_ROW_AGGS = {
    "mean": f"list_avg({_ROW_SQL})", "sum": f"list_sum({_ROW_SQL})", "min": "least(l_quantity, l_discount, l_tax)",
    "max": "greatest(l_quantity, l_discount, l_tax)", "std": f"list_stddev_samp({_ROW_SQL})",
    "median": f"list_median({_ROW_SQL})", "count": f"list_count({_ROW_SQL})",
}
for _agg, _sql in _ROW_AGGS.items():
    _feature(
        f"feat_row_{_agg}", "lineitem", _LINE_KEYS,
        lambda df, agg=_agg: fx.row_aggregate(df, _ROW, agg), {f"{_agg}_of_3_cols": _sql},
    )
_feature(
    "feat_fractions", "lineitem", _LINE_KEYS, lambda df: fx.normalize_fractions(df, _ROW),
    {f"{c}_frac": f"{c} / nullif(l_quantity + l_discount + l_tax, 0)" for c in _ROW}, digits=8,
)
_feature(
    "feat_expression", "orders", ("o_orderkey",),
    lambda df: fx.compute_feature(
        fx.compute_feature(df, "share", "o_totalprice / nullif(avg(o_totalprice) OVER (PARTITION BY o_custkey), 0)"),
        "urgency", "CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'normal' END"),
    {
        "share": "o_totalprice / nullif(avg(o_totalprice) OVER (PARTITION BY o_custkey), 0)",
        "urgency": "CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'normal' END",
    },
    digits=8, exact=("urgency",),
)
_feature(
    "feat_regexp", "part", ("p_partkey",),
    lambda df: fx.compute_feature(df, "brand_no", "regexp_extract(p_brand, '([0-9]+)', 1)"),
    {"brand_no": "regexp_extract(p_brand, '([0-9]+)', 1)"}, exact=("brand_no",),
)
