import duckdb
import pytest

import __spark_entry__ as catalogue
from plumbline.plans.common import TABLES
from tools.oracle_check import rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "rfm_segments", "sql_window", "sql_join_asof", "feat_bin_quantile_ties", "feat_group_deviation", "profile_top_values",
    "fk_edges", "assoc_kruskal_ties", "assoc_chi2", "retention_orders", "basket_rules_all", "split_check",
    "decompose_by_priority", "compare_periods_ties",
)


def test_names_are_unique_and_every_oracle_has_a_query():
    names = [n for family in catalogue._families() for n in family.QUERIES]
    assert len(names) == len(set(names)) == len(catalogue.queries())
    assert set(catalogue.oracle_sql()) <= set(names)


def test_entry_gives_segments(spark):
    got = catalogue.entry(spark)
    assert got.columns == ["segment", "customers", "value"] and got.count() > 0


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_against_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    rel = con.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


def test_filters_reach_the_files(spark):
    plan = catalogue.queries()["sql_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [", 1)[1]
    assert "IsNotNull(l_quantity)" in pushed and "GreaterThanOrEqual(l_shipda" in pushed
    assert "l_returnflag" not in plan  # only the columns asked for are read
