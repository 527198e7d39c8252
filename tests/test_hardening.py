"""Inputs that plain tables do not show: constants, nulls, repeated keys, clashing names, other layouts, other folders."""

import datetime
import random
from itertools import combinations

import pytest

from plumbline import Session
from plumbline.functions import guard, hashing, ordering, stages, tails
from plumbline.operators import associate, basket, causal, learn, prep


def test_constant_number_columns_decline_or_degenerate(spark):
    df = spark.createDataFrame([(float(i % 7), 3.5, 1.0 if i % 2 else None, float(i) if i % 2 else None) for i in range(60)],
                               "a double, k double, half double, other double")
    assert associate.test_numbers(df, "a", "k").method == "degenerate"
    assert associate.test_numbers(df.limit(5), "a", "k").method == "declined"
    assert associate.test_numbers(df, "half", "other").method == "degenerate"  # constant where both are there
    assert associate.test_numbers(df, "a", "other").method in ("pearson", "spearman")


def test_fingerprint_sees_moved_nulls_types_and_cuts(spark):
    rows = lambda data, kind: spark.createDataFrame(data, kind)
    texts = [hashing.fingerprint_text(df) for df in (
        rows([(None, 5)], "a int, b int"), rows([(5, None)], "a int, b int"), rows([(5, None)], "a long, b int"),
        rows([("x", "yz")], "a string, b string"), rows([("xy", "z")], "a string, b string"), rows([("x,string:1:y", "z")], "a string, b string"))]
    assert len(set(texts)) == len(texts)
    many = rows([(i, str(i)) for i in range(50)], "a int, b string")
    assert hashing.fingerprint_text(many.repartition(7)) == hashing.fingerprint_text(many.coalesce(1))


@pytest.mark.parametrize("n1,n2", [(1, 4), (2, 3), (4, 4), (3, 9), (8, 9)])
def test_exact_u_for_small_groups(n1, n2):
    sums = [sum(c) - n1 * (n1 - 1) // 2 for c in combinations(range(n1 + n2), n1)]
    for u in range(-1, n1 * n2 + 1):
        assert tails.u_at_most(u, n1, n2) == pytest.approx(sum(s <= u for s in sums) / len(sums), abs=1e-12)


def test_u_has_one_rule_at_every_size():
    near = [tails.mann_whitney_p(60_000, 8, n, 0) for n in (24_999, 25_000, 25_001, 25_002)]
    steps = [a - b for a, b in zip(near, near[1:])]
    assert max(steps) < 2 * min(steps) and 0 < tails.mann_whitney_p(4.2e9, 8, 10**9, 0) < 1


def test_sql_sees_only_its_own_tables(spark):
    mine = spark.createDataFrame([(i, i % 3) for i in range(9)], "a long, b long")
    spark.createDataFrame([(1,)], "z int").createOrReplaceTempView("t")
    spark.createDataFrame([(1,)], "z int").createOrReplaceTempView("stranger")
    got = guard.run_query(spark, "WITH q AS (SELECT b, count(*) AS n FROM t GROUP BY b) SELECT b, 'paid using ''cash''' AS x FROM q", {"t": mine})
    assert got.join(mine, "b").count() == 9
    assert spark.table("t").columns == ["z"]  # the caller's view is neither read nor dropped
    for query in ("SELECT * FROM stranger", "SELECT * FROM t WHERE a IN (SELECT z FROM stranger)", "SELECT TRANSFORM(a) USING 'cat' FROM t",
                  "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`", "DROP VIEW t"):
        with pytest.raises(ValueError):
            guard.run_query(spark, query, {"t": mine})


def test_tables_are_read_by_what_the_folder_holds(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/plain")
    spark.range(5).write.option("header", True).csv(f"{tmp_path}/text")
    session = Session.load(spark, [f"{tmp_path}/plain", f"{tmp_path}/text"])
    assert session.table("plain").df.columns == ["id"] and session.table("plain").count_rows() == 5
    assert session.table("text").count_rows() == 5


def test_write_back_needs_one_row_per_key(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, k string").write.parquet(f"{tmp_path}/t.parquet")
    table = Session.load(spark, [f"{tmp_path}/t.parquet"]).table("t")
    with pytest.raises(ValueError):
        table.write_column("v", spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), on=["k"])
    table.write_column("v", spark.createDataFrame([("a", 1)], "k string, v int"), on=["k"])
    assert sorted((r.id, r.v) for r in table.df.collect()) == [(1, 1), (2, None), (3, 1)]


def test_predictions_keep_every_column(spark):
    rng = random.Random(1)
    rows = [(i, float(i % 10), rng.choice("xy"), float(i), "note", int(i % 10 > 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "`_c0` int, features double, `_c1` string, prediction double, probability string, y int")
    model = learn.train(df, "y", "classification", prep.Roles(numeric=("features", "prediction"), nominal=("_c1",)), rounds=3, depth=2)
    out = learn.add_predictions(model, df, "guess")
    assert out.columns == [*df.columns, "guess"]
    assert sum(r.guess == r.y for r in out.collect()) > 190


def test_models_with_date_targets_are_saved(spark, tmp_path):
    days = [datetime.date(2024, 1, 1), datetime.date(2024, 6, 1)]
    rows = [(i, float(i % 10), days[i % 10 > 4]) for i in range(200)]
    spark.createDataFrame(rows, "id int, x double, d date").write.parquet(f"{tmp_path}/t.parquet")
    session = Session.create(spark, [f"{tmp_path}/t.parquet"], str(tmp_path / "sessions"))
    table = session.table("t")
    table.models["a b"] = table.models["a_b"] = learn.train(table.df, "d", "classification", prep.Roles(numeric=("x",)), rounds=2, depth=2)
    for name in ("a b", "a_b"):
        session.save_model(table, name)
    assert session._model_folder("t", "a b") != session._model_folder("t", "a_b")
    table.models.clear()
    session.load_model(table, "a b")
    assert not table.unloaded_models and table.models["a b"].classes == days


def test_causal_check_does_not_depend_on_the_layout(spark):
    rng = random.Random(3)
    rows = [(float(i % 2), 2.0 * (i % 2) + rng.gauss(0, 1), rng.choice("abc")) for i in range(300)]
    df = spark.createDataFrame([*rows, *rows[:20]], "t double, y double, c string")
    found = [causal.causal_effect(df.repartition(n), "t", "y", categories=["c"]).new_effect for n in (1, 3, 8)]
    assert max(found) - min(found) < 1e-9


def test_rules_of_long_itemsets_do_not_overflow(spark):
    sets = spark.createDataFrame([([f"i{k:02d}" for k in range(2)], 5, 0.5), (["i00"], 5, 0.5), (["i01"], 5, 0.5)], "items array<string>, freq long, support double")
    assert "bigint" in str(basket.rules(sets)._jdf.queryExecution().analyzed()) or basket.rules(sets).count() == 2


def test_created_and_inserted_rows_are_written_once(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/t.parquet")
    session = Session.load(spark, [f"{tmp_path}/t.parquet"])
    made = session.create_table("made", select_sql="SELECT id, rand() AS r FROM t")
    assert [r.r for r in made.df.orderBy("id").collect()] == [r.r for r in made.df.orderBy("id").collect()]
    assert session.insert_into("made", "SELECT id + 5, rand() FROM t") == {"inserted": 5, "n_rows": 10}


def test_intermediate_results_need_a_shared_folder(spark):
    folder = stages.shared_folder(spark)
    assert spark.sparkContext.applicationId in folder
    source = open(stages.__file__).read()
    assert "tempfile" not in source and "RuntimeError" in source


def test_text_keys_with_a_common_beginning_spread_over_cells(spark):
    df = spark.range(5000).selectExpr("concat('Customer#000000000', lpad(id, 9, '0')) AS k", "1.0D AS v")
    cells = ordering.with_cell(df, "k").selectExpr("k", "_cell").collect()
    assert len({r._cell for r in cells}) > 50
    assert [r._cell for r in sorted(cells, key=lambda r: r.k)] == sorted(r._cell for r in cells)
    placed = ordering.ordinal_positions(df, ["v"], "k").collect()
    assert [r.position for r in sorted(placed, key=lambda r: r.key)] == list(range(1, 5001))


def test_one_table_session_shows_its_models(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/t.parquet")
    session = Session.load(spark, [f"{tmp_path}/t.parquet"])
    assert session.models == {} and session.count_rows() == 5
    with pytest.raises(AttributeError):
        session.no_such_thing
