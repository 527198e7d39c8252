import json
import random

import pytest

from plumbline import Session
from plumbline.sources.readers import parse_type, table_name


@pytest.fixture()
def orders_csv(tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text("region,amount\nnorth,10\nsouth,25\n")
    return str(path)


def churn(tmp_path, rows=400, seed=0):
    rng = random.Random(seed)
    lines = ["customer_id,tenure,charges,contract,churned"]
    for i in range(rows):
        tenure, charges = rng.randint(1, 70), round(rng.gauss(70, 20), 2)
        churned = 1.5 - 0.06 * tenure + 0.02 * (charges - 70) + rng.uniform(-0.5, 0.5) > 0
        contract = rng.choice(["monthly", "annual", "two_year"])
        lines.append(f"C{i:05d},{tenure},{charges},{contract},{'yes' if churned else 'no'}")
    path = tmp_path / "churn.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_is_named_after_its_file_and_summed(spark, orders_csv):
    session = Session.load(spark, orders_csv)
    assert session.tables == ["orders"]
    assert session.query("SELECT sum(amount) AS s FROM orders")["rows"] == [{"s": 35}]
    assert session.count_rows() == 2


@pytest.mark.parametrize("query", [
    "DROP VIEW orders", "CREATE TABLE x AS SELECT 1", "SET spark.sql.ansi.enabled=false",
    "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM text.`/etc/passwd`",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT TRANSFORM(amount) USING 'cat' FROM orders", "INSERT INTO orders VALUES ('a', 1)",
    "SELECT * FROM `csv`.`/etc/passwd`", "SELECT * FROM (SELECT * FROM parquet.`/tmp/x`)",
    "SELECT * FROM orders WHERE EXISTS (SELECT TRANSFORM(amount) USING 'cat' FROM orders)",
    "SELECT 1; SELECT 2", "SELECT (SELECT java_method('java.util.UUID', 'randomUUID')) AS u",
])
def test_sql_is_confined(spark, orders_csv, query):
    session = Session.load(spark, orders_csv)
    with pytest.raises(Exception):
        session.run_sql(query).collect()


def test_sessions_do_not_see_each_other(spark, orders_csv):
    first, second = Session.load(spark, orders_csv), Session(spark)
    second.create_table("orders", columns=[("x", "INT")])
    second.create_table("mine", columns=[("x", "INT")])
    got = first.run_sql("SELECT * FROM orders")
    assert second.query("SELECT count(*) AS n FROM orders")["rows"] == [{"n": 0}]
    assert got.count() == 2
    with pytest.raises(Exception):
        first.run_sql("SELECT * FROM mine")


def test_truncation_reports_the_full_count(spark, orders_csv):
    got = Session.load(spark, orders_csv).query("SELECT * FROM orders ORDER BY amount", limit=1)
    assert got == {"n_rows": 2, "truncated": True, "rows": [{"region": "north", "amount": 10}]}


def test_create_and_insert(spark, orders_csv):
    session = Session.load(spark, orders_csv)
    session.create_table("clean", columns=[("name", "VARCHAR(20)"), ("total", "DECIMAL(10,2)")])
    assert session.insert_into("clean", "SELECT trim(region), amount FROM orders") == {"inserted": 2, "n_rows": 2}
    assert session.insert_into("clean", "VALUES ('west', 1.5)") == {"inserted": 1, "n_rows": 3}
    assert float(session.query("SELECT sum(total) AS s FROM clean")["rows"][0]["s"]) == 36.5
    with pytest.raises(ValueError):
        session.create_table("x", columns=[("a", "int); DROP TABLE orders")])
    with pytest.raises(ValueError):
        session.create_table("x")


def test_names_and_types():
    assert table_name("Sales 2024!") == "sales_2024"
    assert table_name("2024") == "t_2024"
    assert table_name("select") == "select_tbl"
    assert table_name("???") == "tbl"
    assert table_name("a", ["a", "a_2"]) == "a_3"
    assert parse_type("NUMERIC(9, 3)").simpleString() == "decimal(9,3)"


def test_single_table_calls_need_one_table(spark, orders_csv, tmp_path):
    session = Session.load(spark, orders_csv)
    session.add_table(orders_csv, "again")
    with pytest.raises(ValueError):
        session.profile()


def test_relationships_and_join(spark):
    session = Session(spark)
    users = spark.createDataFrame([(i, f"u{i}") for i in range(1, 41)], "id long, name string")
    visits = spark.createDataFrame([(i, i % 20 + 1) for i in range(1000, 1100)], "id long, user_id long")
    session.add_table(users, "users")
    session.add_table(visits, "visits")
    graph = session.relationships()
    assert [(e.child_column, e.parent_table, e.parent_column, e.coverage, e.name_match) for e in graph.relationships] == [
        ("user_id", "users", "id", 1.0, True)]
    joined = session.join(["visits", "users"])
    assert joined.name == "join_visits_users"
    assert joined.df.columns == ["id", "user_id", "users_id", "name"]
    assert joined.count_rows() == 100
    with pytest.raises(ValueError):
        session.join(["visits", "users"], how="sideways")


def test_strong_name_rule_for_one_to_one_keys(spark):
    session = Session(spark)
    ids = spark.range(1, 51)
    session.add_table(ids, "users")
    session.add_table(ids.withColumnRenamed("id", "user_id"), "profiles")
    edges = session.relationships().relationships
    assert [(e.child_table, e.parent_table) for e in edges] == [("profiles", "users")]


def test_column_types_and_worklist(spark, tmp_path):
    table = Session.load(spark, churn(tmp_path)).table("churn")
    assert table.column_types() == {
        "customer_id": "identifier", "tenure": "continuous", "charges": "continuous", "contract": "categorical",
        "churned": "categorical"}
    assert [w["column"] for w in table.list_categorical_columns()] == ["contract", "churned"]
    with pytest.raises(ValueError):
        table.feature_roles()
    with pytest.raises(ValueError):
        table.set_column_type("contract", "continuous")
    table.set_column_type("contract", "categorical_ordinal")
    assert table.classify_as_nominal() == ["churned"]
    table.unset_column_type("contract")
    assert table.classify_column("contract") == "categorical"


def test_train_save_reopen_predict_explain(spark, tmp_path):
    base = str(tmp_path / "store")
    session = Session.create(spark, [churn(tmp_path)], base)
    table = session.table("churn")
    table.classify_as_nominal()
    trained = table.train_classifier("churned", "model", rounds=8)
    assert trained.values["metrics"]["roc_auc"] > 0.65
    assert trained.trust.level.value in ("high", "moderate")
    session.save_model(table, "model")
    assert Session.list(spark, base) == [session.key]

    again = Session.open(spark, session.key, base)
    other = again.table("churn")
    assert other.column_types()["contract"] == "categorical_nominal"
    assert other.evaluate("model").values == trained.values["metrics"]
    other.add_predictions("model")
    got = again.query("SELECT count(*) AS n FROM churn WHERE model_pred = churned")["rows"][0]["n"]
    assert got > 300
    assert "model_pred" in other.derived
    importance = other.feature_importance("model", repeats=3).values["importances"]
    assert max(importance, key=importance.get) == "tenure"
    told = other.explain_prediction("model", {"tenure": 3, "charges": 95.0, "contract": "monthly"})
    assert abs(sum(told.values["contributions"].values())
               - (told.values["prediction"] - told.values["base_value"])) < 1e-9
    with pytest.raises(KeyError):
        other.evaluate("nothing")


def test_meta_survives_corruption(spark, tmp_path, orders_csv):
    base = str(tmp_path / "store")
    session = Session.create(spark, [orders_csv], base)
    path = tmp_path / "store" / "sessions" / session.key / "meta.json"
    created = json.loads(path.read_text())["created_at"]
    session.save()
    assert json.loads(path.read_text())["created_at"] == created
    path.write_text("{ not json")
    crc = path.parent / ".meta.json.crc"
    if crc.exists():
        crc.write_bytes(b"")
    session._write_meta()
    assert json.loads(path.read_text())["session_id"] == session.key


def test_unloadable_model_is_reported(spark, tmp_path, orders_csv):
    base = str(tmp_path / "store")
    session = Session.create(spark, [orders_csv], base)
    table = session.table("orders")
    session.load_model(table, "ghost")
    assert "ghost" in session.info()["unloaded_models"]["orders"]


def test_tiny_table_declines_training(spark, tmp_path):
    table = Session.load(spark, churn(tmp_path, rows=20)).table("churn")
    table.classify_as_nominal()
    assert table.train_classifier("churned").declined


def test_envelope_is_strict_json(spark, orders_csv):
    result = Session.load(spark, orders_csv).profile()
    again = json.loads(result.to_json())
    assert again["declined"] is False and again["trust"]["level"] == "high"
