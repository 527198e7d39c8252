"""Preparation, clustering, models and explanations over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boost, cluster, interpret, learn, prep
from .common import Query, rounded, table

_LINE = prep.Roles(("l_quantity", "l_extendedprice"), ("l_returnflag",), ("l_linenumber",))
_ORDERS = prep.Roles(("o_totalprice", "o_custkey"), ("o_orderpriority",))
_FLAGS, _ROUNDS = ("A", "N", "R"), 3
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def prep_scaled(spark, sf_dir):
    df = prep.scaled_columns(table(spark, sf_dir, "lineitem"), _LINE)
    made = ["l_quantity_scaled", "l_extendedprice_scaled", "l_linenumber_scaled"]
    return rounded(df.select(*_KEYS, *made), 7, *made)


def prep_onehot(spark, sf_dir):
    df = prep.one_hot_columns(table(spark, sf_dir, "lineitem"), "l_returnflag")
    return df.select(*_KEYS, "l_returnflag_A", "l_returnflag_N", "l_returnflag_R")


def class_counts(spark, sf_dir):
    counts = learn.class_counts(table(spark, sf_dir, "orders"), "o_orderstatus")
    return counts.select(F.col("class").alias("label"), "n")


def split_check(spark, sf_dir):
    """The held-out quarter of each order status, by key hash."""
    df = learn.hold_out(table(spark, sf_dir, "orders"), ["o_orderkey"], "o_orderstatus")
    return df.select("o_orderkey", "in_test")


def split_plain(spark, sf_dir):
    df = learn.hold_out(table(spark, sf_dir, "events"), ["event_id"])
    return df.select("event_id", "in_test")


def _scored_labels(spark, sf_dir):
    """Label quality from document length: a stand-in model whose answers SQL can state."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return rows.withColumns(
        {"predicted": (F.col("n_chars") > 600).cast("int"), "score": F.col("n_chars") / (F.col("n_chars") + 600.0)}
    )


def eval_class(spark, sf_dir):
    cells = learn.confusion(_scored_labels(spark, sf_dir), "quality", "predicted")
    out = learn.classification_metrics(cells)
    return rounded(out, 9, "accuracy", "precision", "recall", "f1", "baseline_accuracy")


def eval_confusion(spark, sf_dir):
    return learn.confusion(_scored_labels(spark, sf_dir), "quality", "predicted")


def eval_auc(spark, sf_dir):
    rows = _scored_labels(spark, sf_dir).select(
        F.lit(1).alias("class"), (F.col("quality") == 1).alias("positive"), "score"
    )
    return rounded(learn.class_auc(rows).drop("class"), 9, "auc")


def eval_reg(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_quantity") * 1500.0)
    return rounded(learn.regression_metrics(df, "l_extendedprice", "guess"), 5, "mae", "rmse", "r2")


def kmeans_orders(spark, sf_dir):
    found = cluster.kmeans(table(spark, sf_dir, "orders"), prep.Roles(("o_totalprice", "o_custkey")), k=4)
    return found.labelled.select("o_orderkey", "cluster")


def kmeans_choose(spark, sf_dir):
    """The chosen k and its silhouette, k from 2 to 10."""
    found = cluster.kmeans(table(spark, sf_dir, "customer"), prep.Roles(("c_acctbal", "c_nationkey")))
    return spark.createDataFrame([(found.k, found.silhouette)], "k int, silhouette double")


def cluster_numbers(spark, sf_dir):
    """Means per group for a given label column."""
    df = table(spark, sf_dir, "lineitem").withColumn("cluster", F.col("l_linenumber") % 3)
    out = cluster.profile_numbers(df, ["l_quantity", "l_extendedprice"])
    return rounded(out, 4, "mean_l_quantity", "mean_l_extendedprice")


def cluster_categories(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("cluster", F.col("l_linenumber") % 3)
    return cluster.profile_categories(df, ["l_returnflag", "l_linestatus"])


def pca_lineitem(spark, sf_dir):
    roles = prep.Roles(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    out, _, _ = cluster.principal_components(table(spark, sf_dir, "lineitem"), roles, 2)
    return rounded(out.select(*_KEYS, "pca_0", "pca_1"), 6, "pca_0", "pca_1")


def _order_model(spark, sf_dir, task="classification"):
    target, roles = ("o_orderstatus", _ORDERS) if task == "classification" else ("o_totalprice", prep.Roles(
        ("o_custkey",), ("o_orderpriority", "o_orderstatus")))
    return learn.train(table(spark, sf_dir, "orders"), target, task, roles, ["o_orderkey"])


def train_predict(spark, sf_dir):
    """Multi-class model of order status: every row scored."""
    model = _order_model(spark, sf_dir)
    return learn.add_predictions(model, table(spark, sf_dir, "orders"), "status_pred").select("o_orderkey", "status_pred")


def _line_model(spark, sf_dir):
    roles = prep.Roles(("l_quantity", "l_discount", "l_tax"), ("l_returnflag",))
    return learn.train(table(spark, sf_dir, "lineitem"), "l_extendedprice", "regression", roles, _KEYS)


def boost_softmax(spark, sf_dir):
    """Chances of each return flag by line status after three rounds of boosting with one tree per flag."""
    df = table(spark, sf_dir, "lineitem").withColumn(
        "_y", learn.label_index(table(spark, sf_dir, "lineitem"), "l_returnflag", _FLAGS))
    plan = prep.learn(df, prep.Roles(nominal=("l_linestatus",)), scale=False)
    rows, slot = prep.encode(df, plan), F.col(prep.encoded_names(plan)[0])
    sizes = {int(r["_y"]): r["count"] for r in rows.groupBy("_y").count().collect()}
    loss, base = learn.start(sizes, len(_FLAGS))
    model = boost.boost(rows, [slot], F.col("_y"), loss, [], base, rounds=_ROUNDS, depth=2)
    chances = rows.select("l_linestatus", boost.answer(model, [slot]).alias("p"))
    out = chances.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.get("p", F.lit(i))).alias(f"chance_{f}") for i, f in enumerate(_FLAGS)])
    return rounded(out, 6, *[f"chance_{f}" for f in _FLAGS])


def train_regression_metrics(spark, sf_dir):
    return spark.createDataFrame([learn.holdout_metrics(_line_model(spark, sf_dir))])


def train_binary_metrics(spark, sf_dir):
    roles = prep.Roles(("l_quantity", "l_extendedprice"), ("l_returnflag",))
    model = learn.train(table(spark, sf_dir, "lineitem"), "l_linestatus", "classification", roles, _KEYS)
    found = learn.holdout_metrics(model)
    return spark.createDataFrame([{k: v for k, v in found.items() if k != "confusion_matrix"}])


def perm_importance(spark, sf_dir):
    return interpret.permutation_importance(_line_model(spark, sf_dir))


def shapley_rows(spark, sf_dir):
    """Contributions to every customer's predicted balance."""
    df = table(spark, sf_dir, "customer")
    roles = prep.Roles(("c_nationkey",), ("c_mktsegment",))
    model = learn.train(df, "c_acctbal", "regression", roles, ["c_custkey"])
    return interpret.shapley(model, df, "c_custkey")


def shapley_sums(spark, sf_dir):
    """Per customer: contributions add up to prediction minus base, one for each feature."""
    gap = F.sum("contribution") - F.first("prediction") + F.first("base_value")
    return shapley_rows(spark, sf_dir).groupBy("c_custkey").agg(
        F.count(F.lit(1)).alias("n_features"), (F.abs(gap) < 1e-6).alias("adds_up"))


def kmeans_nearest(spark, sf_dir):
    """Orders, those in a cluster whose centre (the mean of its scaled rows) is the nearest, and distinct clusters."""
    roles = prep.Roles(("o_totalprice", "o_custkey"))
    orders = prep.scaled_columns(table(spark, sf_dir, "orders"), roles)
    found = cluster.kmeans(orders, roles, k=4).labelled
    x, y = "o_totalprice_scaled", "o_custkey_scaled"
    centres = found.groupBy("cluster").agg(F.avg(x).alias("cx"), F.avg(y).alias("cy")).collect()  # four
    near = F.least(*[(F.col(x) - c["cx"]) ** 2 + (F.col(y) - c["cy"]) ** 2 for c in centres])
    own = F.coalesce(*[F.when(F.col("cluster") == c["cluster"], (F.col(x) - c["cx"]) ** 2 + (F.col(y) - c["cy"]) ** 2) for c in centres])
    share = F.avg((own <= near + 1e-2).cast("double"))  # the fit stops a little before the means stand still
    return found.agg(F.count(F.lit(1)).alias("n"), (share > 0.99).alias("nearest"), F.countDistinct("cluster").alias("k"))


def pca_two(spark, sf_dir):
    """Two scaled columns turn by 45 degrees: scores are their sum and difference over the root of two."""
    out, _, _ = cluster.principal_components(table(spark, sf_dir, "lineitem"), prep.Roles(("l_quantity", "l_extendedprice")), 2)
    a, b = F.abs("pca_0"), F.abs("pca_1")  # which axis comes first hangs on the sign of the correlation
    return rounded(out.select(*_KEYS, F.greatest(a, b).alias("far"), F.least(a, b).alias("near")), 6, "far", "near")


def metric_tree(spark, sf_dir):
    roles = prep.Roles(("l_quantity", "l_discount"), ("l_returnflag", "l_linestatus"))
    tree = interpret.MetricTree(table(spark, sf_dir, "lineitem"), "l_extendedprice", roles, True, keys=_KEYS)
    return rounded(tree.segments(), 4, "mean")


def metric_tree_totals(spark, sf_dir):
    """What the leaves of a tree hold together: all rows, and the mean of the whole."""
    leaves = metric_tree(spark, sf_dir).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    return rounded(leaves, 2, "mean")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        prep_scaled, prep_onehot, class_counts, split_check, split_plain, eval_class, eval_confusion, eval_auc,
        eval_reg, kmeans_orders, kmeans_choose, cluster_numbers, cluster_categories, pca_lineitem, train_predict,
        boost_softmax, train_regression_metrics, train_binary_metrics, perm_importance, shapley_rows, shapley_sums, metric_tree,
        metric_tree_totals, kmeans_nearest, pca_two,
    )
}

_LABELLED = """
    (SELECT quality, CAST(n_chars > 600 AS INTEGER) AS predicted, n_chars / (n_chars + 600.0::DOUBLE) AS score
     FROM labels JOIN documents USING (doc_id))"""
_KEYS_SQL = ", ".join(_KEYS)


def _split_sql(source: str, key: str, by: str) -> str:
    return f"""
        SELECT {key}, row_number() OVER (PARTITION BY {by} ORDER BY h) <= ceil(0.25 * count(*) OVER (PARTITION BY {by}))
               AS in_test
        FROM (SELECT *, ('0x' || substr(md5('0:' || {key}), 1, 15))::BIGINT AS h FROM {source}) s"""


def _scaled_sql(c: str) -> str:
    return f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 7) + 0.0 AS {c.replace('(', '').split(' ')[0]}_scaled"


def _dominant_sql(c: str) -> str:
    return (
        f"SELECT CAST(cluster AS INTEGER) AS cluster, '{c}' AS \"column\", v AS dominant FROM (SELECT l_linenumber % 3 AS cluster, "
        f"{c} AS v, row_number() OVER (PARTITION BY l_linenumber % 3 ORDER BY count(*) DESC, {c}) AS k "
        f"FROM lineitem GROUP BY 1, 2) s WHERE k = 1"
    )


def _softmax_sql() -> str:
    """Newton steps from the shares of all rows, per line status: each round adds 0.3 (share - chance) / (chance (1 - chance))."""
    total = ", ".join(f"ln(avg((l_returnflag = '{f}')::DOUBLE) OVER ()) AS m{f}, (l_returnflag = '{f}')::DOUBLE AS y{f}" for f in _FLAGS)
    steps = [f"s0 AS (SELECT l_linestatus, count(*) AS n, " + ", ".join(
        f"avg(m{f}) AS m{f}, avg(y{f}) AS y{f}" for f in _FLAGS) + f" FROM (SELECT l_linestatus, {total} FROM lineitem) r GROUP BY 1)"]
    whole = " + ".join(f"exp(m{f})" for f in _FLAGS)
    for i in range(_ROUNDS):
        chances = ", ".join(f"exp(m{f}) / ({whole}) AS p{f}" for f in _FLAGS)
        steps.append(f"p{i} AS (SELECT *, {chances} FROM s{i})")
        steps.append(f"s{i + 1} AS (SELECT l_linestatus, n, " + ", ".join(
            f"m{f} + 0.3 * (y{f} - p{f}) / (p{f} * (1 - p{f})) AS m{f}, y{f}" for f in _FLAGS) + f" FROM p{i})")
    chances = ", ".join(f"round(exp(m{f}) / ({whole}), 6) + 0.0 AS \"chance_{f}\"" for f in _FLAGS)
    return f"WITH {', '.join(steps)} SELECT l_linestatus, n, {chances} FROM s{_ROUNDS}"


ORACLE: dict[str, str] = {
    "boost_softmax": _softmax_sql(),
    "shapley_sums": "SELECT c_custkey, CAST(2 AS BIGINT) AS n_features, true AS adds_up FROM customer",
    "kmeans_nearest": "SELECT count(*) AS n, true AS nearest, CAST(4 AS BIGINT) AS k FROM orders",
    "metric_tree_totals": "SELECT CAST(count(*) AS BIGINT) AS n, round(avg(l_extendedprice), 2) + 0.0 AS mean FROM lineitem",
    "pca_two": f"""
        SELECT {_KEYS_SQL}, round(greatest(abs(a + b), abs(a - b)) / sqrt(2), 6) + 0.0 AS far,
               round(least(abs(a + b), abs(a - b)) / sqrt(2), 6) + 0.0 AS near
        FROM (SELECT *, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a,
                     (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS b FROM lineitem)""",
    "prep_scaled": f"""
        SELECT {_KEYS_SQL}, {_scaled_sql('l_quantity')}, {_scaled_sql('l_extendedprice')}, {_scaled_sql('l_linenumber')}
        FROM lineitem""",
    "prep_onehot": f"SELECT {_KEYS_SQL}, " + ", ".join(
        f"CAST(l_returnflag = '{v}' AS INTEGER) AS \"l_returnflag_{v}\"" for v in "ANR") + " FROM lineitem",
    "class_counts": "SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1",
    "split_check": _split_sql("orders", "o_orderkey", "o_orderstatus"),
    "split_plain": _split_sql("events", "event_id", "1"),
    "eval_class": f"""
        WITH c AS (SELECT quality AS y, predicted AS p FROM {_LABELLED} s),
             k AS (SELECT DISTINCT y FROM c),
             m AS (SELECT k.y, (SELECT count(*) FROM c WHERE c.y = k.y) AS support,
                          (SELECT count(*) FROM c WHERE c.y = k.y AND c.p = k.y) AS hits,
                          (SELECT count(*) FROM c WHERE c.p = k.y) AS called FROM k),
             s AS (SELECT support, hits, coalesce(hits / nullif(called, 0), 0) AS p, hits / support AS r FROM m)
        SELECT sum(support)::BIGINT AS n, round(sum(hits) / sum(support), 9) + 0.0 AS accuracy,
               round(sum(support * p) / sum(support), 9) + 0.0 AS precision,
               round(sum(support * r) / sum(support), 9) + 0.0 AS recall,
               round(sum(support * coalesce(2 * p * r / nullif(p + r, 0), 0)) / sum(support), 9) + 0.0 AS f1,
               round(max(support) / sum(support), 9) + 0.0 AS baseline_accuracy FROM s""",
    "eval_confusion": f"SELECT quality AS label, predicted AS prediction, count(*) AS n FROM {_LABELLED} s GROUP BY 1, 2",
    "eval_auc": f"""
        WITH s AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r
                   FROM {_LABELLED} l)
        SELECT count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality <> 1) AS n_neg,
               round((sum(r) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1)
                      * (count(*) FILTER (WHERE quality = 1) + 1) / 2.0)
                     / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality <> 1)), 9) + 0.0 AS auc FROM s""",
    "eval_reg": """
        SELECT count(*) AS n, round(avg(abs(l_extendedprice - 1500 * l_quantity)), 5) + 0.0 AS mae,
               round(sqrt(avg((l_extendedprice - 1500 * l_quantity) ** 2)), 5) + 0.0 AS rmse,
               round(1 - avg((l_extendedprice - 1500 * l_quantity) ** 2) / var_pop(l_extendedprice), 5) + 0.0 AS r2
        FROM lineitem""",
    "cluster_numbers": """
        SELECT CAST(l_linenumber % 3 AS INTEGER) AS cluster, count(*) AS size,
               round(avg(l_quantity), 4) + 0.0 AS mean_l_quantity,
               round(avg(l_extendedprice), 4) + 0.0 AS mean_l_extendedprice FROM lineitem GROUP BY 1""",
    "cluster_categories": " UNION ALL ".join(_dominant_sql(c) for c in ("l_returnflag", "l_linestatus")),
}
