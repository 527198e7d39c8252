"""One table with its column types, derived columns, models, and every analytic."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import tails
from .functions.clean import NUMERIC, field_type, micros, moment, present, quoted, require
from .functions.hashing import fingerprint_text
from .operators import associate, basket, causal, cluster, customers, describe, features, interpret, learn, prep
from .operators import series as ts
from .operators.typing import (
    CATEGORICAL, CONTINUOUS, NOMINAL, ORDINAL, SETTABLE, categorical_worklist, detect_types,
)
from .results import (
    Result, Trust, TrustLevel, combine, declined_result, from_sample_size, json_safe,
)

if TYPE_CHECKING:
    from .session import Session

_NOT_CAUSE = "Two things moving together does not show that one causes the other."
_EXACT = Trust(
    TrustLevel.HIGH,
    ("A fixed calculation with nothing estimated; check that it is the one you meant.",),
    ("deterministic",),
)
_TRAIN_NOTES = (
    "Scores describe this data and this split; new data may do worse.",
    "A model of few rows fits them too closely.",
)
_CAUSAL_NOTES = (
    "Estimated from observed, not assigned, treatment: the listed confounders must capture every shared cause.",
    "An unmeasured cause or a reversed direction would bias it; treat it as a hypothesis to test.",
)


class Table:
    def __init__(self, name: str, df: DataFrame, session: "Session | None" = None, key: Sequence[str] | None = None) -> None:
        self.name = name
        self.df = df
        self.session = session
        self.key = list(key) if key else None
        self.models: dict[str, learn.TrainedModel] = {}
        self.unloaded_models: dict[str, str] = {}
        self.derived: set[str] = set()
        self._types: dict[str, str] = {}

    def __repr__(self) -> str:
        return f"<Table {self.name!r} {self.df.columns}>"

    # --- rows and columns ----------------------------------------------------------

    def count_rows(self) -> int:
        return self.df.count()

    def count_non_null(self, column: str) -> dict[str, int]:
        require(self.df, column)
        row = self.df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(present(self.df, column)).alias("n_non_null")).first()
        return {"n_non_null": row["n_non_null"], "n_rows": row["n_rows"], "n_null": row["n_rows"] - row["n_non_null"]}

    def replace(self, df: DataFrame, added: Iterable[str] = (), feature: bool = True) -> None:
        """Take a new version of the rows; ``added`` columns are features or derived notes."""
        for c in added:
            self._types.pop(c, None)
            (self.derived.discard if feature else self.derived.add)(c)
        self.df = df

    def write_column(self, name: str, value: Column | DataFrame, on: Sequence[str] = (), feature: bool = False) -> None:
        """Add or replace a column from an expression, or from a keyed frame joined on ``on``."""
        if isinstance(value, Column):
            df = self.df.withColumn(name, value)
        else:
            if not on:
                raise ValueError("A frame is written back by key: name the key columns.")
            if value.groupBy(*[quoted(k) for k in on]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
                raise ValueError(f"The frame has several rows for one key {list(on)}; there is no single value to write back.")
            base = self.df.drop(name)
            df = base.join(value.select(*[quoted(k) for k in on], quoted(name)), list(on), "left")
            df = df.select(*[quoted(c) for c in base.columns], quoted(name))
        self.replace(df, [name], feature)

    def fingerprint(self) -> str:
        return fingerprint_text(self.df)

    # --- types ----------------------------------------------------------------------

    def column_types(self) -> dict[str, str]:
        """Type of every column; only columns without a known type are computed."""
        missing = [c for c in self.df.columns if c not in self._types]
        if missing:
            self._types |= detect_types(self.df.select(*[quoted(c) for c in missing]))
        return {c: self._types[c] for c in self.df.columns}

    def classify_column(self, column: str, override: bool = False) -> str:
        require(self.df, column)
        if override or column not in self._types:
            self._types[column] = detect_types(self.df.select(quoted(column)))[column]
        return self._types[column]

    def set_column_type(self, column: str, kind: str) -> None:
        if kind not in SETTABLE:
            raise ValueError(f"Only {list(SETTABLE)} may be set, not {kind!r}; other types come from the data.")
        require(self.df, column)
        self._types[column] = kind

    def unset_column_type(self, column: str) -> None:
        self._types.pop(column, None)

    def classify_as_nominal(self) -> list[str]:
        open_ones = [c for c, k in self.column_types().items() if k == CATEGORICAL]
        self._types |= dict.fromkeys(open_ones, NOMINAL)
        return open_ones

    def list_categorical_columns(self) -> list[dict[str, Any]]:
        open_ones = [c for c, k in self.column_types().items() if k == CATEGORICAL]
        if not open_ones:
            return []
        found = {r["column"]: r for r in categorical_worklist(self.df, open_ones).collect()}
        return [
            {"column": c, "distinct": found[c]["distinct"] if c in found else 0,
             "sample": list(found[c]["sample"]) if c in found else []}
            for c in open_ones
        ]

    def feature_roles(self, exclude: Iterable[str] = ()) -> prep.Roles:
        left_out = set(exclude) | self.derived
        return prep.feature_roles({c: k for c, k in self.column_types().items() if c not in left_out})

    # --- description ----------------------------------------------------------------

    def profile(self) -> Result:
        types = self.column_types()
        numbers = [c for c, k in types.items() if k == CONTINUOUS]
        others = [c for c in types if c not in numbers]
        missing = {r["column"]: r for r in describe.missing_counts(self.df).collect()}
        values = {r["column"]: r for r in describe.profile_values(self.df, list(types), others).collect()}
        stats = {r["column"]: r for r in describe.profile_numeric(self.df, numbers).collect()} if numbers else {}
        n_rows = next(iter(missing.values()))["n_rows"] if missing else 0
        out: dict[str, Any] = {}
        for c, kind in types.items():
            entry = {
                "type": kind, "n_missing": missing[c]["n_missing"], "missing_rate": missing[c]["missing_rate"],
                "n_unique": values[c]["n_unique"] if c in values else 0,
            }
            if c in stats and stats[c]["n"]:
                entry |= {k: stats[c][k] for k in ("min", "max", "mean", "median", "std", "skew")}
            elif kind != CONTINUOUS:
                entry["top_values"] = {t["value"]: t["n"] for t in (values[c]["top"] or [])} if c in values else {}
            out[c] = entry
        trust = Trust(TrustLevel.HIGH, ("Describes the data as given, right or wrong.",), (f"n={n_rows}",))
        gaps = sorted(c for c, e in out.items() if e["missing_rate"] >= 0.2)
        if gaps:
            trust = trust.note(f"A fifth or more is missing in: {', '.join(gaps)}.")
        return Result("profile", f"{len(out)} columns over {n_rows} rows", out,
                      {"n_rows": n_rows, "n_columns": len(out)}, trust)

    def detect_outliers(self, column: str) -> Result:
        kind = self.classify_column(column)
        if kind != CONTINUOUS:
            raise ValueError(f"Outliers need a continuous column; {column!r} is {kind}.")
        limits = describe.outlier_limits(self.df, column)
        flagged = describe.flag_outliers(self.df, column, limits)
        made = [f"{column}_is_outlier", f"{column}_outlier_method"]
        counts = describe.outlier_counts(flagged, column).first().asDict()
        self.replace(flagged, made, feature=False)
        trust = from_sample_size(limits["n"], 30, 100, "values").note("An outlier is unusual, not necessarily wrong.")
        return Result(
            "outlier_iqr_zscore", f"{counts['n_outliers']} outliers in {column}", counts,
            {"iqr_bounds": [limits["low"], limits["high"]], "zscore_threshold": describe.Z_LIMIT,
             "flag_column": made[0], "method_column": made[1]}, trust, flagged,
        )

    def association_matrix(self) -> Result:
        types = self.column_types()
        continuous = [c for c, k in types.items() if k == CONTINUOUS and c not in self.derived]
        coded = [c for c, k in types.items() if k in SETTABLE and c not in self.derived]
        names = [c for c in self.df.columns if c in continuous or c in coded]
        rows = associate.association_matrix(self.df.select(*[quoted(c) for c in names]), continuous, coded)
        matrix: dict[str, dict[str, float | None]] = {a: {b: 1.0 if a == b else None for b in names} for a in names}
        for r in rows:
            matrix[r["col_a"]][r["col_b"]] = matrix[r["col_b"]][r["col_a"]] = r["effect_size"]
        trust = from_sample_size(self.count_rows(), 30, 100, "rows").note(
            _NOT_CAUSE, "Cells are effect sizes from 0 to 1; test a pair on its own before relying on it.")
        return Result("association_matrix", f"{len(names)} columns, all pairs", {"columns": names, "matrix": matrix},
                      {"methods": {f"{r['col_a']}__{r['col_b']}": r["method"] for r in rows}}, trust)

    def _association_kind(self, column: str) -> str:
        kind = self.classify_column(column)
        if kind == CATEGORICAL:
            raise ValueError(f"{column!r} is unrefined; set it to nominal or ordinal first.")
        if kind not in (CONTINUOUS, NOMINAL, ORDINAL):
            raise ValueError(f"{column!r} is {kind}; association needs continuous or categorical columns.")
        return "continuous" if kind == CONTINUOUS else "categorical"

    def analyze_association(self, a: str, b: str) -> Result:
        if a == b:
            raise ValueError("A column is not tested against itself.")
        kinds = {c: self._association_kind(c) for c in (a, b)}
        numbers = [c for c, k in kinds.items() if k == "continuous"]
        test = associate.test_pair(self.df, a, b, numbers)
        dtypes = sorted(kinds.values()) if len(numbers) == 1 else [kinds[a], kinds[b]]
        meta = {"dtype_a": dtypes[0], "dtype_b": dtypes[1], "effect_size_measure": test.measure,
                "assumption_checks": test.checks, "n": test.n}
        if test.method == "declined":
            return declined_result("analyze_association",
                                   f"{test.n} complete rows; at least {associate.MIN_ROWS} are needed.", meta, (_NOT_CAUSE,))
        if test.method == "declined_groups":
            return declined_result("analyze_association", "there are fewer than two groups to compare.", meta, (_NOT_CAUSE,))
        if test.method == "degenerate":
            trust = Trust(TrustLevel.HIGH, ("One side never varies, so there is nothing to associate.", _NOT_CAUSE),
                          (f"n={test.n}",))
            return Result("degenerate", "no variation on one side", test.values, meta, trust)
        trust = from_sample_size(test.n, 30, 100, "rows").note(_NOT_CAUSE)
        if test.checks.get("expected_counts_ok") is False:
            trust = trust.note("Some combinations are rare, which weakens the test.")
        p = test.values["p_value"]
        if p >= 0.05:
            trust = trust.note(f"Not significant (p={p:.3g}); it may be chance.")
        summary = f"{test.measure}={test.effect:.3f}, p={p:.3g}"
        if len(numbers) == 2:
            sign = "positive" if test.values["statistic"] >= 0 else "negative"
            summary = f"{strength(test.effect)} {sign} correlation ({summary})"
            trust = trust.note(f"A {strength(test.effect)} correlation explains {test.effect ** 2:.0%} of the variation.")
        return Result(test.method, summary, test.values, meta, trust)

    # --- features ---------------------------------------------------------------------

    def _feature(self, method: str, df: DataFrame, names: list[str], meta: dict[str, Any], count: bool = False,
                 values: dict[str, Any] | None = None) -> Result:
        self.replace(df, names, feature=True)
        values = values or ({"column": names[0]} if len(names) == 1 else {"columns": names})
        if count:
            values["n_non_null"] = df.agg(F.count(quoted(names[0]))).first()[0]
        return Result(method, f"Created {', '.join(names)}", values, {**meta, "feature": True}, _EXACT, df)

    def combine_columns(self, a: str, b: str, op: str, name: str | None = None) -> Result:
        df = features.combine_columns(self.df, a, b, op, name)
        features.need_numbers(self.df, a, b)
        return self._feature("combine_columns", df, [name or f"{a}_{op}_{b}"], {"op": op, "inputs": [a, b]}, True)

    def transform_column(self, column: str, func: str, name: str | None = None) -> Result:
        df = features.transform_column(self.df, column, func, name)
        features.need_numbers(self.df, column)
        return self._feature("transform_column", df, [name or f"{func}_{column}"], {"func": func, "input": column}, True)

    def bin_column(self, column: str, n_bins: int = 4, strategy: str = "quantile", name: str | None = None) -> Result:
        df = features.bin_column(self.df, column, n_bins, strategy, name)
        made = name or f"{column}_bin"
        n = df.where(F.col(quoted(made)).isNotNull()).select(quoted(made)).distinct().count()
        return self._feature("bin_column", df, [made], {"strategy": strategy, "requested_bins": n_bins, "input": column},
                             values={"column": made, "n_bins": n})

    def expand_datetime(self, column: str, parts: Sequence[str] | None = None) -> Result:
        df = features.expand_datetime(self.df, column, parts)
        if not self.df.agg(F.count(moment(self.df, column))).first()[0]:
            raise ValueError(f"No value of {column!r} reads as a date.")
        chosen = list(parts or features.DEFAULT_DATE_PARTS)
        return self._feature("expand_datetime", df, [f"{column}_{p}" for p in chosen], {"input": column, "parts": chosen})

    def group_aggregate(self, group_by: str, value: str, agg: str = "mean", name: str | None = None,
                        add_deviation: bool = False) -> Result:
        df = features.group_aggregate(self.df, group_by, value, agg, name, add_deviation)
        if agg != "count" or add_deviation:
            features.need_numbers(self.df, value)
        made = [name or f"{value}_{agg}_by_{group_by}", *([f"{value}_dev_from_{group_by}"] if add_deviation else [])]
        return self._feature("group_aggregate", df, made, {"group_by": group_by, "value": value, "agg": agg},
                             values={"columns": made})

    def row_aggregate(self, columns: Sequence[str], agg: str = "sum", name: str | None = None) -> Result:
        df = features.row_aggregate(self.df, columns, agg, name)
        features.need_numbers(self.df, *columns)
        made = name or f"{agg}_of_{len(columns)}_cols"
        return self._feature("row_aggregate", df, [made], {"agg": agg, "inputs": list(columns)})

    def normalize_fractions(self, columns: Sequence[str], suffix: str = "_frac") -> Result:
        df = features.normalize_fractions(self.df, columns, suffix)
        features.need_numbers(self.df, *columns)
        return self._feature("normalize_fractions", df, [f"{c}{suffix}" for c in columns], {"inputs": list(columns)})

    def compute_feature(self, name: str, expression: str) -> Result:
        df = features.compute_feature(self.df, name, expression)
        return self._feature("compute_feature", df, [name], {"expression": expression}, True)

    # --- clusters and components --------------------------------------------------------

    def cluster(self, n_clusters: int | None = None) -> Result:
        roles = self.feature_roles(exclude=[cluster.LABEL])
        found = cluster.kmeans(self.df, roles, n_clusters)
        self.replace(found.labelled, [cluster.LABEL], feature=False)
        n = sum(found.sizes.values())
        values = {"n_clusters": found.k, "silhouette": found.silhouette, "cluster_sizes": found.sizes}
        meta = {"algorithm": "kmeans", "k_selection": "silhouette" if n_clusters is None else "fixed",
                "features": list(roles.names), "label_column": cluster.LABEL, "n": n,
                "silhouette_distance": "squared_euclidean"}
        if n < 2:
            meta["k_selection"] = "degenerate"
            return declined_result("kmeans", f"{n} row(s) cannot be split into clusters.", meta, values=values)
        trust = from_sample_size(n, 30, 200, "rows").note(
            "How many clusters there are is a choice.", "Other settings can group the same rows differently.")
        if found.silhouette is not None and found.silhouette < 0.25:
            trust = trust.note("The clusters overlap a good deal.").capped(
                TrustLevel.LOW, f"silhouette={found.silhouette:.3f}")
        return Result("kmeans", f"{found.k} clusters", values, meta, trust, found.labelled)

    def profile_clusters(self) -> Result:
        if cluster.LABEL not in self.df.columns:
            raise ValueError("There are no cluster labels yet: call cluster() first.")
        roles = self.feature_roles(exclude=[cluster.LABEL])
        coded = list(roles.nominal + roles.ordinal)
        out: dict[int, Any] = {}
        for r in cluster.profile_numbers(self.df, roles.numeric).collect():
            out[r[cluster.LABEL]] = {"size": r["size"], "numeric_means": {c: r[f"mean_{c}"] for c in roles.numeric},
                                     "dominant_categories": dict.fromkeys(coded)}
        if coded:
            for r in cluster.profile_categories(self.df, coded).collect():
                out[r[cluster.LABEL]]["dominant_categories"][r["column"]] = r["dominant"]
        n = sum(e["size"] for e in out.values())
        trust = from_sample_size(n, 30, 200, "rows").note("Describes the clusters; it does not show they are real.")
        return Result("profile_clusters", f"{len(out)} clusters", {"clusters": dict(sorted(out.items()))},
                      {"numeric_features": list(roles.numeric), "categorical_features": coded}, trust)

    def reduce_dimensions(self, method: str = "pca", n_components: int = 2) -> Result:
        if method.lower() != "pca":
            raise ValueError(f"Unknown method {method!r}; 'pca' is the one that scales out.")
        made = [f"pca_{i}" for i in range(n_components)]
        old = [c for c in self.df.columns if c == cluster.LABEL or c.startswith(("pca_", "tsne_", "umap_"))]
        roles = self.feature_roles(exclude=old)
        df, ratios, _ = cluster.principal_components(self.df, roles, n_components)
        n = self.count_rows()
        self.replace(df, made, feature=True)
        kept = sum(ratios)
        trust = from_sample_size(n, 30, 200, "rows").note(
            "Fewer dimensions distort distances.", f"{kept:.0%} of the variance is kept.")
        if kept < 0.5:
            trust = trust.capped(TrustLevel.LOW, f"variance_explained={kept:.3f}")
        return Result("pca", f"{len(roles.names)} features to {n_components} components",
                      {"n_components": n_components, "explained_variance_ratio": ratios, "columns": made},
                      {"method": "pca", "features": list(roles.names), "columns_written": made}, trust, df)

    # --- models ---------------------------------------------------------------------------

    def _train(self, target: str, task: str, name: str | None, **options: Any) -> Result:
        require(self.df, target)
        roles = self.feature_roles(exclude=[target])
        fitted = learn.train(self.df, target, task, roles, self.key, **options)
        if isinstance(fitted, tuple):
            reason, n = fitted
            return declined_result("train", f"{reason}.", {"target": target, "task": task, "n_rows": n}, _TRAIN_NOTES)
        name = name or target
        self.models[name] = fitted
        scored = self.evaluate(name)
        trust = combine(from_sample_size(fitted.n_rows, learn.MIN_TRAIN_ROWS, 200, "rows").note(*_TRAIN_NOTES), scored.trust)
        return Result("train", f"Trained {name!r} ({fitted.algorithm}): {scored.summary}",
                      {"model": name, "metrics": scored.values},
                      {"target": target, "task": task, "backend": fitted.algorithm, "features": list(roles.names),
                       "n_rows": fitted.n_rows}, trust, artifact=fitted)

    def train_classifier(self, target: str, name: str | None = None, **options: Any) -> Result:
        return self._train(target, "classification", name, **options)

    def train_regressor(self, target: str, name: str | None = None, **options: Any) -> Result:
        return self._train(target, "regression", name, **options)

    def model(self, name: str) -> learn.TrainedModel:
        if name not in self.models and self.session is not None:
            self.session.load_model(self, name)
        if name not in self.models:
            why = f" ({self.unloaded_models[name]})" if name in self.unloaded_models else ""
            raise KeyError(f"No model {name!r}{why}; known: {list(self.models)}.")
        return self.models[name]

    def evaluate(self, name: str) -> Result:
        m = self.model(name)
        values = json_safe(learn.holdout_metrics(m))
        n = values.pop("n")
        trust = combine(
            from_sample_size(m.n_rows, learn.MIN_TRAIN_ROWS, 200, "rows").note(*_TRAIN_NOTES),
            from_sample_size(n, 30, 100, "test rows").note("One held-out split; another would score a little differently."),
        )
        if m.task == "classification":
            method, summary = "classification_metrics", f"accuracy={values['accuracy']:.3f}, f1={values['f1']:.3f}"
            weak = values["accuracy"] <= values["baseline_accuracy"]
        else:
            r2 = values["r2"]
            method, summary = "regression_metrics", f"R²={r2 if r2 is None else round(r2, 3)}, RMSE={values['rmse']:.3g}"
            weak = r2 is None or r2 <= 0
        if weak:
            trust = combine(trust, Trust(TrustLevel.LOW, ("No better than a constant guess on held-out rows.",),
                                         ("no held-out skill",)))
        return Result(method, summary, values,
                      {"target": m.target, "task": m.task, "backend": m.algorithm, "n_test": n}, trust)

    def add_predictions(self, name: str, column: str | None = None) -> Result:
        m = self.model(name)
        column = column or f"{name}_pred"
        df = learn.add_predictions(m, self.df, column)
        self.replace(df, [column], feature=False)
        trust = from_sample_size(m.n_rows, learn.MIN_TRAIN_ROWS, 200, "rows").note(
            *_TRAIN_NOTES, "Rows used in training look better predicted than new ones will be.")
        return Result("add_predictions", f"Predictions in {column!r}", {"column": column, "n": self.count_rows()},
                      {"model": name, "table": self.name, "backend": m.algorithm}, trust, df)

    def feature_importance(self, name: str, repeats: int = interpret.REPEATS) -> Result:
        m = self.model(name)
        frame = interpret.permutation_importance(m, repeats)
        ranked = sorted(((r["feature"], r["importance"]) for r in frame.collect()), key=lambda kv: (-kv[1], kv[0]))
        n = m.test.count()
        trust = combine(
            from_sample_size(m.n_rows, learn.MIN_TRAIN_ROWS, 200, "rows").note(*_TRAIN_NOTES),
            from_sample_size(n, 30, 100, "test rows"),
        ).note("Shows what the model leans on, not what causes the outcome.")
        return Result("permutation_importance", f"Top feature: {ranked[0][0]}" if ranked else "No features",
                      {"importances": dict(ranked)},
                      {"target": m.target, "task": m.task, "backend": m.algorithm, "n_repeats": repeats,
                       "n_rows_scored": n, "measure": "mean_score_decrease"}, trust, frame)

    def explain_prediction(self, name: str, row: dict[str, Any] | DataFrame, row_key: str | None = None) -> Result:
        """Shapley contributions of one row (a dict) or of every row of a keyed frame."""
        m = self.model(name)
        single = isinstance(row, dict)
        if single:
            missing = [c for c in m.roles.names if c not in row]
            if missing:
                raise ValueError(f"Feature columns are missing: {missing}")
            spark = self.df.sparkSession
            kinds = {f.name: f.dataType for f in m.data.schema.fields}
            rows = spark.range(1).select(
                F.col("id").alias("_one"), *[F.lit(row[c]).cast(kinds[c]).alias(c) for c in m.roles.names])
            row_key = "_one"
        else:
            rows = row
            if row_key is None:
                raise ValueError("Name the key column of the rows to explain.")
        frame = interpret.shapley(m, rows, row_key)
        values: dict[str, Any] = {}
        summary = "Contributions per row"
        meta = {"target": m.target, "task": m.task, "backend": m.algorithm, "scale": "log_odds" if m.task == "classification" else "value"}
        if single:
            got = frame.collect()
            # Of several classes, the one whose contributions are the largest in sum; the first of equals.
            sizes: dict[Any, float] = {}
            for r in got:
                sizes[r["class"]] = sizes.get(r["class"], 0.0) + abs(r["contribution"])
            shown = max(sizes, key=lambda c: sizes[c])
            got = [r for r in got if r["class"] == shown]
            ranked = sorted(((r["feature"], r["contribution"]) for r in got), key=lambda kv: (-abs(kv[1]), kv[0]))
            values = {"contributions": dict(ranked), "base_value": got[0]["base_value"], "prediction": got[0]["prediction"]}
            summary = f"Top driver: {ranked[0][0]}"
            if m.task == "classification":
                meta["explained_class"] = m.classes[shown]
        trust = Trust(TrustLevel.MODERATE, ("Explains these rows only; it is not a general rule.",), ("shapley",))
        return Result("shap", summary, values, meta, trust, frame)

    def explain_metric(self, target: str, max_depth: int = 3) -> Result:
        require(self.df, target)
        roles = self.feature_roles(exclude=[target])
        continuous = self.classify_column(target) == CONTINUOUS
        tree = interpret.MetricTree(self.df, target, roles, continuous, max_depth, self.key)
        n = self.count_non_null(target)["n_non_null"]
        fit = tree.fit_score()
        frame = tree.segments()
        trust = from_sample_size(n, 30, 200, "rows").note("Splits the number up; it does not say why it moved.")
        top = next(iter(tree.importances), None)
        return Result(
            "decision_tree_key_drivers", f"Top driver of {target!r}: {top!r}",
            {"drivers": tree.importances, "rules": [text for _, text in tree.rules()], "explained": fit,
             "explained_held_out": tree.held_out_score()},
            {"target": target, "task": "regression" if continuous else "classification", "max_depth": max_depth,
             "n_rows": n, "features": tree.features}, trust, frame,
        )

    # --- time -------------------------------------------------------------------------------

    def _points(self, time: str, value: str, series: str | None, tie: str | None) -> DataFrame:
        return ts.ordered(self.df, time, value, series, tie)

    def decompose(self, time: str, value: str, series: str | None = None, tie: str | None = None) -> Result:
        points = self._points(time, value, series, tie)
        sizes = ts.series_period(points)
        low = sizes.agg(F.min("n"), F.max("n"), F.count(F.lit(1)), F.min("period")).first()
        n, period = low[0] or 0, low[3]
        meta = {"time_column": time, "value_column": value, "model": "additive", "n_points": n, "n_series": low[2]}
        if (low[1] or 0) < ts.MIN_DECOMPOSE:
            return declined_result("seasonal_decompose", f"{n} points; at least {ts.MIN_DECOMPOSE} are needed.", meta)
        meta["period"] = min(period, n // 2) if n >= ts.MIN_DECOMPOSE else period
        trust = from_sample_size(n, 24, 60, "points").note("Assumes one steady seasonal pattern.")
        if n / max(1, meta["period"]) < 3:
            trust = trust.note("Fewer than three cycles of history: the seasonal part is thin.")
        return Result("seasonal_decompose", f"{value}: trend, seasonal and residual", {}, meta, trust, ts.decompose(points))

    def forecast(self, time: str, value: str, horizon: int = 10, series: str | None = None, tie: str | None = None) -> Result:
        points = self._points(time, value, series, tie)
        status = ts.forecast_status(points).agg(F.min("n"), F.max("n"), F.every("declined"), F.count(F.lit(1))).first()
        n = status[0] or 0
        notes = ("The further out, the wider the error.", "Assumes the past carries on.")
        meta = {"time_column": time, "value_column": value, "horizon": horizon, "n_points": n, "order": [1, 1, 1]}
        if status[2] is None or status[2]:
            return declined_result("arima", f"{status[1] or 0} points of history are too few to forecast.", meta, notes)
        trust = from_sample_size(n, 24, 60, "points")
        if horizon / max(n, 1) > 0.5:
            trust = trust.capped(TrustLevel.MODERATE).note("The horizon is long for this much history.")
        frame = ts.forecast(points, horizon)
        values: dict[str, Any] = {}
        if series is None:
            got = frame.orderBy("step").collect()
            values = {k: [r[k] for r in got] for k in ("forecast", "lower", "upper")}
        return Result("arima", f"{horizon} steps of {value}", values, meta, trust.note(*notes), frame)

    def detect_changepoints(self, time: str, value: str, penalty: float = 10.0, series: str | None = None,
                            tie: str | None = None) -> Result:
        points = self._points(time, value, series, tie)
        status = ts.changepoint_status(points).agg(F.min("n"), F.max("n"), F.every("declined")).first()
        n = status[0] or 0
        meta = {"time_column": time, "value_column": value, "penalty": penalty, "n_points": n}
        if status[2] is None or status[2]:
            return declined_result("pelt_rbf", f"{status[1] or 0} points; at least {ts.MIN_CHANGE} are needed.", meta)
        frame = ts.changepoints(points, penalty)
        trust = from_sample_size(n, 30, 100, "points").note("Says where the series shifts, not why.")
        values: dict[str, Any] = {}
        if series is None:
            got = frame.orderBy("segment").collect()
            values = {"changepoints": [r["start"].isoformat() for r in got[1:]],
                      "segments": [{k: json_safe(r[k]) for k in ("start", "end", "mean", "n")} for r in got]}
            if n < 30 and len(got) <= 2:
                trust = trust.note("One shift in a short series can be chance.")
        return Result("pelt_rbf", f"change points of {value}", values, meta, trust, frame)

    def compare_periods(self, time: str, value: str, split: str | None = None) -> Result:
        require(self.df, time, value)
        if split is None:
            cut = ts.median_time(self.df, time, value)
            if cut is None:
                raise ValueError("No row has both the time and the value.")
        else:
            spark = self.df.sparkSession
            cut = spark.range(1).select(F.lit(split).cast("timestamp_ntz").alias("t"))
            cut = float(cut.select(micros(cut, "t")).first()[0])
        row = ts.compare_windows(self.df, time, value, cut).first().asDict()
        when = self.df.sparkSession.range(1).select(ts.as_time(F.lit(int(cut)))).first()[0].isoformat()
        meta = {"time_column": time, "value_column": value, "split": when,
                "n_before": row["n_before"], "n_after": row["n_after"]}
        n1, n2 = row["n_before"], row["n_after"]
        if min(n1, n2) < 2:
            return declined_result("two_window_comparison", f"{n1} points before and {n2} after; each side needs two.", meta)
        mw = tails.mann_whitney_p(row["u"], n1, n2, row["tie_term"])
        values = {k: row[k] for k in ("mean_before", "mean_after", "delta", "pct_change", "cohens_d")}
        values |= {"mannwhitney_p": mw, "ks_p": tails.ks_two_sample_p(row["d"], n1, n2)}
        trust = from_sample_size(min(n1, n2), 30, 200, "points per window")
        if mw >= 0.05:
            trust = trust.note(f"Not significant (p={mw:.3g}); it may be chance.")
        trust = trust.note("Before against after is not a causal test.")
        return Result("two_window_comparison", f"{value} changed by {row['delta']:.4g} (p={mw:.3g})", values, meta, trust)

    # --- customers, baskets, causes -------------------------------------------------------------

    def rfm(self, customer: str, date: str, money: str) -> Result:
        frame = customers.rfm(self.df, customer, date, money)
        got = customers.rfm_segments(frame).collect()
        n = sum(r["customers"] for r in got)
        meta = {"customer_column": customer, "date_column": date, "monetary_column": money, "n_customers": n}
        if n == 0:
            raise ValueError("No row has customer, date and money.")
        note = "Segments are relative to this table, not fixed limits."
        if n < customers.MIN_CUSTOMERS:
            return declined_result("rfm_quintile_segmentation", f"{n} customers are too few for fifths.", meta, (note,))
        trust = from_sample_size(n, 30, 100, "customers").note(note, "Limits move as data grows.")
        return Result("rfm_quintile_segmentation", f"{n} customers in {len(got)} segments",
                      {"segments": {r["segment"]: r["customers"] for r in got},
                       "segment_value": {r["segment"]: r["value"] for r in got}}, meta, trust, frame)

    def retention_cohorts(self, customer: str, date: str) -> Result:
        frame = customers.retention(self.df, customer, date)
        got = frame.orderBy("cohort", "months_since").collect()  # months × months
        if not got:
            raise ValueError("No row has both customer and date.")
        cohorts: dict[str, dict[int, int]] = {}
        rates: dict[str, dict[int, float]] = {}
        for r in got:
            cohorts.setdefault(r["cohort"], {})[r["months_since"]] = r["customers"]
            rates.setdefault(r["cohort"], {})[r["months_since"]] = r["rate"]
        n = sum(c[0] for c in cohorts.values())
        meta = {"customer_column": customer, "date_column": date, "n_customers": n, "n_cohorts": len(cohorts)}
        if all(set(c) == {0} for c in cohorts.values()):
            return declined_result("monthly_retention_cohorts", "nobody returns after the first month.", meta)
        trust = from_sample_size(n, 30, 100, "customers").note("Small cohorts swing widely.")
        return Result("monthly_retention_cohorts", f"{len(cohorts)} cohorts",
                      {"cohorts": cohorts, "retention_rates": rates}, meta, trust, frame)

    def market_basket(self, transaction: str, item: str, min_support: float = 0.01, min_confidence: float = 0.2,
                      max_rules: int = 50) -> Result:
        rows = basket.item_rows(self.df, transaction, item)
        n = basket.count_transactions(rows)
        meta = {"transaction_column": transaction, "item_column": item, "n_transactions": n,
                "min_support": min_support, "min_confidence": min_confidence}
        if n == 0:
            raise ValueError("There is no basket with an item.")
        sets = basket.itemsets(rows, n, min_support)
        if sets.isEmpty():
            return declined_result("association_rules", f"no itemset reaches support {min_support}.", meta)
        frame = basket.top_rules(basket.rules(sets, min_confidence), max_rules)
        found = [r.asDict() for r in frame.collect()]
        trust = from_sample_size(n, 100, 500, "transactions").note(
            "Bought together does not mean bought because.", "Rare sets give unstable lift.")
        return Result("association_rules", f"{len(found)} rules", {"rules": found}, {**meta, "n_rules": len(found)}, trust, frame)

    def causal_effect(self, treatment: str, outcome: str, confounders: Sequence[str] | None = None) -> Result:
        require(self.df, treatment, outcome)
        if confounders is None:
            roles = self.feature_roles(exclude=[treatment, outcome])
            numbers, coded = list(roles.numeric), list(roles.nominal + roles.ordinal)
        else:
            require(self.df, *confounders)
            numbers = [c for c in confounders if isinstance(field_type(self.df, c), NUMERIC)]
            coded = [c for c in confounders if c not in numbers]
        found = causal.causal_effect(self.df, treatment, outcome, numbers, coded)
        meta = {"treatment": treatment, "outcome": outcome, "confounders": numbers + coded, "n_rows": found.n,
                "estimand": "backdoor"}
        if found.n == 0:
            raise ValueError("No row is complete across treatment, outcome and confounders.")
        if found.n < causal.MIN_ROWS:
            return declined_result("causal_effect", f"{found.n} complete rows; {causal.MIN_ROWS} are needed.", meta, _CAUSAL_NOTES)
        if found.treatment_values < 2:
            return declined_result("causal_effect", f"{treatment!r} never varies.", meta, _CAUSAL_NOTES)
        check = {"method": "random_common_cause", "new_effect": found.new_effect, "passed": found.passed}
        if not found.passed:
            meta["effect_withheld"] = found.effect
            return declined_result("causal_effect", "adding an unrelated random cause moved the estimate.", meta,
                                   _CAUSAL_NOTES, {"refutation": check})
        level = TrustLevel.MODERATE if found.n >= causal.MODERATE_ROWS else TrustLevel.LOW
        trust = Trust(level, _CAUSAL_NOTES, (f"n={found.n}", "refutation_passed=True"))
        return Result("backdoor_linear_regression", f"Effect of {treatment} on {outcome}: {found.effect:.4g}",
                      {"effect": found.effect, "refutation": check}, meta, trust)


def strength(r: float) -> str:
    # Words for the size of a correlation.
    for limit, word in ((0.1, "negligible"), (0.3, "weak"), (0.5, "moderate"), (0.7, "strong")):
        if r < limit:
            return word
    return "very strong"
