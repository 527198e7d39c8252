"""From table columns to a model matrix: impute, scale, encode; levels are tables that are joined, however many."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import field_type, finite, quoted
from ..functions.joins import lookup
from ..functions.ordering import with_cell
from ..functions.stages import settle
from .describe import medians
from .typing import CATEGORICAL, CONTINUOUS, NOMINAL, ORDINAL, distinct_values

OWN = "_plumbline_"  # what working columns begin with; input columns may not
FEATURES = OWN + "features"


@dataclass(frozen=True)
class Roles:
    numeric: tuple[str, ...] = ()
    nominal: tuple[str, ...] = ()
    ordinal: tuple[str, ...] = ()

    @property
    def names(self) -> tuple[str, ...]:
        return self.numeric + self.nominal + self.ordinal


def feature_roles(types: Mapping[str, str], exclude: Iterable[str] = ()) -> Roles:
    """Columns that may feed a model; identifiers and dates are left out, unrefined ones refused."""
    left_out = set(exclude)
    kinds = {c: k for c, k in types.items() if c not in left_out}
    open_ones = [c for c, k in kinds.items() if k == CATEGORICAL]
    if open_ones:
        raise ValueError(f"Set these categorical columns to nominal or ordinal first: {open_ones}")
    return Roles(*(tuple(c for c, k in kinds.items() if k == kind) for kind in (CONTINUOUS, NOMINAL, ORDINAL)))


@dataclass
class Plan:
    """What the encoder learned: fill values and scales, and per coded column a table of its levels."""

    roles: Roles
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    #: ``level``, ``slot`` (its place in sorted order, from 0), ``n`` (rows); one row per level, written out.
    levels: dict[str, DataFrame] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, mode, n_levels)``: most frequent value as text, smallest on ties."""
    found = distinct_values(df, columns)
    return found.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
        F.count(F.lit(1)).alias("n_levels"),
    )


def level_table(df: DataFrame, column: str, as_text: bool) -> DataFrame:
    """``level``, ``slot``, ``n`` of a column's distinct values, numbered in their order without gathering them.

    Levels are cut into ranges of their own order; a range's first number follows from the sizes of those before it.
    """
    value = F.col(quoted(column)).cast("string") if as_text else F.col(quoted(column))
    found = settle(df.where(F.col(quoted(column)).isNotNull()).groupBy(value.alias("level")).agg(F.count(F.lit(1)).alias("n")))
    placed = with_cell(found, "level")
    before = Window.partitionBy(F.lit(0)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_size")).select(  # one row per range
        F.col("_cell").alias("_at"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy("level"))
    return settle(placed.withColumn("_turn", inside).join(starts, F.col("_cell") == F.col("_at")).select(
        "level", (F.col("_start") + F.col("_turn") - 1).cast("int").alias("slot"), "n"))


def learn(df: DataFrame, roles: Roles, scale: bool) -> Plan:
    plan = Plan(roles)
    if roles.numeric:
        found = {r["column"]: r["median"] for r in medians(df, roles.numeric).collect()}
        plan.medians = {c: found.get(c) or 0.0 for c in roles.numeric}
    coded = roles.nominal + roles.ordinal
    if coded:
        for r in modes(df, coded).collect():
            plan.modes[r["column"]], plan.sizes[r["column"]] = r["mode"], r["n_levels"]
    for c in coded:
        plan.levels[c] = level_table(df, c, c in roles.nominal)
    if scale and (roles.numeric or roles.ordinal):
        names = roles.numeric + roles.ordinal
        sized = encode(df, Plan(Roles(roles.numeric, (), roles.ordinal), plan.medians, plan.modes, plan.levels, plan.sizes))
        row = sized.agg(
            *[F.avg(f"{OWN}x{i}").alias(f"m{i}") for i in range(len(names))],
            *[F.stddev_pop(f"{OWN}x{i}").alias(f"s{i}") for i in range(len(names))],
        ).first()
        plan.means = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(names)}
        plan.scales = {c: row[f"s{i}"] or 1.0 for i, c in enumerate(names)}
    return plan


def _number(df: DataFrame, plan: Plan, column: str) -> Column:
    value = F.expr(f"try_cast({quoted(column)} AS DOUBLE)")
    return F.coalesce(finite(value), F.lit(plan.medians[column]))


def _with_slot(df: DataFrame, plan: Plan, column: str, as_text: bool, out: str) -> DataFrame:
    """Add the place of a column's level; a missing value counts as the most frequent one, an unseen one has none."""
    kind = "string" if as_text else field_type(df, column)
    value = F.col(quoted(column)).cast(kind)
    if column in plan.modes:
        value = F.coalesce(value, F.lit(plan.modes[column]).cast(kind))
    keyed = df.withColumn(OWN + "key", value)
    size = plan.sizes.get(column, 0)
    return lookup(keyed, OWN + "key", plan.levels[column], "level", "n", {"slot": out}, settled=True, size=size).drop(OWN + "key")


def encode(df: DataFrame, plan: Plan) -> DataFrame:
    """Add ``_plumbline_x…`` (numbers and places of ordinals, scaled if the plan has scales) and ``_plumbline_i…`` (slots).

    Levels come by joins with their tables. An unseen ordinal is -1, an unseen nominal the slot behind the last level.
    """
    ordered = plan.roles.numeric + plan.roles.ordinal
    for i, c in enumerate(ordered):
        if c in plan.roles.numeric:
            df = df.withColumn(f"{OWN}x{i}", _number(df, plan, c))
        else:
            df = _with_slot(df, plan, c, False, f"{OWN}x{i}")
    for i, c in enumerate(plan.roles.nominal):
        df = _with_slot(df, plan, c, True, f"{OWN}i{i}")
    made = {f"{OWN}x{i}": F.coalesce(F.col(f"{OWN}x{i}").cast("double"), F.lit(-1.0)) for i in range(len(ordered))}
    if plan.scales:
        made = {f"{OWN}x{i}": (made[f"{OWN}x{i}"] - plan.means[c]) / plan.scales[c] for i, c in enumerate(ordered)}
    made |= {f"{OWN}i{i}": F.coalesce(F.col(f"{OWN}i{i}").cast("double"), F.lit(float(plan.sizes.get(c, 0))))
             for i, c in enumerate(plan.roles.nominal)}
    return df.withColumns(made)


def encoded_names(plan: Plan) -> list[str]:
    n, k = len(plan.roles.numeric + plan.roles.ordinal), len(plan.roles.nominal)
    return [f"{OWN}x{i}" for i in range(n)] + [f"{OWN}i{i}" for i in range(k)]


def assemble(encoded: DataFrame, plan: Plan) -> DataFrame:
    """Add the ``features`` vector: numbers, then a sparse 0/1 entry for each level; unseen levels are all zeros.

    The number of slots is handed on as column metadata, so that no pass and no list of levels is needed for it.
    """
    ordered = plan.roles.numeric + plan.roles.ordinal
    inputs = [f"{OWN}x{i}" for i in range(len(ordered))]
    spread = [i for i, c in enumerate(plan.roles.nominal) if plan.sizes.get(c, 0)]
    if spread:
        sized = {
            f"{OWN}i{i}": F.col(f"{OWN}i{i}").alias(
                f"{OWN}i{i}", metadata={"ml_attr": {"type": "nominal", "num_vals": plan.sizes[plan.roles.nominal[i]] + 1}})
            for i in spread
        }
        encoded = encoded.select(*[sized.get(c, F.col(quoted(c))) for c in encoded.columns])
        # The slot kept for unseen levels is the one the encoder drops.
        names = [f"{OWN}i{i}" for i in spread], [f"{OWN}h{i}" for i in spread]
        encoded = OneHotEncoder(inputCols=names[0], outputCols=names[1], dropLast=True).fit(encoded).transform(encoded)
        inputs += names[1]
    return VectorAssembler(inputCols=inputs, outputCol=FEATURES).transform(encoded)


def matrix(df: DataFrame, roles: Roles, scale: bool = True) -> tuple[DataFrame, Plan]:
    """``(df with features, plan)`` for distance-based methods."""
    if not roles.names:
        raise ValueError("There is no usable feature column.")
    plan = learn(df, roles, scale)
    return assemble(encode(df, plan), plan), plan


def working_columns(plan: Plan) -> list[str]:
    return [*encoded_names(plan), *[f"{OWN}h{i}" for i in range(len(plan.roles.nominal))], FEATURES]


def scaled_columns(df: DataFrame, roles: Roles) -> DataFrame:
    """``<c>_scaled`` for numeric and ordinal columns: the matrix, readable."""
    plan = learn(df, roles, scale=True)
    ordered = roles.numeric + roles.ordinal
    out = encode(df, Plan(Roles(roles.numeric, (), roles.ordinal), plan.medians, plan.modes, plan.levels, plan.sizes, plan.means, plan.scales))
    return out.withColumns({f"{c}_scaled": F.col(f"{OWN}x{i}") for i, c in enumerate(ordered)}).drop(
        *[f"{OWN}x{i}" for i in range(len(ordered))])


def one_hot_columns(df: DataFrame, column: str) -> DataFrame:
    """``<c>_<level>`` 0/1 columns of a nominal column, one per level; missing counts as the most frequent level.

    For reading: a column for each level is what is asked for. Models take the sparse ``features`` instead.
    """
    plan = learn(df, Roles(nominal=(column,)), scale=False)
    rows = plan.levels[column].orderBy("slot").select("level").collect()
    value = F.coalesce(F.col(quoted(column)).cast("string"), F.lit(plan.modes.get(column)))
    return df.withColumns({f"{column}_{r['level']}": (value == r["level"]).cast("int") for r in rows})
