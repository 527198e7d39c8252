"""Time series: seasonal decomposition, forecasts, change points, before/after comparison.

Every row is one step of its series, in time order (ties by a tie-break column). Long
series are cut into blocks of bounded length with a few rows of overlap, so the size of
one series never decides the size of a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arima
from ..functions.clean import micros, numeric, quoted, require
from ..functions.joins import lookup
from ..functions.ordering import quantiles, series_positions
from ..functions.pelt import JUMP, MIN_SIZE, best_intervals, best_split, change_points, scale_of, weighted_median_square_gap
from ..functions.stages import settle
from .associate import two_samples

# Seasonal periods tried in order, forecast confidence, shortest history to forecast.
PERIODS = (12, 7, 4)
Z95 = 1.959963984540054
MIN_FORECAST = 12
MIN_DECOMPOSE = 4
MIN_CHANGE = 4
BLOCK = 20_000
MERGE = 64
#: Points of a block that proposes changes, intervals decided together, bins of their histograms.
CHANGE_BLOCK, CHANGE_CHUNK, CHANGE_BINS = 20_000, 256, 512
_REACH = 8  # how many grid places off a proposal may be


def bucketed(df: DataFrame, time: str, value: str, unit: str, agg: str = "sum", series: str | None = None) -> DataFrame:
    """One row per calendar unit (``day``, ``month`` …), an extension for event-level tables."""
    made = {"sum": F.sum, "mean": F.avg, "count": F.count, "max": F.max, "min": F.min}[agg]
    keys = [F.date_trunc(unit, F.col(quoted(time))).cast("timestamp_ntz").alias(time)]
    if series:
        keys.append(F.col(quoted(series)))
    return df.groupBy(*keys).agg(made(numeric(df, value)).cast("double").alias(value))


def as_time(t: Column) -> Column:
    """Microseconds since 1970 back to a zone-free timestamp."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", t, origin)


def infer_period(n: Column) -> Column:
    rule = F.when(n >= 2 * PERIODS[0], PERIODS[0])
    for p in PERIODS[1:]:
        rule = rule.when(n >= 2 * p, p)
    return rule.otherwise(F.greatest(F.lit(2), F.floor(n / 2))).cast("int")


def ordered(df: DataFrame, time: str, value: str, series: str | None = None, tie: str | None = None) -> DataFrame:
    """``(series, t, v, pos, n)`` with 0-based positions; rows missing time or value are left out."""
    require(df, time, value)
    rows = df.select(
        (F.col(quoted(series)) if series else F.lit(0)).alias("series"),
        micros(df, time).alias("t"),
        numeric(df, value).alias("v"),
        *([F.col(quoted(tie)).alias("tie")] if tie else []),
    ).dropna(subset=["t", "v"])
    placed = series_positions(rows, ["series"], "t", "tie" if tie else "v")
    return placed.select(
        "series", "t", "v", (F.col("position") - 1).alias("pos"), F.col("n_positions").alias("n")
    )


def series_period(points: DataFrame) -> DataFrame:
    """``(series, n, period)``."""
    return points.groupBy("series").agg(F.max("n").alias("n")).withColumn("period", infer_period(F.col("n")))


def with_overlap(points: DataFrame, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Add ``block``; rows near a block's edge are also given to the neighbour that looks at them."""
    own = F.floor(F.col("pos") / block)
    inside = F.col("pos") % block
    homes = F.array(
        own,
        F.when((inside < after) & (own > 0), own - 1),
        F.when(inside >= block - before, own + 1),
    )
    return points.withColumn("block", F.explode(F.filter(homes, lambda b: b.isNotNull())))


def moving_average(points: DataFrame, period: int, block: int = BLOCK) -> DataFrame:
    """Add ``trend``: the centred moving average, NULL within half a period of the ends."""
    half = period // 2
    w = Window.partitionBy("series", "block").orderBy("pos")
    total = F.sum("v").over(w.rowsBetween(-half, half))
    if period % 2 == 0:
        total = total - 0.5 * (F.lag("v", half).over(w) + F.lead("v", half).over(w))
    inner = (F.col("pos") >= half) & (F.col("pos") < F.col("n") - half)
    return (
        with_overlap(points, half, half, block)
        .withColumn("trend", F.when(inner, total / period))
        .where(F.col("block") == F.floor(F.col("pos") / block))
        .drop("block")
    )


def _end_fit(inside: Column, name: str) -> list[Column]:
    y, x = F.when(inside, F.col("trend")), F.when(inside, F.col("pos").cast("double"))
    return [
        F.regr_slope(y, x).alias(f"{name}_slope"),
        F.regr_intercept(y, x).alias(f"{name}_start"),
        F.count(y).alias(f"{name}_n"),
        F.max(y).alias(f"{name}_y"),
        F.max(x).alias(f"{name}_x"),
    ]


def _end_line(name: str) -> Column:
    """The fitted line at ``pos``; a single point gives the shortest coefficient vector through it."""
    x, y = F.col(f"fit.{name}_x"), F.col(f"fit.{name}_y")
    single = y * (x * F.col("pos") + 1) / (x * x + 1)
    line = F.col(f"fit.{name}_slope") * F.col("pos") + F.col(f"fit.{name}_start")
    return F.when(F.col(f"fit.{name}_n") == 1, single).otherwise(line)


def decompose(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(series, t, pos, period, v, trend, seasonal, resid)``, additive.

    The trend's ends continue the straight line through the nearest ``period`` averaged
    points; series of fewer than four points are left out.
    """
    sized = points.where(F.col("n") >= MIN_DECOMPOSE).withColumn(
        "period", F.least(infer_period(F.col("n")), F.floor(F.col("n") / 2).cast("int"))
    )
    sized = settle(sized)
    found = [r["period"] for r in sized.select("period").distinct().collect()]  # at most five values
    parts = [moving_average(sized.where(F.col("period") == p), p, block) for p in sorted(found)]
    averaged = parts[0] if parts else sized.withColumn("trend", F.lit(None).cast("double"))
    for part in parts[1:]:
        averaged = averaged.unionByName(part)
    averaged = settle(averaged)
    front = F.floor(F.col("period") / 2)
    back = F.col("n") - 1 - front
    head = (F.col("pos") >= front) & (F.col("pos") < F.least(front + F.col("period"), back))
    tail = (F.col("pos") >= F.greatest(front, back - F.col("period"))) & (F.col("pos") < back)
    fits = averaged.groupBy("series").agg(F.max("n").alias("rows"), *_end_fit(head, "head"), *_end_fit(tail, "tail"))
    packed = fits.select("series", "rows", F.struct(*[c for c in fits.columns if c not in ("series", "rows")]).alias("fit"))
    ended = lookup(averaged, "series", packed, "series", "rows", {"fit": "fit"}).withColumn(
        "trend",
        F.when(F.col("pos") < front, _end_line("head")).when(F.col("pos") > back, _end_line("tail")).otherwise(F.col("trend")),
    )
    phase = (F.col("pos") % F.col("period")).cast("int")
    means = ended.groupBy("series", phase.alias("phase")).agg(
        F.avg(F.col("v") - F.col("trend")).alias("m"), F.count(F.lit(1)).alias("c")
    )
    seasons = means.groupBy("series").agg(
        F.array_sort(F.collect_list(F.struct("phase", "m"))).alias("s"), F.avg("m").alias("centre"), F.sum("c").alias("rows")
    ).select("series", "rows", F.transform("s", lambda x: x["m"] - F.col("centre")).alias("season"))
    full = lookup(ended, "series", seasons, "series", "rows", {"season": "season"})
    seasonal = F.get("season", phase)
    return full.select(
        "series", "t", "pos", "period", "v", "trend", seasonal.alias("seasonal"),
        (F.col("v") - F.col("trend") - seasonal).alias("resid"),
    )


# --- forecast -----------------------------------------------------------------------------


def forecast_status(points: DataFrame) -> DataFrame:
    """``(series, n, period, declined)``: history under 12 points or under two cycles is not forecast."""
    sized = series_period(points)
    return sized.withColumn("declined", (F.col("n") < MIN_FORECAST) | (F.col("n") < 2 * F.col("period")))


_FORECAST_SCHEMA = "step int, forecast double, lower double, upper double, phi double, theta double, sigma2 double"


def _rows_ahead(last, last_w, last_e, phi, theta, sigma2, m, horizon) -> pd.DataFrame:
    mean, se = arima.project(last, last_w, last_e, phi, theta, sigma2, m, horizon)
    return pd.DataFrame(
        {
            "step": np.arange(1, horizon + 1, dtype="int32"), "forecast": mean, "lower": mean - Z95 * se,
            "upper": mean + Z95 * se, "phi": phi, "theta": theta, "sigma2": sigma2,
        }
    )


def _short_series(horizon: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("pos")["v"].to_numpy()
        w = np.diff(y)
        phi, theta, sigma2, e = arima.fit_one_block(w)
        return _rows_ahead(y[-1], w[-1], e, phi, theta, sigma2, len(w), horizon).assign(series=key[0])

    return run


def forecast(points: DataFrame, horizon: int = 10, block: int = BLOCK) -> DataFrame:
    """``(series, step, forecast, lower, upper, phi, theta, sigma2)``: ARIMA(1,1,1) by exact likelihood.

    A series of one block is fitted in one task; a longer one is searched in rounds, each
    a job over its blocks that returns five sums per candidate.
    """
    usable = points.where((F.col("n") >= MIN_FORECAST) & (F.col("n") >= 2 * infer_period(F.col("n"))))
    usable = settle(usable)
    short = usable.where(F.col("n") <= block).groupBy("series").applyInPandas(
        _short_series(horizon), f"series {_series_type(points)}, {_FORECAST_SCHEMA}"
    )
    long_points = usable.where(F.col("n") > block)
    if long_points.isEmpty():
        return short
    return short.unionByName(_long_forecast(long_points, horizon, block))


def _series_type(points: DataFrame) -> str:
    return points.schema["series"].dataType.simpleString()


def _grid(pdf: pd.DataFrame, width: float | None) -> np.ndarray:
    if width is None:
        return arima.first_grid()
    return arima.zoom(np.array([pdf["phi"].iloc[0], pdf["theta"].iloc[0]]), width)


def _summarize_block(width: float | None, block: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        y, pos = pdf["v"].to_numpy(), pdf["pos"].to_numpy()
        w = np.diff(y)
        own = pos[1:] >= key[1] * block
        before = w[~own][-1] if (~own).any() else 0.0
        sums = arima.summarize(w[own], before, int(pos[1:][own][0]) - 1, _grid(pdf, width))
        return pd.DataFrame({
            "series": [key[0]], "block": [key[1]], "n_w": [int(own.sum())], "last_v": [y[-1]],
            "last_w": [w[-1]], "sums": [sums.ravel().tolist()],
        })

    return run


def _choose(width: float | None):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        grid = _grid(pdf, width)
        total, logs, e = arima.fold([np.array(s).reshape(-1, 6) for s in pdf["sums"]])
        m = int(pdf["n_w"].sum())
        best = arima.pick(total, logs, m)
        return pd.DataFrame({
            "series": [key[0]], "phi": [grid[best, 0]], "theta": [grid[best, 1]], "sigma2": [total[best] / m],
            "last_e": [e[best]], "last_v": [pdf["last_v"].iloc[-1]], "last_w": [pdf["last_w"].iloc[-1]], "m": [m],
        })

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring block summaries as one."""
    pdf = pdf.sort_values("block")
    sums = arima.compose([np.array(s).reshape(-1, 6) for s in pdf["sums"]])
    last = pdf.iloc[-1]
    return pd.DataFrame({
        "series": [last["series"]], "block": [int(pdf["block"].iloc[0]) // MERGE], "n_w": [int(pdf["n_w"].sum())],
        "last_v": [last["last_v"]], "last_w": [last["last_w"]], "sums": [sums.ravel().tolist()],
    })


def _ahead(horizon: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        made = _rows_ahead(
            r["last_v"], r["last_w"], r["last_e"], r["phi"], r["theta"], r["sigma2"], int(r["m"]), horizon)
        return made.assign(series=key[0])

    return run


def _long_forecast(points: DataFrame, horizon: int, block: int) -> DataFrame:
    kind = _series_type(points)
    blocks = settle(with_overlap(points, 2, 0, block))
    schema = f"series {kind}, block long, n_w long, last_v double, last_w double, sums array<double>"
    n_blocks = blocks.agg(F.max("block")).first()[0] + 1
    best: DataFrame | None = None
    for width in [None, *arima.widths()]:
        known = blocks
        if best is not None:
            known = lookup(blocks, "series", best, "series", "m", {"phi": "phi", "theta": "theta"})
        sums = known.groupBy("series", "block").applyInPandas(
            _summarize_block(width, block), schema
        )
        left = n_blocks
        while left > MERGE:  # never more than MERGE summaries in one task
            sums = sums.groupBy("series", F.floor(F.col("block") / MERGE)).applyInPandas(_merge, schema)
            left = -(-left // MERGE)
        if best is not None:
            sums = sums.join(best.select("series", "phi", "theta"), "series")
        best = settle(
            sums.groupBy("series").applyInPandas(
                _choose(width),
                f"series {kind}, phi double, theta double, sigma2 double, last_e double, last_v double, last_w double, m long",
            )
        )
    return best.groupBy("series").applyInPandas(_ahead(horizon), f"series {kind}, {_FORECAST_SCHEMA}")


# --- change points ------------------------------------------------------------------------


def changepoints(points: DataFrame, penalty: float = 10.0, block: int = CHANGE_BLOCK, chunk: int = CHANGE_CHUNK) -> DataFrame:
    """``(series, segment, start, end, mean, n)`` of every series of 4 points or more.

    The kernel cost compares all points of a stretch. At every length it is the cost of the points' bins: at most
    ``CHANGE_BINS``, cut at quantiles of the series (so up to that many different values are compared as they are), each
    standing at its mean. Histograms of bins add up, so the same cost can be had for any stretch of any series.

    A series within one block is searched whole. For longer ones overlapping blocks propose changes, and stretches of a
    grid, and of coarser grids until one task sees the whole series, propose those too weak for a block. Proposals are
    decided together, then each moves to its best place between its neighbours, on ever finer grids down to the spacing
    of the search; what no longer pays goes. No task sees more than a block of points or a chunk of intervals.
    """
    kind = _series_type(points)
    usable = settle(points.where(F.col("n") >= MIN_CHANGE))
    found = _short_changes(usable.where(F.col("n") <= block), penalty)
    long_points = usable.where(F.col("n") > block)
    if not long_points.isEmpty():
        found = found.unionByName(_long_changes(long_points.where(F.col("series").isNotNull()), penalty, block, chunk))
        unnamed = long_points.where(F.col("series").isNull())
        if not unnamed.isEmpty():  # joins would lose a null key
            one = _long_changes(unnamed.withColumn("series", F.lit(0)), penalty, block, chunk)
            found = found.unionByName(one.withColumn("series", F.lit(None).cast(kind)))
    return found.withColumns({c: as_time(F.col(c)) for c in ("start", "end")})


def _same(key: tuple, n: int) -> pd.Series:
    return pd.Series([key[0]] * n, dtype=object)


def _with_bin(points: DataFrame) -> DataFrame:
    """Add ``bin``: the number of the series' cuts at or below the value, by bisection."""
    at = F.percentile_approx("v", [k / CHANGE_BINS for k in range(1, CHANGE_BINS)], 20 * CHANGE_BINS)
    spans = points.groupBy(F.col("series").alias("_series")).agg(F.array_sort(F.array_distinct(at)).alias("cuts"))
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(CHANGE_BINS.bit_length()))])
    below = F.aggregate(halves, F.lit(0), lambda found, half: F.when(
        F.coalesce(F.get("cuts", found + half - 1) <= F.col("v"), F.lit(False)), found + half).otherwise(found))
    return points.join(spans, F.col("series").eqNullSafe(F.col("_series"))).withColumn("bin", below.cast("int")).drop("cuts", "_series")


def _short_changes(points: DataFrame, penalty: float) -> DataFrame:
    """Series within one block, each searched whole by one task: the bins' means and the scale are had on the spot."""
    kind = _series_type(points)

    def segments(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        v, t = pdf["v"].to_numpy(), pdf["t"].to_numpy()
        _, bins, counts = np.unique(pdf["bin"].to_numpy(), return_inverse=True, return_counts=True)
        centres = np.bincount(bins, v) / counts
        gamma = scale_of(weighted_median_square_gap(centres, counts))
        edges = [0, *change_points(centres[bins], penalty, gamma), len(v)]
        return pd.DataFrame(
            [(key[0], i, int(t[a]), int(t[b - 1]), float(v[a:b].mean()), b - a) for i, (a, b) in enumerate(zip(edges, edges[1:]))],
            columns=["series", "segment", "start", "end", "mean", "n"],
        )

    return _with_bin(points).groupBy("series").applyInPandas(
        segments, f"series {kind}, segment int, start long, end long, mean double, n long")


def _binned(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with ``bin`` and its mean ``x``, and per series the kernel's scale with its bins and their means."""
    kind = _series_type(points)
    marked = settle(_with_bin(points))
    bins = settle(marked.groupBy("series", "bin").agg(F.avg("v").alias("x"), F.count(F.lit(1)).alias("c")))

    def scales(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        gamma = scale_of(weighted_median_square_gap(pdf["x"].to_numpy(), pdf["c"].to_numpy()))
        return pd.DataFrame({"series": _same(key, 1), "gamma": [gamma], "bins": [pdf["bin"].tolist()], "centres": [pdf["x"].tolist()]})

    scale = settle(bins.groupBy("series").applyInPandas(  # at most CHANGE_BINS rows each
        scales, f"series {kind}, gamma double, bins array<int>, centres array<double>"))
    ready = marked.join(bins.drop("c"), ["series", "bin"]).join(scale.select("series", "gamma"), "series")
    return settle(ready.select("series", "t", "pos", "n", "v", "bin", "x", "gamma")), scale


def _long_changes(points: DataFrame, penalty: float, block: int, chunk: int) -> DataFrame:
    binned, scale = _binned(points)
    step = max(JUMP, block * 3 // 4 // JUMP * JUMP)
    kind = _series_type(points)

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        cuts = change_points(pdf["x"].to_numpy(), penalty, float(pdf["gamma"].iloc[0])) if len(pdf) >= MIN_CHANGE else []
        return pd.DataFrame({"series": _same(key, len(cuts)), "pos": pdf["pos"].to_numpy()[cuts]})

    first = F.greatest(F.lit(0), F.floor((F.col("pos") - block) / step) + 1)
    cells = F.sequence(first.cast("long"), F.floor(F.col("pos") / step).cast("long"))
    proposed = settle(binned.withColumn("cell", F.explode(cells)).groupBy("series", "cell").applyInPandas(
        search, f"series {kind}, pos long").distinct())
    longest = binned.agg(F.max("n")).first()[0] or 0
    kept = _placed(binned, scale, _coarse(binned, scale, proposed, longest, penalty, block, chunk), penalty, chunk, step)
    segments = _numbered(binned, kept, step).groupBy("series", F.col("interval").cast("int").alias("segment")).agg(
        F.min(F.struct("pos", "t")).alias("first"), F.max(F.struct("pos", "t")).alias("last"), F.avg("v").alias("mean"),
        F.count(F.lit(1)).alias("n"))
    return segments.select("series", "segment", F.col("first.t").alias("start"), F.col("last.t").alias("end"), "mean", "n")


def _numbered(points: DataFrame, marks: DataFrame, step: int) -> DataFrame:
    """Add ``interval``: how many marks (series, pos) lie at or before a point, in its cell and in the cells before."""
    cell = F.floor(F.col("pos") / step)
    marked = points.join(marks.select("series", "pos", F.lit(1).alias("mark")), ["series", "pos"], "left").withColumn("cell", cell)
    inside = Window.partitionBy("series", "cell").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("series").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row per cell
    counts = marks.groupBy("series", cell.alias("cell")).agg(F.count(F.lit(1)).alias("m"))
    every = points.select("series", cell.alias("cell")).distinct()
    ahead = every.join(counts, ["series", "cell"], "left").select(
        "series", "cell", F.coalesce(F.sum(F.coalesce("m", F.lit(0))).over(before), F.lit(0)).alias("ahead"))
    own = F.sum(F.coalesce("mark", F.lit(0))).over(inside)
    return marked.withColumn("own", own).join(ahead, ["series", "cell"]).withColumn("interval", F.col("own") + F.col("ahead"))


def _tabled(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Interval numbers, their histograms, the bins' means and the kernel's scale from rows of one series."""
    numbers = np.sort(pdf["interval"].unique())
    where = {b: i for i, b in enumerate(pdf["bins"].iloc[0])}
    table = np.zeros((len(numbers), len(where)))
    np.add.at(table, (np.searchsorted(numbers, pdf["interval"]), pdf["bin"].map(where).to_numpy()), pdf["c"].to_numpy())
    return numbers, table, np.array(pdf["centres"].iloc[0]), float(pdf["gamma"].iloc[0])


def _decided(pieces: DataFrame, scale: DataFrame, by: list[str], penalty: float, chunk: int) -> DataFrame:
    """Intervals that start a segment: ``pieces`` (``by``, interval, bin, c) are weighed in overlapping chunks."""
    margin = chunk // 4
    part = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("interval") - margin) / chunk)).cast("long"),
                                F.floor((F.col("interval") + margin) / chunk).cast("long")))

    def decide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        numbers, table, centres, gamma = _tabled(pdf)
        starts = best_intervals(table, centres, gamma, penalty)
        kept = [int(numbers[i]) for i in starts if numbers[i] // chunk == key[-1]]
        return pd.DataFrame({**{c: pd.Series([k] * len(kept), dtype=object if c == "series" else "int64") for c, k in zip(by, key)},
                             "interval": pd.Series(kept, dtype="int64")})

    kinds = dict(pieces.dtypes)
    chunks = pieces.withColumn("part", part).join(scale, "series")
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", interval long"
    return chunks.groupBy(*by, "part").applyInPandas(decide, schema)


def _coarse(points: DataFrame, scale: DataFrame, proposed: DataFrame, longest: int, penalty: float, block: int, chunk: int) -> DataFrame:
    """``series, pos, reach``: the blocks' proposals, and those of grids where no finer proposal is within reach."""
    grid = max(JUMP, block // 4 // JUMP * JUMP)
    levels = 0
    while -(-longest // (grid << levels)) > chunk:
        levels += 1
    pieces = settle(points.groupBy("series", F.floor(F.col("pos") / grid).alias("interval"), "bin").agg(F.count(F.lit(1)).alias("c")))
    level = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(levels).cast("long")))
    every = pieces.select("series", "bin", "c", "interval", level.alias("level")).withColumn(
        "interval", F.floor(F.col("interval") / F.pow(F.lit(2.0), F.col("level")))
    ).groupBy("series", "level", "interval", "bin").agg(F.sum("c").alias("c"))
    decided = _decided(every, scale, ["series", "level"], penalty, chunk)
    width = (F.lit(float(grid)) * F.pow(F.lit(2.0), F.col("level"))).cast("long")
    coarse = settle(decided.select("series", "level", (F.col("interval") * width).alias("pos"), width.alias("reach")))
    taken = proposed.select("series", "pos", F.lit(_REACH * JUMP).cast("long").alias("reach"))
    for number in range(levels + 1):
        own = coarse.where(F.col("level") == number).select("series", "pos", "reach", F.lit(True).alias("new"))
        both = taken.withColumn("new", F.lit(False)).unionByName(own)
        side = Window.partitionBy("series").orderBy("pos")  # a row per proposal
        finer = F.when(~F.col("new"), F.col("pos"))
        last = F.last(finer, ignorenulls=True).over(side.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        after = F.first(finer, ignorenulls=True).over(side.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        near = F.least(F.col("pos") - F.coalesce(last, F.col("pos") - (1 << 60)), F.coalesce(after, F.col("pos") + (1 << 60)) - F.col("pos"))
        taken = settle(both.withColumn("near", near).where(~F.col("new") | (F.col("near") > F.col("reach"))).select("series", "pos", "reach"))
    return taken


def _kept(points: DataFrame, scale: DataFrame, marks: DataFrame, penalty: float, chunk: int, step: int) -> DataFrame:
    """Those of the marks that the cost of all intervals between them keeps."""
    pieces = settle(_numbered(points, marks, step).groupBy("series", "interval", "bin").agg(
        F.count(F.lit(1)).alias("c"), F.min("pos").alias("first")))
    starts = pieces.groupBy("series", "interval").agg(F.min("first").alias("pos"))
    decided = _decided(pieces.drop("first"), scale, ["series"], penalty, chunk)
    return settle(decided.join(starts, ["series", "interval"]).select("series", "pos"))


def _placed(points: DataFrame, scale: DataFrame, marks: DataFrame, penalty: float, chunk: int, step: int) -> DataFrame:
    """Decide on the marks, then move each to its best place; ``reach`` tells how far off it may be."""
    kept = settle(_kept(points, scale, marks, penalty, chunk, step).join(marks, ["series", "pos"]))
    moved = False
    while True:
        widest = kept.agg(F.max("reach")).first()[0] or 0
        if widest <= JUMP:
            break
        moved = True
        finer = F.greatest(F.lit(JUMP), F.floor(F.col("reach") / _REACH / JUMP) * JUMP).cast("long")
        kept = _moved(points, scale, kept.withColumn("finer", finer), step)
    ready = kept.select("series", "pos")
    return _kept(points, scale, ready, penalty, chunk, step) if moved else ready


def _moved(points: DataFrame, scale: DataFrame, kept: DataFrame, step: int) -> DataFrame:
    """Each mark at the place within twice its reach where the two segments beside it cost least, on its finer grid."""
    kind = _series_type(points)
    order = Window.partitionBy("series").orderBy("pos")  # a row per change
    sizes = points.groupBy("series").agg(F.max("n").alias("n"))
    changes = settle(
        kept.join(sizes, "series").withColumns({
            "number": F.row_number().over(order).cast("long"),
            "before": F.coalesce(F.lag("pos").over(order), F.lit(0)), "behind": F.coalesce(F.lead("pos").over(order), F.col("n")),
        })
    )
    tries = F.sequence(F.lit(-2 * _REACH), F.lit(2 * _REACH))
    at = F.col("pos") + F.col("step") * F.col("finer")
    places = changes.withColumn("step", F.explode(F.when(F.col("reach") > JUMP, tries).otherwise(F.array(F.lit(0))))).withColumn("place", at)
    inside = (F.col("place") >= F.col("before") + MIN_SIZE) & (F.col("place") <= F.col("behind") - MIN_SIZE)
    places = settle(places.where(inside | (F.col("step") == 0)).select("series", "number", F.col("place").alias("pos"), (F.col("step") == 0).alias("own")))
    marks = places.select("series", "pos").distinct()
    pieces = settle(_numbered(points, marks, step).groupBy("series", "interval", "bin").agg(
        F.count(F.lit(1)).alias("c"), F.min("pos").alias("first")))
    starts = settle(pieces.groupBy("series", "interval").agg(F.min("first").alias("pos")))
    # Every interval counts for the change behind it and for the one before it.
    segment = starts.join(changes.select("series", "pos", "number"), ["series", "pos"], "left").withColumn(
        "segment", F.coalesce(F.max("number").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)))
    candidates = places.groupBy("series", "pos").agg(F.collect_set("number").alias("tried"))
    shaped = settle(segment.join(candidates, ["series", "pos"], "left").select("series", "interval", "pos", "segment", "tried"))
    rows = pieces.drop("first").join(shaped, ["series", "interval"]).withColumn(
        "number", F.explode(F.array(F.col("segment"), F.col("segment") + 1))).join(
        changes.select("series", "number", F.col("pos").alias("now")), ["series", "number"]).join(scale, "series")

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        numbers, table, centres, gamma = _tabled(pdf)
        first = pdf.drop_duplicates("interval").sort_values("interval")
        allowed = [i for i, tried in enumerate(first["tried"]) if i and tried is not None and key[1] in list(tried)]
        at = best_split(table, centres, gamma, allowed)
        place = int(pdf["now"].iloc[0]) if at is None else int(first["pos"].iloc[at])
        return pd.DataFrame({"series": _same(key, 1), "number": [key[1]], "pos": [place]})

    found = rows.groupBy("series", "number").applyInPandas(best, f"series {kind}, number long, pos long")
    rest = F.when((F.col("reach") > JUMP) & (F.col("finer") > JUMP), F.col("finer")).otherwise(F.lit(0))
    return settle(found.join(changes.select("series", "number", rest.cast("long").alias("reach")), ["series", "number"]).groupBy(
        "series", "pos").agg(F.max("reach").alias("reach")))


def changepoint_status(points: DataFrame) -> DataFrame:
    """``(series, n, declined)``."""
    n = F.max("n")
    return points.groupBy("series").agg(n.alias("n"), (n < MIN_CHANGE).alias("declined"))


# --- before and after ---------------------------------------------------------------------


def median_time(df: DataFrame, time: str, value: str) -> float | None:
    """Median timestamp in microseconds over rows that have both columns."""
    rows = df.select(micros(df, time).cast("double").alias("t"), numeric(df, value).alias("v")).dropna()
    row = quantiles(rows.select("t"), "t", [0.5]).first()
    return row["q0"] if row else None


def compare_windows(df: DataFrame, time: str, value: str, cut: float) -> DataFrame:
    """One row: sizes, means, ``delta, pct_change, cohens_d`` and the statistics ``u`` and ``d``."""
    rows = df.select(micros(df, time).alias("t"), numeric(df, value).alias("v")).dropna()
    sided = rows.select(F.when(F.col("t") < F.lit(float(cut)), 1).otherwise(0).alias("side"), "v")
    first, second = F.when(F.col("side") == 1, F.col("v")), F.when(F.col("side") == 0, F.col("v"))
    stats = sided.agg(
        F.count(first).alias("n_before"), F.count(second).alias("n_after"),
        F.avg(first).alias("mean_before"), F.avg(second).alias("mean_after"),
        F.var_samp(first).alias("vb"), F.var_samp(second).alias("va"),
    )
    delta = F.col("mean_after") - F.col("mean_before")
    tests = two_samples(sided).select("u", "tie_term", "d", F.lit(1).alias("one"))
    return (
        stats.withColumn("one", F.lit(1))
        .join(tests, "one")  # one row on each side
        .select(
            "n_before", "n_after", "mean_before", "mean_after", delta.alias("delta"),
            (F.try_divide(delta, F.col("mean_before")) * 100).alias("pct_change"),
            F.coalesce(F.try_divide(delta, F.sqrt((F.col("va") + F.col("vb")) / 2)), F.lit(0.0)).alias("cohens_d"),
            "u", "tie_term", "d",
        )
    )
