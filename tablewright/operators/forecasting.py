"""Forecasts of many series: seasonal autoregression, lag regression, trend + seasons.

Series are regular and of any length (see ``timeseries``). Spark computes features, sums of
products, errors and winners; a per-series function only solves one small least-squares problem
or rolls a fitted recursion forward.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators import ranking, timeseries
from tablewright.session import cut, stored

MIN_POINTS = 30
MIN_TREND_POINTS = 5
BOOSTING_ROUNDS = 20
BAND_95 = 1.96
BAND_80 = 1.2816
# Points per season for each step length.
SEASONS = {"1 hour": 24, "1 day": 7, "7 days": 52, "1 month": 12}
LAG_NAMES = [f"lag_{n}" for n in timeseries.LAGS]
FEATURES = [*LAG_NAMES, "rolling_mean_7", "rolling_std_7", "month", "dow"]
DAYS = {"yearly": 365.25, "weekly": 7.0, "daily": 1.0}
ORDERS = {"yearly": 10, "weekly": 3, "daily": 4}


FITTED, SHORT = "fitted", "short"


def by_length(df: DataFrame, keys: Sequence[str], points: int = MIN_POINTS) -> tuple[DataFrame, DataFrame]:
    """The series with at least ``points`` points, and the others."""
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= points)
    sizes = sizes.select(*[F.col(k).alias(n) for k, n in names.items()])
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return df.join(sizes, same, "left_semi"), df.join(sizes, same, "left_anti")


def _fallback(df: DataFrame, keys: Sequence[str], ts: str, value: str, horizon: int, step: str) -> DataFrame:
    """Rows for series too short to fit: the last value, marked ``short``."""
    out = timeseries.last_value_forecast(df, keys, ts, value, horizon, step)
    return out.select(*keys, ts, "step", "forecast", F.lit(SHORT).alias("status"))


def seasonal_ar(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, horizon: int, step: str = "1 day", season: int | None = None
) -> DataFrame:
    """``(keys, ts, step, forecast, lower, upper, status)``: least squares of each change on the
    previous change and, with more than two seasons of data, the one a season before.

    The changes come from windows over parts of a series with a halo, the normal equations from one
    aggregate per series, their solution and the recursion are expressions, so no series is gathered
    anywhere; it sends on its last ``season`` changes only. Where the two regressors are one and the same only the first is used. Series
    under ``MIN_TREND_POINTS`` points repeat their last value, without a band, as ``short``.
    """
    keys, season = list(keys), season or SEASONS.get(step, 7)
    points = timeseries.numbered(df.select(*keys, ts, F.col(value).cast("double").alias("__y")), keys, ts, step)
    rows, by = timeseries.overlapping(points, keys, season + 1)
    order = W.partitionBy(*by).orderBy("__i")
    change = rows.withColumn("__c", F.col("__y") - F.lag("__y").over(order))
    lagged = change.withColumns({"__x": F.lag("__c").over(order), "__s": F.lag("__c", season).over(order)}).filter("__own")
    lagged = lagged.withColumn("__r", F.col("__n") - F.col("__i") + 1)
    known, both = F.col("__x").isNotNull(), F.col("__s").isNotNull() & F.col("__x").isNotNull()
    recent = F.when((F.col("__r") <= season) & F.col("__c").isNotNull(), F.struct(F.col(ts).alias("t"), F.col("__c").alias("c")))

    def moments(rows: Column, names: dict[str, str], mark: str) -> list[Column]:
        col = {k: F.when(rows, F.col(c)) for k, c in names.items()}
        out = [F.avg(c).alias(f"{mark}m{k}") for k, c in col.items()]
        pairs = [(i, j) for i in names for j in names if i <= j]
        return out + [F.covar_pop(col[i], col[j]).alias(f"{mark}{i}{j}") for i, j in pairs]

    sums = lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(ts).alias("__last"), F.max_by("__y", ts).alias("__level"),
        F.sort_array(F.collect_list(recent)).alias("__recent"),
        *moments(known, {"x": "__x", "y": "__c"}, "a"), *moments(both, {"s": "__s", "x": "__x", "y": "__c"}, "b"),
    )
    det = F.col("bss") * F.col("bxx") - F.col("bsx") * F.col("bsx")
    two = F.coalesce((F.col("n") > 2 * season) & (det > 1e-9 * F.col("bss") * F.col("bxx")), F.lit(False))
    sums = sums.withColumns({
        "two": two, "det": det,
        "c1": F.when(two, (F.col("bss") * F.col("bxy") - F.col("bsx") * F.col("bsy")) / det)
        .when(F.col("axx") > 0, F.col("axy") / F.col("axx")).otherwise(0.0),
        "c2": F.when(two, (F.col("bxx") * F.col("bsy") - F.col("bsx") * F.col("bxy")) / det).otherwise(0.0),
    })
    base = F.when(F.col("two"), F.col("bmy") - F.col("c1") * F.col("bmx") - F.col("c2") * F.col("bms"))
    left = F.when(F.col("two"), F.col("byy") - F.col("c1") * F.col("bxy") - F.col("c2") * F.col("bsy"))
    fitted = sums.withColumns({
        "c0": base.otherwise(F.col("amy") - F.col("c1") * F.col("amx")),
        "spread": F.sqrt(F.greatest(left.otherwise(F.col("ayy") - F.col("c1") * F.col("axy")), F.lit(0.0))),
        "long": F.col("n") >= MIN_TREND_POINTS,
    })

    def forward(s: Column, _: Column) -> Column:
        past = s["past"]
        far = F.when(F.size(past) >= season, F.element_at(past, -season)).otherwise(0.0)
        moved = F.col("c0") + F.col("c1") * F.element_at(past, -1) + F.col("c2") * far
        held = F.when(F.size(past) >= season, F.slice(past, -(season - 1), season - 1) if season > 1 else F.array().cast("array<double>")).otherwise(past)
        level = s["level"] + moved
        return F.struct(F.concat(held, F.array(moved)).alias("past"), level.alias("level"), F.concat(s["made"], F.array(level)).alias("made"))

    start = F.struct(
        F.col("__recent")["c"].alias("past"), F.col("__level").alias("level"), F.array().cast("array<double>").alias("made")
    )
    rolled = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, forward)["made"]
    level = F.when(F.col("long"), rolled).otherwise(F.array_repeat("__level", horizon))
    band = F.when(F.col("long"), F.lit(BAND_95) * F.col("spread") * F.sqrt(F.col("step")))
    out = fitted.select(*keys, "__last", "long", "spread", F.posexplode(level).alias("__p", "forecast")).withColumn("step", F.col("__p") + 1)
    return out.select(
        *keys, (F.col("__last") + F.col("step") * timeseries.interval(step)).alias(ts), "step", "forecast",
        (F.col("forecast") - band).alias("lower"), (F.col("forecast") + band).alias("upper"),
        F.when(F.col("long"), FITTED).otherwise(SHORT).alias("status"),
    )


def fit_lag_model(df: DataFrame, keys: Sequence[str], ts: str, value: str, estimator=None, step: str | None = None) -> PipelineModel:
    """One regression on lag features, pooled over all series."""
    frame = timeseries.lag_features(df, keys, ts, value, step=step).na.drop(subset=FEATURES)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="__features")
    estimator = estimator or LinearRegression(regParam=1e-6, elasticNetParam=0.0)
    estimator = estimator.copy().setParams(featuresCol="__features", labelCol=value, predictionCol="__next")
    ready = assembler.transform(frame).select("__features", value).persist()
    try:
        return PipelineModel([assembler, estimator.fit(ready)])
    finally:
        ready.unpersist()


def last_values(df: DataFrame, keys: Sequence[str], ts: str, value: str, n: int) -> DataFrame:
    """Per series the last ``n`` values in time order, as one array."""
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(ts)))
    tail = df.withColumn("__r", newest).filter(F.col("__r") <= n)
    listed = F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).cast("double").alias("v"))))
    return tail.groupBy(*keys).agg(listed.alias("__l"), F.max(ts).alias("__last")).select(
        *keys, F.col("__l")["v"].alias("__hist"), "__last"
    )


def lag_forecast(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, horizon: int, step: str = "1 day", estimator=None, model=None
) -> DataFrame:
    """Recursive forecast with a pooled lag model of any kind; all series step together.

    A series' state is its last 14 values in one array column, so a step is a projection
    and a ``transform`` without shuffle. Steps are written out in groups to bound the plan.
    Series of fewer points repeat their last value, with the status ``short``.
    """
    keys = list(keys)
    depth = max(timeseries.LAGS)
    enough, short = by_length(df, keys, depth)
    rest = _fallback(short, keys, ts, value, horizon, step)
    state = cut(last_values(enough, keys, ts, value, depth))
    if state.isEmpty():
        return rest
    model = model or fit_lag_model(df, keys, ts, value, estimator, step)
    hist, week = F.col("__hist"), F.slice("__hist", -7, 7)
    mean = F.aggregate(week, F.lit(0.0), lambda s, x: s + x) / 7
    square = F.aggregate(week, F.lit(0.0), lambda s, x: s + (x - F.col("rolling_mean_7")) * (x - F.col("rolling_mean_7")))
    state = state.withColumn("__made", F.array().cast("array<double>"))
    for h in range(1, horizon + 1):
        at = F.col("__last") + F.lit(h) * timeseries.interval(step)
        frame = state.withColumns({f"lag_{n}": F.element_at(hist, -n) for n in timeseries.LAGS})
        frame = frame.withColumns({"rolling_mean_7": mean, "month": F.month(at), "dow": F.weekday(at)})
        frame = model.transform(frame.withColumn("rolling_std_7", F.sqrt(square / 6)))
        nxt = F.array("__next")
        state = frame.select(
            *keys, "__last", F.slice(F.concat(hist, nxt), -depth, depth).alias("__hist"),
            F.concat("__made", nxt).alias("__made"),
        )
        if h % 6 == 0:
            state = cut(state)
    out = state.select(*keys, "__last", F.posexplode("__made").alias("__p", "forecast"))
    steps = F.col("__p") + 1
    at = (F.col("__last") + steps * timeseries.interval(step)).alias(ts)
    return out.select(*keys, at, steps.alias("step"), "forecast", F.lit(FITTED).alias("status")).unionByName(rest)


def _rolled_lags(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, horizon: int, step: str, scorer: Callable[[], Callable[[np.ndarray], np.ndarray]]
) -> DataFrame:
    """The recursion of ``lag_forecast`` rolled forward inside tasks, all series of a batch a step at a time.

    Each series sends its last 14 values only; ``scorer()`` gives the function from features to values.
    """
    keys = list(keys)
    depth = max(timeseries.LAGS)
    enough, short = by_length(df, keys, depth)
    rest = _fallback(short, keys, ts, value, horizon, step)
    if enough.isEmpty():
        return rest
    scored = scorer()
    ahead = F.transform(
        F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.col("__last") + h * timeseries.interval(step)
    )
    state = last_values(enough, keys, ts, value, depth).select(
        *keys, "__hist", F.transform(ahead, lambda t: F.month(t)).alias("__months"),
        F.transform(ahead, lambda t: F.weekday(t)).alias("__days"),
    )

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def roll(hists: pd.Series, months: pd.Series, days: pd.Series) -> pd.Series:
        past = np.zeros((len(hists), depth + horizon))
        past[:, :depth] = np.stack(hists.to_numpy())
        month, day = np.stack(months.to_numpy()), np.stack(days.to_numpy())
        for h in range(horizon):
            at = depth + h
            week = past[:, at - 7 : at]
            x = [*[past[:, at - n] for n in timeseries.LAGS], week.mean(axis=1), week.std(axis=1, ddof=1), month[:, h], day[:, h]]
            past[:, at] = scored(np.column_stack(x))
        return pd.Series(list(past[:, depth:]))

    made = state.select(*keys, F.posexplode(roll("__hist", "__months", "__days")).alias("__p", "forecast"))
    made = made.select(*keys, (F.col("__p") + 1).alias("step"), "forecast")
    out = timeseries.future_steps(enough, keys, ts, horizon, step).join(made, [*keys, "step"])
    return out.select(*keys, ts, "step", "forecast", F.lit(FITTED).alias("status")).unionByName(rest)


def lag_forecast_linear(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, horizon: int, step: str = "1 day", model=None
) -> DataFrame:
    """The recursion with a linear model, rolled forward from its coefficients; for long horizons."""

    def scorer():
        fitted = (model or fit_lag_model(df, keys, ts, value, step=step)).stages[-1]
        coef, base = fitted.coefficients.toArray(), float(fitted.intercept)
        return lambda x: base + x @ coef

    return _rolled_lags(df, keys, ts, value, horizon, step, scorer)


def _trees(fitted) -> list[np.ndarray]:
    """A boosted model as arrays over its nodes (feature or -1, threshold, left, right, value), then the
    trees' roots and weights; a few thousand numbers, whatever the data."""
    nodes, roots, weights, waiting = [], [], [], {}
    for line in fitted.toDebugString.splitlines()[1:]:
        words, indent = line.split(), len(line) - len(line.lstrip())
        if not words:
            continue
        if words[0] == "Tree":
            roots.append(len(nodes))
            weights.append(float(words[3].rstrip("):")))
        elif words[0] == "If":
            waiting[indent] = len(nodes)
            nodes.append([int(words[2]), float(words[4].rstrip(")")), len(nodes) + 1, 0, 0.0])
        elif words[0] == "Else":
            nodes[waiting[indent]][3] = len(nodes)
        else:
            nodes.append([-1, 0.0, len(nodes), len(nodes), float(words[1])])
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
    return [feature, threshold, left, right, value, np.array(roots), np.array(weights)]


def _boosted_values(x: np.ndarray, trees: list[np.ndarray]) -> np.ndarray:
    feature, threshold, left, right, value, roots, weights = trees
    at = np.tile(roots, (len(x), 1))
    rows = np.arange(len(x))[:, None]
    while (inner := feature[at] >= 0).any():
        lower = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
        at = np.where(inner, np.where(lower, left[at], right[at]), at)
    return value[at] @ weights


def lag_forecast_boosted(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, horizon: int, step: str = "1 day", model=None
) -> DataFrame:
    """The recursion with boosted trees, rolled forward from the trees' nodes; for long horizons."""

    def scorer():
        estimator = GBTRegressor(maxIter=BOOSTING_ROUNDS, maxDepth=5, seed=42)
        trees = _trees((model or fit_lag_model(df, keys, ts, value, estimator, step)).stages[-1])
        return lambda x: _boosted_values(x, trees)

    return _rolled_lags(df, keys, ts, value, horizon, step, scorer)


# ---- race ---------------------------------------------------------------------------------

CANDIDATES = ("seasonal_naive", "seasonal_ar", "lag_regression", "lag_boosted")


def _candidates(data: DataFrame, keys: list[str], ts: str, value: str, steps: int, step: str, names: Sequence[str]) -> DataFrame:
    """``(keys, ts, step, forecast, lower, upper, model)`` of the named candidates; only the autoregression has a band of its own."""
    season = SEASONS.get(step, 7)
    make = {
        "seasonal_naive": lambda: timeseries.seasonal_naive(data, keys, ts, value, season, steps, step),
        "seasonal_ar": lambda: seasonal_ar(data, keys, ts, value, steps, step, season),
        "lag_regression": lambda: lag_forecast_linear(data, keys, ts, value, steps, step),
        "lag_boosted": lambda: lag_forecast_boosted(data, keys, ts, value, steps, step),
    }
    out = None
    for name in names:
        made = make[name]()
        bands = [F.col(c) if c in made.columns else F.lit(None).cast("double").alias(c) for c in ("lower", "upper")]
        made = made.select(*keys, ts, "step", "forecast", *bands, F.lit(name).alias("model"))
        out = made if out is None else out.unionByName(made)
    return out


def held_out_errors(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, horizon: int, step: str = "1 day", names: Sequence[str] = CANDIDATES
) -> DataFrame:
    """``(keys, ts, step, model, error)``: how far each candidate, learnt from the rest and rolled forward
    without a look at the hold-out, is off at each of its points. The hold-out is a series' last fifth, at
    least ``horizon`` points."""
    keys = list(keys)
    parts = timeseries.time_split(df.select(*keys, ts, value), keys, ts, horizon, step=step)
    train, test = cut(parts.filter("split = 'train'").drop("split")), parts.filter("split = 'test'").drop("split")
    longest = test.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or horizon
    missed = _candidates(train, keys, ts, value, longest, step, names).join(test, [*keys, ts])
    return missed.select(*keys, ts, "step", "model", F.abs(F.col(value) - F.col("forecast")).alias("error"))


def error_bands(errors: DataFrame, by: Sequence[str], share: tuple[int, int] = (95, 100), error: str = "error") -> DataFrame:
    """``(by, band)``: the split-conformal half width, the ``⌈(n + 1)·share⌉``-th smallest of a group's ``n``
    errors, so that a new error of their kind is within it with that probability. Groups of too few errors for
    the share get their largest. Ranks are exact, and no task sorts more than one range of a group's errors."""
    errors = errors.filter(F.col(error).isNotNull())
    keyed = ranking.with_range_bucket(errors, error, ranking.range_bounds(errors, error, 256), "__range")
    ranked = ranking.rank_rows(keyed, [error], F.col("__range"), list(by))
    wanted = F.least(F.col("total"), F.ceil((F.col("total") + 1) * share[0] / share[1]))
    return ranked.filter(F.col("rank") == wanted).select(*by, F.col(error).alias("band"))


def forecast_race(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, horizon: int, step: str = "1 day", names: Sequence[str] = CANDIDATES
) -> DataFrame:
    """Per series the candidate with the lowest hold-out MAE, refitted on all points.

    Returns ``(keys, ts, step, model, mae, forecast, lower, upper, status)``. See ``held_out_errors`` for
    the hold-out. The autoregression's band of 95 % grows with the step; the others' is the split-conformal
    one of the series' errors in the hold-out. Only candidates that won a series are refitted. Series under
    ``MIN_POINTS`` points, or without a point left to learn from, do not race: they repeat their last value
    as model ``last_value`` with the status ``short``.
    """
    keys = list(keys)
    every = cut(df.select(*keys, ts, value))
    long, short = by_length(every, keys, max(MIN_POINTS, horizon + 1))
    columns = [*keys, ts, "step", "model", "mae", "forecast", "lower", "upper", "status"]
    nothing = {c: F.lit(None).cast("double") for c in ("mae", "lower", "upper")}
    rest = _fallback(short, keys, ts, value, horizon, step).withColumns({"model": F.lit("last_value"), **nothing}).select(*columns)
    if long.isEmpty():
        return rest
    series = cut(long)
    missed = stored(held_out_errors(series, keys, ts, value, horizon, step, names))
    errors = missed.groupBy(*keys, "model").agg(F.avg("error").alias("mae"))
    winners = cut(timeseries.pick_winner(errors, keys))
    bands = cut(error_bands(missed.join(winners.drop("mae"), [*keys, "model"], "left_semi"), [*keys, "model"]))
    won = {r["model"] for r in winners.select("model").distinct().collect()}
    if not won:
        return rest
    made = _candidates(series, keys, ts, value, horizon, step, [n for n in names if n in won])
    out = made.join(winners, [*keys, "model"]).join(bands, [*keys, "model"], "left").withColumns({
        "lower": F.coalesce("lower", F.col("forecast") - F.col("band")),
        "upper": F.coalesce("upper", F.col("forecast") + F.col("band")),
        "status": F.lit(FITTED),
    })
    return out.select(*columns).unionByName(rest)


# ---- trend and seasons ------------------------------------------------------------------
#
# The model is linear in its columns, so all a fit needs of a series is the sums of products of
# its columns. Tasks add up the products of the rows they hold, Spark adds up the tasks' sums, and
# one small system per series is solved on what comes out. A series may be of any length.

#: series whose sums a task holds before it sends them on
_HELD = 256


def _design(days: np.ndarray, clock: np.ndarray, span: float, knots: int, use: Sequence[str]) -> np.ndarray:
    """Columns of the model: level, slope, changes of slope up to four fifths of the span, seasons."""
    t = days / span
    columns = [np.ones_like(t), t]
    columns += [np.maximum(t - 0.8 * i / (knots + 1), 0.0) for i in range(1, knots + 1)]
    for name in use:
        for n in range(1, ORDERS[name] + 1):
            turn = 2 * np.pi * n * clock / DAYS[name]
            columns += [np.sin(turn), np.cos(turn)]
    return np.column_stack(columns)


def _solved(sums: np.ndarray, knots: int, use: Sequence[str], points: int, ridge: float) -> tuple[np.ndarray, float]:
    """Coefficients and the standard deviation of the residuals, from the sums of products."""
    size = 2 + knots + 2 * sum(ORDERS[name] for name in use)
    gram = sums[: size * size].reshape(size, size)
    cross, square = sums[size * size : -1], sums[-1]
    penalty = np.full(size, ridge)
    penalty[:2] = 1e-9  # level and slope are free
    coef = np.linalg.solve(gram + np.diag(penalty), cross)
    mean = (cross[0] - gram[0] @ coef) / points
    left = (square - 2 * cross @ coef + coef @ gram @ coef) / points
    return coef, float(np.sqrt(max(left - mean * mean, 0.0)))


def _runs(names: np.ndarray):
    """Stretches of equal values in sorted names."""
    starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else []
    yield from zip(starts, [*starts[1:], len(names)])


def _series_settings(points: DataFrame, keys: Sequence[str], ts: str, value: str, changes: int, seasons: Sequence[str]) -> DataFrame:
    """One row per series: its number, first time, span, scale, changes of slope and the seasons it is long
    and fine enough for (at least half of its steps are shorter than the season)."""
    day = 86_400_000_000
    rows, by = timeseries.overlapping(timeseries.numbered(points, keys, ts), keys, 1)
    at = timeseries.micros(F.col(ts))
    gap = (at - F.lag(at).over(W.partitionBy(*by).orderBy("__i"))) / day
    rows = rows.withColumns({"__gap": gap, "__u": at}).filter("__own")
    y = F.col(value).cast("double")
    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("__u").alias("start"), F.max("__u").alias("end"), F.max(ts).alias("last"),
        F.avg(y).alias("middle"), F.stddev_pop(y).alias("scale"), F.count("__gap").alias("gaps"),
        F.count(F.when(F.col("__gap") < 7, 1)).alias("under_week"), F.count(F.when(F.col("__gap") < 1, 1)).alias("under_day"),
    )
    span = (F.col("end") - F.col("start")) / day
    fits = {
        "yearly": F.col("span") >= 730,
        "weekly": (F.col("span") >= 14) & (2 * F.col("under_week") > F.col("gaps")),
        "daily": (F.col("span") >= 2) & (2 * F.col("under_day") > F.col("gaps")),
    }
    use = F.filter(F.array(*[F.when(fits[name], name) for name in DAYS if name in seasons] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    scale = F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    knots = F.least(F.lit(changes), F.floor(F.col("n") / 3)).cast("int")
    settings = found.withColumn("span", span).select(
        *keys, "n", "start", "span", "last", "middle", scale.alias("scale"), knots.alias("knots"), use.alias("use")
    )
    return stored(settings.withColumn("series", F.monotonically_increasing_id()))


def _sums(rows: DataFrame) -> DataFrame:
    """``(series, sums)``: products of the model's columns and of the scaled values, over all rows of a series."""
    import pyarrow as pa

    def run(batches):
        held: dict[int, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            out = [pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=["series", "sums"])

        for batch in batches:
            pdf = batch.to_pandas().sort_values("series", kind="stable")
            for start, end in _runs(pdf["series"].to_numpy()):
                part = pdf.iloc[start:end]
                first = part.iloc[0]
                x = _design(part["days"].to_numpy(), part["clock"].to_numpy(), first["span"], int(first["knots"]), list(first["use"]))
                y = part["y"].to_numpy()
                made = np.concatenate([(x.T @ x).ravel(), x.T @ y, [y @ y]])
                name = int(first["series"])
                held[name] = held[name] + made if name in held else made
                if len(held) >= _HELD:
                    yield sent()
        if held:
            yield sent()

    partial = rows.select("series", "days", "clock", "y", "span", "knots", "use").mapInArrow(run, "series bigint, sums array<double>")
    added = partial.select("series", F.posexplode("sums").alias("place", "v")).groupBy("series", "place").agg(F.sum("v").alias("v"))
    listed = F.sort_array(F.collect_list(F.struct("place", "v")))  # as many as the model has products
    return added.groupBy("series").agg(listed["v"].alias("sums"))


def trend_fourier(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, horizon: int = 30, changes: int = 25, ridge: float = 1.0,
    seasons: Sequence[str] = tuple(DAYS),
) -> DataFrame:
    """Piecewise trend plus Fourier seasons per series, history and ``horizon`` daily steps.

    Returns ``(keys, ts, is_future, yhat, yhat_lower, yhat_upper)`` with an 80 % band from
    the residuals. Yearly terms need two years, weekly ones two weeks and steps below a
    week, daily ones two days and steps below a day. Series under ``MIN_TREND_POINTS`` points come
    back as they are and repeat their last value, without a band.
    """
    import pyarrow as pa

    keys = list(keys)
    kind = df.schema[ts].dataType.simpleString()
    points = stored(timeseries.mean_per_timestamp(df.na.drop(subset=[ts, value]), keys, ts, value))
    enough, short = by_length(points, keys, MIN_TREND_POINTS)
    settings = _series_settings(enough, keys, ts, value, changes, seasons)
    day = 86_400_000_000
    same = F.lit(True)
    for k in keys:
        same = same & enough[k].eqNullSafe(settings[k])
    at = timeseries.micros(F.col(ts))
    placed = enough.join(settings.drop("last"), same).select(
        "series", enough[ts].alias(ts), ((at - F.col("start")) / day).alias("days"), (at / day).alias("clock"),
        ((F.col(value) - F.col("middle")) / F.col("scale")).alias("y"), "span", "knots", "use",
    )

    def solve(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("sums", "knots", "use", "n")]
            made = [_solved(np.array(s), k, u, n, ridge) for s, k, u, n in zip(*columns)]
            out = [batch.column("series"), pa.array([c for c, _ in made], pa.list_(pa.float64())), pa.array([r for _, r in made], pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=["series", "coef", "spread"])

    ready = _sums(placed).join(settings.select("series", "knots", "use", "n"), "series")
    coefs = stored(ready.mapInArrow(solve, "series bigint, coef array<double>, spread double"))

    ahead = settings.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    stamp = (F.col("last") + F.col("step") * timeseries.interval("1 day")).cast(kind).alias(ts)
    ahead = ahead.select("series", stamp, "start", "span", "knots", "use").select(
        "series", ts, ((at - F.col("start")) / day).alias("days"), (at / day).alias("clock"), "span", "knots", "use", F.lit(True).alias("is_future")
    )
    every = placed.drop("y").withColumn("is_future", F.lit(False)).unionByName(ahead).join(coefs, "series")

    def fit(batches):
        for batch in batches:
            pdf = batch.select(["series", "days", "clock", "span", "knots", "use", "coef"]).to_pandas()
            order = np.argsort(pdf["series"].to_numpy(), kind="stable")
            pdf, fitted = pdf.iloc[order], np.zeros(len(pdf))
            for start, end in _runs(pdf["series"].to_numpy()):
                part = pdf.iloc[start:end]
                first = part.iloc[0]
                x = _design(part["days"].to_numpy(), part["clock"].to_numpy(), first["span"], int(first["knots"]), list(first["use"]))
                fitted[order[start:end]] = x @ np.array(first["coef"])
            kept = [batch.column(c) for c in ("series", ts, "is_future", "spread")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fitted, pa.float64())], names=["series", ts, "is_future", "spread", "fitted"])

    scaled = every.mapInArrow(fit, f"series bigint, `{ts}` {kind}, is_future boolean, spread double, fitted double")
    scaled = scaled.join(settings.select("series", *keys, "middle", "scale"), "series")
    yhat, band = F.col("middle") + F.col("scale") * F.col("fitted"), F.lit(BAND_80) * F.col("scale") * F.col("spread")
    fitted = scaled.select(*keys, ts, "is_future", yhat.alias("yhat"), (yhat - band).alias("yhat_lower"), (yhat + band).alias("yhat_upper"))

    columns = [*keys, F.col(ts).cast(kind).alias(ts)]
    no_band = [F.lit(None).cast("double").alias(c) for c in ("yhat_lower", "yhat_upper")]
    past = short.select(*columns, F.lit(False).alias("is_future"), F.col(value).alias("yhat"), *no_band)
    last = timeseries.last_value_forecast(short, keys, ts, value, horizon, "1 day")
    future = last.select(*columns, F.lit(True).alias("is_future"), F.col("forecast").alias("yhat"), *no_band)
    return fitted.unionByName(past).unionByName(future)
