"""Many series, short ones or one of billions of points: a long table of ``(series keys, ts, value)``.

Raw rows are first averaged per timestamp (with partial aggregation) and put on a calendar
grid. No operator needs a whole series in one task. A series is divided into ranges of time;
a point's position is its place in its range plus the (few) totals of the ranges before.
Windows run over parts of ``RANGE_ROWS`` positions: a part gets the last rows of the part before
it as a halo where a frame has a bounded reach, and the nearest known points of the parts around
it where it has none.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators import ranking
from tablewright.operators.relational import micros
from tablewright.session import cut

LAGS = (1, 2, 3, 7, 14)
LONGEST_FILL = 5
#: positions of a series that one task handles together
RANGE_ROWS = 1 << 16
#: points of calendars that one task unfolds
GRID_ROWS = 1 << 18
#: longest sequence that a row of a calendar is exploded into
_FAN = 2048


def _step_parts(step: str) -> tuple[int, str]:
    found = re.fullmatch(r"([1-9][0-9]{0,8}) (second|minute|hour|day|week|month|year)s?", step)
    if not found:
        raise ValueError(f"not a step: {step!r}")
    return int(found[1]), found[2]


def interval(step: str) -> Column:
    """``3 hours``, ``1 day`` … as an interval; anything else is refused, since it goes into SQL text."""
    _step_parts(step)
    return F.expr(f"INTERVAL {step}")


def calendar_index(ts: Column, step: str) -> Column:
    """Number of the step a time falls into. Neighbours on a grid of ``step`` have neighbouring numbers,
    also where days have 23 hours and months 28 days."""
    n, unit = _step_parts(step)
    if unit in ("month", "year"):
        return F.floor((F.year(ts) * 12 + F.month(ts)) / (n * (12 if unit == "year" else 1)))
    if unit in ("day", "week"):
        return F.floor(F.unix_date(ts.cast("date")) / (n * (7 if unit == "week" else 1)))
    return F.floor(micros(ts) / (n * {"second": 1, "minute": 60, "hour": 3600}[unit] * 1_000_000))


def numbered(df: DataFrame, keys: Sequence[str], ts: str, step: str | None = None) -> DataFrame:
    """Add ``__i``, a row's place in its series by time (from 1), and ``__n``, the series' length.

    No task sorts more of a series than one range of time: with ``step`` a range is ``RANGE_ROWS`` of
    them, else the series is cut into as many equal ranges as its length asks for.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    same = {name: F.struct(F.col(k)) for name, k in zip(names, keys)}  # a struct of null equals another, null doesn't
    placed = df.withColumns({**same, "__u": micros(F.col(ts))})
    if step:
        slot = F.floor(calendar_index(F.col(ts), step) / RANGE_ROWS)
    else:
        ends = placed.groupBy(*names).agg(F.count(F.lit(1)).alias("__rows"), F.min("__u").alias("__lo"), F.max("__u").alias("__hi"))
        placed = placed.join(ends, names)
        share = (F.col("__u") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1)
        slot = F.floor(share * F.ceil(F.col("__rows") / RANGE_ROWS))
    slot = F.coalesce(slot.cast("bigint"), F.lit(-(1 << 60)))
    ranked = ranking.rank_rows(placed, [F.asc_nulls_first("__u")], slot, names, rank="__i", total="__n")
    return ranked.select(*df.columns, "__i", "__n")


def overlapping(df: DataFrame, keys: Sequence[str], back: int) -> tuple[DataFrame, list[str]]:
    """Parts of ``RANGE_ROWS`` positions of ``numbered`` series, each with the ``back`` rows before it, and the
    columns to partition windows by. Rows of which ``__own`` is false are there for others only."""
    size = max(RANGE_ROWS, back)
    part = F.floor((F.col("__i") - 1) / size)
    lent = F.pmod(F.col("__i") - 1, F.lit(size)) >= size - back
    parts = F.when(lent & (part * size + size < F.col("__n")), F.array(part, part + 1)).otherwise(F.array(part))
    out = df.withColumn("__part", F.explode(parts)).withColumn("__own", F.col("__part") == part)
    return out, [*keys, "__part"]


def mean_per_timestamp(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    return df.groupBy(*keys, ts).agg(F.avg(F.col(value).cast("double")).alias(value))


def infer_frequency(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Per series the step between points: ``seconds`` or ``months`` when regular.

    ``n`` distinct points are regular with step ``s`` exactly if all lie on the grid
    ``first + i*s`` with ``s = (last - first)/(n - 1)``; this needs sums, not a sort.
    Irregular series and those under three points get the default step of a day.
    """
    keys = list(keys)
    at = micros(F.col(ts)).alias("__u")
    month = (F.year(ts) * 12 + F.month(ts)).alias("__m")
    within = F.date_format(ts, "dd HH:mm:ss.SSSSSS").alias("__d")
    points = df.select(*keys, at, month, within).distinct()
    ends = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.min("__u").alias("__lo"), F.max("__u").alias("__hi"),
        F.min("__m").alias("__mlo"), F.max("__m").alias("__mhi"),
        F.min("__d").alias("__dlo"), F.max("__d").alias("__dhi"),
    )
    step = F.try_divide(F.col("__hi") - F.col("__lo"), F.col("points") - 1)
    mstep = F.try_divide(F.col("__mhi") - F.col("__mlo"), F.col("points") - 1)
    placed = points.join(ends.withColumns({"__s": step, "__ms": mstep}), keys)
    even = (F.col("__s") == F.floor("__s")) & ((F.col("__u") - F.col("__lo")) % F.col("__s") == 0)
    monthly = (
        (F.col("__dlo") == F.col("__dhi")) & (F.col("__ms") >= 1)
        & ((F.col("__m") - F.col("__mlo")) % F.col("__ms") == 0)
    )
    checked = placed.groupBy(*keys).agg(
        F.first("points").alias("points"), F.first("__s").alias("__s"), F.first("__ms").alias("__ms"),
        F.coalesce(F.bool_and(even), F.lit(False)).alias("__even"),
        F.coalesce(F.bool_and(monthly), F.lit(False)).alias("__monthly"),
    )
    enough = F.col("points") >= 3
    regular = enough & (F.col("__even") | F.col("__monthly"))
    by_month = enough & F.col("__monthly") & ~F.col("__even")
    return checked.select(
        *keys, "points", regular.alias("regular"),
        F.when(by_month, F.col("__ms").cast("bigint")).alias("months"),
        F.when(by_month, F.lit(None)).when(regular, (F.col("__s") / 1_000_000).cast("bigint"))
        .otherwise(F.lit(86400)).cast("bigint").alias("seconds"),
    )


def regularize(df: DataFrame, keys: Sequence[str], ts: str, value: str, step: str = "1 day") -> DataFrame:
    """Each series on a grid of ``step`` from its first point: duplicates averaged, missing
    points null, points off the grid dropped.

    The calendar is exploded in three short sequences per series, and dealt out before the last.
    """
    keys = list(keys)
    kind = df.schema[ts].dataType
    df = df.filter(F.col(ts).isNotNull())
    points = mean_per_timestamp(df, keys, ts, value)
    span = df.groupBy(*keys).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    span = cut(span.withColumn("__n", calendar_index(F.col("__hi"), step) - calendar_index(F.col("__lo"), step)))
    # as many parts as the calendar asks for: adaptive execution would judge by the few rows before they unfold
    parts = -(-(span.agg(F.sum(F.col("__n") + 1)).first()[0] or 1) // GRID_ROWS)

    def unfold(frame: DataFrame, name: str, start: Column, size: int) -> DataFrame:
        most = F.least(F.lit(_FAN - 1), F.floor((F.col("__n") - start) / size)) if size < _FAN**2 else F.floor(F.col("__n") / size)
        return frame.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), most.cast("bigint"))))

    block, chunk = F.col("__a") * _FAN**2, F.col("__b") * _FAN
    dealt = unfold(unfold(span, "__a", F.lit(0), _FAN**2), "__b", block, _FAN).repartition(int(parts), *keys, "__a", "__b")
    grid = unfold(dealt, "__c", block + chunk, 1)
    at = (F.col("__lo") + (block + chunk + F.col("__c")) * interval(step)).cast(kind)
    grid = grid.withColumn(ts, at).filter(F.col(ts) <= F.col("__hi")).select(*keys, ts)
    return grid.join(points, [*keys, ts], "left")


def interpolate_gaps(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, limit: int = LONGEST_FILL, drop: bool = True, step: str | None = None
) -> DataFrame:
    """Linear fill by position of at most ``limit`` consecutive missing points.

    Longer gaps keep their tail empty, leading gaps stay, trailing ones repeat the last
    value; what is still missing is dropped. With ``step`` the rows must be a grid of that step, as
    ``regularize`` gives it; positions are then read off the calendar instead of being counted.

    Each part of a series learns the last known point before it and the first one after it
    from one row per part; these are written first, so a plan on top holds the rows' own plan once.
    """
    keys = list(keys)
    placed = df.withColumn("__i", calendar_index(F.col(ts), step)) if step else numbered(df, keys, ts).drop("__n")
    placed = placed.withColumn("__part", F.floor(F.col("__i") / RANGE_ROWS))
    point = F.when(F.col(value).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(value).alias("v")))
    ends = placed.groupBy(*keys, "__part").agg(F.min(point).alias("__first"), F.max(point).alias("__last"))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    # looking ahead is looking back in descending order: a frame that runs to the end of the
    # partition would be evaluated anew for every row
    after = W.partitionBy(*keys).orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1)
    around = ends.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__at"),
        F.last("__last", ignorenulls=True).over(before).alias("__before"), F.last("__first", ignorenulls=True).over(after).alias("__after"),
    )
    around = cut(around)
    same = F.col("__part") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    back = W.partitionBy(*keys, "__part").orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys, "__part").orderBy(F.desc("__i")).rowsBetween(W.unboundedPreceding, 0)
    placed = placed.join(around, same).withColumn("__p", point)
    placed = placed.withColumns(
        {
            "__prev": F.coalesce(F.last("__p", ignorenulls=True).over(back), "__before"),
            "__next": F.coalesce(F.last("__p", ignorenulls=True).over(ahead), "__after"),
        }
    )
    gone = F.col("__i") - F.col("__prev.i")
    line = F.col("__prev.v") + (F.col("__next.v") - F.col("__prev.v")) * gone / (
        F.col("__next.i") - F.col("__prev.i")
    )
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(
        gone <= limit, F.coalesce(line, F.col("__prev.v"))
    )
    out = placed.withColumn(value, filled).select(*df.columns)
    return out.na.drop(subset=[value]) if drop else out


def lag_features(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, lags: Sequence[int] = LAGS, step: str | None = None
) -> DataFrame:
    """Past values, mean and sample std of the seven previous ones, month and weekday."""
    rows, by = overlapping(numbered(df, keys, ts, step), keys, max(7, *lags))
    order = W.partitionBy(*by).orderBy("__i")
    week = order.rowsBetween(-7, -1)
    features = {f"lag_{n}": F.lag(value, n).over(order) for n in lags}
    features |= {
        "rolling_mean_7": F.avg(value).over(week), "rolling_std_7": F.stddev_samp(value).over(week),
        "month": F.month(ts), "dow": F.weekday(ts),
    }
    return rows.withColumns(features).filter("__own").select(*df.columns, *features)


def test_length(n: Column, horizon: int, share: float = 0.2) -> Column:
    return F.greatest(F.floor(n * F.lit(share)), F.lit(horizon))


def _split(df: DataFrame, keys: Sequence[str], ts: str, horizon: int, share: float, step: str | None) -> DataFrame:
    """``numbered`` rows with ``split`` and the length of the training part, ``__train``."""
    train = (F.col("__n") - test_length(F.col("__n"), horizon, share)).cast("bigint")
    placed = numbered(df, keys, ts, step).withColumn("__train", F.greatest(train, F.lit(0)))
    return placed.withColumn("split", F.when(F.col("__i") > F.col("__train"), "test").otherwise("train"))


def time_split(df: DataFrame, keys: Sequence[str], ts: str, horizon: int, share: float = 0.2, step: str | None = None) -> DataFrame:
    """Mark the last ``max(int(share*n), horizon)`` points of each series as ``test``."""
    return _split(df, keys, ts, horizon, share, step).drop("__i", "__n", "__train")


def future_steps(df: DataFrame, keys: Sequence[str], ts: str, horizon: int, step: str) -> DataFrame:
    """``horizon`` timestamps after the last one of each series, numbered from 1."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("__last"))
    steps = last.select(*keys, "__last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.select(*keys, (F.col("__last") + F.col("step") * interval(step)).alias(ts), "step")


def last_value_forecast(df: DataFrame, keys: Sequence[str], ts: str, value: str, horizon: int, step: str) -> DataFrame:
    """Forecast every step with the last value: what is left where a series is too short to fit."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("__last"), F.max_by(F.col(value).cast("double"), ts).alias("forecast"))
    steps = last.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.select(*keys, (F.col("__last") + F.col("step") * interval(step)).alias(ts), "step", "forecast")


def seasonal_naive(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, season: int, horizon: int, step: str = "1 day"
) -> DataFrame:
    """Forecast each step with the value one (or more) whole seasons before it."""
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(ts)))
    tail = df.withColumn("__r", newest).filter(F.col("__r") <= season)
    have = tail.groupBy(*keys).agg(F.max("__r").alias("__have"))
    future = future_steps(df, keys, ts, horizon, step).join(have, list(keys))
    place = F.col("__have") - (F.col("step") - 1) % F.col("__have")
    return (
        future.withColumn("__r", place)
        .join(tail.select(*keys, "__r", F.col(value).alias("forecast")), [*keys, "__r"])
        .select(*keys, ts, "step", "forecast")
    )


def backtest_naive(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, seasons: Sequence[int], horizon: int, step: str | None = None
) -> DataFrame:
    """Hold-out MAE per series of seasonal-naive forecasts, one row per season length.

    Each test point is predicted from the last training season only.
    """
    parts = _split(df, keys, ts, horizon, 0.2, step)
    numbers = {"__back": F.col("__train") - F.col("__i") + 1, "__forth": F.col("__i") - F.col("__train")}
    placed = parts.withColumns(numbers).drop("__i", "__n", "__train")
    train = placed.filter("split = 'train'")
    test = placed.filter("split = 'test'").select(*keys, ts, F.col(value).alias("__y"), "__forth")
    sizes = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    season = F.explode(F.array(*[F.lit(s) for s in seasons])).alias("season")
    wanted = test.join(sizes, list(keys)).select("*", season)
    m = F.least("season", "__n")
    wanted = wanted.withColumn("__back", m - (F.col("__forth") - 1) % m)
    scored = wanted.join(train.select(*keys, "__back", F.col(value).alias("__f")), [*keys, "__back"])
    return scored.groupBy(*keys, "season").agg(
        F.avg(F.abs(F.col("__y") - F.col("__f"))).alias("mae"), F.count(F.lit(1)).alias("points")
    )


def pick_winner(errors: DataFrame, keys: Sequence[str], model: str = "model") -> DataFrame:
    """Per series the candidate with the lowest error, the smaller name on a tie."""
    return errors.groupBy(*keys).agg(F.min(F.struct("mae", model)).alias("b")).select(*keys, f"b.{model}", "b.mae")


def linear_trend(df: DataFrame, keys: Sequence[str], ts: str, value: str, horizon: int, step: str = "1 day") -> DataFrame:
    """Least-squares line over days per series and its values ``horizon`` steps ahead."""
    days = micros(F.col(ts)) / F.lit(86_400_000_000)
    known = df.filter(F.col(value).isNotNull()).withColumn("__x", days)
    origin = known.groupBy(*keys).agg(F.min("__x").alias("__x0"))
    fit = known.join(origin, list(keys)).withColumn("__x", F.col("__x") - F.col("__x0")).groupBy(*keys).agg(
        F.regr_slope(value, "__x").alias("slope"), F.regr_intercept(value, "__x").alias("intercept"),
        F.first("__x0").alias("__x0"),
    )
    future = future_steps(known, keys, ts, horizon, step)
    ahead = future.join(fit, list(keys))
    x = days - F.col("__x0")
    return ahead.select(*keys, ts, "step", "slope", "intercept", (F.col("intercept") + F.col("slope") * x).alias("forecast"))
