"""Series operators against pandas."""

import numpy as np
import pandas as pd
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tablewright.operators import forecasting, relational, timeseries


def gappy(spark, seed=0, n=200):
    rng = np.random.default_rng(seed)
    days = pd.date_range("2020-01-01", periods=n)
    frames = []
    for key in "ab":
        keep = rng.random(n) > 0.55
        keep[0] = keep[-1] = True
        frames.append(pd.DataFrame({"key": key, "ts": days[keep], "value": rng.normal(size=keep.sum()).round(3)}))
    pdf = pd.concat(frames)
    return spark.createDataFrame(pdf), pdf


def test_fill_equals_pandas(spark):
    df, pdf = gappy(spark)
    grid = timeseries.regularize(df, ["key"], "ts", "value")
    got = timeseries.interpolate_gaps(grid, ["key"], "ts", "value").toPandas()
    for key, part in pdf.groupby("key"):
        want = part.set_index("ts")["value"].asfreq("D").interpolate(limit=5).dropna()
        mine = got[got["key"] == key].set_index("ts")["value"].sort_index()
        assert list(mine.index) == list(want.index) and np.allclose(mine, want)


def test_trailing_and_leading_gaps(spark):
    rows = [("a", i, v) for i, v in enumerate([None, 1.0, None, 3.0] + [None] * 7)]
    df = spark.createDataFrame(rows, "key string, ts int, value double")
    got = {r["ts"]: r["value"] for r in timeseries.interpolate_gaps(df, ["key"], "ts", "value").collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 3.0, 4: 3.0, 5: 3.0, 6: 3.0, 7: 3.0, 8: 3.0}


def test_lags_equal_pandas(spark):
    df, pdf = gappy(spark, 1)
    got = timeseries.lag_features(df, ["key"], "ts", "value").toPandas()
    for key, part in pdf.groupby("key"):
        s = part.set_index("ts")["value"]
        mine = got[got["key"] == key].set_index("ts").sort_index()
        for n in timeseries.LAGS:
            assert np.allclose(mine[f"lag_{n}"], s.shift(n), equal_nan=True)
        past = s.shift(1).rolling(7, min_periods=1)
        assert np.allclose(mine["rolling_mean_7"], past.mean(), equal_nan=True)
        assert np.allclose(mine["rolling_std_7"], past.std(), equal_nan=True)


def test_asof_equals_pandas_for_a_hot_key(spark):
    rng = np.random.default_rng(4)
    base = pd.Timestamp("2024-01-01")

    def side(n, name):
        ts = base + pd.to_timedelta(np.sort(rng.choice(10_000_000, n, replace=False)), unit="s")
        return pd.DataFrame({"key": np.where(rng.random(n) < 0.5, 1, rng.integers(2, 9, n)), "ts": ts, name: np.arange(n)})

    left, right = side(400, "l"), side(300, "r")
    got = relational.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["key"], "ts", ["r"], bucket_seconds=86400)
    want = pd.merge_asof(left, right, on="ts", by="key").sort_values("l")["r"].to_numpy()
    assert np.array_equal(got.toPandas().sort_values("l")["asof_r"].to_numpy(dtype=float), want, equal_nan=True)


def test_asof_keeps_rows_without_key_or_time(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, None, 10), (3, "a", None)], "id int, k string, at int")
    right = spark.createDataFrame([("a", 5, 7.0), (None, 5, 8.0), ("a", None, 9.0)], "k string, at int, v double")
    stamp = F.timestamp_seconds(F.col("at")).alias("ts")
    out = relational.asof_join(left.select("id", "k", stamp), right.select("k", stamp, "v"), ["k"], "ts", ["v"])
    assert {r["id"]: r["asof_v"] for r in out.collect()} == {1: 7.0, 2: None, 3: None}


def sine(spark, n=120):
    ts = pd.date_range("2024-01-01", periods=n)
    frames = [pd.DataFrame({"key": k, "ts": ts, "value": 50 + i + 10 * np.sin(2 * np.pi * np.arange(n) / 7)}) for i, k in enumerate("ab")]
    return spark.createDataFrame(pd.concat(frames))


def test_forecasts_have_a_full_horizon(spark):
    df = sine(spark)
    for out in (
        timeseries.seasonal_naive(df, ["key"], "ts", "value", 7, 10),
        forecasting.seasonal_ar(df, ["key"], "ts", "value", 10),
        forecasting.lag_forecast(df, ["key"], "ts", "value", 10),
        forecasting.lag_forecast_linear(df, ["key"], "ts", "value", 10),
    ):
        pdf = out.toPandas().sort_values(["key", "step"])
        assert pdf.groupby("key")["step"].apply(list).tolist() == [list(range(1, 11))] * 2
        assert pdf["ts"].min() == pd.Timestamp("2024-04-30")
        want = 50 + 10 * np.sin(2 * np.pi * np.arange(120, 130) / 7)
        assert np.abs(pdf[pdf["key"] == "a"]["forecast"].to_numpy() - want).max() < 0.5


def test_short_series_come_back(spark):
    df, few = sine(spark), sine(spark, 4).replace({"a": "few_a", "b": "few_b"}, subset=["key"])
    both = df.unionByName(few)
    for out in (
        forecasting.seasonal_ar(both, ["key"], "ts", "value", 6),
        forecasting.lag_forecast(both, ["key"], "ts", "value", 6),
        forecasting.lag_forecast_linear(both, ["key"], "ts", "value", 6),
        forecasting.forecast_race(both, ["key"], "ts", "value", 6),
    ):
        pdf = out.toPandas()
        assert pdf.groupby("key")["step"].apply(sorted).tolist() == [list(range(1, 7))] * 4
        short = pdf[pdf["key"].str.startswith("few")]
        assert set(short["status"]) == {"short"} and set(pdf["status"]) == {"short", "fitted"}
        assert np.ptp(short[short["key"] == "few_a"]["forecast"]) == 0
    trend = forecasting.trend_fourier(both, ["key"], "ts", "value", 5).toPandas()
    assert trend.groupby("key").size().to_dict() == {"a": 125, "b": 125, "few_a": 9, "few_b": 9}
    only_short = forecasting.forecast_race(few, ["key"], "ts", "value", 6)
    assert only_short.count() == 12


def test_autoregression_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    y = np.cumsum(rng.normal(size=60)) + 3 * np.sin(np.arange(60) * 2 * np.pi / 7)
    df = spark.createDataFrame(pd.DataFrame({"key": "a", "ts": pd.date_range("2024-01-01", periods=60), "value": y}))
    for n, season in ((60, 7), (12, 7), (60, 1)):
        part = df.orderBy("ts").limit(n)
        got = forecasting.seasonal_ar(part, ["key"], "ts", "value", 20, season=season).toPandas().sort_values("step")
        change = np.diff(y[:n])
        lags = [1, season] if n > 2 * season and season > 1 else [1]
        first = max(lags)
        past = np.column_stack([np.ones(n - 1 - first), *[change[first - k : n - 1 - k] for k in lags]])
        coef = np.linalg.lstsq(past, change[first:], rcond=None)[0]
        steps, level, want = list(change), y[n - 1], []
        for _ in range(20):
            steps.append(coef[0] + sum(c * steps[-k] for c, k in zip(coef[1:], lags)))
            level += steps[-1]
            want.append(level)
        assert np.allclose(got["forecast"], want)
        spread = np.std(change[first:] - past @ coef)
        assert np.allclose(got["upper"] - got["forecast"], 1.96 * spread * np.sqrt(np.arange(1, 21)))


def test_steps_are_checked(spark):
    import pytest

    with pytest.raises(ValueError):
        timeseries.future_steps(sine(spark), ["key"], "ts", 3, "1 day) OR (1=1")


def test_both_recursions_agree(spark):
    df, _ = gappy(spark, 5)
    model = forecasting.fit_lag_model(df, ["key"], "ts", "value")
    a = forecasting.lag_forecast(df, ["key"], "ts", "value", 8, model=model).toPandas().sort_values(["key", "step"])
    b = forecasting.lag_forecast_linear(df, ["key"], "ts", "value", 8, model=model).toPandas().sort_values(["key", "step"])
    assert np.allclose(a["forecast"], b["forecast"])


def test_race_and_trend(spark):
    df = sine(spark)
    race = forecasting.forecast_race(df, ["key"], "ts", "value", 7).toPandas()
    assert race[["lower", "upper"]].notna().all().all() and (race["lower"] <= race["upper"]).all()
    assert len(race) == 14 and (race["mae"] < 0.5).all() and race.groupby("key")["model"].nunique().eq(1).all()
    out = forecasting.trend_fourier(df, ["key"], "ts", "value", 30).toPandas()
    assert out["is_future"].sum() == 60 and len(out) == 300
    assert (out["yhat_lower"] <= out["yhat"]).all() and (out["yhat"] <= out["yhat_upper"]).all()


def test_boosted_recursion_equals_the_model(spark):
    """The trees' nodes give what the model itself gives step by step."""
    df, _ = gappy(spark, 5)
    model = forecasting.fit_lag_model(df, ["key"], "ts", "value", GBTRegressor(maxIter=5, maxDepth=4, seed=1))
    a = forecasting.lag_forecast(df, ["key"], "ts", "value", 8, model=model).toPandas().sort_values(["key", "step"])
    b = forecasting.lag_forecast_boosted(df, ["key"], "ts", "value", 8, model=model).toPandas().sort_values(["key", "step"])
    assert len(a) and np.allclose(a["forecast"], b["forecast"])


def test_bands_are_ranks_of_errors(spark):
    draw = np.random.default_rng(8)
    rows = [(k, float(abs(e))) for k, n in (("a", 400), ("b", 19), ("c", 5)) for e in draw.normal(size=n)] + [("a", None)]
    frame = spark.createDataFrame(rows, "k string, error double")
    got = {r["k"]: r["band"] for r in forecasting.error_bands(frame, ["k"]).collect()}
    for k, place in (("a", 381), ("b", 19), ("c", 5)):
        assert got[k] == sorted(e for g, e in rows if g == k and e is not None)[place - 1]
    assert forecasting.error_bands(frame.filter("false"), ["k"]).count() == 0


def test_bands_cover_the_future(spark):
    """Noise about a weekly pattern, 40 series: some 95 % of what comes later lies in the bands."""
    draw = np.random.default_rng(11)
    days, ahead = 150, 14
    value = 50 + 10 * np.sin(2 * np.pi * np.arange(days + ahead) / 7) + draw.normal(size=(40, days + ahead))
    at = pd.date_range("2024-01-01", periods=days + ahead)
    whole = pd.concat([pd.DataFrame({"key": f"s{i}", "ts": at, "value": v}) for i, v in enumerate(value)])
    past = spark.createDataFrame(whole[whole["ts"] < at[days]]).repartition(4)
    for name in ("seasonal_naive", "lag_regression"):
        made = forecasting.forecast_race(past, ["key"], "ts", "value", ahead, names=[name]).toPandas()
        assert len(made) == 40 * ahead and (made["lower"] < made["forecast"]).all()
        met = made.merge(whole, on=["key", "ts"])
        inside = ((met["value"] >= met["lower"]) & (met["value"] <= met["upper"])).mean()
        assert len(met) == 40 * ahead and 0.9 < inside < 0.99, (name, inside)


def test_frequency_of_irregular_series_is_a_day(spark):
    df, _ = gappy(spark, 2)
    assert {(r["regular"], r["seconds"]) for r in timeseries.infer_frequency(df, ["key"], "ts").collect()} == {(False, 86400)}
    hours = spark.range(5).select(F.lit("x").alias("key"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 6 * id)")).alias("ts"))
    assert timeseries.infer_frequency(hours, ["key"], "ts").first()["seconds"] == 21600


def steps(spark, n, key="a", skip=0, made="0, 0, 0, id"):
    at = (F.lit("2020-01-01").cast("timestamp_ntz") + F.expr(f"make_dt_interval({made})")).alias("ts")
    value = F.when((F.col("id") % 97 != 5) & ((F.col("id") < skip) | (F.col("id") > 2 * skip)), F.sin("id") * 10).alias("value")
    return spark.range(n).select(F.lit(key).alias("key"), at, value)


def test_parts_change_nothing(spark, monkeypatch):
    """Ranges of five positions: every gap, lag and season crosses borders of parts."""
    df, _ = gappy(spark, 6)
    df = df.unionByName(steps(spark, 60, None, 14, "0, id")).cache()

    def results():
        grid = timeseries.regularize(df, ["key"], "ts", "value", "1 hour").cache()
        filled = timeseries.interpolate_gaps(grid, ["key"], "ts", "value", step="1 hour").cache()
        made = (
            grid, filled, timeseries.interpolate_gaps(grid, ["key"], "ts", "value", drop=False), timeseries.lag_features(filled, ["key"], "ts", "value"),
            timeseries.lag_features(filled, ["key"], "ts", "value", step="1 hour"), timeseries.time_split(filled, ["key"], "ts", 4),
            timeseries.backtest_naive(filled, ["key"], "ts", "value", (1, 7), 4), forecasting.seasonal_ar(filled, ["key"], "ts", "value", 4, "1 hour", 9),
        )
        rounded = [m.select(*[F.round(c, 7).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes]) for m in made]
        return [sorted(map(repr, m.collect())) for m in rounded]

    whole = results()
    monkeypatch.setattr(timeseries, "RANGE_ROWS", 5)
    monkeypatch.setattr(timeseries, "_FAN", 3)
    assert results() == whole and whole[4] == whole[3] and len(whole[1]) > 100


def test_calendars_of_months_and_of_short_days(spark):
    first = spark.sql("SELECT 'a' AS key, TIMESTAMP_NTZ'2024-01-31 00:00:00' AS ts, 1.0D AS value UNION ALL SELECT 'a', TIMESTAMP_NTZ'2024-06-30 00:00:00', 6.0D")
    got = [str(r["ts"])[:10] for r in timeseries.regularize(first, ["key"], "ts", "value", "1 month").orderBy("ts").collect()]
    assert got == ["2024-01-31", "2024-02-29", "2024-03-31", "2024-04-30", "2024-05-31", "2024-06-30"]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        local = spark.sql("SELECT 'a' AS key, explode(sequence(TIMESTAMP'2024-03-29', TIMESTAMP'2024-11-02', INTERVAL 1 DAY)) AS ts")
        local = local.withColumn("value", F.when(F.dayofmonth("ts") != 31, F.dayofyear("ts").cast("double")))
        grid = timeseries.regularize(local, ["key"], "ts", "value", "1 day")
        assert grid.count() == local.count()
        filled = timeseries.interpolate_gaps(grid, ["key"], "ts", "value", step="1 day")
        assert filled.filter(F.abs(F.col("value") - F.dayofyear("ts")) > 1e-9).count() == 0 and filled.count() == local.count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_many_short_calendars_are_unfolded_in_many_tasks(spark, monkeypatch):
    """The few rows a calendar starts from don't decide in how many tasks it is unfolded."""
    monkeypatch.setattr(timeseries, "GRID_ROWS", 30_000, raising=False)
    ends = spark.range(300).select(F.col("id").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(999), F.lit(999))).alias("h"))
    ends = ends.select("key", (F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_interval(0, 0, 0, 0, h)")).alias("ts"), F.lit(1.0).alias("value"))
    grid = timeseries.regularize(ends, ["key"], "ts", "value", "1 hour")
    held = grid.groupBy(F.spark_partition_id()).agg(F.count("ts").alias("n"), F.count("value").alias("known"))
    held = held.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("known").alias("known")).first()
    assert held["n"] == 300_000 and held["known"] == 600 and held["most"] < 100_000


def test_one_long_series_is_never_in_one_task(spark):
    """Ten million points of a single series: what any task holds is a few parts of it."""
    ends = steps(spark, 1).unionByName(steps(spark, 10_000_001).filter("ts = TIMESTAMP_NTZ'2020-04-25 17:46:40'"))
    grid = timeseries.regularize(ends, ["key"], "ts", "value", "1 second")
    known = F.when(F.unix_micros(F.col("ts").cast("timestamp")) % 7_000_000 < 4_000_000, F.second("ts").cast("double"))
    filled = timeseries.interpolate_gaps(grid.withColumn("value", known), ["key"], "ts", "value", step="1 second")
    lagged = timeseries.lag_features(filled, ["key"], "ts", "value", step="1 second")
    held = lagged.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count("lag_14").alias("lagged"))
    held = held.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("lagged").alias("lagged")).first()
    assert held["n"] == 10_000_001 and held["n"] - held["lagged"] == 14 and held["most"] < held["n"] / 3
    plan = lagged._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # windows by the series alone run over one row per part, or one total per range of time
    assert windows and all("__part" in w or "__bucket" in w or "r__n" in w for w in windows)
    assert plan.count("explode(sequence(") == 3 and "least(2047" in plan


def plain_trend(y, days, clock, changes, seasons, horizon, ridge=1.0):
    """The same model by one design matrix."""
    span, n = days[-1], len(y)
    days, clock = (np.r_[x, x[-1] + np.arange(1, horizon + 1)] for x in (days, clock))
    t, knots = days / span, np.linspace(0, 0.8, min(changes, n // 3) + 2)[1:-1]
    columns = [np.ones_like(t), t, *[np.maximum(t - k, 0) for k in knots]]
    for period, order in seasons:
        columns += [f(2 * np.pi * i * clock / period) for i in range(1, order + 1) for f in (np.sin, np.cos)]
    x = np.column_stack(columns)
    penalty = np.diag([1e-9, 1e-9] + [ridge] * (x.shape[1] - 2))
    scaled = (y - y.mean()) / y.std()
    fitted = y.mean() + y.std() * (x @ np.linalg.solve(x[:n].T @ x[:n] + penalty, x[:n].T @ scaled))
    return fitted, 1.2816 * np.std(y - fitted[:n])


def test_trend_from_sums_equals_one_matrix(spark, monkeypatch):
    monkeypatch.setattr(timeseries, "RANGE_ROWS", 50)
    monkeypatch.setattr(forecasting, "_HELD", 1)
    rng = np.random.default_rng(3)
    frames, kinds = [], {"long": (800, "D"), None: (60, "D"), "hours": (120, "h"), "flat": (40, "D")}
    for key, (n, unit) in kinds.items():
        at = pd.date_range("2021-03-04", periods=n, freq=unit)
        y = np.cumsum(rng.normal(size=n)) + 3 * np.sin(np.arange(n) / 3) if key != "flat" else np.full(n, 2.0)
        frames.append(pd.DataFrame({"key": key, "ts": at, "value": y}))
    df = spark.createDataFrame(pd.concat(frames)).repartition(7)
    out = forecasting.trend_fourier(df, ["key"], "ts", "value", 9).toPandas()
    plan = forecasting.trend_fourier(df, ["key"], "ts", "value", 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan
    seasons = {"long": [(365.25, 10), (7.0, 3)], None: [(7.0, 3)], "hours": [(1.0, 4)]}
    for frame in frames:
        key = frame["key"].iloc[0]
        mine = out[out["key"].isna() if key is None else out["key"] == key].sort_values("ts")
        assert mine["is_future"].tolist() == [False] * len(frame) + [True] * 9
        if key == "flat":
            assert np.allclose(mine["yhat"], 2.0)
            continue
        clock = ((frame["ts"] - pd.Timestamp("1970-01-01")) / pd.Timedelta(days=1)).to_numpy()
        want, band = plain_trend(frame["value"].to_numpy(), clock - clock[0], clock, 25, seasons[key], 9)
        assert np.allclose(mine["yhat"], want, atol=1e-6) and np.allclose(mine["yhat_upper"] - mine["yhat"], band, atol=1e-6)
