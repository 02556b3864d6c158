"""Time-series preparation, baselines and the as-of join."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import relational, timeseries as ts
from tablewright.workload import query, table

HOURLY = """SELECT event_type, date_trunc('hour', ts) AS ts, value FROM events"""
USER_HOURLY = """SELECT user_id, date_trunc('hour', ts) AS ts, value FROM events"""
DAILY = """SELECT o_orderstatus, o_orderdate AS ts, o_totalprice AS value FROM orders"""
STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


def hourly(spark, sf, key="event_type"):
    return table(spark, sf, "events").select(
        key, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "value"
    )


def daily(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderstatus", F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value")
    )


def stamped(df, *rounded, digits=9):
    out = df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return out.withColumns({c: F.round(c, digits) for c in rounded}) if rounded else out


def regular_sql(frame: str, key: str, step: str) -> str:
    return f"""p AS (SELECT {key}, ts, avg(value) AS value FROM ({frame}) GROUP BY ALL),
    s AS (SELECT {key}, unnest(generate_series(lo, hi, INTERVAL {step})) AS ts FROM (SELECT {key}, min(ts) AS lo, max(ts) AS hi FROM p GROUP BY ALL)),
    g AS (SELECT s.{key}, s.ts, p.value FROM s LEFT JOIN p ON s.{key} = p.{key} AND s.ts = p.ts)"""


def filled_sql(frame: str, key: str, step: str) -> str:
    return f"""{regular_sql(frame, key, step)},
    i AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts) AS i FROM g),
    j AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi,
      first_value(value IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni FROM i
      WINDOW b AS (PARTITION BY {key} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        a AS (PARTITION BY {key} ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    f AS (SELECT {key}, ts, value FROM (SELECT {key}, ts, CASE WHEN value IS NOT NULL THEN value
      WHEN i - pi <= 5 THEN coalesce(pv + (nv - pv) * (i - pi) / (ni - pi), pv) END AS value FROM j) WHERE value IS NOT NULL)"""


def filled(df, key, step):
    grid = ts.regularize(df, [key], "ts", "value", step)
    return ts.interpolate_gaps(grid, [key], "ts", "value", step=step)


@query("regularize_series", f"WITH {regular_sql(HOURLY, 'event_type', '1 hour')} SELECT event_type, {STAMP}, round(value, 9) AS value FROM g")
def regularize_series(spark, sf):
    return stamped(ts.regularize(hourly(spark, sf), ["event_type"], "ts", "value", "1 hour"), "value")


@query("interpolate_gaps", f"WITH {filled_sql(USER_HOURLY, 'user_id', '1 hour')} SELECT user_id, {STAMP}, round(value, 9) AS value FROM f")
def interpolate_gaps(spark, sf):
    return stamped(filled(hourly(spark, sf, "user_id"), "user_id", "1 hour"), "value")


@query(
    "infer_frequency",
    """WITH t AS (SELECT concat('hour ', event_type) AS series, date_trunc('hour', ts) AS ts FROM events
      UNION SELECT concat('day ', o_orderstatus), o_orderdate FROM orders
      UNION SELECT concat('month ', o_orderstatus), date_trunc('month', o_orderdate) FROM orders
      UNION SELECT concat('week ', o_orderstatus), date_trunc('week', o_orderdate) FROM orders),
    d AS (SELECT series, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS us, datediff('month', lag(ts) OVER w, ts) AS mo, day(ts) AS dd FROM t
      WINDOW w AS (PARTITION BY series ORDER BY ts)),
    c AS (SELECT series, count(*) AS points, count(DISTINCT us) AS k, min(us) AS us, count(DISTINCT mo) AS mk, min(mo) AS mo, count(DISTINCT dd) AS dk FROM d GROUP BY 1)
    SELECT series, points, points >= 3 AND (k = 1 OR (mk = 1 AND mo > 0 AND dk = 1)) AS regular,
    CASE WHEN points >= 3 AND k <> 1 AND mk = 1 AND mo > 0 AND dk = 1 THEN mo END AS months,
    CASE WHEN points >= 3 AND k = 1 THEN us // 1000000 WHEN points >= 3 AND mk = 1 AND mo > 0 AND dk = 1 THEN NULL ELSE 86400 END AS seconds FROM c""",
)
def infer_frequency(spark, sf):
    events, orders = table(spark, sf, "events"), table(spark, sf, "orders")

    def part(df, word, key, at):
        return df.select(F.concat(F.lit(word + " "), F.col(key)).alias("series"), at.cast("timestamp_ntz").alias("ts"))

    frame = part(events, "hour", "event_type", F.date_trunc("hour", "ts"))
    for unit in ("day", "month", "week"):
        frame = frame.unionByName(part(orders, unit, "o_orderstatus", F.date_trunc(unit, "o_orderdate")))
    return ts.infer_frequency(frame, ["series"], "ts")


LAGGED = ", ".join(f"lag(value, {n}) OVER w AS lag_{n}" for n in ts.LAGS)


@query(
    "lag_features",
    f"""WITH {filled_sql(HOURLY, 'event_type', '1 hour')}, l AS (SELECT event_type, ts, value, {LAGGED},
      avg(value) OVER r AS rolling_mean_7, stddev_samp(value) OVER r AS rolling_std_7, month(ts) AS month, isodow(ts) - 1 AS dow FROM f
      WINDOW w AS (PARTITION BY event_type ORDER BY ts), r AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
    SELECT event_type, {STAMP}, round(value, 9) AS value, {', '.join(f'round(lag_{n}, 9) AS lag_{n}' for n in ts.LAGS)},
    round(rolling_mean_7, 9) AS rolling_mean_7, round(rolling_std_7, 9) AS rolling_std_7, month, dow FROM l""",
)
def lag_features(spark, sf):
    lagged = ts.lag_features(filled(hourly(spark, sf), "event_type", "1 hour"), ["event_type"], "ts", "value", step="1 hour")
    rounded = ["value", *[f"lag_{n}" for n in ts.LAGS], "rolling_mean_7", "rolling_std_7"]
    return stamped(lagged, *rounded)


SPLIT = """n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY event_type) AS n FROM f),
    x AS (SELECT event_type, ts, value, CASE WHEN back <= greatest(floor(n * 0.2), 24) THEN 'test' ELSE 'train' END AS split FROM n)"""


@query(
    "time_split",
    f"WITH {filled_sql(HOURLY, 'event_type', '1 hour')}, {SPLIT} SELECT event_type, {STAMP}, round(value, 9) AS value, split FROM x",
)
def time_split(spark, sf):
    series = filled(hourly(spark, sf), "event_type", "1 hour")
    return stamped(ts.time_split(series, ["event_type"], "ts", 24, step="1 hour"), "value")


@query(
    "seasonal_naive",
    f"""WITH {filled_sql(HOURLY, 'event_type', '1 hour')}, t AS (SELECT event_type, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM f),
    l AS (SELECT event_type, max(ts) AS last FROM f GROUP BY 1), h AS (SELECT unnest(generate_series(1, 48)) AS step)
    SELECT l.event_type, strftime(last + step * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS ts, CAST(step AS INTEGER) AS step, round(t.value, 9) AS forecast
    FROM l, h JOIN t ON t.event_type = l.event_type AND t.r = 24 - (h.step - 1) % 24""",
)
def seasonal_naive(spark, sf):
    series = filled(hourly(spark, sf), "event_type", "1 hour")
    out = ts.seasonal_naive(series, ["event_type"], "ts", "value", 24, 48, "1 hour")
    return stamped(out, "forecast")


@query(
    "forecast_tail",
    f"""WITH {filled_sql(DAILY, 'o_orderstatus', '1 day')}, q AS (SELECT o_orderstatus, ts, value, row_number() OVER (PARTITION BY o_orderstatus ORDER BY ts DESC) AS r,
      max(ts) OVER (PARTITION BY o_orderstatus) AS last FROM f), k AS (SELECT o_orderstatus, last + (8 - r) * INTERVAL 1 DAY AS ts, value FROM q WHERE r <= 7)
    SELECT o_orderstatus, {STAMP}, round(value, 9) AS forecast FROM k ORDER BY ts DESC, o_orderstatus LIMIT 15""",
)
def forecast_tail(spark, sf):
    out = ts.seasonal_naive(filled(daily(spark, sf), "o_orderstatus", "1 day"), ["o_orderstatus"], "ts", "value", 7, 7)
    tail = out.orderBy(F.desc("ts"), "o_orderstatus").limit(15)
    return stamped(tail, "forecast").drop("step")


@query(
    "backtest_mae",
    f"""WITH {filled_sql(HOURLY, 'event_type', '1 hour')}, {SPLIT},
    k AS (SELECT *, row_number() OVER (PARTITION BY event_type, split ORDER BY ts DESC) AS back, row_number() OVER (PARTITION BY event_type, split ORDER BY ts) AS forth FROM x),
    e AS (SELECT a.event_type, m.season, abs(a.value - b.value) AS err FROM k a, (VALUES (1), (24), (168)) m(season), k b
      WHERE a.split = 'test' AND b.split = 'train' AND a.event_type = b.event_type AND b.back = m.season - (a.forth - 1) % m.season)
    SELECT event_type, season, round(avg(err), 8) AS mae, count(*) AS points FROM e GROUP BY 1, 2""",
)
def backtest_mae(spark, sf):
    series = filled(hourly(spark, sf), "event_type", "1 hour")
    out = ts.backtest_naive(series, ["event_type"], "ts", "value", (1, 24, 168), 24, "1 hour")
    return out.withColumn("mae", F.round("mae", 8))


@query(
    "trend_linear",
    f"""WITH {regular_sql(DAILY, 'o_orderstatus', '1 day')}, x AS (SELECT o_orderstatus, ts, value, epoch_us(ts) / 86400000000 AS d FROM p),
    o AS (SELECT o_orderstatus, min(d) AS d0, max(ts) AS last FROM x GROUP BY 1),
    r AS (SELECT x.o_orderstatus, regr_slope(value, d - d0) AS slope, regr_intercept(value, d - d0) AS intercept, any_value(d0) AS d0, any_value(last) AS last
      FROM x JOIN o ON x.o_orderstatus = o.o_orderstatus GROUP BY 1)
    SELECT o_orderstatus, strftime(last + step * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS ts, CAST(step AS INTEGER) AS step, round(slope, 4) AS slope, round(intercept, 2) AS intercept,
    round(intercept + slope * (epoch_us(last + step * INTERVAL 1 DAY) / 86400000000 - d0), 2) AS forecast FROM r, (SELECT unnest(generate_series(1, 30)) AS step)""",
)
def trend_linear(spark, sf):
    points = ts.mean_per_timestamp(daily(spark, sf), ["o_orderstatus"], "ts", "value")
    out = ts.linear_trend(points, ["o_orderstatus"], "ts", "value", 30)
    return stamped(out.withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 2)}), "forecast", digits=2)


@query(
    "asof_join",
    """SELECT p.event_id, p.user_id, v.event_id AS asof_event_id, v.value AS asof_value, strftime(v.ts, '%Y-%m-%d %H:%M:%S') AS asof_ts
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
    ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def asof_join(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value", "event_type")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'view'")
    out = relational.asof_join(left, right, ["user_id"], "ts", ["event_id", "value"])
    out = out.withColumn("asof_ts", F.date_format("asof_ts", "yyyy-MM-dd HH:mm:ss"))
    return out.select("event_id", "user_id", "asof_event_id", "asof_value", "asof_ts")


@query(
    "asof_join_nulls",
    """WITH e AS (SELECT event_id, nullif(user_id % 7, 0) AS k, CASE WHEN event_id % 11 <> 0 THEN ts END AS ts, value, event_type FROM events)
    SELECT p.event_id, v.value AS asof_value, v.n AS asof_n
    FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN
    (SELECT k, ts, max(value) AS value, count(*) AS n FROM e WHERE event_type = 'view' AND k IS NOT NULL AND ts IS NOT NULL GROUP BY k, ts) v
    ON p.k = v.k AND p.ts >= v.ts""",
)
def asof_join_nulls(spark, sf):
    """Rows without a key or a time, on either side, and keys of a seventh of all rows."""
    events = table(spark, sf, "events").select(
        "event_id", F.expr("nullif(user_id % 7, 0)").alias("k"), F.expr("CASE WHEN event_id % 11 <> 0 THEN ts END").alias("ts"), "value", "event_type"
    )
    left = events.filter("event_type = 'purchase'").select("event_id", "k", "ts")
    right = events.filter("event_type = 'view'").groupBy("k", "ts").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return relational.asof_join(left, right, ["k"], "ts", ["value", "n"]).select("event_id", "asof_value", "asof_n")
