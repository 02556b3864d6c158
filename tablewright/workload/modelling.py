"""Training, scoring, forecasting and whole runs."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.functions.text import words
from tablewright.operators import ensembles, explain, forecasting, models, sampling
from tablewright.operators.ranking import seeded_hash
from tablewright.plans import autopilot, batch
from tablewright.session import cut, scratch
from tablewright.sources.readers import run_history
from tablewright.streaming.scoring import score_stream
from tablewright.workload import query, table
from tablewright.workload.evaluation import LINE_TIES
from tablewright.workload.inference import TABLES
from tablewright.workload.preparation import hash_sql
from tablewright.workload.series import DAILY, HOURLY, STAMP, daily, filled, filled_sql, hourly, stamped


def document_quality(spark, sf):
    """Labelled documents with their size, language, source and quality."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.size(words(F.col("text"))).alias("n_words"), "lang", "source"
    )
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


def quality_task(spark, sf):
    df = document_quality(spark, sf)
    return models.prepare_task(df, "quality", "binary", seeded_hash(F.col("doc_id")), ["doc_id"])


@query("leaderboard")
def leaderboard(spark, sf):
    task = quality_task(spark, sf)
    return models.leaderboard_frame(spark, models.train_leaderboard(task, models.candidate_models("binary")), task.problem)


@query("leaderboard_regression")
def leaderboard_regression(spark, sf):
    columns = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice"]
    task = models.prepare_task(table(spark, sf, "lineitem").select(*columns), "l_extendedprice", "regression")
    board = models.train_leaderboard(task, models.candidate_models("regression"))
    return models.leaderboard_frame(spark, board, "regression")


@query("evaluate_holdout")
def evaluate_holdout(spark, sf):
    task = quality_task(spark, sf)
    best = models.train_leaderboard(task)[0]
    _, report = models.evaluate(task, best.model)
    return report


@query("feature_importance")
def feature_importance(spark, sf):
    task = quality_task(spark, sf)
    forest = models.candidate_models("binary")["RandomForest"].fit(task.part("train"))
    shares = models.tree_importance(forest, task.spec.names, [*task.spec.numeric, *task.spec.categorical])
    impurity = spark.createDataFrame(list(shares.items()), "feature string, impurity double")
    drops = autopilot.model_importance(task, forest)
    return drops.join(impurity, "feature", "full").orderBy(F.desc("importance"), "feature")


@query("stacked_ensemble")
def stacked_ensemble(spark, sf):
    task = quality_task(spark, sf)
    predict, _ = models.stacked_ensemble(task)
    found = models.scores(predict(task.part("test")), task.problem)
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "metric string, value double")


# rules of thumb for the price of a line, rounded so that both engines add up the same numbers
PRICE_RULES = {
    "by_quantity": "l_quantity * 1500.0",
    "flat": "l_quantity * 0.0 + 38000.0",
    "by_tax": "30000.0 + l_tax * 200000.0",
    "steep": "l_quantity * 2600.0 - 9000.0",
}


def _ensemble_sql(rules: dict[str, str], rounds: int) -> str:
    """Greedy choice over the products of the rules' errors, one step of a recursion per round."""
    n = len(rules)
    errors = ", ".join(f"{rule} - l_extendedprice AS e{i}" for i, rule in enumerate(rules.values()))
    products = ", ".join(f"avg(e{i} * e{j}) AS g{i}_{j}" for i in range(n) for j in range(n))

    def tried(more: int) -> str:
        w = [f"(w{i} + {int(i == more)})" for i in range(n)]
        total = " + ".join(f"{w[i]} * {w[j]} * g{i}_{j}" for i in range(n) for j in range(n))
        return f"sqrt(({total}) / ((r + 1.0) * (r + 1.0)))"

    found = "[" + ", ".join(f"round({tried(i)}, 7)" for i in range(n)) + "]"
    uses = ", ".join(f"w{i} + CAST(list_position(s, list_min(s)) = {i + 1} AS INTEGER) AS w{i}" for i in range(n))
    names = " UNION ALL ".join(
        f"SELECT '{name}' AS model, w{i} AS uses, round(w{i} / r, 9) AS weight, round(sqrt(g{i}_{i}), 4) AS own_rmse, round(score, 4) AS ensemble_rmse FROM kept, g"
        for i, name in enumerate(rules)
    )
    return f"""WITH RECURSIVE e AS (SELECT {errors} FROM lineitem), g AS (SELECT {products} FROM e),
    t AS (SELECT 0 AS r, {', '.join(f'0 AS w{i}' for i in range(n))}, CAST(NULL AS DOUBLE) AS score
      UNION ALL SELECT r + 1 AS r, {uses}, list_min(s) AS score FROM (SELECT t.*, {found} AS s FROM t, g WHERE r < {rounds})),
    kept AS (SELECT * FROM t WHERE r > 0 ORDER BY score, r LIMIT 1) {names}"""


@query("ensemble_weights", _ensemble_sql(PRICE_RULES, ensembles.ROUNDS))
def ensemble_weights(spark, sf):
    """How much each rule of thumb counts in the ensemble that is chosen from them."""
    lines = table(spark, sf, "lineitem")
    views = {name: F.array(F.expr(rule).cast("double")) for name, rule in PRICE_RULES.items()}
    found = ensembles.choose(lines, views, "rmse", "l_extendedprice")
    own = ensembles.view_scores(lines, views, "rmse", "l_extendedprice")
    rows = [(n, found.uses[n], round(found.weights[n], 9), round(own[n], 4), round(found.score, 4)) for n in views]
    return spark.createDataFrame(rows, "model string, uses int, weight double, own_rmse double, ensemble_rmse double")


@query("bagged_ensemble")
def bagged_ensemble(spark, sf):
    """Bags in two levels and what each counts in the ensemble."""
    return ensembles.bagged_ensemble(quality_task(spark, sf), metric="log_loss").frame(spark)


@query("goal_search")
def goal_search(spark, sf):
    rows, best = models.goal_search(quality_task(spark, sf), trials=8)
    table_rows = [(r["trial"], r["trees"], r["depth"], r["score"], r["score"] >= best["target_score"]) for r in rows]
    return spark.createDataFrame(table_rows, "trial int, trees int, depth int, score double, goal_met boolean")


@query("mlp")
def mlp(spark, sf):
    vectors = table(spark, sf, "embeddings")
    dims = len(vectors.select("embedding").first()[0])
    wide = vectors.select("vec_id", *[F.col("embedding")[i].alias(f"e{i}") for i in range(dims)], F.col("label").cast("string").alias("label"))
    task = models.prepare_task(wide, "label", "multiclass", seeded_hash(F.col("vec_id")), ["vec_id"])
    model = models.network(len(task.spec.names), len(task.labels), epochs=80).fit(task.part("train"))
    found, _ = models.evaluate(task, model)
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "metric string, value double")


@query(
    "shap_sampled",
    f"""WITH r AS (SELECT event_id, value, user_id FROM events ORDER BY {hash_sql('event_id', 1)}, event_id LIMIT 100),
    b AS (SELECT avg(value) AS v, avg(user_id) AS u FROM (SELECT value, user_id FROM events ORDER BY {hash_sql('event_id', 2)}, event_id LIMIT 50))
    SELECT event_id, 'value' AS feature, round(2 * (value - v), 6) AS phi FROM r, b UNION ALL SELECT event_id, 'user_id', round(-0.5 * (user_id - u), 6) FROM r, b""",
)
def shap_sampled(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value", "user_id")
    key = F.col("event_id")
    rows = sampling.sample_rows(events, 100, seeded_hash(key, 1), ["event_id"])
    base = sampling.sample_rows(events, 50, seeded_hash(key, 2), ["event_id"])
    basis = [(r["value"], r["user_id"]) for r in base.collect()]
    packed = rows.select("event_id", F.array(F.col("value"), F.col("user_id").cast("double")).alias("x"))

    def predict(df):
        return df.withColumn("s", 2.0 * F.col("x")[0] - 0.5 * F.col("x")[1])

    out = explain.sampled_shap(packed, ["event_id"], ["value", "user_id"], basis, [(0, 1), (1, 0)], predict, F.col("s"))
    return out.withColumn("phi", F.round("phi", 6))


@query("shap_model")
def shap_model(spark, sf):
    task = quality_task(spark, sf)
    model = models.candidate_models("binary")["LogisticRegression"].fit(task.part("train"))
    return autopilot.explain_model(task, model)


def price_model(spark, sf):
    """Price by quantity: a linear pipeline over the whole table, and its description."""
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    spec = models.fit_features(lines, "l_extendedprice", dates=[])
    ready = PipelineModel(spec.stages).transform(lines)
    line = LinearRegression(featuresCol=models.FEATURES, labelCol="l_extendedprice").fit(ready)
    meta = {"target": "l_extendedprice", "problem_type": "regression", "best_model": "Linear", "dropped": []}
    return PipelineModel([*spec.stages, line]), meta


PRICED = """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, round(b + a * l_quantity, 4) AS prediction FROM lineitem, f"""


@query("score_batch", PRICED)
def score_batch(spark, sf):
    """Train, save, load, score every row."""
    pipeline, meta = price_model(spark, sf)
    folder = scratch(spark)
    models.save_bundle(pipeline, meta, folder)
    loaded, known = models.load_bundle(spark, folder)
    rows = table(spark, sf, "lineitem").select(*LINE_TIES[:5], "l_extendedprice")
    return models.score(loaded, rows, known).withColumn("prediction", F.round("prediction", 4))


@query("score_stream", PRICED)
def stream_scores(spark, sf):
    """The same model over the table as a stream of files."""
    pipeline, meta = price_model(spark, sf)
    folder = scratch(spark)
    rows = table(spark, sf, "lineitem").select(*LINE_TIES[:5], "l_extendedprice")
    # as many files as the table has splits, so a task's share doesn't grow with the table; half of them per batch
    files = max(4, rows.rdd.getNumPartitions())
    rows.repartition(files).write.parquet(f"{folder}/in")
    out = score_stream(spark, pipeline, meta, f"{folder}/in", rows.schema, f"{folder}/out", f"{folder}/state", -(-files // 2))
    return out.withColumn("prediction", F.round("prediction", 4))


@query("run_history", "SELECT 'Linear (regression)' AS label, (SELECT count(*) FROM lineitem) AS scored")
def history(spark, sf):
    pipeline, meta = price_model(spark, sf)
    folder = scratch(spark)
    models.save_bundle(pipeline, meta, f"{folder}/price")
    scored = table(spark, sf, "lineitem").count()
    return run_history(spark, folder).select("label", F.lit(scored).alias("scored"))


@query("autopilot_run")
def autopilot_run(spark, sf):
    folder = scratch(spark)
    return autopilot.run(document_quality(spark, sf), "quality", folder=folder)


@query("review_steps")
def review_steps(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return autopilot.review(df, "l_linestatus", "binary_classification")


@query("batch_run")
def batch_run(spark, sf):
    """Registry of all tables with all columns, and a run with the library's default candidates."""
    tables = {t: table(spark, sf, t) for t in TABLES}
    registry = batch.build_registry(spark, tables, "retail")
    return batch.run_batch(spark, registry, tables.__getitem__).drop("seconds")


@query(
    "seasonal_ar",
    f"""WITH RECURSIVE {filled_sql(HOURLY, 'event_type', '1 hour')},
    a AS (SELECT *, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS c FROM f),
    b AS (SELECT *, lag(c) OVER w AS x, lag(c, 24) OVER w AS s, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM a
      WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    m AS (SELECT event_type, avg(c) AS my, avg(x) AS mx, avg(s) AS ms, var_pop(x) AS xx, var_pop(s) AS ss, covar_pop(x, s) AS xs,
      covar_pop(x, c) AS xy, covar_pop(s, c) AS sy, var_pop(c) AS yy FROM b WHERE s IS NOT NULL AND x IS NOT NULL GROUP BY 1),
    k AS (SELECT *, (ss * xy - xs * sy) / (ss * xx - xs * xs) AS c1, (xx * sy - xs * xy) / (ss * xx - xs * xs) AS c2 FROM m),
    z AS (SELECT *, my - c1 * mx - c2 * ms AS c0, sqrt(yy - c1 * xy - c2 * sy) AS spread FROM k),
    h AS (SELECT event_type, ts AS last, 0 AS step, value AS level, c AS moved FROM b WHERE r = 1
      UNION ALL SELECT h.event_type, last, step + 1, level + c0 + c1 * moved + c2 * b.c, c0 + c1 * moved + c2 * b.c
      FROM h JOIN z ON h.event_type = z.event_type JOIN b ON b.event_type = h.event_type AND b.r = 24 - step WHERE step < 24)
    SELECT h.event_type, strftime(last + step * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS ts, step, round(level, 6) AS forecast,
      round(level - 1.96 * spread * sqrt(step), 6) AS lower, round(level + 1.96 * spread * sqrt(step), 6) AS upper, 'fitted' AS status
    FROM h JOIN z ON h.event_type = z.event_type WHERE step > 0""",
)
def seasonal_ar(spark, sf):
    series = filled(hourly(spark, sf), "event_type", "1 hour")
    return stamped(forecasting.seasonal_ar(series, ["event_type"], "ts", "value", 24, "1 hour"), "forecast", "lower", "upper", digits=6)


SHORT_AND_LONG = "SELECT event_type, ts, value FROM f UNION ALL SELECT concat(event_type, '_short') AS event_type, ts, value FROM q WHERE r <= 9"


@query(
    "forecast_race_short",
    f"""WITH {filled_sql(HOURLY, 'event_type', '1 hour')}, q AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS r FROM f),
    e AS ({SHORT_AND_LONG}), l AS (SELECT event_type, max(ts) AS last, arg_max(value, ts) AS value, count(*) >= 30 AS long FROM e GROUP BY 1)
    SELECT event_type, strftime(last + step * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS ts, step, CASE WHEN long THEN 'fitted' ELSE 'short' END AS status,
      CASE WHEN NOT long THEN round(value, 9) END AS forecast FROM l, (SELECT unnest(generate_series(1, 24)) AS step)""",
)
def forecast_race_short(spark, sf):
    """Long series and the first nine points of each: all of them come back."""
    series = filled(hourly(spark, sf), "event_type", "1 hour")
    few = series.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("ts"))).filter("r <= 9").drop("r")
    both = series.unionByName(few.withColumn("event_type", F.concat("event_type", F.lit("_short"))))
    out = forecasting.forecast_race(both, ["event_type"], "ts", "value", 24, "1 hour")
    return stamped(out.withColumn("forecast", F.when(F.col("status") == "short", F.col("forecast"))), "forecast").select(
        "event_type", "ts", "step", "status", "forecast"
    )


@query("lag_forecast")
def lag_forecast(spark, sf):
    series = cut(filled(hourly(spark, sf), "event_type", "1 hour"))
    boosted = GBTRegressor(maxIter=10, maxDepth=4, seed=42)
    return forecasting.lag_forecast(series, ["event_type"], "ts", "value", 12, "1 hour", boosted)


@query(
    "forecast_bands",
    f"""WITH {filled_sql(HOURLY, 'event_type', '1 hour')}, numbered AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM f),
    split AS (SELECT *, n - greatest(n // 5, 24) AS m FROM numbered), ends AS (SELECT event_type, max(ts) AS last, any_value(m) AS m FROM split WHERE i <= m GROUP BY 1),
    test AS (SELECT s.event_type, s.value, l.m, date_diff('hour', last, ts) AS step FROM split s JOIN ends l USING (event_type) WHERE i > s.m),
    errors AS (SELECT t.event_type, abs(t.value - s.value) AS error FROM test t JOIN split s ON s.event_type = t.event_type AND s.i = t.m + 1 - (24 - (t.step - 1) % 24)
      WHERE t.step <= (SELECT max(n - m) FROM split))
    SELECT event_type, round(avg(error), 6) AS mae, round(list_sort(list(error))[least(count(*), CAST(ceil((count(*) + 1) * 95 / 100) AS BIGINT))], 6) AS band FROM errors GROUP BY 1""",
)
def forecast_bands(spark, sf):
    """The naive candidate's error in the hold-out and the half width of its band."""
    series = filled(hourly(spark, sf), "event_type", "1 hour")
    errors = cut(forecasting.held_out_errors(series, ["event_type"], "ts", "value", 24, "1 hour", ["seasonal_naive"]))
    means = errors.groupBy("event_type").agg(F.round(F.avg("error"), 6).alias("mae"))
    bands = forecasting.error_bands(errors, ["event_type"])
    return means.join(bands.select("event_type", F.round("band", 6).alias("band")), "event_type")


@query("forecast_race")
def forecast_race(spark, sf):
    series = filled(hourly(spark, sf), "event_type", "1 hour")
    return forecasting.forecast_race(series, ["event_type"], "ts", "value", 24, "1 hour")


@query(
    "forecast_run",
    f"""WITH {filled_sql("SELECT 'all' AS series, o_orderdate AS ts, o_totalprice AS value FROM orders", 'series', '1 day')},
    n AS (SELECT count(*) AS n FROM f), v AS (SELECT stddev_samp(o_totalprice) / abs(avg(o_totalprice)) AS price,
      stddev_samp(o_custkey) / abs(avg(o_custkey)) AS customer FROM orders)
    SELECT 'time' AS key, 'o_orderdate' AS value UNION ALL SELECT 'value', CASE WHEN price >= customer THEN 'o_totalprice' ELSE 'o_custkey' END FROM v
    UNION ALL SELECT 'step', '1 day' UNION ALL SELECT 'points', CAST(n AS VARCHAR) FROM n
    UNION ALL SELECT 'held_out', CAST(greatest(n // 5, 30) AS VARCHAR) FROM n""",
)
def forecast_run(spark, sf):
    """Columns, step and hold-out that an unattended forecast of the orders finds for itself."""
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice", "o_custkey", "o_orderdate")
    facts, _ = autopilot.forecast(orders, folder=f"{scratch(spark)}/orders")
    return facts.filter("stage <> 'race'").select("key", "value")


@query(
    "trend_plain",
    f"""WITH p AS (SELECT o_orderstatus, ts, avg(value) AS value, epoch_us(ts) / 86400000000 AS d FROM ({DAILY}) GROUP BY ALL),
    o AS (SELECT o_orderstatus, min(d) AS d0, max(ts) AS last FROM p GROUP BY 1),
    r AS (SELECT o_orderstatus, regr_slope(value, d - d0) AS a, regr_intercept(value, d - d0) AS b, any_value(d0) AS d0, any_value(last) AS last
      FROM p JOIN o USING (o_orderstatus) GROUP BY 1),
    e AS (SELECT o_orderstatus, stddev_pop(value - b - a * (d - d0)) AS s FROM p JOIN r USING (o_orderstatus) GROUP BY 1),
    t AS (SELECT o_orderstatus, ts, false AS is_future FROM p
      UNION ALL SELECT o_orderstatus, last + step * INTERVAL 1 DAY, true FROM r, (SELECT unnest(generate_series(1, 30)) AS step))
    SELECT o_orderstatus, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, is_future, round(y, 3) AS yhat, round(y - 1.2816 * s, 3) AS yhat_lower, round(y + 1.2816 * s, 3) AS yhat_upper
    FROM (SELECT *, b + a * (epoch_us(ts) / 86400000000 - d0) AS y FROM t JOIN r USING (o_orderstatus) JOIN e USING (o_orderstatus))""",
)
def trend_plain(spark, sf):
    """The trend model without changes and seasons."""
    out = forecasting.trend_fourier(daily(spark, sf), ["o_orderstatus"], "ts", "value", 30, changes=0, seasons=())
    return stamped(out, "yhat", "yhat_lower", "yhat_upper", digits=3)


@query("trend_fourier")
def trend_fourier(spark, sf):
    return forecasting.trend_fourier(daily(spark, sf), ["o_orderstatus"], "ts", "value", 30)
