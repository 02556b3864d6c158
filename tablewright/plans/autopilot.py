"""Unattended run: from a table to an explained, saved, evaluated model."""

from __future__ import annotations

import random

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators import catalog, ensembles, explain, forecasting, insights, models, prepare, profile, sampling, timeseries
from tablewright.operators.columns import datetime_columns, q
from tablewright.operators.ranking import HASH_SPACE, row_hash
from tablewright.session import cut
from tablewright.sources.sinks import write_table

EXPLAINED_ROWS = 100
BACKGROUND_ROWS = 50
# rows the unattended run explains
RUN_EXPLAINED_ROWS = 500
# classes whose confusion matrix is shown among the facts; the table is written for any number
SHOWN_CLASSES = 20


def explain_model(task: models.Task, model, rows: int = EXPLAINED_ROWS, background: int = BACKGROUND_ROWS, orders: int = 10, seed: int = 42) -> DataFrame:
    """Monte-Carlo Shapley values of a trained model on a fixed-size sample of test rows.

    Values are per model input (scaled numbers, indicator columns); their number is bounded
    by the category cap. The sample is small by definition, so numbering it is one task.
    """
    names = task.spec.names
    values = vector_to_array(models.FEATURES)
    test = _keyed(task.part("test"))
    picked = sampling.sample_rows(test, rows, _order(seed), ["__k"])
    ids = F.row_number().over(W.orderBy("__k"))
    flat = picked.select(ids.alias("row_id"), values.alias("x"))
    chosen = sampling.sample_rows(_keyed(task.part("train")), background, _order(seed + 1), ["__k"])
    basis = [list(r["x"]) for r in chosen.select(values.alias("x")).collect()]
    draw = random.Random(seed)
    paths = [draw.sample(range(len(names)), len(names)) for _ in range(orders)]

    def predict(df: DataFrame) -> DataFrame:
        return model.transform(df.withColumn(models.FEATURES, array_to_vector("x")))

    if task.problem == "regression":
        score = F.col("prediction")
    else:
        score = vector_to_array("probability")[1 if task.problem == "binary" else 0]
    return explain.sampled_shap(flat, ["row_id"], names, basis, paths, predict, score)


def _keyed(part: DataFrame) -> DataFrame:
    return part.select(models.FEATURES).withColumn("__k", F.xxhash64(models.FEATURES))


def _order(seed: int):
    return F.pmod(F.xxhash64("__k", F.lit(seed)), F.lit(HASH_SPACE))


def model_importance(task: models.Task, model, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Permutation importance of the raw feature columns on the test part."""
    from tablewright.operators import metrics

    used = [*task.spec.numeric, *task.spec.categorical]
    columns = [c for c in task.rows.columns if c in used or c in task.spec.dates]
    part = task.part("test").select(*[q(c) for c in columns], models.LABEL)
    stages = PipelineModel([*task.spec.stages, model])
    hashes = [row_hash(*columns, models.LABEL, seed=seed + r) for r in range(repeats)]

    def metric(df: DataFrame, by: list[str]) -> DataFrame:
        if task.problem == "regression":
            return metrics.regression_metrics(df, models.LABEL, "prediction", by).withColumnRenamed("r2", "score")
        return metrics.classification_metrics(df, models.LABEL, "prediction", by).withColumnRenamed("f1_weighted", "score")

    return explain.permutation_importance(part, columns, stages.transform, metric, hashes, columns)


def run(df: DataFrame, target: str | None = None, budget: float | None = None, folder: str | None = None, candidates=None) -> DataFrame:
    """Infer, profile, prepare, train, evaluate, explain; ``(stage, key, value)`` rows.

    With ``folder`` the bundle and the result tables are written there.
    """
    spark = df.sparkSession
    target = target or catalog.infer_target(df)
    if target is None or target not in df.columns:
        raise ValueError("no target column found; name one")
    problem = catalog.infer_problem_type(df, target)
    rows: list[tuple[str, str, str]] = [("infer", "target", target), ("infer", "problem_type", problem)]
    kpis = insights.kpi_row(df, target).first().asDict()
    rows += [("profile", k, str(v)) for k, v in kpis.items() if v is not None]
    duplicates = profile.duplicate_count(df).first()["duplicate_rows"]
    rows.append(("profile", "duplicate_rows", str(duplicates)))
    spread = profile.target_distribution(df, target)
    rows += [("target", r["value"], f"{r['n']} ({r['share']:.4f})") for r in spread.collect()]
    task = models.prepare_task(df, target, problem)
    rows += [("prepare", "dropped", c) for c in task.spec.dropped]
    rows.append(("prepare", "imbalance", task.strategy))
    board = models.train_leaderboard(task, candidates or models.candidate_models(problem), budget)
    metric = models.primary_metric(problem)
    rows += [("leaderboard", t.name, f"{t.scores.get(metric):.6f}") for t in board]
    best = board[0]
    held_out, report = models.evaluate(task, best.model)
    rows += [("evaluate", k, f"{v:.6f}") for k, v in held_out.items() if v is not None]
    importance = model_importance(task, best.model)
    top = importance.orderBy(F.desc("importance"), "feature").limit(20).collect()
    rows += [("explain", r["feature"], f"{r['importance']:.6f}") for r in top]
    shapley = explain.mean_abs_shap(explain_model(task, best.model, RUN_EXPLAINED_ROWS)).collect()
    rows += [("shapley", r["feature"], f"{r['mean_abs']:.6f}") for r in shapley]
    confusion = models.confusion(task, best.model)
    if confusion is not None and len(task.labels) <= SHOWN_CLASSES:
        rows += [("confusion", f"{r['label']} as {r['predicted']}", str(r["n"])) for r in confusion.collect()]
    if folder:
        meta = {
            "target": target, "problem_type": problem, "best_model": best.name, "dropped": task.spec.dropped,
            "metric": metric, "score": held_out.get(metric),
        }
        models.save_bundle(models.full_model(task, best.model), meta, folder)
        write_table(models.leaderboard_frame(spark, board, problem), f"{folder}/leaderboard", "csv")
        write_table(profile.column_profile(df), f"{folder}/eda_profile", "json")
        write_table(spread, f"{folder}/target_distribution", "json")
        if report is not None:
            write_table(report, f"{folder}/evaluation", "json")
            write_table(confusion, f"{folder}/confusion_matrix", "json")
    return spark.createDataFrame(rows, "stage string, key string, value string")


def find_time(df: DataFrame) -> str:
    """The first date column, else the first text column that reads as dates; an error if there is none."""
    found = datetime_columns(df) or prepare.date_text_columns(df)
    if not found:
        raise ValueError("no time column found; name one")
    return found[0]


def find_value(df: DataFrame, time: str) -> str:
    """The numeric column of the largest relative variation; an error if there is none."""
    first = profile.value_column_ranking(df.drop(time)).first()
    if first is None:
        raise ValueError("no numeric column to forecast; name one")
    return first["column"]


# Names of the usual steps, which have a season of their own.
STEPS = {3600: "1 hour", 86400: "1 day", 604800: "7 days"}


def find_step(points: DataFrame, time: str) -> str:
    """The step between the points of one series; a day where they are irregular or few."""
    found = timeseries.infer_frequency(points.withColumn("__all", F.lit(0)), ["__all"], time).first()
    if found is None:
        return "1 day"
    if found["months"]:
        return "1 month" if found["months"] == 1 else f"{found['months']} months"
    seconds = max(1, found["seconds"])
    return STEPS.get(seconds, f"{seconds} seconds")


def forecast(
    df: DataFrame, time: str | None = None, value: str | None = None, horizon: int = 30, folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Unattended forecast: ``(facts, forecast)``.

    Finds the time and value columns unless they are named, averages values of equal times,
    infers the step, puts the points on its grid, fills short gaps, lets the candidates race on
    the held-out end and refits the winner on all points. ``facts`` are ``(stage, key, value)``
    rows. With ``folder`` the forecast and a ``run_meta`` of mode ``forecast`` are written there.
    """
    spark = df.sparkSession
    for name in (time, value):
        if name is not None and name not in df.columns:
            raise ValueError(f"no column {name!r}")
    time = time or find_time(df)
    value = value or find_value(df, time)
    stamp = prepare.parse_date(time) if dict(df.dtypes)[time] == "string" else q(time).cast("timestamp")
    points = df.select(F.lit("all").alias("series"), stamp.alias("ts"), q(value).cast("double").alias("value")).na.drop()
    points = cut(timeseries.mean_per_timestamp(points, ["series"], "ts", "value"))
    step = find_step(points, "ts")
    grid = timeseries.regularize(points, ["series"], "ts", "value", step)
    series = cut(timeseries.interpolate_gaps(grid, ["series"], "ts", "value", step=step))
    n = series.count()
    out = cut(forecasting.forecast_race(series, ["series"], "ts", "value", horizon, step).drop("series"))
    best = out.select("model", "mae", "status").first()
    held_out = max(n // 5, horizon) if best and best["status"] == forecasting.FITTED else 0
    facts = [("detect", "time", time), ("detect", "value", value), ("detect", "step", step), ("series", "points", str(n))]
    facts.append(("series", "held_out", str(held_out)))
    if best:
        facts += [("race", "model", best["model"]), ("race", "mae", None if best["mae"] is None else f"{best['mae']:.6f}")]
    if folder:
        write_table(out, f"{folder}/forecast", "csv")
        meta = [("forecast", best["model"] if best else None, time, value, step, horizon, best["mae"] if best else None)]
        kinds = "mode string, best_model string, time string, value string, step string, horizon int, mae double"
        spark.createDataFrame(meta, kinds).write.mode("overwrite").json(f"{folder}/run_meta")
    return spark.createDataFrame(facts, "stage string, key string, value string"), out


def review(df: DataFrame, target: str, problem: str, candidates=None) -> DataFrame:
    """Explore, check quality, model, judge, advise: one ``(step, key, value)`` table.

    A model that can't be trained is an error, not a row: there is nothing to judge, or not all of it.
    """
    spark = df.sparkSession
    steps = [("Explorer", profile.explorer(df, target))]
    missing = profile.missing_by_column(df, len(df.columns))
    steps.append(("Data Quality", missing.select("column", F.col("missing_pct").cast("string"))))
    steps.append(("Data Quality", profile.duplicate_count(df).select(F.lit("duplicate_rows"), F.col("duplicate_rows").cast("string"))))
    task = models.prepare_task(df, target, catalog.TASKS.get(problem, "multiclass"))
    board = models.train_leaderboard(task, candidates)
    if board.dropped:
        raise RuntimeError(f"not all candidates could be trained: {board.losses()}"[:600])
    best = board[0]
    score = best.scores.get(models.primary_metric(task.problem))
    found = model_importance(task, best.model).orderBy(F.desc("importance"), "feature").limit(5)
    ranked = [(r["feature"], float(r["importance"])) for r in found.collect()]
    facts = [("Model", "model", best.name), ("Model", "score", None if score is None else f"{score:.6f}")]
    facts += [("Model", f"importance:{f}", f"{v:.6f}") for f, v in ranked]
    scored = spark.createDataFrame([(score,)], "score double")
    verdict = insights.verdict(F.col("score"), F.lit(problem))
    steps.append(("Critic", scored.select(F.lit("verdict"), verdict)))
    frame = spark.createDataFrame(ranked, "column string, score double")
    steps.append(("Business", insights.recommendation(frame).select(F.lit("recommendation"), "recommendation")))
    out = spark.createDataFrame(facts, "step string, key string, value string")
    for step, part in steps:
        out = out.unionByName(part.toDF("key", "value").select(F.lit(step).alias("step"), "key", "value"))
    return out


def train_automl(
    df: DataFrame, target: str, problem_type: str, time_limit: float = 300.0, calibrate: bool = True, folds: int = 5,
    eval_metric: str | None = None, levels: int = 1,
):
    """The best models for any named problem type by ``eval_metric`` (default: accuracy, or RMSE), within
    ``time_limit`` seconds: with ``calibrate`` bags of ``folds`` models in ``levels`` levels above the first and an
    ensemble chosen from them, else single models ranked on the validation part.

    Returns ``{task, leaderboard, best, predict, metric, score}``, or None when training
    fails. ``predict`` adds predictions to rows of the task; ``score`` is its validation
    score, with a minus sign where smaller is better.
    """
    try:
        task = models.prepare_task(df, target, catalog.TASKS.get(problem_type, "multiclass"))
        metric = ensembles.check_metric(task.problem, eval_metric)
        val = task.part("val")
        if calibrate:
            found = ensembles.bagged_ensemble(task, None, metric, folds, levels, budget=time_limit)
            ranked = [models.Trained(b.name, b, {metric: b.score}, b.seconds) for b in found.bags]
            board, predict = models.Board(ranked, found.dropped), found.predict
        else:
            board = models.train_leaderboard(task, budget=time_limit)
            for t in board:
                t.scores.update(judged(task, t.model.transform(val), metric))
        board.sort(key=lambda t: -ensembles.gain(metric, t.scores[metric]))
        if not calibrate:
            predict = board[0].model.transform
        score = judged(task, predict(val), metric)[metric]
    except Exception as exc:  # also what Spark itself raises
        print(f"training failed: {str(exc)[:300]}")
        return None
    return {
        "task": task, "leaderboard": board, "best": board[0].name, "predict": predict, "metric": metric,
        "score": ensembles.gain(metric, score),
    }


def judged(task: models.Task, predicted: DataFrame, metric: str) -> dict[str, float]:
    """One metric of predicted rows."""
    view = F.array("prediction") if task.problem == "regression" else vector_to_array("probability")
    return ensembles.view_scores(predicted, {metric: view}, metric)
