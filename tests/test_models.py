"""Training, scoring, explanation and whole runs."""

import random
import re
import time
import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tablewright.operators import catalog, explain, models, prepare, profile, retrieval
from tablewright.operators.sqlguard import SqlDesk
from tablewright.plans import autopilot, batch
from tablewright.sources import readers, sinks


def churn(spark, n=600):
    rng = np.random.default_rng(11)
    tenure = rng.integers(1, 72, n).astype(float)
    charge = rng.normal(60, 15, n)
    contract = rng.choice(["month", "year", "two's"], n)
    day = pd.Timestamp("2023-01-01") + pd.to_timedelta(rng.integers(0, 700, n), unit="D")
    p = 1 / (1 + np.exp(0.08 * (tenure - 30) - 1.0 * (contract == "month") - 0.02 * (charge - 60)))
    pdf = pd.DataFrame(
        {
            "id": np.arange(n), "tenure": np.where(rng.random(n) < 0.1, np.nan, tenure), "charge": charge,
            "contract": contract, "joined": pd.Series(day).dt.strftime("%Y-%m-%d"), "constant": "x",
            "churn": np.where(rng.random(n) < p, "yes", "no"),
        }
    )
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def task(spark):
    return models.prepare_task(churn(spark), "churn", "binary")


@pytest.fixture(scope="module")
def fitted(task):
    quick = {"LogisticRegression": models.candidate_models("binary")["LogisticRegression"]}
    return models.train_leaderboard(task, {**quick, "broken": LogisticRegression(featuresCol="nope")})


def test_preparation_drops_ids_and_keeps_dates(task):
    assert sorted(task.spec.dropped) == ["constant", "id"]
    assert task.spec.dates == ["joined"] and "joined_year" in task.spec.numeric
    assert task.labels == ["no", "yes"]


def test_failed_candidates_are_skipped(fitted):
    assert [t.name for t in fitted] == ["LogisticRegression"]
    assert fitted[0].scores["roc_auc"] > 0.7


def test_saved_bundle_scores_raw_rows_alike(spark, task, fitted, tmp_path):
    pipeline = models.full_model(task, fitted[0].model)
    meta = {"target": "churn", "problem_type": "binary", "best_model": "LogisticRegression", "dropped": task.spec.dropped}
    models.save_bundle(pipeline, meta, str(tmp_path / "run1"))
    loaded, known = models.load_bundle(spark, str(tmp_path / "run1"))
    raw = churn(spark)
    a = models.score(pipeline, raw, meta).toPandas()
    b = models.score(loaded, raw, known).toPandas()
    assert len(a) == 600 and set(a["prediction"]) <= {"yes", "no"}
    assert np.allclose(a["probability"], b["probability"])
    unseen = raw.withColumn("contract", F.lit("never seen"))
    assert models.score(loaded, unseen, known).count() == 600
    assert readers.run_history(spark, str(tmp_path)).first()["label"] == "LogisticRegression (binary)"


def test_features_depend_on_training_rows_only(spark):
    df = churn(spark).drop("id", "constant")
    half = df.filter("charge < 60")
    first = models.fit_features(half, "churn").stages[1].getStatement()
    assert first == models.fit_features(half.unionByName(df.filter("charge < 60").limit(0)), "churn").stages[1].getStatement()
    assert first != models.fit_features(df, "churn").stages[1].getStatement()


def test_shapley_values_add_up(task, fitted):
    model = fitted[0].model
    phi = autopilot.explain_model(task, model, rows=8, background=5).groupBy("row_id").agg(F.sum("phi").alias("s")).toPandas()
    assert len(phi) == 8 and phi["s"].abs().max() <= 1.0 and phi["s"].abs().max() > 0


def test_shapley_of_a_linear_score_is_exact(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, -1.0, 5.0])], "k int, x array<double>")
    base = [[0.0, 0.0, 1.0], [2.0, 2.0, 3.0]]

    def predict(d):
        return d.withColumn("s", F.col("x")[0] + 2 * F.col("x")[1] - F.col("x")[2])

    got = explain.sampled_shap(df, ["k"], ["a", "b", "c"], base, [(0, 1, 2), (2, 1, 0)], predict, F.col("s"))
    found = {(r["k"], r["feature"]): r["phi"] for r in got.collect()}
    assert found == {(1, "a"): 0, (1, "b"): 2, (1, "c"): -1, (2, "a"): -1, (2, "b"): -4, (2, "c"): -3}


def test_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(explain, "ROWS_PER_BUCKET", 10)
    df = spark.range(300).select(F.lit(1).alias("a"), (F.col("id") % 3 == 0).cast("int").alias("b"))
    hashed = F.pmod(F.xxhash64("a"), F.lit(1000))
    out = explain.shuffled_copies(df, ["b"], [hashed], 30, ["b"])
    assert out.agg(F.sum("b"), F.sum("b__shuffled"), F.count("b__shuffled")).first()[:] == (100, 100, 300)


def test_importance_finds_the_driver(task, fitted):
    got = autopilot.model_importance(task, fitted[0].model, repeats=2).orderBy(F.desc("importance")).first()
    assert got["feature"] == "tenure"


def test_stack_and_search(task):
    light = {k: v for k, v in models.candidate_models("multiclass", trees=5).items()}
    predict, _ = models.stacked_ensemble(task, light, folds=2)
    assert models.scores(predict(task.part("test")), "binary")["roc_auc"] > 0.6
    a = models.goal_search(task, trials=2, seed=1)
    b = models.goal_search(task, trials=2, seed=1)
    assert [(r["trees"], r["depth"]) for r in a[0]] == [(r["trees"], r["depth"]) for r in b[0]]
    assert a[1]["best_score"] == pytest.approx(b[1]["best_score"])
    assert a[1]["goal_met"] == (a[1]["best_score"] >= 0.85)


def test_automl_facade(spark):
    df = churn(spark, 200).select("tenure", "charge", "contract")
    out = autopilot.train_automl(df, "charge", "survival_analysis", calibrate=False)
    assert out["metric"] == "rmse" and out["score"] < 0
    assert autopilot.train_automl(df.select("charge"), "charge", "regression") is None


def test_run_and_review(spark, tmp_path):
    quick = {"LogisticRegression": models.candidate_models("binary")["LogisticRegression"]}
    out = autopilot.run(churn(spark), folder=str(tmp_path / "r"), candidates=quick).toPandas()
    assert set(out["stage"]) == {"infer", "profile", "target", "prepare", "leaderboard", "evaluate", "explain", "shapley", "confusion"}
    assert out[out["key"] == "target"]["value"].tolist() == ["churn"]
    assert readers.read_csv(spark, str(tmp_path / "r" / "leaderboard")).count() == 3
    steps = autopilot.review(churn(spark), "churn", "binary_classification", quick).toPandas()
    assert set(steps["step"]) == {"Explorer", "Data Quality", "Model", "Critic", "Business"}
    with pytest.raises(ValueError):
        autopilot.run(churn(spark), "absent")


def test_stacked_regression(spark):
    df = churn(spark).select("tenure", "charge", "contract")
    task = models.prepare_task(df, "charge", "regression")
    assert task.labels == [] and task.strategy == "none"
    board = models.train_leaderboard(task, {"Ridge": models.candidate_models("regression")["Ridge"]})
    assert set(board[0].scores) == {"r2", "mae", "rmse"}


def test_batch_isolates_failures(spark, tmp_path):
    sinks.write_table(churn(spark), str(tmp_path / "shop" / "a.parquet"))
    churn(spark).toPandas().to_csv(tmp_path / "shop" / "b.csv", index=False)
    churn(spark).toPandas().to_csv(tmp_path / "shop" / "predictions_b.csv", index=False)
    (tmp_path / "venv").mkdir()
    churn(spark).toPandas().to_csv(tmp_path / "venv" / "c.csv", index=False)
    names = [r["relative"] for r in readers.discover(spark, str(tmp_path)).collect()]
    assert "shop/b.csv" in names and not any("predictions" in n or "venv" in n for n in names)
    registry = batch.registry_from_folder(spark, str(tmp_path))
    assert "shop_b" in {r["id"] for r in registry.collect()}
    jobs = registry.filter("id = 'shop_b'")
    bad = jobs.withColumn("id", F.lit("bad")).withColumn("target", F.lit("nope"))
    lost = jobs.withColumn("id", F.lit("lost")).withColumn("dataset", F.lit("/no/such.csv"))

    def light(problem):
        return {"LogisticRegression": models.candidate_models("binary")["LogisticRegression"]}

    every = jobs.unionByName(bad).unionByName(lost)
    out = batch.run_batch(spark, every, lambda p: readers.read_dataset(spark, p), candidates=light)
    assert {r["id"]: r["status"] for r in out.collect()} == {"shop_b": "ok", "bad": "failed", "lost": "failed"}


def test_job_ids_avoid_taken_names(spark):
    registry = batch._registry(spark, [("p", name, name, "t", "regression") for name in ("a", "a_2", "a", "A!")])
    assert [r["id"] for r in registry.collect()] == ["p_a", "p_a_2", "p_a_3", "p_a_4"]
    assert batch._registry(spark, []).count() == 0


def test_sql_desk(spark):
    desk = SqlDesk(spark)
    assert not desk.run()["success"]
    desk.register("data", spark.range(10).withColumnRenamed("id", "val"))
    result, error = desk.execute_sql("```sql\nSELECT COUNT(*) AS cnt FROM `data` -- all\n```")
    assert error == "" and result.first()["cnt"] == 10
    assert desk.run()["result"].count() == 10
    for text in ("DROP TABLE data", "WITH a AS (SELECT 1) SELECT * FROM a", "", "SELECT 1; SELECT 2", "SELECT nope FROM data"):
        out = desk.run(text)
        assert not out["success"] and out["error"]


def test_unattended_forecast(spark, tmp_path):
    days = pd.date_range("2024-01-01", periods=60)
    frame = pd.DataFrame({"day": days.strftime("%Y-%m-%d"), "flat": 5.0, "sales": 50 + np.arange(60) + np.arange(60) % 5, "shop": "x"})
    facts, out = autopilot.forecast(spark.createDataFrame(frame), horizon=7, folder=f"{tmp_path}/f")
    found = {r["key"]: r["value"] for r in facts.collect()}
    assert (found["time"], found["value"], found["step"], found["points"], found["held_out"]) == ("day", "sales", "1 day", "60", "12")
    rows = out.orderBy("step").collect()
    assert [r["step"] for r in rows] == list(range(1, 8)) and abs(rows[0]["forecast"] - 110) < 5
    models.save_bundle(PipelineModel([]), {"target": "t", "problem_type": "regression", "best_model": "Linear"}, f"{tmp_path}/a")
    labels = {r["label"] for r in readers.run_history(spark, str(tmp_path)).collect()}
    assert labels == {"Linear (regression)", f"{found['model']} (forecast)"}
    for bad, text in ((spark.range(3), "no time column"), (spark.createDataFrame(frame[["day", "shop"]]), "no numeric column")):
        with pytest.raises(ValueError, match=text):
            autopilot.forecast(bad)
    monthly = spark.range(24).selectExpr("add_months(date'2020-01-15', CAST(id AS INT)) AS m", "CAST(id AS DOUBLE) AS v")
    assert {r["key"]: r["value"] for r in autopilot.forecast(monthly, horizon=3)[0].collect()}["step"] == "1 month"


def test_frames_without_the_columns_asked_for(spark):
    words, numbers = spark.createDataFrame([("a",)], "w string"), spark.createDataFrame([(1.5, None)], "x float, y double")
    assert profile.numeric_describe(words).count() == profile.correlation_matrix(words).count() == profile.box_stats(words).count() == 0
    assert profile.categorical_top(numbers).count() == prepare.datetime_share(numbers).count() == 0
    assert [r["column"] for r in profile.box_stats(numbers).collect()] == ["x"]
    assert {r["column"]: r["dtype"] for r in profile.column_profile(numbers).collect()} == {"x": "float", "y": "double"}


def test_discovery_takes_any_root(spark, tmp_path):
    root = tmp_path / "a+b (c).d"
    root.mkdir()
    (root / "t.csv").write_text("x\n1\n")
    assert [r["relative"] for r in readers.discover(spark, str(root)).collect()] == ["t.csv"]


def test_a_folder_of_part_files_is_one_dataset(spark, tmp_path):
    spark.range(20).repartition(3).write.parquet(f"{tmp_path}/shop/t.parquet")
    spark.range(20).repartition(3).write.option("header", True).csv(f"{tmp_path}/u.csv")
    spark.range(20).write.parquet(f"{tmp_path}/metrics.parquet")
    (tmp_path / "v.csv").write_text("x\n1\n")
    found = {r["relative"]: r for r in readers.discover(spark, str(tmp_path)).collect()}
    assert sorted(found) == ["shop/t.parquet", "u.csv", "v.csv"]
    assert readers.read_dataset(spark, found["shop/t.parquet"]["path"]).count() == readers.read_dataset(spark, found["u.csv"]["path"]).count() == 20


def test_importance_of_columns_with_equals_signs():
    class Tree:
        featureImportances = type("V", (), {"toArray": lambda self: np.array([0.2, 0.3, 0.5])})()

    assert models.tree_importance(Tree(), ["a=b", "a=x", "a=b=c"], ["a", "a=b"]) == {"a=b": 0.7, "a": 0.3}


def test_nearest_in_blocks_equals_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 3)))], "vec_id long, embedding array<double>")
    asked = base.limit(25).selectExpr("vec_id AS query_id", "embedding")
    whole = {tuple(r) for r in retrieval.nearest(base, asked).collect()}
    monkeypatch.setattr(retrieval, "BASE_BLOCK", 20)
    assert {tuple(r) for r in retrieval.nearest(base, asked, batch=7).collect()} == whole
    index = retrieval.DocumentIndex(size=5, overlap=1).load(spark.createDataFrame([("k1", "one two three"), ("k2", "four five six")], "k string, text string"), "k").build()
    out = index.query(spark.createDataFrame([(1, "four six")], "q long, text string"), "q", k=1).first()
    assert out["context"] == "four five six"


def test_sql_desk_looks_at_the_plan(spark):
    desk = SqlDesk(spark)
    desk.register("data", spark.range(3).selectExpr("id AS val", "concat('x', id) AS name"))
    outside = (
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM data",
        "SELECT val FROM data WHERE name IN (SELECT java_method('java.lang.System', 'getProperty', 'user.home'))",
        "SELECT TRANSFORM (val) USING 'cat' AS (v) FROM data",
    )
    for text in outside:
        out = desk.run(text)
        assert not out["success"] and out["error"] and out["result"] is None
    # a literal that only looks like it is fine
    assert desk.run("SELECT 'java_method(ScriptTransformation)' AS t FROM data")["success"]


def test_sql_desk_returns_run_time_errors(spark):
    desk = SqlDesk(spark)
    desk.register("data", spark.range(3).selectExpr("concat('x', id) AS name"))
    assert desk.run("SELECT CAST(name AS INT) AS n FROM data")["success"]  # lazy
    out = desk.run("SELECT CAST(name AS INT) AS n FROM data", executed=True)
    assert not out["success"] and "CAST_INVALID_INPUT" in out["error"]
    assert desk.run("SELECT name FROM data", executed=True)["result"].count() == 3


def test_job_ids_pass_over_taken_names(spark):
    names = ["a", "a", "a_2", "a", "a_2", "a 4", "b", "a"]
    df = spark.createDataFrame(list(enumerate(names)), "k long, name string")
    found = {r["k"]: r["job_id"] for r in catalog.job_ids(df, F.col("name"), "k").collect()}
    assert [found[i] for i in range(8)] == ["a", "a_3", "a_2", "a_5", "a_2_2", "a_4", "b", "a_6"]


def numbers_by_hand(names):
    """Job ids of names in order, one by one."""
    slugs = [re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", (n or "").lower())) for n in names]
    taken, last, out = set(slugs), {}, []
    for s in slugs:
        n = last.get(s, 0) + 1
        while n > 1 and f"{s}_{n}" in taken:
            n += 1
        last[s] = n
        out.append(s if n == 1 else f"{s}_{n}")
    return out


def test_job_ids_equal_numbering_one_by_one(spark, monkeypatch):
    rng = random.Random(5)
    names = [rng.choice(["a", "b", "a_2", None, "", f"a {rng.randrange(2, 90)}", f"b_{rng.randrange(2, 9)}", "a_007", "a_1"]) for _ in range(600)]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)], "k long, name string, __v string")
    want = numbers_by_hand(names)
    for size in (1 << 16, 8):
        monkeypatch.setattr(catalog, "NUMBER_RANGE", size)
        found = {r["k"]: r["job_id"] for r in catalog.job_ids(df, F.col("name"), "k").collect()}
        assert [found[i] for i in range(len(names))] == want


def test_job_ids_grow_with_the_rows(spark):
    def seconds(n):
        names = F.expr("CASE WHEN id % 5 = 0 THEN 'Job' WHEN id % 5 = 1 THEN 'job 2' ELSE concat('job ', id) END")
        df = catalog.job_ids(spark.range(n).withColumn("name", names), F.col("name"), "id")
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
        begun = time.time()
        df.write.format("noop").mode("overwrite").save()
        return time.time() - begun

    seconds(20_000)
    assert seconds(80_000) < 5 * seconds(20_000) + 1


class Slow(Estimator):
    """Its fit is one Spark job that takes ten minutes."""

    def _fit(self, dataset):
        nap = F.udf(lambda x: time.sleep(600), "int")
        dataset.select(nap(F.col(models.LABEL))).collect()


def test_budget_ends_a_fit(spark, task):
    quick = models.candidate_models("binary")["LogisticRegression"]
    models.train_leaderboard(task, {"LogisticRegression": quick})  # warm
    begun = time.time()
    board = models.train_leaderboard(task, {"LogisticRegression": quick, "Slow": Slow(), "Late": quick}, budget=25)
    assert time.time() - begun < 60
    assert [t.name for t in board] == ["LogisticRegression"]
    assert [(n, s) for n, s, _ in board.dropped] == [("Slow", "out of time"), ("Late", "not started")]
    deadline = time.time() + 10
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < deadline:
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    rows = models.leaderboard_frame(spark, board, "binary").filter("status <> 'ok'").collect()
    assert {(r["model"], r["rank"], r["status"]) for r in rows} == {("Slow", None, "out of time"), ("Late", None, "not started")}
    with pytest.raises(models.OutOfTime):
        models.stacked_ensemble(task, {"Slow": Slow()}, folds=2, budget=3)
    with pytest.raises(RuntimeError):
        models.train_leaderboard(task, {"Slow": Slow()}, budget=2)


def test_forests_take_any_number_of_classes(spark):
    rows = spark.range(6000).select((F.col("id") % 250).cast("double").alias("x"), F.rand(3).alias("noise"), F.concat(F.lit("c"), F.col("id") % 250).alias("y"))
    task = models.prepare_task(rows, "y", "multiclass")
    board = models.train_leaderboard(task, {"RandomForest": models.candidate_models("multiclass", trees=3)["RandomForest"]})
    assert [t.name for t in board] == ["RandomForest"] and board.dropped == []


def test_boosting_of_three_classes(spark, tmp_path):
    rows = spark.range(900).select(F.rand(5).alias("a"), F.rand(6).alias("b"))
    kind = F.when(F.col("a") + F.col("b") < 0.8, "low").when(F.col("a") > F.col("b"), "left").otherwise("right")
    rows = rows.withColumn("y", kind).persist()
    task = models.prepare_task(rows, "y", "multiclass")
    quick = models.candidate_models("multiclass", trees=5, rounds=8)
    assert set(quick) == {"GradientBoosting", "LogisticRegression", "RandomForest"}
    board = models.train_leaderboard(task, {"GradientBoosting": quick["GradientBoosting"]})
    assert board[0].scores["f1_weighted"] > 0.85 and board.dropped == []
    found = board[0].model.transform(task.part("test")).select("prediction", vector_to_array("probability").alias("p")).collect()
    assert all(abs(sum(r["p"]) - 1) < 1e-9 and len(r["p"]) == 3 and np.argmax(r["p"]) == r["prediction"] for r in found)
    predict, _ = models.stacked_ensemble(task, {k: quick[k] for k in ("GradientBoosting", "LogisticRegression")}, folds=2)
    assert models.scores(predict(task.part("test")), "multiclass")["f1_weighted"] > 0.85
    models.save_bundle(models.full_model(task, board[0].model), {"target": "y", "problem_type": "multiclass", "dropped": task.spec.dropped}, str(tmp_path / "m"))
    loaded, meta = models.load_bundle(spark, str(tmp_path / "m"))
    scored = models.score(loaded, rows.withColumn("truth", F.col("y")), meta)
    assert scored.filter("prediction = truth").count() > 780


def test_arrays_are_features(spark, tmp_path):
    rows = spark.range(300).select(
        F.array(F.rand(1), F.col("id") % 2 + F.rand(2) / 4, F.when(F.col("id") % 9 > 0, F.rand(4))).alias("v"), F.array().cast("array<int>").alias("none"),
        F.array(F.lit("t")).alias("words"), (F.col("id") % 2).alias("y"),
    )
    task = models.prepare_task(rows, "y", "binary")
    assert [c for c in task.spec.numeric if c.startswith("v_")] == ["v_0", "v_1", "v_2"]
    board = models.train_leaderboard(task, {"LogisticRegression": models.candidate_models("binary")["LogisticRegression"]})
    assert board[0].scores["roc_auc"] > 0.95
    models.save_bundle(models.full_model(task, board[0].model), {"target": "y", "problem_type": "binary", "dropped": task.spec.dropped}, str(tmp_path / "m"))
    loaded, meta = models.load_bundle(spark, str(tmp_path / "m"))
    assert models.score(loaded, rows.withColumns({"v": F.slice("v", 1, 2), "truth": F.col("y")}), meta).filter("prediction = truth").count() > 270


def test_every_job_of_the_batch_succeeds(spark, sf):
    from tablewright.workload import inference, table

    def light(problem):
        return {name: model for name, model in models.candidate_models(problem, trees=3, rounds=2).items() if name in ("RandomForest", "Ridge")}

    tables = {t: table(spark, sf, t) for t in inference.TABLES}
    registry = batch.build_registry(spark, tables, "retail")
    assert not {r["target"] for r in registry.collect()} & {"l_shipdate", "o_orderdate", "ts"}
    out = batch.run_batch(spark, registry, tables.__getitem__, candidates=light).collect()
    assert len(out) > 4 and {(r["status"], r["error"]) for r in out} == {("ok", None)}


def test_a_fit_reads_three_columns_in_few_tasks(task):
    train = task.part("train")
    slim = models.fit_rows(train)
    assert slim.columns == [models.FEATURES, models.LABEL, models.WEIGHT]
    assert slim.count() == train.count() > 300 and slim.rdd.getNumPartitions() == 1


def test_importance_scores_the_unchanged_rows_once(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    asked = []

    def metric(frame, by):
        asked.append((by, frame.count()))
        return frame.groupBy(*by).agg((-F.avg(F.abs(F.col("p") - F.col("id") % 7))).alias("score"))

    out = explain.permutation_importance(df, ["a", "b"], lambda f: f.withColumn("p", F.col("a") + 0 * F.col("b")), metric, [F.col("id"), F.col("id") * 31 % 97], ["id"])
    found = {r["feature"]: r["importance"] for r in out.collect()}
    assert found["a"] > 0.5 and found["b"] == 0 and sorted(asked) == [([], 100), (["feature", "repeat"], 400)]


def test_a_registry_may_take_dates_as_targets(spark):
    days = spark.range(200).select("id", F.expr("date_add(date'2024-01-01', CAST(id % 5 AS INT))").alias("day"))
    assert batch.build_registry(spark, {"d": days}, "p", dates=True).first()["target"] == "day"
    assert batch.build_registry(spark, {"d": days}, "p").count() == 0


def test_inference(spark):
    df = churn(spark)
    assert catalog.infer_target(df) == "churn"
    assert catalog.infer_problem_type(df, "churn") == "binary"
    assert catalog.infer_problem_type(df, "charge") == "regression"
    assert catalog.detect_problem_type(df, None) == "clustering"
    assert catalog.detect_problem_type(df, "churn") == "multiclass_classification"
    assert catalog.infer_target(df.select("contract", "id")) is None


def test_one_hot_ignores_unseen_and_caps(spark):
    df = spark.createDataFrame([(i, f"v{i % 60:02d}") for i in range(600)], "id int, c string")
    levels = prepare.category_levels(df, ["c"], 50)["c"]
    assert len(levels) == 50 and prepare.RARE in levels
    assert len(prepare.one_hot(df, ["c"]).columns) == 51
    with pytest.raises(ValueError):
        prepare.category_levels(spark.range(20_001).select(F.col("id").cast("string").alias("c")), ["c"])


def test_batch_run_takes_every_table_whole(spark, sf, monkeypatch):
    from tablewright.plans import batch
    from tablewright.workload import inference, modelling, table

    runs = []

    def run(spark, registry, load, **rest):
        runs.append((registry.collect(), load, rest))
        return spark.createDataFrame([], batch.RESULTS)

    monkeypatch.setattr(batch, "run_batch", run)
    modelling.batch_run(spark, sf)
    jobs, load, rest = runs[0]
    whole = batch.build_registry(spark, {t: table(spark, sf, t) for t in inference.TABLES}, "retail").collect()
    assert jobs == whole and len(jobs) > 3 and not rest
    assert all(load(j["dataset"]).columns == table(spark, sf, j["dataset"]).columns for j in jobs)


def test_the_files_of_the_scored_stream_grow_with_the_table(spark, sf, tmp_path, monkeypatch):
    from tablewright.workload import modelling

    lines, seen = spark.read.parquet(f"{sf}/lineitem.parquet"), []
    for i in range(6):
        lines.coalesce(1).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")

    def scored(spark, pipeline, meta, source, schema, sink, checkpoint, per_batch):
        seen.append((spark.read.parquet(source).rdd.getNumPartitions(), spark.read.parquet(source).count(), per_batch))
        return lines.limit(0).withColumn("prediction", F.lit(0.0))

    monkeypatch.setattr(modelling, "score_stream", scored)
    modelling.stream_scores(spark, str(tmp_path))
    files, rows, per_batch = seen[0]
    assert files > 4 and rows == 6 * lines.count() and per_batch == -(-files // 2)


def test_a_review_that_cannot_train_is_an_error(spark):
    quick = models.candidate_models("binary")["LogisticRegression"]
    broken = LogisticRegression(featuresCol="nope")
    for candidates in ({"broken": broken}, {"LogisticRegression": quick, "broken": broken}):
        with pytest.raises(RuntimeError, match="broken: failed"):
            autopilot.review(churn(spark, 200), "churn", "binary_classification", candidates)
