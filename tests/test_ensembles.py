"""Bags, levels, budgets and the greedy choice of an ensemble."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from plain_metrics import accuracy, auc, f1_weighted, log_loss

from tablewright.operators import ensembles, models
from tablewright.plans import autopilot
from test_models import Slow, churn

MEASURES = {"accuracy": accuracy, "f1_weighted": f1_weighted, "log_loss": log_loss, "roc_auc": auc}


def greedy(parts, y, measure, sign, rounds):
    """Tries every member in every round on the rows themselves."""
    uses, best, kept = [0] * len(parts), None, None
    for r in range(rounds):
        taken = sum(n * p for n, p in zip(uses, parts))
        tried = [sign * measure((taken + p) / (r + 1), y) for p in parts]
        at = next(i for i, v in enumerate(tried) if v >= max(tried) - 1e-12)
        uses[at] += 1
        if best is None or tried[at] > best + 1e-12:
            best, kept = tried[at], list(uses)
    return kept, sign * best


@pytest.mark.parametrize("metric", sorted(MEASURES))
def test_choice_equals_brute_force(spark, metric):
    rng = np.random.default_rng(4)
    classes = 2 if metric == "roc_auc" else 3
    y = rng.integers(0, classes, 150)
    parts = []
    for strength in (0.3, 0.6, 0.5, 0.1):
        raw = rng.random((150, classes)) + strength * np.eye(classes)[y]
        parts.append(raw / raw.sum(axis=1, keepdims=True))
    names = [f"m{i}" for i in range(4)]
    rows = [(float(y[i]), *[p[i].tolist() for p in parts]) for i in range(150)]
    df = spark.createDataFrame(rows, "y double, " + ", ".join(f"{n} array<double>" for n in names))
    found = ensembles.choose(df, {n: F.col(n) for n in names}, metric, "y", rounds=6)
    kept, score = greedy(parts, y, MEASURES[metric], -1 if metric == "log_loss" else 1, 6)
    assert list(found.uses.values()) == kept
    assert found.score == pytest.approx(score, abs=1e-9)


@pytest.mark.parametrize("metric", ["rmse", "mae", "r2"])
def test_choice_of_values_equals_brute_force(spark, metric):
    rng = np.random.default_rng(9)
    y = rng.normal(size=200)
    parts = [(y * a + b + rng.normal(size=200) * c)[:, None] for a, b, c in ((1, 2, 0.3), (1, -1, 0.5), (0.2, 0, 0.1), (1, 0, 3))]
    measures = {
        "rmse": lambda p, t: float(np.sqrt(((p[:, 0] - t) ** 2).mean())),
        "mae": lambda p, t: float(np.abs(p[:, 0] - t).mean()),
        "r2": lambda p, t: float(1 - ((p[:, 0] - t) ** 2).mean() / t.var()),
    }
    df = spark.createDataFrame([(float(y[i]), *[p[i].tolist() for p in parts]) for i in range(200)], "y double, a array<double>, b array<double>, c array<double>, d array<double>")
    found = ensembles.choose(df, {n: F.col(n) for n in "abcd"}, metric, "y", rounds=8)
    kept, score = greedy(parts, y, measures[metric], 1 if metric == "r2" else -1, 8)
    assert list(found.uses.values()) == kept
    assert found.score == pytest.approx(score, abs=1e-9)


@pytest.fixture(scope="module")
def bags(spark):
    task = models.prepare_task(churn(spark, 300), "churn", "binary")
    some = models.candidate_models("binary", trees=4)
    light = {"Line": some["LogisticRegression"], "Broken": LogisticRegression(featuresCol="nope"), "Forest": some["RandomForest"]}
    return task, ensembles.bagged_ensemble(task, light, "log_loss", folds=2, levels=1, rounds=5)


def test_levels_bags_and_report(spark, bags):
    task, found = bags
    assert [(b.name, b.level, len(b.models)) for b in found.bags] == [("Line", 0, 2), ("Forest", 0, 2), ("Line", 1, 2), ("Forest", 1, 2)]
    # the second level has two chances of each of the two bags below as further features
    width = found.bags[0].models[0].numFeatures
    assert found.bags[2].models[0].numFeatures == width + 4
    rows = found.frame(spark).collect()
    assert {(r["model"], r["status"]) for r in rows if r["status"] != "ok"} == {("Broken", "failed"), ("Broken, level 2", "failed")}
    assert sum(r["weight"] for r in rows if r["weight"]) == pytest.approx(1)
    # the mean of the chosen is no worse than the best one alone
    assert found.score <= min(b.score for b in found.bags) + 1e-12


def test_new_rows_get_the_mean_of_the_folds(bags):
    task, found = bags
    test = task.part("test")
    first = found.bags[0]
    alone = ensembles.Ensemble(task, "log_loss", found.bags, ensembles.Choice({}, {b.view: float(b is first) for b in found.bags}, 0.0, []), [])
    mine = [r["c"] for r in alone.predict(test).select(vector_to_array("probability")[1].alias("c")).collect()]
    each = [[r["c"] for r in m.transform(test).select(vector_to_array("probability")[1].alias("c")).collect()] for m in first.models]
    assert np.allclose(mine, np.mean(each, axis=0))
    whole = found.predict(test)
    assert whole.columns == [*test.columns, "probability", "prediction"] and whole.count() == test.count()
    assert models.scores(whole, "binary")["roc_auc"] > 0.6


def test_a_row_is_judged_by_models_that_have_not_seen_it(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(*map(float, a), "yes" if b else "no") for a, b in zip(rng.random((400, 6)), rng.integers(0, 2, 400))], "a double, b double, c double, d double, e double, f double, y string")
    task = models.prepare_task(df, "y", "binary")
    # a deep forest learns noise by heart: seen rows would score far above chance
    deep = {"Forest": models.candidate_models("binary", trees=10)["RandomForest"].copy({}).setMaxDepth(12)}
    found = ensembles.bagged_ensemble(task, deep, "roc_auc", folds=3, levels=0, rounds=1)
    assert found.bags[0].score < 0.65
    assert models.scores(deep["Forest"].fit(task.part("train")).transform(task.part("train")), "binary")["roc_auc"] > 0.8


def test_budget_leaves_what_is_ready(spark, bags):
    task, _ = bags
    light = {"Line": models.candidate_models("binary")["LogisticRegression"], "Slow": Slow()}
    found = ensembles.bagged_ensemble(task, light, folds=2, levels=1, rounds=2, budget=25)
    assert [(b.name, b.level) for b in found.bags] == [("Line", 0)]
    assert found.dropped[0][:2] == ("Slow", "out of time") and {s for _, s, _ in found.dropped[1:]} == {"not started"}
    with pytest.raises(models.OutOfTime):
        ensembles.bagged_ensemble(task, {"Slow": Slow()}, folds=2, budget=3)


def test_facade_obeys_its_arguments(spark, monkeypatch):
    quick = lambda problem: {"Ridge": models.candidate_models("regression", trees=3, rounds=2)["Ridge"]}
    monkeypatch.setattr(ensembles, "candidate_models", quick)
    df = churn(spark, 200).select("tenure", "charge", "contract")
    out = autopilot.train_automl(df, "charge", "regression", folds=3, eval_metric="mae", levels=0)
    assert out["metric"] == "mae" and out["score"] < 0 and out["best"] == "Ridge"
    assert [len(t.model.models) for t in out["leaderboard"]] == [3]
    assert autopilot.train_automl(df, "charge", "regression", eval_metric="accuracy") is None


def test_stacking_fits_side_by_side(spark):
    """The fits of the folds overlap, and all folds and the whole are fitted."""
    import threading
    import time

    from pyspark.ml import Estimator
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from tablewright.operators import models

    lock, seen = threading.Lock(), {"now": 0, "most": 0, "all": 0}

    class Watched(Estimator):
        def _fit(self, dataset):
            with lock:
                seen["now"] += 1
                seen["all"] += 1
                seen["most"] = max(seen["most"], seen["now"])
            time.sleep(0.3)
            model = LogisticRegression(maxIter=2, featuresCol=models.FEATURES, labelCol=models.LABEL).fit(dataset)
            with lock:
                seen["now"] -= 1
            return model

    x = (F.col("id") % 17).cast("double")
    rows = spark.range(200).select(
        array_to_vector(F.array(x)).alias(models.FEATURES), (x > 8).cast("double").alias(models.LABEL),
        F.lit(1.0).alias(models.WEIGHT), F.lit("train").alias("split"),
    )
    task = models.Task("y", "binary", None, ["0", "1"], rows, "none")
    predict, whole = models.stacked_ensemble(task, {"a": Watched()}, folds=3)
    assert list(whole) == ["a"] and seen["all"] == 4 and seen["most"] > 1
    assert predict(rows).count() == 200
