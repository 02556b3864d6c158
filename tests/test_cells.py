"""Trees grown on cells: Spark's own boosting found again, forests as good as Spark's."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.operators import cells, models, prepare

KEYS = {"featuresCol": "x", "labelCol": "y", "weightCol": "w", "seed": 42}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(700).select(F.rand(1).alias("a"), F.randn(2).alias("b"), F.floor(F.rand(3) * 5).alias("c"), F.lit(3.0).alias("same"))
    high = F.col("a") * 2 + F.col("b") + F.rand(5) + F.col("c") / 4 > 2
    df = df.withColumn("y", high.cast("double")).withColumn("w", F.when(high, 1.5).otherwise(0.7))
    return VectorAssembler(inputCols=["a", "b", "c", "same"], outputCol="x").transform(df).repartition(3).persist()


def chances(model, rows):
    return np.array([r["p"] for r in model.transform(rows).select(vector_to_array("probability")[1].alias("p")).collect()])


def test_boosting_on_cells_equals_sparks(rows, monkeypatch):
    """In the driver, and over a table whose tasks look for equal rows a few at a time, with cells put together or not."""
    want = chances(GBTClassifier(maxIter=4, **KEYS).fit(rows), rows)
    for local, few in ((cells.LOCAL, cells.FEW), (0, cells.FEW), (0, 0)):
        monkeypatch.setattr(cells, "LOCAL", local)
        monkeypatch.setattr(cells, "FEW", few)
        monkeypatch.setattr(cells, "HELD", cells.HELD if local else 100)
        assert np.abs(chances(cells.CellGBTClassifier(maxIter=4, **KEYS).fit(rows), rows) - want).max() < 1e-9


def test_equal_rows_of_bins_are_one_cell(rows):
    many = rows.select("x", F.lit(2.0).alias("w"), "y").unionAll(rows.select("x", F.lit(2.0).alias("w"), "y"))
    found = cells.make_cells(many, "x", "y", "w", 4, 2, 1)
    blocks = found.local
    assert [f for f, _ in found.cuts] == [0, 1, 2] and found.cells <= 4**3 and found.cells == sum(b["bins"].shape[1] for b in blocks)
    assert sum(b["n"].sum() for b in blocks) == 1400 and sum(b["w"].sum() for b in blocks) == 2800


def test_a_forest_on_cells_learns(rows):
    model = cells.CellForestClassifier(numTrees=10, maxDepth=5, **KEYS).fit(rows)
    assert model.getNumTrees == 10 and abs(model.featureImportances.toArray().sum() - 1) < 1e-9 and model.featureImportances[3] == 0
    right = model.transform(rows).filter("prediction = y").count()
    assert right > 0.85 * rows.count()


def test_rows_without_copies_equal_distinct_rows(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 200).alias("a"), F.when(F.col("id") % 200 > 9, F.col("id") % 200 / 7).alias("b"), F.lit(None).cast("string").alias("c"))
    want = sorted(map(str, df.distinct().collect()))
    assert sorted(map(str, prepare.without_copies(df).collect())) == want
    monkeypatch.setattr(prepare, "SENT_HASHES", 5)
    assert sorted(map(str, prepare.without_copies(df).collect())) == want


def test_no_candidate_is_dropped_for_time(spark):
    """Neither of many classes: without a budget all are trained."""
    many = spark.range(1500).select((F.col("id") % 30).cast("double").alias("v"), F.rand(3).alias("noise"), F.concat(F.lit("c"), F.col("id") % 30).alias("y"))
    task = models.prepare_task(many, "y", "multiclass")
    boosting = models.candidate_models("multiclass", rounds=2)["GradientBoosting"]
    board = models.train_leaderboard(task, {"GradientBoosting": boosting})
    assert board.dropped == [] and board[0].scores["f1_weighted"] > 0.8
