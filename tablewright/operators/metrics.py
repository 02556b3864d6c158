"""Exact evaluation metrics from combined counts; predictions are never gathered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.columns import one_row_to_long
from tablewright.operators.ranking import running_totals

GAP = 0.05


def _pairs(df: DataFrame, label: str, prediction: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(
        *by, F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``(label, predicted, n)`` over all sorted classes, zeros kept.

    The grid is built from one list of the classes, so it needs no pairing of rows.
    """
    counts = _pairs(df, label, prediction, [])
    classes = counts.select(F.explode(F.array_distinct(F.array("label", "predicted"))).alias("c"))
    listed = classes.filter("c IS NOT NULL").agg(F.sort_array(F.collect_set("c")).alias("cs"))
    grid = listed.select(F.explode("cs").alias("label"), "cs").select("label", F.explode("cs").alias("predicted"))
    joined = grid.join(counts, ["label", "predicted"], "left")
    return joined.select("label", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_scores(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class (0 where undefined)."""
    by = list(by)
    counts = _pairs(df, label, prediction, by)
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = counts.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"), hit.alias("hit")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"), F.lit(0).cast("bigint").alias("hit")),
            )
        ),
    )
    per = sides.groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit")
    )
    precision, recall = _ratio(F.col("hit"), F.col("called")), _ratio(F.col("hit"), F.col("support"))
    scored = per.withColumns({"precision": precision, "recall": recall})
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", _ratio(2 * p * r, p + r))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per class, then ``accuracy``, ``macro avg`` and ``weighted avg``."""
    per = class_scores(df, label, prediction)
    measures = ("precision", "recall", "f1")
    w = F.col("support")
    total = per.agg(
        F.sum(w).cast("bigint").alias("support"), (F.sum("hit") / F.sum(w)).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * w) / F.sum(w)).alias(f"weighted_{m}") for m in measures],
    )
    accuracy = {m: F.col("accuracy") for m in measures}
    summary = one_row_to_long(
        total,
        [
            {"class": F.lit("accuracy"), **accuracy, "support": F.col("support")},
            {"class": F.lit("macro avg"), **{m: F.col(f"macro_{m}") for m in measures}, "support": F.col("support")},
            {"class": F.lit("weighted avg"), **{m: F.col(f"weighted_{m}") for m in measures}, "support": F.col("support")},
        ],
    )
    return per.select("class", *measures, F.col("support").cast("bigint").alias("support")).unionByName(summary)


def classification_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and weighted F1, overall or per group."""
    per = class_scores(df, label, prediction, by)
    return per.groupBy(*by).agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.sum("support").cast("bigint").alias("rows"),
    )


def regression_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """R², MAE and RMSE, overall or per group; one scan."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    agg = df.groupBy(*by).agg(
        F.sum((y - p) * (y - p)).alias("__sse"), F.var_pop(y).alias("__var"),
        F.avg(F.abs(y - p)).alias("mae"), F.count(y).alias("rows"),
    )
    r2 = F.lit(1.0) - F.try_divide(F.col("__sse"), F.col("__var") * F.col("rows"))
    rmse = F.sqrt(F.col("__sse") / F.col("rows"))
    return agg.select(*by, r2.alias("r2"), "mae", rmse.alias("rmse"), "rows")


def roc_auc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, ties at half weight.

    Rows collapse to distinct scores; the running count of lower-scored negatives is taken
    over score ranges in parallel.
    """
    by = list(by)
    flag = F.when(positive, 1).otherwise(0)
    per = df.groupBy(*by, F.col(score).cast("double").alias("s")).agg(
        F.sum(flag).cast("bigint").alias("pos"), F.sum(1 - flag).cast("bigint").alias("neg")
    )
    run = running_totals(per, "s", ["neg"], by)
    below = F.col("neg_before") + F.col("neg") / F.lit(2.0)
    return run.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * below), F.sum("pos") * F.sum("neg")).alias("roc_auc"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
    )


def fit_gap(scores: DataFrame, train: str, validation: str, gap: float = GAP) -> DataFrame:
    """Flag rows whose train and validation scores differ by more than ``gap``."""
    apart = F.abs(F.col(train) - F.col(validation))
    return scores.withColumns({"gap": apart, "verdict": F.when(apart > gap, "overfit").otherwise("ok")})
