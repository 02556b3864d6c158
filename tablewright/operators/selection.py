"""Feature scores: mutual information (nearest neighbours or equal-frequency bins), F tests, variance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators import neighbour_information
from tablewright.operators.columns import as_text, categorical_columns, nan_to_null, numeric_columns, one_row_to_long, q
from tablewright.operators.prepare import label_codes, medians
from tablewright.operators.quantiles import exact_quantiles


def bin_number(c: Column, cuts: Sequence[float]) -> Column:
    """How many distinct cut points lie below the value: 0 … len(cuts)."""
    out = F.lit(0)
    for x in sorted(set(cuts)):
        out = out + (c > F.lit(x)).cast("int")
    return out


def equal_frequency_cuts(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    cuts = exact_quantiles(df, columns, [i / bins for i in range(1, bins)])
    return {c: sorted({x for x in v if x is not None}) for c, v in cuts.items()}


def mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 10, target_bins: int | None = None) -> DataFrame:
    """``(column, score)`` in nats between each binned feature and the target.

    A numeric target may be binned as well. One ``groupBy(feature, bin, class)`` with
    partial aggregation serves all features. (The scores rank like nearest-neighbour
    estimates, but are not the same numbers.)
    """
    df = nan_to_null(df).na.drop(subset=[target])
    cuts = equal_frequency_cuts(df, columns, bins)
    if target_bins:
        ycuts = equal_frequency_cuts(df, [target], target_bins)[target]
        y = bin_number(q(target).cast("double"), ycuts).cast("string")
    else:
        y = as_text(target)
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), bin_number(q(c).cast("double"), cuts[c]).alias("bin")) for c in columns]
    )
    cells = df.select(y.alias("y"), F.inline(pairs)).filter("bin IS NOT NULL")
    n = cells.groupBy("column", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    per_bin = n.groupBy("column", "bin").agg(F.sum("n").alias("nx"))
    per_y = n.groupBy("column", "y").agg(F.sum("n").alias("ny"))
    total = n.groupBy("column").agg(F.sum("n").alias("all"))
    joint = n.join(per_bin, ["column", "bin"]).join(per_y, ["column", "y"]).join(total, "column")
    term = F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))
    return joint.groupBy("column").agg(F.sum(term).alias("score"))


def target_bins(df: DataFrame, target: str, bins: int = 10) -> Column:
    """The equal-frequency bin of a numeric target."""
    return bin_number(q(target).cast("double"), equal_frequency_cuts(nan_to_null(df), [target], bins)[target])


def _information(df: DataFrame, columns: Sequence[str], target: str, numeric: bool) -> DataFrame:
    classes = target_bins(df, target) if numeric else None
    return neighbour_information.mutual_information(df, columns, target, classes=classes)


def f_classif(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """One-way ANOVA F per feature from per-class counts, means and variances."""
    df = nan_to_null(df).na.drop(subset=[target])
    values = F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("double").alias("x")) for c in columns])
    long = df.select(as_text(target).alias("y"), F.inline(values)).filter("x IS NOT NULL")
    per = long.groupBy("column", "y").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")
    )
    whole = per.groupBy("column").agg(
        F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean")
    )
    joined = per.join(whole, "column")
    off = F.col("m") - F.col("mean")
    sums = joined.groupBy("column").agg(
        F.sum(F.col("n") * off * off).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.first("all").alias("all"), F.first("k").alias("k"),
    )
    between = F.try_divide(F.col("ssb"), F.col("k") - 1)
    within = F.try_divide(F.col("ssw"), F.col("all") - F.col("k"))
    return sums.select("column", F.try_divide(between, within).alias("score"))


def f_regression(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """``r² / (1 - r²) * (n - 2)`` per feature; one scan."""
    df = nan_to_null(df)
    y = q(target).cast("double")
    aggs, records = [], []
    for i, c in enumerate(columns):
        x = q(c).cast("double")
        aggs += [F.corr(x, y).alias(f"r{i}"), F.count_if(x.isNotNull() & y.isNotNull()).alias(f"n{i}")]
        r2 = F.col(f"r{i}") * F.col(f"r{i}")
        records.append({"column": F.lit(c), "score": F.try_divide(r2 * (F.col(f"n{i}") - 2), 1 - r2)})
    return one_row_to_long(df.agg(*aggs), records)


def variance_rank(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Sample variance of each median-filled numeric column."""
    df = nan_to_null(df)
    columns = list(columns or numeric_columns(df))
    mid = medians(df, columns)
    aggs = [
        F.var_samp(F.coalesce(q(c).cast("double"), F.lit(mid[c]))).alias(f"v{i}") for i, c in enumerate(columns)
    ]
    return one_row_to_long(df.agg(*aggs), [{"column": F.lit(c), "score": F.col(f"v{i}")} for i, c in enumerate(columns)])


def top_features(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows, ties by name."""
    return scores.orderBy(F.desc_nulls_last("score"), "column").limit(k)


def select_features(df: DataFrame, target: str, task: str = "classification", method: str = "mutual_info", k: int = 50) -> DataFrame:
    """The ``k`` best numeric columns and the target; unchanged when there are no more than
    ``k`` of them, otherwise other columns go. ``mutual_info`` is the nearest-neighbour estimate (a
    numeric target in ten bins), ``mutual_info_binned`` the one on bins, anything else the F test."""
    columns = [c for c in numeric_columns(df) if c != target]
    if len(columns) <= k:
        return df
    if method == "mutual_info":
        scores = _information(df, columns, target, task == "regression")
    elif method == "mutual_info_binned":
        bins = 10 if task == "regression" else None
        scores = mutual_information(df, columns, target, target_bins=bins)
    elif task == "regression":
        scores = f_regression(df, columns, target)
    else:
        scores = f_classif(df, columns, target)
    chosen = {r["column"] for r in top_features(scores, k).collect()}
    return df.select(*[q(c) for c in columns if c in chosen], q(target))


def extract_features(df: DataFrame, target: str | None = None, k: int = 50, method: str = "mutual_info") -> DataFrame:
    """Text as category codes, numbers median-filled, the ``k`` columns of highest mutual
    information with the target (or variance, without one), then the target."""
    work = nan_to_null(df)
    for c in categorical_columns(work):
        if c != target:
            work = label_codes(work, c, "__code", missing="nan").withColumn(c, F.col("__code")).drop("__code")
    columns = [c for c in numeric_columns(work) if c != target]
    mid = medians(work, columns)
    work = work.withColumns({c: F.coalesce(q(c).cast("double"), F.lit(mid[c])) for c in columns})
    if target is not None and method == "mutual_info":
        scores = _information(work, columns, target, target in numeric_columns(df))
    elif target is not None and method == "mutual_info_binned":
        bins = 10 if target in numeric_columns(df) else None
        scores = mutual_information(work, columns, target, target_bins=bins)
    else:
        scores = variance_rank(work, columns)
    chosen = [r["column"] for r in top_features(scores, k).collect()]
    return work.select(*[q(c) for c in chosen], *([q(target)] if target else []))
