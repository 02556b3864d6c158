"""Dataset and column profiling. Every result is a tidy table, small by construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.columns import (
    as_text,
    categorical_columns,
    datetime_columns,
    nan_to_null,
    no_rows,
    numeric_columns,
    one_row_to_long,
    q,
    rough_distinct,
)
from tablewright.operators.quantiles import exact_quantiles

DIGEST_OVER = 64


def missing(name: str) -> Column:
    return F.count_if(q(name).isNull())


def value_counts(df: DataFrame, columns: list[str], digest: bool = False) -> DataFrame:
    """``(column, value, n)`` for all columns in one shuffle, combined before it.

    One ``groupBy`` replaces a ``count(distinct)`` per column, which would expand every
    row once per column and lose the partial aggregation. With ``digest`` long text
    travels as its digest, enough to tell values apart.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), (short_text(c) if digest else as_text(c)).alias("value")) for c in columns]
    )
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def short_text(name: str) -> Column:
    """The value as text, or a marked digest of it when that is shorter."""
    value = as_text(name)
    return F.when(F.length(value) > DIGEST_OVER, F.concat(F.lit("\u0000"), F.sha2(value, 256))).otherwise(value)


def distinct_counts(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """``(column, distinct)``; ``approx`` uses sketches and needs no shuffle of values."""
    if approx:
        agg = df.agg(*[rough_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)])
        return one_row_to_long(
            agg, [{"column": F.lit(c), "distinct": F.col(f"d{i}")} for i, c in enumerate(columns)]
        )
    return value_counts(df, columns, digest=True).groupBy("column").agg(F.count("value").alias("distinct"))


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Type, missing %, distinct count and, for numbers, mean, sample std, min and max."""
    df = nan_to_null(df)
    numeric = set(numeric_columns(df))
    aggs, records = [F.count(F.lit(1)).alias("rows")], []
    for i, field in enumerate(df.schema.fields):
        c = field.name
        aggs.append(missing(c).alias(f"m{i}"))
        stats = {k: F.lit(None).cast("double") for k in ("mean", "std", "min", "max")}
        if c in numeric:
            value = q(c).cast("double")
            aggs += [
                F.avg(value).alias(f"a{i}"), F.stddev_samp(value).alias(f"s{i}"),
                F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}"),
            ]
            stats = {
                "mean": F.round(f"a{i}", 4), "std": F.round(f"s{i}", 4),
                "min": F.col(f"lo{i}"), "max": F.col(f"hi{i}"),
            }
        share = F.try_divide(F.col(f"m{i}") * 100.0, F.col("rows"))
        records.append(
            {
                "column": F.lit(c), "position": F.lit(i + 1),
                "dtype": F.lit(field.dataType.simpleString()),
                "missing_pct": F.round(share, 2), **stats,
            }
        )
    long = one_row_to_long(df.agg(*aggs), records)
    return long.join(distinct_counts(df, df.columns, approx), "column", "left").withColumn(
        "distinct", F.coalesce("distinct", F.lit(0)).cast("bigint")
    )


def dataset_kpis(df: DataFrame, target: str | None = None) -> DataFrame:
    """Rows, features, overall missing %, numeric and categorical column counts."""
    df = nan_to_null(df)
    cells = sum((missing(c) for c in df.columns), F.lit(0))
    features = len(df.columns) - (1 if target in df.columns else 0)
    agg = df.agg(F.count(F.lit(1)).alias("rows"), cells.alias("missing"))
    return agg.select(
        "rows",
        F.lit(features).alias("features"),
        F.round(
            F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("rows") * len(df.columns)), F.lit(0.0)), 2
        ).alias("missing_pct"),
        F.lit(len(numeric_columns(df))).alias("numeric_features"),
        F.lit(len(categorical_columns(df))).alias("categorical_features"),
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows, as one row ``duplicate_rows``.

    Copies meet in the partial aggregation, so a large group of equal rows stays one
    group row; long text travels as its digest.
    """
    text = set(categorical_columns(df))
    keys = [short_text(c).alias(c) if c in text else q(c) for c in df.columns]
    groups = df.select(*keys).groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def target_distribution(df: DataFrame, target: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent values with their share of the non-null rows."""
    known = df.filter(q(target).isNotNull()).select(as_text(target).alias("value"))
    total = known.count()
    counts = known.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(k)
    return top.select("value", "n", F.round(F.col("n") / F.lit(max(total, 1)), 4).alias("share"))


def target_kpis(df: DataFrame, target: str) -> DataFrame:
    """Mean and std of a numeric target; class count of any other, with the minority
    share if there are exactly two classes."""
    df = nan_to_null(df)
    null = F.lit(None).cast("double")
    if target in numeric_columns(df):
        value = q(target).cast("double")
        return df.agg(
            F.round(F.avg(value), 4).alias("target_mean"),
            F.round(F.stddev_samp(value), 4).alias("target_std"),
        ).select("*", F.lit(None).cast("bigint").alias("target_classes"), null.alias("minority_class_pct"))
    counts = df.filter(q(target).isNotNull()).groupBy(q(target).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    agg = counts.agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"), F.sum("n").alias("all"))
    return agg.select(
        null.alias("target_mean"),
        null.alias("target_std"),
        F.col("k").alias("target_classes"),
        F.when(F.col("k") == 2, F.round(F.col("least") * 100.0 / F.col("all"), 2)).alias("minority_class_pct"),
    )


def missing_by_column(df: DataFrame, k: int = 20) -> DataFrame:
    """Columns with missing values, the worst ``k`` first."""
    df = nan_to_null(df)
    aggs = [F.count(F.lit(1)).alias("rows")] + [missing(c).alias(f"m{i}") for i, c in enumerate(df.columns)]
    records = [
        {
            "column": F.lit(c), "missing": F.col(f"m{i}"),
            "missing_pct": F.round(F.try_divide(F.col(f"m{i}") * 100.0, F.col("rows")), 2),
        }
        for i, c in enumerate(df.columns)
    ]
    long = one_row_to_long(df.agg(*aggs), records)
    return long.filter("missing > 0").orderBy(F.desc("missing"), "column").limit(k)


def explorer(df: DataFrame, target: str | None = None) -> DataFrame:
    """Shape, missing cells, types and column classes as ``(key, value)`` rows."""
    df = nan_to_null(df)
    cells = sum((missing(c) for c in df.columns), F.lit(0))
    agg = df.agg(F.count(F.lit(1)).alias("rows"), cells.alias("missing"))
    facts = {
        "rows": F.col("rows").cast("string"),
        "columns": F.lit(str(len(df.columns))),
        "missing_values": F.col("missing").cast("string"),
        "numeric_features": F.lit(str(len(numeric_columns(df)))),
        "categorical_features": F.lit(str(len(categorical_columns(df)))),
        "target": F.lit(target),
    }
    facts |= {f"dtype:{f.name}": F.lit(f.dataType.simpleString()) for f in df.schema.fields}
    return one_row_to_long(agg, [{"key": F.lit(k), "value": v} for k, v in facts.items()])


def numeric_describe(df: DataFrame) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max of every numeric column."""
    df = nan_to_null(df)
    columns = numeric_columns(df)
    if not columns:
        kinds = " double, ".join(["mean", "std", "min", "q25", "q50", "q75", "max"])
        return no_rows(df, f"column string, count bigint, {kinds} double")
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    aggs, records = [], []
    for i, c in enumerate(columns):
        v = q(c).cast("double")
        aggs += [
            F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"),
            F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
        ]
        q25, q50, q75 = (F.round(F.lit(x).cast("double"), 4) for x in quartiles[c])
        records.append(
            {
                "column": F.lit(c), "count": F.col(f"n{i}"), "mean": F.round(f"a{i}", 4),
                "std": F.round(f"s{i}", 4), "min": F.col(f"lo{i}"), "q25": q25, "q50": q50,
                "q75": q75, "max": F.col(f"hi{i}"),
            }
        )
    return one_row_to_long(df.agg(*aggs), records)


def categorical_top(df: DataFrame, k: int = 5, kind: str = "other") -> DataFrame:
    """Distinct count and the ``k`` most frequent values (null included) per column.

    The ranking window runs on value counts; Spark keeps only ``k`` rows per task and
    column before the shuffle.
    """
    from pyspark.sql import Window as W

    columns = categorical_columns(df, kind)
    if not columns:
        return no_rows(df, "column string, value string, n bigint, rank int, distinct bigint")
    counts = value_counts(df, columns)
    order = W.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    distinct = counts.groupBy("column").agg(F.count("value").alias("distinct"))
    return top.join(distinct, "column")


def quality_metrics(df: DataFrame) -> DataFrame:
    """Completeness %, duplication %, dimensionality, sample size, sparsity."""
    df = nan_to_null(df)
    duplicates = duplicate_count(df).first()["duplicate_rows"]
    cells = sum((missing(c) for c in df.columns), F.lit(0))
    agg = df.agg(F.count(F.lit(1)).alias("rows"), cells.alias("missing"))
    size = F.greatest(F.col("rows") * len(df.columns), F.lit(1))
    return agg.select(
        F.round(100.0 - F.col("missing") * 100.0 / size, 4).alias("completeness_pct"),
        F.round(F.lit(duplicates) * 100.0 / F.greatest("rows", F.lit(1)), 4).alias("duplication_pct"),
        F.lit(len(df.columns)).alias("dimensionality"),
        F.col("rows").alias("sample_size"),
        F.round(F.col("missing") / size, 6).alias("sparsity"),
    )


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair, rows with a null in either left out; one scan."""
    df = nan_to_null(df)
    columns = columns or numeric_columns(df)
    if not columns:
        return no_rows(df, "a string, b string, corr double")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    aggs = [
        F.corr(q(a).cast("double"), q(b).cast("double")).alias(f"r{n}") for n, (a, b) in enumerate(pairs)
    ]
    records = []
    for n, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            records.append({"a": F.lit(x), "b": F.lit(y), "corr": F.round(f"r{n}", 6)})
    return one_row_to_long(df.agg(*aggs), records)


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts in ``bins`` equal bins over the column's range; the maximum is in the last."""
    known = nan_to_null(df).select(q(column).cast("double").alias("x")).filter("x IS NOT NULL")
    edge = known.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    lo, hi = edge["lo"], edge["hi"]
    if lo is None or lo == hi:
        bin_no = F.lit(1)
    else:
        bin_no = F.least(F.floor(F.lit(bins) * (F.col("x") - lo) / F.lit(hi - lo)) + 1, F.lit(bins))
    return known.groupBy(bin_no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Quartiles, whiskers (furthest points within 1.5 IQR) and outliers per column."""
    df = nan_to_null(df)
    columns = columns or numeric_columns(df)
    empty = "column string, q1 double, median double, q3 double, lower double, upper double, outliers bigint"
    if not columns:
        return no_rows(df, empty)
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    aggs, records = [], []
    for i, c in enumerate(columns):
        q1, q2, q3 = quartiles[c]
        if q1 is None:
            continue
        v = q(c).cast("double")
        inside = (v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))
        aggs += [
            F.min(F.when(inside, v)).alias(f"lo{i}"), F.max(F.when(inside, v)).alias(f"hi{i}"),
            F.count_if(~inside).alias(f"out{i}"),
        ]
        records.append(
            {
                "column": F.lit(c), "q1": F.round(F.lit(q1), 4), "median": F.round(F.lit(q2), 4),
                "q3": F.round(F.lit(q3), 4), "lower": F.col(f"lo{i}"), "upper": F.col(f"hi{i}"),
                "outliers": F.col(f"out{i}"),
            }
        )
    if not records:  # every value of every column is missing
        return no_rows(df, empty)
    return one_row_to_long(df.agg(*aggs), records)


def feature_ranges(df: DataFrame, k: int = 5, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Min and max of the first ``k`` numeric features."""
    columns = [c for c in numeric_columns(df) if c not in exclude][:k]
    if not columns:
        return no_rows(df, "column string, low double, high double")
    agg = nan_to_null(df).agg(
        *[f(q(c).cast("double")).alias(f"{p}{i}") for i, c in enumerate(columns) for f, p in ((F.min, "lo"), (F.max, "hi"))]
    )
    return one_row_to_long(
        agg,
        [{"column": F.lit(c), "low": F.col(f"lo{i}"), "high": F.col(f"hi{i}")} for i, c in enumerate(columns)],
    )


def value_column_ranking(df: DataFrame) -> DataFrame:
    """Numeric columns by relative variation ``std / (|mean| + 1e-9)``; the first is the
    one to forecast, earlier columns winning ties."""
    dates = set(datetime_columns(df))
    columns = [c for c in numeric_columns(df) if c not in dates]
    if not columns:
        return no_rows(df, "column string, position int, variation double")
    aggs, records = [], []
    for i, c in enumerate(columns):
        v = q(c).cast("double")
        aggs.append((F.stddev_samp(v) / (F.abs(F.avg(v)) + F.lit(1e-9))).alias(f"v{i}"))
        records.append({"column": F.lit(c), "position": F.lit(i), "variation": F.round(f"v{i}", 6)})
    return one_row_to_long(nan_to_null(df).agg(*aggs), records).orderBy(F.desc("variation"), "position")


def class_weights(df: DataFrame, target: str, threshold: float = 3.0) -> DataFrame:
    """Class counts and weights ``n / (k * n_c)``; weight 1 when the largest class is
    less than ``threshold`` times the smallest. One row per class."""
    counts = df.filter(q(target).isNotNull()).groupBy(q(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    s = counts.agg(
        F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"), F.max("n").alias("most"), F.min("n").alias("least")
    ).first()
    if not s["k"]:
        return counts.select("label", "n", F.lit("none").alias("strategy"), F.lit(1.0).alias("weight"))
    weighted = s["most"] / max(s["least"], 1) >= threshold
    weight = F.lit(float(s["all"])) / (F.lit(s["k"]) * F.col("n")) if weighted else F.lit(1.0)
    return counts.select(
        "label", "n",
        F.lit("class_weight" if weighted else "none").alias("strategy"),
        F.round(weight, 6).alias("weight"),
    )
