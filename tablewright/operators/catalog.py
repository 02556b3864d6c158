"""Schema-level inference: targets, problem types, catalog listing, job ids."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions.text import slug
from tablewright.operators.columns import datetime_columns, nan_to_null, numeric_columns, q, rough_distinct
from tablewright.operators.ranking import offsets, rank_rows

# Name patterns of likely targets, strongest first, for a single run and
# for many datasets.
RUN_HINTS = (
    r"^is_?fraud", r"^fraud", r"^churn", r"^target$", r"^label$", r"^y$",
    r"fatal", r"outcome", r"^class$", r"^sentiment$", r"^quality$",
    r"^survived$", r"^default", r"^species$", r"^status$", r"^segmentation$",
)
BATCH_HINTS = (
    r"^is_?fraud", r"^fraud", r"^churn", r"^target$", r"^label$", r"^y$",
    r"fatal", r"death", r"murder", r"^default", r"^survived$", r"outcome",
    r"^class$", r"^status$",
)
LABEL_VALUES = 20
LABEL_SHARE = 0.05

# The task that each named problem type is trained as.
TASKS = {
    "binary_classification": "binary",
    "multiclass_classification": "multiclass",
    "classification": "multiclass",
    "regression": "regression",
    "ordinal_regression": "regression",
    "survival_analysis": "regression",
    "time_series_forecasting": "regression",
    "anomaly_detection": "binary",
    "multi_label_classification": "multiclass",
    "recommendation": "regression",
    "image_classification": "multiclass",
    "text_classification": "multiclass",
}


def catalog_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, position, column, type)`` of every table, from the schemas alone."""
    rows = [
        (name, i + 1, f.name, f.dataType.simpleString())
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")


def known_values(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, column, known)``: values that are not null, one scan per table."""
    out = None
    for name, df in tables.items():
        agg = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
        facts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("known")) for i, c in enumerate(df.columns)])
        part = agg.select(F.lit(name).alias("table"), F.inline(facts))
        out = part if out is None else out.unionByName(part)
    return out


def hinted_target(columns: Sequence[str], hints: Sequence[str]) -> str | None:
    names = {c: c.strip().lower().replace(" ", "_") for c in columns}
    return next((c for h in hints for c in columns if re.search(h, names[c])), None)


def distinct_at_most(df: DataFrame, column: str, limit: float) -> bool:
    """Whether ``column`` has at most ``limit`` values; a sketch settles clear cases, so a
    key column is not shuffled to learn that it is one."""
    known = nan_to_null(df.select(q(column)))
    rough = known.agg(rough_distinct(column)).first()[0]
    if rough > 2 * limit + 100:
        return False
    return known.agg(F.count_distinct(q(column))).first()[0] <= limit


def infer_target(df: DataFrame, hints: Sequence[str] = RUN_HINTS, whole_share: bool = True) -> str | None:
    """First column matching the strongest hint; else the last column if it has few values."""
    found = hinted_target(df.columns, hints)
    if found:
        return found
    share = df.count() * LABEL_SHARE
    limit = max(LABEL_VALUES, int(share) if whole_share else share)
    last = df.columns[-1]
    return last if distinct_at_most(df, last, limit) else None


def infer_problem_type(df: DataFrame, target: str) -> str:
    """binary for 2 values, regression for a numeric column with more than 20, else multiclass."""
    if not distinct_at_most(df, target, LABEL_VALUES):
        return "regression" if target in numeric_columns(df) else "multiclass"
    n = nan_to_null(df.select(q(target))).agg(F.count_distinct(q(target))).first()[0]
    return "binary" if n == 2 else "multiclass"


def detect_problem_type(df: DataFrame, target: str | None) -> str:
    """The interactive form: clustering without target, time series for dates, then by
    number of numeric values; any text is multiclass."""
    if target is None or target not in df.columns:
        return "clustering"
    if target in datetime_columns(df):
        return "time_series_forecasting"
    if target not in numeric_columns(df):
        return "multiclass_classification"
    if not distinct_at_most(df, target, LABEL_VALUES):
        return "regression"
    return "binary_classification" if distinct_at_most(df, target, 2) else "multiclass_classification"


def task_of(problem_type: Column) -> Column:
    """Any named problem type as binary / multiclass / regression; unknown is multiclass."""
    pairs = [F.lit(x) for kv in TASKS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), problem_type), F.lit("multiclass"))


#: ranks and taken numbers that one task puts in order together
NUMBER_RANGE = 1 << 16


def job_ids(df: DataFrame, name: Column, order: str, buckets: int = 64) -> DataFrame:
    """Add ``job_id``: the slug of ``name``; later rows with the same slug get _2, _3 …

    The first row of every slug keeps it, so the numbers pass over those that would make the
    slug of another row: ``a, a, a_2`` gives ``a, a_3, a_2``. No id occurs twice. ``order`` is
    a numeric key; a null name has the empty slug.

    The ``i``-th taken number ``x`` of a slug (from 0) moves all ranks of ``x - i`` or more on by one. Ranks and
    these thresholds make one ordered stream, and a running total over ranges of it gives each
    rank its moves; no slug's numbers are gathered in one place.
    """
    slugged = df.withColumn("__slug", F.coalesce(slug(name), F.lit("")))
    edge = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    width = max((edge["hi"] or 0) - (edge["lo"] or 0) + 1, 1)
    bucket = F.floor((F.col(order) - F.lit(edge["lo"])) * F.lit(buckets) / F.lit(width))
    ranked = rank_rows(slugged, [order], bucket, ["__slug"], "__n", "__total")

    shape = r"^(.*)_([1-9][0-9]{0,8})$"
    base, number = (F.regexp_extract("__slug", shape, i) for i in (1, 2))
    taken = slugged.select("__slug").distinct().filter((number != "") & (number != "1"))
    taken = taken.select(base.alias("__slug"), number.cast("bigint").alias("__x"))
    # a base that is no row's slug needs no numbers
    taken = taken.join(slugged.select("__slug").distinct(), "__slug", "left_semi")
    placed = rank_rows(taken, ["__x"], F.floor(F.col("__x") / NUMBER_RANGE), ["__slug"], "__i", "__all_taken")
    moves = placed.groupBy("__slug", (F.col("__x") - F.col("__i") + 1).alias("__v")).agg(F.count(F.lit(1)).alias("__moves"))

    nothing = F.lit(None).cast(ranked.select(F.struct(*[q(c) for c in df.columns])).schema[0].dataType)
    later = ranked.filter("__n > 1").select("__slug", F.col("__n").alias("__v"), F.lit(0).cast("bigint").alias("__moves"), F.struct(*[q(c) for c in df.columns]).alias("__row"))
    stream = later.unionAll(moves.select("__slug", "__v", "__moves", nothing.alias("__row")))
    stream = stream.withColumn("__range", F.floor(F.col("__v") / NUMBER_RANGE))
    before = offsets(stream, ["__slug"], "__range", {"m": F.sum("__moves")}).select("__slug", "__range", "m__before")
    # a threshold comes before the rank it equals
    order_by = W.partitionBy("__slug", "__range").orderBy("__v", F.col("__row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    moved = stream.join(before, ["__slug", "__range"]).withColumn("__number", F.col("__v") + F.col("m__before") + F.sum("__moves").over(order_by))
    numbered = moved.filter(F.col("__row").isNotNull()).select("__row.*", F.concat_ws("_", "__slug", F.col("__number").cast("string")).alias("job_id"))
    return ranked.filter("__n = 1").select(*[q(c) for c in df.columns], F.col("__slug").alias("job_id")).unionAll(numbered)
