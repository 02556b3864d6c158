"""Cleaning and feature preparation: learn statistics once, apply them as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators.catalog import distinct_at_most
from tablewright.operators.columns import (
    as_text,
    categorical_columns,
    is_float,
    is_measured,
    nan_to_null,
    no_rows,
    numeric_columns,
    one_row_to_long,
    q,
    rough_distinct,
)
from tablewright.operators.profile import distinct_counts, value_counts
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.skew import spread_join
from tablewright.session import cut

# The formats a text date may have, tried in this order, each with the shape
# a text must have to be worth the (much slower) attempt to parse it. Where day and month are both
# numbers the month comes first, unless it would be above 12. One-digit parts, names of months in
# any case, and a time with fraction, half of day or zone are part of each.
_TIME = r"([ T]\d{1,2}:\d\d(:\d\d([.,]\d{1,9})?)?( ?([AP]M|[ap]m))?( ?(Z|[+-]\d\d:?\d\d))?)?$"
_TIME_24 = "[ ]['T'][H:mm[:ss[.SSSSSSSSS][,SSSSSSSSS]]][ ][XXX][XX]"
_TIME_12 = "[ ]['T']h:mm[:ss[.SSSSSSSSS]][ ]a[ ][XXX][XX]"
_MONTH = r"[A-Za-z]{3,9}"
_DATES = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}",
    "yyyy.M.d": r"^\d{4}\.\d{1,2}\.\d{1,2}",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}",
    "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}",
    "M.d.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}",
    "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}",
    "d[ ][-][MMMM][MMM][,][ ][-]yyyy": rf"^\d{{1,2}}[ -]{_MONTH}(, ?| |-)\d{{4}}",
    "[MMMM][MMM] d[,] yyyy": rf"^{_MONTH} \d{{1,2}},? \d{{4}}",
    "yyyy[ ][-][MMMM][MMM][ ][-]d": rf"^\d{{4}}[ -]{_MONTH}[ -]\d{{1,2}}",
    "[MMMM][MMM][ ][-]yyyy": rf"^{_MONTH}[ -]\d{{4}}",
}
_HALF_DAY = r"(?i)[ap]m"
#: a text that is no date by its first signs costs one look
DATE_GATE = rf"^(\d{{1,4}}[-/. ]|\d{{8}}|{_MONTH}[ -]\d)"


def _date_formats() -> list[tuple[str, str]]:
    """``(format, shape)`` in the order of the tries: with the clock of 24 hours, then of 12."""
    out = [("yyyyMMdd", r"^\d{8}$"), ("yyyyMMdd'T'HHmmss[XXX][XX]", r"^\d{8}T\d{6}(Z|[+-]\d\d:?\d\d)?$")]
    for date, shape in _DATES.items():
        out += [(date + _TIME_24, shape + _TIME), (date + _TIME_12, shape + _TIME)]
    return out


def date_sql(name: str) -> str:
    """SQL text for the timestamp in the (quoted) text column ``name``: the first format that fits, else null."""

    def text(v: str) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    whole = f"trim({name})"
    halved = f"{whole} RLIKE {text(_HALF_DAY)}"
    tries = []
    for form, shape in _date_formats():
        clock = f" AND {halved}" if form.endswith(_TIME_12) else f" AND NOT {halved}" if form.endswith(_TIME_24) else ""
        tries.append(f"CASE WHEN {whole} RLIKE {text(shape)}{clock} THEN try_to_timestamp({whole}, {text(form)}) END")
    return f"CASE WHEN {whole} RLIKE {text(DATE_GATE)} THEN coalesce({', '.join(tries)}) END"


DATE_SHARE = 0.9
ID_SHARE = 0.98
RARE = "__infrequent__"
# More levels than this make no sensible set of indicator columns.
MOST_LEVELS = 10_000
ONE_TASK_LEVELS = 100_000


# ---- rows ----------------------------------------------------------------------------


def clean_rows(df: DataFrame, target: str) -> DataFrame:
    """Without rows whose target is missing and without exact copies."""
    return nan_to_null(df).na.drop(subset=[target]).dropDuplicates()


#: hashes of rows that are sent to all tasks to tell which rows may have copies
SENT_HASHES = 1_000_000


def without_copies(df: DataFrame) -> DataFrame:
    """``dropDuplicates`` that shuffles a hash per row: only rows that share theirs meet in full."""
    if not df.columns:
        return df.dropDuplicates()
    hashed = df.withColumn("__copy", F.xxhash64(*[q(c) for c in df.columns]))
    shared = hashed.groupBy("__copy").count().filter("count > 1").select("__copy")
    known = [r["__copy"] for r in shared.limit(SENT_HASHES + 1).collect()]
    if len(known) > SENT_HASHES:
        return df.dropDuplicates()
    if not known:
        return df
    few = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in known], "__copy bigint"))
    alone = hashed.join(few, "__copy", "left_anti").drop("__copy")
    return alone.unionByName(hashed.join(few, "__copy", "left_semi").drop("__copy").dropDuplicates())


def coerce_numeric(df: DataFrame, column: str) -> DataFrame:
    """``column`` as double; rows that hold no number are dropped."""
    number = q(column).cast("string").try_cast("double")
    return df.withColumn(column, number).na.drop(subset=[column])


# ---- columns -------------------------------------------------------------------------


def id_like_columns(df: DataFrame, target: str) -> DataFrame:
    """Per column: distinct count and whether it is constant or nearly unique.

    Floating columns and arrays of numbers may be unique. The decision is a table; drop with ``id_like_names``.
    """
    df = nan_to_null(df)
    columns = [c for c in df.columns if c != target]
    rows = df.count()
    floats = [c for c in columns if is_measured(df, c)]
    many = (F.col("distinct") >= F.lit(rows * ID_SHARE)) & ~F.col("column").isin(floats)
    return distinct_counts(df, columns).withColumn("drop", (F.col("distinct") <= 1) | many)


def id_like_names(df: DataFrame, target: str) -> list[str]:
    """Names to drop. Sketches rule out the columns that are clearly neither."""
    df = nan_to_null(df)
    columns = [c for c in df.columns if c != target]
    if not columns:
        return []
    rough = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[rough_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)],
    ).first()
    doubtful = [
        c for i, c in enumerate(columns)
        if rough[f"d{i}"] <= 5 or (rough[f"d{i}"] >= 0.85 * rough["rows"] and not is_measured(df, c))
    ]
    if not doubtful:
        return []
    decided = id_like_columns(df.select(*[q(c) for c in doubtful]), target)
    drop = {r["column"] for r in decided.filter("drop").collect()}
    return [c for c in columns if c in drop]


def parse_date(name: str) -> Column:
    """The text column ``name`` as timestamp through the first format that fits, else null.

    Blanks around a date don't count. A text with a zone is that moment, shown in the session's zone;
    fractions finer than a microsecond are cut.
    """
    return F.expr(date_sql("`" + name.replace("`", "``") + "`"))


def datetime_share(df: DataFrame) -> DataFrame:
    """Per text column: the share of rows that read as a date, nulls counted as failures."""
    columns = categorical_columns(df)
    if not columns:
        return no_rows(df, "column string, parsed double, is_date boolean")
    aggs = [F.avg(parse_date(c).isNotNull().cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]
    return one_row_to_long(
        df.agg(*aggs),
        [
            {"column": F.lit(c), "parsed": F.round(f"s{i}", 6), "is_date": F.col(f"s{i}") > DATE_SHARE}
            for i, c in enumerate(columns)
        ],
    )


def date_text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    kept = df.drop(*exclude)
    if not categorical_columns(kept):
        return []
    found = {r["column"] for r in datetime_share(kept).filter("is_date").collect()}
    return [c for c in kept.columns if c in found]


def calendar_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Year, month and day of week (Monday 0) of each date column, which is dropped."""
    parts = {}
    for c in columns:
        ts = parse_date(c) if c in categorical_columns(df) else q(c)
        parts |= {f"{c}_year": F.year(ts), f"{c}_month": F.month(ts), f"{c}_dow": F.weekday(ts)}
    return df.withColumns(parts).drop(*columns) if parts else df


# ---- fill values ---------------------------------------------------------------------


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent text per column, the smallest on a tie; from combined counts."""
    if not columns:
        return {}
    counts = value_counts(df, list(columns)).filter("value IS NOT NULL")
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("k"), "value")).alias("b"))
    found = {r["column"]: r["b"]["value"] for r in best.collect()}
    return {c: found.get(c) for c in columns}


def impute_preview(df: DataFrame, target: str | None = None) -> DataFrame:
    """Numbers filled with the median, text with the mode (``MISSING`` if none); the
    target stays as it is."""
    df = nan_to_null(df)
    numeric = [c for c in numeric_columns(df) if c != target]
    text = [c for c in categorical_columns(df) if c != target]
    mid, mode = medians(df, numeric), modes(df, text)
    fills = {c: F.coalesce(q(c).cast("double"), F.lit(mid[c]).cast("double")) for c in numeric}
    fills |= {c: F.coalesce(q(c), F.lit(mode[c] if mode[c] is not None else "MISSING")) for c in text}
    return df.withColumns(fills) if fills else df


# ---- numeric -------------------------------------------------------------------------


def scale_statistics(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """``{column: (median, spread)}``: the spread is the IQR of the filled column, 1 if zero.

    Filling with the median moves the quartiles, so columns with missing values have them
    taken again after the fill.
    """
    df = nan_to_null(df).select(*[q(c).cast("double").alias(c) for c in columns])
    raw = exact_quantiles(df, columns, [0.5, 0.25, 0.75])
    holes = df.agg(*[F.count_if(q(c).isNull()).alias(f"h{i}") for i, c in enumerate(columns)]).first()
    mid = {c: v[0] if v[0] is not None else 0.0 for c, v in raw.items()}
    quartiles = {c: v[1:] for c, v in raw.items()}
    holed = [c for i, c in enumerate(columns) if holes[f"h{i}"]]
    if holed:
        filled = df.select(*[F.coalesce(q(c), F.lit(mid[c])).alias(c) for c in holed])
        quartiles |= exact_quantiles(filled, holed, [0.25, 0.75])
    out = {}
    for c in columns:
        q1, q3 = quartiles[c]
        spread = (q3 - q1) if q1 is not None else 0.0
        out[c] = (mid[c], spread if spread > 0 else 1.0)
    return out


def robust_scale(df: DataFrame, columns: Sequence[str], stats=None) -> DataFrame:
    """Median-fill and scale ``(x - median) / IQR`` with given or own statistics."""
    df = nan_to_null(df)
    stats = stats or scale_statistics(df, columns)
    return df.withColumns(
        {c: (F.coalesce(q(c).cast("double"), F.lit(m)) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()}
    )


# ---- categories ----------------------------------------------------------------------


def category_levels(
    df: DataFrame, columns: Sequence[str], cap: int | None = None, most: int = MOST_LEVELS
) -> dict[str, list[str]]:
    """Levels per column in alphabetical order. Above ``cap`` levels only the
    ``cap - 1`` most frequent stay (ties: smaller text first).

    Only the kept levels reach the driver. Without ``cap`` a column may have at most
    ``most`` values, else it is an error; raise it where so many indicator columns are wanted.
    """
    if not columns:
        return {}
    if cap is None:
        for c in columns:
            if not distinct_at_most(df, c, most):
                raise ValueError(f"column {c!r} has more than {most} levels; set a cap or raise the limit")
    counts = value_counts(df, list(columns)).filter("value IS NOT NULL")
    if cap is not None:
        order = W.partitionBy("column").orderBy(F.desc("n"), "value")
        top = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= cap + 1)
    else:
        top = counts.withColumn("r", F.lit(0))
    found: dict[str, list[tuple[int, str]]] = {c: [] for c in columns}
    for r in top.select("column", "value", "r").collect():
        found[r["column"]].append((r["r"], r["value"]))
    levels = {}
    for c, pairs in found.items():
        pairs.sort()
        kept = [v for _, v in pairs]
        if cap is not None and len(kept) > cap:
            kept = kept[: cap - 1] + [RARE]
        levels[c] = sorted(kept)
    return levels


def cap_category(name: str, levels: Sequence[str]) -> Column:
    """The category, or the shared rare level if ``levels`` has one and lacks the value."""
    c = as_text(name)
    if RARE not in levels:
        return c
    common = [v for v in levels if v != RARE]
    return F.when(c.isNull() | c.isin(common), c).otherwise(F.lit(RARE))


def one_hot(df: DataFrame, columns: Sequence[str], cap: int | None = 50, drop_first: bool = False) -> DataFrame:
    """0/1 columns ``{column}={level}`` in place of each column; unseen levels give zeros.

    Missing values take the mode. Each column has at most ``cap`` indicator columns.
    """
    mode = modes(df, columns)
    filled = df.withColumns({c: F.coalesce(as_text(c), F.lit(mode[c])) for c in columns})
    levels = category_levels(filled, columns, cap)
    flags = {}
    for c in columns:
        value = cap_category(c, levels[c])
        for v in levels[c][1 if drop_first else 0 :]:
            flags[f"{c}={v}"] = F.coalesce((value == v).cast("int"), F.lit(0))
    return filled.withColumns(flags).drop(*columns)


def cardinality_split(df: DataFrame, threshold: int = 10) -> DataFrame:
    """Text columns with their distinct count, ``low`` up to the threshold else ``high``."""
    counts = distinct_counts(df, categorical_columns(df))
    group = F.when(F.col("distinct") <= threshold, "low").otherwise("high")
    return counts.withColumn("cardinality", group)


def label_codes(df: DataFrame, column: str, code: str = "code", missing: str | None = None) -> DataFrame:
    """Add the position of each value among the sorted distinct values, from 0.

    ``missing`` names the category that nulls form; without it they have no code.
    """
    value = as_text(column)
    if missing is not None:
        value = F.coalesce(value, F.lit(missing))
    keyed = df.withColumn("__v", value)
    levels = cut(keyed.filter("__v IS NOT NULL").select("__v").distinct())
    if levels.count() <= ONE_TASK_LEVELS:
        # sent to the rows: shuffled by value they would be in as many tasks as there are levels
        codes = cut(levels.withColumn(code, (F.row_number().over(W.orderBy("__v")) - 1).cast("int")))
        return keyed.join(F.broadcast(codes), "__v", "left").select(*df.columns, code)
    return spread_join(keyed, _sorted_levels(levels, code), ["__v"], "left").select(*df.columns, code)


def _sorted_levels(levels: DataFrame, code: str) -> DataFrame:
    """Distinct text with its rank from 0: range-partitioned and written to the shared folder, then
    each range is ranked by itself behind its offset."""
    ranged = cut(levels.repartitionByRange(F.col("__v")).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(W.partitionBy("__p").orderBy("__v"))
    return ranged.join(sizes, "__p").select("__v", (F.col("__before") + place - 1).cast("int").alias(code))


def dummies(df: DataFrame, target: str | None = None, most: int = MOST_LEVELS) -> DataFrame:
    """Numbers with null as 0; text as 0/1 columns without the first level; all rows kept.

    A text column of more than ``most`` levels is an error, as each level is a column.
    """
    df = nan_to_null(df)
    text = [c for c in categorical_columns(df) if c != target]
    numbers = [c for c in numeric_columns(df) if c != target]
    levels = category_levels(df, text, most=most)
    flags = {f"{c}_{v}": F.coalesce((q(c) == v).cast("int"), F.lit(0)) for c in text for v in levels[c][1:]}
    filled = df.withColumns({c: F.coalesce(q(c), F.lit(0)) for c in numbers} | flags)
    return filled.drop(*text)
