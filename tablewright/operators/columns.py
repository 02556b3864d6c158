"""Column classes and the null model shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    """Integer, floating and decimal columns; booleans do not count."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame, kind: str = "string") -> list[str]:
    """``kind='string'``: text columns only. ``kind='other'``: everything not numeric."""
    if kind == "string":
        return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if kind == "other":
        numeric = set(numeric_columns(df))
        return [c for c in df.columns if c not in numeric]
    raise ValueError(f"unknown kind {kind!r}")


def datetime_columns(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    ]


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def is_measured(df: DataFrame, name: str) -> bool:
    """Floating columns, and arrays of numbers: their values may all differ without being ids."""
    kind = df.schema[name].dataType
    return is_float(df, name) or (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in floating columns, so both count as missing."""
    floats = [c for c in df.columns if is_float(df, c)]
    if not floats:
        return df
    return df.withColumns({c: F.nanvl(q(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats})


def q(name: str) -> Column:
    """Column by exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(name: str) -> Column:
    return q(name).cast("string")


def no_rows(df: DataFrame, schema: str) -> DataFrame:
    """An empty table, the answer for a frame without any column of the kind asked for."""
    return df.sparkSession.createDataFrame([], schema)


def one_row_to_long(agg: DataFrame, records: list[dict[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into one row per record, without a second job."""
    structs = [F.struct(*[c.alias(k) for k, c in r.items()]) for r in records]
    return agg.select(F.inline(F.array(*structs)))


def rough_distinct(name: str) -> Column:
    """Estimated distinct count (about 2 %): one small sketch per column, no shuffle of values."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(as_text(name), F.lit(12)))
