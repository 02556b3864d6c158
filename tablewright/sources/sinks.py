"""Writing results. Sinks are folders: every task writes its own part."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, folder: str, kind: str = "parquet") -> None:
    """Tables as parquet, csv (with header) or json, replacing what was there."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(folder)
    elif kind == "json":
        writer.json(folder)
    elif kind == "parquet":
        writer.parquet(folder)
    else:
        raise ValueError(f"unknown kind {kind!r}")
