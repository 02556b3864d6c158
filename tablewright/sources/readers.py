"""Reading datasets, listing them in a folder, and past runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tablewright.functions.text import utf8_text

# Folders and file names that hold no source data (outputs of past runs
# would leak the label).
SKIP_FOLDERS = (
    ".venv", "venv", "node_modules", ".git", "__pycache__", ".kilo",
    "AutogluonModels", "catboost_info", ".streamlit", ".vscode", "temp",
    "Lib", "Scripts", "Include", "share", "etc", ".ipynb_checkpoints",
)
SKIP_NAMES = (
    r"^predictions", r"^powerbi_", r"^leaderboard", r"^metrics",
    r"^feature_importance", r"^experiment_log", r"^thresholds",
    r"^fairness", r"^robustness", r"^business_metrics", r"^feature_ablation",
)
KINDS = ("csv", "parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with header; types are inferred unless a schema saves that extra pass."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_dataset(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    if path.rstrip("/").lower().endswith(".csv"):
        return read_csv(spark, path, schema)
    return spark.read.parquet(path)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of every file, invalid bytes left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", utf8_text(F.col("content")).alias("text"))


def skipped(path: Column) -> Column:
    """Whether a relative path lies in a skipped folder or has a skipped name."""
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    by_name = F.lit(False)
    for pattern in SKIP_NAMES:
        by_name = by_name | name.rlike(pattern)
    return F.arrays_overlap(parts, F.lit(list(SKIP_FOLDERS))) | by_name


def discover(spark: SparkSession, root: str) -> DataFrame:
    """``(path, relative, bytes)`` of the datasets under ``root``; contents are not read.

    A folder named like a dataset (``t.parquet/``) is one, whatever number of files it holds.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(KINDS) + "}").load(root)
        .select("path", "length")
    )
    inside = f"{root.rstrip('/')}/"
    # by length, not by pattern: a root may hold any characters
    relative = F.expr("substring(path, locate(root, path) + length(root))")
    listed = files.withColumn("root", F.lit(inside)).select("path", relative.alias("file"), F.col("length").alias("bytes")).distinct()
    # up to the outermost folder named like a dataset, else the file itself
    dataset = F.regexp_extract("file", rf"(?s)^(.*?\.({'|'.join(KINDS)}))(/|$)", 1)
    placed = listed.withColumn("relative", dataset).filter(~skipped(F.col("relative")))
    path = F.expr("substring(path, 1, length(path) - length(file) + length(relative))")
    return placed.groupBy(path.alias("path"), "relative").agg(F.sum("bytes").alias("bytes")).orderBy("relative")


def run_history(spark: SparkSession, root: str) -> DataFrame:
    """Past runs under ``root``, newest folder name first, with a one-line label."""
    try:
        metas = spark.read.json(f"{root}/*/run_meta")
    except AnalysisException:
        return spark.createDataFrame([], "run string, label string")
    run = F.regexp_extract(F.input_file_name(), r"([^/]+)/run_meta/", 1)
    known = [F.col(c) for c in ("problem_type", "mode") if c in metas.columns]
    kind = F.coalesce(*known, F.lit("run"))
    best = F.coalesce(F.col("best_model"), F.lit("?")) if "best_model" in metas.columns else F.lit("?")
    return metas.select(run.alias("run"), F.format_string("%s (%s)", best, kind).alias("label")).orderBy(F.desc("run"))
