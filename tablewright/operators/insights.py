"""Rule-based findings: risks, verdicts, recommendations, report overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators import profile
from tablewright.operators.columns import nan_to_null

# Thresholds of the risk rules and the finding each one reports.
HIGH_MISSING, SOME_MISSING, SMALL_CLASS, FEW_ROWS, MANY_CATEGORIES = 20.0, 5.0, 20.0, 1000, 20
RISKS = {
    "high_missing": "High missingness (%s%%) may bias model. Investigate and impute carefully.",
    "some_missing": "Moderate missing data detected – consider multiple imputation strategies.",
    "imbalance": "Class imbalance: minority class = %s%%. Use oversampling (SMOTE) or class-weighted loss.",
    "few_rows": "Small dataset (<1,000 rows). Model generalisation may be limited; use cross-validation.",
    "many_categories": "High cardinality or many categorical columns. Encoding may inflate dimensionality.",
    "none": "No major data quality risks detected. Proceed with modelling.",
}
ADVICE = (
    "Perform thorough EDA before modelling to identify hidden patterns.",
    "Consider feature engineering to capture domain-specific interactions.",
    "Validate model on holdout data that reflects real production distribution.",
    "Monitor model drift quarterly and retrain when performance degrades > 5%.",
)
DRIVERS = "Focus on top drivers: %s. These explain most of the model's predictive power."
NO_MODEL = "No trained model found. Train a model first."
NO_DRIVERS = "Collect more data and ensure feature quality before deployment."
OVERFIT_FROM, OK_FROM, RESIDUAL_OK = 0.95, 0.6, 1.0


def risk_rules(kpis: DataFrame) -> DataFrame:
    """Explode a KPI table (one row per dataset) into its findings.

    Needs ``rows``, ``missing_pct``, ``categorical_features``, ``minority_class_pct``;
    other columns are kept. A dataset without findings gets the ``none`` row.
    """
    missing, small = F.col("missing_pct"), F.col("minority_class_pct")

    def finding(rule: str, test: Column, *values: Column) -> Column:
        text = F.format_string(RISKS[rule], *values) if values else F.lit(RISKS[rule])
        return F.when(test, F.struct(F.lit(rule).alias("rule"), text.alias("finding")))

    one = F.format_string("%.1f", missing)
    two = F.round(small, 2).cast("string")
    found = F.array_compact(
        F.array(
            finding("high_missing", missing > HIGH_MISSING, one),
            finding("some_missing", missing > SOME_MISSING),
            finding("imbalance", small < SMALL_CLASS, two),
            finding("few_rows", F.col("rows") < FEW_ROWS),
            finding("many_categories", F.col("categorical_features") > MANY_CATEGORIES),
        )
    )
    none = F.array(finding("none", F.lit(True)))
    keep = [c for c in kpis.columns if c not in ("missing_pct", "minority_class_pct", "categorical_features", "rows")]
    return kpis.select(*keep, F.inline(F.when(F.size(found) > 0, found).otherwise(none)))


def kpi_row(df: DataFrame, target: str | None) -> DataFrame:
    """Dataset and target KPIs as one row."""
    kpis = profile.dataset_kpis(df, target)
    if target is None:
        return kpis.withColumn("minority_class_pct", F.lit(None).cast("double"))
    extra = profile.target_kpis(df, target).first().asDict()
    kinds = {"target_mean": "double", "target_std": "double", "target_classes": "bigint", "minority_class_pct": "double"}
    return kpis.withColumns({k: F.lit(extra[k]).cast(t) for k, t in kinds.items()})


def verdict(score: Column, problem: Column) -> Column:
    """OVERFIT / OK / UNDERFIT by score; regression scores count as OK below 1."""
    return (
        F.when(score.isNull(), "UNKNOWN")
        .when(F.lower(problem).contains("regression"), F.when(score < RESIDUAL_OK, "OK").otherwise("UNDERFIT"))
        .when(score >= OVERFIT_FROM, "OVERFIT")
        .when(score >= OK_FROM, "OK")
        .otherwise("UNDERFIT")
    )


def recommendation(scores: DataFrame, k: int = 3) -> DataFrame:
    """One sentence on the ``k`` best features of ``(column, score)``."""
    top = scores.orderBy(F.desc("score"), "column").limit(k)
    names = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "column"))).alias("l"))
    listed = F.col("l")["column"]
    text = F.format_string(
        "Key business drivers identified: %s. Focus stakeholder attention on these variables for maximum impact. "
        "Consider feature engineering around '%s' to improve model performance.",
        F.array_join(listed, ", "), F.try_element_at(listed, F.lit(1)),
    )
    return names.select(F.when(F.size("l") > 0, text).otherwise(F.lit(NO_DRIVERS)).alias("recommendation"))


def summary_text(df: DataFrame, target: str | None, problem: str, has_model: bool = False) -> DataFrame:
    """The dataset in four sentences, as one row."""
    kpis = profile.dataset_kpis(df, target)
    model = "A trained model is available for inference and explanation. " if has_model else ""
    label = F.initcap(F.replace(F.lit(problem), F.lit("_"), F.lit(" ")))
    text = F.format_string(
        "Dataset contains %s records with %s predictive features. Problem type: %s. "
        "Data completeness: %.1f%%. " + model + "Numeric features (%s) dominate; %s categorical columns require encoding.",
        F.format_number("rows", 0), F.col("features").cast("string"), label, 100.0 - F.col("missing_pct"),
        F.col("numeric_features").cast("string"), F.col("categorical_features").cast("string"),
    )
    return kpis.select(text.alias("summary"))


def report_overview(df: DataFrame, target: str | None, problem: str) -> DataFrame:
    """The opening table of a report: rows, columns, target, problem type, missing %."""
    df = nan_to_null(df)
    kpis = profile.dataset_kpis(df, target)
    rows = {
        "Rows": F.format_number("rows", 0),
        "Columns": F.lit(str(len(df.columns))),
        "Target column": F.lit(str(target)),
        "Problem type": F.initcap(F.replace(F.lit(problem), F.lit("_"), F.lit(" "))),
        "Missing %": F.format_string("%.2f%%", "missing_pct"),
    }
    return kpis.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in rows.items()])))


def _numbered(part: str, texts: DataFrame) -> DataFrame:
    """``(section, key, value)`` of a one-row table whose ``texts`` is an array, numbered from 1."""
    placed = texts.select(F.posexplode("texts").alias("p", "value"))
    return placed.select(F.lit(part).alias("section"), (F.col("p") + 1).cast("string").alias("key"), "value")


def drivers(importance: DataFrame, k: int = 3) -> DataFrame:
    """One row of ``texts``: advice on the ``k`` most important of ``(feature, importance)``, or none."""
    top = importance.orderBy(F.desc("importance"), "feature").limit(k)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("s"), "feature")))["feature"]
    text = F.format_string(DRIVERS, F.array_join("l", ", "))
    return top.agg(listed.alias("l")).select(F.when(F.size("l") > 0, F.array(text)).otherwise(F.array().cast("array<string>")).alias("texts"))


def business_insights(df: DataFrame, target: str | None, problem: str, importance: DataFrame | None = None) -> DataFrame:
    """KPIs, summary, recommendations and risks as one ``(section, key, value)`` table.

    With the ``(feature, importance)`` of a model its top drivers are recommended; without, or
    where it has none, the standing advice is given.
    """
    kpis = kpi_row(df, target)
    facts = kpis.select(F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in kpis.columns])))
    out = facts.filter("value IS NOT NULL").select(F.lit("kpis").alias("section"), "key", "value")
    summary = summary_text(df, target, problem, importance is not None).select(F.array("summary").alias("texts"))
    advice = kpis.select(F.array(*[F.lit(a) for a in ADVICE]).alias("texts"))
    if importance is not None:
        found = drivers(importance).withColumnRenamed("texts", "found")
        standing = F.array(*[F.lit(a) for a in ADVICE])
        advice = found.select(F.when(F.size("found") > 0, F.col("found")).otherwise(standing).alias("texts"))
    missing = [c for c in ("minority_class_pct",) if c not in kpis.columns]
    complete = kpis.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else kpis
    order = F.array_position(F.array(*[F.lit(r) for r in RISKS]), F.col("rule"))
    risks = risk_rules(complete.select("rows", "missing_pct", "categorical_features", "minority_class_pct"))
    risks = risks.agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "finding")))["finding"].alias("texts"))
    return out.unionByName(_numbered("summary", summary)).unionByName(_numbered("recommendations", advice)).unionByName(_numbered("risks", risks))


def report_tables(
    df: DataFrame, target: str | None, problem: str, board: DataFrame | None = None, importance: DataFrame | None = None, k: int = 10
) -> DataFrame:
    """The tables of a report as ``(section, key, value)``: overview, model, importance, insights.

    ``board`` has ``model`` and ``score``, the larger the better; ``importance`` has ``feature`` and
    ``importance``, of which the ``k`` largest are shown.
    """
    out = report_overview(df, target, problem).select(F.lit("overview").alias("section"), F.col("metric").alias("key"), "value")
    if board is None:
        note = df.sparkSession.createDataFrame([("model", "note", NO_MODEL)], "section string, key string, value string")
        out = out.unionByName(note)
    else:
        best = board.orderBy(F.desc_nulls_last("score"), "model").limit(1)
        pairs = F.array(
            F.struct(F.lit("Best model").alias("key"), F.col("model").cast("string").alias("value")),
            F.struct(F.lit("Validation score").alias("key"), F.format_string("%.4f", F.col("score").cast("double")).alias("value")),
        )
        out = out.unionByName(best.select(F.inline(pairs)).select(F.lit("model").alias("section"), "key", "value"))
    if importance is not None:
        top = importance.orderBy(F.desc("importance"), "feature").limit(k)
        out = out.unionByName(top.select(
            F.lit("importance").alias("section"), F.col("feature").alias("key"), F.format_string("%.4f", F.col("importance").cast("double")).alias("value")
        ))
    parts = business_insights(df, target, problem, importance).filter("section <> 'kpis'")
    return out.unionByName(parts)
