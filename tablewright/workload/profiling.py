"""Queries over the profiling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import profile
from tablewright.workload import query, table
from tablewright.workload.frames import (
    CUSTOMER_POINTS,
    LABELLED,
    ORDERS_GAPS,
    REPEATED,
    customer_points,
    labelled,
    orders_gaps,
    repeated_lines,
)

ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
    "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}
NUMERIC = ("bigint", "int", "double")


def _profile_sql(frame: str, types: dict[str, str]) -> str:
    parts = []
    for i, (c, t) in enumerate(types.items()):
        stats = "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max"
        if t in NUMERIC:
            stats = (
                f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
                f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max"
            )
        parts.append(
            f"""SELECT '{c}' AS "column", {i + 1} AS position, '{t}' AS dtype,
            round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS missing_pct, {stats},
            count(DISTINCT {c}) AS "distinct" FROM t"""
        )
    return f"WITH t AS ({frame}) " + " UNION ALL ".join(parts)


@query("column_profile", _profile_sql(ORDERS_GAPS, ORDER_TYPES))
def column_profile(spark, sf):
    return profile.column_profile(orders_gaps(spark, sf))


@query(
    "dataset_kpis",
    f"""WITH t AS ({ORDERS_GAPS}) SELECT count(*) AS rows, 5 AS features,
    round(100.0 * (count(*) FILTER (WHERE o_totalprice IS NULL) + count(*) FILTER (WHERE o_orderpriority IS NULL))
      / (6 * count(*)), 2) AS missing_pct, 3 AS numeric_features, 2 AS categorical_features FROM t""",
)
def dataset_kpis(spark, sf):
    return profile.dataset_kpis(orders_gaps(spark, sf), "o_orderstatus")


@query(
    "duplicate_rows",
    f"SELECT CAST((SELECT count(*) FROM ({REPEATED})) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({REPEATED}))) AS BIGINT) AS duplicate_rows",
)
def duplicate_rows(spark, sf):
    return profile.duplicate_count(repeated_lines(spark, sf))


@query(
    "duplicate_texts",
    "SELECT CAST((SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS BIGINT) AS duplicate_rows",
)
def duplicate_texts(spark, sf):
    return profile.duplicate_count(table(spark, sf, "documents").select("text", "lang"))


@query(
    "target_distribution",
    f"""WITH t AS ({ORDERS_GAPS}) SELECT o_orderpriority AS value, count(*) AS n,
    round(count(*) / (SELECT count(o_orderpriority) FROM t), 4) AS share
    FROM t WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 20""",
)
def target_distribution(spark, sf):
    return profile.target_distribution(orders_gaps(spark, sf), "o_orderpriority")


@query(
    "target_kpis",
    f"""WITH t AS ({LABELLED}), c AS (SELECT CAST(quality AS VARCHAR) AS v, count(*) AS n FROM t WHERE quality IS NOT NULL GROUP BY 1)
    SELECT 'numeric' AS form, round(avg(n_chars), 4) AS target_mean, round(stddev_samp(n_chars), 4) AS target_std,
      CAST(NULL AS BIGINT) AS target_classes, CAST(NULL AS DOUBLE) AS minority_class_pct FROM t
    UNION ALL SELECT 'text', NULL, NULL, count(*), CASE WHEN count(*) = 2 THEN round(100.0 * min(n) / sum(n), 2) END FROM c""",
)
def target_kpis(spark, sf):
    df = labelled(spark, sf)
    numeric = profile.target_kpis(df, "n_chars").withColumn("form", F.lit("numeric"))
    text = df.withColumn("quality", F.col("quality").cast("string"))
    return numeric.unionByName(profile.target_kpis(text, "quality").withColumn("form", F.lit("text")))


@query(
    "missing_by_column",
    f"""WITH t AS ({LABELLED}), m AS (
    SELECT 'quality' AS "column", count(*) FILTER (WHERE quality IS NULL) AS missing, count(*) AS n FROM t
    UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL), count(*) FROM t
    UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL), count(*) FROM t)
    SELECT "column", missing, round(100.0 * missing / n, 2) AS missing_pct FROM m WHERE missing > 0""",
)
def missing_by_column(spark, sf):
    return profile.missing_by_column(labelled(spark, sf))


@query(
    "explorer",
    f"""WITH t AS ({LABELLED}), a AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality IS NULL)
      + count(*) FILTER (WHERE toxic IS NULL) AS m FROM t)
    SELECT 'rows' AS key, CAST(n AS VARCHAR) AS value FROM a UNION ALL SELECT 'columns', '6'
    UNION ALL SELECT 'missing_values', CAST(m AS VARCHAR) FROM a UNION ALL SELECT 'numeric_features', '4'
    UNION ALL SELECT 'categorical_features', '2' UNION ALL SELECT 'target', 'quality'
    UNION ALL SELECT 'dtype:doc_id', 'bigint' UNION ALL SELECT 'dtype:n_chars', 'bigint'
    UNION ALL SELECT 'dtype:lang', 'string' UNION ALL SELECT 'dtype:source', 'string'
    UNION ALL SELECT 'dtype:quality', 'int' UNION ALL SELECT 'dtype:toxic', 'int'""",
)
def explorer(spark, sf):
    return profile.explorer(labelled(spark, sf), "quality")


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
    min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
    round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max FROM lineitem"""


@query("numeric_describe", " UNION ALL ".join(_describe_sql(c) for c in LINE_NUMBERS))
def numeric_describe(spark, sf):
    return profile.numeric_describe(table(spark, sf, "lineitem").select(*LINE_NUMBERS))


def _top_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", value, n, rank, "distinct" FROM (SELECT {c} AS value, count(*) AS n,
    row_number() OVER (ORDER BY count(*) DESC, {c} NULLS FIRST) AS rank, count({c}) AS ignored FROM t GROUP BY 1),
    (SELECT count(DISTINCT {c}) AS "distinct" FROM t) WHERE rank <= 5"""


@query(
    "categorical_top5",
    f"WITH t AS (SELECT o_orderstatus, o_orderpriority FROM ({ORDERS_GAPS})) "
    + " UNION ALL ".join(_top_sql(c) for c in ("o_orderstatus", "o_orderpriority")),
)
def categorical_top5(spark, sf):
    return profile.categorical_top(orders_gaps(spark, sf).select("o_orderstatus", "o_orderpriority"))


@query(
    "quality_metrics",
    f"""WITH t AS (SELECT n_chars, lang, quality FROM ({LABELLED})),
    a AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality IS NULL) AS m FROM t),
    d AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM t))
    SELECT round(100.0 - m * 100.0 / (n * 3), 4) AS completeness_pct, round((n - k) * 100.0 / n, 4) AS duplication_pct,
    3 AS dimensionality, n AS sample_size, round(m / (n * 3), 6) AS sparsity FROM a, d""",
)
def quality_metrics(spark, sf):
    return profile.quality_metrics(labelled(spark, sf).select("n_chars", "lang", "quality"))


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
        for a in LINE_NUMBERS
        for b in LINE_NUMBERS
    ),
)
def correlation_matrix(spark, sf):
    return profile.correlation_matrix(table(spark, sf, "lineitem"), LINE_NUMBERS)


@query(
    "histogram50",
    """WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT CAST(least(floor(50 * (l_extendedprice - lo) / (hi - lo)) + 1, 50) AS INTEGER) AS bin, count(*) AS n
    FROM lineitem, r GROUP BY 1""",
)
def histogram50(spark, sf):
    return profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice")


def _box_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3,
    min({c}) FILTER (WHERE ok) AS lower, max({c}) FILTER (WHERE ok) AS upper, count(*) FILTER (WHERE NOT ok) AS outliers
    FROM (SELECT *, {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM lineitem, (SELECT
    quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM lineitem))"""


@query("box_stats", " UNION ALL ".join(_box_sql(c) for c in LINE_NUMBERS))
def box_stats(spark, sf):
    return profile.box_stats(table(spark, sf, "lineitem"), LINE_NUMBERS)


@query(
    "feature_ranges",
    f"WITH t AS ({CUSTOMER_POINTS}) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM t"""
        for c in ("balance", "n_orders", "spend")
    ),
)
def feature_ranges(spark, sf):
    return profile.feature_ranges(customer_points(spark, sf), exclude=("c_custkey",))


def _variation_sql(i: int, c: str) -> str:
    return f"""SELECT '{c}' AS "column", {i} AS position, round(stddev_samp({c}) / (abs(avg({c})) + 1e-9), 6) AS variation FROM lineitem"""


@query(
    "pick_value_column",
    " UNION ALL ".join(_variation_sql(i, c) for i, c in enumerate(LINE_NUMBERS))
    + " ORDER BY variation DESC, position LIMIT 1",
)
def pick_value_column(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_shipdate", *LINE_NUMBERS)
    return profile.value_column_ranking(lines).limit(1)


@query(
    "class_weights",
    """WITH c AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1),
    s AS (SELECT sum(n) AS total, count(*) AS k, max(n) / min(n) AS ratio FROM c)
    SELECT label, n, CASE WHEN ratio >= 3 THEN 'class_weight' ELSE 'none' END AS strategy,
    CASE WHEN ratio >= 3 THEN round(total / (k * n), 6) ELSE 1.0 END AS weight FROM c, s""",
)
def class_weights(spark, sf):
    return profile.class_weights(table(spark, sf, "labels"), "quality")
