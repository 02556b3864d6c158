"""Metrics, feature scores and explanations of a fixed linear scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import explain, metrics, neighbour_information, profile, sampling, selection
from tablewright.operators.ranking import seeded_hash
from tablewright.workload import query, table
from tablewright.workload.frames import CUSTOMER_POINTS, customer_points
from tablewright.workload.preparation import hash_sql

WEIGHTS = {"l_quantity": 0.3, "l_discount": -20.0}
SCORE_SQL = "(0.3::DOUBLE * l_quantity - 20.0::DOUBLE * l_discount)"
SCORED = f"""SELECT *, {SCORE_SQL} AS score, CASE WHEN {SCORE_SQL} > 9 THEN 'R' WHEN {SCORE_SQL} > 4 THEN 'A' WHEN {SCORE_SQL} > 0 THEN 'N' ELSE 'X' END AS predicted FROM lineitem"""


def score(frame):
    return frame.withColumn("score", F.lit(0.3) * F.col("l_quantity") - F.lit(20.0) * F.col("l_discount"))


def scored(spark, sf):
    s = F.col("score")
    called = F.when(s > 9, "R").when(s > 4, "A").when(s > 0, "N").otherwise("X")
    return score(table(spark, sf, "lineitem")).withColumn("predicted", called)


@query(
    "confusion_matrix",
    f"""WITH s AS ({SCORED}), k AS (SELECT DISTINCT l_returnflag AS c FROM s UNION SELECT predicted FROM s)
    SELECT a.c AS label, b.c AS predicted, (SELECT count(*) FROM s WHERE l_returnflag = a.c AND predicted = b.c) AS n FROM k a, k b""",
)
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(scored(spark, sf), "l_returnflag", "predicted")


CLASS_SQL = f"""s AS ({SCORED}), k AS (SELECT DISTINCT l_returnflag AS c FROM s UNION SELECT predicted FROM s),
  t AS (SELECT c AS class, count(*) FILTER (WHERE l_returnflag = c) AS support, count(*) FILTER (WHERE predicted = c) AS called,
    count(*) FILTER (WHERE l_returnflag = c AND predicted = c) AS hit FROM k, s GROUP BY 1),
  p AS (SELECT *, coalesce(hit / nullif(called, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM t),
  f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM p)"""


@query(
    "classification_report",
    f"""WITH {CLASS_SQL} SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM f
    UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""",
)
def classification_report(spark, sf):
    out = metrics.classification_report(scored(spark, sf), "l_returnflag", "predicted")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "classification_metrics",
    f"""WITH {CLASS_SQL} SELECT round(sum(hit) / sum(support), 6) AS accuracy,
    round(sum(f1 * support) / sum(support), 6) AS f1_weighted, CAST(sum(support) AS BIGINT) AS rows FROM f""",
)
def classification_metrics(spark, sf):
    out = metrics.classification_metrics(scored(spark, sf), "l_returnflag", "predicted")
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "f1_weighted")})


@query(
    "regression_metrics",
    """SELECT l_returnflag, round(1 - sum((l_extendedprice - p) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2,
    round(avg(abs(l_extendedprice - p)), 4) AS mae, round(sqrt(avg((l_extendedprice - p) ** 2)), 4) AS rmse, count(*) AS rows
    FROM (SELECT *, 1400.0::DOUBLE * l_quantity - 500.0::DOUBLE * l_tax AS p FROM lineitem) GROUP BY 1""",
)
def regression_metrics(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("p", 1400.0 * F.col("l_quantity") - 500.0 * F.col("l_tax"))
    out = metrics.regression_metrics(lines, "l_extendedprice", "p", ["l_returnflag"])
    return out.withColumns({"r2": F.round("r2", 6), "mae": F.round("mae", 4), "rmse": F.round("rmse", 4)})


@query(
    "roc_auc",
    f"""WITH c AS (SELECT l_linestatus AS status, score, count(*) FILTER (WHERE l_returnflag = 'R') AS pos, count(*) FILTER (WHERE l_returnflag <> 'R') AS neg
      FROM (SELECT *, 0.3::DOUBLE * l_quantity - 20.0::DOUBLE * l_discount AS score FROM lineitem) GROUP BY 1, 2),
    w AS (SELECT *, sum(neg) OVER (PARTITION BY status ORDER BY score) - neg / 2 AS below FROM c)
    SELECT status AS l_linestatus, round(sum(pos * below) / (sum(pos) * sum(neg)), 6) AS roc_auc, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
    FROM w GROUP BY 1""",
)
def roc_auc(spark, sf):
    out = metrics.roc_auc(scored(spark, sf), "score", F.col("l_returnflag") == "R", ["l_linestatus"])
    return out.withColumn("roc_auc", F.round("roc_auc", 6))


def _gap_rule(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    split = sampling.split_rows(table(spark, sf, "labels"), seeded_hash(F.col("doc_id")), ["doc_id"], "quality")
    return split.join(docs, "doc_id").withColumn("called", (F.col("n_chars") > 600).cast("int"))


@query(
    "fit_gap",
    f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {hash_sql('doc_id')}, doc_id) AS r,
      count(*) OVER (PARTITION BY quality) AS n FROM labels),
    s AS (SELECT lang, CASE WHEN r <= (n * 700) // 1000 THEN 'train' WHEN r <= (n * 850) // 1000 THEN 'val' ELSE 'test' END AS split,
      CASE WHEN quality = CASE WHEN n_chars > 600 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END AS hit FROM r JOIN documents d ON r.doc_id = d.doc_id),
    a AS (SELECT lang, avg(hit) FILTER (WHERE split = 'train') AS train, avg(hit) FILTER (WHERE split = 'val') AS val FROM s GROUP BY 1)
    SELECT lang, round(train, 6) AS train, round(val, 6) AS val, round(abs(train - val), 6) AS gap,
    CASE WHEN abs(train - val) > 0.05 THEN 'overfit' ELSE 'ok' END AS verdict FROM a""",
)
def fit_gap(spark, sf):
    scores = metrics.classification_metrics(_gap_rule(spark, sf), "quality", "called", ["lang", "split"])
    wide = scores.groupBy("lang").pivot("split", ["train", "val"]).agg(F.first("accuracy"))
    out = metrics.fit_gap(wide, "train", "val")
    return out.withColumns({c: F.round(c, 6) for c in ("train", "val", "gap")})


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _binned(c: str, k: int = 10) -> str:
    cuts = ", ".join(f"quantile_cont({c}, {i / k})" for i in range(1, k))
    return f"(SELECT list_sort(list_distinct([{cuts}])) FROM lineitem) AS q_{c}"


def _mi_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", round(sum(n / total * ln(n * total / (nx * ny))), 6) AS score FROM (
    SELECT x, y, n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS total FROM (
    SELECT len(list_filter(q_{c}, lambda v: {c} > v)) AS x, l_returnflag AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem, q GROUP BY 1, 2))"""


@query(
    "mutual_info",
    f"WITH q AS (SELECT {', '.join(_binned(c) for c in FEATURES)}) " + " UNION ALL ".join(_mi_sql(c) for c in FEATURES),
)
def mutual_info(spark, sf):
    out = selection.mutual_information(table(spark, sf, "lineitem"), FEATURES, "l_returnflag")
    return out.withColumn("score", F.round("score", 6))


def _psi(n: str) -> str:
    z = f"({n} + 6.0::DOUBLE)"
    steps = " - ".join(f"1 / ({n} + {j}.0::DOUBLE)" for j in range(6))
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - 1 / (252 * {z} ** 6) + 1 / (240 * {z} ** 8) - {steps})"


def _nearest_information_sql(c: str, source: str, k: int = 3) -> str:
    """Neighbours from the rows next to each row of its class, counts from the ordered distinct values."""
    sides = ", ".join(f"abs(x - {move}(x, {j}) OVER w)" for j in range(1, k + 1) for move in ("lag", "lead"))
    return f"""SELECT '{c}' AS "column", round(greatest(0, {_psi('any_value(total)')} + avg(
      {_psi('CASE WHEN r > 0 THEN least(' + str(k) + ', c - 1) ELSE same END')} - {_psi('c')} - {_psi('CASE WHEN r > 0 THEN hi.below - lo.upto ELSE lo.n END')})), 6) AS score
    FROM (SELECT *, x - r AS a, x + r AS z, count(*) OVER () AS total FROM
      (SELECT x, c, same, list_sort(list_filter(near, lambda v: v IS NOT NULL))[least({k}, c - 1)] AS r FROM
        (SELECT x, count(*) OVER (PARTITION BY y) AS c, count(*) OVER (PARTITION BY y, x) AS same, [{sides}] AS near
         FROM (SELECT {c}::DOUBLE AS x, y FROM {source}) WINDOW w AS (PARTITION BY y ORDER BY x)) WHERE c > 1)) p
    ASOF JOIN (SELECT x AS v, n, sum(n) OVER (ORDER BY x) AS upto FROM (SELECT {c}::DOUBLE AS x, count(*) AS n FROM {source} GROUP BY 1)
      UNION ALL SELECT '-infinity'::DOUBLE, 0, 0) lo ON p.a >= lo.v
    ASOF JOIN (SELECT x AS v, sum(n) OVER (ORDER BY x) AS below FROM (SELECT {c}::DOUBLE AS x, count(*) AS n FROM {source} GROUP BY 1)
      UNION ALL SELECT '-infinity'::DOUBLE, 0) hi ON p.z > hi.v"""


@query(
    "mutual_info_neighbours",
    "WITH t AS (SELECT *, l_returnflag AS y FROM lineitem) " + " UNION ALL ".join(_nearest_information_sql(c, "t") for c in FEATURES),
)
def mutual_info_neighbours(spark, sf):
    out = neighbour_information.mutual_information(table(spark, sf, "lineitem"), FEATURES, "l_returnflag")
    return out.withColumn("score", F.round("score", 6))


@query(
    "mutual_info_numeric_target",
    "WITH q AS (SELECT list_sort(list_distinct([" + ", ".join(f"quantile_cont(l_extendedprice, {i / 10})" for i in range(1, 10)) + """])) AS cuts FROM lineitem),
    t AS (SELECT l_quantity, l_discount, l_partkey, len(list_filter(cuts, lambda v: l_extendedprice > v)) AS y FROM lineitem, q) """
    + " UNION ALL ".join(_nearest_information_sql(c, "t") for c in ("l_quantity", "l_discount", "l_partkey")),
)
def mutual_info_numeric_target(spark, sf):
    lines = table(spark, sf, "lineitem")
    bins = selection.target_bins(lines, "l_extendedprice")
    out = neighbour_information.mutual_information(lines, ["l_quantity", "l_discount", "l_partkey"], "l_extendedprice", classes=bins)
    return out.withColumn("score", F.round("score", 6))


def _anova_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", round((sum(n * (m - mean) ** 2) / (count(*) - 1)) / (sum(n * v) / (any_value(total) - count(*))), 5) AS score
    FROM (SELECT l_returnflag, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY 1),
    (SELECT avg({c}) AS mean, count(*) AS total FROM lineitem)"""


@query("f_classif", " UNION ALL ".join(_anova_sql(c) for c in FEATURES))
def f_classif(spark, sf):
    out = selection.f_classif(table(spark, sf, "lineitem"), FEATURES, "l_returnflag")
    return out.withColumn("score", F.round("score", 5))


REGRESSORS = ["l_quantity", "l_discount", "l_tax"]


@query(
    "f_regression",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(corr({c}, l_extendedprice) ** 2 / (1 - corr({c}, l_extendedprice) ** 2) * (count(*) - 2), 4) AS score FROM lineitem"""
        for c in REGRESSORS
    ),
)
def f_regression(spark, sf):
    out = selection.f_regression(table(spark, sf, "lineitem"), REGRESSORS, "l_extendedprice")
    return out.withColumn("score", F.round("score", 4))


@query(
    "variance_rank",
    f"WITH t AS ({CUSTOMER_POINTS}), m AS (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in ("balance", "n_orders", "spend"))
    + " FROM t) SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(var_samp(coalesce({c}, m_{c})), 2) AS score FROM t, m"""
        for c in ("balance", "n_orders")
    )
    + ")",
)
def variance_rank(spark, sf):
    out = selection.variance_rank(customer_points(spark, sf), ["balance", "n_orders"])
    return out.withColumn("score", F.round("score", 2))


@query(
    "top_features",
    "SELECT * FROM (" + " UNION ALL ".join(_anova_sql(c) for c in FEATURES) + ') ORDER BY score DESC, "column" LIMIT 3',
)
def top_features(spark, sf):
    scores = selection.f_classif(table(spark, sf, "lineitem"), FEATURES, "l_returnflag")
    return selection.top_features(scores.withColumn("score", F.round("score", 5)), 3)


@query("extract_features")
def extract_features(spark, sf):
    frame = table(spark, sf, "lineitem").select(*FEATURES, "l_linestatus", "l_returnflag")
    return selection.extract_features(frame, "l_returnflag", k=3)


LINE_TIES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY_SQL = "(l_orderkey * 7 + l_partkey)"


def _permuted_sql(repeat: int) -> str:
    ties = ", ".join(LINE_TIES)
    moved = ", ".join(
        f"CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY b) THEN first_value({c}) OVER w ELSE lead({c}) OVER w END AS s_{c}"
        for c in WEIGHTS
    )
    return f"""SELECT {repeat} AS repeat, l_extendedprice / 1000 AS y, {', '.join(WEIGHTS)}, {moved} FROM
    (SELECT *, h % greatest(1, (SELECT count(*) FROM lineitem) // 10000) AS b FROM (SELECT *, {hash_sql(KEY_SQL, 100 + repeat)} AS h FROM lineitem))
    WINDOW w AS (PARTITION BY b ORDER BY h, {ties})"""


def _r2(name: str, q: str, d: str) -> str:
    p = f"(0.3::DOUBLE * {q} - 20.0::DOUBLE * {d})"
    return f"1 - sum((y - {p}) ** 2) / (var_pop(y) * count(*)) AS {name}"


@query(
    "permutation_importance",
    f"""WITH c AS ({' UNION ALL '.join(_permuted_sql(r) for r in range(5))}),
    m AS (SELECT repeat, {_r2('base', 'l_quantity', 'l_discount')}, {_r2('q', 's_l_quantity', 'l_discount')}, {_r2('d', 'l_quantity', 's_l_discount')} FROM c GROUP BY 1)
    SELECT 'l_quantity' AS feature, round(avg(base - q), 6) AS importance FROM m UNION ALL SELECT 'l_discount', round(avg(base - d), 6) FROM m""",
)
def permutation_importance(spark, sf):
    lines = table(spark, sf, "lineitem").select(*LINE_TIES).withColumn("y", F.col("l_extendedprice") / 1000)
    key = F.col("l_orderkey") * 7 + F.col("l_partkey")
    hashes = [seeded_hash(key, 100 + r) for r in range(explain.REPEATS)]

    def r2(frame, by):
        return metrics.regression_metrics(frame, "y", "score", by).withColumnRenamed("r2", "score")

    out = explain.permutation_importance(lines, list(WEIGHTS), score, r2, hashes, LINE_TIES)
    return out.select("feature", F.round("importance", 6).alias("importance"))


@query(
    "shap_linear",
    """WITH m AS (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'l_quantity' AS feature, round(0.3::DOUBLE * (l_quantity - mq), 6) AS phi FROM lineitem, m
    UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'l_discount', round(-20.0::DOUBLE * (l_discount - md), 6) FROM lineitem, m""",
)
def shap_linear(spark, sf):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    out = explain.linear_shap(table(spark, sf, "lineitem"), keys, WEIGHTS)
    return out.withColumn("phi", F.round("phi", 6))


@query(
    "shap_summary",
    """WITH m AS (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md FROM lineitem)
    SELECT 'l_quantity' AS feature, round(avg(abs(0.3::DOUBLE * (l_quantity - mq))), 6) AS mean_abs FROM lineitem, m
    UNION ALL SELECT 'l_discount', round(avg(abs(-20.0::DOUBLE * (l_discount - md))), 6) FROM lineitem, m""",
)
def shap_summary(spark, sf):
    values = explain.linear_shap(table(spark, sf, "lineitem"), ["l_orderkey"], WEIGHTS)
    return explain.mean_abs_shap(values).withColumn("mean_abs", F.round("mean_abs", 6))


@query(
    "what_if_grid",
    f"""WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_discount) AS c, max(l_discount) AS d FROM lineitem),
    s AS (SELECT unnest(generate_series(0, 4)) AS i)
    SELECT 'l_quantity' AS varied, round(a + (b - a) * i / 4, 6) AS setting, round(avg(0.3::DOUBLE * (a + (b - a) * i / 4) - 20.0::DOUBLE * l_discount), 6) AS mean_score
      FROM lineitem, r, s GROUP BY 1, 2
    UNION ALL SELECT 'l_discount', round(c + (d - c) * i / 4, 6), round(avg(0.3::DOUBLE * l_quantity - 20.0::DOUBLE * (c + (d - c) * i / 4)), 6) FROM lineitem, r, s GROUP BY 1, 2""",
)
def what_if_grid(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_discount")
    ranges = {r["column"]: (r["low"], r["high"]) for r in profile.feature_ranges(lines).collect()}
    out = explain.partial_dependence(lines, ranges, score, F.col("score"))
    return out.withColumns({"setting": F.round("setting", 6), "mean_score": F.round("mean_score", 6)})


@query(
    "what_if_first_row",
    f"""WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_discount) AS c, max(l_discount) AS d FROM lineitem),
    f AS (SELECT l_quantity AS q, l_discount AS t FROM lineitem ORDER BY {', '.join(LINE_TIES)} LIMIT 1), s AS (SELECT unnest(generate_series(0, 4)) AS i)
    SELECT 'l_quantity' AS varied, round(a + (b - a) * i / 4, 6) AS setting, round(0.3::DOUBLE * (a + (b - a) * i / 4) - 20.0::DOUBLE * t, 6) AS score FROM r, f, s
    UNION ALL SELECT 'l_discount', round(c + (d - c) * i / 4, 6), round(0.3::DOUBLE * q - 20.0::DOUBLE * (c + (d - c) * i / 4), 6) FROM r, f, s""",
)
def what_if_first_row(spark, sf):
    lines = table(spark, sf, "lineitem").select(*LINE_TIES)
    first = sampling.head_rows(lines, 1, *LINE_TIES).select("l_quantity", "l_discount").first().asDict()
    ranges = {
        r["column"]: (r["low"], r["high"])
        for r in profile.feature_ranges(lines.select("l_quantity", "l_discount")).collect()
    }
    grid = explain.what_if_grid(first, ranges)
    rows = [(g["varied"], float(g["setting"]), float(g["l_quantity"]), float(g["l_discount"])) for g in grid]
    frame = spark.createDataFrame(rows, "varied string, setting double, l_quantity double, l_discount double")
    return score(frame).select("varied", F.round("setting", 6).alias("setting"), F.round("score", 6).alias("score"))
