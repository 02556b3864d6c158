"""Cleaning, feature preparation, sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import prepare, sampling
from tablewright.operators.ranking import seeded_hash
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


def hash_sql(key: str, seed: int = 42) -> str:
    return f"((({key} % 2147483647) * 1103515245 + {12345 + seed}) % 2147483647)"


@query(
    "clean_rows",
    f"SELECT DISTINCT n_chars, lang, source, quality FROM ({LABELLED}) WHERE quality IS NOT NULL",
)
def clean_rows(spark, sf):
    return prepare.clean_rows(labelled(spark, sf).select("n_chars", "lang", "source", "quality"), "quality")


@query("drop_copies", f"SELECT DISTINCT * FROM ({REPEATED})")
def drop_copies(spark, sf):
    return prepare.clean_rows(repeated_lines(spark, sf), "l_returnflag")


CUSTOMER_ID = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, 'retail' AS channel FROM customer"


@query(
    "id_like_columns",
    f"WITH t AS ({CUSTOMER_ID}), n AS (SELECT count(*) AS n FROM t) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct",
        count(DISTINCT {c}) <= 1 OR (count(DISTINCT {c}) >= 0.98 * any_value(n) AND {c != 'c_acctbal'}) AS "drop" FROM t, n"""
        for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "channel")
    ),
)
def id_like_columns(spark, sf):
    return prepare.id_like_columns(table(spark, sf, "customer").withColumn("channel", F.lit("retail")), "c_mktsegment")


@query(
    "impute_preview",
    f"""WITH t AS ({ORDERS_GAPS}), m AS (SELECT quantile_cont(o_totalprice, 0.5) AS price FROM t),
    c AS (SELECT o_orderpriority AS p FROM t WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT o_orderkey, coalesce(o_totalprice, price) AS o_totalprice, coalesce(o_orderpriority, p) AS o_orderpriority,
    o_orderstatus FROM t, m, c""",
)
def impute_preview(spark, sf):
    frame = orders_gaps(spark, sf).select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return prepare.impute_preview(frame, "o_orderstatus")


def _scaled_sql(columns, frame, key):
    mids = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in columns)
    filled = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in columns)
    spread = ", ".join(f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}" for c in columns)
    scaled = ", ".join(
        f"round(({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END, 6) AS {c}" for c in columns
    )
    return f"""WITH t AS ({frame}), m AS (SELECT {mids} FROM t), f AS (SELECT {key}, {filled} FROM t, m),
    s AS (SELECT {spread} FROM f) SELECT {key}, {scaled} FROM f, m, s"""


@query("robust_scale", _scaled_sql(("o_totalprice", "o_custkey"), ORDERS_GAPS, "o_orderkey"))
def robust_scale(spark, sf):
    columns = ["o_totalprice", "o_custkey"]
    scaled = prepare.robust_scale(orders_gaps(spark, sf).select("o_orderkey", *columns), columns)
    return scaled.select("o_orderkey", *[F.round(c, 6).alias(c) for c in columns])


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


@query(
    "one_hot",
    f"""WITH t AS ({ORDERS_GAPS}), c AS (SELECT o_orderpriority AS p FROM t WHERE o_orderpriority IS NOT NULL
      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), f AS (SELECT o_orderkey, coalesce(o_orderpriority, p) AS p, o_orderstatus AS s FROM t, c)
    SELECT o_orderkey, """
    + ", ".join(f"""CAST(p = '{v}' AS INTEGER) AS "o_orderpriority={v}" """ for v in PRIORITIES)
    + ", "
    + ", ".join(f"""CAST(s = '{v}' AS INTEGER) AS "o_orderstatus={v}" """ for v in "FOP")
    + " FROM f",
)
def one_hot(spark, sf):
    frame = orders_gaps(spark, sf).select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return prepare.one_hot(frame, ["o_orderpriority", "o_orderstatus"])


@query(
    "ohe_capped",
    """WITH c AS (SELECT p_name AS v, row_number() OVER (ORDER BY count(*) DESC, p_name) AS r, count(*) OVER () AS k FROM part GROUP BY 1),
    t AS (SELECT p_partkey, CASE WHEN r <= 49 OR k <= 50 THEN p_name ELSE '__infrequent__' END AS level FROM part JOIN c ON p_name = v)
    SELECT level, count(*) AS n, sum(p_partkey) AS keys FROM (SELECT p_partkey, level FROM t) GROUP BY 1""",
)
def ohe_capped(spark, sf):
    parts = table(spark, sf, "part")
    levels = prepare.category_levels(parts, ["p_name"], 50)["p_name"]
    capped = parts.select("p_partkey", prepare.cap_category("p_name", levels).alias("level"))
    return capped.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"))


@query(
    "cardinality_split",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct",
        CASE WHEN count(DISTINCT {c}) <= 10 THEN 'low' ELSE 'high' END AS cardinality FROM part"""
        for c in ("p_name", "p_brand", "p_type")
    ),
)
def cardinality_split(spark, sf):
    return prepare.cardinality_split(table(spark, sf, "part"))


@query(
    "label_encode",
    "SELECT p_partkey, p_name, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INTEGER) AS code FROM part",
)
def label_encode(spark, sf):
    return prepare.label_codes(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name")


@query(
    "category_codes",
    f"""SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'nan')) - 1 AS INTEGER) AS code
    FROM ({ORDERS_GAPS})""",
)
def category_codes(spark, sf):
    frame = orders_gaps(spark, sf).select("o_orderkey", "o_orderpriority")
    return prepare.label_codes(frame, "o_orderpriority", missing="nan").select("o_orderkey", "code")


@query(
    "dummies_drop_first",
    f"""SELECT o_orderkey, coalesce(o_totalprice, 0) AS o_totalprice, """
    + ", ".join(
        f"""CAST(coalesce(o_orderpriority = '{v}', false) AS INTEGER) AS "o_orderpriority_{v}" """ for v in PRIORITIES[1:]
    )
    + f", o_orderstatus FROM ({ORDERS_GAPS})",
)
def dummies_drop_first(spark, sf):
    frame = orders_gaps(spark, sf).select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return prepare.dummies(frame, "o_orderstatus")


@query("head_rows", "SELECT * FROM events ORDER BY event_id LIMIT 5000")
def head_rows(spark, sf):
    return sampling.head_rows(table(spark, sf, "events"), 5000, "event_id")


@query(
    "sample_fixed",
    f"SELECT * FROM orders ORDER BY {hash_sql('o_orderkey')}, o_orderkey LIMIT 2000",
)
def sample_fixed(spark, sf):
    return sampling.sample_rows(table(spark, sf, "orders"), 2000, seeded_hash(F.col("o_orderkey")), ["o_orderkey"])


def _split_sql(by: str, frame: str, key: str) -> str:
    window = f"PARTITION BY {by} " if by else ""
    label = by or "NULL"
    return f"""WITH r AS (SELECT {key}, row_number() OVER ({window}ORDER BY {hash_sql(key)}, {key}) AS r,
      count(*) OVER ({window}) AS n FROM {frame})
    SELECT {key}, CASE WHEN r <= (n * 700) // 1000 THEN 'train' WHEN r <= (n * 850) // 1000 THEN 'val' ELSE 'test' END AS split FROM r"""


@query("stratified_split", _split_sql("quality", "labels", "doc_id"))
def stratified_split(spark, sf):
    rows = table(spark, sf, "labels")
    return sampling.split_rows(rows, seeded_hash(F.col("doc_id")), ["doc_id"], "quality").select("doc_id", "split")


@query("random_split", _split_sql("", "orders", "o_orderkey"))
def random_split(spark, sf):
    rows = table(spark, sf, "orders")
    split = sampling.split_rows(rows, seeded_hash(F.col("o_orderkey")), ["o_orderkey"])
    return split.select("o_orderkey", "split")


@query(
    "scaled_points",
    _scaled_sql(("balance", "n_orders", "spend"), CUSTOMER_POINTS, "c_custkey"),
)
def scaled_points(spark, sf):
    columns = ["balance", "n_orders", "spend"]
    scaled = prepare.robust_scale(customer_points(spark, sf), columns)
    return scaled.select("c_custkey", *[F.round(c, 6).alias(c) for c in columns])
