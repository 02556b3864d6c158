"""Input frames with missing values and copies, as DataFrames and as SQL.

The driver's tables hold no nulls, so missing values come from their meaning: a pending
order has no final price, priority 4 is "not specified", most documents carry no label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import cut
from tablewright.workload import table

ORDERS_GAPS = """SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice,
  o_orderdate, NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders"""


def orders_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumns(
        {
            "o_totalprice": F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")),
            "o_orderpriority": F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")),
        }
    )


LABELLED = """SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


LINES = "l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split()


def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items without keys, where equal rows do occur."""
    return table(spark, sf, "lineitem").select(
        "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"
    )


REPEATED = "SELECT l_linenumber, l_quantity, l_discount, l_returnflag, l_linestatus FROM lineitem"

CUSTOMER_POINTS = """SELECT c.c_custkey, c.c_acctbal AS balance, o.n_orders, o.spend
  FROM customer c LEFT JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_orders,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM orders GROUP BY 1) o
  ON c.c_custkey = o.o_custkey"""


def customer_points(spark: SparkSession, sf: str) -> DataFrame:
    """Balance, order count and spend per customer; the exact sums keep engines equal.

    Written once: scaling and fits read them many times, and would add up all orders each time.
    """
    spend = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend"),
    )
    customers = table(spark, sf, "customer")
    joined = customers.join(spend, customers.c_custkey == spend.o_custkey, "left")
    return cut(joined.select("c_custkey", F.col("c_acctbal").alias("balance"), "n_orders", "spend"))
