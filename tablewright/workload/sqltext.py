"""Guarded SQL: statement cleaning, the guard, and statements run through it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import text
from tablewright.operators.sqlguard import SqlDesk
from tablewright.workload import query, table

SP = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# One candidate statement per document: fenced, commented, its opening word by language.
STATEMENTS = """SELECT doc_id, concat('```SQL', chr(10), CASE lang WHEN 'en' THEN 'select' WHEN 'fr' THEN 'WITH'
  WHEN 'de' THEN ' SELECT' ELSE 'drop' END, ' `n_chars` -- ', source, chr(10), '/* ', text, ' */ FROM documents;', chr(10), '```') AS raw
  FROM documents"""

CLEANED = f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(raw, '```(?:sql)?', '', 'gi'), '`', ''),
  '--[^\\n]*', '', 'g'), '/\\*.*?\\*/', '', 'gs'), '^[{SP}]+|[{SP}]+$', '', 'g') AS cleaned FROM ({STATEMENTS})"""


def _statements(spark, sf):
    word = (
        F.when(F.col("lang") == "en", "select").when(F.col("lang") == "fr", "WITH")
        .when(F.col("lang") == "de", " SELECT").otherwise("drop")
    )
    raw = F.concat(
        F.lit("```SQL\n"), word, F.lit(" `n_chars` -- "), F.col("source"), F.lit("\n/* "), F.col("text"),
        F.lit(" */ FROM documents;\n```"),
    )
    return table(spark, sf, "documents", spread=True).select("doc_id", raw.alias("raw"))


@query("sql_clean", CLEANED)
def sql_clean(spark, sf):
    return _statements(spark, sf).select("doc_id", text.clean_statement(F.col("raw")).alias("cleaned"))


@query(
    "sql_guard",
    f"""SELECT upper(regexp_extract(cleaned, '^[{SP}]*([^{SP}]+)', 1)) AS token,
    upper(regexp_extract(cleaned, '^[{SP}]*([^{SP}]+)', 1)) = 'SELECT' AS allowed, count(*) AS n FROM ({CLEANED}) GROUP BY 1, 2""",
)
def sql_guard(spark, sf):
    cleaned = _statements(spark, sf).select(text.clean_statement(F.col("raw")).alias("s"))
    return cleaned.groupBy(
        text.first_token(F.col("s")).alias("token"), text.is_select(F.col("s")).alias("allowed")
    ).agg(F.count(F.lit(1)).alias("n"))


PASSED = {
    "sql_fallback": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
    "sql_join_inner": """SELECT n_name, o_orderstatus, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderstatus""",
    "sql_join_left": """SELECT d.lang, count(*) AS docs, count(l.doc_id) AS labelled, sum(l.quality) AS good
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""",
    "sql_join_full": """SELECT coalesce(a.k, b.k) AS k, a.customers, b.suppliers FROM
      (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey) a
      FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) b
      ON a.k = b.k""",
    "sql_join_semi": """SELECT count(*) AS n, sum(n_chars) AS chars FROM documents d LEFT SEMI JOIN labels l ON d.doc_id = l.doc_id""",
    "sql_join_anti": """SELECT lang, count(*) AS n FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""",
    "sql_join_theta": """SELECT a.st, count(*) AS n, max(o.o_totalprice) AS top FROM orders o JOIN
      (SELECT o_orderstatus AS st, avg(o_totalprice) AS mean FROM orders GROUP BY o_orderstatus) a
      ON o.o_totalprice > a.mean AND o.o_orderstatus <> a.st GROUP BY a.st""",
    "sql_window_rank": """SELECT * FROM (SELECT c_nationkey, c_name, c_acctbal,
      rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r FROM customer) t WHERE r <= 3""",
    "sql_window_frame": """SELECT o_orderstatus, o_day, orders, sum(orders) OVER (PARTITION BY o_orderstatus ORDER BY o_day
      ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS week_orders FROM
      (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS o_day, count(*) AS orders FROM orders GROUP BY o_orderstatus, CAST(o_orderdate AS DATE)) t""",
    "sql_rollup": """SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS g FROM lineitem
      GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "sql_cube": """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "sql_grouping_sets": """SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM documents
      GROUP BY GROUPING SETS ((lang), (source), ())""",
    "sql_distinct_agg": """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers,
      count(*) AS n FROM lineitem GROUP BY l_returnflag""",
    "sql_union": """SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation""",
    "sql_union_all": """SELECT side, count(*) AS n FROM (SELECT 'c' AS side, c_nationkey AS k FROM customer
      UNION ALL SELECT 's', s_nationkey FROM supplier) t GROUP BY side""",
    "sql_intersect": """SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'""",
    "sql_intersect_all": """SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'""",
    "sql_except": """SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""",
    "sql_except_all": """SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'""",
    "sql_cte_inside_select": """SELECT * FROM (WITH spend AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY o_custkey)
      SELECT c_mktsegment, count(*) AS buyers, max(total) AS best FROM spend JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment) t""",
    "sql_correlated_exists": """SELECT c_mktsegment, count(*) AS n FROM customer c WHERE EXISTS
      (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000) GROUP BY c_mktsegment""",
    "sql_scalar_subquery": """SELECT count(*) AS above, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders
      WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)""",
    "sql_correlated_scalar": """SELECT p_brand, count(*) AS n FROM part p WHERE p_retailprice >
      (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand) GROUP BY p_brand""",
    "sql_case": """SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size,
      count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS price FROM lineitem GROUP BY 1""",
    "sql_having": """SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 40""",
    "sql_in_subquery": """SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey IN
      (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_orderpriority""",
    "sql_filter_agg": """SELECT event_type, count(*) FILTER (WHERE value > 50) AS big, max(value) AS top FROM events GROUP BY event_type""",
    "sql_lateral": """SELECT n.n_name, t.top FROM nation n, LATERAL (SELECT max(c.c_acctbal) AS top FROM customer c
      WHERE c.c_nationkey = n.n_nationkey) t""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


def _register(name: str, statement: str) -> None:
    oracle = statement.replace("LEFT SEMI JOIN", "SEMI JOIN").replace("LEFT ANTI JOIN", "ANTI JOIN")

    @query(name, oracle)
    def run(spark, sf):
        desk = SqlDesk(spark)
        for t in TABLES:
            if t in statement:
                desk.register(t, table(spark, sf, t))
        out = desk.run(f"```sql\n{statement}\n``` -- {name}")
        if not out["success"]:
            raise ValueError(out["error"])
        return out["result"]


for _name, _statement in PASSED.items():
    _register(_name, _statement)
