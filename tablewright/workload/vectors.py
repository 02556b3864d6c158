"""Chunking, retrieval and clustering queries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from tablewright.operators import clustering, retrieval
from tablewright.session import cut
from tablewright.workload import query, table
from tablewright.workload.frames import CUSTOMER_POINTS, customer_points
from tablewright.workload.preparation import _scaled_sql
from tablewright.workload.scalars import WORDS

CHUNKS = f"""SELECT doc_id, CAST(start // 320 AS INTEGER) AS chunk_id, list_aggregate(w[start + 1 : start + 400], 'string_agg', ' ') AS text
  FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1, 320)) AS start FROM (SELECT doc_id, {WORDS} AS w FROM documents))"""


@query("chunk_documents", CHUNKS)
def chunk_documents(spark, sf):
    return retrieval.chunk_documents(table(spark, sf, "documents", spread=True), "doc_id")


@query(
    "term_frequency",
    f"""SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM
    (SELECT doc_id, unnest({WORDS.replace('(text', '(lower(text)')}) AS term FROM documents) GROUP BY 1""",
)
def term_frequency(spark, sf):
    return retrieval.term_frequency(table(spark, sf, "documents", spread=True))


CENTRES = """SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM
  (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1"""


def _d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))"


def centres(spark, sf):
    """The mean vector of each class: a small query set that grows with the classes."""
    vectors = table(spark, sf, "embeddings")
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    return vectors.groupBy("label").agg(vector_to_array(mean).alias("embedding"))


TOP = f"""SELECT query_id, item_id, distance, rank FROM (SELECT label AS query_id, vec_id AS item_id, {_d2('embedding', 'c')} AS distance,
  row_number() OVER (PARTITION BY label ORDER BY {_d2('embedding', 'c')}, vec_id) AS rank FROM (SELECT vec_id, embedding FROM embeddings), ({CENTRES}) q) WHERE rank <= 4"""


def _top(spark, sf):
    queries = centres(spark, sf).withColumnRenamed("label", "query_id")
    return retrieval.nearest(table(spark, sf, "embeddings"), queries)


@query("vector_topk", f"SELECT query_id, item_id, round(distance, 6) AS distance, rank FROM ({TOP})")
def vector_topk(spark, sf):
    return _top(spark, sf).withColumn("distance", F.round("distance", 6))


@query(
    "retrieval_context",
    f"""SELECT query_id, count(*) AS chunks, left(string_agg(text, chr(10) || chr(10) ORDER BY rank), 300) AS context
    FROM ({TOP}) JOIN documents ON item_id = doc_id GROUP BY 1""",
)
def retrieval_context(spark, sf):
    return retrieval.context(_top(spark, sf), table(spark, sf, "documents"), "doc_id", limit=retrieval.ANSWER_CHARS)


@query("document_answers")
def document_answers(spark, sf):
    """Benchmark items as questions to an index over all documents."""
    index = retrieval.DocumentIndex().load(table(spark, sf, "documents", spread=True), "doc_id").build()
    return index.query(table(spark, sf, "benchmark"), "item_id")


@query("tfidf_embed")
def tfidf_embed(spark, sf):
    chunks = retrieval.chunk_documents(table(spark, sf, "documents", spread=True), "doc_id")
    return retrieval.fit_embedder(chunks, ["doc_id", "chunk_id"])[1]


@query(
    "kmeans_assign",
    f"""SELECT vec_id, CAST(arg_min(label, (round(d, 9), label)) AS INTEGER) AS cluster FROM
    (SELECT vec_id, q.label, {_d2('embedding', 'c')} AS d FROM embeddings, ({CENTRES}) q) GROUP BY 1""",
)
def kmeans_assign(spark, sf):
    means = sorted((r["label"], r["embedding"]) for r in centres(spark, sf).collect())
    out = clustering.assign_nearest(table(spark, sf, "embeddings"), "embedding", [m for _, m in means])
    return out.select("vec_id", "cluster")


@query(
    "silhouette",
    f"""WITH d AS (SELECT a.vec_id, a.label, b.label AS other, avg({_d2('a.embedding', 'b.embedding')}) AS m, count(*) AS n
      FROM embeddings a, embeddings b GROUP BY 1, 2, 3),
    s AS (SELECT vec_id, label, max(CASE WHEN label = other THEN m * n / greatest(n - 1, 1) END) AS a,
      min(CASE WHEN label <> other THEN m END) AS b, max(CASE WHEN label = other THEN n END) AS n FROM d GROUP BY 1, 2)
    SELECT label, round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette, count(*) AS points FROM s GROUP BY 1""",
)
def silhouette(spark, sf):
    rows = clustering.silhouette_rows(table(spark, sf, "embeddings"), "embedding", "label")
    return rows.groupBy("label").agg(F.round(F.avg("silhouette"), 6).alias("silhouette"), F.count(F.lit(1)).alias("points"))


PLANE = ["balance", "spend"]


def plane(spark, sf):
    """Scaled balance and spend per customer, rounded so both engines agree on distances."""
    from tablewright.operators.prepare import robust_scale

    scaled = robust_scale(customer_points(spark, sf).select("c_custkey", *PLANE), PLANE)
    return scaled.select("c_custkey", *[F.round(c, 6).alias(c) for c in PLANE])


NEAR = f"""p AS ({_scaled_sql(tuple(PLANE), CUSTOMER_POINTS, 'c_custkey')}),
  e AS (SELECT a.c_custkey AS a, b.c_custkey AS b FROM p a, p b WHERE (a.balance - b.balance) ** 2 + (a.spend - b.spend) ** 2 <= 0.01),
  k AS (SELECT a AS c_custkey, count(*) >= 5 AS core FROM e GROUP BY 1)"""


@query("dbscan_core", f"WITH {NEAR} SELECT c_custkey, core FROM k")
def dbscan_core(spark, sf):
    return clustering.core_points(plane(spark, sf), "c_custkey", PLANE, 0.1)


@query(
    "dbscan",
    f"""WITH RECURSIVE {NEAR}, g AS (SELECT e.a, e.b FROM e JOIN k x ON x.c_custkey = e.a AND x.core JOIN k y ON y.c_custkey = e.b AND y.core),
    r(a, label) AS (SELECT a, a FROM g WHERE a = b UNION SELECT g.b, r.label FROM r JOIN g ON g.a = r.a WHERE g.b > r.label),
    l AS (SELECT a, min(label) AS label FROM r GROUP BY 1)
    SELECT k.c_custkey, k.core, coalesce(CASE WHEN core THEN (SELECT label FROM l WHERE l.a = k.c_custkey)
      ELSE (SELECT min(label) FROM e JOIN l ON l.a = e.b WHERE e.a = k.c_custkey) END, -1) AS cluster FROM k""",
)
def dbscan(spark, sf):
    return clustering.dbscan(plane(spark, sf), "c_custkey", PLANE, 0.1)


WIDE = f"""p AS (SELECT c_custkey, round(balance * 20, 6) AS balance, round(spend * 20, 6) AS spend FROM ({_scaled_sql(tuple(PLANE), CUSTOMER_POINTS, 'c_custkey')})),
  q AS (SELECT a.c_custkey AS a, b.c_custkey AS b, (a.balance - b.balance) ** 2 + (a.spend - b.spend) ** 2 AS d FROM p a, p b),
  fifth AS (SELECT a, d FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM q) WHERE r = 5),
  radius AS (SELECT 0.3::DOUBLE AS low, 0.6::DOUBLE AS high, true AS growing, 0 AS step
    UNION ALL SELECT CASE WHEN growing THEN CASE WHEN much THEN low ELSE high END WHEN half THEN low ELSE (low + high) / 2 END,
      CASE WHEN growing THEN CASE WHEN much THEN high ELSE 2 * high END WHEN half THEN (low + high) / 2 ELSE high END,
      growing AND NOT much, step + 1
    FROM (SELECT r.*, (SELECT avg(CASE WHEN d <= r.high * r.high THEN 1.0 ELSE 0.0 END) FROM fifth) >= 0.9 AS much,
        (SELECT avg(CASE WHEN d <= (r.low + r.high) / 2 * (r.low + r.high) / 2 THEN 1.0 ELSE 0.0 END) FROM fifth) >= 0.9 AS half FROM radius r)
    WHERE growing OR high - low > 0.01 * low),
  eps AS (SELECT CASE WHEN (SELECT avg(CASE WHEN d <= 0.09 THEN 1.0 ELSE 0.0 END) FROM fifth) >= 0.9 THEN 0.3 ELSE arg_max(high, step) END AS eps FROM radius),
  e AS (SELECT a, b FROM q, eps WHERE d <= eps * eps),
  k AS (SELECT a AS c_custkey, count(*) >= 5 AS core FROM e GROUP BY 1)"""


@query(
    "dbscan_auto",
    f"""WITH RECURSIVE {WIDE}, g AS (SELECT e.a, e.b FROM e JOIN k x ON x.c_custkey = e.a AND x.core JOIN k y ON y.c_custkey = e.b AND y.core),
    r(a, label) AS (SELECT a, a FROM g WHERE a = b UNION SELECT g.b, r.label FROM r JOIN g ON g.a = r.a WHERE g.b > r.label),
    l AS (SELECT a, min(label) AS label FROM r GROUP BY 1)
    SELECT k.c_custkey, k.core, coalesce(CASE WHEN core THEN (SELECT label FROM l WHERE l.a = k.c_custkey)
      ELSE (SELECT min(label) FROM e JOIN l ON l.a = e.b WHERE e.a = k.c_custkey) END, -1) AS cluster FROM k""",
)
def dbscan_auto(spark, sf):
    """Density clusters with the radius found from the data."""
    wide = plane(spark, sf).select("c_custkey", *[F.round(F.col(c) * 20, 6).alias(c) for c in PLANE])
    return clustering.dbscan(wide, "c_custkey", PLANE)


FIVE = [f"e{i}" for i in range(1, 6)]


@query(
    "dbscan_wide",
    f"""WITH RECURSIVE p AS (SELECT vec_id, {", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(FIVE))} FROM embeddings),
    e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a, p b WHERE {" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in FIVE)} <= 0.13::DOUBLE * 0.13::DOUBLE),
    k AS (SELECT a AS vec_id, count(*) >= 5 AS core FROM e GROUP BY 1),
    g AS (SELECT e.a, e.b FROM e JOIN k x ON x.vec_id = e.a AND x.core JOIN k y ON y.vec_id = e.b AND y.core),
    r(a, label) AS (SELECT a, a FROM g WHERE a = b UNION SELECT g.b, r.label FROM r JOIN g ON g.a = r.a WHERE g.b > r.label),
    l AS (SELECT a, min(label) AS label FROM r GROUP BY 1)
    SELECT k.vec_id, k.core, coalesce(CASE WHEN core THEN (SELECT label FROM l WHERE l.a = k.vec_id)
      ELSE (SELECT min(label) FROM e JOIN l ON l.a = e.b WHERE e.a = k.vec_id) END, -1) AS cluster FROM k""",
)
def dbscan_wide(spark, sf):
    """Density clusters of five columns."""
    rows = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(FIVE)])
    return clustering.dbscan(rows, "vec_id", FIVE, 0.13)


def _shape(spark, sf):
    return cut(clustering.feature_vectors(customer_points(spark, sf), ["balance", "n_orders", "spend"]).select("c_custkey", "features"))


@query("kmeans_auto")
def kmeans_auto(spark, sf):
    out, _, _, _ = clustering.kmeans_auto(_shape(spark, sf), seeds=(42, 43))
    return out.select("c_custkey", "cluster")


@query("gmm_auto")
def gmm_auto(spark, sf):
    out, _, _, _ = clustering.gmm_auto(_shape(spark, sf))
    return out.select("c_custkey", "cluster")


@query("hierarchical")
def hierarchical(spark, sf):
    out, _, _, _ = clustering.hierarchical_auto(_shape(spark, sf))
    return out.select("c_custkey", "cluster")


@query("pca2")
def pca2(spark, sf):
    return clustering.pca2(customer_points(spark, sf), ["balance", "n_orders", "spend"]).select("c_custkey", "pc1", "pc2")
