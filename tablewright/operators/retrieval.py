"""Document chunks, their vectors, exact nearest neighbours and retrieved context."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions.text import chunk_starts, words
from tablewright.session import cut, stored

CHUNK_WORDS = 400
CHUNK_OVERLAP = 80
TOP_K = 4
ANSWER_CHARS = 300
QUERY_BATCH = 1024
#: rows of the base compared with one batch of queries in one task
BASE_BLOCK = 65_536
BROADCAST_HITS = 100_000


def chunk_documents(
    df: DataFrame, key: str, text: str = "text", size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """``(key, chunk_id, text)``: word windows of ``size``, each starting ``size - overlap``
    words after the one before, until the start passes the last word."""
    split = df.select(key, words(F.col(text)).alias("__w"))
    starts = chunk_starts(F.size("__w"), size, overlap)
    out = split.select(key, "__w", F.posexplode(starts).alias("chunk_id", "__at"))
    return out.select(key, "chunk_id", F.array_join(F.slice("__w", F.col("__at") + 1, F.lit(size)), " ").alias("text"))


def term_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    """``(term, n, docs)`` over lower-cased words; hot terms combine before the shuffle."""
    # sorted words: a word unlike the one before it is the document's first use of it
    listed = df.select(F.array_sort(words(F.lower(text))).alias("__w"))
    before = F.transform("__w", lambda w, i: F.when(i > 0, F.get("__w", i - 1)))
    uses = listed.select(F.inline(F.arrays_zip(F.col("__w").alias("term"), before.alias("before"))))
    first = F.col("before").isNull() | (F.col("before") != F.col("term"))
    return uses.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_if(first).alias("docs"))


def fit_embedder(df: DataFrame, keep: Sequence[str], text: str = "text", dim: int = 1024) -> tuple[PipelineModel, DataFrame]:
    """TF-IDF over hashed terms, unit length: stands for a sentence encoder.

    Returns the model and the vectors of the rows it was fitted on, with the columns ``keep``. Their
    texts are split and hashed once: the counts are written, and both the fit and the vectors read them.
    """
    tokens = df.select(*keep, words(F.lower(text)).alias("tokens"))
    hashed = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=dim)
    counted = stored(hashed.transform(tokens).drop("tokens"))
    weigh = [IDF(inputCol="tf", outputCol="idf").fit(counted), Normalizer(inputCol="idf", outputCol="vec")]
    vectors = PipelineModel(weigh).transform(counted)
    return PipelineModel([hashed, *weigh]), vectors.select(*keep, vector_to_array("vec").alias("embedding"))


def embed(model: PipelineModel, df: DataFrame, text: str = "text", name: str = "embedding") -> DataFrame:
    out = model.transform(df.withColumn("tokens", words(F.lower(text))))
    return out.select(*df.columns, vector_to_array("vec").alias(name))


def _partial_top(ids: str, vector: str, keys: list, points: np.ndarray, k: int):
    """Best ``k`` rows of one task for each query, as a function for ``mapInPandas``."""
    norms = (points**2).sum(axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [(np.empty(0), np.empty(0, dtype="int64"))] * len(points)
        for batch in batches:
            if batch.empty:
                continue
            base = np.stack(batch[vector].to_numpy()).astype("float64")
            names = batch[ids].to_numpy(dtype="int64")
            rough = (base**2).sum(axis=1)[:, None] + norms - 2.0 * (base @ points.T)
            slack = 1e-9 * (1.0 + norms + rough.max(initial=0.0))
            for j, point in enumerate(points):
                near = rough[:, j]
                if len(near) > k:
                    near_enough = np.partition(near, k - 1)[k - 1] + slack[j]
                    pick = np.flatnonzero(near <= near_enough)
                else:
                    pick = np.arange(len(near))
                exact = ((base[pick] - point) ** 2).sum(axis=1)
                d = np.concatenate([best[j][0], exact])
                i = np.concatenate([best[j][1], names[pick]])
                order = np.lexsort((i, d))[:k]
                best[j] = (d[order], i[order])
        for j, (d, i) in enumerate(best):
            yield pd.DataFrame({"query_id": keys[j], "item_id": i, "distance": d})

    return run


def nearest(
    base: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    ids: str = "vec_id",
    vector: str = "embedding",
    query_id: str = "query_id",
    batch: int = QUERY_BATCH,
) -> DataFrame:
    """``(query_id, item_id, distance, rank)``: the exact ``k`` nearest by squared distance.

    Up to ``batch`` queries go to every task and the base is not shuffled. More are a table
    like any other: queries and base are dealt into blocks, each pair of blocks is compared in
    one task that keeps ``k`` rows per query, and only those are ranked together. The plan is
    the same for any number of queries, and no pair of rows is ever shuffled. Ids are integers.
    """
    slim = base.select(F.col(ids).alias("item_id"), F.col(vector).alias("v"))
    numbered = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(vector).alias("v"))
    kind = "query_id bigint, item_id bigint, distance double"
    few = numbered.limit(batch + 1).collect()
    if not few:
        return base.sparkSession.createDataFrame([], f"{kind}, rank int")
    if len(few) <= batch:
        points = np.array([r["v"] for r in few], dtype="float64")
        parts = slim.mapInPandas(_partial_top("item_id", "v", [r["query_id"] for r in few], points, k), kind)
    else:
        turns, dealt = -(-numbered.count() // batch), max(1, -(-slim.count() // BASE_BLOCK))
        left = slim.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(dealt)))
        left = left.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(turns - 1).cast("bigint"))))
        right = numbered.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)))
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(dealt - 1).cast("bigint"))))

        def compare(some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if some.empty or asked.empty:
                return pd.DataFrame({"query_id": [], "item_id": [], "distance": []})
            points = np.stack(asked["v"].to_numpy()).astype("float64")
            return pd.concat(_partial_top("item_id", "v", asked["query_id"].tolist(), points, k)(iter([some])))

        parts = left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInPandas(compare, kind)
    order = W.partitionBy("query_id").orderBy("distance", "item_id")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def context(hits: DataFrame, texts: DataFrame, ids: str, text: str = "text", limit: int | None = None) -> DataFrame:
    """Per query the retrieved texts in rank order, joined by a blank line (at most ``k``).

    The hits are written out and counted: up to ``BROADCAST_HITS`` of them go to the texts,
    which then need no shuffle.
    """
    hits = cut(hits.select("query_id", "item_id", "rank"))
    few = hits.count() <= BROADCAST_HITS
    listed = texts.select(F.col(ids).alias("item_id"), F.col(text).alias("__t"))
    joined = listed.join(F.broadcast(hits) if few else hits, "item_id")
    ranked = joined.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "__t"))).alias("l"))
    whole = F.array_join(F.col("l")["__t"], "\n\n")
    return ranked.select("query_id", F.size("l").alias("chunks"), (F.left(whole, F.lit(limit)) if limit else whole).alias("context"))


class DocumentIndex:
    """Chunks and vectors of a document table, asked with ``query``.

    ``build`` writes the vectors to the shared folder once; every query then reads them.
    """

    def __init__(self, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, dim: int = 1024) -> None:
        self.size, self.overlap, self.dim = size, overlap, dim
        self.chunks: DataFrame | None = None
        self.model: PipelineModel | None = None
        self.vectors: DataFrame | None = None

    def load(self, df: DataFrame, key: str, text: str = "text") -> "DocumentIndex":
        chunks = chunk_documents(df, key, text, self.size, self.overlap)
        # numbered once and written, so keys of any type and any number of chunks are told apart
        self.chunks = stored(chunks.withColumn("item_id", F.monotonically_increasing_id()))
        return self

    def build(self) -> "DocumentIndex":
        if self.chunks is None:
            raise ValueError("load documents first")
        self.model, vectors = fit_embedder(self.chunks, ["item_id"], "text", self.dim)
        self.vectors = cut(vectors.withColumn("embedding", F.col("embedding").cast("array<float>")))
        return self

    def query(self, questions: DataFrame, key: str, text: str = "text", k: int = TOP_K) -> DataFrame:
        """Per question the retrieved context (or a note that nothing is indexed)."""
        if self.vectors is None:
            note = F.lit("No document indexed.")
            return questions.select(F.col(key).cast("bigint").alias("query_id"), F.lit(0).alias("chunks"), note.alias("context"))
        asked = embed(self.model, questions.select(F.col(key).alias("query_id"), F.col(text).alias("text")))
        hits = nearest(self.vectors, asked, k, ids="item_id")
        return context(hits, self.chunks, "item_id")
