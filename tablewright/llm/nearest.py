"""Approximate nearest neighbours by cosine: probed lists, scanned by column blocks that give up early."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.llm.common import append, field
from tablewright.session import stored

#: rows the list centres are fitted on, those of the smallest hash (a documented bound)
FIT_ROWS = 16_384
#: lists: about the square root of the rows, at most this many
MOST_LISTS = 4096
#: share of the true neighbours whose lists a query must probe, as measured on trial queries
TARGET = 0.95
LEAST_PROBED = 8
#: queries of that measurement (a documented bound); each meets the whole table
_TRIALS = 256
#: columns of one block of the scan
BLOCK = 16
#: standard errors by which an early estimate must miss the bound before a candidate is given up
DOUBT = 2.5
#: vectors of one part of a list; a list of more is dealt out in parts
PART = 8192
#: queries compared with a part at once
_QUERIES = 128
_ROUNDS = 12
SEED = 42


def usable(vector: Column) -> Column:
    """True if a vector has at least one component that is not zero, and none null, infinite or NaN."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, so that any block of columns is a fair sample of a distance."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, lists: int, seed: int = SEED) -> np.ndarray:
    """Spherical k-means on the bounded sample."""
    rng = np.random.default_rng(seed)
    middle = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(_ROUNDS):
        near = np.argmax(sample @ middle.T, axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1)
        middle[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return middle


def lists_to_probe(trials: np.ndarray, middle: np.ndarray, trial: np.ndarray, owner: np.ndarray, target: float = TARGET) -> int:
    """How many of its nearest lists a query must probe to meet ``target`` of the true neighbours:
    ``owner`` has the list of each, ``trial`` the row of ``trials`` whose neighbour it is."""
    place = np.argsort(np.argsort(-(trials @ middle.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(place[trial, owner])
    most = ranks[max(0, int(np.ceil(target * len(ranks))) - 1)] + 1 if len(ranks) else 0
    return int(min(len(middle), max(LEAST_PROBED, most)))


def _true_neighbours(listed: DataFrame, names: np.ndarray, trials: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(trial, list)`` of the ``k`` nearest other vectors of each trial, by brute force over the whole
    table. A task keeps the best ``k`` of its rows, so what is shuffled does not grow with them."""
    sent = listed.sparkSession.sparkContext.broadcast((names, trials))

    def run(batches):
        own, points = sent.value
        near = np.full((len(points), k), -np.inf)
        vid, owner = (np.zeros((len(points), k), dtype=np.int64) for _ in range(2))
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                ids, lists = (np.asarray(some.column(c), dtype=np.int64) for c in (0, 2))
                found = points @ _unit(_numbers(some.column(1), size)).T
                found[own[:, None] == ids[None, :]] = -np.inf
                near = np.concatenate([near, found], axis=1)
                vid, owner = (np.concatenate([x, np.broadcast_to(y, found.shape)], axis=1) for x, y in ((vid, ids), (owner, lists)))
                best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                near, vid, owner = (np.take_along_axis(x, best, axis=1) for x in (near, vid, owner))
        trial, place = np.nonzero(np.isfinite(near))
        columns = [pa.array(x, t) for x, t in ((trial, pa.int64()), (near[trial, place], pa.float64()), (vid[trial, place], pa.int64()), (owner[trial, place], pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["trial", "near", "vid", "list"])

    found = listed.select("vid", "v", "list").mapInArrow(run, "trial bigint, near double, vid bigint, list bigint")
    order = W.partitionBy("trial").orderBy(F.desc("near"), "vid")
    rows = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("trial", "list").collect()
    return np.array([r["trial"] for r in rows], dtype=np.int64), np.array([r["list"] for r in rows], dtype=np.int64)


def scan(queries: np.ndarray, base: np.ndarray, bound: np.ndarray, block: int = BLOCK, doubt: float = DOUBT):
    """Candidates of one list part that survive the scan of all column blocks: ``(query, row, distance²)``.

    ``bound`` has the squared distance a query can already count on. After each block the
    distance seen so far, scaled up to all columns, estimates the whole one; a candidate goes
    when the estimate misses the bound by more than its doubt, ``doubt / sqrt(columns seen)``.
    """
    size = base.shape[1]
    q, r = np.meshgrid(np.arange(len(queries), dtype=np.int32), np.arange(len(base), dtype=np.int32), indexing="ij")
    q, r, seen = q.ravel(), r.ravel(), None
    for start in range(0, size, block):
        end = min(size, start + block)
        if seen is None:  # the first block of all candidates as one product
            a, b = queries[:, start:end], base[:, start:end]
            seen = np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0).ravel()
        else:
            part = queries[q, start:end] - base[r, start:end]
            seen = seen + np.einsum("ij,ij->i", part, part)
        if end < size:
            keep = seen * (size / end) <= bound[q] * (1.0 + doubt / np.sqrt(end)) ** 2
        else:
            keep = seen <= bound[q] * (1.0 + 1e-9) + 1e-12
        q, r, seen = q[keep], r[keep], seen[keep]
    return q, r, seen


def _bounds(queries: np.ndarray, base: np.ndarray, k: int) -> np.ndarray:
    """The k-th smallest exact distance to a few rows of the part: what a query can count on."""
    few = base[: max(64, 4 * k)]
    if len(few) < k:
        return np.full(len(queries), np.inf)
    exact = np.maximum(2.0 - 2.0 * (queries @ few.T), 0.0)
    return np.partition(exact, k - 1, axis=1)[:, k - 1]


def _search_part(size: int, k: int):
    """Best ``k`` of one list part for each of its queries, as a function for ``cogroup``."""
    import pandas as pd

    turn = rotation(size)

    def run(key, base_rows, query_rows):
        empty = pd.DataFrame({"qid": np.zeros(0, np.int64), "vid": np.zeros(0, np.int64), "far": np.zeros(0)})
        if base_rows.empty or query_rows.empty:
            return empty
        names, asked = base_rows["vid"].to_numpy(), query_rows["qid"].to_numpy()
        base, points = (_unit(np.stack(x["v"].to_numpy())) @ turn for x in (base_rows, query_rows))
        out = [empty]
        for i in range(0, len(points), _QUERIES):
            some = points[i : i + _QUERIES]
            q, r, far = scan(some, base, _bounds(some, base, k))
            far = np.round(far, 12)  # equal directions tie, the smaller id first
            order = np.lexsort((names[r], far, q))
            q, r, far = q[order], r[order], far[order]
            best = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append(pd.DataFrame({"qid": asked[i : i + _QUERIES][q[best]], "vid": names[r[best]], "far": far[best]}))
        return pd.concat(out)

    return run


def _numbers(vectors: pa.Array, size: int) -> np.ndarray:
    return np.asarray(vectors.flatten(), dtype=np.float64).reshape(-1, size)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow for huge components
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _nearest_lists(df: DataFrame, sent, size: int, probed: int) -> DataFrame:
    """Add ``lists``: the numbers of the ``probed`` nearest centres, nearest first."""

    def start():
        middle = sent.value

        def work(vectors: pa.Array) -> list[pa.Array]:
            found = []
            for i in range(0, len(vectors), 1024):
                near = _unit(_numbers(vectors.slice(i, 1024), size)) @ middle.T
                if probed < near.shape[1]:
                    some = np.argpartition(-near, probed - 1, axis=1)[:, :probed]
                    near = np.take_along_axis(near, some, axis=1)
                    order = np.take_along_axis(some, np.argsort(-near, axis=1, kind="stable"), axis=1)
                else:
                    order = np.argsort(-near, axis=1, kind="stable")
                found += list(order)
            return [pa.array(found, pa.list_(pa.int64()))]

        return work

    return append(df, {"v": F.col("v")}, [field("lists", "array<bigint>")], start)


def _cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)
    norm = [F.aggregate(v, zero, lambda s, x: s + x.cast("double") * x.cast("double")) for v in (a, b)]
    return dot / (F.sqrt(norm[0]) * F.sqrt(norm[1]))


def search(
    df: DataFrame, is_query: Column, k: int = 5, ids: str = "vec_id", vector: str = "embedding",
    target: float = TARGET, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every query row its ``k`` nearest other rows found,
    by cosine, nearest first, ties to the smaller id; fewer if there are fewer.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, and
    neither do rows without an id or of another length than the most frequent one (of equally
    frequent ones the longest). A row repeated is one row. Equal vectors are searched once: of
    each, the ``k + 1`` smallest ids can be results. No usable rows give no rows.

    Every row is indexed. Centres of the lists are fitted on a bounded sample; how many lists a
    query probes is measured on some of the queries, kept out of that sample, whose true
    neighbours are looked up in the whole table. Lists of more
    than ``PART`` vectors are dealt out in parts, and so are the queries that probe a list; no
    task holds more than one part of each. Scores are computed on the original vectors.
    """
    spark = df.sparkSession
    v = F.col(vector)
    named = df.filter(usable(v) & F.col(ids).isNotNull()).select(
        F.col(ids).cast("bigint").alias("id"), v.alias("v"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(7), v).alias("h2"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    named = stored(named.groupBy("h1", "h2", "id").agg(F.first("v").alias("v"), F.max("asks").alias("asks")))
    common = named.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).first()
    if common is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    size = common["s"]
    named = named.filter(F.size("v") == size)

    # one row per different vector: its smallest id stands for it
    order = W.partitionBy("h1", "h2").orderBy("id")
    members = stored(named.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1))
    unique = members.filter("n = 1").select(F.col("id").alias("vid"), "v", "h1", "h2")
    total = unique.count()
    asked = stored(
        named.filter("asks").select(F.col("id").alias("query_id"), "h1", "h2").join(unique.select("vid", "h1", "h2"), ["h1", "h2"])
        .select("query_id", F.col("vid").alias("qid"))
    )
    points = stored(unique.join(asked.select(F.col("qid").alias("vid")).distinct(), "vid"))

    # the trials are queries that neither seed nor fit the centres, unless there is nothing else
    tried = points.select("vid", "v", "h2").orderBy("h2", "vid").limit(_TRIALS).collect()
    if not tried:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    names = np.array([r["vid"] for r in tried], dtype=np.int64)
    trials = _unit(np.array([r["v"] for r in tried]))
    rows = max(1, min(fit_rows, (64 << 20) // (8 * size)))
    first = unique.select("vid", "v", "h1").orderBy("h1", "vid").limit(rows + len(names)).collect()
    apart = set(names.tolist())
    sample = _unit(np.array(([r["v"] for r in first if r["vid"] not in apart] or [r["v"] for r in first])[:rows]))
    middle = centres(sample, int(max(1, min(MOST_LISTS, len(sample), round(total**0.5)))))
    sent = spark.sparkContext.broadcast(middle)
    listed = stored(_nearest_lists(unique.select("vid", "v"), sent, size, 1).select("vid", "v", F.col("lists")[0].alias("list")))
    number = lists_to_probe(trials, middle, *_true_neighbours(listed, names, trials, size, k), target)
    asking = points.select(F.col("vid").alias("qid"), "v")
    probes = stored(_nearest_lists(asking, sent, size, number).select("qid", "v", F.explode("lists").alias("list")))

    # parts of each list and of its queries; as many rows as there are lists, so both may be broadcast
    parts = listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    turns = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("turns"))
    plan = F.broadcast(stored(parts.join(turns, "list")))
    base = listed.join(plan, "list").withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")))
    base = base.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    probes = probes.join(plan, "list").withColumn("turn", F.pmod(F.xxhash64("qid"), F.col("turns")).cast("int"))
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)))
    keys = ["list", "part", "turn"]
    found = (
        base.select(*keys, "vid", "v").groupBy(*keys).cogroup(probes.select(*keys, "qid", "v").groupBy(*keys))
        .applyInPandas(_search_part(size, k + 1), "qid bigint, vid bigint, far double")
    )
    near = W.partitionBy("qid").orderBy("far", "vid")
    few = found.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 8).select("qid", "vid")

    # exact scores of the few, then their ids, then each query without itself
    left, right = listed.select(F.col("vid").alias("qid"), F.col("v").alias("a")), listed.select("vid", F.col("v").alias("b"))
    scored = stored(few).join(left, "qid").join(right, "vid").select("qid", "vid", _cosine(F.col("a"), F.col("b")).alias("score"))
    own = members.select(F.col("id").alias("vec_id"), "h1", "h2").join(unique.select("vid", "h1", "h2"), ["h1", "h2"])
    best = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    answer = scored.join(own.select("vid", "vec_id"), "vid").withColumn("n", F.row_number().over(best))
    answer = stored(answer.filter(F.col("n") <= k + 1).select("qid", "vec_id", "score"))
    each = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = asked.join(answer, "qid").filter("query_id <> vec_id").withColumn("rank", F.row_number().over(each))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
