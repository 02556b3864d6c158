"""Exact k-means on integer vectors; the nearest centroid is found coefficient by coefficient.

The Walsh-Hadamard transform of 64 integers is 64 integers, and squared distances between
transforms are 64 times those between vectors. Its first coefficients (of lowest sequency) hold
the coarse shape. The squared differences are summed from coarse to fine; a centroid whose sum so
far exceeds another one's whole distance can't be nearest and is left out, and those that stay
are summed over all coefficients. Everything is in integers, so results don't depend on the order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import append, field
from tablewright.session import stored

SIZE = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
#: coefficients whose differences are summed before the first, second ... look at who is left
STEPS = (4, 16, 64)
#: components beyond this are cut to it, so they fit a long
LIMIT = 2**62
#: up to this size of a component no sum of 64 squared differences of coefficients leaves a long
SAFE = 2**20
MOST_LONG = 2**63 - 1
#: rows compared at once
_ROWS = 4096


def order() -> np.ndarray:
    """Rows of Sylvester's matrix by sequency, the number of sign changes."""
    return np.argsort((np.diff(matrix(), axis=1) != 0).sum(axis=1), kind="stable")


def matrix(size: int = SIZE) -> np.ndarray:
    """Sylvester's Hadamard matrix."""
    signs = np.ones((1, 1), dtype=np.int64)
    while len(signs) < size:
        signs = np.block([[signs, signs], [signs, -signs]])
    return signs


def transform(rows: np.ndarray) -> np.ndarray:
    """The coefficients of each row, by butterflies, from coarse to fine. Python integers stay exact
    at any size; longs do up to ``SAFE``."""
    out = rows.copy()
    half = 1
    while half < SIZE:
        pairs = out.reshape(len(out), SIZE // (2 * half), 2, half)
        a, b = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        pairs[:, :, 0], pairs[:, :, 1] = a + b, a - b
        half *= 2
    return out[:, order()]


def restore(coefficients: list[int]) -> list[int]:
    """The vector that has these coefficients; the transform is its own inverse but for a factor of 64."""
    signs = matrix()[order()]
    return [sum(int(s) * c for s, c in zip(column, coefficients)) // SIZE for column in signs.T]


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (the smaller one of equally near ones) and the squared distance,
    both inputs being coefficients; and how many differences were summed."""
    n, k = len(rows), len(centroids)
    every = np.arange(n)
    seen = np.zeros((n, k), dtype=rows.dtype)
    alive = np.ones((n, k), dtype=bool)
    leader = np.zeros(n, dtype=np.int64)
    start, summed = 0, 0
    for end in STEPS:
        r, c = np.nonzero(alive)
        gap = rows[r, start:end] - centroids[c, start:end]
        seen[r, c] += (gap * gap).sum(axis=1)
        summed += gap.size
        if end < SIZE:
            # the whole distance of the one that leads so far bounds all others
            leader = _first_least(seen, alive)
            gap = rows[:, end:] - centroids[leader, end:]
            bound = seen[every, leader] + (gap * gap).sum(axis=1)
            summed += gap.size
            alive &= seen <= bound[:, None]
        start = end
    found = _first_least(seen, alive)
    return found, seen[every, found] // SIZE, summed


def _first_least(seen: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Per row the first of the least values among those alive."""
    best = np.argmax(alive, axis=1)
    least = seen[np.arange(len(seen)), best]
    for c in range(seen.shape[1]):
        better = alive[:, c] & (seen[:, c] < least)
        best[better], least[better] = c, seen[better, c]
    return best


def _integers(values: pa.Array) -> np.ndarray:
    """Rows of an array of 64 longs each; Python integers if a long could not hold a distance."""
    flat = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
    return flat if not len(flat) or max(-int(flat.min()), int(flat.max())) <= SAFE else flat.astype(object)


def _centroids(vectors: list[list[int]], exact: bool) -> np.ndarray:
    rows = np.array(vectors, dtype=object)
    return transform(rows if exact else rows.astype(np.int64))


def _chunks(values: pa.Array, centroids: list[list[int]]):
    """Coefficients of at most ``_ROWS`` rows at a time, the centroids' in the same kind of number."""
    large = max(abs(x) for c in centroids for x in c) > SAFE
    for i in range(0, len(values), _ROWS):
        rows = _integers(values.slice(i, _ROWS))
        exact = large or rows.dtype == object
        yield transform(rows.astype(object) if exact else rows), _centroids(centroids, exact)


def integers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component, cut to what a long can hold."""
    def whole(x: Column) -> Column:
        scaled = x.cast("double") * F.lit(float(scale))
        return F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), scaled))).cast("bigint")

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    """True for vectors of exactly 64 components, none null, infinite or NaN."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == SIZE) & ~bad, F.lit(False))


def _sums(rows: DataFrame, sent) -> DataFrame:
    """Per cluster the number of its vectors and the sums of their coefficients. A task adds up its own
    rows first, so what is shuffled is a few numbers of each task."""
    def run(batches):
        counts, sums = {}, {}
        for batch in batches:
            for coefficients, centres in _chunks(batch.column(0), sent.value):
                found, _, _ = nearest(coefficients, centres)
                for c in np.unique(found):
                    some = coefficients[found == c]
                    counts[int(c)] = counts.get(int(c), 0) + len(some)
                    total = sums.setdefault(int(c), [0] * SIZE)
                    sums[int(c)] = [a + int(b) for a, b in zip(total, some.sum(axis=0))]
        cluster = [c for c in sums for _ in range(SIZE)]
        place = list(range(SIZE)) * len(sums)
        count = [counts[c] for c in sums for _ in range(SIZE)]
        # in two parts, so sums of any size add up exactly
        high, low = ([f(x) for s in sums.values() for x in s] for f in (lambda x: x >> 32, lambda x: x & 0xFFFFFFFF))
        columns = [pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(count, pa.int64()), *[pa.array(x, pa.decimal128(38, 0)) for x in (high, low)]]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "place", "count", "high", "low"])

    parts = rows.select("whole").mapInArrow(run, "cluster int, place int, count bigint, high decimal(38,0), low decimal(38,0)")
    return parts.groupBy("cluster", "place").agg(F.sum("count").alias("count"), F.sum("high").alias("high"), F.sum("low").alias("low"))


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: each the exact floor of its vectors' mean, componentwise; empty ones
    stay. Some 64 numbers per cluster come to the driver."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)
    counts: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for r in _sums(rows, sent).collect():
        counts[r["cluster"]] = r["count"]
        sums.setdefault(r["cluster"], [0] * SIZE)[r["place"]] = (int(r["high"]) << 32) + int(r["low"])
    return [[x // counts[c] for x in restore(sums[c])] if c in sums else old for c, old in enumerate(centroids)]


def cluster(
    df: DataFrame, ids: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    scale: int = SCALE, seed: int = 3,
) -> tuple[DataFrame, list[list[int]]]:
    """``(id, cluster, distance)`` of every usable row, and the centroids.

    Rows whose vector is null, has not 64 components, or holds null or non-finite ones are left
    out; a repeated row counts as often as it stands there. The first centroids are the rows with the
    smallest SHA-256 of ``seed:id`` (null ids last, rows of one id by vector); fewer rows than
    ``clusters`` make fewer clusters, no rows none. Squared distances beyond a long are its largest
    value; so are components beyond 2^62. Other columns play no part.
    """
    kept = df.filter(usable(F.col(vector))).select(F.col(ids).alias("id"), integers(F.col(vector), scale).alias("whole"))
    rows = stored(kept)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.withColumn("mark", mark).orderBy(F.asc_nulls_last("mark"), "whole").limit(clusters).collect()
    centroids = [list(r["whole"]) for r in first]
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows, centroids)
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def start():
        def work(values: pa.Array) -> list[pa.Array]:
            names, far = [], []
            for coefficients, centres in _chunks(values, sent.value):
                found, distance, _ = nearest(coefficients, centres)
                names.append(found.astype(np.int32))
                far += [min(int(d), MOST_LONG) for d in distance]
            return [pa.array(np.concatenate(names) if names else [], pa.int32()), pa.array(far, pa.int64())]

        return work

    made = append(rows, {"whole": F.col("whole")}, [field("cluster", "int"), field("distance", "bigint")], start)
    return stored(made.select("id", "cluster", "distance")), centroids


def with_inertia(assigned: DataFrame) -> DataFrame:
    """Add ``cluster_inertia`` and ``inertia``: the distances summed over the row's cluster and over all,
    at most the largest long. One row per cluster is broadcast."""
    far = F.sum(F.col("distance").cast("decimal(38,0)"))
    each = assigned.groupBy("cluster").agg(far.alias("s"))
    rows = {r["cluster"]: int(r["s"]) for r in each.collect()}
    total = min(sum(rows.values()), MOST_LONG)
    own = F.lit(None).cast("bigint")
    for c, s in rows.items():
        own = F.when(F.col("cluster") == c, F.lit(min(s, MOST_LONG)).cast("bigint")).otherwise(own)
    return assigned.withColumns({"cluster_inertia": own, "inertia": F.lit(total).cast("bigint")})


def centroid_digest(centroid: list[int]) -> str:
    """SHA-256 of the components as decimal integers joined by commas, in lowercase hex."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
