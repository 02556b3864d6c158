"""Exact top-k inner products of integer vectors, found bucket by bucket of vector lengths.

``q·p`` is ``|q| |p| cos(q, p)``. Vectors are grouped by length. A query that already has ``k``
products of at least ``t`` needs, in a bucket whose longest vector has length ``l``, a cosine of at
least ``t / (|q| l)``, the bucket's *local threshold*: above 1 the bucket can be passed over. In the
others either lengths rule vectors out (only those of ``t / |q|`` or longer can reach ``t``) or
coordinates do: a unit vector within an angle of the query's has each coordinate in a known range.
Which of the two is decided per bucket at a local threshold found by trying some queries. What is
left is multiplied out, in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.llm.common import append, field
from tablewright.session import stored

SCALE = 256
#: lengths of one group are within a factor of ``2 ** (1 / BANDS)``
BANDS = 8
#: base vectors and queries that one task compares
PART = 8192
BLOCK = 8192
#: vectors of one bucket inside a part
BUCKET = 1024
#: vectors whose products give each query its first threshold: half the longest, half of smallest
#: hash (a documented bound; they only make pruning start early, no result depends on them)
FIRST = 2048
#: bytes of those vectors at most
FIRST_BYTES = 8 << 20
#: coordinates looked at, those in which the query is largest
FOCUS = 4
#: queries a bucket tries to choose its switch of methods
_TRIALS = 8
#: share of a bucket's vectors that coordinates must rule out to be worth it
_WORTH = 0.75
#: queries multiplied with a bucket at once
_QUERIES = 512
#: products and sums beyond this are made with Python integers
EXACT = 2.0**53
MOST_LONG = 2**63 - 1
#: relative error allowed to lengths and cosines, so rounding rules nothing out
_SLACK = 1e-9
#: rows of a table of groups that may be broadcast
MOST_GROUPS = 100_000


def usable(vector: Column) -> Column:
    """True for vectors without null, infinite or NaN components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component, as doubles: they hold these integers exactly. A product
    too large for a double stays the component times ``scale`` at its largest."""
    most = F.lit(np.finfo(np.float64).max.item() / 2)

    def whole(x: Column) -> Column:
        scaled = F.greatest(-most, F.least(most, x.cast("double") * F.lit(float(scale))))
        # floor() gives a long, and beyond 2^53 every double is whole
        return F.when(F.abs(scaled) < F.lit(EXACT), F.floor(F.when(F.abs(scaled) < F.lit(EXACT), scaled)).cast("double")).otherwise(scaled)

    return F.transform(vector, whole)


def length(vector: Column) -> Column:
    """Euclidean length, without overflow."""
    most = F.coalesce(F.array_max(F.transform(vector, F.abs)), F.lit(0.0))
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.try_divide(x, most), F.lit(2.0)))
    return F.when(most > 0, F.least(most * F.sqrt(squares), F.lit(np.finfo(np.float64).max.item()))).otherwise(F.lit(0.0))


def lengths(rows: np.ndarray) -> np.ndarray:
    """The same of each row."""
    if not rows.size:
        return np.zeros(len(rows))
    most = np.abs(rows).max(axis=1)
    safe = np.where(most > 0, most, 1.0)
    with np.errstate(over="ignore"):
        return np.minimum(most * np.sqrt(((rows / safe[:, None]) ** 2).sum(axis=1)), np.finfo(np.float64).max)


def products(queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """All inner products, exactly: doubles while every sum stays whole in them, else Python integers,
    those beyond a long as its nearest value."""
    if not queries.size or not base.size:
        return np.zeros((len(queries), len(base)))
    if float(np.abs(queries).max()) * float(np.abs(base).max()) * base.shape[1] < EXACT:
        return queries @ base.T
    whole = [np.array([[int(x) for x in row] for row in rows], dtype=object).reshape(rows.shape) for rows in (queries, base)]
    return np.clip(whole[0] @ whole[1].T, -MOST_LONG - 1, MOST_LONG)


def band(length: Column) -> Column:
    """Number of the group of lengths; zero vectors have one of their own below all others."""
    return F.when(length > 0, F.floor(F.log2(length) * BANDS).cast("int")).otherwise(F.lit(-10_000))


def coordinate_range(coordinate: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values a coordinate can have in a unit vector whose cosine with the query's is at least
    ``cosine``, where the query's unit vector has ``coordinate``: the angles differ by at most that."""
    own, off = (np.arccos(np.clip(x, -1.0, 1.0)) for x in (coordinate, cosine))
    return np.cos(np.minimum(np.pi, own + off)) - _SLACK, np.cos(np.maximum(0.0, own - off)) + _SLACK


class Bucket:
    """Vectors of similar length, longest first, with their coordinates sorted one by one."""

    def __init__(self, names: np.ndarray, rows: np.ndarray, far: np.ndarray):
        self.names, self.rows, self.far = names, rows, far
        with np.errstate(invalid="ignore", divide="ignore"):
            self.unit = np.nan_to_num(rows / far[:, None])
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)
        self.switch = None

    def prefix(self, least: float) -> int:
        """How many vectors are at least so long."""
        return int(np.searchsorted(-self.far, -least * (1.0 - _SLACK), side="right"))

    def by_coordinates(self, point: np.ndarray, cosine: float) -> np.ndarray:
        """Rows whose focus coordinates all lie in range: the shortest range is read off its sorted
        list, the others are looked up in those rows."""
        focus = np.argsort(-np.abs(point), kind="stable")[:FOCUS]
        low, high = coordinate_range(point[focus], np.full(len(focus), cosine))
        runs = [(np.searchsorted(self.sorted[:, f], a, side="left"), np.searchsorted(self.sorted[:, f], b, side="right")) for f, a, b in zip(focus, low, high)]
        best = int(np.argmin([b - a for a, b in runs]))
        found = self.order[runs[best][0] : runs[best][1], focus[best]]
        for i, f in enumerate(focus):
            if i != best:
                value = self.unit[found, f]
                found = found[(value >= low[i]) & (value <= high[i])]
        return found

    def choose(self, points: np.ndarray, cosines: np.ndarray) -> None:
        """Set the local threshold from which coordinates are used: the least one of some tried queries
        from which on they rule out most of the bucket."""
        tried = np.argsort(cosines, kind="stable")[:: max(1, len(cosines) // _TRIALS)]
        self.switch = 2.0
        for i in tried[::-1]:
            if cosines[i] <= 0 or len(self.by_coordinates(points[i], cosines[i])) > (1.0 - _WORTH) * len(self.rows):
                break
            self.switch = cosines[i]


def _better(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller name."""
    if len(scores) > 4 * k:
        if scores.dtype == object:
            cut = sorted(scores, reverse=True)[k - 1]
        else:
            cut = -np.partition(-scores, k - 1)[k - 1]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(scores))
    order = sorted(some.tolist(), key=lambda i: (-scores[i], names[i]))[:k]
    return np.array(order, dtype=np.int64)


def search_part(names: np.ndarray, rows: np.ndarray, asked: np.ndarray, points: np.ndarray, floor: np.ndarray, k: int):
    """``(query, name, score)`` lists: for each query the best ``k`` of a part that reach ``floor``, the
    score it can already count on (-inf: none yet). A query's own name is no candidate. Also
    returned: how many vectors were multiplied with queries."""
    far, reach = lengths(rows), lengths(points)
    order = np.lexsort((names, -far))
    names, rows, far = names[order], rows[order], far[order]
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = np.nan_to_num(points / reach[:, None])
    bound = floor.astype(np.float64).copy()
    best: list[list[tuple]] = [[] for _ in asked]
    touched = 0

    def take(i: int, candidates: np.ndarray, scores: np.ndarray) -> None:
        fits = (candidates != asked[i]) & (scores >= float(bound[i]))
        candidates, scores = candidates[fits], scores[fits]
        some = _better(scores, candidates, k)
        merged = best[i] + [(-int(scores[j]), int(candidates[j])) for j in some]
        best[i] = sorted(merged)[:k]
        if len(best[i]) == k:
            bound[i] = max(bound[i], _down(-best[i][-1][0]))

    for start in range(0, len(rows), BUCKET):
        end = start + BUCKET
        bucket = Bucket(names[start:end], rows[start:end], far[start:end])
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            local = np.where((bound > 0) & (reach > 0), bound / reach / bucket.far[0], np.where(bound > 0, np.inf, -1.0))
        local = np.nan_to_num(local, nan=np.inf, posinf=np.inf) * (1.0 - _SLACK)
        live = np.flatnonzero(local <= 1.0)
        if not len(live):
            continue
        bucket.choose(unit[live], local[live])
        for i in live[local[live] >= bucket.switch]:
            found = bucket.by_coordinates(unit[i], local[i])
            found = found[found < bucket.prefix(bound[i] / reach[i])]
            touched += len(found)
            take(i, bucket.names[found], products(points[i : i + 1], bucket.rows[found])[0])
        rest = live[local[live] < bucket.switch]
        with np.errstate(invalid="ignore", divide="ignore"):
            least = np.where(bound[rest] > 0, bound[rest] / reach[rest], 0.0)
        rest, least = rest[np.argsort(least, kind="stable")], np.sort(least)
        for j in range(0, len(rest), _QUERIES):
            some = rest[j : j + _QUERIES]
            n = bucket.prefix(least[j])
            touched += n * len(some)
            scores = products(points[some], bucket.rows[:n])
            for i, row in zip(some, scores):
                hit = np.flatnonzero(row >= float(bound[i]))
                if len(hit):
                    take(i, bucket.names[hit], row[hit])
    return [(int(asked[i]), name, -score) for i in range(len(asked)) for score, name in best[i]], touched


def _matrix(vectors, size: int) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64).reshape(len(vectors), size)


def _down(score) -> float:
    """A double that is not above a whole number."""
    found = float(score)
    return found if abs(score) < EXACT else found - abs(found) * 1e-15


def _search(k: int):
    import pandas as pd

    def run(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(base) and len(queries):
            size = len(base["whole"].iloc[0])
            names, asked = base["id"].to_numpy(), queries["query_id"].to_numpy()
            found, _ = search_part(names, _matrix(base["whole"], size), asked, _matrix(queries["whole"], size), queries["floor"].to_numpy(), k)
        return pd.DataFrame({c: pd.Series([f[i] for f in found], dtype="int64") for i, c in enumerate(("query_id", "vec_id", "score"))})

    return run


def _first_floor(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """Add ``floor``: the k-th best product with a bounded number of base vectors of the query's own size."""
    half = FIRST // 2
    mixed = F.xxhash64(F.lit(7), "id", "whole")
    widest = base.agg(F.max(F.size("whole"))).first()[0] or 1
    half = max(k, min(half, FIRST_BYTES // (16 * max(1, widest))))
    longest = base.orderBy(F.desc("far"), "id", mixed).limit(half)
    some = longest.unionAll(base.orderBy(mixed, "id").limit(half)).distinct().select("id", "whole").collect()
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r["whole"]) for r in some}:
        own = [r for r in some if len(r["whole"]) == size]
        by_size[size] = (np.array([r["id"] for r in own], dtype=np.int64), _matrix([r["whole"] for r in own], size))
    sent = base.sparkSession.sparkContext.broadcast(by_size)

    def start():
        known = sent.value

        def work(names: pa.Array, vectors: pa.Array) -> list[pa.Array]:
            out = []
            for name, vector in zip(names.to_pylist(), vectors.to_pylist()):
                ids, rows = known.get(len(vector), (np.zeros(0, np.int64), np.zeros((0, len(vector)))))
                rows = rows[ids != name]
                if len(rows) < k:
                    out.append(float("-inf"))
                    continue
                scores = products(_matrix([vector], len(vector)), rows)[0]
                least = sorted(scores, reverse=True)[k - 1] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]
                out.append(_down(least))
            return [pa.array(out, pa.float64())]

        return work

    return append(queries, {"id": F.col("id"), "whole": F.col("whole")}, [field("floor", "double")], start)


def _sent(df: DataFrame) -> DataFrame:
    """``df`` stored, and broadcast if its rows are few."""
    table = stored(df)
    return F.broadcast(table) if table.count() <= MOST_GROUPS else table


def search(
    df: DataFrame, is_query: Column, k: int = 5, ids: str = "vec_id", vector: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every query row the ``k`` rows of other ids with the highest
    inner product of ``floor(scale * x)``, ties to the smaller id; fewer if there are fewer.

    Vectors that are null or hold null or non-finite components take no part, nor do rows
    without an id. Vectors are compared with those of their own number of components (none: every
    product is 0). A repeated row is one row. A query id with several vectors asks with
    each, and an id's best product counts. Scores beyond a long are its nearest value, and tie. No rows
    give no rows; other columns play no part.

    Lengths make groups, groups parts of ``PART`` vectors; queries make blocks of ``BLOCK`` by the length
    they need, and a block meets only the parts that are long enough. No task holds more than one of
    each; every other row of the table that could be in a result is multiplied out.
    """
    spark = df.sparkSession
    named = df.filter(usable(F.col(vector)) & F.col(ids).isNotNull()).select(
        F.col(ids).cast("bigint").alias("id"), integers(F.col(vector), scale).alias("whole"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    named = named.withColumns({"h1": F.xxhash64("whole"), "h2": F.xxhash64(F.lit(7), "whole")})
    named = named.groupBy("id", "h1", "h2").agg(F.first("whole").alias("whole"), F.max("asks").alias("asks"))

    base = named.withColumn("far", length(F.col("whole")))
    base = stored(base.select("id", "whole", "asks", "far", F.size("whole").alias("size"), band(F.col("far")).alias("band")))
    queries = _first_floor(base.filter("asks").select("id", "whole", "size", "far"), base, k)
    needed = F.when(F.col("floor") > 0, F.try_divide(F.col("floor"), F.col("far")) * (1.0 - _SLACK))
    # one band less, for the rounding of logarithms
    need = F.when(F.col("floor") <= 0, F.lit(-10_000)).otherwise(F.coalesce(band(needed) - 1, F.lit(10_000_000)))
    queries = stored(queries.select(F.col("id").alias("query_id"), "whole", "size", "floor", need.alias("need")))

    # how many parts each group of lengths has; queries in blocks, those that need the longest vectors first
    parts = _sent(base.groupBy("size", "band").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")))
    groups = queries.groupBy("size", "need").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("size").orderBy(F.desc("need")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    turns = F.ceil(F.col("n") / BLOCK).cast("int")
    groups = _sent(groups.select("size", "need", F.floor(before / BLOCK).cast("int").alias("first"), turns.alias("turns")))
    every = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("turns") - 1)).alias("block")
    blocks = groups.select("size", "need", every).groupBy("size", "block").agg(F.min("need").alias("need"))
    meet = _sent(parts.join(blocks, "size").filter(F.col("band") >= F.col("need")).select("size", "band", "parts", "block"))
    dealt = base.select("id", "whole", "size", "band").join(meet, ["size", "band"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", "whole"), F.col("parts")).cast("int"))
    turn = F.pmod(F.xxhash64("query_id", "whole"), F.col("turns")).cast("int")
    asked = queries.join(groups, ["size", "need"]).withColumn("block", F.col("first") + turn).join(meet, ["size", "block"])
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["size", "band", "part", "block"]
    found = (
        dealt.select(*keys, "id", "whole").groupBy(*keys).cogroup(asked.select(*keys, "query_id", "whole", "floor").groupBy(*keys))
        .applyInPandas(_search(k), "query_id bigint, vec_id bigint, score bigint")
    )
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
