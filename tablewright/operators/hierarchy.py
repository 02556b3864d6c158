"""Bottom-up hierarchy (Ward) over mergeable cluster features.

A cluster feature is a count, a sum of vectors and a sum of their squares; two add up to that of
their union, and Ward's distance follows from counts and means. Every row goes to the nearest of at
most ``FEATURES`` points, so Spark reduces a table of any size to that many features with partial
aggregation; the merges run over them, and the tree labels every row through its feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.skew import spread_join
from tablewright.session import stored

#: cluster features that are merged at most (a documented bound); up to as many distinct points are exact
FEATURES = 1024
#: rounds in which the features' points move to their means, if there are more distinct points
ROUNDS = 2
_ROWS = 1024
_ROOM = "__feature"


@dataclass
class MergeTree:
    """``merges[i]``: ``(left, right, height, rows)``. Features are numbered from 0, and the union made by
    merge ``i`` has the number ``features + i``. The height is the growth of the squared error."""

    features: int
    merges: list[tuple[int, int, float, int]]

    def labels(self, clusters: int) -> list[int]:
        """The cluster of each feature when ``clusters`` are left, numbered by their first feature."""
        owner = list(range(self.features + len(self.merges)))
        for i, (left, right, _, _) in enumerate(self.merges[: max(0, self.features - clusters)]):
            owner[left] = owner[right] = self.features + i

        def top(x: int) -> int:
            while owner[x] != x:
                x = owner[x]
            return x

        found: dict[int, int] = {}
        return [found.setdefault(top(x), len(found)) for x in range(self.features)]

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per merge, in order."""
        rows = [(i, *map(int, m[:2]), float(m[2]), int(m[3])) for i, m in enumerate(self.merges)]
        return spark.createDataFrame(rows, "step int, left int, right int, height double, rows bigint")


def ward(counts: np.ndarray, sums: np.ndarray) -> MergeTree:
    """Merge the two clusters whose union adds least to the squared error, until one is left; of
    equally good pairs that of the smallest places."""
    n, sums = counts.astype(np.float64).copy(), sums.astype(np.float64).copy()
    size = len(n)
    names = list(range(size))
    middle = sums / n[:, None]

    def growth(i: int) -> np.ndarray:
        gap = middle - middle[i]
        return n * n[i] / (n + n[i]) * (gap * gap).sum(axis=1)

    far = np.full((size, size), np.inf)
    for i in range(size):
        far[i, i + 1 :] = growth(i)[i + 1 :]
    alive = np.ones(size, dtype=bool)
    merges = []
    for step in range(size - 1):
        i, j = divmod(int(np.argmin(far)), size)
        merges.append((names[i], names[j], float(far[i, j]), int(n[i] + n[j])))
        n[i], sums[i] = n[i] + n[j], sums[i] + sums[j]
        middle[i], names[i], alive[j] = sums[i] / n[i], size + step, False
        far[j, :] = far[:, j] = np.inf
        new = np.where(alive, growth(i), np.inf)
        far[i, i + 1 :], far[:i, i] = new[i + 1 :], new[:i]
    return MergeTree(size, merges)


def _placed(df: DataFrame, points: np.ndarray) -> DataFrame:
    """Add the number of the nearest point to rows of ``__v``."""
    sent = df.sparkSession.sparkContext.broadcast(points)
    schema = T.StructType([*df.schema.fields, T.StructField(_ROOM, T.IntegerType())])

    def run(batches):
        points = sent.value
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("__v"))
            found = [np.zeros(0, dtype=np.int32)]
            for start in range(0, len(vectors), _ROWS):
                rows = vectors.slice(start, _ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, points.shape[1])
                far = np.zeros((len(rows), len(points)))
                for i in range(points.shape[1]):
                    gap = rows[:, i][:, None] - points[:, i][None, :]
                    far += gap * gap
                found.append(far.argmin(axis=1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found), pa.int32())], names=schema.names)

    return df.mapInArrow(run, schema)


def _features(placed: DataFrame) -> list:
    """Number, count and sum of every feature that has rows; at most ``FEATURES`` of them."""
    sums = placed.select(_ROOM, "n", F.posexplode("__v").alias("i", "x")).groupBy(_ROOM, "i")
    sums = sums.agg(F.sum(F.col("x") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    whole = sums.groupBy(_ROOM).agg(F.sort_array(F.collect_list(F.struct("i", "s")))["s"].alias("s"), F.first("n").alias("n"))
    return whole.orderBy(_ROOM).collect()


def build(df: DataFrame, vector: str = "features") -> tuple[DataFrame, MergeTree | None]:
    """``df`` with the number of each row's feature in ``__feature``, and the merge tree.

    Up to ``FEATURES`` distinct points are features themselves, so the tree is exactly Ward's. Of more, those
    of the smallest hash start, and move to their rows' means; this does not depend on partitions.
    An empty table has no tree.
    """
    isarray = isinstance(df.schema[vector].dataType, T.ArrayType)
    rows = df.withColumn("__v", F.col(vector).cast("array<double>") if isarray else vector_to_array(F.col(vector)))
    vectors = stored(rows.groupBy("__v").agg(F.count(F.lit(1)).alias("n")))
    some = [r["__v"] for r in vectors.orderBy(F.xxhash64("__v"), "__v").limit(FEATURES + 1).collect()]
    if not some:
        return df.withColumn(_ROOM, F.lit(0)), None
    points = np.array(some[:FEATURES], dtype=np.float64)
    for _ in range(ROUNDS if len(some) > FEATURES else 0):
        points = np.array([[x / r["n"] for x in r["s"]] for r in _features(_placed(vectors, points))])
    placed = stored(_placed(vectors, points))
    found = _features(placed)
    tree = ward(np.array([r["n"] for r in found]), np.array([r["s"] for r in found]))
    # features without rows have no place in the tree
    place = {r[_ROOM]: i for i, r in enumerate(found)}
    numbers = F.lit([place.get(i, -1) for i in range(len(points))])[F.col(_ROOM)]
    return spread_join(rows, placed.select("__v", numbers.alias(_ROOM)), ["__v"]).select(*df.columns, _ROOM), tree


def cut(rows: DataFrame, tree: MergeTree | None, clusters: int) -> DataFrame:
    """Rows of ``build`` with their ``cluster`` when so many are left."""
    if tree is None:
        return rows.drop(_ROOM).withColumn("cluster", F.lit(0))
    return rows.withColumn("cluster", F.lit(tree.labels(clusters))[F.col(_ROOM)]).drop(_ROOM)
