"""Clustering of numeric columns: model sweeps, density clusters, silhouette, projection."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators import density, hierarchy
from tablewright.operators.columns import numeric_columns, q
from tablewright.operators.components import components
from tablewright.operators.prepare import medians, robust_scale
from tablewright.operators.skew import spread_join
from tablewright.session import cut, spread

MIN_EPS = 0.3
MIN_SAMPLES = 5
#: rows that are worth a task of their own in a sweep over models
FIT_ROWS = 5_000
#: mixtures fitted at a time
SIDE_BY_SIDE = 4
#: columns a grid of cells is made for
GRID_COLUMNS = 3
EPS_SHARE = 0.9
NOISE = -1
#: halvings of a dense cell before the points of pairs of sub-cells that are still undecided are compared
BOX_LEVELS = 20


def feature_vectors(df: DataFrame, features: Sequence[str] | None = None, name: str = "features") -> DataFrame:
    """Median-filled, robustly scaled numeric columns as one vector column."""
    features = list(features or numeric_columns(df))
    slim = df.select(*df.columns, *[q(c).alias(f"__{c}") for c in features])
    scaled = robust_scale(slim, [f"__{c}" for c in features])
    assembled = VectorAssembler(inputCols=[f"__{c}" for c in features], outputCol=name).transform(scaled)
    return assembled.select(*df.columns, name)


# ---- silhouette ----------------------------------------------------------------------


def silhouette_rows(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """Squared-distance silhouette of every row, added as ``silhouette``.

    The mean squared distance to a cluster follows from its size, mean and mean squared
    norm, so one aggregate and one map replace all pairs of rows. Rows of single-member
    clusters get 0.
    """
    vec = vector_to_array(F.col(vector)) if _is_vector(df, vector) else F.col(vector).cast("array<double>")
    work = df.withColumn("__v", vec)
    means, sizes, norms, names = _cluster_sums(work, cluster)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {c: i for i, c in enumerate(names)}
        for batch in batches:
            if batch.empty:
                yield batch.assign(silhouette=pd.Series(dtype="float64"))[out_names]
                continue
            x = np.stack(batch["__v"].to_numpy()).astype("float64")
            own = batch[cluster].map(place).to_numpy()
            d = (x**2).sum(axis=1)[:, None] + norms - 2.0 * (x @ means.T)
            rows = np.arange(len(x))
            n = sizes[own]
            a = d[rows, own] * n / np.maximum(n - 1, 1)
            d[rows, own] = np.inf
            b = d.min(axis=1) if len(names) > 1 else np.zeros(len(x))
            top = np.maximum(a, b)
            s = np.where((n > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
            yield batch.assign(silhouette=s)[out_names]

    keep = [c for c in df.columns if c != vector]
    out_names = [*keep, "silhouette"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return work.select(*keep, "__v").mapInPandas(score, f"{schema}, silhouette double")


def _is_vector(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("vectorudt", "udt")


def _cluster_sums(work: DataFrame, cluster: str):
    """Mean, size and mean squared norm of each cluster: one row per cluster."""
    from pyspark.ml.functions import array_to_vector

    square = F.aggregate("__v", F.lit(0.0), lambda s, x: s + x * x)
    rows = work.groupBy(cluster).agg(
        Summarizer.mean(array_to_vector(F.col("__v"))).alias("m"), F.count(F.lit(1)).alias("n"), F.avg(square).alias("y")
    ).collect()
    names = [r[cluster] for r in rows]
    means = np.array([r["m"].toArray() for r in rows])
    return means, np.array([r["n"] for r in rows]), np.array([r["y"] for r in rows]), names


def silhouette(df: DataFrame, vector: str, cluster: str) -> float:
    """Mean silhouette; 0 with fewer than two clusters."""
    row = silhouette_rows(df, vector, cluster).agg(F.avg("silhouette").alias("s"), F.count_distinct(cluster).alias("k")).first()
    return row["s"] if row["k"] and row["k"] > 1 else 0.0


# ---- model sweeps --------------------------------------------------------------------


def cluster_counts(df: DataFrame, max_k: int) -> range:
    """2 … min(max_k, rows - 1); the rows are counted only as far as needed."""
    return range(2, min(max_k, df.limit(max_k + 1).count() - 1) + 1)


def kmeans_auto(df: DataFrame, vector: str = "features", max_k: int = 10, seeds: Sequence[int] = (42,)):
    """Best k by silhouette (smallest on a tie): ``(labelled, k, silhouette, scores)``."""
    scores, best = [], None
    for k in cluster_counts(df, max_k):
        runs = [KMeans(k=k, seed=s, featuresCol=vector, predictionCol="cluster").fit(df) for s in seeds]
        model = min(runs, key=lambda m: m.summary.trainingCost)
        value = silhouette(model.transform(df).select(vector, "cluster"), vector, "cluster")
        scores.append((k, value))
        if best is None or value > best[1]:
            best = (k, value, model)
    return best[2].transform(df), best[0], best[1], scores


def gmm_auto(df: DataFrame, vector: str = "features", max_k: int = 10, seed: int = 42):
    """Gaussian mixture with the lowest BIC: ``(labelled, k, bic, scores)``.

    The rows are dealt out to all cores, and several mixtures are fitted side by side.
    """
    slim = spread(df.select(vector), FIT_ROWS).persist()
    rows = slim.count()
    dim = len(slim.select(vector).first()[0]) if rows else 0

    def fitted(k: int):
        model = GaussianMixture(k=k, seed=seed, featuresCol=vector, predictionCol="cluster").fit(slim)
        free = k * dim + k * dim * (dim + 1) / 2 + k - 1
        return k, -2.0 * model.summary.logLikelihood + free * math.log(rows), model

    try:
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            # the costliest, those of many components, first
            found = sorted(pool.map(inheritable_thread_target(df.sparkSession)(fitted), reversed(cluster_counts(slim, max_k))), key=lambda f: f[0])
    finally:
        slim.unpersist()
    k, bic, model = min(found, key=lambda f: f[1])
    return model.transform(df), k, bic, [f[:2] for f in found]


def hierarchical_auto(df: DataFrame, vector: str = "features", max_k: int = 10):
    """Ward's bottom-up hierarchy cut at the best silhouette: ``(labelled, k, silhouette, scores)``.

    One merge tree over cluster features serves every k (see ``hierarchy``).
    """
    rows, tree = hierarchy.build(df, vector)
    rows = cut(rows)
    scores, best = [], None
    for k in cluster_counts(df, max_k):
        value = silhouette(hierarchy.cut(rows, tree, k).select(vector, "cluster"), vector, "cluster")
        scores.append((k, value))
        if best is None or value > best[1]:
            best = (k, value)
    k, value = best or (1, 0.0)
    return hierarchy.cut(rows, tree, k), k, value, scores


def assign_nearest(df: DataFrame, vector: str, centroids: Sequence[Sequence[float]], name: str = "cluster") -> DataFrame:
    """Index of the nearest of a few given centroids (lowest index on a tie)."""
    v = F.col(vector).cast("array<double>")
    gaps = [
        F.struct(
            F.aggregate(
                F.zip_with(v, F.lit([float(x) for x in c]), lambda a, b: (a - b) * (a - b)),
                F.lit(0.0), lambda s, x: s + x,
            ).alias("d"),
            F.lit(i).alias("i"),
        )
        for i, c in enumerate(centroids)
    ]
    return df.withColumn(name, F.array_min(F.array(*gaps))["i"])


def pca2(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """First two principal components of the filled, centred, unscaled features.

    Each component's sign makes its largest loading positive.
    """
    mid = medians(df, features)
    filled = df.withColumns({f"num__{c}": F.coalesce(q(c).cast("double"), F.lit(mid[c])) for c in features})
    raw = VectorAssembler(inputCols=[f"num__{c}" for c in features], outputCol="__raw").transform(filled)
    centred = StandardScaler(withMean=True, withStd=False, inputCol="__raw", outputCol="__centred").fit(raw).transform(raw)
    model = PCA(k=2, inputCol="__centred", outputCol="__axes").fit(centred)
    loads = model.pc.toArray()
    signs = [1.0 if loads[np.abs(loads[:, j]).argmax(), j] > 0 else -1.0 for j in range(2)]
    xy = vector_to_array("__axes")
    out = model.transform(centred).withColumn("__xy", xy)
    return out.select(*df.columns, (F.col("__xy")[0] * signs[0]).alias("pc1"), (F.col("__xy")[1] * signs[1]).alias("pc2"))


def run_clustering(
    df: DataFrame, key: str, method: str = "kmeans", features: Sequence[str] | None = None, max_k: int = 10
) -> tuple[DataFrame, dict]:
    """``(labelled rows, metrics)`` by kmeans, dbscan, gaussian or hierarchical.

    Features are the numeric columns but the key, median-filled and robustly scaled. The
    metrics hold ``best_k`` (or ``eps``) and the silhouette without noise.
    """
    if method not in ("kmeans", "dbscan", "gaussian", "hierarchical"):
        raise ValueError(f"unknown method {method!r}")
    features = list(features or [c for c in numeric_columns(df) if c != key])
    if method == "dbscan":
        scaled = robust_scale(df.select(key, *[q(c) for c in features]), features)
        scaled = cut(scaled)
        eps = auto_eps(scaled, key, features)
        labels = cut(dbscan(scaled, key, features, eps).select(key, "cluster"))
        vectors = scaled.select(key, F.array(*[q(c) for c in features]).alias("features"))
        kept = vectors.join(labels.filter(F.col("cluster") != NOISE), key).select("features", "cluster")
        return df.join(labels, key), {"eps": eps, "silhouette": silhouette(kept, "features", "cluster")}
    vectors = cut(feature_vectors(df, features))
    sweep = {"kmeans": kmeans_auto, "gaussian": gmm_auto, "hierarchical": hierarchical_auto}[method]
    out, k, value, _ = sweep(vectors, max_k=max_k)
    found = silhouette(out.select("features", "cluster"), "features", "cluster") if method == "gaussian" else value
    return out.select(*df.columns, "cluster"), {"best_k": k, "silhouette": found}


# ---- density clusters ----------------------------------------------------------------
#
# Points fall into cells of side eps/sqrt(d), so any two points of a cell are neighbours: a
# cell with min_samples points needs no distances to know that all of them are core and
# share a cluster. Only points of the other cells (fewer than min_samples each) are sent to
# their neighbour cells, so the distances computed grow with the rows, however many rows
# one cell holds. Dense neighbour cells are linked by comparing the boxes of ever smaller
# sub-cells, never all their points.


def _distance2(a: Sequence[str], b: Sequence[str]) -> Column:
    return sum(((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b)), F.lit(0.0))


def _offsets(d: int) -> list[tuple[int, ...]]:
    reach = math.ceil(math.sqrt(d))
    near = itertools.product(range(-reach, reach + 1), repeat=d)
    return [o for o in near if sum(max(abs(x) - 1, 0) ** 2 for x in o) <= d + 1e-9]


class _Points:
    """The rows of a frame and its distinct points with their weights, written once for all radii."""

    def __init__(self, df: DataFrame, key: str, dims: Sequence[str]) -> None:
        self.x = [f"x{i}" for i in range(len(dims))]
        self.rows = cut(df.select(F.col(key).alias("pid"), *[q(v).cast("double").alias(x) for v, x in zip(dims, self.x)]))
        # equal points count as one with a weight, so copies never meet each other
        self.unique = cut(self.rows.groupBy(*self.x).agg(F.min("pid").alias("pid"), F.count(F.lit(1)).alias("w")))

    def each(self, found: DataFrame) -> DataFrame:
        """The rows with what was found for their points."""
        return spread_join(self.rows, found, self.x, counts=self.unique.select(*self.x, F.col("w").alias("__n")))


class _Grid:
    """Distinct points in cells, with their weights and core flags."""

    def __init__(self, points: _Points, eps: float, min_samples: int) -> None:
        self.x, self.d, self.eps, self.min_samples = points.x, len(points.x), eps, min_samples
        self.side = eps / math.sqrt(self.d)
        self.c = [f"c{i}" for i in range(self.d)]
        cells = [F.floor(F.col(x) / F.lit(self.side)).cast("bigint").alias(c) for x, c in zip(self.x, self.c)]
        self.points = points.unique.select("pid", "w", *self.x, *cells)
        sizes = self.points.groupBy(*self.c).agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("__n"))
        self.cells = cut(sizes.withColumn("dense", F.col("n") >= min_samples))
        self.known: DataFrame | None = None

    def by_cell(self, some: DataFrame, small: DataFrame) -> DataFrame:
        """Some of the points joined by their cell, of which the number of points is known."""
        return spread_join(some, small, self.c, counts=self.cells.select(*self.c, "__n"))

    def flagged(self) -> DataFrame:
        """Points with ``core``, written once."""
        if self.known is None:
            self.known = cut(self._flagged())
        return self.known

    def share(self) -> float:
        """The share of the rows that are core."""
        row = self.flagged().agg(F.sum(F.when(F.col("core"), F.col("w")).otherwise(0)).alias("c"), F.sum("w").alias("n")).first()
        return row["c"] / row["n"]

    def _flagged(self) -> DataFrame:
        """Points with ``core``: by their cell if dense, else by counted neighbours."""
        points = self.by_cell(self.points, self.cells.select(*self.c, "dense"))
        sparse = points.filter("NOT dense")
        near = self.pairs(points, sparse.select("pid", *self.x, *self.c))
        counted = near.groupBy("s_pid").agg(F.sum("w").alias("around")).withColumnRenamed("s_pid", "pid")
        few = sparse.join(counted, "pid", "left").withColumn("core", F.coalesce("around", F.lit(0)) >= self.min_samples)
        columns = ["pid", "w", *self.x, *self.c, "dense", "core"]
        return points.filter("dense").withColumn("core", F.lit(True)).select(*columns).unionByName(few.select(*columns))

    def pairs(self, points: DataFrame, sparse: DataFrame) -> DataFrame:
        """Each sparse point with the points within eps of it, found in neighbour cells."""
        moves = F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in _offsets(self.d)])
        sent = sparse.select("*", F.explode(moves).alias("o")).select(
            F.col("pid").alias("s_pid"),
            *[F.col(x).alias(f"s_{x}") for x in self.x],
            *[F.col(c).alias(f"s_{c}") for c in self.c],
            *[(F.col(c) + F.col(f"o.o{i}")).alias(c) for i, c in enumerate(self.c)],
        )
        met = self.by_cell(points, sent)
        return met.filter(_distance2(self.x, [f"s_{x}" for x in self.x]) <= F.lit(self.eps * self.eps))


def core_points(df: DataFrame, key: str, dims: Sequence[str], eps: float, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """``(key, core)``: whether at least ``min_samples`` points (itself included) lie within eps."""
    if len(dims) > GRID_COLUMNS:
        return density.dbscan(df, key, list(dims), eps, min_samples).select(key, "core")
    points = _Points(df, key, dims)
    flags = _Grid(points, eps, min_samples).flagged().select(*points.x, "core")
    return points.each(flags).select(F.col("pid").alias(key), "core")


def auto_eps(df: DataFrame, key: str, dims: Sequence[str], min_samples: int = MIN_SAMPLES, tolerance: float = 0.01) -> float:
    """The radius within which 90 % of the points have ``min_samples`` points, 0.3 at least.

    That radius is the 90th percentile of the distance to the ``min_samples``-th nearest
    point (itself included). Core points at a trial radius are counted on the grid (or the tree of
    cells, which is built once), and the radius is bracketed by doubling and halved down to ``tolerance``. A table of fewer rows than
    ``min_samples`` has no such radius and gets the smallest.
    """
    if len(dims) > GRID_COLUMNS:
        tree = density.Tree(df, key, list(dims))
        return _radius(df, lambda eps: density.share_of_core(tree, eps, min_samples), min_samples, tolerance)
    return _auto_grid(_Points(df, key, dims), min_samples, tolerance).eps


def _auto_grid(points: _Points, min_samples: int, tolerance: float = 0.01) -> _Grid:
    """The grid of the radius that ``auto_eps`` finds; its core flags are known from the trial."""
    grids: dict[float, _Grid] = {}

    def share(eps: float) -> float:
        grids[eps] = _Grid(points, eps, min_samples)
        return grids[eps].share()

    eps = _radius(points.rows, share, min_samples, tolerance)
    return grids.get(eps) or _Grid(points, eps, min_samples)


def _radius(df: DataFrame, share: Callable[[float], float], min_samples: int, tolerance: float) -> float:
    """The smallest radius found by doubling and halving of which enough of the rows are core."""
    if df.limit(min_samples).count() < min_samples:
        return MIN_EPS  # no radius makes any point core
    low, high = MIN_EPS, 2 * MIN_EPS
    if share(MIN_EPS) >= EPS_SHARE:
        return MIN_EPS
    while share(high) < EPS_SHARE:
        low, high = high, 2 * high
    while high - low > tolerance * low:
        mid = (low + high) / 2
        low, high = (low, mid) if share(mid) >= EPS_SHARE else (mid, high)
    return high


def dbscan(df: DataFrame, key: str, dims: Sequence[str], eps: float | None = None, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """``(key, core, cluster)``: the smallest core key of the cluster, -1 for noise.

    Border points near several clusters take the smallest label. Exact for any number of columns:
    up to three on a grid, more in a tree of cells (``density``), since a grid cell has too many
    neighbours then. ``key`` is an integer and no coordinate is null.
    """
    if not dims:
        raise ValueError("density clusters need a column")
    if len(dims) > GRID_COLUMNS:
        return density.dbscan(df, key, list(dims), auto_eps(df, key, dims, min_samples) if eps is None else eps, min_samples)
    placed = _Points(df, key, dims)
    grid = _auto_grid(placed, min_samples) if eps is None else _Grid(placed, eps, min_samples)
    points = grid.flagged()
    core = points.filter("core")
    nodes = cut(core.groupBy(*grid.c).agg(F.min("pid").alias("node"), F.max("dense").alias("dense")))
    named = grid.by_cell(core.select("pid", "w", *grid.x, *grid.c), nodes.select(*grid.c, "node"))
    near = grid.pairs(named, points.filter("NOT dense").select("pid", *grid.x, *grid.c))
    touches = cut(near.select("s_pid", "node").distinct())
    sparse_core = points.filter("core AND NOT dense").join(nodes.select(*grid.c, "node"), grid.c)
    links = touches.join(sparse_core.select(F.col("pid").alias("s_pid"), F.col("node").alias("a")), "s_pid")
    links = links.select("a", F.col("node").alias("b")).unionByName(_dense_links(grid, points, nodes))
    labels = connected_labels(nodes.select("node"), links.filter("a <> b").distinct())
    cell_label = nodes.join(labels, "node").select(*grid.c, "label")
    core_label = grid.by_cell(core.select("pid", *grid.x, *grid.c), cell_label).select(*grid.x, "label")
    border = points.filter("NOT core").join(
        touches.join(labels, "node").groupBy("s_pid").agg(F.min("label").alias("label")).withColumnRenamed("s_pid", "pid"),
        "pid", "left",
    )
    every = core_label.withColumn("core", F.lit(True)).unionByName(
        border.select(*grid.x, F.coalesce("label", F.lit(NOISE)).alias("label")).withColumn("core", F.lit(False))
    )
    return placed.each(every).select(F.col("pid").alias(key), "core", F.col("label").alias("cluster"))


def _dense_links(grid: _Grid, points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between dense cells that hold two points within eps."""
    dense = cut(grid.by_cell(points.filter("dense").select(*grid.x, *grid.c), nodes.select(*grid.c, "node")))
    eps2 = grid.eps * grid.eps
    k = [f"k{i}" for i in range(grid.d)]

    def placed(some: DataFrame, level: int) -> DataFrame:
        return some.withColumns({c: F.floor(F.col(x) * F.lit(2.0**level / grid.side)).cast("bigint") for c, x in zip(k, grid.x)})

    def boxes(some: DataFrame, level: int) -> DataFrame:
        """Per sub-cell of each dense cell: the bounds of its points and one of them; written once for both sides."""
        return cut(placed(some, level).groupBy("node", *grid.c, *k).agg(
            *[F.min(x).alias(f"lo{i}") for i, x in enumerate(grid.x)],
            *[F.max(x).alias(f"hi{i}") for i, x in enumerate(grid.x)],
            F.min(F.struct(*grid.x)).alias("p"),
        ))

    def sided(made: DataFrame, side: str) -> DataFrame:
        return made.select(*[F.col(c).alias(f"{side}_{c}") for c in made.columns])

    def judged(pairs: DataFrame) -> DataFrame:
        low = high = real = F.lit(0.0)
        for i, x in enumerate(grid.x):
            apart = F.greatest(F.col(f"b_lo{i}") - F.col(f"a_hi{i}"), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.lit(0.0))
            across = F.greatest(F.col(f"b_hi{i}") - F.col(f"a_lo{i}"), F.col(f"a_hi{i}") - F.col(f"b_lo{i}"))
            step = F.col(f"a_p.{x}") - F.col(f"b_p.{x}")
            low, high, real = low + apart * apart, high + across * across, real + step * step
        linked = (high <= eps2) | (real <= eps2)
        keys = ["a_node", "b_node", *[f"{s}_k{i}" for s in "ab" for i in range(grid.d)]]
        return pairs.select(*keys, linked.alias("linked"), (low > eps2).alias("far"))

    half = [o for o in _offsets(grid.d) if o > (0,) * grid.d]
    moves = F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in half])
    whole = boxes(dense, 0)
    first = sided(whole, "a").select("*", F.explode(moves).alias("o"))
    first = first.withColumns({f"b_{c}": F.col(f"a_{c}") + F.col(f"o.o{i}") for i, c in enumerate(grid.c)})
    state = cut(judged(first.join(sided(whole, "b"), [f"b_{c}" for c in grid.c])))
    found = state.filter("linked").select("a_node", "b_node").distinct()
    level = 0
    while True:
        level += 1
        open_pairs = state.filter("NOT linked AND NOT far").join(
            state.filter("linked").select("a_node", "b_node").distinct(), ["a_node", "b_node"], "left_anti"
        )
        if open_pairs.isEmpty():
            break
        if level > BOX_LEVELS:  # the boxes are tiny: their points are compared themselves
            for side in "ab":
                sub = [F.floor(F.col(x) * F.lit(2.0 ** (level - 1) / grid.side)).cast("bigint").alias(f"{side}_k{i}") for i, x in enumerate(grid.x)]
                points_of = dense.select(F.col("node").alias(f"{side}_node"), *sub, *[F.col(x).alias(f"{side}_{x}") for x in grid.x])
                open_pairs = open_pairs.join(points_of, [f"{side}_node", *[f"{side}_k{i}" for i in range(grid.d)]])
            met = open_pairs.filter(_distance2([f"a_{x}" for x in grid.x], [f"b_{x}" for x in grid.x]) <= eps2)
            found = found.unionByName(met.select("a_node", "b_node").distinct())
            break
        # only points of sub-cells in open pairs are looked at again, fewer at each level
        still = [open_pairs.select(F.col(f"{s}_node").alias("node"), *[F.col(f"{s}_{c}").alias(c) for c in k]) for s in "ab"]
        met = placed(dense, level - 1).join(still[0].unionByName(still[1]).distinct(), ["node", *k], "left_semi")
        dense = cut(met.select(*dense.columns))
        made = boxes(dense, level)
        for side in "ab":
            up = {f"{side}_u{i}": F.expr(f"{side}_k{i} >> 1") for i in range(grid.d)}
            small = sided(made, side).withColumns(up).drop(*[f"{side}_{c}" for c in grid.c])
            keys = [f"{side}_node", *[f"{side}_u{i}" for i in range(grid.d)]]
            open_pairs = open_pairs.withColumnsRenamed({f"{side}_k{i}": f"{side}_u{i}" for i in range(grid.d)})
            open_pairs = open_pairs.join(small, keys).drop(*keys[1:])
        state = cut(judged(open_pairs))
        found = found.unionByName(state.filter("linked").select("a_node", "b_node").distinct())
    return found.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def connected_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node of each connected group, itself if it has no link."""
    name = nodes.columns[0]
    found = components(links)
    return (
        nodes.select(F.col(name).alias("node"))
        .join(found, "node", "left")
        .select("node", F.coalesce("label", "node").alias("label"))
    )
