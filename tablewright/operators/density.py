"""Density clusters of points with any number of columns, by metric partitioning.

A tree of cells is built top down: a cell of more than ``CELL`` points takes some of them as
pivots, and every point goes to its nearest pivot. A cell knows its pivot, the distance of its farthest
point and its weight. Which leaves can hold points within ``eps`` of each other is found by going
down the tree in pairs: by the triangle inequality a pair is out if its pivots are further apart than both
radii and ``eps``, and with it all pairs below. Vectors move only between leaves that are left.

A cell of radius ``eps / 2`` with ``min_samples`` points is *tight*: its points are neighbours, so all are core
and in one cluster, and no distances inside it are needed. Other leaves are clustered locally. A point
visits other leaves only while its own ones don't make it core, and leaves of one cluster need no further
link, so most pairs of leaves within reach never meet; local clusters are merged through connected components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators.columns import q
from tablewright.operators.components import components
from tablewright.operators.skew import spread_join
from tablewright.session import stored

#: points of a leaf at most
CELL = 1024
#: pivots of a cell
FAN = 16
#: rows of a level's pivots that may be broadcast
MOST_PIVOTS = 4096
#: leaves that a group of points is compared with before all others in reach
NEAREST = 8
#: groups that one other group meets in one go
VISITORS = 64
NOISE = -1
ROOT = "r"
_SLACK = 1e-9


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Whether each point of ``a`` is within ``eps`` of each of ``b``; summed column by column."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        gap = a[:, i][:, None] - b[:, i][None, :]
        total += gap * gap
    return total <= eps * eps


class Tree:
    """The cells of a table's distinct points; independent of ``eps``."""

    def __init__(self, df: DataFrame, key: str, dims: list[str]) -> None:
        self.x = [f"x{i}" for i in range(len(dims))]
        self.rows = df.select(F.col(key).cast("bigint").alias("pid"), *[q(c).cast("double").alias(x) for c, x in zip(dims, self.x)])
        unique = self.rows.groupBy(*self.x).agg(F.min("pid").alias("pid"), F.count(F.lit(1)).alias("w"))
        points = stored(unique.select("pid", "w", F.array(*self.x).alias("v"), F.lit(ROOT).alias("cell")))
        self.total = points.agg(F.sum("w")).first()[0] or 0
        # every level's cells, and which of them have cells below
        self.kids: DataFrame | None = None
        self.depth = 0
        done, open_ = None, points
        while True:
            sizes = open_.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
            large = sizes.filter(F.col("n") > CELL).select("cell") if self.depth else sizes.select("cell")
            large = stored(large)
            leaves = open_.join(large, "cell", "left_anti")
            done = leaves if done is None else done.unionAll(leaves)
            if large.isEmpty():
                break
            open_, kids = self._divide(open_.join(large, "cell"))
            self.kids = kids if self.kids is None else self.kids.unionAll(kids)
            self.depth += 1
        self.points = stored(done)
        # a leaf is its own only child, so pairs of any depth go down together
        ends = self.points.select("cell").distinct()
        if self.kids is not None:
            self.kids = stored(self.kids.unionAll(self.kids.join(ends, "cell").select(F.col("cell").alias("parent"), "cell", "pivot", "far", "w")))

    def _divide(self, points: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One level: every point with its new cell, and the new cells with their parents."""
        mixed = F.xxhash64(F.lit(self.depth), "pid")
        rank = F.row_number().over(W.partitionBy("cell").orderBy(mixed, "pid"))
        some = points.withColumn("n", rank).filter(F.col("n") <= FAN)
        pivots = stored(some.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("n", F.col("v").alias("p")))).alias("pivots")))
        few = F.broadcast(pivots) if pivots.count() * FAN <= MOST_PIVOTS else pivots
        best = F.array_min(F.transform("pivots", lambda p: F.struct(_distance(F.col("v"), p["p"]).alias("far"), p["n"].alias("n"))))
        name = F.concat("cell", F.lit("."), F.col("best.n").cast("string"))
        placed = stored(points.join(few, "cell").withColumn("best", best).select("pid", "w", "v", name.alias("cell"), F.col("best.far").alias("far")))
        middle = pivots.select(F.col("cell").alias("parent"), F.inline("pivots")).withColumn("cell", F.concat("parent", F.lit("."), F.col("n").cast("string")))
        kids = placed.groupBy("cell").agg(F.max("far").alias("far"), F.sum("w").alias("w"))
        kids = stored(middle.join(kids, "cell").select("parent", "cell", F.col("p").alias("pivot"), "far", "w"))
        return placed.drop("far"), kids


class Neighbours:
    """What a radius makes of a tree: tight cells, pairs of leaves within reach, and core points."""

    def __init__(self, tree: Tree, eps: float, min_samples: int) -> None:
        self.tree, self.eps, self.min_samples = tree, eps, min_samples
        tight = (F.col("far") <= eps / 2 * (1 - _SLACK)) & (F.col("w") >= min_samples)
        self.kids = tree.kids.withColumn("tight", F.when(tight, F.col("cell")))
        self.nodes = self._tight_cells()
        self.pairs = self._pairs()

    def _tight_cells(self) -> DataFrame:
        """``(cell, node)`` of every leaf: its topmost tight cell, null if none is."""
        down = self.kids.filter(F.col("parent") == ROOT).select("cell", F.col("tight").alias("node"))
        for _ in range(self.tree.depth - 1):
            step = self.kids.filter(F.col("parent") != ROOT).select(F.col("parent").alias("cell"), F.col("cell").alias("next"), "tight")
            down = down.join(step, "cell").select(F.col("next").alias("cell"), F.coalesce("node", "tight").alias("node"))
        return stored(down)

    def _pairs(self) -> DataFrame:
        """``(a, b, a_node, b_node, joined)``: leaves that may hold neighbours, each pair once; pairs inside one
        tight cell are left out. ``joined``: the pivots, which are points, are neighbours."""
        def side(s: str) -> DataFrame:
            return self.kids.select(*[F.col(c).alias(f"{s}_{n}") for c, n in (("parent", "up"), ("cell", "cell"), ("pivot", "pivot"), ("far", "far"), ("tight", "tight"))])

        pairs = self.tree.rows.sparkSession.createDataFrame([(ROOT, ROOT, None, None)], "a string, b string, a_node string, b_node string")
        for _ in range(self.tree.depth):
            step = pairs.join(side("a"), F.col("a") == F.col("a_up")).join(side("b"), F.col("b") == F.col("b_up"))
            apart = _distance(F.col("a_pivot"), F.col("b_pivot"))
            reach = (F.col("a_far") + F.col("b_far") + self.eps) * (1 + _SLACK)
            nodes = {f"{s}_node": F.coalesce(f"{s}_node", f"{s}_tight") for s in "ab"}
            step = step.withColumns({**nodes, "apart": apart}).filter((F.col("apart") <= reach) & ((F.col("a") != F.col("b")) | (F.col("a_cell") <= F.col("b_cell"))))
            step = step.filter(~(F.col("a_node") == F.col("b_node")) | F.col("a_node").isNull() | F.col("b_node").isNull())
            pairs = stored(step.select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b"), "a_node", "b_node", (F.col("apart") <= self.eps * (1 - _SLACK)).alias("joined")))
        return pairs

    def visits(self, groups: DataFrame, others: DataFrame, unlike: str | None = None) -> DataFrame:
        """``(a, b, apart, reach)``: which of ``others`` may hold neighbours of which of ``groups`` in another leaf, by
        the triangle inequality with their own heads; with ``unlike`` only those that differ in that column."""
        both = self.pairs.filter("a <> b").select(F.inline(F.array(
            F.struct(F.col("a").alias("a_cell"), F.col("b").alias("b_cell")), F.struct(F.col("b").alias("a_cell"), F.col("a").alias("b_cell"))
        )))
        one, two = (g.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "cell", "head", "far", *([unlike] if unlike else []))]) for s, g in (("a", groups), ("b", others)))
        met = both.join(one, "a_cell").join(two, "b_cell")
        if unlike:
            met = met.filter(F.col(f"a_{unlike}") != F.col(f"b_{unlike}"))
        apart, reach = _distance(F.col("a_head"), F.col("b_head")), (F.col("a_far") + F.col("b_far") + self.eps) * (1 + _SLACK)
        met = met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), apart.alias("apart"), reach.alias("reach"))
        return met.filter("apart <= reach")

    def _alone(self, points: DataFrame) -> DataFrame:
        """``(pid, n, near)`` of the points that have too few neighbours in their own leaf."""
        eps, least = self.eps, self.min_samples

        def run(leaf: pd.DataFrame) -> pd.DataFrame:
            pids, near = leaf["pid"].to_numpy(), _near(np.stack(leaf["v"]), np.stack(leaf["v"]), eps)
            n = near @ leaf["w"].to_numpy()
            few = np.flatnonzero(n < least)
            return pd.DataFrame({"pid": pids[few], "n": n[few], "near": pd.Series([pids[near[i]].tolist() for i in few], dtype=object)})

        return points.groupBy("cell").applyInPandas(run, "pid bigint, n bigint, near array<bigint>")

    def flagged(self) -> DataFrame:
        """The points with ``node`` and ``core``, and ``near``, the neighbours of a point that is not core.

        Few points have too few neighbours in their own leaf; only these visit other leaves, the nearest
        ones first, and the others only if those don't settle them.
        """
        points = stored(self.tree.points.join(self.nodes, "cell"))
        eps, least = self.eps, self.min_samples
        found = open_ = stored(self._alone(points.filter("node IS NULL").select("cell", "pid", "v", "w")))
        leaves = _groups(points, "cell")

        def count(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            near = _near(_vectors(a), _vectors(b), eps)
            n, other = near @ b["w"], b["pids"]
            hit = np.flatnonzero(n)
            # a point with more neighbours than these is core, and nobody asks for them
            return pd.DataFrame({"pid": a["pids"][hit], "n": n[hit], "near": pd.Series([other[near[i]][:least].tolist() for i in hit], dtype=object)})

        seen = None
        for most in (NEAREST, None):
            if open_.isEmpty():
                break
            groups = _groups(points.join(open_.select("pid"), "pid"), "cell")
            visits = self.visits(groups, leaves)
            if seen is not None:
                visits = visits.join(seen, ["a", "b"], "left_anti")
            visits = seen = stored(_nearest(visits, most).select("a", "b"))
            met = stored(_meet(visits, groups, leaves, count, "pid bigint, n bigint, near array<bigint>"))
            found = stored(found.unionAll(met).groupBy("pid").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("near")).alias("near")))
            open_ = found.filter(F.col("n") < least)
        joined = points.join(found, "pid", "left")
        core = F.col("node").isNotNull() | F.col("n").isNull() | (F.col("n") >= least)
        return joined.select("pid", "w", "v", "cell", "node", core.alias("core"), F.when(~core, F.col("near")).alias("near"))


def _groups(points: DataFrame, *by: str) -> DataFrame:
    """``(id, cell, …, head, far, pids, w, x)``: a leaf's points of one kind, at most ``CELL``, around one of them."""
    id_ = F.concat_ws("/", *[F.col(c).cast("string") for c in by]).alias("id")
    made = points.groupBy(*by).agg(F.collect_list(F.struct("pid", "v", "w")).alias("block"))
    made = made.withColumn("head", F.col("block")[0]["v"])
    far = F.array_max(F.transform("block", lambda p: _distance(p["v"], F.col("head"))))
    flat = [F.col("block")["pid"].alias("pids"), F.col("block")["w"].alias("w"), F.flatten(F.col("block")["v"]).alias("x")]
    return stored(made.select(id_, *by, "head", far.alias("far"), *flat))


def _vectors(group: pd.Series) -> np.ndarray:
    return group["x"].reshape(len(group["pids"]), -1)


def _nearest(visits: DataFrame, most: int | None) -> DataFrame:
    """The ``most`` nearest visits of each group, or all."""
    if not most:
        return visits
    place = F.row_number().over(W.partitionBy("a").orderBy("apart", "b"))
    return visits.withColumn("place", place).filter(F.col("place") <= most)


def _meet(pairs: DataFrame, left: DataFrame, right: DataFrame, function, schema: str) -> DataFrame:
    """``function(group a, group b)`` for every pair of groups; a task holds one group ``b`` and ``VISITORS`` others at a time."""
    turn = F.floor((F.row_number().over(W.partitionBy("b").orderBy("a")) - 1) / VISITORS)
    turns = stored(pairs.select("a", "b", turn.alias("turn")))
    one = turns.join(left.select(F.col("id").alias("a"), "pids", "w", "x"), "a")
    two = turns.select("b", "turn").distinct().join(right.select(F.col("id").alias("b"), "pids", "w", "x"), "b")
    one, two = (side.select(*[F.col(c).alias(f"{s}_{c}") for c in side.columns]) for s, side in (("a", one), ("b", two)))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = (g.rename(columns=lambda c: c[2:]) for g in (a, b))
        host = b.iloc[0]
        return pd.concat([function(guest, host) for _, guest in a.iterrows()])

    return one.groupBy("a_b", "a_turn").cogroup(two.groupBy("b_b", "b_turn")).applyInPandas(run, schema)


def _local(eps: float):
    """The core points of one leaf with their local cluster, named by its smallest point."""
    def run(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("pid")
        near = _near(np.stack(points["v"]), np.stack(points["v"]), eps)
        names = points["pid"].to_numpy().copy()
        while True:  # every point takes the smallest name in reach
            least = np.where(near, names[None, :], np.iinfo(np.int64).max).min(axis=1)
            # and then the name of the point it is named after
            least = np.minimum(least, least[np.searchsorted(points["pid"].to_numpy(), least)])
            if np.array_equal(least, names):
                return pd.DataFrame({"pid": points["pid"], "part": names})
            names = least

    return run


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``(part, label)`` after links ``(a, b)`` between labels."""
    found = components(links).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return stored(labels.join(found, "label", "left").select("part", F.coalesce("to", "label").alias("label")))


def _clusters(near: Neighbours, core: DataFrame) -> DataFrame:
    """``(part, label)``: the cluster, named by its smallest core point, of each local cluster.

    Leaves whose pivots are neighbours are linked without any vector. Vectors are sent only between the groups
    (leaf and cluster so far) of different clusters: to the nearest ones first, since these links leave
    few others in doubt.
    """
    eps = near.eps

    def touch(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        hit = _near(_vectors(a), _vectors(b), eps).any()
        return pd.DataFrame({"a": [a["a"]] * int(hit), "b": [b["b"]] * int(hit)}, dtype=object)

    ends = near.tree.points.select("cell").distinct()
    heads = near.tree.kids.join(ends, "cell").select("cell", F.col("pivot").alias("v")).distinct()
    heads = stored(heads.join(core, ["cell", "v"]).select("cell", "part"))
    a, b = (heads.select(F.col("cell").alias(s), F.col("part").alias(f"{s}_part")) for s in "ab")
    links = near.pairs.filter("joined AND a <> b").join(a, "a").join(b, "b").filter("a_part <> b_part")
    labels = core.select("part", F.col("part").alias("label")).distinct()
    labels = _merged(labels, stored(links.select(F.col("a_part").alias("a"), F.col("b_part").alias("b")).distinct()))
    for most in (NEAREST, None):
        groups = _groups(spread_join(core, labels, ["part"]), "cell", "label")
        visits = stored(_nearest(near.visits(groups, groups, "label"), most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if visits.isEmpty():
            break
        met = stored(_meet(visits, groups, groups, touch, "a string, b string"))
        one, two = (groups.select(F.col("id").alias(s), F.col("label").alias(f"{s}_label")) for s in "ab")
        links = met.join(one, "a").join(two, "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
        labels = _merged(labels, stored(links.distinct()))
    return labels


def dbscan(df: DataFrame, key: str, dims: list[str], eps: float, min_samples: int, tree: Tree | None = None) -> DataFrame:
    """``(key, core, cluster)`` as ``clustering.dbscan`` gives it, for any number of columns."""
    tree = tree or Tree(df, key, dims)
    empty = f"`{key}` {df.schema[key].dataType.simpleString()}, core boolean, cluster bigint"
    if not tree.total:
        return df.sparkSession.createDataFrame([], empty)
    near = Neighbours(tree, eps, min_samples)
    points = stored(near.flagged())
    schema = "pid bigint, part bigint"
    local = points.filter("core AND node IS NULL").select("cell", "pid", "v").groupBy("cell").applyInPandas(_local(eps), schema)
    tight = points.filter("node IS NOT NULL").groupBy("node").agg(F.min("pid").alias("part"))
    named = spread_join(points.filter("node IS NOT NULL").select("pid", "node"), stored(tight), ["node"]).select("pid", "part")
    parts = local.unionAll(named)
    core = stored(points.filter("core").select("pid", "w", "v", "cell").join(parts, "pid"))
    labels = _clusters(near, core)
    known = stored(spread_join(core.select("pid", "part"), labels, ["part"]).select("pid", "label"))
    seen = points.filter("NOT core").select(F.col("pid").alias("one"), F.explode("near").alias("pid"))
    border = seen.join(known, "pid").groupBy(F.col("one").alias("pid")).agg(F.min("label").alias("label"))
    every = points.select("pid", "v", "core").join(known.unionAll(border), "pid", "left")
    every = every.select(*[F.col("v")[i].alias(x) for i, x in enumerate(tree.x)], "core", F.coalesce("label", F.lit(NOISE)).alias("cluster"))
    return spread_join(tree.rows, every, tree.x).select(F.col("pid").cast(df.schema[key].dataType).alias(key), "core", "cluster")


def share_of_core(tree: Tree, eps: float, min_samples: int) -> float:
    """Weight of the core points among all."""
    found = Neighbours(tree, eps, min_samples).flagged().agg(F.sum(F.when(F.col("core"), F.col("w")).otherwise(0))).first()[0]
    return found / tree.total
