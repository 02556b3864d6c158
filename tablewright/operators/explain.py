"""Explanations of a scorer: permutation importance, Shapley values, what-if grids."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators.columns import q

REPEATS = 5
ROWS_PER_BUCKET = 10_000


def shuffled_copies(
    df: DataFrame,
    features: Sequence[str],
    hashes: Sequence[Column],
    buckets: int,
    ties: Sequence[str],
) -> DataFrame:
    """Per repeat, each row with ``{f}__shuffled``: the feature value of another row.

    A hash puts every row in a random bucket and orders it there; the value comes from the
    next row, the last taking the first's. That permutes each column over buckets which are
    random samples of a bounded size, in one shuffle per repeat for all features. Equal rows
    share a hash; if one overfills a bucket, the hash of the ``ties`` deals it out as well, so
    the result depends on the rows alone.
    """
    copies = None
    parts = _bucket_parts(df, hashes[0], buckets)
    for i, h in enumerate(hashes):
        part = F.pmod(F.xxhash64(F.lit(i), *[q(t) for t in ties]), F.lit(parts)).cast("int")
        placed = df.withColumn("__h", h).withColumn("__s", part)
        placed = placed.withColumn("__b", F.pmod(F.col("__h"), F.lit(buckets)) * parts + F.col("__s")).drop("__s")
        inside = W.partitionBy("__b").orderBy("__h", *ties)
        whole = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        last = F.row_number().over(inside) == F.count(F.lit(1)).over(W.partitionBy("__b"))
        moved = {
            f"{f}__shuffled": F.when(last, F.first(q(f)).over(whole)).otherwise(F.lead(q(f)).over(inside))
            for f in features
        }
        one = placed.withColumns(moved).withColumn("repeat", F.lit(i)).drop("__h", "__b")
        copies = one if copies is None else copies.unionByName(one)
    return copies


def _bucket_parts(df: DataFrame, hashed: Column, buckets: int) -> int:
    sizes = df.groupBy(F.pmod(hashed, F.lit(buckets)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    return 1 if most <= 4 * ROWS_PER_BUCKET else -(-most // ROWS_PER_BUCKET)


def with_one_shuffled(copies: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature with just that feature replaced; the input of any model's ``transform``."""
    keep = [c for c in copies.columns if not c.endswith("__shuffled") and c not in features]

    def version(name: str) -> Column:
        values = [q(f"{f}__shuffled" if f == name else f).alias(f) for f in features]
        return F.struct(F.lit(name).alias("feature"), *values)

    return copies.select(*keep, F.inline(F.array(*[version(f) for f in features])))


def permutation_importance(
    df: DataFrame,
    features: Sequence[str],
    predict: Callable[[DataFrame], DataFrame],
    metric: Callable[[DataFrame, list[str]], DataFrame],
    hashes: Sequence[Column],
    ties: Sequence[str],
    rows: int | None = None,
) -> DataFrame:
    """Mean drop of the metric when a feature is shuffled, over the repeats.

    ``predict`` adds the prediction, ``metric(df, by)`` returns ``(by…, score)``. All
    repeats and features are scored in one plan and one grouped aggregation; the unchanged
    rows, the same in every repeat, are scored once.
    """
    rows = df.count() if rows is None else rows
    buckets = max(1, rows // ROWS_PER_BUCKET)
    copies = shuffled_copies(df, features, hashes, buckets, ties)
    scored = metric(predict(with_one_shuffled(copies, features)), ["feature", "repeat"])
    base = metric(predict(df), []).select(F.col("score").alias("base"))
    drop = scored.crossJoin(F.broadcast(base))
    return drop.groupBy("feature").agg(
        F.avg(F.col("base") - F.col("score")).alias("importance"),
        F.stddev_pop(F.col("base") - F.col("score")).alias("spread"),
    )


def linear_shap(df: DataFrame, keys: Sequence[str], weights: dict[str, float]) -> DataFrame:
    """Exact Shapley values of a linear score, ``w * (x - mean(x))``, one row per feature."""
    means = df.agg(*[F.avg(q(c).cast("double")).alias(c) for c in weights]).first()
    phis = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), (F.lit(w) * (q(c).cast("double") - F.lit(means[c]))).alias("phi"))
            for c, w in weights.items()
        ]
    )
    return df.select(*keys, F.inline(phis))


def mean_abs_shap(values: DataFrame, k: int = 20) -> DataFrame:
    """Features by mean absolute Shapley value."""
    agg = values.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    return agg.orderBy(F.desc("mean_abs"), "feature").limit(k)


def sampled_shap(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    background: Sequence[Sequence[float]],
    orders: Sequence[Sequence[int]],
    predict: Callable[[DataFrame], DataFrame],
    score: Column,
    vector: str = "x",
) -> DataFrame:
    """Monte-Carlo Shapley values of any model as ``(keys, feature, phi)``.

    ``df`` holds the feature values as one array column ``vector``. For each explained row
    and background row, features switch from the background to the row one by one in a
    given order (positions into ``features``); the score change at a switch is that
    feature's share. ``background`` and ``orders`` are small driver-side parameters, so a
    row is repeated ``len(background) * (len(features) + 1)`` times inside its task and all
    copies are scored in one ``transform``. Per row the values add up to its score minus
    the mean background score.
    """
    d = len(features)
    base = F.lit([[float(v) for v in row] for row in background])
    # place[r][j]: when feature j switches on path r; turn[r][i]: which feature switches i-th
    paths = [orders[r % len(orders)] for r in range(len(background))]
    place = F.lit([[list(p).index(j) for j in range(d)] for p in paths])
    turn = F.lit([list(p) for p in paths])
    path = F.explode(F.sequence(F.lit(0), F.lit(len(background) - 1))).alias("__r")
    rows = df.select(*keys, vector, path).select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("__i"))
    mixed = F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda j: F.when(place[F.col("__r")][j] < F.col("__i"), F.col(vector)[j]).otherwise(base[F.col("__r")][j]),
    )
    scored = predict(rows.withColumn(vector, mixed)).select(*keys, "__r", "__i", score.alias("__s"))
    one_path = W.partitionBy(*keys, "__r").orderBy("__i")
    moved = scored.withColumn("__d", F.col("__s") - F.lag("__s").over(one_path)).filter("__i > 0")
    switched = F.lit(list(features))[turn[F.col("__r")][F.col("__i") - 1]]
    return moved.groupBy(*keys, switched.alias("feature")).agg((F.sum("__d") / F.lit(len(background))).alias("phi"))


def what_if_grid(row: dict, ranges: dict[str, tuple[float, float]], steps: int = 5) -> list[dict]:
    """Scenarios: each feature in turn moved from its low to its high, the rest as in ``row``."""
    grid = []
    for f, (lo, hi) in ranges.items():
        for i in range(steps):
            value = lo + (hi - lo) * i / (steps - 1)
            grid.append({**row, "varied": f, "setting": value, f: value})
    return grid


def partial_dependence(
    df: DataFrame,
    ranges: dict[str, tuple[float, float]],
    predict: Callable[[DataFrame], DataFrame],
    score: Column,
    steps: int = 5,
) -> DataFrame:
    """Mean score over all rows with one feature set to each of ``steps`` grid values.

    Every row is repeated once per scenario (features x steps, a parameter) inside its task
    and averaged with partial aggregation.
    """
    features = list(ranges)
    rest = [c for c in df.columns if c not in features]
    scenarios = []
    for f, (lo, hi) in ranges.items():
        for i in range(steps):
            value = F.lit(float(lo + (hi - lo) * i / (steps - 1)))
            values = [(value if g == f else q(g).cast("double")).alias(g) for g in features]
            scenarios.append(F.struct(F.lit(f).alias("varied"), value.alias("setting"), *values))
    rows = df.select(*[q(c) for c in rest], F.inline(F.array(*scenarios)))
    return predict(rows).groupBy("varied", "setting").agg(F.avg(score).alias("mean_score"))
