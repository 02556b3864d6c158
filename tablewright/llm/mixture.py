"""Mix sources to target weights: budgets flow down a tree, leaves give seeded prefixes of epochs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.llm.common import without
from tablewright.session import stored

#: rows of a leaf that are ranked together, about
BUCKET_ROWS = 512
MOST_EPOCHS = 4
SEED = 42
#: a seeded order has this many places: the first eight hex digits of an MD5
_PLACES = 1 << 32


def token_length(text: Column) -> Column:
    """Words between ASCII white space: the token measure where no tokenizer is at hand."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def weight_of(weights: Mapping[tuple, float], level: int, names: Sequence[Column]) -> Column:
    """The weight of a node among its siblings.

    ``weights`` is keyed by the values from the root down to the node; a value of ``"*"`` fits
    any; the key with the fewest stars wins (of equally many, the one that sorts first), and 1
    is the weight of a node no key fits. A literal list, as long as the caller's mapping.
    """
    fitting = sorted((k for k in weights if len(k) == level + 1), key=lambda k: (sum(x == "*" for x in k), tuple(map(str, k))))
    out = F.lit(1.0)
    for key in reversed(fitting):
        same = [n.eqNullSafe(F.lit(x)) for n, x in zip(names, key) if x != "*"]
        hit = F.lit(True)
        for s in same:
            hit = hit & s
        out = F.when(hit, F.lit(float(weights[key]))).otherwise(out)
    return out


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple, float], budget: float, most_epochs: int = MOST_EPOCHS
) -> DataFrame:
    """``leaves`` (one row per leaf, with its ``supply`` of tokens) plus ``budget`` tokens.

    From the root down, a node's budget is shared among its children by weight. A child cannot
    take more than ``most_epochs`` times the supply below it, without leaves that a weight of 0 shuts out; what it leaves goes to its
    siblings by their weights, again up to what each can take. Since a node never gets more
    than its own children can take together, a shortage is met among siblings first, and only
    what they cannot take reaches the ancestor's other children. Children of weight 0 get
    nothing. Windows run over the nodes of one parent, never over rows.

    The share of a child is ``min(room, weight * rate)`` with one rate for all siblings: in the
    order of room per weight, the rate is the largest of (budget - rooms before) / (weights from
    here on), over all children.
    """
    levels = list(levels)
    # what a leaf can take: nothing if it or a node above it has weight 0
    open_path = F.lit(True)
    for i, _ in enumerate(levels):
        open_path = open_path & (weight_of(weights, i, [F.col(c) for c in levels[: i + 1]]) > 0)
    takes = F.when(open_path, F.col("supply")).otherwise(F.lit(0)).alias("takes")
    tree = leaves.select(*levels, "supply", takes, F.lit(float(budget)).alias("b"))
    for i, _ in enumerate(levels):
        path = [F.col(c) for c in levels[: i + 1]]
        weight = F.greatest(weight_of(weights, i, path), F.lit(0.0))
        nodes = tree.groupBy(*levels[: i + 1], "b").agg((F.sum("takes") * F.lit(float(most_epochs))).alias("room"))
        nodes = nodes.withColumn("w", weight).withColumn("room", F.when(F.col("w") > 0, F.col("room")).otherwise(F.lit(0.0)))
        siblings = W.partitionBy(*levels[:i]) if i else W.partitionBy(F.lit(0))
        order = siblings.orderBy(F.when(F.col("w") > 0, F.col("room") / F.col("w")).otherwise(F.lit(-1.0)), *path)
        before = F.coalesce(F.sum("room").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        behind = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
        nodes = nodes.withColumn("rate", F.when(behind > 0, (F.col("b") - before) / behind))
        rate = F.max("rate").over(siblings)
        enough = F.col("b") >= F.sum("room").over(siblings)
        share = F.when(enough, F.col("room")).otherwise(F.least(F.col("room"), F.col("w") * F.greatest(rate, F.lit(0.0))))
        given = nodes.select(*[F.col(c).alias(f"g{j}") for j, c in enumerate(levels[: i + 1])], share.alias("given"))
        fits = F.lit(True)
        for j, c in enumerate(levels[: i + 1]):
            fits = fits & F.col(c).eqNullSafe(F.col(f"g{j}"))
        tree = tree.join(given, fits).select(*levels, "supply", "takes", F.col("given").alias("b"))
    return tree.drop("takes").withColumnRenamed("b", "budget")


def mix(
    df: DataFrame, levels: Sequence[str], weights: Mapping[tuple, float], tokens: Column, ids: str = "doc_id",
    tie: Column | None = None, budget: float | None = None, fraction: float = 1.0, most_epochs: int = MOST_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """The rows of ``df`` that are used at least once, plus ``n_tokens`` and ``copies`` (epochs each is used in).

    The budget is ``budget`` tokens, or ``fraction`` of all there are, dealt to the leaves of
    the tree ``levels`` by ``leaf_budgets``. A leaf of ``s`` tokens and a budget of ``b`` uses
    all rows ``floor(b / s)`` times, and of one more epoch the longest prefix that fits the
    rest, in the order of MD5(seed:epoch:id), then id, then tokens, then ``tie`` (a hash of the
    text, say). Rows of no tokens come with the prefix they stand in. Rows that agree in all of
    these are taken or left together. Null levels are values like any other, null ids sort
    first, null and empty texts have no tokens. No rows give no rows.

    Only sums per leaf and per order bucket are shuffled for planning. A leaf's order is cut
    into buckets of some ``BUCKET_ROWS`` rows; buckets before the cut are taken and those
    behind it left without ranking, and only the one bucket with the cut is sorted. A leaf
    with a third of all rows is spread like any other.
    """
    levels = list(levels)
    own = [f"l{i}" for i in range(len(levels))]
    names = df.columns
    rows = df.select(
        *[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(names)],
        *[F.col(f"`{c}`").alias(o) for c, o in zip(levels, own)],
        tokens.cast("bigint").alias("t"), F.col(ids).cast("string").alias("key"), F.col(ids).alias("id"),
        (F.lit(0) if tie is None else tie).alias("h"),
    )
    leaves = stored(rows.groupBy(*own).agg(F.sum("t").cast("double").alias("supply"), F.count(F.lit(1)).alias("n")))
    whole = leaves.agg(F.sum("supply")).first()[0] or 0.0
    total = float(budget) if budget is not None else fraction * whole
    by_level = {tuple(k): v for k, v in weights.items()}
    budgets = leaf_budgets(leaves.select(*own, "supply"), own, by_level, total, most_epochs)
    plan = _same(leaves, budgets.drop("supply"), own).withColumns({
        "full": F.when(F.col("supply") > 0, F.floor(F.round("budget", 6) / F.col("supply"))).otherwise(F.lit(0)).cast("bigint"),
        "buckets": F.ceil(F.col("n") / BUCKET_ROWS).cast("bigint"),
    })
    rest = F.when(F.col("supply") > 0, F.floor(F.round(F.col("budget") - F.col("full") * F.col("supply"), 6))).otherwise(F.lit(0)).cast("bigint")
    plan = stored(plan.select(*own, "full", "buckets", rest.alias("rest")))

    placed = _same(rows, plan, own)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce("key", F.lit(""))).cast("binary"))
    placed = placed.withColumn("md5", digest)
    place = F.conv(F.substring("md5", 1, 8), 16, 10).cast("bigint")
    placed = placed.withColumn("bucket", F.floor(place * F.col("buckets") / F.lit(_PLACES)).cast("bigint"))
    sums = placed.groupBy(*own, "bucket", "rest").agg(F.sum("t").alias("in_bucket"))
    ahead = W.partitionBy(*own).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)))
    cut = sums.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("in_bucket") > F.col("rest")))
    # of a leaf, the first bucket that no longer fits whole
    cut = stored(cut.groupBy(*own).agg(F.min(F.struct("bucket", "before")).alias("m")).select(*own, "m.*"))
    cut = cut.withColumnsRenamed({"bucket": "cut_bucket", "before": "cut_before"})
    judged = _same(placed, cut, own, "left")
    ended = F.col("cut_bucket").isNull()
    inside = judged.filter(~ended & (F.col("bucket") == F.col("cut_bucket")))
    outside = judged.filter(ended | (F.col("bucket") != F.col("cut_bucket")))
    taken = F.when(ended | (F.col("bucket") < F.col("cut_bucket")), F.lit(1)).otherwise(F.lit(0))
    order = W.partitionBy(*own).orderBy("md5", "id", "t", "h")  # a range frame: equal rows share a fate
    reached = F.col("cut_before") + F.sum("t").over(order)
    inside = inside.withColumn("more", F.when(reached <= F.col("rest"), F.lit(1)).otherwise(F.lit(0)))
    out = outside.withColumn("more", taken).unionByName(inside).withColumn("copies", F.col("full") + F.col("more")).filter("copies > 0")
    out = out.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(names)], F.col("t").alias("__t"), F.col("copies").alias("__c"))
    kept = without(out, ["n_tokens", "copies"]).columns
    return out.select(*kept[:-2], F.col("__t").alias("n_tokens"), F.col("__c").cast("bigint").alias("copies"))


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, nulls equal nulls; ``b`` is small: one row per leaf."""
    right = b.withColumnsRenamed({c: f"__{c}" for c in columns})
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return a.join(right, on, how).drop(*[f"__{c}" for c in columns])
