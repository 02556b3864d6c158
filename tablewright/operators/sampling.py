"""Fixed-size samples and exact splits decided by a hash, without sorting all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators.ranking import hash_bucket

BUCKETS = 4096


def head_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first ``n`` rows in key order: a top-k, not a sort of the table."""
    return df.orderBy(*keys).limit(n)


def sample_rows(df: DataFrame, n: int, hashed: Column, ties: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Exactly ``n`` rows with the smallest hash, ties broken by ``ties``.

    Bucket counts (one scan) tell which hash bucket holds the cut. Rows below it pass a
    filter; only that one bucket, a 1/``buckets`` share, is sorted.
    """
    keyed = df.withColumn("__b", hash_bucket(hashed, buckets))
    left, cut = n, None
    for r in sorted(keyed.groupBy("__b").count().collect()):
        if r["count"] > left:
            cut = r["__b"]
            break
        left -= r["count"]
    if cut is None:
        return df
    edge = keyed.filter(F.col("__b") == cut).orderBy(hashed, *ties).limit(left)
    return keyed.filter(F.col("__b") < cut).unionByName(edge).drop("__b")


def split_rows(
    df: DataFrame,
    hashed: Column,
    ties: Sequence[str],
    label: str | None = None,
    per_mille: Sequence[int] = (700, 150, 150),
    names: Sequence[str] = ("train", "val", "test"),
    name: str = "split",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Add ``split``: exact shares per label (or overall), rows chosen by hash order.

    The hash is of a row's key and ``ties`` tell rows apart: remove copies first.

    Each label's cuts fall into one hash bucket each. A row in any other bucket knows its
    part from the bucket alone; only rows in a cut bucket are ranked, so the table itself
    is not shuffled and no task gets a whole label.
    """
    by = label or "__all"
    keyed = df.withColumn("__b", hash_bucket(hashed, buckets)).withColumn("__h", hashed)
    if label is None:
        keyed = keyed.withColumn("__all", F.lit(1))
    per = keyed.groupBy(by, "__b").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy(by).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    per = per.select(
        F.col(by).alias("__l"), "__b", F.sum("n").over(upto).alias("upto"), "n",
        F.sum("n").over(W.partitionBy(by)).alias("total"),
    )
    share, cuts = 0, []
    for i, p in enumerate(per_mille[:-1]):
        share += p
        at = F.expr(f"total * {share} div 1000")
        place = F.struct(F.col("__b").alias("b"), (at - (F.col("upto") - F.col("n"))).alias("r"))
        cuts.append(F.min(F.when(F.col("upto") >= at, place)).alias(f"__c{i}"))
    edges = per.groupBy("__l").agg(*cuts)
    if label is None:
        # one group: its cuts are a handful of numbers
        only = edges.first()
        place = [only[f"__c{i}"] if only else None for i in range(len(cuts))]
        fixed = [F.struct(F.lit(p["b"] if p else -1).alias("b"), F.lit(p["r"] if p else 0).alias("r")) for p in place]
        placed = keyed.withColumns({f"__c{i}": c for i, c in enumerate(fixed)})
    else:
        placed = keyed.join(edges, F.col(by).eqNullSafe(F.col("__l")))
    on_edge = F.lit(False)
    for i in range(len(cuts)):
        on_edge = on_edge | (F.col("__b") == F.col(f"__c{i}.b"))

    def part(rank: Column) -> Column:
        out = F.lit(names[-1])
        for i in reversed(range(len(cuts))):
            c = F.col(f"__c{i}")
            inside = (F.col("__b") < c["b"]) | ((F.col("__b") == c["b"]) & (rank <= c["r"]))
            out = F.when(inside, names[i]).otherwise(out)
        return out

    order = W.partitionBy(by, "__b").orderBy("__h", *ties)
    ranked = placed.filter(on_edge).withColumn("__r", F.row_number().over(order))
    sure = placed.filter(~on_edge).withColumn("__r", F.lit(0))
    columns = [F.col(c) for c in df.columns]
    return sure.select(*columns, part(F.col("__r")).alias(name)).unionByName(
        ranked.select(*columns, part(F.col("__r")).alias(name))
    )
