"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000
HOT_ROWS = 100_000


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``big ⋈ small`` on ``keys`` with the hot keys of ``big`` cut into salted parts.

    A key is hot above ``max(hot_rows, rows/1000)`` rows, so there are at most 1000 of
    them and their list may be broadcast. Each hot key of ``big`` is spread over parts of
    about the threshold; its rows in ``small`` are repeated once per part. ``counts`` has a
    key's rows in ``big`` (or more) as ``__n``, where they are known already.
    """
    keys = list(keys)
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    rows = counts.agg(F.sum("__n").alias("s"), F.max("__n").alias("m")).first()
    limit = max(hot_rows, (rows["s"] or 0) // HOT_SHARE)
    if (rows["m"] or 0) <= limit:
        return big.join(small, keys, how)
    hot = F.broadcast(
        counts.filter(F.col("__n") > limit)
        .select(*keys, F.ceil(F.col("__n") / F.lit(limit)).cast("int").alias("__parts"))
    )
    others = [F.col(c) for c in big.columns]
    salt = F.pmod(F.xxhash64(*others), F.coalesce("__parts", F.lit(1))).cast("int")
    salted = big.join(hot, keys, "left").withColumn("__salt", salt).drop("__parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    repeated = small.join(hot, keys, "left").withColumn("__salt", copies).drop("__parts")
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")
