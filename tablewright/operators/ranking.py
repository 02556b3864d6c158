"""Exact ranks and running totals that never put a whole group into one task.

A window without ``partitionBy``, or partitioned by a label that holds a third of all
rows, sorts that whole group in a single task. Here rows first get a bucket that is
monotone in the order; small per-bucket totals give each bucket its offset; and only the
rows inside one bucket are sorted together. The results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.session import cut

HASH_SPACE = 2147483647


def seeded_hash(key: Column, seed: int = 42) -> Column:
    """Arithmetic hash of an integer key into ``[0, HASH_SPACE)``, the same in any SQL engine.

    The key is reduced before the multiplication, so it cannot overflow.
    """
    reduced = F.pmod(key.cast("bigint"), F.lit(HASH_SPACE))
    return F.pmod(reduced * F.lit(1103515245) + F.lit(12345 + seed), F.lit(HASH_SPACE))


def row_hash(*columns: str, seed: int = 42) -> Column:
    """Well-mixed hash of any columns into ``[0, HASH_SPACE)``."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), F.lit(HASH_SPACE))


def hash_bucket(hashed: Column, buckets: int) -> Column:
    """Equal-width bucket of a hash; monotone in the hash."""
    return F.floor(hashed * F.lit(buckets) / F.lit(HASH_SPACE)).cast("int")


def range_bounds(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Inner bucket bounds at about equal row counts (a sketch, so one scan, no shuffle)."""
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(
        F.percentile_approx(F.col(column).cast("double"), probs, 10 * buckets).alias("b")
    ).first()
    return sorted(set(row["b"] or []))


def with_range_bucket(df: DataFrame, column: str, bounds: Sequence[float], name: str) -> DataFrame:
    """Bucket of ``column`` among ``bounds`` (none for an empty table); equal values always share a bucket."""
    splits = [float("-inf"), *([b for b in bounds if abs(b) != float("inf")] or [0.0]), float("inf")]
    value = f"{name}__v"
    cut = Bucketizer(splits=splits, inputCol=value, outputCol=name)
    return cut.transform(df.withColumn(value, F.col(column).cast("double"))).drop(value)


def offsets(
    df: DataFrame, by: Sequence[str], bucket: str, totals: dict[str, Column]
) -> DataFrame:
    """Per ``(by, bucket)``: the sum of each total over all lower buckets, and overall."""
    per_bucket = df.groupBy(*by, bucket).agg(*[c.alias(f"{k}__n") for k, c in totals.items()])
    before = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    return per_bucket.select(
        *by,
        bucket,
        *[F.coalesce(F.sum(f"{k}__n").over(before), F.lit(0)).alias(f"{k}__before") for k in totals],
        *[F.sum(f"{k}__n").over(whole).alias(f"{k}__all") for k in totals],
    )


def with_offsets(df: DataFrame, by: Sequence[str], bucket: str, totals: dict[str, Column]) -> DataFrame:
    """``df`` with its ``offsets``, dealt out by ``(by, bucket)``.

    The join must shuffle the rows: were a small file sent to the offsets instead, they would stay
    where the groups' totals are, and a window over a bucket would run in one task per group. The
    offsets are written first, so the plan of ``df`` isn't doubled by every step on top of another.
    """
    return df.join(cut(offsets(df, by, bucket, totals)).hint("shuffle_hash"), [*by, bucket])


def rank_rows(
    df: DataFrame,
    order_by: Sequence[Column | str],
    bucket: Column,
    by: Sequence[str] = (),
    rank: str = "rank",
    total: str = "total",
) -> DataFrame:
    """``row_number()`` over ``by`` in ``order_by`` order, plus the size of each group.

    ``bucket`` must be monotone in ``order_by``. The join with the offsets and the window
    use the same keys, so the rows are shuffled once.
    """
    b = "__bucket"
    keyed = df.withColumn(b, bucket)
    grouped = [*by] if by else ["__all"]
    if not by:
        keyed = keyed.withColumn("__all", F.lit(1))
    within = W.partitionBy(*grouped, b).orderBy(*order_by)
    ranked = with_offsets(keyed, grouped, b, {"r": F.count(F.lit(1))})
    return ranked.select(
        *[F.col(c) for c in df.columns],
        (F.col("r__before") + F.row_number().over(within)).cast("bigint").alias(rank),
        F.col("r__all").cast("bigint").alias(total),
    )


def running_totals(
    df: DataFrame,
    order_by: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    buckets: int = 256,
) -> DataFrame:
    """Add ``{c}_before`` (total of ``c`` over smaller ``order_by``) and ``{c}_all``.

    ``order_by`` must be numeric and unique within ``by``: aggregate to distinct values first.
    """
    b = "__bucket"
    grouped = [*by] if by else ["__all"]
    keyed = df if by else df.withColumn("__all", F.lit(1))
    keyed = with_range_bucket(keyed, order_by, range_bounds(df, order_by, buckets), b)
    within = (
        W.partitionBy(*grouped, b).orderBy(order_by).rowsBetween(W.unboundedPreceding, -1)
    )
    joined = with_offsets(keyed, grouped, b, {c: F.sum(c) for c in sums})
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            (F.col(f"{c}__before") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"{c}_before")
            for c in sums
        ],
        *[F.col(f"{c}__all").alias(f"{c}_all") for c in sums],
    )
