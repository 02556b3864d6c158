"""Joins by time that Spark has no operator for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    prefix: str = "asof_",
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Every left row with the latest right row of the same key at or before its time.

    A left row whose key or time is null has no match, like one that nothing precedes.

    Rows meet in ``(key, time bucket)`` groups, so a key that holds a third of all rows is
    spread over its buckets. The last right row of each bucket is computed with partial
    aggregation and carried forward over the (few) bucket rows of its key.
    """
    keys, values = list(keys), list(values)
    complete = F.lit(True)
    for c in [*keys, ts]:
        complete = complete & F.col(c).isNotNull()
    alone, left, right = left.filter(~complete), left.filter(complete), right.filter(complete)
    slot = F.floor(micros(F.col(ts)) / F.lit(bucket_seconds * 1_000_000)).alias("__b")
    found = F.struct(F.col(ts).alias("ts"), *[F.col(v).alias(v) for v in values])
    marks = right.select(*keys, slot, F.col(ts).alias("__ts"), found.alias("__found"))
    rows = left.select(*keys, slot, F.col(ts).alias("__ts"), F.struct(*left.columns).alias("__left"))

    last = marks.groupBy(*keys, "__b").agg(F.max("__found").alias("__last"))
    slots = rows.select(*keys, "__b").distinct().join(last, [*keys, "__b"], "full")
    earlier = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carried = slots.select(*keys, "__b", F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))

    both = marks.withColumn("__side", F.lit(0)).unionByName(
        rows.withColumn("__side", F.lit(1)), allowMissingColumns=True
    )
    upto = (
        W.partitionBy(*keys, "__b").orderBy("__ts", "__side").rowsBetween(W.unboundedPreceding, 0)
    )
    joined = both.join(carried, [*keys, "__b"]).withColumn(
        "__hit", F.coalesce(F.last("__found", ignorenulls=True).over(upto), "__carried")
    )
    hit = F.col("__hit")
    out = joined.filter("__side = 1").select(
        "__left.*", hit["ts"].alias(f"{prefix}{ts}"), *[hit[v].alias(f"{prefix}{v}") for v in values]
    )
    added = out.columns[len(alone.columns) :]
    return out.unionByName(alone.select("*", *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in added]))
