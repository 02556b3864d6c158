"""Mutual information of continuous features with a class, from nearest neighbours.

For a row with value ``x`` in a class of ``c`` rows, let ``r`` be the distance to its ``k``-th nearest
neighbour in the class and ``m`` the number of rows of any class strictly nearer than ``r``, itself
included. The information is ``ψ(N) + mean(ψ(k) - ψ(c) - ψ(m))``, not less than 0. Equal values need no noise:
where ``r`` is 0, ``k`` and ``m`` count the rows with exactly this value in the class and in all.

Equal values of a class are one weighted cell. A cell's place in its class comes from range buckets, its
neighbours from windows over parts of the places with ``k`` cells of halo on both sides, and ``m`` from
running totals over values and bounds in one ordered stream. No task sorts a whole class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators import ranking
from tablewright.operators.columns import as_text, nan_to_null, no_rows, q
from tablewright.session import stored

NEIGHBOURS = 3
#: cells of a class in one window
PART = 65_536
#: rows to a range bucket, where there are many
BUCKET_ROWS = 500_000
_SHIFT = 6


def digamma(n: Column) -> Column:
    """ψ of a whole number from 1 on, to about 1e-11: six steps of the recurrence, then the asymptotic series."""
    n = n.cast("double")
    z = n + _SHIFT
    s = 1 / (z * z)
    out = F.log(z) - 1 / (2 * z) - s * (F.lit(1 / 12) - s * (F.lit(1 / 120) - s * (F.lit(1 / 252) - s * F.lit(1 / 240))))
    for j in range(_SHIFT):
        out = out - 1 / (n + j)
    return out


def _cells(df: DataFrame, columns: Sequence[str], y: Column, buckets: int) -> DataFrame:
    """``(column, y, b, x, n)``: how many rows of a class have a value, and the value's range bucket."""
    finite = [F.when(F.abs(q(c).cast("double")) < float("inf"), q(c).cast("double") + F.lit(0.0)) for c in columns]
    wide = df.select(y.alias("y"), *[x.alias(f"x{i}") for i, x in enumerate(finite)]).filter("y IS NOT NULL")
    probs = [i / buckets for i in range(1, buckets)]
    found = wide.agg(*[F.percentile_approx(f"x{i}", probs, 10 * buckets).alias(f"b{i}") for i in range(len(columns))]).first()
    splits = [[float("-inf"), *(sorted(set(found[f"b{i}"] or [])) or [0.0]), float("inf")] for i in range(len(columns))]
    names = [f"x{i}" for i in range(len(columns))]
    cut = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"b{i}" for i in range(len(columns))], handleInvalid="keep")
    records = [F.struct(F.lit(c).alias("column"), F.col(f"b{i}").cast("int").alias("b"), F.col(f"x{i}").alias("x")) for i, c in enumerate(columns)]
    long = cut.transform(wide).select("y", F.inline(F.array(*records))).filter("x IS NOT NULL")
    return long.groupBy("column", "y", "b", "x").agg(F.count(F.lit(1)).alias("n"))


def _neighbourhoods(cells: DataFrame, k: int) -> DataFrame:
    """Cells of classes of two rows or more with ``c`` (the class's rows), ``k`` (neighbours) and ``r`` (their reach)."""
    by = ["column", "y"]
    within = W.partitionBy(*by, "b").orderBy("x")
    placed = ranking.with_offsets(cells, by, "b", {"r": F.count(F.lit(1)), "n": F.sum("n")}).select(
        *by, "x", "n", F.col("n__all").alias("c"), (F.col("r__all") - 1).alias("last"),
        (F.col("r__before") + F.row_number().over(within) - 1).alias("i"),
    ).filter("c > 1")
    size = max(PART, k)
    own = F.floor(F.col("i") / size)
    lent = F.array_distinct(F.array(
        own, F.floor(F.greatest(F.col("i") - k, F.lit(0)) / size), F.floor(F.least(F.col("i") + k, F.col("last")) / size)
    ))
    parts = placed.withColumn("part", F.explode(lent))
    at = W.partitionBy(*by, "part").orderBy("i")
    reach = [F.array_repeat(F.lit(0.0), F.least(F.col("n") - 1, F.lit(k)).cast("int"))]
    sides = {}
    for j in range(1, k + 1):
        for side, move in (("a", F.lag), ("z", F.lead)):
            sides |= {f"{side}x{j}": move("x", j).over(at), f"{side}n{j}": move("n", j).over(at)}
            away = F.abs(F.col("x") - F.col(f"{side}x{j}"))
            many = F.coalesce(F.least(F.col(f"{side}n{j}"), F.lit(k)), F.lit(0)).cast("int")
            reach.append(F.array_repeat(away, many))
    near = parts.withColumns(sides).filter(F.col("part") == own)
    wanted = F.least(F.lit(k), F.col("c") - 1).cast("int")
    r = F.element_at(F.array_sort(F.concat(*reach)), wanted)
    near = near.withColumn("r", r)
    return near.select(*by, "x", "n", "c", F.when(F.col("r") > 0, wanted).otherwise(F.col("n")).alias("k"), "r")


def mutual_information(
    df: DataFrame, columns: Sequence[str], target: str, k: int = NEIGHBOURS, classes: Column | None = None
) -> DataFrame:
    """``(column, score)`` in nats between each numeric feature and the class in ``target``.

    ``classes`` replaces the class, say by a numeric target's bins. Rows without a target and, per
    feature, rows without a finite value and rows alone in their class take no part; a feature without
    rows scores 0. A copy of every row changes the scores: equal values are neighbours at distance 0.
    """
    if not columns:
        return no_rows(df, "column string, score double")
    df = nan_to_null(df).na.drop(subset=[target])
    y = as_text(target) if classes is None else classes.cast("string")
    buckets = max(16, min(4096, df.count() // BUCKET_ROWS))
    cells = stored(_cells(df, columns, y, buckets))
    near = _neighbourhoods(cells, k)
    near = stored(near.withColumns({"lo": F.col("x") - F.col("r"), "hi": F.col("x") + F.col("r")}))
    points = near.select("column", F.col("x").alias("v"), "n")
    bounds = near.filter("r > 0").select("column", F.explode(F.array("lo", "hi")).alias("v"), F.lit(0).cast("bigint").alias("n"))
    values = points.unionByName(bounds).groupBy("column", "v").agg(F.sum("n").alias("n"))
    totals = stored(ranking.running_totals(stored(values), "v", ["n"], ["column"], max(256, buckets)))
    low = totals.select("column", F.col("v").alias("lo"), F.col("n").alias("at_lo"), F.col("n_before").alias("under_lo"))
    high = totals.select("column", F.col("v").alias("hi"), F.col("n_before").alias("under_hi"))
    met = near.join(low, ["column", "lo"]).join(high, ["column", "hi"])
    m = F.when(F.col("r") > 0, F.col("under_hi") - F.col("under_lo") - F.col("at_lo")).otherwise(F.col("at_lo"))
    part = F.col("n") * (digamma(F.col("k")) - digamma(F.col("c")) - digamma(m))
    sums = met.groupBy("column").agg(F.sum("n").alias("rows"), F.sum(part).alias("s"))
    score = F.greatest(F.lit(0.0), digamma(F.col("rows")) + F.col("s") / F.col("rows"))
    asked = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return asked.join(sums.select("column", score.alias("score")), "column", "left").select(
        "column", F.coalesce("score", F.lit(0.0)).alias("score")
    )
