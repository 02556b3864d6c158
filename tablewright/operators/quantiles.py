"""Exact quantiles with linear interpolation, for any number of rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators.columns import q

# Up to this many rows ``percentile`` keeps its value counts in one reducer comfortably.
ONE_PASS_ROWS = 2_000_000
# A bracket of this many rows is ranked directly.
BRACKET_ROWS = 1_000_000


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    one_pass_rows: int = ONE_PASS_ROWS,
    bracket_rows: int = BRACKET_ROWS,
    accuracy: int = 10_000,
) -> dict[str, list[float | None]]:
    """``{column: [quantile per prob]}``, nulls ignored, as numpy's default method.

    Small input: one aggregate. Otherwise a sketch brackets each wanted rank, an exact
    count confirms the bracket, and only the rows inside it are ranked, so a column of
    distinct values is never gathered in one task.
    """
    columns, probs = list(columns), list(probs)
    if not columns:
        return {}
    doubles = df.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    if doubles.count() <= one_pass_rows:
        row = doubles.agg(
            *[F.percentile(F.col(f"c{i}"), probs).alias(f"c{i}") for i in range(len(columns))]
        ).first()
        return {c: list(row[f"c{i}"] or [None] * len(probs)) for i, c in enumerate(columns)}
    return _bracketed(doubles, columns, probs, bracket_rows, accuracy)


def _bracketed(doubles, columns, probs, bracket_rows, accuracy):
    """Brackets of the ranks, narrowed until few rows lie between their ends, then one ranking.

    Columns of few values are counted value by value at once. Rows at a bracket's ends don't matter: they
    are combined before they are shuffled, and no sketch can part two values of many rows each.
    """
    every = range(len(columns))
    sizes = doubles.agg(
        *[F.count(f"c{i}").alias(f"n{i}") for i in every],
        *[F.min(f"c{i}").alias(f"lo{i}") for i in every],
        *[F.max(f"c{i}").alias(f"hi{i}") for i in every],
        *[F.approx_count_distinct(f"c{i}").alias(f"d{i}") for i in every],
    ).first()
    few, room = set(), bracket_rows // 4
    for i in sorted(every, key=lambda i: sizes[f"d{i}"]):
        room -= sizes[f"d{i}"]
        if room >= 0:
            few.add(i)
    wanted = {}
    for i in every:
        n = sizes[f"n{i}"]
        for j, p in enumerate(probs):
            if n:
                h = (n - 1) * p
                wanted[(i, j)] = {
                    "first": math.floor(h), "last": math.ceil(h), "frac": h - math.floor(h),
                    "lo": sizes[f"lo{i}"], "hi": sizes[f"hi{i}"], "below": 0, "inside": n, "between": 0 if i in few else n,
                }
    margin = 2.0 / accuracy
    for _ in range(20):
        wide = {k: w for k, w in wanted.items() if w["between"] > bracket_rows and w["lo"] < w["hi"]}
        if not wide:
            break
        _narrow(doubles, wide, margin, accuracy)
    return _pick(doubles, columns, probs, wanted)


def _inside(bracket):
    i, lo, hi = bracket
    return (F.col(f"c{i}") >= F.lit(lo)) & (F.col(f"c{i}") <= F.lit(hi))


def _brackets(bounds):
    """Number of each different ``(column, lo, hi)``: several ranks of a column often share one."""
    return {b: n for n, b in enumerate(dict.fromkeys(bounds))}


def _narrow(doubles, wide, margin, accuracy):
    """One sketch job, then one counting job that accepts only brackets holding the ranks."""
    old = {k: (k[0], w["lo"], w["hi"]) for k, w in wide.items()}
    shares = {b: [] for b in _brackets(old.values())}
    place = {}
    for k, w in wide.items():
        low = max(0.0, (w["first"] - w["below"]) / w["inside"] - margin)
        high = min(1.0, (w["last"] - w["below"] + 1) / w["inside"] + margin)
        place[k] = len(shares[old[k]])
        shares[old[k]] += [low, high]
    sketches = [
        F.percentile_approx(F.when(_inside(b), F.col(f"c{b[0]}")), s, accuracy).alias(f"b{n}") for n, (b, s) in enumerate(shares.items())
    ]
    bounds = dict(zip(shares, doubles.agg(*sketches).first()))
    new = {k: (k[0], *bounds[old[k]][place[k] : place[k] + 2]) for k in wide}
    numbers = _brackets(new.values())
    counts = []
    for (i, lo, hi), n in numbers.items():
        c = F.col(f"c{i}")
        counts.append(F.count_if(c < lo).alias(f"below{n}"))
        counts.append(F.count_if((c >= lo) & (c <= hi)).alias(f"in{n}"))
        counts.append(F.count_if((c > lo) & (c < hi)).alias(f"between{n}"))
    row = doubles.agg(*counts).first()
    for k, w in wide.items():
        n = numbers[new[k]]
        below, inside = row[f"below{n}"], row[f"in{n}"]
        if below <= w["first"] and w["last"] < below + inside:
            _, w["lo"], w["hi"] = new[k]
            w["below"], w["inside"], w["between"] = below, inside, row[f"between{n}"]


def _pick(doubles, columns, probs, wanted):
    bracket = {k: (k[0], w["lo"], w["hi"]) for k, w in wanted.items()}
    numbers = _brackets(bracket.values())
    tags = F.array(
        *[F.when(_inside(b), F.struct(F.lit(n).alias("key"), F.col(f"c{b[0]}").alias("x"))) for b, n in numbers.items()]
    )
    hits = doubles.select(F.inline(F.filter(tags, lambda s: s.isNotNull())))
    counted = hits.groupBy("key", "x").count()
    upto = W.partitionBy("key").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    placed = counted.withColumn("upto", F.sum("count").over(upto))
    test = F.lit(False)
    for k, w in wanted.items():
        for r in (w["first"] - w["below"], w["last"] - w["below"]):
            covers = (F.col("upto") > r) & (F.col("upto") - F.col("count") <= r)
            test = test | ((F.col("key") == numbers[bracket[k]]) & covers)
    found: dict[int, list] = {}
    for r in placed.filter(test).select("key", "x", "upto", "count").collect():
        found.setdefault(r["key"], []).append((r["upto"] - r["count"], r["upto"], r["x"]))
    out = {}
    for i, c in enumerate(columns):
        values = []
        for j, _ in enumerate(probs):
            w = wanted.get((i, j))
            if w is None:
                values.append(None)
                continue
            pair = []
            for rank in (w["first"] - w["below"], w["last"] - w["below"]):
                pair.append(next(x for a, b, x in found[numbers[bracket[(i, j)]]] if a <= rank < b))
            values.append(pair[0] + (pair[1] - pair[0]) * w["frac"])
        out[c] = values
    return out
