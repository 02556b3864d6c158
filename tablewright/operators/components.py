"""Connected components of a graph given by its links, without a limit on their number or length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import stored


def _with_smallest(pairs: DataFrame) -> DataFrame:
    """Add ``m``, the smallest of ``v`` (and ``u``) over the rows of each ``u``.

    The minima are written out first: the join then shuffles both of its sides itself, so a
    node with very many neighbours is split over several tasks at run time.
    """
    least = stored(pairs.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m")))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to the smallest of its neighbourhood."""
    both = edges.select(F.inline(F.array(
        F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )))
    linked = _with_smallest(both).filter("v > u")
    return linked.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them."""
    linked = _with_smallest(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    pair = F.array(F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return linked.select(F.inline(pair)).filter("hi <> lo").distinct()


def _signature(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum."""
    mixed = F.xxhash64("hi", "lo")
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mixed).alias("x"), F.sum(F.pmod(mixed, F.lit(1 << 30))).alias("s")).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b", trace: list | None = None) -> DataFrame:
    """``(node, label)`` of every node with a link to another one; ``label`` is the smallest
    node of its component.

    Alternating large and small stars: each round rewrites the edges so that they point to
    smaller nodes, until every component is one star. The number of rounds grows with the
    logarithm of a component's size, and each is written to the shared folder. Links of a
    node to itself and rows with a null end say nothing and are passed over; no links give
    an empty result. ``trace``, if given, receives the number of edges after each round.
    """
    ends = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), F.col(a).alias("x"), F.col(b).alias("y"))
    edges = stored(ends.filter("x <> y").select("hi", "lo").distinct())
    before = _signature(edges)
    while before[0]:
        edges = stored(_small_star(stored(_large_star(edges))))
        now = _signature(edges)
        if trace is not None:
            trace.append(now[0])
        if now == before:
            break
        before = now
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    centres = edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return stars.unionByName(centres)
