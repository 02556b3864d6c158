"""Connected components against a plain union of sets."""

import random

from pyspark.sql import functions as F

from tablewright.operators.clustering import connected_labels
from tablewright.operators.components import components


def plain(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def test_random_graph(spark):
    rng = random.Random(3)
    links = [(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(140)] + [(7, 7), (200, 200)]
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")
    found = {r["node"]: r["label"] for r in components(df).collect()}
    assert found == {k: v for k, v in plain([x for x in links if x[0] != x[1]]).items()}


def test_long_chain_needs_few_rounds(spark):
    keys = list(range(1000))
    random.Random(5).shuffle(keys)
    df = spark.createDataFrame(list(zip(keys, keys[1:])), "a long, b long")
    trace = []
    found = components(df, trace=trace).collect()
    assert len(found) == 1000 and {r["label"] for r in found} == {0}
    assert len(trace) < 25


def test_nothing_to_link_and_lonely_nodes(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert components(none).count() == 0
    labels = connected_labels(spark.range(3).withColumnRenamed("id", "node"), none).collect()
    assert sorted(tuple(r) for r in labels) == [(0, 0), (1, 1), (2, 2)]


def test_star_with_a_hot_centre(spark):
    df = spark.range(1, 5000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert components(df).filter("label <> 0").count() == 0
