"""The skew-proof helpers equal their plain counterparts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators import prepare, quantiles, ranking, sampling, skew
from tablewright.session import stored


def skewed(spark, n=3000):
    """A third of the rows share one key and one value."""
    rng = np.random.default_rng(1)
    key = np.where(np.arange(n) % 3 == 0, 7, rng.integers(0, 50, n))
    value = np.where(np.arange(n) % 3 == 0, 1.5, rng.normal(size=n))
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "key": key, "value": value}))


@pytest.mark.parametrize("one_pass,bracket", [(10**6, 10**6), (0, 50), (0, 1)])
def test_quantiles_equal_numpy(spark, one_pass, bracket):
    df = skewed(spark).withColumn("hole", F.when(F.col("id") % 2 == 0, F.col("value")))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, ["value", "hole"], probs, one_pass, bracket, accuracy=100)
    pdf = df.toPandas()
    assert np.allclose(got["value"], np.quantile(pdf["value"], probs))
    assert np.allclose(got["hole"], np.quantile(pdf["hole"].dropna(), probs))


def test_quantiles_between_two_heavy_values(spark, monkeypatch):
    """No sketch parts two values of half the rows each; narrowing ends, and the median lies between them."""
    rounds, narrow = [], quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: rounds.append(1) or narrow(*a))
    df = spark.range(4000).select(
        (F.col("id") % 2).alias("half"), F.when(F.col("id") % 100 < 49, 0.0).when(F.col("id") % 100 > 50, 1.0).otherwise(F.rand(3)).alias("rest")
    )
    got = quantiles.exact_quantiles(df, ["half", "rest"], [0.25, 0.5, 0.75], 0, 200, accuracy=100)
    rest = np.quantile(df.toPandas()["rest"], [0.25, 0.5, 0.75])
    assert got["half"] == [0.0, 0.5, 1.0] and np.allclose(got["rest"], rest) and len(rounds) <= 2


def held(df, column):
    """Rows of the fullest partition with a value in ``column``."""
    return df.groupBy(F.spark_partition_id()).agg(F.count(column).alias("n")).agg(F.max("n")).first()[0]


def test_codes_and_totals_stay_spread(spark):
    """Codes of two levels leave the rows where they are; totals of a small file are dealt out by range."""
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in off}
    df = spark.range(0, 40_000, 1, 8).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("v"))
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        assert held(prepare.label_codes(df, "v"), "code") == 5_000
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        totals = ranking.running_totals(stored(df.select(F.lit("x").alias("column"), "id")), "id", ["id"], ["column"])
        assert held(totals, "id_before") < 15_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_rank_rows_equals_window(spark):
    df = skewed(spark)
    h = ranking.seeded_hash(F.col("id"))
    got = ranking.rank_rows(df.withColumn("h", h), ["h", "id"], ranking.hash_bucket(F.col("h"), 16), ["key"])
    want = df.withColumn("want", F.row_number().over(W.partitionBy("key").orderBy(h, "id")))
    assert got.join(want, "id").filter("rank <> want").count() == 0


def test_running_totals_equal_window(spark):
    df = skewed(spark).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    got = ranking.running_totals(df, "value", ["n"], buckets=9).toPandas().sort_values("value")
    assert (got["n_before"].to_numpy() == got["n"].cumsum().shift(fill_value=0).to_numpy()).all()
    assert (got["n_all"] == 3000).all()


def test_sample_is_exact_and_repeatable(spark):
    df = skewed(spark)
    h = ranking.seeded_hash(F.col("id"))
    for n in (0, 1, 777, 3000, 5000):
        got = sampling.sample_rows(df, n, h, ["id"], buckets=7)
        want = df.orderBy(h, "id").limit(n)
        assert {r["id"] for r in got.collect()} == {r["id"] for r in want.collect()}


def test_split_shares_per_label(spark):
    df = skewed(spark)
    got = sampling.split_rows(df, ranking.row_hash("id"), ["id"], "key", buckets=5)
    assert got.count() == 3000 and got.select("id").distinct().count() == 3000
    wide = got.groupBy("key").pivot("split", ["train", "val", "test"]).count().fillna(0).toPandas()
    n = wide[["train", "val", "test"]].sum(axis=1)
    assert (wide["train"] == n * 700 // 1000).all()
    assert (wide["train"] + wide["val"] == n * 850 // 1000).all()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_join(spark, how):
    big = skewed(spark)
    small = spark.createDataFrame([(k, c) for k in range(0, 50, 2) for c in "ab"] + [(7, "hot")], "key long, tag string")
    got = skew.spread_join(big, small, ["key"], how, hot_rows=100)
    want = big.join(small, ["key"], how)
    columns = ["id", "key", "value", "tag"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_long_label_lists_rank_in_ranges(spark, monkeypatch):
    from tablewright.operators import prepare

    df = spark.range(500).select(F.concat(F.lit("Customer#"), F.col("id") % 90).alias("name"))
    want = {r["name"]: r["code"] for r in prepare.label_codes(df, "name").collect()}
    monkeypatch.setattr(prepare, "ONE_TASK_LEVELS", 10)
    assert {r["name"]: r["code"] for r in prepare.label_codes(df, "name").collect()} == want
    assert want == {v: i for i, v in enumerate(sorted(want))}


def test_auc_with_ties_equals_pairs(spark):
    from tablewright.operators import metrics

    df = skewed(spark, 400).withColumn("s", F.round("value", 1)).withColumn("y", F.col("id") % 4 == 0)
    got = metrics.roc_auc(df, "s", F.col("y")).first()["roc_auc"]
    pdf = df.toPandas()
    pos, neg = pdf[pdf["y"]]["s"].to_numpy(), pdf[~pdf["y"]]["s"].to_numpy()
    d = pos[:, None] - neg[None, :]
    assert got == pytest.approx(((d > 0) + 0.5 * (d == 0)).mean())
