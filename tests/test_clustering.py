"""Density clusters, silhouette, neighbours and projections against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import clustering, retrieval


def brute_dbscan(x, eps, least):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    near = d <= eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    changed = True
    while changed:
        changed = False
        for i in np.flatnonzero(core):
            m = label[np.flatnonzero(near[i] & core)].min()
            if m < label[i]:
                label[i], changed = m, True
    for i in np.flatnonzero(~core):
        around = np.flatnonzero(near[i] & core)
        label[i] = label[around].min() if len(around) else -1
    return core, label


def cloud(kind, n=240):
    rng = np.random.default_rng(3)
    if kind == "blobs":
        x = np.concatenate([rng.normal(c, 0.15, (n // 3, 2)) for c in ((0, 0), (2, 0), (1, 2))])
    elif kind == "copies":
        x = np.concatenate([np.zeros((n // 3, 2)), rng.uniform(-2, 2, (2 * n // 3, 2))])
    elif kind == "two dense lines":
        t = rng.uniform(0, 1, n // 2)
        x = np.concatenate([np.c_[t, 0 * t], np.c_[t, 0 * t + 0.2501]])
    else:
        x = rng.uniform(-1, 1, (n, 3))
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("kind,eps", [("blobs", 0.2), ("copies", 0.25), ("two dense lines", 0.25), ("cube", 0.3)])
def test_dbscan_equals_brute_force(spark, kind, eps):
    x = cloud(kind)
    dims = [f"d{i}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=dims)
    pdf.insert(0, "id", np.arange(len(x)))
    got = clustering.dbscan(spark.createDataFrame(pdf), "id", dims, eps).toPandas().sort_values("id")
    core, label = brute_dbscan(x, eps, 5)
    assert (got["core"].to_numpy() == core).all()
    assert (got["cluster"].to_numpy() == label).all()


def test_auto_eps_is_the_neighbour_percentile(spark):
    x = cloud("blobs", 150) * 6
    pdf = pd.DataFrame(x, columns=["a", "b"])
    pdf.insert(0, "id", np.arange(len(x)))
    got = clustering.auto_eps(spark.createDataFrame(pdf), "id", ["a", "b"], tolerance=0.02)
    d = np.sort(np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)), axis=1)[:, 4]
    want = max(np.quantile(d, 0.9, method="inverted_cdf"), 0.3)
    assert want <= got <= want * 1.03


def test_silhouette_equals_pairs(spark):
    x = cloud("blobs")
    label = (x[:, 0] > 1).astype(int) + 2 * (x[:, 1] > 1)
    label[0] = 9
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "v": x.tolist(), "c": label}))
    got = clustering.silhouette_rows(df, "v", "c").toPandas().sort_values("id")["silhouette"].to_numpy()
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            assert got[i] == 0
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == o].mean() for o in set(label) - {label[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b))


@pytest.mark.parametrize("batch", [1000, 7])
def test_nearest_equals_brute_force_with_copies(spark, batch):
    rng = np.random.default_rng(5)
    base = np.concatenate([np.tile(rng.normal(size=4), (60, 1)), rng.normal(size=(120, 4))])
    asked = np.concatenate([base[:1], rng.normal(size=(20, 4))])
    b = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(180), "embedding": base.tolist()})).repartition(5)
    q = spark.createDataFrame(pd.DataFrame({"query_id": np.arange(21), "embedding": asked.tolist()}))
    got = retrieval.nearest(b, q, 4, batch=batch).toPandas().sort_values(["query_id", "rank"])
    for j, g in got.groupby("query_id"):
        d = ((base - asked[j]) ** 2).sum(1)
        assert g["item_id"].tolist() == np.lexsort((np.arange(180), d))[:4].tolist()
        assert np.allclose(g["distance"], np.sort(d)[:4])


def test_sweeps_label_every_row(spark):
    x = cloud("blobs")
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    vectors = clustering.feature_vectors(df, ["a", "b"]).cache()
    out, k, score, scores = clustering.kmeans_auto(vectors, max_k=4)
    assert k == 3 and score == max(s for _, s in scores) and out.count() == len(x)
    _, k, bic, scores = clustering.gmm_auto(vectors, max_k=3)
    assert bic == min(s for _, s in scores)


def test_mixtures_use_all_cores(spark):
    """Rows in one partition are dealt out before the mixtures are fitted; every number of components is tried."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, (10_000, 2)) for c in (0.0, 5.0)])
    df = clustering.feature_vectors(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])).coalesce(1), ["a", "b"])
    dealt = clustering.spread(df, clustering.FIT_ROWS)
    assert dealt.rdd.getNumPartitions() == min(4, spark.sparkContext.defaultParallelism)
    assert clustering.spread(df.limit(10), clustering.FIT_ROWS).rdd.getNumPartitions() == 1
    out, k, _, scores = clustering.gmm_auto(df, max_k=3)
    assert out.count() == 20_000 and [s[0] for s in scores] == [2, 3] and k == min(scores, key=lambda s: s[1])[0]


def test_facade(spark):
    x = cloud("blobs")
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    out, found = clustering.run_clustering(df, "id", "kmeans", max_k=4)
    assert found["best_k"] == 3 and out.columns == ["id", "a", "b", "cluster"]
    out, found = clustering.run_clustering(df, "id", "dbscan")
    assert found["eps"] == 0.3 and out.filter("cluster >= 0").count() > 200
    with pytest.raises(ValueError):
        clustering.run_clustering(df, "id", "spectral")


def test_pca_axes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * [3, 1, 0.1]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    p = clustering.pca2(df, list("abc")).select("pc1", "pc2").toPandas().to_numpy()
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    assert np.allclose(p.var(axis=0, ddof=1), want) and abs(np.corrcoef(p.T)[0, 1]) < 1e-9
    assert np.allclose(p.mean(axis=0), 0)


def test_index_without_documents(spark):
    q = spark.createDataFrame([(1, "a b")], "id long, text string")
    assert retrieval.DocumentIndex().query(q, "id").first()["context"] == "No document indexed."


def test_chunks(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(1000)))), (2, ""), (3, "a b")], "id long, text string")
    got = retrieval.chunk_documents(docs, "id").withColumn("n", F.size(F.split("text", " "))).orderBy("id", "chunk_id").collect()
    assert [(r["id"], r["chunk_id"], r["n"]) for r in got] == [(1, 0, 400), (1, 1, 400), (1, 2, 360), (1, 3, 40), (3, 0, 2)]


def test_density_clusters_of_many_columns_and_of_few_rows(spark):
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(c, 0.05, size=(60, 5)) for c in (0.0, 3.0)])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "key long, a double, b double, c double, d double, e double")
    out, facts = clustering.run_clustering(df, "key", "dbscan")
    label = {r["key"]: r["cluster"] for r in out.collect()}
    assert len(label) == 120 and facts["eps"] > 0
    left, right = ({label[i] for i in part} - {-1} for part in (range(60), range(60, 120)))
    assert left and right and not left & right
    few, _ = clustering.run_clustering(df.limit(4), "key", "dbscan")
    assert {r["cluster"] for r in few.collect()} == {-1}


def labelled(spark, x, eps, least=5):
    dims = [f"d{i}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=dims)
    pdf.insert(0, "id", np.arange(len(x)))
    got = clustering.dbscan(spark.createDataFrame(pdf), "id", dims, eps, least).toPandas().sort_values("id")
    return got["core"].to_numpy(), got["cluster"].to_numpy()


def wide_cloud(kind):
    rng = np.random.default_rng(8)
    if kind == "blobs":
        x = np.concatenate([rng.normal(c, 0.2, (80, 5)) for c in (0.0, 1.0, 3.0)] + [rng.uniform(-2, 5, (40, 5))])
    elif kind == "copies":
        x = np.concatenate([np.zeros((90, 4)), np.full((60, 4), 0.2), rng.uniform(-1, 1, (90, 4))])
    elif kind == "tight":  # hundreds of points inside one radius, next to others at just that distance
        ball = rng.normal(size=(200, 6))
        ball = 0.2 * ball / np.linalg.norm(ball, axis=1, keepdims=True) * rng.uniform(0, 1, (200, 1))
        x = np.concatenate([ball, ball[:50] + np.array([1.2, 0, 0, 0, 0, 0]), ball[:50] + np.array([0, 0.9, 0, 0, 0, 0])])
    else:
        t = rng.uniform(0, 40, 300)  # a long thin cluster through many cells
        x = np.stack([np.cos(t), np.sin(t), t / 9, t / 7, 0 * t], axis=1)
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("kind,eps,cell,fan", [
    ("blobs", 0.45, 1024, 16), ("blobs", 0.45, 12, 3), ("copies", 0.4, 12, 3), ("tight", 1.0, 12, 3), ("chain", 0.5, 12, 3)
])
def test_wide_dbscan_equals_brute_force(spark, monkeypatch, kind, eps, cell, fan):
    monkeypatch.setattr(clustering.density, "CELL", cell)
    monkeypatch.setattr(clustering.density, "FAN", fan)
    x = wide_cloud(kind)
    core, label = labelled(spark, x, eps)
    want_core, want = brute_dbscan(x, eps, 5)
    assert (core == want_core).all() and (label == want).all()
    assert len(set(label)) > 1 or kind in ("chain", "tight")


def test_wide_points_without_rows_and_alone(spark):
    df = spark.createDataFrame([(7, 1.0, 2.0, 3.0, 4.0)], "id int, a double, b double, c double, d double")
    one = clustering.dbscan(df, "id", list("abcd"), 0.5)
    assert [tuple(r) for r in one.collect()] == [(7, False, -1)] and one.schema["id"].dataType.simpleString() == "int"
    assert clustering.dbscan(df.limit(0), "id", list("abcd"), 0.5).count() == 0


def test_few_pairs_of_leaves_meet(spark, monkeypatch):
    """Far clusters never meet: pairs of leaves stay in proportion to the leaves."""
    monkeypatch.setattr(clustering.density, "CELL", 20)
    monkeypatch.setattr(clustering.density, "FAN", 4)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(10.0 * c, 0.3, (60, 5)) for c in range(16)])
    pdf = pd.DataFrame(x, columns=list("abcde"))
    pdf.insert(0, "id", np.arange(len(x)))
    tree = clustering.density.Tree(spark.createDataFrame(pdf), "id", list("abcde"))
    near = clustering.density.Neighbours(tree, 0.2, 5)
    leaves = tree.points.select("cell").distinct().count()
    assert leaves > 48 and near.pairs.count() < 8 * leaves


def test_leaves_within_reach_need_not_meet(spark, monkeypatch):
    """In a dense cloud every leaf is within reach of others, but no vectors need be sent."""
    density, met = clustering.density, []
    monkeypatch.setattr(density, "CELL", 300)
    monkeypatch.setattr(density, "FAN", 4)
    meet = density._meet

    def counted(pairs, *rest):
        met.append(pairs.count())
        return meet(pairs, *rest)

    monkeypatch.setattr(density, "_meet", counted)
    x = np.random.default_rng(3).uniform(0, 1, (1000, 4))
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf.insert(0, "id", np.arange(len(x)))
    tree = density.Tree(spark.createDataFrame(pdf), "id", list("abcd"))
    near = density.Neighbours(tree, 0.6, 5)
    assert near.pairs.filter("a <> b").count() > 10 and near.flagged().filter("core").count() == 1000
    assert sum(met) == 0


def test_distances_equal_to_the_radius_link_dense_cells(spark):
    """The only pair within the radius is exactly as far, among points closer than any sub-cell."""
    step = 2.0**-40
    left, right = [-i * step for i in range(8)], [0.25 + i * step for i in range(8)]
    core, label = labelled(spark, np.array([left + right]).T, 0.25)
    assert core.all() and set(label) == {0}
    core, label = labelled(spark, np.array([left + [r + step for r in right]]).T, 0.25)
    assert core.all() and set(label) == {0, 8}


def brute_ward(x):
    """Partitions of points by merging the pair that adds least to the squared error, for every number of clusters."""
    groups = [[i] for i in range(len(x))]
    found = {len(groups): sorted(map(tuple, groups))}
    while len(groups) > 1:
        def grown(a, b):
            gap = x[a].mean(axis=0) - x[b].mean(axis=0)
            return len(a) * len(b) / (len(a) + len(b)) * (gap @ gap)

        _, i, j = min((grown(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] = sorted(groups[i] + groups.pop(j))
        found[len(groups)] = sorted(map(tuple, groups))
    return found


def vectors_of(spark, x, parts=3):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(parts)


def partition_of(out):
    groups = {}
    for r in out.collect():
        groups.setdefault(r["cluster"], []).append(r["id"])
    return sorted(tuple(sorted(g)) for g in groups.values())


def test_hierarchy_equals_ward_on_distinct_points(spark):
    x = np.random.default_rng(4).normal(size=(45, 3))
    x = np.concatenate([x, x[:5]])  # copies are merged first, at height 0
    want = brute_ward(x)
    rows, tree = clustering.hierarchy.build(vectors_of(spark, x), "features")
    for k in (1, 2, 3, 7, 20, 45):
        assert partition_of(clustering.hierarchy.cut(rows, tree, k)) == want[k]
    merges = tree.table(spark).orderBy("step").collect()
    assert len(merges) == 44 and merges[-1]["rows"] == 50
    assert all(a["height"] <= b["height"] + 1e-12 for a, b in zip(merges, merges[1:]))
    total = ((x - x.mean(axis=0)) ** 2).sum()
    assert abs(sum(m["height"] for m in merges) - total) < 1e-9


def test_hierarchy_of_more_points_than_features(spark, monkeypatch):
    monkeypatch.setattr(clustering.hierarchy, "FEATURES", 40)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.2, (150, 2)) for c in ((0, 0), (4, 0), (0, 5), (6, 6))])
    out, k, score, scores = clustering.hierarchical_auto(vectors_of(spark, x), max_k=6)
    assert k == 4 and score > 0.9 and [n for n, _ in scores] == [2, 3, 4, 5, 6]
    assert partition_of(out) == [tuple(range(i * 150, (i + 1) * 150)) for i in range(4)]
    again, *_ = clustering.hierarchical_auto(vectors_of(spark, x, 7), max_k=6)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_hierarchy_without_rows_and_with_one(spark):
    rows, tree = clustering.hierarchy.build(vectors_of(spark, np.zeros((1, 2))).limit(0), "features")
    assert tree is None and clustering.hierarchy.cut(rows, tree, 2).count() == 0
    rows, tree = clustering.hierarchy.build(vectors_of(spark, np.ones((9, 2))), "features")
    assert tree.merges == [] and {r["cluster"] for r in clustering.hierarchy.cut(rows, tree, 2).collect()} == {0}


def test_density_clusters_read_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(x):
        seen.add(1)
        return x

    rows = spark.range(300).select("id", noted(F.sin("id") * 4).alias("a"), (F.cos("id") * 4).alias("b"))
    assert clustering.dbscan(rows, "id", ["a", "b"]).filter("core").count() >= 270
    assert seen.value == 300


def test_embedder_reads_its_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(x):
        seen.add(1)
        return x

    rows = spark.range(60).select("id", noted(F.concat(F.lit("Word "), F.col("id") % 7, F.lit("  end"))).alias("text"))
    model, vectors = retrieval.fit_embedder(rows, ["id"], dim=64)
    got = {r["id"]: r["embedding"] for r in vectors.collect()}
    assert seen.value == 60 and len(got) == 60
    assert got == {r["id"]: r["embedding"] for r in retrieval.embed(model, rows).collect()}
