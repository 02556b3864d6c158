"""Exact top-k, centroid clustering and the Merkle manifest on odd input and against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm import hadamard, merkle, norm_search, queries

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, kind=T.FloatType()):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(kind))])
    own = {n: F.lit("own") for n in ("rank", "score", "cluster", "distance", "whole", "far", "Band", "part", "block", "id", "h1", "key")}
    return spark.createDataFrame(rows, schema).withColumns(own)


# exact top-k

def top(rows, k=5):
    """Brute force with Python's integers over (id, integers)."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    found = []
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        best = {}
        for i, v in rows:
            for j, w in rows:
                if j == q and i != q and len(v) == len(w):
                    score = max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w))))
                    best[i] = max(best.get(i, score), score)
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        found += [(q, n + 1, i, s) for n, (i, s) in enumerate(ranked)]
    return sorted(found)


def searched(df, **more):
    return sorted(tuple(r) for r in norm_search.search(df, F.pmod(F.col("vec_id"), F.lit(50)) == 0, **more).collect())


def whole(rows, scale=256):
    return [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows]


def test_topk_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(i, [0.25, -0.5, 1.0, 0.0, 0.0, 0.125]) for i in range(200, 290)]  # ties
    rows += rows[:20]  # repeated
    rows += [(300, [0.0] * 6), (301, [0.0] * 6), (350, [1.0, 2.0]), (351, [3.0, -1.0]), (400, []), (401, []), (402, []), (0, [9.0] * 6), (450, [7.0] * 3)]
    rows += [(500, [-5.0] * 6), (-50, [2.0] * 6)]
    bad = [(50, None), (7, [NAN] * 6), (8, [INF] * 6), (9, [None] * 6), (None, [1.0] * 6)]
    found = searched(vectors(spark, rows + bad))
    assert found == top(whole(rows))
    assert searched(vectors(spark, rows + bad), k=1000) == top(whole(rows), 1000)
    assert searched(vectors(spark, [])) == [] == searched(vectors(spark, bad)) == searched(vectors(spark, rows[:1]))


def test_topk_beyond_long_and_double(spark):
    rows = [(0, [1e300, -3.0]), (1, [1e300, 1.0]), (2, [5e299, 1.0]), (50, [2.0**40, 1.0]), (51, [2.0**40 + 1, 1.0]), (52, [2.0**40, 2.0]), (100, [-1e300, 0.0])]
    most = float(np.finfo(np.float64).max) / 2
    exact = [(i, [int(np.floor(max(-most, min(most, 256 * x)))) for x in v]) for i, v in rows]
    assert searched(vectors(spark, rows, T.DoubleType())) == top(exact)


def test_topk_with_many_parts_and_blocks(spark, monkeypatch):
    for name, value in (("PART", 40), ("BLOCK", 2), ("FIRST", 8), ("BUCKET", 16)):
        monkeypatch.setattr(norm_search, name, value)
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(6, 16))
    rows = [(i, ((middle[i % 6] + 0.05 * rng.normal(size=16)) * 2.0 ** rng.integers(-3, 4)).tolist()) for i in range(400)]
    assert searched(vectors(spark, rows)) == top(whole(rows))


@pytest.mark.parametrize("short, long, coordinates", [(0.2, 3.0, False), (0.9999, 1.0001, True)])
def test_a_part_is_pruned_by_lengths_or_coordinates(short, long, coordinates):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(40, 32))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    near = middle[rng.integers(0, 40, 4000)] + 0.01 * rng.normal(size=(4000, 32))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    base = np.floor(2**16 * near * rng.uniform(short, long, size=(4000, 1)))
    points, names = base[:30], np.arange(4000)
    switches, choose = [], norm_search.Bucket.choose
    norm_search.Bucket.choose = lambda self, *a: (choose(self, *a), switches.append(self.switch))[0]
    try:
        found, touched = norm_search.search_part(names, base, names[:30], points, np.full(30, -np.inf), 5)
    finally:
        norm_search.Bucket.choose = choose
    true = []
    for q in range(30):
        score = base @ base[q]
        score[q] = -np.inf
        true += [(q, int(i), int(score[i])) for i in np.lexsort((names, -score))[:5]]
    assert sorted(found) == sorted(true)
    assert touched < 0.6 * 30 * 4000 and (min(switches) <= 1) == coordinates


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=3, max_size=3), st.lists(st.floats(-1, 1), min_size=3, max_size=3))
def test_coordinates_lie_in_range(a, b):
    a, b = np.array(a), np.array(b)
    if np.linalg.norm(a) < 1e-3 or np.linalg.norm(b) < 1e-3:
        return
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    low, high = norm_search.coordinate_range(a, np.full(3, a @ b))
    assert np.all((b >= low - 1e-7) & (b <= high + 1e-7))


def test_no_base_vector_moves_to_blocks_it_cannot_serve(spark):
    # queries whose neighbours are long never meet the short vectors
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * (100.0 if i % 4 == 0 else 0.01)).tolist()) for i in range(800)]
    df = norm_search.search(vectors(spark, rows), F.pmod(F.col("vec_id"), F.lit(100)) == 0)
    assert sorted({r["query_id"] for r in df.collect()}) == list(range(0, 800, 100))
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# centroids

def lloyd(rows, clusters=8, rounds=10):
    """Brute force over (id, integers)."""
    def mark(row):
        return (row[0] is None, hashlib.sha256(f"3:{row[0]}".encode()).hexdigest(), row[1])

    centres = [list(v) for _, v in sorted(rows, key=mark)[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(centres)) for _, v in rows]

    for _ in range(rounds):
        owner = [c for _, c in assign()]
        for c in range(len(centres)):
            own = [v for (_, v), o in zip(rows, owner) if o == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    return assign(), centres


def test_transform_is_the_matrix_and_its_inverse():
    rng = np.random.default_rng(0)
    rows = rng.integers(-(2**20), 2**20, size=(5, 64))
    coefficients = hadamard.transform(rows)
    assert np.array_equal(coefficients, rows @ hadamard.matrix()[hadamard.order()].T)
    assert all(hadamard.restore([int(x) for x in c]) == r.tolist() for c, r in zip(coefficients, rows))
    changes = (np.diff(hadamard.matrix()[hadamard.order()], axis=1) != 0).sum(axis=1)
    assert changes.tolist() == list(range(64))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 3, 1000, 2**20]))
def test_progressive_search_is_exact(seed, size):
    rng = np.random.default_rng(seed)
    rows, centres = rng.integers(-size, size + 1, size=(40, 64)), rng.integers(-size, size + 1, size=(8, 64))
    centres[5], rows[0] = centres[2], centres[2]  # a tie
    true = ((rows[:, None, :] - centres[None]) ** 2).sum(axis=2)
    found, far, _ = hadamard.nearest(hadamard.transform(rows), hadamard.transform(centres))
    assert np.array_equal(found, true.argmin(axis=1)) and np.array_equal(far, true.min(axis=1))
    again = hadamard.nearest(hadamard.transform(rows.astype(object)), hadamard.transform(centres.astype(object)))
    assert np.array_equal(again[0], found) and list(again[1]) == far.tolist()


def test_progressive_search_gives_up_early():
    # coarse vectors: neighbouring components alike
    rng = np.random.default_rng(7)
    rows, centres = (np.repeat(rng.integers(-1000, 1000, size=(n, 4)), 16, axis=1) for n in (500, 8))
    _, _, summed = hadamard.nearest(hadamard.transform(rows), hadamard.transform(centres))
    assert summed < 0.6 * 500 * 8 * 64


def clustered(df):
    assigned, centres = hadamard.cluster(df)
    return Counter((r["id"], r["cluster"], r["distance"]) for r in assigned.collect()), centres


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) + 3 * (i % 4)).tolist()) for i in range(60)]
    rows += rows[:10] + [(None, [0.5] * 64), (None, [0.25] * 64), (700, [-1.0] * 64), (700, [-2.0] * 64)] + [(800 + i, [4.0] * 64) for i in range(40)]
    bad = [(1, None), (2, [1.0] * 63), (3, []), (4, [NAN] * 64), (5, [None] + [1.0] * 63), (6, [INF] * 64), (7, [1.0] * 65)]
    found, centres = clustered(vectors(spark, rows + bad))
    exact = whole(rows, 1024)
    true, middles = lloyd(exact)
    assert centres == middles
    assert found == Counter((i, c, d) for (i, _), (d, c) in zip(exact, true))
    total = hadamard.with_inertia(hadamard.cluster(vectors(spark, rows))[0]).collect()
    assert {r["inertia"] for r in total} == {sum(d for d, _ in true)}
    assert all(r["cluster_inertia"] == sum(d for d, c in true if c == r["cluster"]) for r in total)


def test_few_and_huge_vectors(spark):
    assert clustered(vectors(spark, [])) == (Counter(), [])
    assert clustered(vectors(spark, [(1, [0.5] * 64)]))[0] == Counter([(1, 0, 0)])
    rows = [(1, [1e7] * 64), (2, [1e7 + 4] * 64), (3, [-1e7] * 64), (4, [1e300] * 64), (5, [-1e300] * 64), (6, [0.0] * 64)] + [(10 + i, [float(i)] * 64) for i in range(6)]
    cut = [(i, [max(-hadamard.LIMIT, min(hadamard.LIMIT, int(np.floor(1024 * x)))) for x in v]) for i, v in rows]
    true, middles = lloyd(cut)
    found, centres = clustered(vectors(spark, rows, T.DoubleType()))
    assert centres == middles
    assert found == Counter((i, c, min(d, 2**63 - 1)) for (i, _), (d, c) in zip(cut, true))
    assigned = spark.createDataFrame([(0, 2**63 - 1), (0, 5), (1, 2)], "cluster int, distance long")
    assert {tuple(r) for r in hadamard.with_inertia(assigned).select("cluster_inertia", "inertia").collect()} == {(2**63 - 1, 2**63 - 1), (2, 2**63 - 1)}


# the manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_of(leaves):
    """Levels of one tree, and per leaf its siblings as hex in order."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i : i + 3]) for i in range(0, len(last), 3)])
    proofs = []
    for i in range(len(leaves)):
        proof, at = "", i
        for level in levels[:-1]:
            run = at // 3 * 3
            proof += "".join(level[j] for j in range(run, min(run + 3, len(level))) if j != at)
            at //= 3
        proofs.append(proof)
    return levels[-1][0], proofs


def manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made, roots = [], []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        root, proofs = tree_of([leaf_of(r) for r in own])
        roots.append(root)
        made.append([(r, leaf_of(r), root, p) for r, p in zip(own, proofs)])
    if not roots:
        return Counter()
    root, above = tree_of(roots)
    return Counter((r[0], leaf, sub, root, p + above[t]) for t, own in enumerate(made) for r, leaf, sub, p in own)


def proved(df):
    columns = [F.col(c) for c in SCHEMA.replace(" long", "").replace(" string", "").split(", ")]
    return merkle.prove(df, merkle.leaf_digest(columns), F.col("source"), F.col("doc_id"), {"doc_id": F.col("doc_id")})


def check_manifest(df, rows):
    out = merkle.with_folded_root(proved(df), F.col("leaf")).collect()
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"].hex()) for r in out) == manifest(rows)
    assert all(r["folded_root"] == r["root"] for r in out)


def docs(spark, rows):
    own = ["leaf", "Root", "subroot", "proof", "tree", "place", "key", "digest", "carry", "level", "part", "folded_root"]
    return spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("own") for n in own})


def test_manifest_of_odd_rows(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(300), rng.choice(["a", "b", "", None, "ä", "Z", "a a"]), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice(["x\ny", "", None, "漢字" * 9, "-"])) for _ in range(200)]
    rows += rows[:50] + [(1, "hot", "en", 3, "same")] * 3000 + [(None, "hot", "en", 3, "same"), (None, None, None, None, None), (5, "alone", "en", 1, "x" * 500_000)]
    check_manifest(docs(spark, rows), rows)
    check_manifest(docs(spark, []), [])


@pytest.mark.parametrize("n, groups", [(1, 1), (2, 2), (28, 28), (2188, 1)])
def test_manifest_sizes(spark, n, groups):
    rows = [(i, f"s{i % groups}", None, i, "t") for i in range(n)]
    check_manifest(docs(spark, rows), rows)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 200), st.integers(0, 199))
def test_path_and_fold(n, place):
    place %= n
    leaves = [hashlib.sha256(str(i).encode()) for i in range(n)]
    root, proofs = tree_of([x.hexdigest() for x in leaves])
    assert merkle.fold(leaves[place].digest(), merkle.path(place, n), bytes.fromhex(proofs[place])).hex() == root


def test_manifest_of_many_levels(spark, monkeypatch):
    # blocks of three leaves make every level a block's last one; nothing is broadcast
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "MOST_SENT", -1)
    rng = random.Random(9)
    rows = [(i, rng.choice("aaab") + str(i % 30 if i > 250 else ""), None, None, "t") for i in range(300)]
    check_manifest(docs(spark, rows), rows)


def test_tampering_shows(spark, sf):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    import zlib

    for r in queries.op13_merkle(spark, sf).collect():
        spoilt = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (text[r["doc_id"]] or "")
        assert r["verified"] == (not spoilt) == (r["folded_root"] == r["root"])


def test_subroots(spark):
    rows = [(i, "ab"[i % 2], None, i, "t") for i in range(11)]
    found = merkle.subroots(proved(docs(spark, rows))).orderBy("tree").collect()
    assert [(r["tree"], r["leaves"]) for r in found] == [(0, 6), (1, 5)] and digest(found[0]["subroot"], found[1]["subroot"]) == found[0]["root"]
