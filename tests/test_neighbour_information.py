"""Nearest-neighbour mutual information against all distances."""

import math

import numpy as np
import pytest

from tablewright.operators import neighbour_information, selection

K = neighbour_information.NEIGHBOURS


def psi(n: float) -> float:
    out = 0.0
    while n < 20:
        out -= 1 / n
        n += 1
    return out + math.log(n) - 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4) - 1 / (252 * n**6)


def brute(rows, k=K):
    rows = [(float(x), y) for x, y in rows if x is not None and math.isfinite(x) and y is not None]
    size = {y: sum(y == b for _, b in rows) for _, y in rows}
    rows = [(x, y) for x, y in rows if size[y] > 1]
    total = 0.0
    for i, (x, y) in enumerate(rows):
        far = sorted(abs(x - v) for j, (v, b) in enumerate(rows) if b == y and j != i)
        r = far[min(k, size[y] - 1) - 1]
        if r > 0:
            near, m = min(k, size[y] - 1), sum(x - r < v < x + r for v, _ in rows)
        else:
            near, m = sum(v == x and b == y for v, b in rows), sum(v == x for v, _ in rows)
        total += psi(near) - psi(size[y]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows)) if rows else 0.0


def test_digamma(spark):
    from pyspark.sql import functions as F

    got = spark.range(1, 200).select("id", neighbour_information.digamma(F.col("id")).alias("p")).collect()
    assert max(abs(r["p"] - psi(r["id"])) for r in got) < 1e-10
    assert got[0]["p"] == pytest.approx(-0.5772156649015329, abs=1e-10)


@pytest.mark.parametrize("part", [3, 7, neighbour_information.PART])
def test_equals_all_distances(spark, monkeypatch, part):
    """Parts of a few cells, so that every neighbourhood crosses a border; ties; lone and small classes."""
    monkeypatch.setattr(neighbour_information, "PART", part)
    draw = np.random.default_rng(3)
    y = [str(v) for v in draw.integers(0, 4, 240)] + ["pair", "pair", "lone", None]
    spread = [float(v) for v in draw.normal(size=244) + np.array([float(v) if v and v.isdigit() else 0.0 for v in y])]
    tied = [float(v) for v in draw.integers(0, 12, 244)]
    odd = [None if i % 17 == 0 else float("nan") if i % 19 == 0 else float("inf") if i % 23 == 0 else round(v, 1) for i, v in enumerate(spread)]
    frame = spark.createDataFrame(list(zip(spread, tied, odd, y)), "spread double, `ti.ed` double, odd double, y string").repartition(5)
    got = {r["column"]: r["score"] for r in neighbour_information.mutual_information(frame, ["spread", "ti.ed", "odd"], "y").collect()}
    for name, values in (("spread", spread), ("ti.ed", tied), ("odd", odd)):
        assert got[name] == pytest.approx(brute(zip(values, y)), abs=1e-9), name
    assert got["spread"] > 0.2


def test_no_rows_and_no_values(spark):
    empty = spark.createDataFrame([], "x double, y string")
    assert [tuple(r) for r in neighbour_information.mutual_information(empty, ["x"], "y").collect()] == [("x", 0.0)]
    nulls = spark.createDataFrame([(None, "a"), (None, "b")], "x double, y string")
    assert [tuple(r) for r in neighbour_information.mutual_information(nulls, ["x"], "y").collect()] == [("x", 0.0)]
    assert neighbour_information.mutual_information(nulls, [], "y").count() == 0


def test_selection_takes_what_depends_on_the_target(spark):
    draw = np.random.default_rng(5)
    rows = [(float(a), float(b), float(abs(a) > 1), float(a * a)) for a, b in draw.normal(size=(300, 2))]
    frame = spark.createDataFrame(rows, "signal double, noise double, cls double, square double")
    # a dependence without correlation
    chosen = selection.select_features(frame.drop("square"), "cls", k=1)
    assert chosen.columns == ["signal", "cls"]
    chosen = selection.select_features(frame.drop("cls"), "square", task="regression", k=1)
    assert chosen.columns == ["signal", "square"]
