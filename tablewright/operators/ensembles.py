"""Bagged models in levels, and ensembles chosen greedily from their out-of-fold predictions.

A bag is one model per fold, each fitted on the other folds. A training row's *opinion* (its class
probabilities, or its value) comes from the one model that has not seen it, a new row's is the mean over the
bag. A level above the first has the opinions of the level below as further features. The ensemble is
chosen with replacement: each round adds the bag that makes the mean opinion best by the metric asked for, and
the best of all rounds stays.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tablewright.operators import metrics
from tablewright.operators.models import FEATURES, LABEL, OutOfTime, Task, candidate_models, within
from tablewright.session import stored

FOLD = "__fold"
ROUNDS = 25
#: metrics by kind of problem; those of LOSSES are better the smaller they are
REGRESSION = ("rmse", "mae", "r2")
CLASSES = ("accuracy", "f1_weighted", "log_loss")
BINARY = (*CLASSES, "roc_auc")
LOSSES = ("rmse", "mae", "log_loss")
#: a chance is taken as no smaller than this by the logarithmic loss
LEAST_CHANCE = 1e-15
#: a relative difference below this is a tie, which the earlier bag wins
TIE = 1e-12


def default_metric(problem: str) -> str:
    return "rmse" if problem == "regression" else "accuracy"


def check_metric(problem: str, metric: str | None) -> str:
    """The metric to use; an error for one that the problem has not."""
    known = {"regression": REGRESSION, "binary": BINARY}.get(problem, CLASSES)
    if metric is not None and metric not in known:
        raise ValueError(f"metric {metric!r} is none of {', '.join(known)} for a {problem} problem")
    return metric or default_metric(problem)


def gain(metric: str, value: float) -> float:
    """The value with a sign that makes larger better; no value is worst of all."""
    if value is None or math.isnan(value):
        return float("-inf")
    return -value if metric in LOSSES else value


def _decided(view: Column) -> Column:
    """The class of greatest chance, the first of equal ones."""
    return (F.array_position(view, F.array_max(view)) - 1).cast("double")


def view_scores(df: DataFrame, views: dict[str, Column], metric: str, label: str = LABEL) -> dict[str, float]:
    """One metric of many predictions of the same rows, each an array of chances or of one value; one job."""
    y = F.col(label).cast("double")
    if metric in ("f1_weighted", "roc_auc"):
        told = (lambda v: F.get(v, 1)) if metric == "roc_auc" else _decided
        each = F.array(*[F.struct(F.lit(n).alias("trial"), told(v).alias("p")) for n, v in views.items()])
        long = df.select(y.alias("y"), F.explode(each).alias("t")).select("y", "t.trial", "t.p")
        if metric == "roc_auc":
            found = metrics.roc_auc(long, "p", F.col("y") == 1, ["trial"])
        else:
            found = metrics.classification_metrics(long, "y", "p", ["trial"])
        return {r["trial"]: r[metric] for r in found.select("trial", metric).collect()}
    names = list(views)
    out = []
    for v in views.values():
        apart = F.get(v, 0) - y
        if metric == "accuracy":
            out.append(F.avg((_decided(v) == y).cast("int")))
        elif metric == "log_loss":
            out.append(-F.avg(F.log(F.greatest(F.get(v, y.cast("int")), F.lit(LEAST_CHANCE)))))
        elif metric == "mae":
            out.append(F.avg(F.abs(apart)))
        elif metric == "rmse":
            out.append(F.sqrt(F.avg(apart * apart)))
        else:
            out.append(1 - F.try_divide(F.avg(apart * apart), F.var_pop(y)))
    row = df.agg(*[c.alias(f"s{i}") for i, c in enumerate(out)]).first()
    return {n: row[f"s{i}"] for i, n in enumerate(names)}


@dataclass
class Choice:
    """How often each bag was taken, the share that gives it, and the best score of every round."""

    uses: dict[str, int]
    weights: dict[str, float]
    score: float
    rounds: list[tuple[str, float]]


def _greedy(names: Sequence[str], metric: str, rounds: int, trial: Callable[[dict[str, int]], dict[str, float]]) -> Choice:
    """``trial`` gives the score of the mean opinion after one more use of each name."""
    uses = dict.fromkeys(names, 0)
    steps, best, kept = [], None, dict(uses)
    for _ in range(rounds):
        found = trial(uses)
        taken = names[0]
        for name in names[1:]:
            if _above(gain(metric, found[name]), gain(metric, found[taken])):
                taken = name
        uses[taken] += 1
        steps.append((taken, found[taken]))
        if best is None or _above(gain(metric, found[taken]), gain(metric, best)):
            best, kept = found[taken], dict(uses)
    total = sum(kept.values())
    return Choice(kept, {n: c / total for n, c in kept.items()}, best, steps)


def _above(a: float, b: float) -> bool:
    if math.isinf(a) or math.isinf(b):
        return a > b
    return a - b > TIE * max(1.0, abs(a), abs(b))


def choose(held: DataFrame, views: dict[str, Column], metric: str, label: str = LABEL, rounds: int = ROUNDS) -> Choice:
    """The best ensemble, with replacement, of predictions for the same held-out rows.

    Square errors need the rows once: a mean's square error is a quadratic form of the products of the members'
    errors, so all rounds run on that small matrix. Other metrics read the rows once a round.
    """
    names = list(views)
    if not names or rounds < 1:
        raise ValueError("an ensemble needs a prediction and a round")
    if metric in ("rmse", "r2"):
        y = F.col(label).cast("double")
        errors = held.select(y.alias("y"), *[(F.get(v, 0) - y).alias(f"e{i}") for i, v in enumerate(views.values())])
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        row = errors.agg(F.var_pop("y").alias("spread"), *[F.avg(F.col(f"e{i}") * F.col(f"e{j}")).alias(f"g{i}_{j}") for i, j in pairs]).first()

        def from_products(uses: dict[str, int]) -> dict[str, float]:
            out = {}
            for more in names:
                w = [uses[n] + (n == more) for n in names]
                total = sum(w)
                square = sum((1 if i == j else 2) * w[i] * w[j] * (row[f"g{i}_{j}"] or 0.0) for i, j in pairs) / total**2
                square = max(0.0, square)
                out[more] = math.sqrt(square) if metric == "rmse" else 1 - square / row["spread"] if row["spread"] else None
            return out

        return _greedy(names, metric, rounds, from_products)
    slim = stored(held.select(label, *[v.alias(f"__v{i}") for i, v in enumerate(views.values())]))

    def from_rows(uses: dict[str, int]) -> dict[str, float]:
        total = sum(uses.values()) + 1
        taken = [_times(f"__v{i}", uses[name]) for i, name in enumerate(names) if uses[name]]
        summed = slim.withColumn("__sum", _added(taken)) if taken else slim.withColumn("__sum", _times("__v0", 0))
        tried = {n: F.zip_with("__sum", f"__v{i}", lambda s, x: (s + x) / float(total)) for i, n in enumerate(names)}
        return view_scores(summed, tried, metric, label)

    return _greedy(names, metric, rounds, from_rows)


def _times(array: str, factor: float) -> Column:
    return F.transform(array, lambda x: x * float(factor))


def _added(arrays: Sequence[Column]) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), arrays)


@dataclass
class Bag:
    """The models of one candidate in one level, by fold; its opinion has the column ``view``."""

    name: str
    level: int
    view: str
    models: list
    seconds: float
    score: float | None = None


def _opinion(model, df: DataFrame, name: str, regression: bool) -> DataFrame:
    """``df`` with the array of one model's chances, or of its value."""
    out = model.transform(df)
    view = F.array(F.col("prediction")) if regression else vector_to_array("probability")
    return out.withColumn(name, view).select(*[F.col(f"`{c}`") for c in df.columns], name)


def _raise(df: DataFrame, views: Sequence[str], width: int) -> DataFrame:
    """Rows of the next level: features and the opinions so far, of ``width`` numbers each, in one vector."""
    wide = df
    for v in views:
        known = VectorSizeHint(inputCol=f"{v}_vector", size=width, handleInvalid="optimistic")
        wide = known.transform(wide.withColumn(f"{v}_vector", array_to_vector(v)))
    inputs = [FEATURES, *[f"{v}_vector" for v in views]]
    joined = VectorAssembler(inputCols=inputs, outputCol="__raised", handleInvalid="keep").transform(wide)
    return joined.drop(*inputs).withColumnRenamed("__raised", FEATURES)


class Ensemble:
    """Bags, their weights and what became of every candidate."""

    def __init__(self, task: Task, metric: str, bags: Sequence[Bag], choice: Choice, dropped: Sequence[tuple[str, str, str]]) -> None:
        self.task, self.metric, self.bags, self.choice, self.dropped = task, metric, list(bags), choice, list(dropped)

    @property
    def score(self) -> float:
        """The metric of the mean opinion over all held-out folds."""
        return self.choice.score

    def opinions(self, df: DataFrame) -> DataFrame:
        """``df`` with the mean opinion of every bag that the prediction needs."""
        regression = self.task.problem == "regression"
        needed = [b for b in self.bags if self.choice.weights[b.view]]
        top = max(b.level for b in needed)
        own = [c for c in df.columns]
        out = df.withColumn("__features0", F.col(FEATURES))
        for level in range(top + 1):
            here = [b for b in self.bags if b.level == level and (level < top or b in needed)]
            for bag in here:
                parts = [f"{bag.view}_{k}" for k in range(len(bag.models))]
                for model, part in zip(bag.models, parts):
                    out = _opinion(model, out, part, regression)
                n = float(len(parts))
                out = out.withColumn(bag.view, F.transform(_added([F.col(p) for p in parts]), lambda x: x / F.lit(n))).drop(*parts)
            if level < top:
                out = _raise(out, [b.view for b in here], max(1, len(self.task.labels)))
        views = [b.view for b in self.bags if b.view in out.columns]
        return out.withColumn(FEATURES, F.col("__features0")).select(*[F.col(f"`{c}`") for c in own], *views)

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows with features get ``prediction`` and, if there are classes, ``probability``."""
        own = [F.col(f"`{c}`") for c in df.columns]
        # the mean lets every bag have its weight, whatever the order of the opinions
        shares = [(v, w) for v, w in self.choice.weights.items() if w]
        rows = self.opinions(df)
        mixed = _added([_times(v, w) for v, w in shares])
        rows = rows.withColumn("__mixed", mixed)
        if self.task.problem == "regression":
            return rows.select(*own, F.get("__mixed", 0).alias("prediction"))
        return rows.select(*own, array_to_vector("__mixed").alias("probability"), _decided(F.col("__mixed")).alias("prediction"))

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row per bag, best first, then one per candidate that was dropped."""
        ranked = sorted(self.bags, key=lambda b: -gain(self.metric, b.score))
        rows = [(i + 1, b.name, b.level, self.metric, b.score, self.choice.weights[b.view], "ok", None) for i, b in enumerate(ranked)]
        rows += [(None, name, None, None, None, None, status, error) for name, status, error in self.dropped]
        return spark.createDataFrame(rows, "rank int, model string, level int, metric string, value double, weight double, status string, error string")


def bagged_ensemble(
    task: Task, models: dict | None = None, metric: str | None = None, folds: int = 5, levels: int = 1,
    rounds: int = ROUNDS, budget: float = 600.0,
) -> Ensemble:
    """Bags of every candidate in ``levels`` levels above the first, and the ensemble chosen from all of them.

    Copies of a row share a fold. A candidate that fails or that the budget of seconds ends is reported and
    not missed: each is fitted with the time left, and until one is ready each may take its equal
    share. ``OutOfTime`` or the last error if none is.
    """
    metric = check_metric(task.problem, metric)
    if folds < 2 or levels < 0:
        raise ValueError("bagging needs two folds or more and no negative number of levels")
    models, regression = models or candidate_models(task.problem), task.problem == "regression"
    spark, started = task.rows.sparkSession, time.time()
    fold = F.pmod(F.xxhash64(FEATURES, LABEL), F.lit(folds))
    rows = stored(task.part("train").withColumn(FOLD, fold))
    bags, dropped, last = [], [], None

    def bagged(estimator, view: str) -> tuple[list, DataFrame]:
        level_rows = rows.persist()
        pool = ThreadPool(folds)

        def without(k: int):
            return estimator.copy().fit(level_rows.filter(F.col(FOLD) != k))

        try:
            # the folds' jobs share the executors; their threads carry the tag that a budget cancels by
            fits = [inheritable_thread_target(spark)(partial(without, k)) for k in range(folds)]
            kept = pool.map(lambda fit: fit(), fits)
            parts = [_opinion(m, level_rows.filter(F.col(FOLD) == k), view, regression) for k, m in enumerate(kept)]
            return kept, stored(reduce(DataFrame.unionByName, parts))
        finally:
            pool.close()
            level_rows.unpersist()

    for level in range(levels + 1):
        below = len(bags)
        for i, (name, estimator) in enumerate(models.items()):
            view, title = f"__bag{level}_{i}", name if level == 0 else f"{name}, level {level + 1}"
            left = budget - (time.time() - started)
            if bags and left <= 0:
                dropped.append((title, "not started", f"the budget of {budget:.0f} seconds is spent"))
                continue
            begun = time.time()
            try:
                limit = left if bags else max(left, budget / len(models))
                kept, wider = within(spark, limit, partial(bagged, estimator, view))
            except OutOfTime as exc:
                last = exc
                dropped.append((title, "out of time", str(exc)))
                continue
            except Exception as exc:
                last = exc
                dropped.append((title, "failed", str(exc)[:300]))
                continue
            rows = wider
            bags.append(Bag(name, level, view, kept, time.time() - begun))
        fresh = [b.view for b in bags[below:]]
        if not fresh:
            break
        if level < levels:
            rows = stored(_raise(rows, fresh, max(1, len(task.labels))).select(*[F.col(f"`{c}`") for c in rows.columns]))
    if not bags:
        raise last or RuntimeError("no candidate")
    views = {b.view: F.col(b.view) for b in bags}
    own = view_scores(rows, views, metric)
    for bag in bags:
        bag.score = own[bag.view]
    return Ensemble(task, metric, bags, choose(rows, views, metric, rounds=rounds), dropped)
