"""Training, scoring and keeping models: everything is one saveable ``PipelineModel``."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

from pyspark import InheritableThread, inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassificationModel,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    IndexToString,
    OneHotEncoder,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators import cells, metrics, prepare, profile
from tablewright.operators.columns import categorical_columns, datetime_columns, nan_to_null, numeric_columns, q
from tablewright.operators.ranking import row_hash
from tablewright.operators.sampling import split_rows
from tablewright.session import discard, scratch, stored

LABEL = "__label"
WEIGHT = "__weight"
FEATURES = "__features"
MAX_CATEGORIES = 50
HIDDEN = (256, 128, 64)
#: rows that one task of a fit takes, where there are so many
FIT_ROWS = 20_000
#: fits side by side: of an ensemble, and of the jobs of a batch
SIDE_BY_SIDE = 4


# ---- features ------------------------------------------------------------------------


def _name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _text(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def _date_sql(c: str, is_text: bool) -> str:
    if not is_text:
        return _name(c)
    return prepare.date_sql(_name(c))


@dataclass
class FeatureSpec:
    """What was learnt from the training rows, and the stages that apply it."""

    stages: list
    dropped: list[str]
    dates: list[str]
    numeric: list[str]
    categorical: list[str]
    names: list[str] = field(default_factory=list)


def array_lengths(df: DataFrame) -> dict[str, int]:
    """Columns that are arrays of numbers, with their greatest length; empty ones are left out."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType)]
    found = df.agg(*[F.max(F.size(q(c))).alias(c) for c in arrays]).first().asDict() if arrays else {}
    return {c: n for c, n in found.items() if n and n > 0}


def fit_features(train: DataFrame, target: str, dropped: Sequence[str] = (), dates: Sequence[str] | None = None) -> FeatureSpec:
    """Learn fills, scales and categories on ``train``; the stages hold them as constants.

    Dates become calendar numbers inside the pipeline, so a saved model scores raw rows.
    """
    work, stages = nan_to_null(train).drop(*dropped), []
    wide = array_lengths(work.drop(target))
    if wide:
        # the places of an array are columns of their own; a shorter one has nulls in the last of them
        places = [f"get({_name(c)}, {i}) AS {_name(f'{c}_{i}')}" for c, n in wide.items() for i in range(n)]
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(places)} FROM __THIS__"))
        work = stages[0].transform(work).drop(*wide)
    inputs = work.drop(target)
    text_dates = list(dates) if dates is not None else prepare.date_text_columns(inputs)
    all_dates = [c for c in inputs.columns if c in text_dates or c in datetime_columns(inputs)]
    numeric = [c for c in numeric_columns(inputs)]
    if all_dates:
        parts = []
        for c in all_dates:
            ts = _date_sql(c, c in categorical_columns(inputs))
            for part, fn in (("year", "year"), ("month", "month"), ("dow", "weekday")):
                parts.append(f"{fn}({ts}) AS {_name(f'{c}_{part}')}")
                numeric.append(f"{c}_{part}")
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__"))
        inputs = stages[-1].transform(inputs)
    categorical = [
        c for c in work.columns
        if c != target and c not in all_dates and c not in numeric_columns(work)
    ]
    if not numeric and not categorical:
        raise ValueError("no usable feature columns")
    exprs, assembled, names = [], [], []
    for c, (mid, spread) in prepare.scale_statistics(inputs, numeric).items() if numeric else ():
        value = f"CAST({_name(c)} AS DOUBLE)"
        if prepare.is_float(inputs, c):
            value = f"nanvl({value}, NULL)"
        exprs.append(f"(coalesce({value}, {_number(mid)}) - {_number(mid)}) / {_number(spread)} AS {_name('num__' + c)}")
        assembled.append(f"num__{c}")
        names.append(c)
    fill = prepare.modes(inputs, categorical)
    filled = inputs.withColumns({c: F.coalesce(q(c).cast("string"), F.lit(fill[c])) for c in categorical})
    levels = prepare.category_levels(filled, categorical, MAX_CATEGORIES) if categorical else {}
    categorical = [c for c in categorical if levels[c]]
    for c in categorical:
        value = f"coalesce(CAST({_name(c)} AS STRING), {_text(fill[c])})"
        if prepare.RARE in levels[c]:
            common = ", ".join(_text(v) for v in levels[c] if v != prepare.RARE)
            value = f"CASE WHEN {value} IN ({common}) THEN {value} ELSE {_text(prepare.RARE)} END"
        exprs.append(f"{value} AS {_name('cat__' + c)}")
    stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__"))
    if categorical:
        indexes = [
            StringIndexerModel.from_labels(levels[c], f"cat__{c}", f"idx__{c}", handleInvalid="keep") for c in categorical
        ]
        encoder = OneHotEncoder(
            inputCols=[f"idx__{c}" for c in categorical], outputCols=[f"hot__{c}" for c in categorical]
        )
        so_far = PipelineModel([*stages, *indexes]).transform(train.drop(*dropped).limit(1))
        stages += [*indexes, encoder.fit(so_far)]
        assembled += [f"hot__{c}" for c in categorical]
        names += [f"{c}={v}" for c in categorical for v in levels[c]]
    stages.append(VectorAssembler(inputCols=assembled, outputCol=FEATURES))
    return FeatureSpec(stages, list(dropped), all_dates, numeric, categorical, names)


# ---- training ------------------------------------------------------------------------


@dataclass
class Task:
    """A prepared problem: split rows with label and weight, and the feature stages."""

    target: str
    problem: str
    spec: FeatureSpec
    labels: list[str]
    rows: DataFrame
    strategy: str

    def part(self, name: str) -> DataFrame:
        return self.rows.filter(F.col("split") == name)


def prepare_task(
    df: DataFrame, target: str, problem: str, hashed: Column | None = None, ties: Sequence[str] | None = None
) -> Task:
    """Clean, drop id-like columns, split 70/15/15, learn features on the training part.

    ``hashed`` decides the split (default: a hash of the whole row); ``ties`` are its
    tie-breaking columns.
    """
    spark, folder = df.sparkSession, scratch(df.sparkSession)
    clean = stored(prepare.without_copies(nan_to_null(df).na.drop(subset=[target])), folder)
    dropped = prepare.id_like_names(clean, target)
    columns = list(clean.columns)
    order = hashed if hashed is not None else row_hash(*columns)
    split = split_rows(clean, order, ties or columns, None if problem == "regression" else target)
    if problem == "regression":
        labels, strategy = [], "none"
        rows = split.withColumn(LABEL, q(target).cast("double")).withColumn(WEIGHT, F.lit(1.0))
    else:
        table = profile.class_weights(clean.select(q(target).cast("string").alias(target)), target).collect()
        labels = sorted(r["label"] for r in table)
        strategy = table[0]["strategy"]
        weight = {r["label"]: r["weight"] for r in table}
        code = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(float(i)))])
        mass = F.create_map(*[x for v in labels for x in (F.lit(v), F.lit(float(weight[v])))])
        value = q(target).cast("string")
        # with the number of classes known, no estimator has to count them, or refuses more than a hundred
        nominal = {"ml_attr": {"type": "nominal", "name": LABEL, "num_vals": len(labels)}}
        rows = split.withColumn(LABEL, code[value].alias(LABEL, metadata=nominal)).withColumn(WEIGHT, mass[value])
    # written once: every candidate, metric and explanation reads the same rows
    rows = stored(rows)
    discard(spark, folder)
    spec = fit_features(rows.filter("split = 'train'").drop("split", LABEL, WEIGHT), target, dropped)
    staged = PipelineModel(spec.stages).transform(rows).select(*[q(c) for c in [*columns, "split", LABEL, WEIGHT, FEATURES]])
    # features are as large as all else, and made again in no time unless dates have to be read from text
    texts = set(spec.dates) & set(categorical_columns(rows))
    return Task(target, problem, spec, labels, stored(staged) if texts else staged, strategy)


class NormalisedScores(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``probability`` from the margins of one boosted model per class: their own probabilities, scaled to sum 1."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # margins beyond 30 make no difference to a double
        margins = F.transform(vector_to_array("rawPrediction"), lambda x: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x)))
        chances = F.transform(margins, lambda x: 1.0 / (1.0 + F.exp(-2.0 * x)))
        total = F.aggregate(chances, F.lit(0.0), lambda s, x: s + x)
        return dataset.withColumn("probability", array_to_vector(F.transform(chances, lambda x: x / total)))


class BoostedClasses(Estimator):
    """Boosting for any number of classes: one model against the rest per class, and a probability vector."""

    def __init__(self, rounds: int, seed: int, **columns: str) -> None:
        super().__init__()
        self.rounds, self.seed, self.columns = rounds, seed, columns

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        one = cells.CellGBTClassifier(maxIter=self.rounds, seed=self.seed, **self.columns)
        classes = cells.known_classes(dataset, one.getLabelCol())
        found = cells.cells_of(one, dataset, classes, classes)
        try:
            java = cells.boosted_models(dataset.sparkSession, found, range(classes), one)
        finally:
            found.close()
        several = OneVsRest(classifier=one, **self.columns)
        model = several._copyValues(OneVsRestModel([cells.with_params(one, GBTClassificationModel(j)) for j in java]))
        return PipelineModel([model, NormalisedScores()])


def candidate_models(problem: str, seed: int = 42, trees: int = 50, rounds: int = 20) -> dict:
    """Estimators tried for a problem; weights apply to all of them."""
    common = {"featuresCol": FEATURES, "labelCol": LABEL, "weightCol": WEIGHT}
    if problem == "regression":
        return {
            "GradientBoosting": cells.CellGBTRegressor(maxIter=rounds, seed=seed, **common),
            "RandomForest": cells.CellForestRegressor(numTrees=trees, maxDepth=8, seed=seed, **common),
            "Ridge": LinearRegression(regParam=1e-3, elasticNetParam=0.0, **common),
        }
    models = {
        "RandomForest": cells.CellForestClassifier(numTrees=trees, maxDepth=8, seed=seed, **common),
        "LogisticRegression": LogisticRegression(maxIter=100, **common),
    }
    if problem == "binary":
        return {"GradientBoosting": cells.CellGBTClassifier(maxIter=rounds, seed=seed, **common), **models}
    # last: with many classes it is the one that a budget may end
    return {**models, "GradientBoosting": BoostedClasses(rounds, seed, **common)}


def network(dim: int, classes: int, epochs: int = 80, seed: int = 42) -> MultilayerPerceptronClassifier:
    """Feed-forward classifier with hidden layers 256-128-64."""
    return MultilayerPerceptronClassifier(
        layers=[dim, *HIDDEN, classes], maxIter=epochs, seed=seed, featuresCol=FEATURES, labelCol=LABEL
    )


def primary_metric(problem: str) -> str:
    return {"regression": "r2", "binary": "roc_auc"}.get(problem, "f1_weighted")


def scores(predicted: DataFrame, problem: str) -> dict[str, float]:
    """All metrics of a transformed frame; only aggregates reach the driver.

    The model runs once: its few output columns are kept for the metrics that follow.
    """
    chance = problem == "binary" and "probability" in predicted.columns
    extra = [vector_to_array("probability")[1].alias("p")] if chance else []
    slim = predicted.select(LABEL, "prediction", *extra).persist()
    try:
        if problem == "regression":
            row = metrics.regression_metrics(slim, LABEL, "prediction").first()
            return {"r2": row["r2"], "mae": row["mae"], "rmse": row["rmse"]}
        row = metrics.classification_metrics(slim, LABEL, "prediction").first()
        out = {"accuracy": row["accuracy"], "f1_weighted": row["f1_weighted"]}
        if chance:
            out["roc_auc"] = metrics.roc_auc(slim, "p", F.col(LABEL) == 1).first()["roc_auc"]
        return out
    finally:
        slim.unpersist()


@dataclass
class Trained:
    name: str
    model: object
    scores: dict[str, float]
    seconds: float


class Board(list):
    """The trained candidates, best first; ``dropped`` has ``(name, status, error)`` of the others:
    ``failed``, ``out of time`` or ``not started``."""

    def __init__(self, trained: Sequence[Trained], dropped: Sequence[tuple[str, str, str]]) -> None:
        super().__init__(trained)
        self.dropped = list(dropped)

    def losses(self) -> str:
        """The candidates that were dropped, and why, as text."""
        return "; ".join(f"{name}: {status}, {error}" for name, status, error in self.dropped)


class OutOfTime(RuntimeError):
    """Work that was ended at its time limit."""


#: seconds that work has to end after its Spark jobs were cancelled
GRACE = 10.0


def within(spark: SparkSession, seconds: float, work):
    """The result of ``work()``, or ``OutOfTime`` after so many seconds.

    The work runs in a thread whose Spark jobs carry a tag of their own. At the limit the jobs of that tag
    are cancelled, again and again until the work has ended, since a fit starts job after job.
    """
    context, tag = spark.sparkContext, f"within-{uuid.uuid4().hex}"
    out: dict = {}

    def run() -> None:
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        try:
            out["value"] = work()
        except BaseException as exc:  # handed to the caller
            out["error"] = exc
        finally:
            context.removeJobTag(tag)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(max(0.0, seconds))
    if thread.is_alive():
        ended = time.time() + GRACE
        while thread.is_alive() and time.time() < ended:
            context.cancelJobsWithTag(tag)
            thread.join(0.2)
        raise OutOfTime(f"ended after {seconds:.0f} seconds")
    if "error" in out:
        raise out["error"]
    return out["value"]


def fit_rows(part: DataFrame) -> DataFrame:
    """What a fit and its scores read of some rows: no columns but features, label and weight, and no more
    partitions than the rows are worth, since a fit starts hundreds of jobs with a task for each."""
    slim = part.select(FEATURES, LABEL, WEIGHT)
    return slim.coalesce(max(1, -(-slim.count() // FIT_ROWS)))


def train_leaderboard(task: Task, models: dict | None = None, budget: float | None = None) -> Board:
    """Fit each candidate on train, score on validation, best first.

    All are trained however long they take, unless a ``budget`` of seconds is named. A candidate that
    fails, or that the budget ends, is reported in ``dropped``; so are those it leaves no time for. Until
    one is trained, each may take its equal share of the budget even when that is spent. If none can be
    trained the run fails.
    """
    models = models or candidate_models(task.problem)
    # not kept in memory: each fit keeps what it reads often, in a smaller form
    train, val = fit_rows(task.part("train")), fit_rows(task.part("val"))
    started, done, dropped = time.time(), [], []

    def fitted(name: str, estimator) -> Trained:
        begun = time.time()
        model = estimator.fit(train)
        return Trained(name, model, scores(model.transform(val), task.problem), time.time() - begun)

    for name, estimator in models.items():
        left = None if budget is None else budget - (time.time() - started)
        if left is not None and done and left <= 0:
            dropped.append((name, "not started", f"the budget of {budget:.0f} seconds is spent"))
            continue
        try:
            work = partial(fitted, name, estimator)
            if left is not None:
                work = partial(within, train.sparkSession, left if done else max(left, budget / len(models)), work)
            done.append(work())
        except OutOfTime as exc:
            dropped.append((name, "out of time", str(exc)))
        except Exception as exc:
            dropped.append((name, "failed", str(exc)[:300]))
    if not done:
        raise RuntimeError(f"no candidate could be trained: {Board([], dropped).losses()}"[:600])
    metric = primary_metric(task.problem)
    return Board(sorted(done, key=lambda t: -(t.scores.get(metric) or float("-inf"))), dropped)


def leaderboard_frame(spark: SparkSession, board: Sequence[Trained], problem: str) -> DataFrame:
    """A row per candidate and metric, and one, without rank and value, per candidate that was dropped."""
    metric = primary_metric(problem)
    rows = [
        (i + 1, t.name, m, float(v), m == metric, "ok", None)
        for i, t in enumerate(board) for m, v in t.scores.items() if v is not None
    ]
    rows += [(None, name, None, None, None, status, error) for name, status, error in getattr(board, "dropped", ())]
    return spark.createDataFrame(rows, "rank int, model string, metric string, value double, is_primary boolean, status string, error string")


def full_model(task: Task, model) -> PipelineModel:
    """Feature stages, model and label decoding as one saveable pipeline."""
    stages = [*task.spec.stages, model]
    if task.labels:
        stages.append(IndexToString(inputCol="prediction", outputCol="__decoded", labels=task.labels))
    return PipelineModel(stages)


def evaluate(task: Task, model) -> tuple[dict[str, float], DataFrame | None]:
    """Metrics on the untouched test part, and its classification report."""
    predicted = model.transform(task.part("test"))
    report = None
    if task.labels:
        named = F.element_at(F.lit(task.labels), F.col("prediction").cast("int") + 1)
        report = metrics.classification_report(
            predicted.select(q(task.target).cast("string").alias("y"), named.alias("p")), "y", "p"
        )
    return scores(predicted, task.problem), report


def confusion(task: Task, model) -> DataFrame | None:
    """Confusion matrix of the test part; None for a regression."""
    if not task.labels:
        return None
    predicted = model.transform(task.part("test"))
    named = F.element_at(F.lit(task.labels), F.col("prediction").cast("int") + 1)
    pairs = predicted.select(q(task.target).cast("string").alias("y"), named.alias("p"))
    return metrics.confusion_matrix(pairs, "y", "p")


# ---- scoring and keeping -------------------------------------------------------------


def score(pipeline: PipelineModel, df: DataFrame, meta: dict) -> DataFrame:
    """Every row with ``prediction`` (labels restored) and, if binary, ``probability``.

    Works on batch and streaming frames alike; target and dropped columns may be present.
    """
    inputs = df.drop(meta["target"], *meta.get("dropped", []))
    out = pipeline.transform(inputs)
    columns = [q(c) for c in inputs.columns]
    if meta["problem_type"] == "regression":
        return out.select(*columns, "prediction")
    result = [*columns, F.col("__decoded").alias("prediction")]
    if meta["problem_type"] == "binary":
        result.append(vector_to_array("probability")[1].alias("probability"))
    return out.select(*result)


def save_bundle(pipeline: PipelineModel, meta: dict, folder: str) -> None:
    """``folder/model`` and ``folder/run_meta`` (one JSON row)."""
    from pyspark.sql import SparkSession as Session

    spark = Session.active()
    pipeline.write().overwrite().save(f"{folder}/model")
    row = {k: ([str(x) for x in v] if isinstance(v, list) else None if v is None else str(v)) for k, v in meta.items()}
    fields = ", ".join(f"`{k}` {'array<string>' if isinstance(v, list) else 'string'}" for k, v in row.items())
    spark.createDataFrame([tuple(row.values())], fields).write.mode("overwrite").json(f"{folder}/run_meta")


def load_bundle(spark: SparkSession, folder: str) -> tuple[PipelineModel, dict]:
    meta = spark.read.json(f"{folder}/run_meta").first().asDict()
    meta.setdefault("dropped", [])
    meta["dropped"] = meta["dropped"] or []
    return PipelineModel.load(f"{folder}/model"), meta


# ---- importance, stacking, search ----------------------------------------------------


def tree_importance(model, names: Sequence[str], columns: Sequence[str] = ()) -> dict[str, float]:
    """Impurity importance per source column, one-hot parts (``column=level``) added up.

    ``columns`` are the source columns; with them, names that hold ``=`` themselves stay apart.
    """
    out: dict[str, float] = {}
    for name, value in zip(names, model.featureImportances.toArray()):
        fits = [c for c in columns if name == c or name.startswith(f"{c}=")]
        source = max(fits, key=len) if fits else name.split("=", 1)[0]
        out[source] = out.get(source, 0.0) + float(value)
    return out


def stacked_ensemble(task: Task, models: dict | None = None, folds: int = 5, budget: float | None = None):
    """Out-of-fold predictions of each base model feed a linear second level; ``OutOfTime`` after ``budget`` seconds.

    Returns ``(predict, weights)`` where ``predict`` adds ``prediction`` (and, if binary,
    ``probability``) to rows with features.
    """
    if budget is not None:
        return within(task.rows.sparkSession, budget, lambda: stacked_ensemble(task, models, folds))
    models = models or candidate_models(task.problem)
    regression = task.problem == "regression"
    slim = task.part("train").select(FEATURES, LABEL, WEIGHT)
    train = slim.withColumn("__fold", F.pmod(F.xxhash64(FEATURES, LABEL), F.lit(folds))).persist()
    outputs = {name: f"__base{i}" for i, name in enumerate(models)}

    def opinion(model, df: DataFrame, name: str) -> DataFrame:
        out = model.transform(df)
        view = F.array(F.col("prediction")) if regression else vector_to_array("probability")
        return out.withColumn(outputs[name], view).select(*df.columns, outputs[name])

    # the fits know nothing of each other: one per model and fold, and one per model on all rows
    asked = [(k, name) for k in [*range(folds), None] for name in models]
    pool = ThreadPoolExecutor(SIDE_BY_SIDE)

    def fitted(one: tuple):
        k, name = one
        return models[name].fit(train if k is None else train.filter(F.col("__fold") != k))

    try:
        done = dict(zip(asked, pool.map(inheritable_thread_target(train.sparkSession)(fitted), asked)))
    finally:
        pool.shutdown(cancel_futures=True)
    held = None
    for k in range(folds):
        fold = train.filter(F.col("__fold") == k)
        for name in models:
            fold = opinion(done[k, name], fold, name)
        held = fold if held is None else held.unionByName(fold)
    whole = {name: done[None, name] for name in models}

    def widen(df: DataFrame) -> DataFrame:
        return df.withColumn("__stack", array_to_vector(F.concat(*[F.col(c) for c in outputs.values()])))

    second = (
        LinearRegression(regParam=1e-3, featuresCol="__stack", labelCol=LABEL, weightCol=WEIGHT)
        if regression
        else LogisticRegression(featuresCol="__stack", labelCol=LABEL, weightCol=WEIGHT, regParam=1e-3)
    ).fit(widen(held))
    train.unpersist()

    def predict(df: DataFrame) -> DataFrame:
        for name, model in whole.items():
            df = opinion(model, df, name)
        return second.transform(widen(df))

    return predict, whole


def goal_search(task: Task, goal: float = 0.85, trials: int = 8, seed: int = 42) -> tuple[list[dict], dict]:
    """Seeded random search over forest size and depth; best score, and whether it met the goal.

    All trials run; any score beats none, so negative metrics work too.
    """
    draw = random.Random(seed)
    # a forest draws its samples by partition and row, so both must depend on the rows alone
    train = task.part("train")
    parts, placed = train.sparkSession.sparkContext.defaultParallelism, F.xxhash64(FEATURES, LABEL)
    train = train.repartition(parts, placed).sortWithinPartitions(placed).persist()
    val = task.part("val").persist()
    metric, rows = primary_metric(task.problem), []
    kind = RandomForestRegressor if task.problem == "regression" else RandomForestClassifier
    seen: dict[tuple, float] = {}
    for i in range(trials):
        params = (draw.choice([10, 20, 30, 40, 50]), draw.choice([3, 5, 8]))
        if params not in seen:
            model = kind(
                numTrees=params[0], maxDepth=params[1], seed=seed, featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT
            ).fit(train)
            seen[params] = scores(model.transform(val), task.problem)[metric]
        rows.append({"trial": i + 1, "trees": params[0], "depth": params[1], "score": seen[params]})
    train.unpersist()
    val.unpersist()
    best = max(rows, key=lambda r: r["score"])
    return rows, {"best_score": best["score"], "goal_met": best["score"] >= goal, "trees": best["trees"], "depth": best["depth"], "target_score": goal}
