"""Graded quality by ordinal regression: hashed-text weights shared by all grades, ordered thresholds."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import append, field
from tablewright.session import stored

#: hashed features; the model is this many numbers whatever the data
FEATURES = 1 << 18
#: rated rows the model is fitted on, those of the smallest hash of their id and text (a documented bound)
FIT_ROWS = 20_000
#: a feature must occur in this many of the fitted rows to get a weight
LEAST_ROWS = 5
ROUNDS = 200
RIDGE = 1e-3
STEP = 0.05
#: bytes of one slice of a long text that is split into words at once
_SLICE = 1 << 20
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[*range(97, 123)]] = 1
_KINDS[[*range(65, 91)]] = 2
_KINDS[[*range(48, 58)]] = 3
_KINDS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
_KINDS[[*range(128, 256)]] = 5
_SHAPES = ("lower", "upper", "digit", "mark", "wide")


def _bucket(token: bytes) -> int:
    return zlib.crc32(token) & (FEATURES - 1)


def features(text: bytes | None) -> np.ndarray:
    """Distinct hashed features of a whole text, sorted.

    Its lower-cased words without marks at their ends, its marks, and its shape: the shares of
    letters, capitals, digits and marks, of distinct words, and its length, each as a step on a
    short scale. A null or empty text has its shape only.
    """
    data = text or b""
    kinds = np.bincount(_KINDS[np.frombuffer(data, dtype=np.uint8)], minlength=6)[1:]
    words, total = set(), 0
    for start, end in _cuts(data):
        part = data[start:end].lower().split()
        total += len(part)
        words.update(part)
    tokens = set()
    for w in words:
        core = w.strip(_MARKS)
        tokens.add(core)
        if len(core) != len(w):
            tokens.add(b"\x00" + w[len(w.rstrip(_MARKS)) :])
    tokens.discard(b"")
    shown = max(1, int(kinds.sum()))
    for name, n in zip(_SHAPES, kinds):
        tokens.add(f"\x01{name}{_step(n / shown)}".encode())
    tokens.add(f"\x01fresh{_step(len(words) / max(1, total))}".encode())
    tokens.add(f"\x01size{int(np.log2(total + 1))}".encode())
    return np.unique(np.fromiter(map(_bucket, tokens), dtype=np.int64, count=len(tokens)))


_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def _step(share: float) -> int:
    """0 to 12: nothing, then steps of about a doubling up to a half, then tenths."""
    if share <= 0:
        return 0
    return int(7 + (share - 0.5) * 10) if share >= 0.5 else max(1, int(7 + np.log2(share)))


def _cuts(data: bytes):
    start = 0
    while start < len(data):
        cut = data.find(b" ", start + _SLICE)
        cut = len(data) if cut < 0 else cut
        yield start, cut
        start = cut


class OrdinalModel:
    """P(grade >= k) = sigmoid(weights · features - threshold k), thresholds in rising order."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def tails(self, feats: list[np.ndarray]) -> np.ndarray:
        """``(rows, grades - 1)``: the probabilities of at least the second, third … grade."""
        score = np.array([self.weights[f].sum(dtype=np.float64) for f in feats])
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        steps = np.diff(np.array(self.grades, dtype=np.float64))
        return self.grades[0] + tails @ steps if len(steps) else np.full(len(tails), float(self.grades[0]))


def _fit(grades: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> OrdinalModel:
    """Maximum likelihood with a ridge by Adam on all rows at once; a few hundred sparse passes."""
    levels = np.unique(grades)
    place = np.searchsorted(levels, grades)
    used, slim = np.unique(columns, return_inverse=True)
    common = np.bincount(slim) >= min(LEAST_ROWS, len(grades))
    keep = common[slim]
    rows, slim = rows[keep], (np.cumsum(common) - 1)[slim[keep]]
    used = used[common]
    n, d, k = len(grades), len(used), len(levels)
    weights = np.zeros(FEATURES, dtype=np.float32)
    if k < 2:
        return OrdinalModel([int(x) for x in levels], weights, np.zeros(0))
    above = np.array([(place >= j).mean() for j in range(1, k)])
    # thresholds as a first value and positive gaps, which keeps them in order
    start = -np.log(above / (1 - above))
    theta = np.concatenate([np.zeros(d), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, ROUNDS + 1):
        w, first, gaps = theta[:d], theta[d], np.exp(theta[d + 1 :])
        cut = first + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(rows, w[slim], minlength=n)
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        upper, lower = _sigmoid(edge[place + 1] - eta), _sigmoid(edge[place] - eta)
        p = np.maximum(upper - lower, 1e-12)
        up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_eta = (up - low) / n  # derivative of the mean loss
        g_cut = np.array([(low[place == j].sum() - up[place == j - 1].sum()) / n for j in range(1, k)])
        g_gap = np.cumsum(g_cut[::-1])[::-1][1:] * gaps
        grad = np.concatenate([np.bincount(slim, g_eta[rows], minlength=d) + RIDGE * w, [g_cut.sum()], g_gap])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights[used] = theta[:d]
    return OrdinalModel([int(x) for x in levels], weights, theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(rated: DataFrame, text: str = "text", grade: str = "grade", key: str | None = None, rows: int = FIT_ROWS) -> OrdinalModel:
    """Fit on at most ``rows`` distinct rated rows (all, if there are fewer): those of the smallest
    hash of ``key`` and text, so a run repeated picks the same ones. A row repeated counts once,
    rows without a grade are passed over.

    Features are made in the tasks; only the sample's feature numbers come to the driver. No
    rated row gives a model of one grade, 0.
    """

    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([features(t.as_py()) for t in texts], pa.list_(pa.int32()))]

        return work

    known = rated.filter(F.col(grade).isNotNull()).select(
        F.col(grade).cast("int").alias("g"), F.col(text).cast("binary").alias("t"),
        F.xxhash64(F.lit(11), *([F.col(key)] if key else []), F.col(text)).alias("h"),
    )
    last = known.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    few = known.filter(F.col("h") <= F.lit(last)).dropDuplicates(["h", "g"])
    made = append(few.select("g", "t"), {"t": F.col("t")}, [field("f", "array<int>")], start, ["t"]).toArrow()
    if not made.num_rows:
        return OrdinalModel([0], np.zeros(FEATURES, dtype=np.float32), np.zeros(0))
    lists = made.column("f").combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    columns = np.asarray(lists.flatten(), dtype=np.int64)
    return _fit(np.asarray(made.column("g")), np.repeat(np.arange(len(sizes)), sizes), columns)


_FIELDS = [field("expected_grade", "double"), field("tail_prob", "double")]


def grade(df: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``df`` plus ``expected_grade`` and ``tail_prob``, the probability of the highest grade.

    Whole texts of any length count; null and empty texts are graded by their shape alone. A
    model of one grade gives that grade and probability 1. Columns with these names are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def start():
        held = sent.value

        def work(texts: pa.Array) -> list[pa.Array]:
            tails = held.tails([features(t.as_py()) for t in texts])
            top = tails[:, -1] if tails.shape[1] else np.ones(len(tails))
            return [pa.array(held.expected(tails), pa.float64()), pa.array(top, pa.float64())]

        return work

    return append(df, {"t": F.col(text).cast("binary")}, _FIELDS, start)


def select(df: DataFrame, model: OrdinalModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """The graded rows whose probability of the highest grade is at least ``least``."""
    return grade(df, model, text).filter(F.col("tail_prob") >= least)


def ratings(labels: DataFrame) -> Column:
    """Grade of a label row: one point for quality, one for not being toxic; null if either is missing."""
    return F.col("quality").cast("int") + (F.lit(1) - F.col("toxic").cast("int"))


def rated_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of ``FIT_ROWS`` rated rows (those of the smallest hash of the id) as a stored table
    of ``doc_id, text, grade``. So few ids and grades may be broadcast.

    Labels are joined to the documents by ``doc_id``; documents or labels without one take no part.
    """
    marked = labels.select("doc_id", ratings(labels).alias("grade")).filter("doc_id IS NOT NULL AND grade IS NOT NULL")
    few = marked.withColumn("h", F.xxhash64(F.lit(5), "doc_id")).orderBy("h", "grade").limit(FIT_ROWS).select("doc_id", "grade")
    return stored(docs.select("doc_id", "text").join(F.broadcast(stored(few)), "doc_id"))
