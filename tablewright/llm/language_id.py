"""Languages of a document as a mixture: expectation-maximisation over its words' n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import append, field, structs

UNKNOWN = "und"
#: hashed trigram buckets per language
BUCKETS = 1 << 15
#: languages a model may have: it then has 256 * 32,768 four-byte numbers, 32 MB, in every task
MOST_LANGUAGES = 256
#: added to every bucket's count
SMOOTHING = 0.5
#: overlapping trigrams see every byte three times
TEMPER = 1.0 / 3.0
#: a further language must raise the log-likelihood by this many times the logarithm of the words
PENALTY = 3.0
ROUNDS = 25
SETTLED = 1e-3
_CHUNK_BYTES = 1 << 20
#: words of a long text whose scores wait to be folded into the different ones
_WAITING_WORDS = 1 << 18

#: ASCII letters and all bytes beyond ASCII stay, everything else becomes a space
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def _trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, place)`` of the byte trigrams around every letter; a word's own edges are spaces."""
    x = _LETTERS[data]
    place = np.flatnonzero(x[1:-1] != 32) + 1
    gram = x[place - 1] << np.uint32(16) | x[place] << np.uint32(8) | x[place + 1]
    bucket = (gram * np.uint32(2654435761)) >> np.uint32(32 - 15)
    return bucket, place


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a space around each, and where each begins."""
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8), starts


def lowered(text: Column) -> Column:
    return F.lower(text).cast("binary")


class LanguageModel:
    """Smoothed trigram log-likelihoods of some languages; bounded by ``MOST_LANGUAGES``."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        total = counts.sum(axis=1, keepdims=True) + SMOOTHING * counts.shape[1]
        self.scores = np.ascontiguousarray((TEMPER * np.log((counts + SMOOTHING) / total)).T.astype(np.float32))

    def word_scores(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(first place, log-likelihood per language)`` of every word in ``data``."""
        bucket, place = _trigrams(data)
        if not len(place):
            return place, np.zeros((0, len(self.names)), dtype=np.float32)
        first = np.flatnonzero(np.diff(place, prepend=-2) > 1)
        return place[first], np.add.reduceat(self.scores[bucket], first, axis=0)

    @property
    def chunk_bytes(self) -> int:
        """Bytes of text to score at once: a letter takes four bytes per language, 16 MB in all at most."""
        return max(1 << 14, min(_CHUNK_BYTES, (1 << 22) // max(1, len(self.names))))

    def mixtures(self, texts: list[bytes]) -> list[tuple[list[tuple[str, float]], int]]:
        """Per text the chosen languages with their shares, largest first, and the number of words."""
        if any(len(t) > self.chunk_bytes for t in texts):
            out = []
            for t in texts:
                if len(t) > self.chunk_bytes:
                    table, times = self._long_scores(t)
                    out += self._infer(np.zeros(len(table), dtype=np.int64), table, 1, times)
                else:
                    out += self.mixtures([t])
            return out
        data, starts = _joined(texts)
        at, table = self.word_scores(data)
        return self._infer(np.searchsorted(starts, at - 1, side="right") - 1, table, len(texts))

    def _long_scores(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Different rows of word scores of a long text, and how many words have each: memory grows with
        its different words, not with its length."""
        table, times, waiting = np.zeros((0, len(self.names)), dtype=np.float32), np.zeros(0), []
        size = 0

        def folded():
            rows = np.concatenate([table, *waiting])
            counts = np.concatenate([times, *[np.ones(len(w)) for w in waiting]])
            same, place = np.unique(rows, axis=0, return_inverse=True)
            return same, np.bincount(place.reshape(-1), weights=counts, minlength=len(same))

        for part in _word_parts(text, self.chunk_bytes):
            waiting.append(self.word_scores(_joined([part])[0])[1])
            size += len(waiting[-1])
            if size > len(table) + _WAITING_WORDS:
                table, times = folded()
                waiting, size = [], 0
        return folded()

    def _infer(
        self, owner: np.ndarray, table: np.ndarray, docs: int, times: np.ndarray | None = None
    ) -> list[tuple[list[tuple[str, float]], int]]:
        """Mixtures from the word scores in ``table``, each of document ``owner`` and found ``times`` times."""
        rows_of = np.bincount(owner, minlength=docs)
        times = np.ones(len(owner)) if times is None else times
        words = np.bincount(owner, weights=times, minlength=docs)
        out: list[tuple[list[tuple[str, float]], int]] = [([], 0)] * docs
        live = np.flatnonzero(rows_of)
        if not len(live) or not self.names:
            return out
        n = rows_of[live]
        begin = _begins(n)
        place = np.repeat(np.arange(len(live)), n)
        like = table.astype(np.float64)
        like -= like.max(axis=1, keepdims=True)
        like = np.exp(like)
        shares = np.full((len(live), len(self.names)), 1.0 / len(self.names))
        shares, _ = _expectation_maximisation(like, times, n, shares)
        order = np.argsort(-shares, axis=1, kind="stable")
        best = np.zeros((len(live), len(self.names)))
        best[np.arange(len(live)), order[:, 0]] = 1.0
        top = np.add.reduceat(times * np.log(np.maximum(like[np.arange(len(place)), order[place, 0]], 1e-300)), begin)
        open_docs = np.arange(len(live))
        for k in range(2, len(self.names) + 1):
            # the k languages of the largest shares, fitted anew by themselves
            pick = np.isin(place, open_docs, assume_unique=False) if len(open_docs) < len(live) else slice(None)
            start = np.zeros((len(open_docs), len(self.names)))
            rows = np.arange(len(open_docs))[:, None]
            chosen = order[open_docs, :k]
            start[rows, chosen] = np.maximum(shares[open_docs[:, None], chosen], 1e-3)
            start /= start.sum(axis=1, keepdims=True)
            fitted, value = _expectation_maximisation(like[pick], times[pick], n[open_docs], start)
            value -= PENALTY * np.log(words[live][open_docs] + 1.0)
            better = value > top[open_docs]
            open_docs, fitted, value = open_docs[better], fitted[better], value[better]
            if not len(open_docs):
                break
            best[open_docs], top[open_docs] = fitted, value
        for d, row in zip(live, best):
            ranked = np.argsort(-row, kind="stable")
            out[d] = ([(self.names[i], float(min(1.0, row[i]))) for i in ranked if row[i] > 0], int(words[d]))
        return out


def _word_parts(text: bytes, size: int = _CHUNK_BYTES) -> Iterator[bytes]:
    """A long text in parts cut at spaces (or, in one endless word, anywhere)."""
    start = 0
    while start < len(text):
        cut = text.find(b" ", start + size, start + 2 * size)
        cut = min(len(text), start + 2 * size) if cut < 0 else cut
        yield text[start:cut]
        start = cut


def _begins(n: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs of ``n`` rows begins."""
    return np.concatenate([[0], np.cumsum(n)[:-1]])


def _expectation_maximisation(like, times, n, shares):
    """Shares of each document that fit its words best, from the given start, and the log-likelihood.

    ``like`` holds the documents' rows one after another, ``n`` of each, a row counting ``times`` times. A
    document is done when its own shares have settled, whatever others do, so its result depends on
    its words alone. A share of zero stays zero, which is how a smaller set of languages is fitted.
    """
    shares = shares.copy()
    total_words = np.add.reduceat(times, _begins(n))
    moving, left, often, size = np.arange(len(n)), like, times, n
    for _ in range(ROUNDS):
        begin = _begins(size)
        weighted = left * np.repeat(shares[moving], size, axis=0)
        weighted *= (often / np.maximum(weighted.sum(axis=1), 1e-300))[:, None]
        new = np.add.reduceat(weighted, begin, axis=0) / total_words[moving][:, None]
        unsettled = np.abs(new - shares[moving]).max(axis=1) >= SETTLED
        shares[moving] = new
        if not unsettled.any():
            break
        if not unsettled.all():
            rows = np.repeat(unsettled, size)
            moving, left, often, size = moving[unsettled], left[rows], often[rows], size[unsettled]
    seen = (like * np.repeat(shares, n, axis=0)).sum(axis=1)
    return shares, np.add.reduceat(times * np.log(np.maximum(seen, 1e-300)), _begins(n))


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Count the trigrams of every row with a label; tasks add up before the shuffle.

    Rows without a label or text teach nothing. More than ``MOST_LANGUAGES`` labels are an
    error. The model's size is languages times buckets, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1).to_pylist()):
                table = counts.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
                for part in _word_parts(t.as_py()):
                    table += np.bincount(_trigrams(_joined([part])[0])[0], minlength=BUCKETS)
        for name, table in counts.items():
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(table[used])], names=["lang", "bucket", "n"]
            )

    known = df.select(lowered(F.col(text)).alias("t"), F.col(lang).cast("string").alias("l")).filter("t IS NOT NULL AND l IS NOT NULL")
    totals = known.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # by language one array of pairs: at most MOST_LANGUAGES rows come to the driver
    listed = totals.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))
    rows = sorted(listed.limit(MOST_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang!r}")
    counts = np.zeros((len(rows), BUCKETS))
    for i, r in enumerate(rows):
        counts[i, np.array(r["b"], dtype=np.int64)] = r["n"]
    return LanguageModel([r["lang"] for r in rows], counts)


_FIELDS = [field("lang_pred", "string"), field("score", "double"), structs("languages", lang="string", share="double"), field("lang_words", "bigint")]


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` plus ``lang_pred``, ``score`` (its share of the words, 0 to 1), ``languages`` (the chosen
    set with shares, largest first) and ``lang_words``.

    Shares of all languages are fitted to the words' likelihoods; then the sets of the one, two,
    three … largest are fitted by themselves, and a larger set is taken only while it raises the
    log-likelihood by more than a penalty. Ties go to the language whose name sorts first. A text
    that is null, has no letter, or meets a model of no languages is ``und`` with score 0. Texts
    are read whole; no rows give no rows. Columns with these names are replaced. A row's result
    depends on its text and the model alone, not on the rows beside it.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))

    def start():
        held = sent.value

        def work(texts: pa.Array, letters: pa.Array) -> list[pa.Array]:
            found, group, size = [], [], 0
            for t in texts:
                t = t.as_py() or b""
                if group and size + len(t) > held.chunk_bytes:
                    found += held.mixtures(group)
                    group, size = [], 0
                group.append(t)
                size += len(t)
            found += held.mixtures(group) if group else []
            rows = [(m, n) if ok and m else ([], 0) for (m, n), ok in zip(found, letters.to_pylist())]
            listed = [[{"lang": a, "share": s} for a, s in m] for m, _ in rows]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            return [
                pa.array([m[0][0] if m else UNKNOWN for m, _ in rows], pa.string()),
                pa.array([m[0][1] if m else 0.0 for m, _ in rows], pa.float64()),
                pa.array(listed, kind),
                pa.array([n for _, n in rows], pa.int64()),
            ]

        return work

    return append(df, {"t": lowered(F.col(text)), "l": has_letter}, _FIELDS, start)


def held_out(ids: Column) -> Column:
    """True for the fifth of the ids that no model learns from; a missing id is held out too."""
    return F.coalesce(F.pmod(F.crc32(ids.cast("string")), F.lit(5)) == 0, F.lit(True))


def identify(df: DataFrame, ids: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` with the languages predicted by a model of its own labelled rows outside the held-out fifth."""
    return predict(df, train(df.filter(~held_out(F.col(ids))), text, lang), text)


def keep_identified(df: DataFrame, ids: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """``df`` without rows of no language (``und``) and rows in which no language has a share of ``least``.

    Null and empty texts are ``und`` and go; null ids are held out and may stay. Copies are judged alike and
    all stay. Columns keep their names, also those that ``predict`` would add. No rows give no rows.
    """
    names = {c: f"__d{i}" for i, c in enumerate(df.columns)}
    found = identify(df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names[ids], names[text], names[lang])
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(n).alias(c) for c, n in names.items()])
