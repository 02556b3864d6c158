"""Find passages of test items in training documents, and remove the spans or the documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import append, field, structs, without
from tablewright.session import stored

WINDOW = 13
#: a document is contaminated if at least one word in this many is hit
ONE_IN = 20
#: bytes of item text whose windows one task holds; more items take more passes
BLOCK_BYTES = 4 << 20
#: bytes of document text worked through at once
_CHUNK_BYTES = 1 << 21
#: every byte that is no part of a word becomes a space, A-Z become a-z
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_BASE = 0x9E3779B97F4A7C15


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and everything beyond ASCII."""
    return text.translate(_WORD_BYTES).split() if text else []


class WindowIndex:
    """A hash set of the word windows of some items, by window length.

    Words are numbered, so a window is a row of numbers; its hash finds a candidate row and the
    numbers themselves confirm it.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.words: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for name, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(name)
        self.by_size = {size: self._table(size, rows) for size, rows in sorted(found.items())}

    @staticmethod
    def _table(size: int, rows: dict[tuple[int, ...], set[str]]):
        ids = np.array(list(rows), dtype=np.int64).reshape(-1, size)
        base = _BASE
        while True:
            powers = np.array([pow(base, j, 1 << 64) for j in range(size)], dtype=np.uint64)
            hashes = (ids.astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64)
            order = np.argsort(hashes)
            if len(np.unique(hashes)) == len(hashes):
                break
            base += 2  # another odd base: two windows of the set have one hash
        owners = [sorted(x) for x in rows.values()]
        return base, hashes[order], ids[order], [owners[i] for i in order]

    def hits(self, numbers: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int, list]]:
        """``(positions, rows, size, owners)`` per window length; ``numbers`` has 0 for unknown words."""
        out = []
        gaps = np.concatenate([[0], np.cumsum(numbers == 0)])
        for size, (base, hashes, ids, owners) in self.by_size.items():
            if len(numbers) < size:
                continue
            at = np.flatnonzero(gaps[size:] == gaps[:-size])  # windows of known words only
            if not len(at):
                continue
            value = np.zeros(len(at), dtype=np.uint64)
            for j in range(size):
                value += numbers[at + j].astype(np.uint64) * np.uint64(pow(base, j, 1 << 64))
            row = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            same = hashes[row] == value
            at, row = at[same], row[same]
            true = np.all(numbers[at[:, None] + np.arange(size)] == ids[row], axis=1)
            out.append((at[true], row[true], size, owners))
        return out


def _scan(index: WindowIndex, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """Per document: the hit word ranges ``[from, to)``, joined where they touch, and the items found."""
    sizes = np.array([len(d) for d in docs])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # one unknown word between documents
    numbers = np.zeros(starts[-1], dtype=np.int64)
    known = index.words.get
    for start, doc in zip(starts, docs):
        numbers[start : start + len(doc)] = [known(w, 0) for w in doc]
    edge = np.zeros(len(numbers) + 1, dtype=np.int64)
    items: dict[int, set[str]] = {}
    for at, row, size, owners in index.hits(numbers):
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        owner_doc = np.searchsorted(starts, at, side="right") - 1
        for d, r in np.unique(np.stack([owner_doc, row], axis=1), axis=0):
            items.setdefault(int(d), set()).update(owners[r])
    hit = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    change = np.diff(hit)
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    spans: dict[int, list[tuple[int, int]]] = {}
    for d, b, e in zip(np.searchsorted(starts, begin, side="right") - 1, begin, end):
        spans.setdefault(int(d), []).append((int(b - starts[d]), int(e - starts[d])))
    return [(spans.get(i, []), items.get(i, set())) for i in range(len(docs))]


def _join_spans(a: list, b: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_HITS = [structs("hit_spans", start="bigint", end="bigint"), field("hit_items", "array<string>"), field("n_words", "bigint")]


def _one_pass(df: DataFrame, index, text: str, first: bool) -> DataFrame:
    """Add (or widen) the hit columns by the windows of one block of items."""
    reads = {"t": F.col(text).cast("binary")}
    if not first:
        reads |= {"s": F.col("hit_spans"), "i": F.col("hit_items")}

    def start():
        held = index.value

        def work(texts: pa.Array, spans: pa.Array | None = None, items: pa.Array | None = None) -> list[pa.Array]:
            found, counts, chunk, size = [], [], [], 0
            for i, t in enumerate(texts):
                t = t.as_py()
                chunk.append(words_of(t))
                size += len(t or b"")
                if size > _CHUNK_BYTES or i == len(texts) - 1:
                    found += _scan(held, chunk)
                    counts += [len(c) for c in chunk]
                    chunk, size = [], 0
            if spans is not None:
                before = zip(spans.to_pylist(), items.to_pylist())
                found = [(_join_spans([(x["start"], x["end"]) for x in s], n), {*j, *m}) for (s, j), (n, m) in zip(before, found)]
            rows = [[{"start": a, "end": b} for a, b in s] for s, _ in found]
            return [
                pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([sorted(m) for _, m in found], pa.list_(pa.string())),
                pa.array(counts, pa.int64()),
            ]

        return work

    return append(df, reads, _HITS, start)


def find_hits(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` plus ``hit_spans`` (ranges of word numbers), ``hit_items`` (sorted as text) and ``n_words``.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window,
    one without words has none. The windows of up to ``block_bytes`` of item text (measured
    first) are broadcast to the tasks, which scan whole texts without any shuffle of them. More
    items take one pass per block, each written out before the next. Null texts have no words,
    a null id counts as an empty name, repeated items as one. No items: nothing is hit.
    """
    listed = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("n"), F.col(item_text).cast("binary").alias("t"))
    listed = stored(listed.filter(F.length("t") > 0).distinct())
    total = listed.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("t"), F.lit(blocks))
    context = docs.sparkSession.sparkContext
    out = docs
    for i in range(blocks):
        rows = listed.filter(block == i).collect()
        index = WindowIndex([(r["n"], bytes(r["t"])) for r in rows], window)
        out = _one_pass(out if i == 0 else stored(out), context.broadcast(index), text, i == 0)
    return out


def contamination(found: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """Add ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` to the result of ``find_hits``.

    ``items_sha256`` is that of the item names, sorted as text and joined by commas.
    """
    spans = F.transform("hit_spans", lambda s: s["end"] - s["start"])
    n_hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return without(found, ["n_hit", "n_items", "items_sha256", "contaminated"]).withColumns({
        "n_hit": n_hit,
        "n_items": F.size("hit_items").cast("bigint"),
        "items_sha256": F.sha2(F.array_join("hit_items", ","), 256),
        "contaminated": (n_hit > 0) & (n_hit * one_in >= F.col("n_words")),
    })


def drop_documents(docs: DataFrame, items: DataFrame, text: str = "text", one_in: int = ONE_IN, **how) -> DataFrame:
    """``docs`` without contaminated rows; columns and all other rows stay as they are.

    Null and empty texts have no words and stay; copies are judged alike. Columns may have the names that
    ``find_hits`` adds, in any case. No rows give no rows, and no items drop nothing."""
    taken = {c.lower() for c in docs.columns} & {"hit_spans", "hit_items", "n_words"}
    names = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c.lower() in taken and c != text}
    found = contamination(find_hits(docs.withColumnsRenamed(names), items, text, **how).select(
        *[F.col(f"`{names.get(c, c)}`").alias(f"__d{i}") for i, c in enumerate(docs.columns)], "hit_spans", "hit_items", "n_words"
    ), one_in)
    return found.filter(~F.col("contaminated")).select(*[F.col(f"__d{i}").alias(c) for i, c in enumerate(docs.columns)])


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` with the hit words cut out of ``text``, from the first byte of a span's first word to
    the last byte of its last word; texts without a hit stay byte for byte, null ones null.

    Every row stays, copies too, with its columns whatever their names. No rows give no rows, and no items
    change nothing."""
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    found = find_hits(docs.toDF(*names.values()), items, names[text], **how)

    def start():
        def work(texts: pa.Array, spans: pa.Array) -> list[pa.Array]:
            return [pa.array([_cut(t.as_py(), s.as_py()) for t, s in zip(texts, spans)], pa.string())]

        return work

    reads = {"t": F.col(names[text]).cast("binary"), "s": F.col("hit_spans")}
    cut = append(found, reads, [field(names[text], "string")], start, [f.name for f in _HITS])
    return cut.select(*[F.col(n).alias(c) for c, n in names.items()])


def _cut(text: bytes | None, spans: list[dict]) -> str | None:
    if not text or not spans:
        return None if text is None else text.decode("utf-8", "replace")
    plain = np.frombuffer(text.translate(_WORD_BYTES), dtype=np.uint8) != 32
    change = np.diff(np.concatenate([[0], plain.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    out, last = [], 0
    for s in spans:
        out.append(text[last : begin[s["start"]]])
        last = int(end[s["end"] - 1])
    return b"".join([*out, text[last:]]).decode("utf-8", "replace")
