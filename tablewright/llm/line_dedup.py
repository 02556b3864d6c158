"""Drop lines that many documents share, through a sharded minimal perfect hash of their keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import ASCII_SPACE, append, field
from tablewright.session import stored

MIN_DOCS = 10
MIN_CHARS = 1
#: keys of one shard of the perfect hash
SHARD_KEYS = 1 << 17
#: shards that are sent to the tasks together (about 17 bytes a key: some 70 MB); more take more passes
SHARDS_AT_ONCE = 32
#: line keys a task adds up before it passes them on
_HELD = 200_000
#: bits of a level of the perfect hash per key that is left
_GAMMA = 2


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return line.strip(ASCII_SPACE).lower()


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """128 bits per key, as two unsigned numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<u8").reshape(-1, 2)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """Another well-spread number of 64 bits for each key and seed."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, as bit arrays by level.

    A level hashes the keys that are left into ``_GAMMA`` bits each; keys alone on their bit
    settle there, the others go on. The number of a key is the number of set bits before its
    own. Some three bits a key; building and looking up work on whole arrays.
    """

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels, self.size = [], 0
        for bits, words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((bits, words, np.cumsum(ones) - ones + self.size))
            self.size += int(ones.sum())

    @staticmethod
    def build(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """``(bits, 64-bit words)`` of every level; ``keys`` must be distinct."""
        levels, left = [], keys
        while len(left):
            size = -(-_GAMMA * len(left) // 64) * 64
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append((size, np.packbits(alone, bitorder="little").view("<u8")))
            left = left[~alone[at]]
        return levels

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers ``0..size-1`` of the keys; -1 or any number for a key that was not built in."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for depth, (size, words, before) in enumerate(self.levels):
            if not len(todo):
                break
            at = _mix(keys[todo], depth) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            settled = (words[word] >> bit) & np.uint64(1) == 1
            w, below = word[settled], (np.uint64(1) << bit[settled]) - np.uint64(1)
            out[todo[settled]] = before[w] + np.bitwise_count(words[w] & below)
            todo = todo[~settled]
        return out


class ShardIndex:
    """Some shards: a perfect hash each, with arrays of 64-bit fingerprints and of counts."""

    def __init__(self, shards: int, rows: list):
        self.shards = shards
        self.held = {}
        for r in rows:
            levels = [(int(n), np.frombuffer(b, dtype="<u8")) for n, b in zip(r["sizes"], r["bits"])]
            prints, counts = np.frombuffer(r["prints"], dtype="<u8"), np.frombuffer(r["counts"], dtype="<i8")
            twins = np.frombuffer(r["twins"], dtype="<i8").reshape(-1, 3)
            self.held[r["shard"]] = (PerfectHash(levels), prints, counts, twins)

    def counts_of(self, hashes: np.ndarray) -> np.ndarray:
        """Documents of each key; 0 if it is not in these shards."""
        out = np.zeros(len(hashes), dtype=np.int64)
        shard = shard_of(hashes[:, 0], self.shards)
        for s, (perfect, prints, counts, twins) in self.held.items():
            mine = np.flatnonzero(shard == s)
            if not len(mine):
                continue
            at = perfect.find(hashes[mine, 0])
            true = (at >= 0) & (prints[at] == hashes[mine, 1])
            out[mine[true]] = counts[at[true]]
            for first, second, docs in twins:
                own = hashes[mine].view(np.int64)
                out[mine[(own[:, 0] == first) & (own[:, 1] == second)]] = docs
        return out


def shard_of(first: np.ndarray, shards: int) -> np.ndarray:
    return ((first >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def common_lines(df: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(h1, h2, docs)``: the 128-bit hash of every line key of at least ``min_chars`` code points
    that occurs in at least ``min_docs`` rows, with their number. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            pairs = np.frombuffer(b"".join(held), dtype="<i8").reshape(-1, 2)
            columns = [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "n"])

        for batch in batches:
            for t in batch.column(0):
                keys = {line_key(x) for x in (t.as_py() or b"").split(b"\n")}
                for k in keys:
                    if len(k) >= min_chars and (min_chars <= 1 or len(k.decode("utf-8", "replace")) >= min_chars):
                        h = xxhash.xxh3_128_digest(k)
                        held[h] = held.get(h, 0) + 1
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    parts = df.select(F.col(text).cast("binary")).mapInArrow(run, "h1 bigint, h2 bigint, n bigint")
    return parts.groupBy("h1", "h2").agg(F.sum("n").alias("docs")).filter(F.col("docs") >= min_docs)


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """One row per shard of ``(h1, h2, docs)``: the perfect hash of its ``h1`` and the arrays.

    Keys that share ``h1`` with an earlier one (the first such pair is expected at about four
    billion keys) are listed beside the arrays.
    """
    shard = F.pmod(F.shiftrightunsigned("h1", 32), F.lit(shards))

    def build(key, part):
        import pandas as pd

        again = part["h1"].duplicated()
        own = part[~again]
        first = own["h1"].to_numpy(dtype=np.int64).view(np.uint64)
        levels = PerfectHash.build(first)
        at = PerfectHash(levels).find(first)
        prints, counts = np.empty(len(at), dtype="<u8"), np.empty(len(at), dtype="<i8")
        prints[at] = own["h2"].to_numpy(dtype=np.int64).view(np.uint64)
        counts[at] = own["docs"].to_numpy(dtype=np.int64)
        twins = part.loc[again, ["h1", "h2", "docs"]].to_numpy(dtype="<i8")
        row = {"shard": key[0], "sizes": [n for n, _ in levels], "bits": [w.tobytes() for _, w in levels]}
        return pd.DataFrame([row | {"prints": prints.tobytes(), "counts": counts.tobytes(), "twins": twins.tobytes()}])

    kind = "shard bigint, sizes array<bigint>, bits array<binary>, prints binary, counts binary, twins binary"
    return keys.withColumn("shard", shard).groupBy("shard").applyInPandas(build, kind)


_FIELDS = [field("n_lines", "bigint"), field("n_dropped", "bigint"), field("most_docs", "bigint")]


def _drop(df: DataFrame, text: str, index, first: bool) -> DataFrame:
    reads = {"t": F.col(text).cast("binary")}
    if not first:
        reads |= {f.name: F.col(f.name) for f in _FIELDS}

    def start():
        held = index.value

        def work(texts: pa.Array, *before: pa.Array) -> list[pa.Array]:
            lines = [(t.as_py() or b"").split(b"\n") for t in texts]
            sizes = [len(x) for x in lines]
            keys = [line_key(x) for d in lines for x in d]
            count = held.counts_of(key_hashes(keys)) if keys else np.zeros(0, dtype=np.int64)
            kept, dropped, most, at = [], [], [], 0
            for t, d, n in zip(texts, lines, sizes):
                c = count[at : at + n]
                at += n
                gone = int((c > 0).sum())
                kept.append(b"\n".join(x for x, k in zip(d, c) if not k) if gone else t.as_py() or b"")
                dropped.append(gone)
                most.append(int(c.max()))
            if before:
                sizes = before[0].to_pylist()
                dropped = [a + b for a, b in zip(before[1].to_pylist(), dropped)]
                most = [max(a, b) for a, b in zip(before[2].to_pylist(), most)]
            return [pa.array(kept, pa.binary()).cast(pa.string()), *[pa.array(x, pa.int64()) for x in (sizes, dropped, most)]]

        return work

    return append(df, reads, [field(text, "string"), *_FIELDS], start)


def drop_common_lines(
    df: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
    shard_keys: int = SHARD_KEYS, shards_at_once: int = SHARDS_AT_ONCE,
) -> DataFrame:
    """``df`` with shared lines taken out of ``text``, plus ``n_lines`` (before), ``n_dropped`` and
    ``most_docs`` (documents of the most frequent line that went; 0 if none did).

    A line's key that occurs in at least ``min_docs`` rows loses all its lines everywhere; the
    other lines stay byte for byte, joined by a newline. Null and empty texts are one empty line
    and come back empty. Repeated rows count as documents of their own.

    The shared keys make a perfect hash in shards of about ``shard_keys``. Documents look their
    lines up in the arrays of ``shards_at_once`` shards, which bounds what is broadcast; more
    shards take further passes over the remaining lines, each written out first.
    """
    keys = stored(common_lines(df, text, min_docs, min_chars))
    shards = max(1, -(-keys.count() // shard_keys))
    built = stored(build_shards(keys, shards))
    context = df.sparkSession.sparkContext
    out = df
    for i in range(0, shards, shards_at_once):
        rows = built.filter((F.col("shard") >= i) & (F.col("shard") < i + shards_at_once)).collect()
        out = _drop(out if i == 0 else stored(out), text, context.broadcast(ShardIndex(shards, rows)), i == 0)
    return out
