"""Near duplicates by SimHash, found through covering bit masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import append, field
from tablewright.operators.components import components
from tablewright.session import stored

SHINGLE_WORDS = 3
RADIUS = 3
#: buckets of more fingerprints than this are divided by a second family of masks
BUCKET = 2048
BITS = 64
SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, size: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash over the XXH64 of all word shingles (repeats count), as a signed number.

    Words are what is left between ASCII white space after lower-casing A-Z. A text of fewer
    words than a shingle is one shingle; no words, no text: 0. A bit is set if more than half
    of the shingles' hashes have it.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    groups = zip(*[words[i:] for i in range(size)]) if len(words) >= size else [words]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in map(b" ".join, groups)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1)
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view("<i8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint", size: int = SHINGLE_WORDS) -> DataFrame:
    """``df`` plus the fingerprint of ``text`` as a bigint."""

    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([fingerprint(t.as_py(), size) for t in texts], pa.int64())]

        return work

    return append(df, {"text": F.col(text).cast("binary")}, [field(name, "bigint")], start)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions so that any ``radius`` positions are outside of one of them.

    Every position gets a vector of ``radius + 1`` bits other than zero, and every such vector
    ``v`` makes a mask of the positions whose vector has an odd product with ``v``. ``radius``
    vectors cannot span a space of one dimension more, so some ``v`` is orthogonal to all of
    them: two numbers that differ in at most ``radius`` positions agree under that mask.
    """
    codes = (1 << (radius + 1)) - 1
    return [
        sum(1 << bit for i, bit in enumerate(bits) if (((1 + i % codes) & v).bit_count() & 1)) for v in range(1, codes + 1)
    ]


def mask_levels(radius: int) -> tuple[list[int], list[list[int]]]:
    """The masks of all tables, and for each table the masks that also cover its other bits.

    A mask keeps about half of the bits it is made for, so members of a bucket of the second
    level differ in about ``64 / 4`` bits only: it cannot hold more than some thousand
    different fingerprints, however many documents there are (2 ** 14 for radius 3).
    """
    first = covering_masks(list(range(BITS)), radius)
    second = [[m | s for s in covering_masks([b for b in range(BITS) if not m >> b & 1], radius)] for m in first]
    return first, second


def bucket_links(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join every group reachable within ``radius`` inside one bucket, one per joined member.

    A member already reached is never compared again, so a tight group costs one comparison
    per member and only the rest is looked at further.
    """
    left = np.unique(members).view(np.uint64)
    links = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                links += [(int(root.view(np.int64)), int(x)) for x in found.view(np.int64)]
    return links


def _links_of(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [p for b in batch.column(0) for p in bucket_links(np.asarray(b.values, dtype=np.int64), radius)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"]
            )

    return buckets.mapInArrow(run, "a bigint, b bigint")


def near_links(prints: DataFrame, radius: int = RADIUS, name: str = "fingerprint", bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links whose components are those of all pairs of distinct fingerprints
    within ``radius`` bits.

    Fingerprints must be distinct. Every one goes to a bucket per mask; buckets of one member
    are dropped after a count, buckets of up to ``bucket`` members are compared inside one
    task, and larger ones are first divided by the second family of masks, which keeps every
    close pair together somewhere and bounds a bucket for good. All comparisons are exact.
    """
    first, second = mask_levels(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col(name).bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(first)])
    placed = prints.select(F.col(name).alias("f"), F.inline(keys))
    busy = stored(placed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    small = placed.join(busy.filter(F.col("n") <= bucket).select("t", "k"), ["t", "k"])
    small = small.groupBy("t", "k").agg(F.collect_list("f").alias("l")).select("l")
    found = _links_of(small, radius)
    large = busy.filter(F.col("n") > bucket).select("t", "k")
    if not large.isEmpty():
        masks = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in second])
        members = placed.join(large, ["t", "k"]).select("f", "t", F.posexplode(F.get(masks, F.col("t"))).alias("s", "m"))
        again = members.groupBy("t", "s", F.col("f").bitwiseAND(F.col("m")).alias("k"))
        found = found.unionByName(_links_of(again.agg(F.collect_list("f").alias("l")).filter(F.size("l") > 1).select("l"), radius))
    return found


def text_hash(text: Column) -> Column:
    """Two XXH64 of a text: 128 bits that stand for it."""
    return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g"))


def near_duplicate_groups(df: DataFrame, ids: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(ids, text_hash, fingerprint, component_id, group)`` of every row: the smallest id that
    can be reached over links of at most ``radius`` differing bits, the row's own id included.

    Equal fingerprints are one node, so copies cost nothing beyond their rows. Null ids take
    part but lose against any other; a component of null ids has a null ``component_id``. Null
    and empty texts have fingerprint 0 and are linked like any other. Repeated ids are kept as
    rows of their own. No rows give no rows. ``text_hash`` tells rows of one id apart, and
    ``group`` (a fingerprint) names the component also where ids are null.
    """
    slim = df.select(F.col(ids).alias("id"), text_hash(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    rows = stored(with_fingerprint(slim).drop("text"))
    nodes = stored(rows.groupBy("fingerprint").agg(F.min("id").alias("least")))
    labels = stored(components(near_links(nodes)))
    known = stored(labels.join(nodes, labels["node"] == nodes["fingerprint"]).select("node", "label", "least"))
    smallest = stored(known.groupBy("label").agg(F.min("least").alias("component_id")))
    linked = stored(known.select("node", "label").join(smallest, "label"))
    every = nodes.join(linked, nodes["fingerprint"] == linked["node"], "left").select(
        "fingerprint",
        F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("label", "fingerprint").alias("group"),
    )
    out = rows.join(stored(every), "fingerprint")
    return out.select(F.col("id").alias(ids), "text_hash", "fingerprint", "component_id", "group")


def drop_near_duplicates(df: DataFrame, ids: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``df`` with one row of each group of near duplicates: that of the smallest id.

    Rows with the same id and text are one another's copies; one of them stays. Among rows of
    the smallest id whose texts differ, the smaller text hash stays. A group whose ids are all
    null keeps one row too. All columns of ``df`` are kept, whatever their names. No rows give no rows.
    """
    names = {c: f"d{i}" for i, c in enumerate(df.columns)}
    df = df.toDF(*names.values())
    groups = near_duplicate_groups(df, names[ids], names[text], radius)
    ids, text = names[ids], names[text]
    alike = groups.groupBy("group", ids, "text_hash").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col(ids).isNull().alias("no_id"), F.col(ids).alias("id"), "text_hash", "n")
    best = stored(stored(alike).groupBy("group").agg(F.min(order).alias("m")).select("m.*"))
    keep = best.select(F.col("id").alias("__b"), F.col("text_hash").alias("__h"), F.col("n").alias("__n"))
    marked = df.withColumns({"__id": F.col(ids), "__hash": text_hash(F.col(text))})
    joined = marked.join(keep, F.col("__id").eqNullSafe(F.col("__b")) & (F.col("__hash") == F.col("__h")))
    if (best.agg(F.max("n")).first()[0] or 0) > 1:
        once = joined.filter("__n > 1").dropDuplicates(["__id", "__hash"])
        joined = joined.filter("__n = 1").unionByName(once)
    return joined.select(*[F.col(n).alias(c) for c, n in names.items()])
