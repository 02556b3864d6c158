"""A Merkle manifest of a dataset, with a proof for every row made by pointer jumping.

Rows are leaves. The leaves of a group, in order, make one tree; the roots of the groups, in
order, make another. A node's *segment* is the digests of its siblings, and its pointer leads to
its parent. A self-join lets every pointer take its target's pointer and append its target's
segment, so the distance doubles; after ``ceil(log2(height))`` joins every leaf points to the
root and its segment is its proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import append, field
from tablewright.operators import ranking
from tablewright.session import stored

#: children of a node
FAN = 3
#: levels that one task builds of a block of leaves, so a block has at most FAN ** LEVELS of them
LEVELS = 6
#: bytes of nodes up to which a round sends them to every task; more are shuffled
MOST_SENT = 8 << 20
#: the number of the tree whose leaves are the groups' roots
TOP = -1
DIGEST = 32


def field_text(value: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of a row's fields, as lowercase hex; no two rows of different fields are the same text."""
    return F.sha2(F.concat(*[field_text(v) for v in values]).cast("binary"), 256)


def parent_digest(children: Sequence[bytes]) -> bytes:
    """SHA-256 of the children's digests as hex text."""
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def path(place: int, count: int, fan: int = FAN) -> Iterator[tuple[int, int]]:
    """From leaf ``place`` of ``count`` up to the root: the position in each run, and the run's length."""
    while count > 1:
        yield place % fan, min(fan, count - place // fan * fan)
        place, count = place // fan, -(-count // fan)


def fold(digest: bytes, steps: Iterator[tuple[int, int]], proof: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    at = 0
    for position, length in steps:
        siblings = [proof[i : i + DIGEST] for i in range(at, at + (length - 1) * DIGEST, DIGEST)]
        digest = parent_digest([*siblings[:position], digest, *siblings[position:]])
        at += (length - 1) * DIGEST
    return digest


_KEY = ["tree", "level", "place"]
_TO = [f"to_{c}" for c in _KEY]


def _node_type(carry: T.DataType) -> T.StructType:
    kinds = {
        "tree": T.LongType(), "level": T.IntegerType(), "place": T.LongType(), "count": T.LongType(), "digest": T.BinaryType(),
        "to_tree": T.LongType(), "to_level": T.IntegerType(), "to_place": T.LongType(), "segment": T.BinaryType(),
        "rise": T.IntegerType(), "role": T.StringType(), "carry": carry,
    }
    return T.StructType([T.StructField(k, v, True) for k, v in kinds.items()])


def _build_block(base: int, schema: pa.Schema):
    """The nodes over one block of ``FAN ** LEVELS`` neighbouring nodes of level ``base``.

    Roles: ``leaf`` for rows, ``node`` for nodes that have a parent here, ``top`` for the block's
    last node. A run of equal leaves comes as one row with its first place and its length.
    ``rise`` is the greatest distance down to a leaf.
    """
    size = FAN**LEVELS

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("first")
        tree, count, block = (table.column(c)[0].as_py() for c in ("tree", "count", "block"))
        low, high = block * size, min(count, (block + 1) * size)
        rows = []
        for i, (first, length) in enumerate(zip(table.column("first").to_pylist(), table.column("length").to_pylist())):
            rows += [i] * (min(high, first + length) - max(low, first))
        digests, rises = table.column("digest").to_pylist(), table.column("rise").to_pylist()
        line, rise = [digests[i] for i in rows], [rises[i] for i in rows]
        out = {name: [] for name in schema.names if name != "carry"}

        def emit(*values):
            for column, value in zip(out.values(), values):
                column.append(value)

        level, start, n = base, low, count
        while True:
            here = n == 1 or level == base + LEVELS
            if not here or (base == 0 and level == 0 and tree != TOP):
                up = (TOP, 0, tree) if tree != TOP and n <= FAN else (tree, level + 1, None)
                role = "leaf" if level == 0 and tree != TOP else "node"
                for i, own in enumerate(line):
                    run = i // FAN * FAN
                    siblings = b"".join(line[run:i] + line[i + 1 : run + FAN])
                    to = up[2] if up[2] is not None else (start + i) // FAN
                    emit(tree, level, start + i, n, own, up[0], up[1], to, siblings, rise[i], role)
            if here:
                emit(tree, level, start, n, line[0], None, None, None, None, rise[0], "top")
                break
            rise = [max(rise[i : i + FAN]) + 1 for i in range(0, len(line), FAN)]
            line = [parent_digest(line[i : i + FAN]) for i in range(0, len(line), FAN)]
            level, start, n = level + 1, start // FAN, -(-n // FAN)
        total = len(out["tree"])
        arrays = [pa.array(v, schema.field(k).type) for k, v in out.items()]
        source = table.column("carry").combine_chunks()
        taken = pa.array((rows if out["role"][0] == "leaf" else []) + [None] * total, pa.int64()).slice(0, total)
        return pa.Table.from_arrays([*arrays, source.take(taken).cast(schema.field("carry").type)], schema=schema)

    return build


def _forest(leaves: DataFrame, most: int, carry: T.DataType) -> tuple[list[DataFrame], DataFrame]:
    """All nodes over ``leaves`` (tree, count, first, length, digest, rise, carry), a table for each
    ``LEVELS`` levels, and the root of each tree."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = _node_type(carry)
    schema = to_arrow_schema(kind)
    tables, roots, base, size = [], [], 0, FAN**LEVELS
    while True:
        last = (F.col("first") + F.col("length") - 1) / size
        blocks = F.sequence(F.floor(F.col("first") / size), F.floor(last))
        made = leaves.withColumn("block", F.explode(blocks)).groupBy("tree", "block").applyInArrow(_build_block(base, schema), kind)
        made = stored(made)
        tables.append(made.filter("role <> 'top'"))
        roots.append(made.filter("role = 'top' AND count = 1"))
        if most <= size:
            break
        base, most = base + LEVELS, -(-most // size)
        open_ = made.filter("role = 'top' AND count > 1")
        leaves = open_.select(
            "tree", "count", F.col("place").alias("first"), F.lit(1).cast("bigint").alias("length"), "digest", "rise", "carry"
        )
    found = roots[0]
    for more in roots[1:]:
        found = found.unionAll(more)
    return tables, found.select("tree", "digest", "rise")


def _places(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """``rows`` with the number of their tree, their first place in it and its size; the number of
    trees and the largest size. No task holds more than a range of the order of one group."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, "key", "at", "digest").withColumn("part", F.spark_partition_id()))
    totals = stored(ranged.groupBy("key", "part").agg(F.sum("length").alias("n")))
    before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    trees = totals.groupBy("key").agg(F.min("part").alias("part"), F.sum("n").alias("count"))
    trees = stored(ranking.rank_rows(trees, ["key"], F.col("part"), rank="tree", total="trees").drop("part"))
    most = trees.agg(F.max("count"), F.max("trees")).first()
    if most[0] is None:
        return ranged, 0, 0
    starts = stored(starts.join(trees, "key").select("key", "part", "start", "count", (F.col("tree") - 1).alias("tree")))
    order = W.partitionBy("key", "part").orderBy("at", "digest")
    first = F.col("start") + F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("length")
    placed = ranged.join(starts, ["key", "part"]).withColumn("first", first)
    return placed.select("tree", "count", "first", "length", "digest", F.lit(0).alias("rise"), "carry"), most[1], most[0]


def _jump(rows: DataFrame, far: int, root_level: int) -> DataFrame:
    """One self-join: every pointer that is not at the root takes its target's pointer and segment.
    ``far`` is the distance that pointers have; only nodes as far above a leaf can be targets, and
    only those that can be targets of the next round are kept."""
    at_root = (F.col("to_tree") == TOP) & (F.col("to_level") == root_level)
    targets = rows.filter((F.col("role") == "node") & (F.col("rise") >= far - 1))
    targets = targets.select(
        *[F.col(c).alias(f"to_{c}") for c in _KEY], *[F.col(c).alias(f"next_{c}") for c in _TO],
        F.col("segment").alias("more"), F.col("subroot").alias("found"),
    )
    size = targets.agg(F.sum(F.octet_length("more") + 64)).first()[0] or 0
    if size <= MOST_SENT:
        targets = F.broadcast(targets)
    rows = rows.filter((F.col("role") == "leaf") | (F.col("rise") >= 2 * far - 1))
    jumped = rows.filter(~at_root).join(targets, _TO)
    jumped = jumped.withColumns(
        {"segment": F.concat("segment", "more"), "subroot": F.coalesce("subroot", "found"), **{c: F.col(f"next_{c}") for c in _TO}}
    )
    return jumped.select(*rows.columns).unionAll(rows.filter(at_root))


def prove(df: DataFrame, leaf: Column, group: Column, order: Column, carry: dict[str, Column]) -> DataFrame:
    """One row per row of ``df``: the columns of ``carry``, then ``leaf``, ``subroot``, ``root`` (lowercase
    hex), ``proof`` (binary: the siblings' digests from the leaf's level up, left to right) and the
    leaf's place: ``tree``, ``trees``, ``place``, ``leaves``.

    ``leaf`` is the row's digest in hex. Groups are ordered bytewise with null first, the leaves of
    a group by ``order``, null first, then by digest; equal rows are leaves of their own. Other
    columns of ``df`` play no part, whatever their names. No rows give no rows. A lone leaf is its
    group's root and a lone group's root is the root; its proof is empty. Columns of ``carry``
    must be comparable, since equal rows travel as one.
    """
    key = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    named = df.select(key.alias("key"), order.alias("at"), F.unhex(leaf).alias("digest"), F.struct(*[c.alias(n) for n, c in carry.items()]).alias("carry"))
    rows = stored(named.groupBy("key", "at", "digest", "carry").agg(F.count(F.lit(1)).alias("length")))
    kind = rows.schema["carry"].dataType
    placed, trees, most = _places(rows)
    digests = {"leaf": "digest", "subroot": "subroot", "root": "root"}
    if not trees:
        columns = ", ".join([*[f"{n} string" for n in digests], "proof binary", "tree bigint", "trees bigint", "place bigint", "leaves bigint"])
        return rows.sparkSession.createDataFrame([], T.StructType([*kind.fields, *T._parse_datatype_string(columns).fields]))
    tables, roots = _forest(placed, most, kind)
    nothing = F.lit(None).cast(kind).alias("carry")
    tops, root = _forest(
        roots.select(
            F.lit(TOP).cast("bigint").alias("tree"), F.lit(trees).cast("bigint").alias("count"), F.col("tree").alias("first"),
            F.lit(1).cast("bigint").alias("length"), "digest", "rise", nothing,
        ),
        trees, kind,
    )
    # the root's level in the top tree, and its distance from the farthest leaf
    top, root_level, count = root.first(), 0, trees
    while count > 1:
        root_level, count = root_level + 1, -(-count // FAN)
    subroot = F.when((F.col("tree") == TOP) & (F.col("level") == 0), F.col("digest"))
    all_rows = [t.withColumn("subroot", subroot) for t in [*tables, *tops]]
    jumping = all_rows[0]
    for more in all_rows[1:]:
        jumping = jumping.unionAll(more)
    far = 1
    while far <= top["rise"]:
        jumping = stored(_jump(jumping, far, root_level))
        far *= 2
    made = jumping.filter("role = 'leaf'").withColumns(
        {"root": F.lit(top["digest"].hex()), "subroot": F.lower(F.hex(F.coalesce("subroot", F.lit(bytes(top["digest"])))))}
    )
    return made.select(
        "carry.*", F.lower(F.hex("digest")).alias("leaf"), "subroot", "root", F.col("segment").alias("proof"), "tree",
        F.lit(trees).cast("bigint").alias("trees"), "place", F.col("count").alias("leaves"),
    )


def with_folded_root(proved: DataFrame, leaf: Column) -> DataFrame:
    """Add ``folded_root``: the root that digest ``leaf`` (hex) and the row's proof give; null for a null leaf."""
    reads = {c: F.col(c) for c in ("tree", "trees", "place", "leaves", "proof")} | {"digest": F.unhex(leaf)}

    def start():
        def work(*columns: pa.Array) -> list[pa.Array]:
            found = []
            for tree, trees, place, leaves, proof, digest in zip(*[c.to_pylist() for c in columns]):
                steps = [*path(place, leaves), *path(tree, trees)]
                found.append(None if digest is None else fold(digest, steps, proof).hex())
            return [pa.array(found, pa.string())]

        return work

    return append(proved, reads, [field("folded_root", "string")], start)


def subroots(proved: DataFrame) -> DataFrame:
    """The manifest itself: one row per group with its number, number of leaves and root."""
    return proved.groupBy("tree").agg(F.first("leaves").alias("leaves"), F.first("subroot").alias("subroot"), F.first("root").alias("root"))
