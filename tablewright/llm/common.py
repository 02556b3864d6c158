"""What several operators share: appended columns, text pieces and the given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: white space of the word and line contracts: space and U+0009 to U+000D
ASCII_SPACE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole; a table of too few splits for the cores is dealt out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without columns of these names, in any case: an operator's own columns replace them."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def append(
    df: DataFrame, reads: dict[str, Column], fields: Sequence[T.StructField], start: Callable, also_drop: Sequence[str] = ()
) -> DataFrame:
    """``df`` plus ``fields``, made batch by batch in Arrow.

    ``start()`` runs once per task and gives ``work(*arrays) -> list of Arrow arrays``, called
    with the arrays of ``reads``. Columns of ``df`` named like a new one are replaced.
    """
    kept = without(df, [f.name for f in fields] + list(also_drop)).columns
    n = len(kept)
    sent = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], *[c.alias(f"r{i}") for i, c in enumerate(reads.values())])
    schema = T.StructType([T.StructField(f"k{i}", sent.schema[i].dataType, True) for i in range(n)] + [T.StructField(f"n{i}", f.dataType, True) for i, f in enumerate(fields)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            made = work(*[batch.column(i) for i in range(n, batch.num_columns)])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + made, names=names)

    out = sent.mapInArrow(run, schema)
    return out.toDF(*kept, *[f.name for f in fields])


_SIMPLE = {"bigint": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "boolean": T.BooleanType, "string": T.StringType}


def field(name: str, kind: str) -> T.StructField:
    """A nullable field of a simple type, or of an ``array<...>`` of one."""
    simple = _SIMPLE[kind.removeprefix("array<").removesuffix(">")]()
    return T.StructField(name, T.ArrayType(simple) if kind.startswith("array<") else simple, True)


def structs(name: str, **kinds: str) -> T.StructField:
    """A field that is an array of structs of simple types."""
    return T.StructField(name, T.ArrayType(T.StructType([field(n, k) for n, k in kinds.items()])), True)


def spans_of(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut ``0..len(sizes)`` into runs of about ``limit`` bytes each, one item at least."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)
