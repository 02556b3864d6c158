"""Session settings the library reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall
    back to a temporary folder, since executors elsewhere could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tablewright-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on the shared folder, so lost executors cost one re-read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt out to all cores, if it has fewer partitions and at least ``rows`` rows for each: the small
    result of a join often comes in one partition, and iterative work on it then keeps one core busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = min(cores, -(-df.count() // rows))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def scratch(spark: SparkSession) -> str:
    """A new folder on the shared storage."""
    return f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written as a table on the shared folder (``folder`` in it, if named) and read again.

    Unlike ``cut`` the result forgets how it was partitioned: a join of it shuffles both
    sides, which lets adaptive execution split a hot key.
    """
    folder = folder or scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
