"""Scoring files as they arrive."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablewright.operators.models import score


def score_stream(
    spark: SparkSession,
    pipeline: PipelineModel,
    meta: dict,
    source: str,
    schema: T.StructType,
    sink: str,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Score every parquet file under ``source`` not yet scored, append to ``sink``.

    The checkpoint remembers finished files, so a restarted run neither misses nor repeats
    any. Returns the sink's rows.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    scored = score(pipeline, reader.parquet(source), meta)
    running = (
        scored.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(scored.schema).parquet(sink)
