"""Streaming forms of what grows over time: resumable copies and stable splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.sampling import disjoint_split


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch)).parquet(path)


def copy_new(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived since the last run, once: the checkpoint remembers the files."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_stream(stream: DataFrame, holdout: float = 0.2, seed: int = 0) -> DataFrame:
    """The disjoint split is a condition on single rows, so it holds on a stream."""
    return disjoint_split(stream, holdout, seed)
