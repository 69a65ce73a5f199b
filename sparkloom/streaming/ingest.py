"""Structured Streaming into datasets: each micro-batch is one commit, counted once.

The batch's number is the source's offset, so a batch that is run again after a failure finds
its range counted and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.dataset import Commit, Dataset, SourceRange


def files_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def ingest(stream: DataFrame, root: str, source: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, once: bool = False, on_commit: Callable[[Commit], None] | None = None) -> StreamingQuery:
    """Appends a stream to the dataset at root; once: what there is, then the end."""

    def land(batch: DataFrame, number: int) -> None:
        dataset = Dataset.open(batch.sparkSession, root)
        rows = prepare(batch) if prepare else batch
        commit = dataset.append(rows, [SourceRange(source, number, number + 1)])
        if on_commit:
            on_commit(commit)

    writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def closing_groups(stream: DataFrame, time_column: str, width: str, late: str, *keys: str, **aggregates) -> DataFrame:
    """Groups by bucket of time, given out as they close: append mode over a watermark."""
    return stream.withWatermark(time_column, late).groupBy(F.window(time_column, width), *keys).agg(*(c.alias(n) for n, c in aggregates.items())).withColumn("bucket", F.col("window.start")).drop("window")
