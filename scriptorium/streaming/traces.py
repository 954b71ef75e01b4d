"""Streaming extensions, beyond what the batch operators need: trace counts by window, and indexing as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.sources.traces import TRACE


def stream_traces(spark: SparkSession, directory: str) -> DataFrame:
    return spark.readStream.schema(TRACE).json(directory)


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, kind, n) of tumbling windows; rows later than the watermark are dropped. Batch and stream alike."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.where(F.col(time).isNotNull()).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def index_on_arrival(spark: SparkSession, mirror: str, checkpoint: str, run: Callable[[], object]) -> StreamingQuery:
    """Start an incremental index run for each batch of new files of a mirror folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(mirror).select("path")
    return files.writeStream.foreachBatch(lambda batch, _: None if batch.isEmpty() else run()).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
