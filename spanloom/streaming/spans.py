"""Streams of spans: append to a store, windows with late data, and repeats dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.storage import SpanStore, stream_name

LATE = "10 minutes"


def stream(spark: SparkSession, folder: str, schema: StructType, files: int = 1000) -> DataFrame:
    """New Parquet files of a folder, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def timed(spans: DataFrame) -> DataFrame:
    """``spans`` with event_time from start_time_ms."""
    return spans.withColumn("event_time", F.timestamp_millis("start_time_ms"))


def unrepeated(spans: DataFrame, late: str = LATE) -> DataFrame:
    """The first of each span within the watermark."""
    return timed(spans).withWatermark("event_time", late).dropDuplicatesWithinWatermark(["tenant_id", "span_id"])


def windowed(spans: DataFrame, size: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """Spans, errors and the mean duration by tenant and tumbling or sliding window."""
    w = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    grouped = timed(spans).withWatermark("event_time", late).groupBy(w.alias("w"), "tenant_id")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("errors"), F.avg("duration_ms").alias("mean_ms")).select("w.start", "w.end", "tenant_id", "n", "errors", "mean_ms")


def sessions(spans: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """Sessions of a trace: spans without a gap longer than ``gap``."""
    grouped = timed(spans).withWatermark("event_time", late).groupBy(F.session_window("event_time", gap).alias("w"), "tenant_id", "trace_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "tenant_id", "trace_id", "n")


def append_to(spans: DataFrame, store: SpanStore, checkpoint: str) -> StreamingQuery:
    """Run the stream into a store until it has read what is there, a batch of the store for each micro-batch.

    The store remembers the last micro-batch of each checkpoint, so one that is run again after a failure isn't added twice.
    """
    name = stream_name(checkpoint)

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.append(batch, name, number)

    return spans.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
