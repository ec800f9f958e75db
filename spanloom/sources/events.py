"""Spans from the ``events`` table, and the other tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span for each event: a user is a trace, and a span's parent is the one before it in its trace."""
    return spans_of(table(spark, sf_dir, "events"))


def spans_of(e: DataFrame) -> DataFrame:
    """Spans of a table or stream of events."""
    start = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    duration = F.floor(F.col("value") * 10).cast("long")
    return e.select(
        (F.col("user_id") % 4).alias("tenant_id"), F.lit(0).cast("long").alias("partition_id"),
        F.concat(F.lit("t"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("trace_id"),
        F.concat(F.lit("s"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("span_id"),
        start.alias("start_time_ms"), (start + duration).alias("end_time_ms"), duration.alias("duration_ms"), F.col("event_type").alias("span_type"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.concat(F.lit("m"), (F.col("event_id") % 8).cast("string")).alias("model"),
        F.col("value").alias("cost_usd"), F.col("props").alias("metadata"), (F.col("event_id") + 1).alias("commit_id"),
    )


def with_parent(spans_: DataFrame) -> DataFrame:
    return spans_.withColumn("parent_span_id", F.lag("span_id").over(Window.partitionBy("trace_id").orderBy("start_time_ms", "span_id")))


#: The same in DuckDB, as a common table expression.
SPANS_SQL = """spans AS (SELECT user_id % 4 AS tenant_id, 0::BIGINT AS partition_id, 't' || lpad(user_id::varchar, 8, '0') AS trace_id, 's' || lpad(event_id::varchar, 12, '0') AS span_id,
 epoch_us(ts) // 1000 AS start_time_ms, epoch_us(ts) // 1000 + cast(floor(value * 10) AS bigint) AS end_time_ms, cast(floor(value * 10) AS bigint) AS duration_ms, event_type AS span_type,
 CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, 'm' || (event_id % 8)::varchar AS model, value AS cost_usd, props AS metadata, event_id + 1 AS commit_id FROM events)"""
