"""Versions of spans: the latest of each, compaction, trace bounds and the trace tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schema import SORT_KEY
from ..sources.shared import stored

IDENTITY = ("tenant_id", "span_id")


def merged(old: DataFrame, new: DataFrame, newer: bool = False) -> DataFrame:
    """The latest of each span of ``old``, which has one row for each, and ``new``, which may have more.

    Only rows of ``old`` that ``new`` has too are compared; the others pass, and filters on them reach their scan. ``newer``: every commit of ``new`` is
    known to be above those of ``old``, so that such rows needn't even be read.
    """
    ids = new.select(*IDENTITY).distinct()
    kept = old.join(ids, list(IDENTITY), "left_anti").select(*old.columns)
    if newer:
        return kept.unionByName(latest(new))
    met = old.join(ids, list(IDENTITY), "left_semi").select(*old.columns)
    return kept.unionByName(latest(met.unionByName(new)))


def latest(spans: DataFrame, by: str = "commit") -> DataFrame:
    """One row for each span. ``by``: commit keeps the highest commit_id; trace_order the first by trace_id, start_time_ms and descending commit_id."""
    order = {"commit": [F.desc("commit_id"), *SORT_KEY], "trace_order": ["trace_id", "start_time_ms", F.desc("commit_id")]}[by]
    turn = Window.partitionBy(*IDENTITY).orderBy(*order)
    return spans.withColumn("__turn", F.row_number().over(turn)).filter("__turn = 1").drop("__turn")


def compacted(spans: DataFrame, files: int | None = None) -> DataFrame:
    """The latest spans, each trace whole within one partition and sorted, ready to be written."""
    kept = latest(spans)
    placed = kept.repartitionByRange(files, "trace_id") if files else kept.repartitionByRange("trace_id")
    return placed.sortWithinPartitions(*SORT_KEY)


#: Ranges of groups, some 10 MB, up to which their offsets go to every task.
FEW_GROUPS = 100_000


def with_commits(spans: DataFrame, base: int) -> DataFrame:
    """commit_id from ``base`` on, without gaps, by tenant and partition in the order of the sort key.

    Rows are sorted in ranges and written to the shared folder, so that ids don't change if an executor is lost. A row's number is its place in its range plus the
    rows of its tenant and partition in the ranges before: no task gets a whole tenant.
    """
    order = ["tenant_id", "partition_id", *SORT_KEY]
    # written first, as choosing the ranges reads the rows once more
    spans = stored(spans.drop("commit_id"), "spans")
    run = stored(spans.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    # the range in the upper bits, the place in it in the lower 33
    part = F.shiftright("__at", 33)
    counts = run.groupBy("tenant_id", "partition_id", part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("tenant_id", "partition_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("tenant_id", "partition_id", "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")), "starts")
    found = run.withColumn("__part", part)
    keyed = F.broadcast(starts) if starts.count() <= FEW_GROUPS else starts
    same = [found[c].eqNullSafe(keyed[c]) for c in ("tenant_id", "partition_id")] + [found["__part"] == keyed["__part"]]
    joined = found.join(keyed, same)
    return joined.select(*[found[c] for c in run.columns if c != "__at"], (F.col("__at") + F.col("__shift") + F.lit(base)).cast("long").alias("commit_id"))


def trace_bounds(spans: DataFrame) -> DataFrame:
    """First start, last end, spans and errors of each trace."""
    return spans.groupBy("tenant_id", "trace_id").agg(F.min("start_time_ms").alias("first_start"), F.max("end_time_ms").alias("last_end"), F.count(F.lit(1)).alias("n_spans"), F.count_if(F.col("status") == "error").alias("n_errors"))


def zone_map(spans: DataFrame, columns: list[str], by: Column) -> DataFrame:
    """Rows, nulls, and the least and largest value of columns, for each file or other unit."""
    stats = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        stats += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{c}")]
    return spans.groupBy(by.alias("unit")).agg(*stats)


def children(spans: DataFrame) -> DataFrame:
    """Each parent span with the number of its children and their total duration."""
    return spans.filter("parent_span_id is not null").groupBy("tenant_id", F.col("parent_span_id").alias("span_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("duration_ms").alias("children_ms"))


def subtree(spans: DataFrame, root: str, tenant_id: int, depth: int = 64) -> DataFrame:
    """(span_id, depth) of all spans under ``root``, level by level; ends where a level is empty, and fails beyond ``depth`` levels.

    The edges are written once and every level reads them, so what ``spans`` takes is paid once whatever the depth. A level is written too: any number of spans may be on it.
    """
    own = stored(spans.filter(F.col("tenant_id") == tenant_id).select("span_id", "parent_span_id"), "edges")
    level = stored(own.filter(F.col("span_id") == root).select("span_id", F.lit(0).alias("depth")), "level")
    found, at = level, 0
    while not level.isEmpty():
        at += 1
        level = stored(own.join(level.select(F.col("span_id").alias("parent_span_id")), "parent_span_id").select("span_id", F.lit(at).alias("depth")), "level")
        if at > depth and not level.isEmpty():
            raise ValueError(f"more than {depth} levels under {root}")
        found = found.unionByName(level)
    return found
