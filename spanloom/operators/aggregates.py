"""Aggregates that Spark lacks, or names differently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sum_or_zero(column: str) -> Column:
    """The sum as a double; 0.0 of nothing."""
    return F.coalesce(F.sum(F.col(column).cast("double")), F.lit(0.0))


def percentiles(df: DataFrame, keys: list[str], column: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact percentiles by nearest rank: of n sorted values the one at floor(n * q), at most the last.

    Equal values are counted before they meet, so what is sorted is a group's distinct values and no group is held in memory. A group
    without values has nulls.
    """
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*keys).orderBy(column)
    real = F.when(F.col(column).isNotNull(), F.col("__n")).otherwise(0)
    placed = counts.withColumn("__upto", F.sum(real).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum(real).over(Window.partitionBy(*keys)))
    at = {name: F.least(F.greatest(F.floor(F.col("__all") * F.lit(q)), F.lit(0)), F.col("__all") - 1) for name, q in quantiles.items()}
    picked = [F.min(F.when(F.col(column).isNotNull() & (F.col("__upto") > rank), F.col(column))).alias(name) for name, rank in at.items()]
    return placed.groupBy(*keys).agg(*picked)


def grouped(df: DataFrame, keys: list[str], aggregates: list[Column] | None = None) -> DataFrame:
    """One row for each key, in the order of the keys; without aggregates the distinct keys."""
    out = df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()
    return out.orderBy(*keys)


def ordered(df: DataFrame, column: str, descending: bool = False, limit: int | None = None, tie: str | None = None) -> DataFrame:
    """Rows in order of a column, missing values last in ascending and first in descending order."""
    c = F.col(column)
    out = df.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), *([tie] if tie else []))
    return out if limit is None else out.limit(limit)


#: Added to a quantile, so that a whole n * q takes the value after it, as the nearest rank here does.
ABOVE = 1e-12


def percentile_sql(column: str, q: float) -> str:
    """The exact percentile by nearest rank as an aggregate of Spark SQL. It counts equal values before the shuffle; a group is held as its distinct values."""
    return f"percentile_disc({min(max(q, 0.0) + ABOVE, 1.0)!r}D) WITHIN GROUP (ORDER BY {column})"
