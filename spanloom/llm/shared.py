"""Shared-folder tables, Arrow batch helpers and column checks used by every operator here."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch handed to Python. Long documents make wide rows, so this is far below Spark's defaults.
ARROW_ROWS, ARROW_BYTES = 256, 16 << 20
#: Rows in a batch joined from several.
GATHERED_ROWS = 1 << 16


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that hold whole texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    # -1 is no bound
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a local one for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Rows of ids or paths, some 10 MB, up to which a table is sent to every task.
FEW_ROWS = 100_000


def filesystem(uri: str):
    """(filesystem, path) of a URI by pyarrow; the scheme says which."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def is_parquet(df: DataFrame) -> bool:
    """Whether ``df`` is a Parquet table as it was read, so that its rows have addresses."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: The tables written in the shared folder, in order.
WRITTEN: list[str] = []


def remove_since(spark: SparkSession, mark: int, keep: str) -> None:
    """Delete the tables written since ``mark`` tables had been, but for ``keep``."""
    for path in WRITTEN[mark:]:
        if path != keep:
            remove(spark, path)
    WRITTEN[mark:] = [keep]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    WRITTEN.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no result reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, want: str) -> str:
    """``want``, or ``want`` with underscores in front where ``df`` already has such a column."""
    have = {c.lower() for c in df.columns}
    while want.lower() in have:
        want = "_" + want
    return want


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, end to end, and the offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        # a null may keep bytes of its own; its length counts as 0
        valid = np.asarray(column.is_valid())
        if (np.diff(offsets)[~valid] != 0).any():
            column = column.fill_null("")
            return text_buffer(column)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of ``column`` or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Join batches into ones of about ``limit`` bytes of ``column``; a longer row stands alone."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for part in slices(batches, column, limit):
        raw, _ = text_buffer(part.column(column))
        if held and (size + len(raw) > limit or rows + part.num_rows > GATHERED_ROWS):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, rows = [], 0, 0
        held.append(part)
        size += len(raw)
        rows += part.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def lowered(column: str) -> F.Column:
    """Lower case in the JVM; null is empty."""
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
