"""Token counts through a cache of digests.

A text is normalised and digested; the tokenizer has a digest of its own, of its vocabulary file, pattern and library version. Counts are kept in a
Parquet table by both digests. A run joins its digests to that table, encodes each distinct text that it lacks once, and appends
the new counts.

Texts aren't shuffled. One pass makes the digest of each row and its address, a file and a row number. Only these are
shuffled, to choose one row for each missing digest, and the rows chosen are read where they lie.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import FEW_ROWS, filesystem, free_name, is_parquet, new_path, stored, tune

CACHE = T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("tokens", T.LongType())])


def default_vocabulary() -> str:
    """The place of the default vocabulary file, outside this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Tokenizer:
    """A byte-level BPE from a file of ranks, with its digest."""

    def __init__(self, path: str | None = None, pattern: str | None = None) -> None:
        import tiktoken

        with open(path or default_vocabulary(), "rb") as f:
            self.ranks = f.read()
        self.pattern = pattern or default_pattern()
        self.digest = hashlib.sha256(b"\0".join((self.ranks, self.pattern.encode(), tiktoken.__version__.encode()))).hexdigest()


def encoding(name: str, ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={})


#: White space of the regular expressions; a run from this length on is cut out before they see it, as they would run out of stack.
LONG_SPACE = re.compile("(?<![{0}])[{0}]{{10000,}}".format("\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"))


def count_tokens(encoder, text: str) -> int:
    """Tokens of a text. A long run of white space is, but for its last character, a piece by itself, as the pattern has it."""
    n = at = 0
    for m in LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        n += len(encoder.encode_ordinary(text[at : m.start()])) + len(encoder._encode_single_piece(text[m.start() : end]))
        at = end
    return n + len(encoder.encode_ordinary(text[at:] if at else text))


SPACE = " \t\n"


def normalised(column: str = "text") -> Column:
    """Line ends as \\n and no white space at either end; null is empty. Nothing else is changed, so counts are those of the text that is trained on."""
    return F.btrim(F.replace(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit(SPACE))


def normal(text: str | None) -> str:
    """``normalised`` in Python."""
    return (text or "").replace("\r\n", "\n").strip(SPACE)


def read_cache(docs: DataFrame, cache: str) -> DataFrame:
    """The cache, empty where there is none yet."""
    spark = docs.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache)


def counter(held, column: str):
    """Reads the rows of (path, row, digest), each path's rows in order, and counts their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, *rest = held.value
        encoder = encoding(name, *rest)
        for path, rows, digests in runs(batches):
            counts = []
            for text, digest in zip(texts_at(path, column, rows), digests, strict=True):
                text = normal(text)
                if hashlib.sha256(text.encode()).digest() != digest:
                    raise RuntimeError(f"{path} changed while it was read")
                counts.append(count_tokens(encoder, text))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(counts), pa.string()), pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], ["tokenizer", "digest", "tokens"])

    return run


#: Rows of a stretch of a file; what was chosen of a stretch is read by one task, at once.
RUN_ROWS = 1 << 12
#: Rows of all documents for each task of the second pass, where that makes more tasks than the session's shuffles have.
TASK_ROWS = 1 << 16


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[int], list[bytes]]]:
    """(path, rows, digests) of rows that follow each other in a file, at most RUN_ROWS."""
    path, rows, digests = None, [], []
    for batch in batches:
        for p, r, d in zip(*(batch.column(c).to_pylist() for c in ("path", "row", "digest")), strict=True):
            if rows and (p != path or len(rows) == RUN_ROWS):
                yield path, rows, digests
                rows, digests = [], []
            path = p
            rows.append(r)
            digests.append(d)
    if rows:
        yield path, rows, digests


def texts_at(path: str, column: str, rows: list[int]) -> Iterator[str | None]:
    """The column of some rows, in ascending order, of a Parquet file; only row groups that hold any are read, a batch at a time."""
    import pyarrow.parquet as pq

    store, at = filesystem(unquote(path))
    want = np.array(rows)
    with store.open_input_file(at) as f:
        file = pq.ParquetFile(f)
        base = 0
        for g in range(file.num_row_groups):
            size = file.metadata.row_group(g).num_rows
            if ((want >= base) & (want < base + size)).any():
                at_row = base
                for batch in file.iter_batches(batch_size=256, row_groups=[g], columns=[column]):
                    own = want[(want >= at_row) & (want < at_row + batch.num_rows)]
                    yield from batch.column(0).take(pa.array(own - at_row)).to_pylist()
                    at_row += batch.num_rows
                    if at_row > want[-1]:
                        return
            base += size


def counted(docs: DataFrame, cache: str | None = None, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``docs`` without its text, with ``tokens``, the number of tokens of the normalised text.

    ``cache``: a folder that all executors share; None takes a new one of the shared folder, so that nothing of an earlier run is used. What the cache lacks is encoded once for
    each distinct text and appended. A digest that two runs appended at once counts once. ``docs`` other than a plain Parquet table are written to the shared folder first.

    A null text has 0 tokens, like an empty one. doc_id may be null or repeat: each row keeps its own. Texts of any length are encoded whole, in a time that grows as
    they do, runs of white space or of one character included. All columns but text
    pass through; ``tokens`` gets underscores in front where the name is taken. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    tokenizer = tokenizer or Tokenizer()
    cache = cache or new_path(spark, "tokens")
    held = spark.sparkContext.broadcast((tokenizer.digest, tokenizer.ranks, tokenizer.pattern))
    name = free_name(docs, "tokens")
    if not is_parquet(docs):
        docs = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]).alias("d"), F.col("text").cast("string").alias("text")), "texts")
        rest, column = F.col("d"), "text"
    else:
        rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]).alias("d")
        column = next(c for c in docs.columns if c.lower() == "text")
    address = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at")
    rows = stored(docs.select(rest, F.unhex(F.sha2(normalised(), 256)).alias("digest"), address), "digests")
    paths = docs.select(F.col("_metadata.file_path").alias("path")).distinct().select(F.xxhash64("path").alias("file"), "path")
    paths = stored(paths, "paths")
    known = read_cache(docs, cache).filter(F.col("tokenizer") == tokenizer.digest)
    misses = rows.join(known.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.min("at").alias("at")).select("digest", "at.file", "at.row")
    misses = misses.join(F.broadcast(paths) if paths.count() <= FEW_ROWS else paths, "file").select("path", "row", "digest")
    # a stretch of a file goes to one task, however many rows of it were chosen; a number of tasks is given, as the work isn't in the bytes that are shuffled
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_ROWS)
    misses = misses.repartition(tasks, "path", F.floor(F.col("row") / F.lit(RUN_ROWS))).sortWithinPartitions("path", "row")
    misses.mapInArrow(counter(held, column), CACHE).write.mode("append").parquet(cache)
    counts = read_cache(docs, cache).filter(F.col("tokenizer") == tokenizer.digest).groupBy("digest").agg(F.max("tokens").alias("t"))
    return rows.join(counts, "digest").select("d.*", F.col("t").alias(name))
