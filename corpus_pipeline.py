"""From raw documents to training shards: quality, near copies, benchmark leaks, mixture, order.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of documents.
The mixture is handed on as the order in which the rows of its table lie; the shards follow it.

In all stages documents may have more columns than those of the table documents, of any names but doc_id, text, lang, source and n_chars, which
are these whatever their case; they pass through. An empty table gives an empty result. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, mixing, ngram_join, quality_cnn, sharding
from spanloom.llm.shared import WRITTEN, remove_since, stored, table


def same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a probability at the threshold is kept.

    A null text is scored as an empty one. Rows that repeat get the same answer each. Rows without a doc_id are scored like others, but can't be labelled.
    """
    return same_columns(quality_cnn.classified(docs, table(spark, sf_dir, "labels")), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least doc_id (null last).

    Rows without text or without words stay as they are. Where doc_ids repeat or are null, each row is judged by its own text; of rows that repeat, one stays.
    """
    return ngram_join.one_of_each_group(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark text go: 13 words of an item in a row, or all of a shorter one.

    Each row is judged by its own text, with or without a doc_id; rows without text stay. Items without text match nothing.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, lying in the order of the schedule's slots, which take each source in turn; a null source is a source.

    Rows that repeat are documents of their own; ties of the order within a source go by doc_id and text. Rows aren't removed.
    """
    return same_columns(mixing.mixed(docs, whole=True, ordered=True), docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``hilbert`` and ``shard`` (with underscores in front where these names are taken): windows of the order in which they lie, the mixture's, each cut into shards along the curve.

    Null lang and source are values of their own, a null n_chars counts as 0 and a null doc_id sorts first; ties go by doc_id and text.
    """
    return sharding.sharded_in_windows(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]

#: MinHash and a trained classifier have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as a table of the shared folder before the next reads it. Once a stage is written, what it was made from is deleted."""
    docs = table(spark, sf_dir, "documents")
    mark = len(WRITTEN)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        remove_since(spark, mark, docs.stored_at)
    return STAGES[-1][1](spark, docs, sf_dir)
