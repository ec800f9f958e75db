"""Queries opN_<name> over whole tables, and their DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_density, licenses, mixing, ngram_join, quality_cnn, quality_rules, sharding, token_cache, warc
from .shared import table


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that has a near copy: its class, its links and its best partner."""
    return ngram_join.ngram_links(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents kept, with their probability."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_cnn.classified(docs, table(spark, sf_dir, "labels")).drop("text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.counted(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass every rule."""
    return quality_rules.passed(table(spark, sf_dir, "documents")).drop("text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest match of each document and benchmark item; the pipeline's stage removes these documents."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC files and read back."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extracted(table(spark, sf_dir, "pages"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the schedule."""
    return mixing.mixed(table(spark, sf_dir, "documents"), whole=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_warc, op3_hilbert_sharding, op4_ngram_join, op5_quality_classifier,
        op6_token_counts, op7_quality_rules, op8_decontamination, op9_html_extraction, op10_source_mixing,
    )
}

ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.oracle_sql(),
    "op2_warc": "SELECT page_id, url, html FROM pages",
    "op3_hilbert_sharding": sharding.oracle_sql(),
    "op8_decontamination": decontaminate.oracle_sql(),
    "op7_quality_rules": quality_rules.oracle_sql("doc_id, lang, source, n_chars"),
}
