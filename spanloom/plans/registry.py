"""Queries over the span operators, by name, each with the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsonpath, scalars, text
from ..functions.sql import register
from ..operators import aggregates, lifecycle, vectors
from ..sources import ingest
from ..sources.events import SPANS_SQL, spans, spans_of, table, with_parent
from ..sources.shared import new_path, stored
from ..sources.storage import SpanStore
from ..streaming import spans as streams
from .dialect import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WITH = f"WITH {SPANS_SQL} "
PARENT = f"WITH {SPANS_SQL}, tree AS (SELECT *, lag(span_id) OVER (PARTITION BY trace_id ORDER BY start_time_ms, span_id) AS parent_span_id FROM spans) "
ID = "span_id, model, duration_ms"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate and 95th percentile of duration by model, for one tenant."""
    own = spans(spark, sf_dir).filter("tenant_id = 1")
    p95 = aggregates.percentiles(own, ["model"], "duration_ms", {"p95_ms": 0.95})
    rate = own.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("status") == "error") / F.count(F.lit(1)), 6).alias("error_rate"))
    # null is a model too
    return rate.join(p95.withColumnRenamed("model", "m"), F.col("model").eqNullSafe(F.col("m"))).drop("m")


query(
    WITH + "SELECT model, count(*) AS n, round(count(*) FILTER (status = 'error') / count(*), 6) AS error_rate, "
    "list_sort(list(duration_ms))[least(floor(count(*) * 0.95::double), count(*) - 1)::int + 1] AS p95_ms FROM spans WHERE tenant_id = 1 GROUP BY model",
    "flagship",
)(flagship)

# predicates


def _filter(name: str, condition: str, columns: str = ID, duck: str | None = None) -> None:
    query(WITH + f"SELECT {columns} FROM spans WHERE {duck or condition}", name)(lambda s, d: spans(s, d).filter(condition).selectExpr(*columns.split(", ")))


_filter("b1_trace_load", "trace_id = 't00000008'", "span_id, model")
_filter("b2_attr_filter", "model = 'm3' AND status = 'error'")
_filter("b4_time_slice", "start_time_ms >= 1704070000000 AND start_time_ms < 1704080000000", "span_id, start_time_ms")
_filter("point_lookup_span", "span_id = 's000000000042'", "span_id, trace_id, model, cost_usd")
_filter("filter_ne", "duration_ms <> 100")
_filter("filter_lt", "duration_ms < 100")
_filter("filter_le", "duration_ms <= 100")
_filter("filter_gt", "duration_ms > 100")
_filter("filter_ge", "duration_ms >= 100")
_filter("filter_literal_on_left", "100 < duration_ms")
_filter("filter_float", "cost_usd > 12.5", "span_id, cost_usd")
_filter("filter_and", "model = 'm1' AND duration_ms > 100 AND status = 'ok'")
_filter("filter_or", "model = 'm1' OR status = 'error'")
_filter("filter_not", "NOT (model = 'm1')")
_filter("filter_nested", "(model = 'm1' OR model = 'm2') AND NOT (status = 'error' AND duration_ms < 50)")
_filter("filter_true", "TRUE", "span_id")
_filter("filter_false", "FALSE", "span_id")
_filter("filter_in", "model IN ('m1', 'm5')")
_filter("filter_between", "duration_ms BETWEEN 50 AND 150")
_filter("filter_like", "span_type LIKE 'cl%'", "span_id, span_type")
_filter("filter_is_null", "metadata IS NULL OR cost_usd IS NOT NULL", "span_id")
_filter("empty_time_range", "start_time_ms >= 1704080000000 AND start_time_ms < 1704070000000", "span_id")


@query(WITH + "SELECT span_id FROM spans WHERE NOT coalesce(json_extract_string(metadata, '$.k') = '69', false)")
def filter_not_two_valued(s, d):
    return spans(s, d).filter(scalars.two_valued_not(F.get_json_object("metadata", "$.k") == "69")).select("span_id")


@query(WITH + "SELECT * FROM spans")
def project_star(s, d):
    return spans(s, d)


@query(WITH + "SELECT span_id AS id, duration_ms / 1000.0::double AS seconds FROM spans")
def project_alias(s, d):
    return spans(s, d).select(F.col("span_id").alias("id"), (F.col("duration_ms") / F.lit(1000.0)).alias("seconds"))


# aggregates


@query(WITH + "SELECT model, count(*) AS n FROM spans GROUP BY model")
def b8_count_by_model(s, d):
    return spans(s, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "SELECT count(*) AS n, count(cost_usd) AS n_cost, count(DISTINCT trace_id) AS n_traces FROM spans")
def global_count(s, d):
    return spans(s, d).agg(F.count(F.lit(1)).alias("n"), F.count("cost_usd").alias("n_cost"), F.count_distinct("trace_id").alias("n_traces"))


@query(WITH + "SELECT count(*) AS n FROM spans WHERE model = 'none'")
def count_of_nothing(s, d):
    return spans(s, d).filter("model = 'none'").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "SELECT model, count(*) AS n FROM spans WHERE start_time_ms >= 1704070000000 AND start_time_ms < 1704080000000 GROUP BY model")
def count_time_range(s, d):
    return spans(s, d).filter("start_time_ms >= 1704070000000 AND start_time_ms < 1704080000000").groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "SELECT model, round(sum(cost_usd), 6) AS sum_cost_usd, round(avg(duration_ms), 6) AS avg_duration_ms, min(duration_ms) AS min_duration_ms, max(cost_usd) AS max_cost_usd FROM spans GROUP BY model")
def agg_sum_avg_min_max(s, d):
    return spans(s, d).groupBy("model").agg(F.round(aggregates.sum_or_zero("cost_usd"), 6).alias("sum_cost_usd"), F.round(F.avg("duration_ms"), 6).alias("avg_duration_ms"), F.min("duration_ms").alias("min_duration_ms"), F.max("cost_usd").alias("max_cost_usd"))


@query(WITH + "SELECT coalesce(sum(cost_usd), 0.0::double) AS sum_cost_usd, avg(cost_usd) AS avg_cost_usd FROM spans WHERE model = 'none'")
def sum_of_nothing(s, d):
    return spans(s, d).filter("model = 'none'").agg(aggregates.sum_or_zero("cost_usd").alias("sum_cost_usd"), F.avg("cost_usd").alias("avg_cost_usd"))


@query(WITH + "SELECT status, min(span_type) AS first_type, max(span_id) AS last_span FROM spans GROUP BY status")
def agg_min_max_text(s, d):
    return spans(s, d).groupBy("status").agg(F.min("span_type").alias("first_type"), F.max("span_id").alias("last_span"))


def _percentile(q: float) -> None:
    label = f"p{round(q * 100)}"
    query(WITH + f"SELECT model, list_sort(list(duration_ms))[least(floor(count(*) * {q}::double), count(*) - 1)::int + 1] AS {label} FROM spans GROUP BY model", f"agg_percentile_{label}")(
        lambda s, d: aggregates.percentiles(spans(s, d), ["model"], "duration_ms", {label: q})
    )


for _q in (0.5, 0.95, 0.99):
    _percentile(_q)


@query(WITH + "SELECT list_sort(list(cost_usd))[least(floor(count(*) * 0.0::double), count(*) - 1)::int + 1] AS p0, list_sort(list(cost_usd))[least(floor(count(*) * 1.0::double), count(*) - 1)::int + 1] AS p100 FROM spans")
def agg_percentile_global(s, d):
    return aggregates.percentiles(spans(s, d), [], "cost_usd", {"p0": 0.0, "p100": 1.0})


@query(WITH + "SELECT model, status, count(*) AS n FROM spans GROUP BY model, status")
def group_two_keys(s, d):
    return aggregates.grouped(spans(s, d), ["model", "status"], [F.count(F.lit(1)).alias("n")])


@query(WITH + "SELECT DISTINCT span_type, status FROM spans")
def group_no_agg(s, d):
    return aggregates.grouped(spans(s, d), ["span_type", "status"])


@query(WITH + "SELECT coalesce(json_extract_string(metadata, '$.none'), '') AS key, count(*) AS n FROM spans GROUP BY 1")
def group_null_key_text(s, d):
    return spans(s, d).groupBy(scalars.key_text(F.get_json_object("metadata", "$.none")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "SELECT model, count(*) AS n FROM spans GROUP BY model HAVING count(*) FILTER (status = 'error') > 10")
def having(s, d):
    return spans(s, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("e")).filter("e > 10").select("model", "n")


@query(WITH + "SELECT model, status, count(*) AS n FROM spans GROUP BY ROLLUP (model, status)")
def rollup(s, d):
    return spans(s, d).rollup("model", "status").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "SELECT model, status, count(*) AS n FROM spans GROUP BY CUBE (model, status)")
def cube(s, d):
    return spans(s, d).cube("model", "status").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "SELECT model, status, count(*) AS n FROM spans GROUP BY GROUPING SETS ((model), (status), ())")
def grouping_sets(s, d):
    return s.sql("SELECT model, status, count(*) AS n FROM {spans} GROUP BY GROUPING SETS ((model), (status), ())", spans=spans(s, d))


@query(WITH + "SELECT model, count(*) FILTER (status = 'error') AS errors, round(stddev_samp(duration_ms), 6) AS spread_ms, round(sum(duration_ms) FILTER (status = 'ok') / 1000, 3) AS ok_s FROM spans GROUP BY model")
def agg_filter_stddev(s, d):
    return spans(s, d).groupBy("model").agg(F.count_if(F.col("status") == "error").alias("errors"), F.round(F.stddev_samp("duration_ms"), 6).alias("spread_ms"), F.round(F.sum(F.when(F.col("status") == "ok", F.col("duration_ms"))) / 1000, 3).alias("ok_s"))


@query(WITH + "SELECT model, true AS close FROM spans GROUP BY model")
def approx_distinct(s, d):
    """Distinct traces by HyperLogLog, within 10 % of the exact number (twice the sketch's standard error of 5 %)."""
    exact, about = F.count_distinct("trace_id"), F.approx_count_distinct("trace_id", 0.05)
    return spans(s, d).groupBy("model").agg((F.abs(about - exact) <= F.greatest(exact * 0.1, F.lit(1))).alias("close"))


@query(WITH + "SELECT model, true AS close FROM spans GROUP BY model")
def percentile_approx(s, d):
    """The 95th percentile by sketch, whose rank is within 1 % of the exact one."""
    own = spans(s, d)
    about = own.groupBy("model").agg(F.percentile_approx("duration_ms", 0.95, 1000).alias("about"))
    rank = own.join(F.broadcast(about), "model").groupBy("model").agg((F.count_if(F.col("duration_ms") < F.col("about")) / F.count(F.lit(1))).alias("below"), (F.count_if(F.col("duration_ms") <= F.col("about")) / F.count(F.lit(1))).alias("upto"))
    return rank.select("model", ((F.col("below") <= 0.96) & (F.col("upto") >= 0.94)).alias("close"))


# order and limits


@query(WITH + "SELECT span_id, cost_usd FROM spans ORDER BY cost_usd ASC NULLS LAST, span_id LIMIT 100")
def order_asc_limit(s, d):
    return aggregates.ordered(spans(s, d).select("span_id", "cost_usd"), "cost_usd", limit=100, tie="span_id")


@query(WITH + "SELECT span_id, cost_usd FROM spans ORDER BY cost_usd DESC NULLS FIRST, span_id LIMIT 100")
def order_desc_limit(s, d):
    return aggregates.ordered(spans(s, d).select("span_id", "cost_usd"), "cost_usd", descending=True, limit=100, tie="span_id")


@query(WITH + "SELECT model, count(*) AS n FROM spans GROUP BY model ORDER BY n DESC, model LIMIT 3")
def order_after_aggregate(s, d):
    return spans(s, d).groupBy("model").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "model").limit(3)


@query(WITH + "SELECT span_id, start_time_ms FROM spans ORDER BY start_time_ms, span_id LIMIT 50 OFFSET 100")
def order_offset(s, d):
    return spans(s, d).select("span_id", "start_time_ms").orderBy("start_time_ms", "span_id").offset(100).limit(50)


# full text


def _duck_match(q: str, column: str = "text") -> str:
    low = f"lower({column})"

    def of(node) -> str:
        if node.kind == "tokens":
            return f"regexp_matches({low}, '{text.pattern(node.parts)}')"
        if node.kind == "not":
            return f"(NOT {of(node.parts[0])})"
        return "(" + (" AND " if node.kind == "all" else " OR ").join(map(of, node.parts)) + ")"

    return of(text.parse(q))


def _fts(name: str, q: str) -> None:
    query(f"SELECT doc_id, lang FROM documents WHERE {_duck_match(q)}", name)(lambda s, d: table(s, d, "documents").filter(text.text_match("text", q)).select("doc_id", "lang"))


_fts("b3_fts_term", "license")
_fts("fts_or", "the les")
_fts("fts_and", "the AND of AND license")
_fts("fts_phrase", '"of the"')
_fts("fts_phrase_long", '"under the mit license"')
_fts("fts_not", "the AND NOT of")
_fts("fts_signs", "+the -license")
_fts("fts_grouped", '(license OR "public license") AND NOT gnu')
_fts("fts_accents", "être OR für")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'les ')")
def fts_substring(s, d):
    return table(s, d, "documents").filter(text.text_match("text", "les ", "substring")).select("doc_id")


@query(f"SELECT doc_id, source FROM documents WHERE {_duck_match('license')} AND lang = 'en'")
def fts_and_attr(s, d):
    return table(s, d, "documents").filter((F.col("lang") == "en") & text.text_match("text", "license")).select("doc_id", "source")


@query(f"SELECT doc_id FROM documents WHERE {_duck_match('en', 'lang')} OR {_duck_match('license')}")
def fts_any_column(s, d):
    return table(s, d, "documents").filter(text.text_match_any(["lang"], "en") | text.text_match_any(["text"], "license")).select("doc_id")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND " + _duck_match("the"))
def fts_conversations(s, d):
    return table(s, d, "conversations").filter((F.col("role") == "user") & text.text_match("text", "the")).select("conv_id", "turn")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND strlen(t) <= 40)) AS n_tokens FROM documents")
def fts_tokens(s, d):
    return table(s, d, "documents").select("doc_id", F.size(text.tokens("text")).cast("long").alias("n_tokens"))


_BM25 = "ln(1 + (n_all - d{0} + 0.5) / (d{0} + 0.5)) * c{0} * 2.2 / (c{0} + 1.2 * (0.25 + 0.75 * n / mean))"


@query(
    "WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND strlen(t) <= 40) AS w FROM documents), "
    "c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'license')) AS c0, len(list_filter(w, lambda x: x = 'public')) AS c1 FROM t), "
    "a AS (SELECT count(*) AS n_all, avg(n) AS mean, count(*) FILTER (c0 > 0) AS d0, count(*) FILTER (c1 > 0) AS d1 FROM c) "
    f"SELECT doc_id, round({_BM25.format(0)} + {_BM25.format(1)}, 6) AS score FROM c, a WHERE c0 > 0 OR c1 > 0"
)
def fts_bm25(s, d):
    """All texts that hold either term, with their score."""
    return text.bm25(table(s, d, "documents"), "doc_id", "text", ["license", "public"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id FROM documents WHERE {_duck_match('license')} AND ({_duck_match('src0', 'source')} OR {_duck_match('src0')})")
def fts_terms_across_columns(s, d):
    return table(s, d, "documents").filter(text.text_match_any(["text", "source"], "license AND src0")).select("doc_id")


# JSON


@query(WITH + "SELECT span_id FROM spans WHERE json_extract_string(metadata, '$.k') = '69'")
def b6_jsonpath(s, d):
    return spans(s, d).filter(jsonpath.json_path_eq("metadata", "k", "69")).select("span_id")


@query(WITH + "SELECT span_id FROM spans WHERE json_extract_string(metadata, '$.k')::double >= 90")
def json_path_range(s, d):
    return spans(s, d).filter(jsonpath.json_path_compare("metadata", "k", ">=", 90)).select("span_id")


_TAGS = "to_json(named_struct('tags', array(named_struct('n', model), named_struct('n', status)), 'e', CASE WHEN status = 'error' THEN array() ELSE array(1) END, 'p', named_struct('q', span_type))) AS m"


@query(WITH + "SELECT span_id FROM spans WHERE model = 'm2' OR status = 'm2'")
def json_path_array_any(s, d):
    return spans(s, d).selectExpr("span_id", _TAGS).filter(jsonpath.json_path_eq("m", "tags[*].n", "m2")).select("span_id")


@query(WITH + "SELECT span_id FROM spans WHERE span_type = 'click'")
def json_path_nested(s, d):
    return spans(s, d).selectExpr("span_id", _TAGS).filter(jsonpath.json_path_eq("m", "p.q", "click")).select("span_id")


@query(WITH + "SELECT 'k' AS path, count(*) AS presence, count(DISTINCT json_extract_string(metadata, '$.k')) AS distinct_values FROM spans")
def json_path_discovery(s, d):
    return jsonpath.discover(spans(s, d), "metadata", "span_id")


@query(WITH + "SELECT span_id AS key, 'k' AS path, json_extract_string(metadata, '$.k') AS value FROM spans")
def json_leaves(s, d):
    return jsonpath.leaves(spans(s, d), "metadata", "span_id")


# vectors


_DISTANCE = "list_distance(a.embedding::double[], b.embedding::double[])"
#: The queries are all vectors whose id is divisible by 100.
_ASKED = "FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id"
_NEAREST = f"SELECT query, vec_id, round(distance, 6) AS distance, place FROM (SELECT a.vec_id AS query, b.vec_id AS vec_id, {_DISTANCE} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DISTANCE}, b.vec_id) AS place {_ASKED} WHERE {_DISTANCE} IS NOT NULL AND {{}}) WHERE place <= 10"


def _asked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").filter("vec_id % 100 = 0")


def _rounded(found: DataFrame, *more: str) -> DataFrame:
    return found.select("query", "vec_id", F.round("distance", 6).alias("distance"), *more)


@query(_NEAREST.format("true"))
def knn_l2(s, d):
    """The 10 nearest other vectors of each query vector."""
    return _rounded(vectors.nearest_of_each(_asked(s, d), vectors.checked(table(s, d, "embeddings"), "embedding", 64), 10), "place")


@query(_NEAREST.format("b.label = 3"))
def knn_filtered(s, d):
    return _rounded(vectors.nearest_of_each(_asked(s, d), table(s, d, "embeddings").filter("label = 3"), 10), "place")


@query(f"SELECT a.vec_id AS query, b.vec_id AS vec_id, round({_DISTANCE}, 6) AS distance {_ASKED} WHERE {_DISTANCE} <= 1.2")
def knn_radius(s, d):
    return _rounded(vectors.within_of_each(_asked(s, d), table(s, d, "embeddings"), 1.2))


@query("SELECT vec_id AS query, 10 AS found, true AS recall_reached FROM embeddings WHERE vec_id % 100 = 0")
def knn_index(s, d):
    """The index of cells against the exact search: how many are found of each query, and whether the recall over all is 0.9 at least."""
    own = table(s, d, "embeddings")
    exact = vectors.nearest_of_each(_asked(s, d), own, 10)
    found = vectors.CellIndex(own, 32).nearest(_asked(s, d), 10, 26)
    # written, as the recall and the counts both read it
    met = stored(found.select("query", "vec_id", "place").join(exact.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left"), "met")
    recall = met.agg((F.count("hit") / F.count(F.lit(1)) >= 0.9).alias("recall_reached"))
    return met.groupBy("query").agg(F.count(F.lit(1)).cast("int").alias("found")).crossJoin(F.broadcast(recall))


# lifecycle


def _versions(s: SparkSession, d: str) -> DataFrame:
    """Spans, and a later version of those with errors."""
    own = spans(s, d)
    again = own.filter("status = 'error'").withColumns({"commit_id": F.col("commit_id") + 1_000_000_000, "cost_usd": F.col("cost_usd") * 2, "status": F.lit("retried")})
    return own.unionByName(again)


_VERSIONS = f"WITH {SPANS_SQL}, v AS (SELECT * FROM spans UNION ALL SELECT * REPLACE (commit_id + 1000000000 AS commit_id, cost_usd * 2 AS cost_usd, 'retried' AS status) FROM spans WHERE status = 'error') "
_LATEST = _VERSIONS + "SELECT span_id, status, cost_usd, commit_id FROM v QUALIFY row_number() OVER (PARTITION BY tenant_id, span_id ORDER BY {}) = 1"
_KEPT = ("span_id", "status", "cost_usd", "commit_id")


@query(_LATEST.format("commit_id DESC"))
def dedup_latest(s, d):
    return lifecycle.latest(_versions(s, d)).select(*_KEPT)


@query(_LATEST.format("trace_id, start_time_ms, commit_id DESC"))
def dedup_trace_order(s, d):
    return lifecycle.latest(_versions(s, d), "trace_order").select(*_KEPT)


@query(_LATEST.format("commit_id DESC"))
def compact_idempotent(s, d):
    return lifecycle.compacted(lifecycle.compacted(_versions(s, d))).select(*_KEPT)


@query(_VERSIONS + "SELECT status, count(*) AS n FROM v GROUP BY status")
def wal_union_visible(s, d):
    return _versions(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "SELECT tenant_id, trace_id, min(start_time_ms) AS first_start, max(end_time_ms) AS last_end, count(*) AS n_spans, count(*) FILTER (status = 'error') AS n_errors FROM spans GROUP BY ALL")
def trace_locality_bounds(s, d):
    return lifecycle.trace_bounds(spans(s, d))


@query(WITH + "SELECT model AS unit, count(*) AS n_rows, min(start_time_ms) AS min_start_time_ms, max(start_time_ms) AS max_start_time_ms, 0 AS nulls_start_time_ms, min(trace_id) AS min_trace_id, max(trace_id) AS max_trace_id, 0 AS nulls_trace_id FROM spans GROUP BY model")
def zone_map_stats(s, d):
    return lifecycle.zone_map(spans(s, d), ["start_time_ms", "trace_id"], F.col("model"))


@query(WITH + "SELECT tenant_id, partition_id, span_id, 5000 + row_number() OVER (PARTITION BY tenant_id, partition_id ORDER BY trace_id, start_time_ms, span_id) - 1 AS commit_id FROM spans")
def commit_allocation(s, d):
    return lifecycle.with_commits(spans(s, d), 5000).select("tenant_id", "partition_id", "span_id", "commit_id")


@query(PARENT + "SELECT tenant_id, parent_span_id AS span_id, count(*) AS n_children, sum(duration_ms)::bigint AS children_ms FROM tree WHERE parent_span_id IS NOT NULL GROUP BY ALL")
def trace_tree_children(s, d):
    return lifecycle.children(with_parent(spans(s, d)))


# tenancy and the dialect


@query(WITH + "SELECT count(*) AS n, max(tenant_id) AS most FROM spans WHERE tenant_id = 2")
def tenant_isolation_count(s, d):
    return Engine(spans(s, d)).sql("SELECT count(*) AS n, max(tenant_id) AS most FROM spans", 2)


@query(WITH + "SELECT span_id, duration_ms FROM spans WHERE tenant_id = 1 AND json_extract_string(metadata, '$.k') = '69' AND status = 'ok'")
def dialect_jsonpath(s, d):
    return Engine(spans(s, d)).sql("SELECT span_id, duration_ms FROM spans WHERE metadata.k = '69' AND status = 'ok'", 1)


@query(WITH + "SELECT model, count(*) AS n, list_sort(list(duration_ms))[least(floor(count(*) * 0.95::double), count(*) - 1)::int + 1] AS p95 FROM spans WHERE tenant_id = 1 GROUP BY model ORDER BY model")
def dialect_percentile(s, d):
    return Engine(spans(s, d)).sql("SELECT model, count(*) AS n, percentile(duration_ms, 0.95) AS p95 FROM spans GROUP BY model ORDER BY model", 1)


@query(WITH + "SELECT span_id FROM spans WHERE tenant_id = 3 AND regexp_matches(lower(span_type), '(^|[^\\p{L}\\p{N}])(click|view)($|[^\\p{L}\\p{N}])') AND start_time_ms >= 1704070000000")
def dialect_text_match(s, d):
    return Engine(spans(s, d)).sql("SELECT span_id FROM spans WHERE text_match(span_type, 'click view') AND start_time_ms >= 1704070000000", 3)


@query(WITH + "SELECT span_id FROM spans WHERE tenant_id = 2 AND (coalesce(json_extract_string(metadata, '$.k')::double, 0) >= 90 OR coalesce(json_extract_string(metadata, '$.k')::double, 100) < 5)")
def dialect_json_range(s, d):
    return Engine(spans(s, d)).sql("SELECT span_id FROM spans WHERE metadata.k >= 90 OR 5 > metadata.k", 2)


@query(WITH + "SELECT span_id, json_extract_string(metadata, '$.k') AS k FROM spans WHERE tenant_id = 1 AND json_extract_string(metadata, '$.k') IN ('3', '5', '69') AND json_extract_string(metadata, '$.k') NOT LIKE '5%'")
def dialect_json_in(s, d):
    return Engine(spans(s, d)).sql("SELECT span_id, metadata.k AS k FROM spans WHERE metadata.k IN ('3', '5', '69') AND metadata.k NOT LIKE '5%'", 1)


@query(WITH + ", own AS (SELECT * FROM spans WHERE tenant_id = 1), x AS (SELECT trace_id FROM own WHERE status = 'error' GROUP BY trace_id) SELECT model, count(*) AS n FROM own JOIN x USING (trace_id) GROUP BY model")
def dialect_with_join(s, d):
    return Engine(spans(s, d)).sql("WITH x AS (SELECT trace_id FROM spans WHERE status = 'error' GROUP BY trace_id) SELECT model, count(*) AS n FROM spans JOIN x USING (trace_id) GROUP BY model", 1)


# ingest


@query(WITH + "SELECT span_id AS request_id, tenant_id, 0 AS partition_id, start_time_ms, end_time_ms, greatest(end_time_ms - start_time_ms, 0) AS duration_ms, model, 26 AS id_length FROM spans")
def ingest_defaults(s, d):
    one = F.struct("start_time_ms", "end_time_ms", "model", F.col("span_id").alias("request_id"))
    requests = spans(s, d).groupBy("tenant_id", "trace_id").agg(F.collect_list(one).alias("spans")).select(F.to_json(F.struct("tenant_id", "spans")).alias("body"))
    return ingest.ingest_json(requests).select("request_id", "tenant_id", "partition_id", "start_time_ms", "end_time_ms", "duration_ms", "model", F.length("span_id").alias("id_length"))


def _otlp(s: SparkSession, d: str) -> DataFrame:
    value = lambda **v: F.struct(*[c.alias(k) for k, c in v.items()])
    attributes = F.array(
        F.struct(F.lit("gen_ai.response.model").alias("key"), F.struct(F.col("model").alias("stringValue"), F.lit(None).cast("string").alias("intValue"), F.lit(None).cast("double").alias("doubleValue")).alias("value")),
        F.struct(F.lit("gen_ai.usage.input_tokens").alias("key"), F.struct(F.lit(None).cast("string").alias("stringValue"), F.col("duration_ms").cast("string").alias("intValue"), F.lit(None).cast("double").alias("doubleValue")).alias("value")),
        F.struct(F.lit("gen_ai.request.temperature").alias("key"), F.struct(F.lit(None).cast("string").alias("stringValue"), F.lit(None).cast("string").alias("intValue"), F.lit(0.5).alias("doubleValue")).alias("value")),
        F.struct(F.lit("request.id").alias("key"), F.struct(F.col("span_id").alias("stringValue"), F.lit(None).cast("string").alias("intValue"), F.lit(None).cast("double").alias("doubleValue")).alias("value")),
    )
    nanos = lambda c: F.concat(F.col(c).cast("string"), F.lit("999999"))
    one = F.struct(
        F.substring(F.sha2("trace_id", 256), 1, 32).alias("traceId"), F.substring(F.sha2("span_id", 256), 1, 16).alias("spanId"), F.lit("").alias("parentSpanId"), F.col("span_type").alias("name"), nanos("start_time_ms").alias("startTimeUnixNano"), nanos("end_time_ms").alias("endTimeUnixNano"),
        value(code=F.when(F.col("status") == "error", 2).otherwise(1)).alias("status"), attributes.alias("attributes"),
    )
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.lit("svc").alias("stringValue")).alias("value"))).alias("attributes"))
    grouped = spans(s, d).groupBy("trace_id").agg(F.collect_list(one).alias("spans"))
    return grouped.select(F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans"))).alias("body"))


@query(WITH + "SELECT span_id AS request_id, start_time_ms, end_time_ms, duration_ms, 'llm_call' AS span_type, status, 'svc' AS provider, model, duration_ms AS prompt_tokens, 0.5::double AS temperature, span_type AS span_name FROM spans")
def otlp_normalise(s, d):
    out = ingest.ingest_otlp(_otlp(s, d), 9)
    return out.select("request_id", "start_time_ms", "end_time_ms", "duration_ms", "span_type", "status", "provider", "model", "prompt_tokens", "temperature", F.get_json_object("metadata", "$.otel_span_name").alias("span_name"))


def _typed(s: SparkSession, d: str) -> DataFrame:
    """One request for each span: repeated keys and attributes of all kinds."""
    sql = """concat('{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"ab","spanId":"', lpad(substring(span_id, 2), 16, '0'), '","name":"x","attributes":[',
 '{"key":"a","value":{"stringValue":"first"}},{"key":"a","value":{"stringValue":"', model, '"}},{"key":"n","value":{"intValue":', duration_ms, '}},{"key":"s","value":{"intValue":"', duration_ms, '"}},',
 '{"key":"d","value":{"doubleValue":0.5}},{"key":"b","value":{"boolValue":true}},{"key":"l","value":{"arrayValue":{"values":[]}}},{"value":{"stringValue":"no key"}},{"key":"gen_ai.request.model","value":{"intValue":"1"}},',
 '{"key":"gen_ai.request.model","value":{"stringValue":"', model, '"}},{"key":"request.id","value":{"stringValue":"', span_id, '"}}]}]}]}]}')"""
    return spans(s, d).select(F.expr(sql).alias("body"))


@query(WITH + "SELECT span_id AS request_id, model, 'llm_call' AS span_type, model AS a FROM spans")
def otlp_repeated_key(s, d):
    """Of a repeated key the last counts in the metadata, and the first that is a text as the model."""
    return ingest.ingest_otlp(_typed(s, d), 9).select("request_id", "model", "span_type", F.get_json_object("metadata", "$.attributes.a").alias("a"))


@query(WITH + "SELECT span_id AS request_id, duration_ms::varchar AS n, '\"' || duration_ms || '\"' AS s, '0.5' AS d, 'true' AS b, 'null' AS l FROM spans")
def otlp_typed_attributes(s, d):
    """The values of attributes as JSON: numbers stay numbers and texts stay texts."""
    out = ingest.ingest_otlp(_typed(s, d), 9).select("request_id", F.parse_json("metadata").alias("m"))
    return out.select("request_id", *[F.to_json(F.variant_get("m", f"$.attributes.{k}", "variant")).alias(k) for k in "nsdbl"])


@query(
    WITH + "SELECT CASE span_type WHEN 'error' THEN 'malformed' WHEN 'click' THEN 'no tenant_id' WHEN 'view' THEN 'no spans' ELSE 'a span without start or end' END AS reason, count(*) AS n FROM spans GROUP BY 1"
)
def ingest_rejects(s, d):
    """Requests that are refused, by reason."""
    body = F.when(F.col("span_type") == "error", '{"tenant_id": 1, "spans": [').when(F.col("span_type") == "click", '{"spans": []}').when(F.col("span_type") == "view", '{"tenant_id": 1}').otherwise('{"tenant_id": 1, "spans": [{"start_time_ms": 5}]}')
    return ingest.ingest_rejects(spans(s, d).select(body.alias("body"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    WITH + "SELECT trace_id AS request_id, tenant_id, CASE WHEN status = 'error' THEN status END AS status, nullif(duration_ms % 3, 0) AS prompt_tokens, nullif(cost_usd, 0) AS cost_usd, metadata, 26 AS id_length, true AS no_parent, true AS no_embedding FROM spans"
)
def proto_normalise(s, d):
    """Records with empty texts and zeros for nulls, ids as bytes and metadata as bytes."""
    records = spans(s, d).select(
        "tenant_id", "partition_id", F.unhex(F.sha2("trace_id", 256)).alias("hash"), "start_time_ms", "end_time_ms", "duration_ms", F.when(F.col("status") == "error", "error").otherwise("").alias("status"), (F.col("duration_ms") % 3).alias("prompt_tokens"),
        "cost_usd", F.col("metadata").cast("binary").alias("metadata_json"), F.col("trace_id").alias("request_id"), F.unhex(F.lit("")).alias("parent_span_id"), F.expr("cast(array() as array<float>)").alias("embedding"), F.col("span_id").cast("binary").alias("span_bytes"),
    )
    records = records.withColumns({"trace_id": F.expr("substring(hash, 1, 16)"), "span_id": F.expr("substring(span_bytes, 1, 8)")}).drop("hash", "span_bytes")
    out = ingest.from_proto(records)
    return out.select("request_id", "tenant_id", "status", "prompt_tokens", "cost_usd", "metadata", F.length("span_id").alias("id_length"), F.col("parent_span_id").isNull().alias("no_parent"), F.col("embedding").isNull().alias("no_embedding"))


# windows and streams

_TIME = "make_timestamp(start_time_ms * 1000)"


@query(WITH + f"SELECT epoch_us(time_bucket(INTERVAL 1 hour, {_TIME})) AS start_us, tenant_id, count(*) AS n, count(*) FILTER (status = 'error') AS errors, round(avg(duration_ms), 6) AS mean_ms FROM spans GROUP BY 1, 2")
def tumbling_window(s, d):
    w = streams.windowed(spans(s, d), "1 hour")
    return w.select(F.unix_micros("start").alias("start_us"), "tenant_id", "n", "errors", F.round("mean_ms", 6).alias("mean_ms"))


@query(
    WITH + f"SELECT epoch_us(b - k * INTERVAL 30 minute) AS start_us, tenant_id, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL 30 minute, {_TIME}) AS b FROM spans), (VALUES (0), (1)) AS o(k) GROUP BY 1, 2"
)
def sliding_window(s, d):
    return streams.windowed(spans(s, d), "1 hour", "30 minutes").select(F.unix_micros("start").alias("start_us"), "tenant_id", "n")


@query(
    WITH + ", g AS (SELECT *, CASE WHEN start_time_ms - lag(start_time_ms) OVER w < 600000 THEN 0 ELSE 1 END AS fresh FROM spans WINDOW w AS (PARTITION BY tenant_id, trace_id ORDER BY start_time_ms, span_id)), "
    "h AS (SELECT *, sum(fresh) OVER (PARTITION BY tenant_id, trace_id ORDER BY start_time_ms, span_id) AS session FROM g) "
    "SELECT tenant_id, trace_id, min(start_time_ms) AS first_ms, count(*) AS n FROM h GROUP BY tenant_id, trace_id, session"
)
def session_window(s, d):
    return streams.sessions(spans(s, d), "10 minutes").select("tenant_id", "trace_id", F.unix_millis("start").alias("first_ms"), "n")


@query(WITH + "SELECT span_id, trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY cost_usd DESC, span_id) AS place FROM spans QUALIFY place <= 3")
def rank_window(s, d):
    order = Window.partitionBy("trace_id").orderBy(F.desc("cost_usd"), "span_id")
    return spans(s, d).select("span_id", "trace_id", F.row_number().over(order).alias("place")).filter("place <= 3")


@query(WITH + "SELECT span_id, sum(duration_ms) OVER (PARTITION BY trace_id ORDER BY start_time_ms, span_id ROWS UNBOUNDED PRECEDING)::bigint AS running_ms FROM spans")
def running_sum(s, d):
    order = Window.partitionBy("trace_id").orderBy("start_time_ms", "span_id").rowsBetween(Window.unboundedPreceding, 0)
    return spans(s, d).select("span_id", F.sum("duration_ms").over(order).alias("running_ms"))


@query(WITH + "SELECT a.span_id, (SELECT max(b.start_time_ms) FROM spans b WHERE b.trace_id = a.trace_id AND b.status = 'error' AND b.start_time_ms <= a.start_time_ms) AS last_error_ms FROM spans a WHERE a.status = 'ok'")
def asof_join(s, d):
    """The last error of the trace at or before each span, by one pass over the trace in place of a range join."""
    order = Window.partitionBy("trace_id").orderBy("start_time_ms").rangeBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("status") == "error", F.col("start_time_ms"))).over(order)
    return spans(s, d).withColumn("last_error_ms", last).filter("status = 'ok'").select("span_id", "last_error_ms")


@query(WITH + "SELECT trace_id FROM spans WHERE status = 'error' INTERSECT SELECT trace_id FROM spans WHERE model = 'm1'")
def set_intersect(s, d):
    own = spans(s, d)
    return own.filter("status = 'error'").select("trace_id").intersect(own.filter("model = 'm1'").select("trace_id"))


@query(WITH + "SELECT trace_id FROM spans WHERE status = 'error' UNION SELECT trace_id FROM spans WHERE model = 'm1'")
def set_union(s, d):
    own = spans(s, d)
    return own.filter("status = 'error'").select("trace_id").union(own.filter("model = 'm1'").select("trace_id")).distinct()


@query(WITH + "SELECT trace_id FROM spans WHERE status = 'error' UNION ALL SELECT trace_id FROM spans WHERE model = 'm1'")
def set_union_all(s, d):
    own = spans(s, d)
    return own.filter("status = 'error'").select("trace_id").union(own.filter("model = 'm1'").select("trace_id"))


@query(WITH + "SELECT trace_id FROM spans WHERE status = 'error' EXCEPT SELECT trace_id FROM spans WHERE model = 'm1'")
def set_except(s, d):
    own = spans(s, d)
    return own.filter("status = 'error'").select("trace_id").subtract(own.filter("model = 'm1'").select("trace_id"))


@query(WITH + "SELECT DISTINCT a.trace_id FROM spans a WHERE EXISTS (SELECT 1 FROM spans b WHERE b.trace_id = a.trace_id AND b.duration_ms > 900)")
def semi_join(s, d):
    own = spans(s, d)
    return own.join(own.filter("duration_ms > 900").select("trace_id"), "trace_id", "left_semi").select("trace_id").distinct()


@query(WITH + "SELECT e.span_id AS error_id, s.span_id AS span_id FROM spans e JOIN spans s ON e.status = 'error' AND s.tenant_id = e.tenant_id AND s.start_time_ms BETWEEN e.start_time_ms - 60000 AND e.start_time_ms + 60000")
def interval_join(s, d):
    """Spans that start within a minute of an error of their tenant. Both sides are cut into minutes, and an error stands in its own and the two next to it, so the join is one of equal keys."""
    own = spans(s, d)
    minute = F.floor(F.col("start_time_ms") / 60_000)
    errors = own.filter("status = 'error'").select("tenant_id", F.col("span_id").alias("error_id"), F.col("start_time_ms").alias("at"), F.explode(F.array(minute - 1, minute, minute + 1)).alias("minute"))
    near = own.select("tenant_id", "span_id", "start_time_ms", minute.alias("minute")).join(errors, ["tenant_id", "minute"])
    return near.filter(F.abs(F.col("start_time_ms") - F.col("at")) <= 60_000).select("error_id", "span_id")


@query(
    WITH + ", n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_time_ms, span_id) AS k FROM spans WHERE tenant_id = 1) SELECT span_id, floor(log2(k))::int AS depth FROM n WHERE trace_id = (SELECT arg_min(trace_id, span_id) FROM n WHERE k = 1)"
)
def trace_subtree(s, d):
    """All spans below the first span of a trace, with their depth; the k-th span of a trace has the k/2-th as its parent here."""
    own = spans(s, d).filter("tenant_id = 1").select("tenant_id", "trace_id", "span_id", "start_time_ms")
    # one aggregate finds the trace; only its spans are numbered and joined
    firsts = own.groupBy("trace_id").agg(F.min_by("span_id", F.struct(F.isnull("start_time_ms"), "start_time_ms", F.isnull("span_id"), "span_id")).alias("span_id"))
    root = firsts.filter("span_id is not null").orderBy("span_id", "trace_id").first()
    k = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.asc_nulls_last("start_time_ms"), F.asc_nulls_last("span_id")))
    trace = stored(own.filter(F.col("trace_id") == (root.trace_id if root else "")).select("tenant_id", "span_id", k.alias("k")), "trace")
    parents = trace.select(F.col("k").alias("above"), F.col("span_id").alias("parent_span_id"))
    tree = trace.withColumn("above", F.floor(F.col("k") / 2).cast("int")).join(parents, "above", "left")
    return lifecycle.subtree(tree, root.span_id if root else "", 1)


@query(WITH + "SELECT DISTINCT trace_id FROM spans WHERE trace_id NOT IN (SELECT trace_id FROM spans WHERE duration_ms > 900)")
def anti_join(s, d):
    own = spans(s, d)
    return own.join(own.filter("duration_ms > 900").select("trace_id").distinct(), "trace_id", "left_anti").select("trace_id").distinct()


def _store(s: SparkSession) -> SpanStore:
    """A store of its own in the folder that all executors share."""
    return SpanStore(s, new_path(s, "store"))


@query(_LATEST.format("commit_id DESC"))
def store_compaction(s, d):
    """Two appended batches, one compaction, one batch after it, and the latest of all."""
    store = _store(s)
    own = spans(s, d)
    store.append(ingest.conformed(own))
    store.append(ingest.conformed(own.filter("status = 'error'")))
    store.compact()
    store.append(ingest.conformed(_versions(s, d).filter("status = 'retried'")))
    return store.spans().select(*_KEPT)


@query(WITH + "SELECT span_id, model, status FROM spans WHERE trace_id = 't00000008'")
def store_trace_lookup(s, d):
    """One trace of a store with a compacted version and a batch after it."""
    store = _store(s)
    own = ingest.conformed(spans(s, d))
    store.append(own)
    store.compact()
    store.append(own.filter("status = 'error'").withColumn("commit_id", F.col("commit_id") + 1_000_000_000))
    return store.spans().filter("trace_id = 't00000008'").select("span_id", "model", "status")


@query(WITH + "SELECT kind, sum(n_rows)::bigint AS n_rows, min(a) AS first_ms, max(b) AS last_ms FROM (SELECT 'silver' AS kind, count(*) AS n_rows, min(start_time_ms) AS a, max(start_time_ms) AS b FROM spans UNION ALL SELECT 'bronze', count(*), min(start_time_ms), max(start_time_ms) FROM spans WHERE status = 'error') GROUP BY kind")
def store_manifest(s, d):
    """The parts of a store with their rows and bounds."""
    store = _store(s)
    own = ingest.conformed(spans(s, d))
    store.append(own)
    store.compact()
    store.append(own.filter("status = 'error'"))
    return store.manifest().select("kind", F.col("rows").alias("n_rows"), F.col("min_start_time_ms").alias("first_ms"), F.col("max_start_time_ms").alias("last_ms"))


@query(WITH + "SELECT model, round(sum(length(trace_id)), 0)::bigint AS n, count(*) FILTER (json_extract_string(metadata, '$.k') = '69') AS k FROM spans GROUP BY model")
def sql_functions(s, d):
    """The functions for plain SQL."""
    register(s)
    own = spans(s, d)
    return s.sql("SELECT model, sum(length(trace_id)) + sum(length(ulid_from_hex('ff')) - 26) + sum(int(l2_distance(array(1D), array(1D)))) AS n, count_if(json_path_eq(metadata, 'k', '69')) AS k FROM {own} GROUP BY model", own=own)


@query(WITH + "SELECT model, count(*) AS n FROM spans GROUP BY model")
def stream_append(s, d):
    """A stream of the event files into a store, read back."""
    store = _store(s)
    raw = streams.stream(s, f"{d}/events.parquet*", table(s, d, "events").schema)
    streams.append_to(ingest.conformed(spans_of(raw)), store, f"{store.root}/checkpoint").awaitTermination()
    return store.raw().groupBy("model").agg(F.count(F.lit(1)).alias("n"))


# star schema


@query(
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL"
)
def tpch_q1(s, d):
    price = F.col("l_extendedprice")
    kept = table(s, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base_price"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count(F.lit(1)).alias("n"))


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1995-01-01' AND l_discount BETWEEN 0.049 AND 0.071 AND l_quantity < 24")
def tpch_q6(s, d):
    kept = table(s, d, "lineitem").filter("l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1995-01-01' AND l_discount BETWEEN 0.049D AND 0.071D AND l_quantity < 24")
    return kept.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query(
    "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15' GROUP BY l_orderkey"
)
def tpch_q3(s, d):
    c = table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(s, d, "orders").filter("o_orderdate < DATE '1995-03-15'").select("o_orderkey", "o_custkey")
    li = table(s, d, "lineitem").filter("l_shipdate > DATE '1995-03-15'").select("l_orderkey", "l_extendedprice", "l_discount")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return joined.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
