"""Ingest: JSON spans, OTLP/JSON traces and protobuf-shaped records to rows of the span table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import hex_to_ulid, nanos_to_ms, span_type_of, status_of
from .schema import SPANS_SCHEMA

_ATTRIBUTE = "struct<key: string, value: variant>"
OTLP = f"resourceSpans array<struct<resource: struct<attributes: array<{_ATTRIBUTE}>>, scopeSpans: array<struct<spans: array<struct<traceId: string, spanId: string, parentSpanId: string, name: string, startTimeUnixNano: string, endTimeUnixNano: string, status: struct<code: int>, attributes: array<{_ATTRIBUTE}>>>>>>>, __bad string"
#: Spans that one request may hold.
MOST_SPANS = 100_000


def conformed(df: DataFrame) -> DataFrame:
    """All columns of the span table in order; those that are missing are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SPANS_SCHEMA])


_ULID = "^[0-7][0-9A-HJKMNP-TV-Z]{25}$"


def _id(c: str) -> Column:
    """The id where it is a ULID; else one from a hash of the row, so that a retried task gives the same."""
    made = hex_to_ulid(F.substring(F.sha2(F.concat_ws("|", F.coalesce(F.col(c), F.lit("")), F.col("__row")), 256), 1, 32))
    return F.when(F.upper(F.col(c)).rlike(_ULID), F.upper(F.col(c))).otherwise(made)


def _parsed(requests: DataFrame, column: str, shape: T.StructType | str) -> DataFrame:
    """(body, r): each request as parsed. It goes through a list of one, as else filters on it would be moved below and parse it once for each mention."""
    body = F.col(column).cast("string")
    return requests.select(body.alias("body"), F.explode(F.array(F.from_json(body, shape, {"columnNameOfCorruptRecord": "__bad"}))).alias("r"))


def _requests(requests: DataFrame, column: str) -> DataFrame:
    """(body, r, reason): each request as parsed, and why it is refused, if it is."""
    fields = [f for f in SPANS_SCHEMA if f.name not in ("tenant_id", "partition_id", "commit_id", "metadata")]
    shape = T.StructType([
        T.StructField("tenant_id", T.LongType()), T.StructField("partition_id", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField("metadata", T.StringType())]))), T.StructField("__bad", T.StringType()),
    ])
    r = _parsed(requests, column, shape)
    lacks = F.exists("r.spans", lambda s: s.isNull() | s["start_time_ms"].isNull() | s["end_time_ms"].isNull())
    reason = F.when(F.col("body").isNull() | F.col("r").isNull() | F.col("r.__bad").isNotNull(), "malformed").when(F.col("r.tenant_id").isNull(), "no tenant_id").when(F.col("r.spans").isNull(), "no spans")
    return r.withColumn("reason", reason.when(F.size("r.spans") > MOST_SPANS, "too many spans").when(lacks, "a span without start or end"))


def ingest_rejects(requests: DataFrame, column: str = "body") -> DataFrame:
    """(body, reason) of the requests that ``ingest_json`` refuses, each as a whole: malformed ones, those without tenant_id or spans, with a span that lacks its times, and with more than 100,000 spans."""
    return _requests(requests, column).filter("reason is not null").select("body", "reason")


def ingest_json(requests: DataFrame, column: str = "body", base_commit: int = 1) -> DataFrame:
    """Spans of JSON requests ``{tenant_id, partition_id, spans: [...]}``; those of ``ingest_rejects`` are left out.

    partition_id is 0 where missing; ids that are missing or no ULIDs are made from the row, a parent that is none is null; duration_ms is end - start where missing, at least 0.
    """
    r = _requests(requests, column).filter("reason is null")
    s = r.select("r.tenant_id", F.coalesce("r.partition_id", F.lit(0)).alias("partition_id"), F.sha2("body", 256).alias("__b"), F.posexplode("r.spans").alias("__at", "s"))
    s = s.select("tenant_id", "partition_id", F.concat_ws("|", "__b", "__at").alias("__row"), "s.*")
    parent = F.upper("parent_span_id")
    s = s.withColumns({
        "trace_id": _id("trace_id"), "span_id": _id("span_id"), "parent_span_id": F.when(parent.rlike(_ULID), parent),
        "duration_ms": F.coalesce("duration_ms", F.greatest(F.col("end_time_ms") - F.col("start_time_ms"), F.lit(0))),
    })
    from ..operators.lifecycle import with_commits

    return conformed(with_commits(conformed(s), base_commit))


def typed(attributes: Column) -> Column:
    """Each attribute as (key, s, i, d, json): its value as a text, a long (also from a text) or a double, null where it isn't of the kind, and as it stands in the request."""
    kinds = ("stringValue", "intValue", "doubleValue", "boolValue")

    def one(a: Column) -> Column:
        raw = {k: F.to_json(F.try_variant_get(a["value"], f"$.{k}", "variant")) for k in kinds}
        text = F.when(raw["stringValue"].startswith('"'), F.try_variant_get(a["value"], "$.stringValue", "string"))
        number = F.when(~raw["doubleValue"].startswith('"'), raw["doubleValue"].try_cast("double"))
        parts = {"key": a["key"], "s": text, "i": F.btrim(raw["intValue"], F.lit('"')).try_cast("long"), "d": number, "json": F.coalesce(*raw.values(), F.lit("null"))}
        return F.named_struct(*[x for name, c in parts.items() for x in (F.lit(name), c)])

    return F.transform(attributes, one)


def attribute(attributes: Column, *names: str, kind: str = "string") -> Column:
    """The first of the ``typed`` attributes of the first name that has a value of the kind: string, long or double."""
    field = {"string": "s", "long": "i", "double": "d"}[kind]
    return F.coalesce(*[F.get(F.filter(attributes, _of(n, field)), F.lit(0))[field] for n in names])


def _of(name: str, field: str) -> Callable[[Column], Column]:
    return lambda a: (a["key"] == name) & a[field].isNotNull()


def attributes_json(attributes: Column) -> Column:
    """A JSON object of ``typed`` attributes: values as they stand in the request, null for other kinds. Of a key that repeats the last counts; null keys are left out."""
    last = F.filter(attributes, lambda a, i: a["key"].isNotNull() & ~F.exists(F.slice(attributes, i + 2, F.size(attributes)), lambda b: F.coalesce(b["key"] == a["key"], F.lit(False))))
    # to_json takes no plain text, so the key goes as an array of one
    key = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    return F.concat(F.lit("{"), F.array_join(F.transform(last, lambda a: F.concat(key(a["key"]), F.lit(":"), a["json"])), ","), F.lit("}"))


def _otlp(requests: DataFrame, column: str) -> DataFrame:
    r = _parsed(requests, column, OTLP)
    bad = F.col("body").isNull() | F.col("r").isNull() | F.col("r.__bad").isNotNull()
    return r.withColumn("reason", F.when(bad, "malformed").when(F.col("r.resourceSpans").isNull(), "no resourceSpans"))


def otlp_rejects(requests: DataFrame, column: str = "body") -> DataFrame:
    """(body, reason) of the requests that ``ingest_otlp`` refuses."""
    return _otlp(requests, column).filter("reason is not null").select("body", "reason")


def ingest_otlp(requests: DataFrame, tenant_id: int, column: str = "body", base_commit: int = 1) -> DataFrame:
    """Spans of OTLP/JSON trace requests, with the gen_ai attributes mapped to columns and all kept in metadata. Those of ``otlp_rejects`` are left out."""
    r = _otlp(requests, column).filter("reason is null")
    r = r.select(F.explode("r.resourceSpans").alias("rs")).select(F.col("rs.resource.attributes").alias("ra"), F.explode("rs.scopeSpans").alias("ss"))
    none = F.expr(f"cast(array() as array<{_ATTRIBUTE}>)")
    r = r.select(attribute(typed(F.coalesce("ra", none)), "service.name").alias("service"), F.explode("ss.spans").alias("s")).select("service", "s", typed(F.coalesce("s.attributes", none)).alias("a"))
    get = lambda *n, kind="string": attribute(F.col("a"), *n, kind=kind)
    start, end = nanos_to_ms("s.startTimeUnixNano"), nanos_to_ms("s.endTimeUnixNano")
    name = F.regexp_replace(F.to_json(F.array(F.coalesce("s.name", F.lit("")))), r"^\[|\]$", "")
    out = r.select(
        F.lit(tenant_id).cast("long").alias("tenant_id"), F.lit(0).cast("long").alias("partition_id"), hex_to_ulid(F.coalesce("s.traceId", F.lit(""))).alias("trace_id"), hex_to_ulid(F.coalesce("s.spanId", F.lit(""))).alias("span_id"),
        F.when(F.length("s.parentSpanId") > 0, hex_to_ulid("s.parentSpanId")).alias("parent_span_id"), start.alias("start_time_ms"), end.alias("end_time_ms"), F.greatest(end - start, F.lit(0)).alias("duration_ms"),
        get("gen_ai.request.model", "gen_ai.response.model").alias("model"), get("gen_ai.tool.name").alias("tool_name"), F.coalesce(get("gen_ai.system"), F.col("service")).alias("provider"),
        status_of(F.col("s.status.code")).alias("status"), get("gen_ai.prompt").alias("prompt"), get("gen_ai.completion").alias("completion"),
        get("gen_ai.usage.prompt_tokens", "gen_ai.usage.input_tokens", kind="long").alias("prompt_tokens"), get("gen_ai.usage.completion_tokens", "gen_ai.usage.output_tokens", kind="long").alias("completion_tokens"),
        get("gen_ai.request.temperature", kind="double").alias("temperature"), get("gen_ai.request.top_p", kind="double").alias("top_p"), get("user.id").alias("user_id"), get("session.id").alias("session_id"),
        get("http.request.id", "request.id").alias("request_id"), F.concat(F.lit('{"otel_span_name":'), name, F.lit(',"attributes":'), attributes_json(F.col("a")), F.lit("}")).alias("metadata"),
    )
    from ..operators.lifecycle import with_commits

    return conformed(with_commits(conformed(out.withColumn("span_type", span_type_of(F.col("model"), F.col("tool_name")))), base_commit))


def from_proto(records: DataFrame, base_commit: int = 1) -> DataFrame:
    """Spans of records that stand for nulls with empty texts, lists and zeros, as protobuf does; required columns keep theirs.

    Ids that come as bytes are ULIDs of these, zeros added at the left. metadata_json, bytes or text, is metadata where it is JSON, else null.
    """
    required = {f.name for f in SPANS_SCHEMA if not f.nullable}
    out = records
    if "metadata_json" in records.columns:
        text = F.col("metadata_json").cast("string")
        out = out.withColumn("metadata", F.when(F.try_parse_json(text).isNotNull() & (text != ""), text))
    for c in ("trace_id", "span_id", "parent_span_id"):
        if isinstance(records.schema[c].dataType if c in records.columns else None, T.BinaryType):
            out = out.withColumn(c, F.when(F.lit(c != "parent_span_id") | (F.octet_length(c) > 0), hex_to_ulid(F.hex(c))))
    for f in SPANS_SCHEMA:
        if f.name in out.columns and f.name not in required:
            if isinstance(f.dataType, T.ArrayType):
                out = out.withColumn(f.name, F.when(F.size(f.name) > 0, F.col(f.name)))
            else:
                empty = F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(0)
                out = out.withColumn(f.name, F.nullif(F.col(f.name), empty.cast(f.dataType)))
    from ..operators.lifecycle import with_commits

    return conformed(with_commits(conformed(out), base_commit))


def synthetic(spark, rows: int, tenants: int = 10, spans_a_trace: int = 10, seed: int = 7) -> DataFrame:
    """Generated spans for benchmarks, the same for the same seed."""
    i = F.col("id")
    pick = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(i, F.lit(seed + salt)), F.lit(len(values))) + 1).cast("int"))
    number = lambda salt, most: F.pmod(F.xxhash64(i, F.lit(seed + salt)), F.lit(most))
    trace = F.floor(i / spans_a_trace)
    start = F.lit(1_700_000_000_000) + trace * 1000 + F.pmod(i, F.lit(spans_a_trace)) * 50
    base = spark.range(rows).select(
        F.pmod(F.xxhash64(trace), F.lit(tenants)).alias("tenant_id"), F.lit(0).cast("long").alias("partition_id"), hex_to_ulid(F.lower(F.hex(trace))).alias("trace_id"), hex_to_ulid(F.lower(F.hex(i + (1 << 40)))).alias("span_id"),
        F.when(F.pmod(i, F.lit(spans_a_trace)) > 0, hex_to_ulid(F.lower(F.hex(i - 1 + (1 << 40))))).alias("parent_span_id"), start.alias("start_time_ms"), (start + number(1, 5000)).alias("end_time_ms"), number(1, 5000).alias("duration_ms"),
        pick(2, ["agent_step", "llm_call", "tool_call", "retrieval"]).alias("span_type"), pick(3, ["ok"] * 9 + ["error"]).alias("status"), pick(4, ["m0", "m1", "m2", "m3"]).alias("model"),
        F.concat(F.lit("step "), number(5, 1000).cast("string"), F.lit(" of the plan: "), pick(6, ["search", "timeout error", "summarise", "out of memory"])).alias("prompt"),
        number(7, 4000).alias("prompt_tokens"), (number(8, 100000) / 1e6).alias("cost_usd"), F.to_json(F.struct(number(9, 100).alias("k"))).alias("metadata"), (i + 1).alias("commit_id"),
    )
    return conformed(base)
