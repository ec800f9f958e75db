"""The span table's columns, in order."""

from pyspark.sql import types as T

_COLUMNS = (
    ("tenant_id", T.LongType(), False), ("partition_id", T.LongType(), False), ("trace_id", T.StringType(), False), ("span_id", T.StringType(), False),
    ("parent_span_id", T.StringType(), True), ("start_time_ms", T.LongType(), False), ("end_time_ms", T.LongType(), False), ("duration_ms", T.LongType(), False),
    ("span_type", T.StringType(), True), ("status", T.StringType(), True), ("provider", T.StringType(), True), ("model", T.StringType(), True), ("tool_name", T.StringType(), True),
    ("prompt", T.StringType(), True), ("completion", T.StringType(), True), ("prompt_tokens", T.LongType(), True), ("completion_tokens", T.LongType(), True),
    ("cost_usd", T.DoubleType(), True), ("temperature", T.DoubleType(), True), ("top_p", T.DoubleType(), True), ("tool_io_text", T.StringType(), True),
    ("user_id", T.StringType(), True), ("session_id", T.StringType(), True), ("request_id", T.StringType(), True), ("metadata", T.StringType(), True),
    ("embedding", T.ArrayType(T.FloatType()), True), ("commit_id", T.LongType(), False),
)

SPANS_SCHEMA = T.StructType([T.StructField(*c) for c in _COLUMNS])
SORT_KEY = ("trace_id", "start_time_ms", "span_id")
SPAN_TYPES = ("agent_step", "llm_call", "tool_call", "retrieval", "eval_score", "other")
STATUSES = ("ok", "error", "timeout", "cancelled")
