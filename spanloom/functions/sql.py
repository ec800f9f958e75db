"""Functions for plain Spark SQL. They are SQL functions, so the optimiser sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .scalars import CROCKFORD
from .text import LONGEST_TOKEN, OTHER

_PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_OTHER = OTHER.replace("\\", "\\\\")

FUNCTIONS = {
    "l2_distance": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "CASE WHEN size(a) = size(b) THEN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)) END",
    ),
    "ulid_from_hex": (
        "h STRING", "STRING",
        f"translate(concat(lpad(conv(substring(lpad(h, 32, '0'), 1, 2), 16, 32), 2, '0'), lpad(conv(substring(lpad(h, 32, '0'), 3, 15), 16, 32), 12, '0'), lpad(conv(substring(lpad(h, 32, '0'), 18, 15), 16, 32), 12, '0')), '{_PLAIN}', '{CROCKFORD}')",
    ),
    "ulid_from_bytes": ("b BINARY", "STRING", "ulid_from_hex(hex(b))"),
    "nanos_to_ms": ("n STRING", "BIGINT", "coalesce(cast(floor(try_cast(n AS DECIMAL(38, 0)) / 1000000) AS BIGINT), 0)"),
    "text_tokens": ("t STRING", "ARRAY<STRING>", f"filter(split(lower(t), '{_OTHER}+'), x -> x <> '' AND octet_length(x) <= {LONGEST_TOKEN})"),
    "text_has": ("t STRING, term STRING", "BOOLEAN", "array_contains(text_tokens(t), lower(term))"),
    "json_path_eq": ("j STRING, path STRING, value STRING", "BOOLEAN", "coalesce(get_json_object(j, concat('$.', path)) = value, false)"),
    "json_path_number": ("j STRING, path STRING", "DOUBLE", "try_cast(get_json_object(j, concat('$.', path)) AS DOUBLE)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; gives their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
