"""Scalar helpers of ingest and of vector search, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_to_ulid(hexadecimal: Column | str) -> Column:
    """26 characters in base 32 for up to 32 hexadecimal digits, zeros added at the left. Digits that are none count as 0."""
    padded = F.lpad(F.regexp_replace(F.lower(_c(hexadecimal)), "[^0-9a-f]", "0"), 32, "0")
    # 60 bits are 15 hexadecimal digits and 12 of base 32; 8 bits and twice 60 are 128
    parts = [(1, 2, 2), (3, 15, 12), (18, 15, 12)]
    plain = F.concat(*[F.lpad(F.conv(F.substring(padded, at, n), 16, 32), digits, "0") for at, n, digits in parts])
    return F.translate(plain, "0123456789ABCDEFGHIJKLMNOPQRSTUV", CROCKFORD)


def ulid_to_hex(ulid: Column | str) -> Column:
    """32 hexadecimal digits of a ULID of 26 characters; null where it isn't one."""
    u = F.upper(_c(ulid))
    plain = F.translate(u, CROCKFORD, "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    digits = F.lower(F.concat(*[F.lpad(F.conv(F.substring(plain, at, n), 32, 16), digits, "0") for at, n, digits in ((1, 2, 2), (3, 12, 15), (15, 12, 15))]))
    return F.when(u.rlike(f"^[{CROCKFORD}]{{26}}$"), digits)


def l2_distance(a: Column | str, b: Column | str | list[float]) -> Column:
    """Euclidean distance of two vectors, in doubles; null where one is null or they differ in length."""
    other = F.lit([float(x) for x in b]) if isinstance(b, list) else _c(b)
    squares = F.zip_with(_c(a), other, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(_c(a)) == F.size(other), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def nanos_to_ms(nanos: Column | str) -> Column:
    """Milliseconds of a text of nanoseconds; 0 where it can't be read."""
    return F.coalesce(F.floor(_c(nanos).try_cast("decimal(38,0)") / F.lit(1_000_000)).cast("long"), F.lit(0).cast("long"))


def span_type_of(model: Column, tool: Column) -> Column:
    return F.when(model.isNotNull(), "llm_call").when(tool.isNotNull(), "tool_call").otherwise("agent_step")


def status_of(code: Column) -> Column:
    return F.when(code == 2, "error").when(code == 1, "ok")


def key_text(c: Column | str) -> Column:
    """A group key as text; null is empty."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def two_valued_not(p: Column) -> Column:
    """NOT that is true where the predicate is null."""
    return ~F.coalesce(p, F.lit(False))
