"""JSON paths: equality and comparisons on a path, leaves, and discovery of paths."""

from __future__ import annotations

import json
import operator
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Objects and arrays nest at most so deep below the root for discovery.
DEPTH = 6


def _variant(column: Column | str) -> Column:
    return F.try_parse_json(F.col(column) if isinstance(column, str) else column)


def _steps(path: str) -> list[str]:
    out: list[str] = []
    for part in path.split("."):
        while part.endswith("[*]"):
            part = part[:-3]
            out.append(part) if part and not part.endswith("[*]") else None
            out.append("[*]")
            part = ""
        if part:
            out.append(part)
    return out


def _key(names: list[str]) -> str:
    return "$" + "".join("['" + n.replace("'", "\\'") + "']" for n in names)


def _any(value: Column, steps: list[str], test) -> Column:
    """Whether ``test`` holds for the value at the path, or for any element where the path goes through arrays."""
    if "[*]" not in steps:
        return test(F.try_variant_get(value, _key(steps), "string") if steps else value.cast("string"))
    at = steps.index("[*]")
    items = F.try_variant_get(value, _key(steps[:at]), "array<variant>")
    return F.exists(items, lambda x: _any(x, steps[at + 1 :], test))


def json_path_eq(column: Column | str, path: str, value: str) -> Column:
    """Whether the leaf at ``path`` has the text ``value``: strings as they are, true and false, numbers as JSON writes them, and null as "null". ``[*]`` in the path stands for any element.

    Texts that are no JSON, and paths that aren't there, give false.
    """
    steps = _steps(path.removeprefix("metadata."))
    if "[*]" not in steps:
        c = F.col(column) if isinstance(column, str) else column
        # get_json_object is cheaper where the keys are plain names
        plain = all(s.replace("_", "a").isalnum() for s in steps)
        found = F.get_json_object(c, "$." + ".".join(steps)) if plain else F.try_variant_get(_variant(c), _key(steps), "string")
        if value == "null":
            there = F.is_variant_null(F.try_variant_get(_variant(c), _key(steps), "variant"))
            return F.coalesce(found == value, there, F.lit(False))
        return F.coalesce(found == value, F.lit(False))
    return F.coalesce(_any(_variant(column), steps, lambda x: x == value), F.lit(False))


def json_path_compare(column: Column | str, path: str, op: str, value: float | int | str) -> Column:
    """Typed comparison of the leaf at ``path``: op is one of ==, !=, <, <=, > and >=. What isn't there or isn't of the type is null."""
    kind = "string" if isinstance(value, str) else "double"
    test = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    return test(F.try_variant_get(_variant(column), _key(_steps(path)), kind), F.lit(value))


def walk(value: object, prefix: str = "", depth: int = 0, most: int = DEPTH) -> Iterator[tuple[str, str | None]]:
    """(path, text) of every leaf; an array also gives (path[*], None)."""
    if depth > most:
        return
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{prefix}.{k}" if prefix else k, depth + 1, most)
    elif isinstance(value, list):
        yield prefix + "[*]", None
        for v in value:
            yield from walk(v, prefix + "[*]", depth + 1, most)
    elif isinstance(value, str):
        yield prefix, value
    elif value is None:
        yield prefix, "null"
    elif isinstance(value, bool):
        yield prefix, "true" if value else "false"
    else:
        yield prefix, json.dumps(value)


def leaves(df: DataFrame, column: str, key: str, most: int = DEPTH) -> DataFrame:
    """(key, path, value) of all leaves of a JSON column, by Arrow batches. Texts that are no JSON give nothing."""
    rows = df.select(F.col(key).alias("key"), F.col(column).cast("string").alias("json")).filter("json is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch["key"], batch["json"], strict=True):
                try:
                    value = json.loads(text)
                except ValueError:
                    continue
                out.extend((k, p, v) for p, v in walk(value, most=most))
            yield pd.DataFrame(out, columns=["key", "path", "value"])

    kind = dict(rows.dtypes)["key"]
    return rows.mapInPandas(run, f"key {kind}, path string, value string")


def discover(df: DataFrame, column: str, key: str, percent: float = 1.0, most_paths: int = 256, most_values: int = 4096, depth: int = DEPTH) -> DataFrame:
    """(path, presence, distinct_values): the paths in at least ``percent`` of the rows, the ``most_paths`` most frequent (a top-k report). More than ``most_values`` distinct values are given as so many."""
    total = F.broadcast(df.agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) * percent / 100)).alias("need")))
    found = leaves(df, column, key, depth).groupBy("path").agg(F.count_distinct("key").alias("presence"), F.least(F.count_distinct("value"), F.lit(most_values)).alias("distinct_values"))
    return found.crossJoin(total).filter(F.col("presence") >= F.col("need")).drop("need").orderBy(F.desc("presence"), "path").limit(most_paths)
