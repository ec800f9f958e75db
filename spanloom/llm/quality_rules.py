"""Quality rules as a short-circuit cascade.

Each rule is a JVM expression. On a sample of the documents the cost of each rule is timed and the rules' answers are
tabulated; then rules are put in order, each time taking the one that rejects most of what is left for its cost. A
document is tested in that order until a rule rejects it. The order changes how long the filter takes, never what it keeps.

Rules share features, such as the words of the text. A feature is made where the first rule needs it, if the document comes so far, and
costs the rules after that nothing.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import is_parquet, remove, stored

#: Documents, about, on which rules are timed, and the files that they come from. The same at any size of the table.
SAMPLE_ROWS, SAMPLE_FILES = 5_000, 16

SPACE = "[ \\t\\n\\r]+"
#: Features in Spark and in DuckDB.
FEATURES = {
    "words": (f"split(text, '{SPACE}')", "regexp_split_to_array(text, '[ \\t\\n\\r]+')"),
    "letters": ("length(text) - length(regexp_replace(text, '\\\\p{L}+', ''))", "length(regexp_replace(text, '[^\\p{L}]+', '', 'g'))"),
    "lines": ("split(text, '\\n')", "regexp_split_to_array(text, '\\n')"),
}


@dataclass(frozen=True)
class Rule:
    """``keep``: Spark SQL over ``text`` and ``feature`` that is true for documents to keep. ``duck``: the same in DuckDB."""

    name: str
    feature: str | None
    keep: str
    duck: str


def _count(pattern: str) -> tuple[str, str]:
    """Characters that match a class, in Spark and in DuckDB."""
    return f"length(regexp_replace(text, '[^{pattern}]+', ''))", f"length(regexp_replace(text, '[^{pattern}]+', '', 'g'))"


def _one(character: str) -> tuple[str, str]:
    """Occurrences of a character."""
    return (f"(length(text) - length(replace(text, '{character}', '')))",) * 2


_WORDS = "size(array_remove(words, ''))", "len(list_filter(words, lambda w: w <> ''))"
_UPPER, _SYMBOLS, _SHOUTS, _BARS = _count("\\\\p{Lu}"), _count("#$%&*<>{}~^@"), _one("!"), _one("|")
_SIZE, _UNIQUE = ("size", "len"), ("size(array_distinct", "len(list_distinct")


def _both(name: str, feature: str | None, form: str, **parts: tuple[str, str]) -> Rule:
    spark, duck = (form.format(**{k: v[i] for k, v in parts.items()}) for i in (0, 1))
    return Rule(name, feature, spark, duck.replace("\\\\", "\\"))


RULES = (
    _both("has_text", None, "length(trim(text)) >= 4"),
    _both("few_symbols", None, "{s} * 20 <= length(text)", s=_SYMBOLS),
    _both("few_capitals", "letters", "{u} * 5 <= letters * 2", u=_UPPER),
    _both("few_exclamations", None, "{s} * 25 <= length(text)", s=_SHOUTS),
    _both("few_bars", None, "{s} * 50 <= length(text)", s=_BARS),
    _both("mostly_letters", "letters", "letters * 5 >= length(text) * 2"),
    _both("word_length", "words", "length(text) between {w} * 2 and {w} * 16", w=_WORDS),
    _both("varied_words", "words", "{u}(words)) * greatest(sqrt(cast({n}(words) as double)), cast(4 as double)) >= {n}(words)", u=_UNIQUE, n=_SIZE),
    _both("varied_lines", "lines", "{u}(lines)) * 10 >= {n}(lines) * 3", u=_UNIQUE, n=_SIZE),
)


def bound(feature: str, inner: str) -> str:
    """``inner`` with the feature under its name; it is made once."""
    return f"transform(array({FEATURES[feature][0]}), {feature} -> {inner})[0]"


def alone(rule: Rule) -> str:
    return bound(rule.feature, rule.keep) if rule.feature else rule.keep


def cascade(order: list[Rule], made: frozenset[str] = frozenset()) -> str:
    """One expression that tests the rules in order, until one rejects."""
    if not order:
        return "true"
    rule, *rest = order
    new = {rule.feature} - {None} - made
    inner = f"CASE WHEN NOT ({rule.keep}) THEN false ELSE {cascade(rest, made | new)} END"
    for feature in new:
        inner = bound(feature, inner)
    return inner


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` texts: of a Parquet table, of a few files by a hash of their names; else of all rows."""
    if is_parquet(docs):
        files = docs.inputFiles()
        if len(files) > SAMPLE_FILES:
            import zlib

            files = sorted(files, key=lambda f: (zlib.crc32(f.encode()), f))[:SAMPLE_FILES]
            docs = docs.sparkSession.read.schema(docs.schema).parquet(*files)
    part = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return part.sample(fraction=min(1.0, rows / max(docs.count(), 1)), seed=1)


def in_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection for their cost, each counted on what the rules before it leave of the sample; a feature that is there already costs nothing."""
    spark = docs.sparkSession
    part = stored(sampled(docs, sample_rows), "sample")

    def seconds(keep: str) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            part.agg(F.count_if(F.expr(keep))).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    seconds("true")
    floor = seconds("length(text) >= 0")
    cost = {r.name: max(seconds(alone(r)) - floor, 1e-3) for r in rules}
    features = {f: max(seconds(bound(f, f"{f} is not null")) - floor, 0.0) for f in {r.feature for r in rules} - {None}}
    answers = part.groupBy(*[F.coalesce(F.expr(alone(r)), F.lit(False)).alias(r.name) for r in rules]).count().collect()
    remove(spark, part.stored_at)
    left, out, made = list(rules), [], set()
    while left:
        price = lambda r: max(cost[r.name] - features[r.feature], 1e-3) if r.feature in made else cost[r.name]
        best = max(left, key=lambda r: (sum(a["count"] for a in answers if not a[r.name]) / price(r), -price(r), r.name))
        out.append(best)
        left.remove(best)
        made |= {best.feature} - {None}
        answers = [a for a in answers if a[best.name]]
    return out


def passed(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that pass every rule, with all their columns.

    A null or empty text fails (it has no text). A null doc_id is treated like any other, and texts of any length are judged whole. Rows that repeat are judged each.
    Where rules reject equally much for their cost, the cheaper comes first, then the one of the greater name; what is kept is the same in any order. Columns may have any names. An
    empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), text)
    return rows.filter(F.expr(cascade(in_order(docs, rules, sample_rows)))).select("d.*")


def oracle_sql(columns: str) -> str:
    tests = " AND ".join(f"({r.duck})" for r in RULES)
    features = ", ".join(f"{duck} AS {name}" for name, (_, duck) in FEATURES.items())
    return f"SELECT {columns} FROM (SELECT *, {features} FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)) WHERE {tests}"
