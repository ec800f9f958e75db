"""Full-text matching inside the JVM.

A token is a run of letters and digits in lower case, of at most 40 bytes. A term matches where it stands between other characters
or the ends; a phrase matches as a run of tokens. The regular expression runs only on rows that hold the text at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = r"[^\p{L}\p{N}]"
LONGEST_TOKEN = 40
_LEX = re.compile(r'\s*(?:(?P<op>[()])|(?P<sign>[+-](?=\S))|"(?P<phrase>[^"]*)"|(?P<word>[^\s()"]+))')


@dataclass(frozen=True)
class Node:
    """``kind``: tokens, any, all, not, or none for what holds no token."""

    kind: str
    parts: tuple = ()


def tokens_of(text: str) -> tuple[str, ...]:
    return tuple(t for t in re.split(r"[\W_]+", text.lower()) if t and len(t.encode()) <= LONGEST_TOKEN)


def parse(query: str) -> Node | None:
    """The query's tree: terms are joined by OR; AND, OR, NOT, + and - signs, phrases and parentheses are known. None where it can't be read.

    Words without a token (signs only, or over 40 bytes) are left out of the query; a query of such words alone matches nothing.
    """
    lexed: list[tuple[str, str]] = []
    at = 0
    query = query.rstrip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m:
            return None
        at = m.end()
        kind = m.lastgroup
        value = m[kind]
        if kind == "word" and value in ("AND", "OR", "NOT"):
            kind = value
        lexed.append((kind, value))
    place = 0

    def peek() -> str:
        return lexed[place][0] + (lexed[place][1] if lexed[place][0] == "op" else "") if place < len(lexed) else ""

    def clause() -> Node | None:
        nonlocal place
        must: list[Node] = []
        should: list[Node] = []
        while place < len(lexed) and peek() != "op)":
            if peek() == "OR":
                place += 1
                continue
            sign = ""
            if peek() == "sign":
                sign = lexed[place][1]
                place += 1
            node = both()
            if node is None:
                return None
            if node.kind == "none":
                continue
            if sign == "-":
                must.append(Node("not", (node,)))
            elif sign == "+" or node.kind == "not":
                must.append(node)
            else:
                should.append(node)
        if not must and not should:
            return Node("none")
        if any(m.kind != "not" for m in must) or not should:
            # what must hold decides; optional terms only rank
            return must[0] if len(must) == 1 else Node("all", tuple(must))
        some = should[0] if len(should) == 1 else Node("any", tuple(should))
        return Node("all", (some, *must)) if must else some

    def both() -> Node | None:
        nonlocal place
        parts = [single()]
        while peek() == "AND":
            place += 1
            parts.append(single())
        if None in parts:
            return None
        parts = [p for p in parts if p.kind != "none"]
        if not parts:
            return Node("none")
        return parts[0] if len(parts) == 1 else Node("all", tuple(parts))

    def single() -> Node | None:
        nonlocal place
        kind = peek()
        if kind == "NOT":
            place += 1
            inner = single()
            return inner if inner is None or inner.kind == "none" else Node("not", (inner,))
        if kind == "op(":
            place += 1
            inner = clause()
            if peek() != "op)":
                return None
            place += 1
            return inner
        if kind in ("phrase", "word"):
            value = lexed[place][1]
            place += 1
            found = tokens_of(value)
            return Node("tokens", found) if found else Node("none")
        return None

    tree = clause()
    return tree if place == len(lexed) else None


def pattern(tokens: tuple[str, ...]) -> str:
    """A regular expression, for Java and for RE2, that finds the tokens as a run in lower-case text."""
    return f"(^|{OTHER})" + f"{OTHER}+".join(tokens) + f"($|{OTHER})"


def _column(low: Column, node: Node) -> Column:
    if node.kind == "none":
        return F.when(low.isNotNull(), F.lit(False))
    if node.kind == "tokens":
        # tokens are letters and digits only, so they stand for themselves
        found = low.rlike(pattern(node.parts))
        for t in node.parts:
            found = low.contains(t) & found
        return found
    parts = [_column(low, p) for p in node.parts]
    if node.kind == "not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if node.kind == "all" else out | p
    return out


def text_match(column: Column | str, query: str, mode: str = "tokens") -> Column:
    """Whether the text matches. ``mode``: tokens, or substring (the whole query, any case). A query that can't be read is looked for as a substring.

    A null text gives null, so it is never kept by a filter.
    """
    c = F.col(column) if isinstance(column, str) else column
    tree = parse(query) if mode == "tokens" else None
    if tree is None:
        return F.lower(c).contains(query.lower())
    return _column(F.lower(c), tree)


def text_match_any(columns: list[str], query: str) -> Column:
    """Whether the columns together match: each term or phrase may stand in any of them. A null column holds nothing."""
    tree = parse(query)
    if tree is None:
        tests = [F.lower(c).contains(query.lower()) for c in columns]
        return F.coalesce(*[F.when(t, True) for t in tests], F.lit(False))

    def of(node: Node) -> Column:
        if node.kind in ("tokens", "none"):
            return F.coalesce(*[F.when(_column(F.lower(F.col(c)), node), True) for c in columns], F.lit(False))
        parts = [of(p) for p in node.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.kind == "all" else out | p
        return ~out if node.kind == "not" else out

    return of(tree)


def tokens(column: Column | str) -> Column:
    """The tokens of a text as an array, for indexes that are kept as a column."""
    c = F.col(column) if isinstance(column, str) else column
    return F.filter(F.split(F.lower(c), f"{OTHER}+"), lambda t: (t != "") & (F.octet_length(t) <= LONGEST_TOKEN))


#: How fast a term's count saturates, and how much the length of a text counts.
K1, B = 1.2, 0.75


def _is(word: str) -> Callable[[Column], Column]:
    return lambda x: x == word


def bm25(df: DataFrame, key: str, column: str, terms: list[str]) -> DataFrame:
    """(key, score) of the texts that hold any of the terms, by BM25 over all of ``df``. Frequencies and lengths are counted over all texts; null texts have no tokens."""
    wanted = sorted({t for term in terms for t in tokens_of(term)})
    rows = df.select(F.col(key).alias(key), F.coalesce(tokens(column), F.expr("cast(array() as array<string>)")).alias("t"))
    counts = rows.select(key, F.size("t").alias("n"), *[F.size(F.filter("t", _is(w))).alias(f"c{i}") for i, w in enumerate(wanted)])
    totals = counts.agg(F.count(F.lit(1)).alias("all"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}") for i in range(len(wanted))])
    score = F.lit(0.0)
    for i in range(len(wanted)):
        rarity = F.log(1 + (F.col("all") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + rarity * F.col(f"c{i}") * (K1 + 1) / (F.col(f"c{i}") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    some = F.greatest(*[F.col(f"c{i}") for i in range(len(wanted))], F.lit(0), F.lit(0)) > 0
    # the totals are one row
    return counts.filter(some).crossJoin(F.broadcast(totals)).select(key, score.alias("score"))
