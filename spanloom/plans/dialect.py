"""The SQL dialect: one SELECT over ``spans`` for one tenant.

Three forms are rewritten outside string literals (metadata paths, text_match and percentile); the rest is Spark SQL. ``spans`` is a common
table expression that holds the tenant's rows only. Before a statement runs, Spark's own parser reads it, and every relation
that it names must be ``spans`` or a common table expression of the statement that is in scope there.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Node, parse, pattern
from ..operators.aggregates import percentile_sql
from ..sources.schema import SPANS_SCHEMA

_STRING = re.compile(r"'(?:[^']|'')*'")
_LITERAL = r"(?:\0\d+\0|[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
_PATH = r"(?P<column>(?:\b\w+\.)?\bmetadata)\.(?P<path>\w+(?:\[\*\])?(?:\.\w+(?:\[\*\])?)*)"
_OP = r"(?P<op><=|>=|<>|!=|=|<|>)"
_IN = re.compile(rf"{_PATH}\s+(?P<no>not\s+)?in\s*\(\s*(?P<values>{_LITERAL}(?:\s*,\s*{_LITERAL})*)\s*\)", re.I)
_BETWEEN = re.compile(rf"{_PATH}\s+(?P<no>not\s+)?between\s+(?P<low>{_LITERAL})\s+and\s+(?P<high>{_LITERAL})", re.I)
_LIKE = re.compile(rf"{_PATH}\s+(?P<no>not\s+)?like\s+(?P<value>\0\d+\0)", re.I)
_NULL = re.compile(rf"{_PATH}\s+is\s+(?P<no>not\s+)?null\b", re.I)
_COMPARED = re.compile(rf"{_PATH}\s*{_OP}\s*(?P<value>{_LITERAL})(?![\w.])", re.I)
_FLIPPED = re.compile(rf"(?<![\w.\0])(?P<value>{_LITERAL})\s*{_OP}\s*{_PATH}(?![\w.(])", re.I)
_BARE = re.compile(rf"{_PATH}(?!\s*\()", re.I)
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
_MATCH = re.compile(r"\btext_match\s*\(\s*(\w+)\s*,\s*\0(\d+)\0\s*\)", re.I)
_PERCENTILE = re.compile(r"\bpercentile\s*\(\s*(\w+)\s*,\s*([0-9.]+)\s*\)", re.I)
_LIMIT = re.compile(r"\blimit\s+(\d+)\s*$", re.I)
_STRICT = re.compile(r"\b(join|having|distinct|offset|with|union|intersect|except|over)\b", re.I)
_WITH = re.compile(r"\s*with\b(\s+recursive\b)?", re.I)
#: Parentheses may nest so deep.
DEPTH = 64
#: Nodes of a parsed statement that only read. What isn't here, commands and writes above all, is refused.
NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Join LateralJoin Union UnionLoop Intersect Except SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedHaving "
    "WithWindowDefinition Window Generate UnresolvedHint Pivot Unpivot UnpivotTransformer Sample UnresolvedRelation UnresolvedInlineTable UnresolvedTableValuedFunction OneRowRelation LocalRelation Range".split()
)
#: Table functions that read nothing but their arguments.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode variant_explode_outer".split())
#: Functions that run code of the cluster's own.
_REFUSED = re.compile(r"\b(?:try_reflect|reflect|java_method)\b", re.I)
#: Whole numbers keep their type as percentiles.
_INTEGERS = {f.name: f.dataType.simpleString() for f in SPANS_SCHEMA if f.dataType.simpleString() in ("int", "bigint")}


class DialectError(ValueError):
    """A statement that the dialect doesn't have."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def check_relations(spark: SparkSession, query: str, allowed: frozenset[str] = frozenset(("spans",))) -> None:
    """Raise where a statement names a relation that isn't in ``allowed`` or a common table expression in scope, or does anything but read."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:
        raise DialectError(f"can't be read: {str(e)[:300]}") from e

    def walk(node, names: frozenset[str]) -> None:
        kind = node.nodeName().removeprefix("'")
        if kind not in NODES:
            raise DialectError(f"{kind} isn't in the dialect")
        if kind == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in names:
                raise DialectError(f"no relation {'.'.join(parts)}")
        if kind == "UnresolvedTableValuedFunction" and ".".join(_items(node.name())).lower() not in TABLE_FUNCTIONS:
            raise DialectError(f"no table function {'.'.join(_items(node.name()))}")
        if kind == "UnresolvedWith":
            recursive = node.allowRecursion()
            for own in _items(node.cteRelations()):
                name = own._1().lower()
                walk(own._2(), names | {name} if recursive else names)
                names = names | {name}
        else:
            for inner in _items(node.innerChildren()):
                walk(inner, names)
        for inner in [*_items(node.children()), *_items(node.subqueries())]:
            walk(inner, names)

    walk(plan, allowed)


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _match_sql(column: str, query: str) -> str:
    low = f"lower({column})"
    tree = parse(query)
    if tree is None:
        return f"contains({low}, {_quote(query.lower())})"

    def of(node: Node) -> str:
        if node.kind == "none":
            return f"({column} IS NOT NULL AND false)"
        if node.kind == "tokens":
            return f"({low} RLIKE {_quote(pattern(node.parts))})"
        if node.kind == "not":
            return f"(NOT {of(node.parts[0])})"
        return "(" + (" AND " if node.kind == "all" else " OR ").join(map(of, node.parts)) + ")"

    return of(tree)


def _leaf(column: str, path: str, kind: str, test: Callable[[str], str]) -> str:
    """``test`` of the leaf at a path, as a text or a number; ``[*]`` stands for any element. False where there is none."""
    steps = path.split(".")

    def key(names: list[str]) -> str:
        return _quote("$." + ".".join(names))

    def of(value: str, steps: list[str], level: int) -> str:
        at = next((i for i, s in enumerate(steps) if s.endswith("[*]")), None)
        if at is None:
            if kind == "string" and level == 0:
                return test(f"get_json_object({column}, {key(steps)})")
            value = f"try_parse_json({value})" if level == 0 else value
            return test(f"try_variant_get({value}, {key(steps) if steps else _quote('$')}, '{kind}')")
        value = f"try_parse_json({value})" if level == 0 else value
        names = [*steps[:at], steps[at].removesuffix("[*]")]
        return f"exists(try_variant_get({value}, {key(names)}, 'array<variant>'), x{level} -> {of(f'x{level}', steps[at + 1 :], level + 1)})"

    return f"coalesce({of(column, steps, 0)}, false)"


def rewritten(query: str, strict: bool = False, most_rows: int | None = None) -> str:
    """Spark SQL of a statement of the dialect. ``most_rows``: a larger LIMIT is lowered to it."""
    bare = _STRING.sub("''", query)
    if ";" in bare.rstrip().rstrip(";"):
        raise DialectError("one statement at a time")
    query = query.rstrip().rstrip(";")
    if not re.match(r"\s*(select|with)\b", query, re.I):
        raise DialectError("only SELECT")
    depth = most = 0
    for c in bare:
        depth += (c == "(") - (c == ")")
        most = max(most, depth)
    if most > DEPTH:
        raise DialectError(f"nested deeper than {DEPTH}")
    if m := _REFUSED.search(bare):
        raise DialectError(f"{m[0]} isn't in the dialect")
    if strict and (m := _STRICT.search(bare)):
        raise DialectError(f"{m[0].upper()} isn't in the dialect")
    # strings are set aside first, so that nothing in them is taken for SQL
    held: list[str] = []
    texts: list[str] = []

    def hold(sql: str, value: str = "") -> str:
        held.append(sql)
        texts.append(value)
        return f"\0{len(held) - 1}\0"

    def string(m: re.Match) -> str:
        value = m[0][1:-1].replace("''", "'")
        return hold(_quote(value), value)

    def leaf(m: re.Match, values: list[str], test: Callable[[str], str], no: bool = False) -> str:
        kind = "string" if values[0].startswith("\0") else "double"
        if any(v.startswith("\0") != (kind == "string") for v in values):
            raise DialectError("a path is compared with texts or with numbers")
        plain = _leaf(m["column"], m["path"], kind, test)
        return hold(f"(NOT {plain})" if no else plain)

    def compared(op: str) -> Callable[[re.Match], str]:
        def of(m: re.Match) -> str:
            sign = m["op"] if op == "" else _TURNED.get(m["op"], m["op"])
            no = sign in ("<>", "!=")
            return leaf(m, [m["value"]], lambda x: f"{x} {'=' if no else sign} {m['value']}", no)

        return of

    out = _STRING.sub(string, query.replace("\0", ""))
    out = _MATCH.sub(lambda m: hold(_match_sql(m[1], texts[int(m[2])])), out)
    out = _IN.sub(lambda m: leaf(m, re.split(r"\s*,\s*", m["values"]), lambda x: f"{x} IN ({m['values']})", bool(m["no"])), out)
    out = _BETWEEN.sub(lambda m: leaf(m, [m["low"], m["high"]], lambda x: f"{x} BETWEEN {m['low']} AND {m['high']}", bool(m["no"])), out)
    out = _LIKE.sub(lambda m: leaf(m, [m["value"]], lambda x: f"{x} LIKE {m['value']}", bool(m["no"])), out)
    out = _NULL.sub(lambda m: leaf(m, ["\0"], lambda x: f"{x} IS NOT NULL", not m["no"]), out)
    out = _COMPARED.sub(compared(""), out)
    out = _FLIPPED.sub(compared("turned"), out)
    out = _BARE.sub(lambda m: hold(f"get_json_object({m['column']}, {_quote('$.' + m['path'])})"), out)

    def rank(m: re.Match) -> str:
        c, q = m[1], float(m[2])
        label = f"p{m[2].removeprefix('0.').ljust(2, '0')}_{c}"
        value = percentile_sql(c, q)
        if (kind := _INTEGERS.get(c.lower())) is not None:
            value = f"cast({value} AS {kind})"
        tail = out[m.end() : m.end() + 8].lstrip().lower()
        return value if tail.startswith("as ") else f"{value} AS {label}"

    out = _PERCENTILE.sub(rank, out)
    if most_rows is not None:
        out = _LIMIT.sub(lambda m: f"LIMIT {min(int(m[1]), most_rows)}", out)
    while "\0" in out:
        out = re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], out)
    return out


class Engine:
    """Queries over spans. Every query is for one tenant, whose rows are filtered before the statement sees them. ``most_rows``: the largest LIMIT, None for any."""

    def __init__(self, spans: DataFrame, most_rows: int | None = None) -> None:
        self.spans, self.most_rows = spans, most_rows

    def sql(self, query: str, tenant_id: int, strict: bool = False) -> DataFrame:
        """The result of a statement. Relations other than ``spans`` and the statement's own raise DialectError."""
        own = self.spans.filter(F.col("tenant_id") == int(tenant_id))
        spark = self.spans.sparkSession
        text = rewritten(query, strict, self.most_rows)
        check_relations(spark, text)
        # spans is an expression of the statement, not a name that other sessions could see
        text = text.replace("{", "{{").replace("}", "}}")
        given = "spans AS (SELECT * FROM {own})"
        if m := _WITH.match(text):
            text = f"WITH{m[1] or ''} {given}, {text[m.end() :]}"
        else:
            text = f"WITH {given} {text}"
        return spark.sql(text, own=own)

    def rows_json(self, query: str, tenant_id: int) -> DataFrame:
        """The result with each row as JSON."""
        return self.sql(query, tenant_id).select(F.to_json(F.struct("*")).alias("row_json"))
