"""HTML extraction by composite text density.

A page is parsed into a tree. Each node gets a density: its characters per tag, damped where much of its text or many of its tags are
links. A node's sum is the sum of its children's densities, so the block that holds the article has the largest. The least density on
the path from that node to the body is the threshold. From the body down, each node that reaches the threshold gives the subtree of the
largest sum below it, and its other children are looked at likewise; what lies inside a subtree that is given already, or below a node
under the threshold, gives nothing more. Short texts without links, such as a line of advertising, reach the body's density too: so a
subtree's sum must also reach the least density on the path below the body, and a text that has no dense children must itself be as dense
as the children of the largest subtree are on average.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, tune

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style noscript template head title svg iframe object select textarea".split())
RAW = frozenset(("script", "style", "textarea", "title"))
BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: An opening tag that ends open elements of these names, up to the nearest of the limits.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Block elements end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile(r"[>\"']")
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}
#: What may be ended by an opening tag: names and limits, and the tags that begin or limit any of them.
SCOPES = [({"p"}, {"table", "td", "th", "article", "section", "div", "body", "blockquote"}), *ENDS.values()]
SCOPE_OF = {name: k + 1 for k, name in enumerate(ENDS)}
SCOPE_TAGS = frozenset().union(*(names | limits for names, limits in SCOPES))
SPACES = re.compile(r"\s+")
#: Least logarithm of a density's base.
LEAST_LOG = 0.1


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "chars", "tags", "link_chars", "link_tags", "density", "sum", "scopes")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        #: For each of SCOPES the nearest open element of its names, this one included, before a limit.
        self.scopes: tuple[Node | None, ...] = parent.scopes if parent else (None,) * len(SCOPES)
        if tag in SCOPE_TAGS:
            self.scopes = tuple(None if tag in limits else self if tag in names else up for up, (names, limits) in zip(self.scopes, SCOPES, strict=True))
        self.children: list[Node] = []
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag whose attributes begin at ``at`` ends, after its ``>``, which may stand in quotes; a quote that is never closed is none. ``last``: the last place of each quote."""
    while m := STOP.search(page, at):
        c = m[0]
        if c == ">":
            return m.end()
        at = page.find(c, m.end()) + 1 if m.start() < last[c] else m.end()
    return len(page)


def parse(page: str) -> Node:
    """The tree of a page; whatever is wrong in it is mended: tags without an end end with their parent, ends without a start are dropped.

    Time is linear in the page: every character is passed once, and no end or start of an element looks at elements that it doesn't end.
    """
    root = Node("#root", None)
    at, here, n = 0, root, len(page)
    last = {c: page.rfind(c) for c in "\"'"}
    opened: dict[str, int] = {}

    def close(to: Node) -> Node:
        """Ends all open elements up to ``to``, itself included."""
        up = here
        while True:
            opened[up.tag] -= 1
            if up is to:
                return up.parent
            up = up.parent

    while at < n:
        start = page.find("<", at)
        if start < 0:
            _text(here, page[at:])
            break
        c = page[start + 1 : start + 2]
        if c == "/":
            m = NAME.match(page, start + 2)
        elif c == "!" or c == "?":
            if start > at:
                _text(here, page[at:start])
            mark, until = ("<!--", "-->") if page.startswith("<!--", start) else ("<![CDATA[", "]]>") if page.startswith("<![CDATA[", start) else ("<!", ">")
            end = page.find(until, start + len(mark))
            at = end + len(until) if end >= 0 else n
            continue
        else:
            m = NAME.match(page, start + 1)
        if m is None:
            # no tag: the sign is text
            _text(here, page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            _text(here, page[at:start])
        at = tag_end(page, m.end(), last)
        name = m[0].lower()
        if c == "/":
            if opened.get(name):
                up = here
                while up.tag != name:
                    up = up.parent
                here = close(up)
            continue
        if name in ENDS_P and here.scopes[0] is not None:
            here = close(here.scopes[0])
        if name in SCOPE_OF and (up := here.scopes[SCOPE_OF[name]]) is not None:
            here = close(up)
        node = Node(name, here)
        here.children.append(node)
        here.parts.append(node)
        if name in VOID or page.endswith("/", m.end(), at - 1):
            continue
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else n
            continue
        here = node
        opened[name] = opened.get(name, 0) + 1
    return root


def _text(here: Node, raw: str) -> None:
    here.parts.append(html.unescape(raw) if "&" in raw else raw)


def in_order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


def measure(root: Node) -> Node:
    """Count characters, tags and links of every node, set densities and their sums; returns the body."""
    nodes = in_order(root)
    for node in reversed(nodes):
        if node.tag in HIDDEN:
            continue
        node.chars = sum(len(SPACES.sub(" ", p).strip()) for p in node.parts if isinstance(p, str))
        shown = [c for c in node.children if c.tag not in HIDDEN]
        node.chars += sum(c.chars for c in shown)
        node.tags = len(shown) + sum(c.tags for c in shown)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, 1 + node.tags
        else:
            node.link_chars, node.link_tags = sum(c.link_chars for c in shown), sum(c.link_tags for c in shown)
    body = next((x for x in nodes if x.tag == "body"), None) or next((x for x in nodes if x.tag == "html"), root)
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(nodes):
        node.density = density(node, ratio) if node.tag not in HIDDEN else 0.0
        node.sum = sum(c.density for c in node.children)
    return body


def density(node: Node, ratio: float) -> float:
    """Characters per tag, times the logarithm of how little of both is links; ``ratio``: link characters per character of the body.

    The logarithm's base grows with the share of links among the node's own characters, so link lists come out low. Counts of 0 in a
    denominator are 1.
    """
    if not node.chars:
        return 0.0
    tags, links, link_tags = max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
    base = math.log(node.chars * node.link_chars / max(node.chars - node.link_chars, 1) + ratio * node.chars + math.e)
    inside = node.chars / links * tags / link_tags
    # the base of a node without links comes near 1, whose logarithm is 0
    return max(node.chars / tags * math.log(max(inside, 1.0)) / max(math.log(base), LEAST_LOG), 0.0)


def bests(nodes: list[Node]) -> dict[Node, Node]:
    """Of each of ``nodes`` (parents first) the visible node of the largest sum under it, itself included; the first of equals."""
    out: dict[Node, Node] = {}
    for node in reversed(nodes):
        best = node
        for c in node.children:
            if c.tag not in HIDDEN and out[c].sum > best.sum:
                best = out[c]
        out[node] = best
    return out


def chosen(body: Node) -> tuple[list[Node], Node, float]:
    """The subtrees to extract, in the order of the page and without overlaps, the one of the largest sum, and the threshold."""
    nodes = in_order(body)
    best = bests(nodes)
    top = best[body]
    # floor: the threshold without the body
    threshold, floor, up = top.density, top.density, top
    while up is not body and up.parent is not None:
        floor, up = threshold, up.parent
        threshold = min(threshold, up.density)
    dense = sum(c.density > 0 for c in top.children)
    usual = max(floor, top.sum / dense) if dense else floor
    # a subtree is marked before the walk comes to it, and the walk doesn't enter it
    marked, todo = set(), [body]
    while todo:
        node = todo.pop()
        if node not in marked and node.chars and node.density >= threshold - 1e-9:
            found = best[node]
            if found is top or (found.sum >= floor - 1e-9 if found.sum else found.density >= usual - 1e-9):
                marked.add(found)
            if node not in marked:
                todo.extend(reversed(node.children))
    return [x for x in nodes if x in marked], top, threshold


def text_of(node: Node) -> str:
    """Visible text; block elements stand on lines of their own."""
    out: list[str] = []
    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            out.append("\n")
        elif isinstance(x, str):
            out.append(SPACES.sub(" ", x))
        elif x.tag not in HIDDEN:
            if x.tag in BLOCK:
                out.append("\n")
                todo.append(None)
            todo.extend(reversed(x.parts))
    lines = (SPACES.sub(" ", line).strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def path_of(node: Node) -> str:
    names = []
    up: Node | None = node
    while up is not None and up.parent is not None:
        names.append(up.tag)
        up = up.parent
    return "/".join(reversed(names))


def extract(page: str | None) -> tuple[str, str, float, float]:
    """(text of all subtrees, path of the one of the largest sum, its sum, threshold) of a page."""
    if not page:
        return "", "", 0.0, 0.0
    body = measure(parse(page))
    if not body.chars:
        return "", "", 0.0, 0.0
    nodes, top, threshold = chosen(body)
    return "\n".join(t for t in map(text_of, nodes) if t), path_of(top), top.sum, threshold


def extracted(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with ``text``, ``path``, ``density_sum`` and ``threshold``.

    One row for each page. A null or empty page, and one without visible text, gives an empty text and path and zeros. Ties between
    subtrees go to the first in the page. Whole pages are read, however long. All columns but html pass through; new names that are taken get underscores
    in front. An empty table gives an empty result.
    """
    tune(pages.sparkSession)
    rest = [c for c in pages.columns if c.lower() != "html"]
    names = []
    for want in ("text", "path", "density_sum", "threshold"):
        names.append(free_name(pages, want))
    inner = [f"c{i}" for i in range(len(rest))]
    plain = pages.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(rest, inner, strict=True)], F.col("html").cast("string").alias("h"))
    out = T.StructType([*[f for f in plain.schema.fields if f.name != "h"], T.StructField("text", T.StringType()), T.StructField("path", T.StringType()), T.StructField("density_sum", T.DoubleType()), T.StructField("threshold", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(h) for h in batch.column("h").to_pylist()]
            made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in inner], *made], [*inner, "text", "path", "density_sum", "threshold"])

    return plain.mapInArrow(run, out).toDF(*rest, *names)
