import math
import random
import time
from html.parser import HTMLParser

import pytest

from spanloom.llm import html_density as H

PAGES = "page_id long, url string, html string"


def page(prose, seed, blocks=6):
    nav = "".join(f'<li><a href="/{i}">{prose(seed + i, 2)}</a></li>' for i in range(12))
    body = "".join(f"<p>{prose(seed * 31 + i, 60)}</p>" for i in range(blocks))
    return f"<html><head><title>t</title><script>var x = '<p>no</p>';</script></head><body><div class=nav><ul>{nav}</ul></div><div><article>{body}</article></div><div><ul>{nav}</ul></div></body></html>"


def test_the_article_is_found(prose):
    for seed in range(1, 20):
        text, path, best, threshold = H.extract(page(prose, seed))
        assert path == "html/body/div/article" and best > 0 and threshold > 0
        assert text == "\n".join(prose(seed * 31 + i, 60) for i in range(6))


class Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = self.here = {"tag": "#root", "up": None, "kids": [], "text": []}

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "up": self.here, "kids": [], "text": []}
        self.here["kids"].append(node)
        self.here = node

    def handle_endtag(self, tag):
        self.here = self.here["up"]

    def handle_data(self, data):
        self.here["text"].append(data)


def shown(node):
    return [k for k in node["kids"] if k["tag"] not in H.HIDDEN]


def chars(n):
    return sum(len(" ".join(t.split())) for t in n["text"]) + sum(map(chars, shown(n)))


def tags(n):
    return len(shown(n)) + sum(map(tags, shown(n)))


def links(n):
    return (chars(n), 1 + tags(n)) if n["tag"] == "a" else tuple(map(sum, zip((0, 0), *map(links, shown(n)), strict=True)))


def density(n, ratio):
    c, t, (lc, lt) = chars(n), tags(n), links(n)
    if not c:
        return 0.0
    base = math.log(c * lc / max(c - lc, 1) + ratio * c + math.e)
    return max(c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / max(math.log(base), H.LEAST_LOG), 0.0)


@pytest.mark.parametrize("seed", [2, 5, 11])
def test_densities_against_plain_recursion(prose, seed):
    source = page(prose, seed)
    tree = Tree()
    tree.feed(source)
    body = tree.root["kids"][0]["kids"][1]
    ratio = links(body)[0] / chars(body)
    nodes = []
    walk = lambda n: (nodes.append(n), [walk(k) for k in n["kids"]])
    walk(body)
    mine = H.in_order(H.measure(H.parse(source)))
    assert [n["tag"] for n in nodes] == [n.tag for n in mine]
    for a, b in zip(nodes, mine, strict=True):
        assert (chars(a), tags(a), *links(a)) == (b.chars, b.tags, b.link_chars, b.link_tags)
        assert math.isclose(density(a, ratio), b.density) and math.isclose(sum(density(k, ratio) for k in shown(a)), b.sum)


@pytest.mark.parametrize("broken", ["<", "<p", "</div></div>text", "<p>a<p>b<li>c", "<a href='x>y", "<!-- open", "<script>never", "<table><tr><td>x<td>y<tr><td>z</table>", "a &amp; b &bogus; &#12345678;", "<div " * 50, "<br/>" * 30, "\0\x01<\x02>"])
def test_broken_pages(broken):
    text, path, best, threshold = H.extract(broken)
    assert isinstance(text, str) and best >= 0


def test_deep_and_long_pages(prose):
    assert H.extract("<div>" * 20_000 + "deep" + "</div>" * 20_000)[0] == "deep"
    long = prose(3, 100_000)
    assert H.extract(f"<body><p>{long}</p></body>")[0] == long


def test_odd_rows_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "t", 1.0), (1, "u", "<p>x</p>", "t", 1.0), (None, None, None, None, None), (2, "u", "", "t", 2.0), (3, "u", "<script>x</script>", "t", 3.0)], PAGES + ", text string, threshold double")
    got = H.extracted(df)
    assert got.columns == ["page_id", "url", "text", "threshold", "_text", "path", "density_sum", "_threshold"]
    assert sorted((r.page_id or 0, r._text) for r in got.collect()) == [(0, ""), (1, "x"), (1, "x"), (2, ""), (3, "")]
    assert H.extracted(spark.createDataFrame([], PAGES)).count() == 0


def test_every_article_container_is_found(prose):
    paragraphs = [prose(400 + i, 60) for i in range(11)]
    first, second = ("".join(f"<p>{t}</p>" for t in part) for part in (paragraphs[:6], paragraphs[6:]))
    ad = "".join(f'<a href="/{i}">{prose(i, 3)}</a>' for i in range(8))
    for inner in (second, f"<div><div>{second}</div></div>"):
        text, path, best, _ = H.extract(f"<html><body><div>{first}</div><div class=ad>{ad}</div><div>{inner}</div></body></html>")
        assert text == "\n".join(paragraphs) and path == "html/body/div" and best > 0
    # in the order of the page, also where the largest comes last
    text, path, _, _ = H.extract(f"<body><div>{second}</div><div class=ad>{ad}</div><section>{first}</section></body>")
    assert text == "\n".join(paragraphs[6:] + paragraphs[:6]) and path == "body/section"


def copied(node, up=None):
    """A parsed tree as plain dicts."""
    out = {"tag": node.tag, "up": up, "kids": [], "text": [x for x in node.parts if isinstance(x, str)], "all": []}
    for x in node.parts:
        out["all"].append(x if isinstance(x, str) else copied(x, out))
        if not isinstance(x, str):
            out["kids"].append(out["all"][-1])
    return out


def plain_text(node):
    if isinstance(node, str):
        return " ".join(("." + node + ".").split())[1:-1]
    if node["tag"] in H.HIDDEN:
        return ""
    inside = "".join(map(plain_text, node["all"]))
    return f"\n{inside}\n" if node["tag"] in H.BLOCK else inside


def brute(source):
    """The whole extraction by plain recursion over the definitions."""
    body = copied(H.parse(source))
    found = lambda n, tag: n if n["tag"] == tag else next((x for x in (found(k, tag) for k in n["kids"]) if x), None)
    body = found(body, "body") or found(body, "html") or body
    if not chars(body):
        return "", 0.0, 0.0
    ratio = links(body)[0] / chars(body)
    dense = lambda n: density(n, ratio) if n["tag"] not in H.HIDDEN else 0.0
    total = lambda n: sum(map(dense, n["kids"]))
    under = lambda n: [n, *(x for k in shown(n) for x in under(k))]
    best = lambda n: max(under(n), key=total)
    top = best(body)
    path = [top]
    while path[-1] is not body:
        path.append(path[-1]["up"])
    threshold, floor = min(map(dense, path)), min(map(dense, path[:-1] or path))
    many = sum(dense(k) > 0 for k in top["kids"])
    usual = max(floor, total(top) / many) if many else floor
    marked = []

    def visit(n):
        if any(n is x for x in marked) or not chars(n) or dense(n) < threshold - 1e-9:
            return
        b = best(n)
        if b is top or (total(b) >= floor - 1e-9 if total(b) else dense(b) >= usual - 1e-9):
            if not any(b is x for x in marked):
                marked.append(b)
        if not any(n is x for x in marked):
            for k in n["kids"]:
                if k["tag"] not in H.HIDDEN:
                    visit(k)

    visit(body)
    texts = ["\n".join(x for x in (" ".join(line.split()) for line in plain_text(n).split("\n")) if x) for n in under(body) if any(n is m for m in marked)]
    return "\n".join(t for t in texts if t), total(top), threshold


@pytest.mark.parametrize("seed", range(40))
def test_the_whole_extraction_against_brute_force(prose, seed):
    rng = random.Random(seed)

    def part(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return f"<p>{prose(rng.randrange(10**6), rng.randint(1, 60))}</p>"
        if kind < 0.45:
            return "".join(f'<a href="/{i}">{prose(rng.randrange(10**6), 2)}</a> ' for i in range(rng.randint(1, 6)))
        if kind < 0.5:
            return "<script>var x = 1;</script>" + prose(rng.randrange(10**6), 3)
        tag = rng.choice(["div", "section", "article", "ul", "span", "td", "b"])
        return f"<{tag}>" + "".join(part(depth - 1) for _ in range(rng.randint(1, 5))) + (f"</{tag}>" if rng.random() < 0.9 else "")

    source = "<html><head><title>x</title></head><body>" + "".join(part(4) for _ in range(rng.randint(1, 5))) + "</body></html>"
    text, _, best, threshold = H.extract(source)
    want = brute(source)
    assert text == want[0] and math.isclose(best, want[1]) and math.isclose(threshold, want[2])


@pytest.mark.parametrize("page", ["<a " * 300_000 + '"', "<span>" * 80_000 + "</x>" * 80_000, "<p><table><td>" + "<span>" * 80_000 + "<h1>" * 40_000, "<a '" * 250_000, "<" * 500_000, "<!--" * 250_000, "</" * 400_000, "<script" * 150_000, "&" * 1_000_000, "<li><b>" * 80_000])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    H.extract(page)
    assert time.perf_counter() - began < 12


def test_an_unclosed_quote_is_none():
    assert H.extract("<body><p title='a>b'>one</p><p title='x>two</p></body>")[0] == "one\ntwo"
