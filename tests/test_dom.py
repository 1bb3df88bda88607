"""Trees of pages against another parser, and their axes against loops."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from dayboard.sources import dom


class Plain(HTMLParser):
    """Elements by the standard library's tokens, for pages that close what they open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.text = [], [], ""

    def handle_starttag(self, tag, attrs):
        n = len(self.nodes)
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.nodes.append({"tag": tag, "attrs": first, "parent": self.open[-1] if self.open else -1, "last": n, "from": len(self.text), "to": len(self.text)})
        if tag not in dom.VOID:
            self.open.append(n)

    def handle_endtag(self, tag):
        n = self.open.pop()
        assert self.nodes[n]["tag"] == tag
        self.nodes[n]["last"], self.nodes[n]["to"] = len(self.nodes) - 1, len(self.text)

    def handle_data(self, data):
        self.text += data


def page(rng, depth=0):
    out = ""
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.25 or depth > 5:
            out += rng.choice(["text", " a &amp; b ", "1 &lt; 2", "日本", "<!-- <b>no</b> -->", "<br>", "<img src='a>b' ALT=\"x\">", "&#x41;"])
        elif kind < 0.32:
            out += rng.choice(["<script>if (a<b) '</p>'</script>", "<style>p>a{}</style>", "<script></script>"])
        else:
            tag = rng.choice(["div", "span", "section", "b"])
            attrs = rng.choice(["", " class='a b'", ' id=x class="c"', " data-class=a hidden", " class=a class=b", "\n  href = '/x?a=1&amp;b=2'"])
            out += f"<{tag}{attrs}>{page(rng, depth + 1)}</{tag.upper() if rng.random() < 0.2 else tag}>"
    return out


@pytest.mark.parametrize("seed", range(40))
def test_trees_of_closed_pages(seed):
    html = page(random.Random(seed))
    plain = Plain()
    plain.feed(html)
    plain.close()
    nodes, text = dom.parse(html)
    assert text == plain.text
    assert [(n[5], n[6], n[2], n[1], n[7], n[8]) for n in nodes] == [(n["tag"], n["attrs"], n["parent"], n["last"], n["from"], n["to"]) for n in plain.nodes]


def shape(html):
    """Nested lists of tags."""
    nodes, _ = dom.parse(html)
    out = {-1: []}
    for n in nodes:
        out[n[0]] = []
        out[n[2]].append((n[5], out[n[0]]))
    return show(out[-1])


def show(nodes):
    return " ".join(t + (f"({show(c)})" if c else "") for t, c in nodes)


@pytest.mark.parametrize(
    "html,want",
    [
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "ul(li li(ul(li)) li)"),
        ("<table><tr><td>1<td>2<tr><th>3<table><tr><td>x</table><td>4</table>", "table(tr(td td) tr(th(table(tr(td))) td))"),
        ("<p>a<p>b<div>c<p>d</div><p>e", "p p div(p) p"),
        ("<dl><dt>a<dd>b<dt>c<dd>d<dl><dt>e</dl></dl>", "dl(dt dd dt dd(dl(dt)))"),
        ("<div><b>x</div></b>y</i>", "div(b)"),
        ("<td>a</div>b<p>c</td>", "td(p)"),
        ("<table><tbody><tr><td>a<tbody><tr><td>b</table>", "table(tbody(tr(td)) tbody(tr(td)))"),
        ("<select><option>a<option>b</select>", "select(option option)"),
        ("a < b <c", ""),
        ("<p title='a", ""),
        ("<script>never closed <p>", "script"),
        ("<!doctype html><?x?><html><body><!-- open", "html(body)"),
        ("", ""),
        ("<br/><img/ src=x><p/>q", "br img p"),
    ],
)
def test_unclosed_pages(html, want):
    assert shape(html) == want


def test_axes_against_loops(spark):
    rng = random.Random(3)
    tags = ["div", "td", "b", "i"]

    def nested(depth):
        return "".join(f"<{t}>{nested(depth + 1) if rng.random() < 0.75 and depth < 9 else 'x'}</{t}>" for t in rng.choices(tags[::2] + ["span"], k=rng.randint(1, 3)))

    pages = [(f"u{k}", nested(0)) for k in range(15)] + [("none", None), ("empty", "")]
    tree = dom.trees(spark.createDataFrame(pages, "url string, html string").repartition(3)).cache()
    assert {r.url: len(r.nodes) for r in tree.collect()}["none"] == 0
    parsed = {u: dom.parse(h or "")[0] for u, h in pages}
    inner, outer = dom.select(tree, "b").withColumn("rest", F.lit(1)), dom.select(tree, "div").select("url", "node", "last", "parent", "nth")

    def around(u, n, own, tag="div"):
        found = [m[0] for m in parsed[u] if m[5] == tag and (m[0] < n[0] or own and m[0] == n[0]) and n[0] <= m[1]]
        return max(found, default=None)

    want = {(u, n[0]): around(u, n, False) for u, ns in parsed.items() for n in ns if n[5] == "b"}
    assert {(r.url, r.node): r.closest for r in dom.closest(inner, outer).collect()} == want
    assert {(r.url, r.node) for r in dom.inside(inner, outer).collect()} == {k for k, v in want.items() if v is not None}
    for own in (False, True):
        got = {(r.url, r.node): r.up for r in dom.closest(dom.select(tree, "div"), outer, "up", itself=own).collect()}
        assert got == {(u, n[0]): around(u, n, own) for u, ns in parsed.items() for n in ns if n[5] == "div"}
    got = {(r.url, r.node): r.of for r in dom.children(inner, outer).collect()}
    assert got == {(u, n[0]): n[2] for u, ns in parsed.items() for n in ns if n[5] == "b" and n[2] >= 0 and ns[n[2]][5] == "div"}
    got = {(r.url, r.node): r.next for r in dom.next_sibling(outer, dom.select(tree, "b")).collect()}
    assert got == {(u, n[0]): min((m[0] for m in ns if m[5] == "b" and m[2] == n[2] and m[4] > n[4]), default=None) for u, ns in parsed.items() for n in ns if n[5] == "div"}
    got = {(r.url, r.node): r.next for r in dom.next_sibling(outer, outer).collect()}
    assert got == {(u, n[0]): min((m[0] for m in ns if m[5] == "div" and m[2] == n[2] and m[4] > n[4]), default=None) for u, ns in parsed.items() for n in ns if n[5] == "div"}


def test_one_shuffle_and_no_pairs(spark):
    tree = dom.trees(spark.createDataFrame([("u", "<td><b>x</b></td>")], "url string, html string"))
    plan = dom.closest(dom.select(tree, "b"), dom.select(tree, "td"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_classes_attributes_and_text(spark):
    html = "<div class='a  b'>x<p data-class=c title='&quot;'>y &amp; z</p></div><div class=ab>w</div>"
    tree = dom.trees(spark.createDataFrame([("u", html)], "url string, html string"))
    assert [r.text for r in dom.select(tree, cls="b").collect()] == ["xy & z"]
    assert dom.select(tree, cls="c").count() == 0
    r = dom.select(tree, "p").select("text", dom.attr(F.col("attrs"), "title").alias("t"), dom.attr(F.col("attrs"), "none").alias("n")).first()
    assert (r.text, r.t, r.n) == ("y & z", '"', None)
