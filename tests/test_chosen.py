"""Elements of pages chosen in the page's own row, against the axes over rows, and without a shuffle."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dayboard.plans import venues as V
from dayboard.queries import listings as L
from dayboard.sources import dom

DAY = dt.date(2026, 11, 26)


def nested(rng, depth=0):
    tags = ["div class='a b'", "div", "td", "b href=1 class=b", "b"]
    return "".join(f"<{t}>{nested(rng, depth + 1) if rng.random() < 0.7 and depth < 8 else 'x&lt;'}</{t.split()[0]}>" for t in rng.choices(tags, k=rng.randint(1, 3)))


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(17)
    rows = [(f"u{k}", nested(rng)) for k in range(70)] + [("none", None), ("empty", ""), ("open", "<div>" * 300 + "<b href=x>t")]
    return spark.createDataFrame(rows, "url string, html string").repartition(3).cache()


def chosen(some, of, columns):
    kinds = {"div": ("div",), "a": (None, "a"), "b": ("b", "b"), "link": ("b", None, "href"), "held": ("b", None, "href", "a")}
    return dom.chosen(some, kinds, of, columns, texts=("link",), up={"up": ("link", "div"), "self": ("div", "div")}, own={"own": ("div", "link")}, after={"next": ("link", "div")})


def test_same_as_axes_over_rows(some):
    tree = dom.trees(some).cache()
    place = lambda at, i: at(i)["node"]
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    div, link = dom.select(tree, "div"), dom.select(tree, "b", where=lambda x: x["attrs"]["href"].isNotNull())
    got = chosen(some, "link", lambda e, at: {c: e[c] for c in ("node", "last", "depth", "nth", "href", "text")} | {"up": place(at, e["up"]), "next": place(at, e["next"])})
    want = dom.next_sibling(dom.closest(link, div, "up"), div).select("url", "node", "last", "depth", "nth", dom.attr(F.col("attrs"), "href"), "text", "up", "next")
    assert rows(got) == rows(want)
    got = chosen(some, "div", lambda e, at: {"node": e["node"], "up": place(at, e["self"])})
    assert rows(got) == rows(dom.closest(div, div, "up").select("url", "node", "up"))
    got = chosen(some, "div", lambda e, at: {"node": e["node"], "own": F.transform(e["own"], lambda i: at(i)["node"])}).select("url", "node", F.explode("own"))
    assert rows(got) == rows(dom.closest(link, div, "up").where("up is not null").select("url", "up", "node"))
    got = chosen(some, "div", lambda e, at: {"node": e["node"], "of": F.transform(e["next_of"], lambda i: at(i)["node"])}).select("url", "node", F.explode("of"))
    assert rows(got) == rows(dom.next_sibling(link, div).where("next is not null").select("url", "next", "node"))
    assert rows(chosen(some, "held", lambda e, at: {"node": e["node"]})) == rows(dom.inside(link, dom.select(tree, cls="a")).select("url", "node"))
    assert rows(chosen(some, "b", lambda e, at: {"node": e["node"]})) == rows(dom.select(tree, "b", "b").select("url", "node"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("of", [V.cards, V.boxes])
def test_cards_and_boxes_shuffle_nothing(spark, of):
    """trees were written, read several times, and shuffled by page for every field."""
    p = plan(of(spark.createDataFrame([("https://v.jp/", "")], "url string, html string"), DAY))
    assert not any(x in p for x in ("Exchange", "Join", "Window", "parquet"))


def test_calendar_shuffles_events_only(spark):
    """once by day and title, once to the details."""
    pages = spark.createDataFrame([("https://v.jp/", "")], "url string, html string")
    p = plan(V.calendar(pages, pages))
    assert "Exchange hashpartitioning(url" not in p and "parquet" not in p and p.count("Join") == 1


def test_cells_sort_nothing_but_the_pages_orders(spark):
    """F8: sorted windows and joins over elements held whole partitions in memory."""
    p = plan(L.dom_cells(spark, "/root/testdata/sf0.001"))
    assert p.count("Exchange") == 1 and "Join" not in p and "Window" not in p
