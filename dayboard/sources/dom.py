"""Pages as trees in rows: elements with the intervals of their places, and the axes between them as DataFrame operators.

Elements are numbered in the order in which they open, from 0, and hold the number of the last one inside them, so
"inside" is a comparison of intervals: x is inside y if ``y.node < x.node <= y.last``.  A page's tree is one row; the
axes look at selected elements only, and need the elements of one page together, never pairs of them.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches

# Fixed values of HTML: elements without content, elements whose content is text, and which open element a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
_BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
ENDS = {t: frozenset({"p"}) for t in _BLOCKS} | {"li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "option": frozenset({"option"})} | {t: frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}) for t in ("thead", "tbody", "tfoot")}
#: What a start tag cannot look beyond for an element to end: a list inside an item does not end the item.
SCOPE = {"li": frozenset({"ul", "ol"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "td": frozenset({"table"}), "th": frozenset({"table"}), "tr": frozenset({"table"}), "thead": frozenset({"table"}), "tbody": frozenset({"table"}), "tfoot": frozenset({"table"}), "option": frozenset({"select"})}
_WALLS = frozenset({"table", "td", "th", "caption", "button", "object"})

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`]++)))?""")

NODE = "struct<node:int,last:int,parent:int,depth:int,nth:int,tag:string,attrs:map<string,string>,text_from:int,text_to:int>"


def _new(tag: str, rest: str) -> tuple[str, dict[str, str], frozenset, frozenset]:
    """Tag, attributes, and what a start tag ends and cannot look beyond."""
    tag, attrs = tag.lower(), {}
    for name, a, b, c in _ATTR.findall(rest):
        attrs.setdefault(name.lower(), entities.unescape(a or b or c))
    return tag, attrs, ENDS.get(tag, frozenset()), SCOPE.get(tag, _WALLS)


_seen = lru_cache(4096)(_new)  # pages repeat their start tags


def parse(page: str) -> tuple[list[list], str]:
    """Elements in order as lists of :data:`NODE`'s fields, and the page's text, to which they have offsets.

    Elements that are never closed reach to the end of what holds them; an end tag without an open element is left
    out, and so are comments and declarations.  Attributes are shared between elements and not to be changed.
    """
    nodes: list[list] = []
    open_: list[list] = []
    kids = [0]  # elements so far at the top, and inside each open element
    live: dict[str, int] = {}  # how many elements of a tag are open
    text: list[str] = []
    size = 0

    def close(to: int) -> None:
        while len(open_) > to:
            n = open_.pop()
            kids.pop()
            live[n[5]] -= 1
            n[1], n[8] = len(nodes) - 1, size

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            piece = entities.unescape(page[at:stop])
            text.append(piece)
            size += len(piece)
        if not m:
            break
        at = m.end()
        ended, begun, rest = m.groups()
        if ended:
            tag = ended.lower()
            if not live.get(tag):
                continue
            for k in range(len(open_) - 1, -1, -1):
                t = open_[k][5]
                if t == tag:
                    close(k)
                    break
                if t in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html"):
                    break  # not out of a cell
        elif begun:
            tag, attrs, ends, scope = (_seen if len(rest) < 256 else _new)(begun, rest)
            if any(map(live.get, ends)):
                cut = len(open_)
                for k in range(len(open_) - 1, -1, -1):
                    t = open_[k][5]
                    if t in scope:
                        break
                    if t in ends:
                        cut = k
                close(cut)
            n = len(nodes)
            node = [n, n, open_[-1][0] if open_ else -1, len(open_), kids[-1], tag, attrs, size, size]
            nodes.append(node)
            kids[-1] += 1
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                raw = page[at : stop.start() if stop else end]
                raw = entities.unescape(raw) if tag in ("textarea", "title") else raw
                text.append(raw)
                size += len(raw)
                node[8], at = size, stop.end() if stop else end
            elif tag not in VOID:
                open_.append(node)
                kids.append(0)
                live[tag] = live.get(tag, 0) + 1
    close(0)
    return nodes, "".join(text)


_INT, _STR = pa.int32(), pa.string()


def _trees(batches: Iterator[pa.RecordBatch], pages: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, pages):
            part = batch.slice(at, pages)
            found = [parse(h or "") for h in part.column("html").to_pylist()]
            flat = [n for ns, _ in found for n in ns]
            pairs = [list(n[6].items()) for n in flat]
            column = lambda i, kind: pa.array([n[i] for n in flat], kind)  # noqa: B023, E731
            attrs = pa.MapArray.from_arrays(_offsets(pairs), pa.array([k for p in pairs for k, _ in p], _STR), pa.array([v for p in pairs for _, v in p], _STR))
            nodes = pa.StructArray.from_arrays([*(column(i, _INT) for i in range(5)), column(5, _STR), attrs, column(7, _INT), column(8, _INT)], names=["node", "last", "parent", "depth", "nth", "tag", "attrs", "text_from", "text_to"])
            lists = pa.ListArray.from_arrays(_offsets([ns for ns, _ in found]), nodes)
            yield pa.RecordBatch.from_arrays([part.column("url"), pa.array([t for _, t in found], _STR), lists], names=["url", "text", "nodes"])


def _offsets(lists: list) -> pa.Array:
    return pa.array(list(accumulate(map(len, lists), initial=0)), _INT)


def trees(pages: DataFrame) -> DataFrame:
    """``(url, text, nodes)`` of ``pages(url, html)``: a row a page, null and empty pages with no elements.

    The root's parent is -1.  ``url`` must tell pages apart.
    """
    return pages.select("url", "html").mapInArrow(_trees, f"url string, text string, nodes array<{NODE}>")


#: Columns of a chosen element, before those that were asked for.
_PLACE = ("node", "last", "depth", "nth")


def _chooser(kinds: dict, texts: tuple, up: dict, own: dict, after: dict) -> Callable[[str], list[list]]:
    """Of a page, the elements of any kind: place on the page, kinds as bits, href and text, then the columns of each axis."""
    bit = {name: 1 << i for i, name in enumerate(kinds)}
    outers = sorted({o for _, o in up.values()} | {o for o, _ in own.values()} | {k[3] for k in kinds.values() if k[3]})
    slot = {o: i for i, o in enumerate(outers)}
    outer_bits, text_bits = sum(bit[o] for o in outers), sum(bit[t] for t in texts)
    lists = len(_PLACE) + 3 + len(up)  # where the columns of lists begin
    ups = [(len(_PLACE) + 3 + i, bit[kind], slot[outer]) for i, (kind, outer) in enumerate(up.values())]
    owns = [(lists + i, bit[inner], slot[outer]) for i, (outer, inner) in enumerate(own.values())]
    nexts = [(lists + len(own) + 2 * i, bit[kind], bit[other]) for i, (kind, other) in enumerate(after.values())]
    width = lists + len(own) + 2 * len(after)

    @lru_cache(4096)
    def of(tag: str, cls: str | None) -> tuple[int, list[tuple]]:
        """The kinds that tag and class decide, and those that need more."""
        names = re.split(r"\s+", cls, flags=re.A) if cls is not None else ()
        fits = [(bit[n], attr, within) for n, (t, c, attr, within) in kinds.items() if t in (None, tag) and (c is None or c in names)]
        return sum(b for b, attr, within in fits if not (attr or within)), [(b, attr, slot.get(within)) for b, attr, within in fits if attr or within]

    def choose(page: str) -> list[list]:
        nodes, text = parse(page)
        out: list[list] = []
        inside = [()] * len(nodes) + [(None,) * len(outers)]  # innermost elements of the outer kinds, for what an element holds; the last: for the top
        waiting: dict[tuple, list[int]] = {}
        for node, last, parent, depth, nth, tag, attrs, start, stop in nodes:
            around = inside[parent]
            bits, more = of(tag, attrs.get("class"))
            for b, attr, within in more:
                if (attr is None or attr in attrs) and (within is None or around[within] is not None):
                    bits |= b
            inside[node] = around
            if not bits:
                continue
            place = len(out)
            row = [node, last, depth, nth, bits, attrs.get("href"), text[start:stop] if bits & text_bits else None] + [None] * (width - len(_PLACE) - 3)
            out.append(row)
            if bits & outer_bits:
                inside[node] = tuple(place if bits & bit[o] else a for o, a in zip(outers, around, strict=True))
            for c, b, s in ups:
                if bits & b:
                    row[c] = around[s]
            for c, b, s in owns:
                if bits & b and around[s] is not None:
                    outer = out[around[s]]
                    if outer[c] is None:
                        outer[c] = []
                    outer[c].append(place)
            for c, b, other in nexts:
                if bits & other and (parent, c) in waiting:
                    row[c + 1] = waiting.pop((parent, c))
                    for w in row[c + 1]:
                        out[w][c] = place
                if bits & b:
                    waiting.setdefault((parent, c), []).append(place)
        return out

    return choose


def chosen(pages: DataFrame, kinds: dict[str, tuple], of: str, columns: Callable[[Column, Callable[[Column], Column]], dict[str, Column]], *, texts: tuple = (), up: dict = {}, own: dict = {}, after: dict = {}) -> DataFrame:  # noqa: B006
    """A row for each element of the kind ``of`` on ``pages(url, html)``: its url and ``columns(e, at)``.

    A kind is (tag, class, attribute, kind that must be around it), None for what does not matter.  ``e`` has node, last, depth,
    nth, href, the text inside if its kind is among ``texts``, and the places of other chosen elements, whose structs ``at(place)`` gives:
    ``up[name] = (kind, outer)`` of the innermost outer element around one of a kind; ``own[name] = (outer, inner)`` all inner
    elements that have this outer one as their innermost; ``after[name] = (kind, other)`` the next of the others under the
    same parent, and under ``name_of`` at that one all that it is next to.

    The work on a page is in its own row, in proportion to its length: nothing is shuffled, joined or sorted, and only the chosen
    elements leave Python.
    """
    small_batches(pages.sparkSession)
    kinds = {name: (*k, *[None] * (4 - len(k))) for name, k in kinds.items()}
    singles, lists = [*up], [*own]
    names = [*_PLACE, "kinds", "href", "text", *singles, *lists, *(f"{n}{x}" for n in after for x in ("", "_of"))]
    types = [_INT] * 5 + [_STR] * 2 + [_INT] * len(singles) + [pa.list_(_INT)] * len(lists) + [_INT, pa.list_(_INT)] * len(after)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = _chooser(kinds, texts, up, own, after)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [choose(h or "") for h in part.column("html").to_pylist()]
                values = zip(*(row for rows in found for row in rows), strict=True) if any(found) else [()] * len(names)
                els = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)
                yield pa.RecordBatch.from_arrays([part.column("url"), pa.ListArray.from_arrays(_offsets(found), els)], names=["url", "els"])

    spark_type = {_INT: "int", _STR: "string", pa.list_(_INT): "array<int>"}
    els = ",".join(f"{n}:{spark_type[t]}" for n, t in zip(names, types, strict=True))
    tree = pages.select("url", "html").mapInArrow(rows, f"url string, els array<struct<{els}>>")
    wanted = F.filter("els", lambda e: e["kinds"].bitwiseAND(F.lit(1 << [*kinds].index(of))) != 0)
    made = F.transform(wanted, lambda e: F.struct(*[c.alias(n) for n, c in columns(e, lambda place: F.get("els", place)).items()]))
    return tree.select("url", F.inline(made))


def has_class(attrs: Column, name: str) -> Column:
    """Whether one of an element's classes is the name."""
    return F.coalesce(F.array_contains(F.split(F.try_element_at(attrs, F.lit("class")), r"\s+"), name), F.lit(False))


def attr(attrs: Column, name: str) -> Column:
    """The value of an attribute, null without it."""
    return F.try_element_at(attrs, F.lit(name))


def select(tree: DataFrame, tag: str | None = None, cls: str | None = None, where=None) -> DataFrame:
    """Elements ``(url, node, last, parent, depth, nth, tag, attrs, text)`` with a tag, a class, and whatever ``where``
    says of the element's struct; ``text`` is all text inside.  Elements are filtered before they become rows."""

    def wanted(x: Column) -> Column:
        ok = F.lit(True)
        if tag is not None:
            ok = ok & (x["tag"] == tag)
        if cls is not None:
            ok = ok & has_class(x["attrs"], cls)
        return ok & where(x) if where is not None else ok

    rows = tree.select("url", F.col("text").alias("page_text"), F.explode(F.filter("nodes", wanted)).alias("e"))
    text = F.expr("substring(page_text, e.text_from + 1, e.text_to - e.text_from)")
    return rows.select("url", *[f"e.{c}" for c in ("node", "last", "parent", "depth", "nth", "tag", "attrs")], text.alias("text"))


def closest(inner: DataFrame, outer: DataFrame, name: str = "closest", itself: bool = False) -> DataFrame:
    """``inner`` with the number of the innermost element of ``outer`` that it is inside, null if there is none.

    With ``itself`` an element that is in both is its own.  Ranges of a page's elements are nested or apart, so the
    innermost open one at a place is the last that opened at the depth of nesting there: one running sum and one last
    value over the page's places in order, both in one shuffle by page.  Both sides' rows must be distinct elements.
    """
    asked, columns = _packed(inner)
    none = F.lit(None).cast("int")
    # at one place: ranges that ended before close first; an element asks before it opens, or after if it may be its own
    row = lambda df, at, kind, step, opened: df.select("url", at.alias("at"), F.lit(kind).alias("kind"), F.lit(step).alias("step"), opened.alias("opened"), "row")
    bare = outer.select("url", "node", "last", F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    places = row(bare, F.col("node"), 1 if itself else 2, 1, F.col("node")).unionByName(row(bare, F.col("last") + 1, 0, -1, none)).unionByName(row(asked, F.col("node"), 2 if itself else 1, 0, none))
    so_far = lambda *keys: Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = places.withColumn("level", F.sum("step").over(so_far("url")))
    found = found.withColumn("found", F.when(F.col("level") > 0, F.last("opened", ignorenulls=True).over(so_far("url", "level"))))
    return found.where("row is not null").select(*columns, F.col("found").alias(name))


def _packed(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Rows as one column beside their places, and the columns to take them apart again."""
    return rows.select("url", "node", "parent", "nth", F.struct(*rows.columns).alias("row")), [F.col("row")[c].alias(c) for c in rows.columns]


def inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Elements of ``inner`` that are inside any of ``outer``."""
    return closest(inner, outer, "_outer").where("_outer is not null").drop("_outer")


def first_of(inner: DataFrame, outer: DataFrame, column: str, name: str) -> DataFrame:
    """``(url, node, name)``: of each element of ``outer`` that is the innermost around any of ``inner``, the column's value in
    the first of these."""
    found = closest(inner, outer.select("url", "node", "last"), "_outer").where("_outer is not null")
    return found.groupBy("url", F.col("_outer").alias("_node")).agg(F.min_by(column, "node").alias(name)).withColumnRenamed("_node", "node")


def children(inner: DataFrame, outer: DataFrame, name: str = "of") -> DataFrame:
    """Elements of ``inner`` whose parent is one of ``outer``, with the parent's number."""
    return inner.join(outer.select("url", F.col("node").alias("parent"), F.col("node").alias(name)), ["url", "parent"]).select(*inner.columns, name)


def next_sibling(rows: DataFrame, others: DataFrame, name: str = "next") -> DataFrame:
    """Elements with the nearest of ``others`` that follows them under the same parent, null if none does."""
    asked, columns = _packed(rows)
    there = others.select("url", "parent", "nth", F.lit(0).alias("kind"), F.col("node").alias("there"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    both = asked.select("url", "parent", "nth", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("there"), "row").unionByName(there)
    after = Window.partitionBy("url", "parent").orderBy("nth", "kind").rowsBetween(1, Window.unboundedFollowing)
    return both.withColumn("found", F.first("there", ignorenulls=True).over(after)).where("row is not null").select(*columns, F.col("found").alias(name))
