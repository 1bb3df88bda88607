"""Main text of web pages by consensus of the pages of a host.

Every page scores its containers by the text below them that is not in links, and finds the smallest one that holds
the article: from the body down, as long as one element holds nearly all and no heading, lead or section is left
beside it.  The pages of a host vote on generalised tag-class paths, in Spark, and each page is then extracted from
the containers on its host's winning path.  A page that has none of them, or less than half of its article in them,
keeps its own choice.

Elements that are never text (scripts, menus, footers and the like) go by their tag, and so do those that are hidden.
Marks in class, id or role only weigh: all words of a mark must speak of what is not the article, a mark that speaks
of content outweighs them, and so does the page's only main heading inside.  A form that lays out the page stays
without its controls.  Headers of articles stay, those of sites go.  Whatever their names, containers and lists that
stand beside most of a host's different articles go too, but for those among paragraphs.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .storage import Stash

#: HTML element kinds and words in class, id or role that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
DROPPED = frozenset("head script style noscript template nav footer aside button select iframe object svg canvas audio video dialog menu textarea title input option optgroup datalist fieldset label legend output".split())
CONTAINERS = frozenset("body main article section div td center html form".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus feedback footer form gdpr login menu modal nav navbar navigation newsletter notice pager pagination popup promo promotion recommended related reply replies respond search share sharing side sidebar signup skip social sponsor sponsored subscribe tags toolbar widget contentinfo complementary".split()
)
HEADERS = frozenset("header masthead topbar".split())
NEUTRAL = frozenset("area articles bar block bottom box center col column container global group holder inner item items js left list link links news outer page panel post posts primary region right row secondary section site slot stories top unit wrap wrapper zone".split())
CONTENT = frozenset("article articlebody body content entry main story text".split())
PAGE = frozenset(("#root", "html", "body"))
LISTS = frozenset("dl ol table ul".split())
#: An element is furniture if it stands on so many of a host's pages with different articles, and on this share of them.
LEAST_ARTICLES, FURNITURE_SHARE = 5, 0.8

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_WORD = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


def _path(parent: str, step: str) -> str:
    """The path of a child; what lies above a long path is hashed, so that deep pages stay small."""
    if len(parent) > 400:
        parent = "#" + hashlib.blake2b(parent.encode(), digest_size=8).hexdigest()
    return f"{parent}>{step}"


class Element:
    __slots__ = ("children", "digest", "heading", "kind", "parent", "path", "plain", "score", "tag", "top")

    def __init__(self, tag: str, parent: Element | None, path: str, kind: str):
        self.tag, self.parent, self.path = tag, parent, path
        self.kind = kind  # "gone" by its tag or what it is in, "soft" or "header" by its marks, or ""
        self.children: list[Element | str] = []
        self.plain = self.score = 0
        self.digest = 0  # of its tags and text, 0 without text
        self.heading = False  # whether a main heading or an article is inside
        self.top = tag in PAGE  # whether it lays out a page: menus, footers or the like are its children


def _kind(tag: str, marks: list[tuple[str, str]]) -> str:
    if tag in DROPPED or any(k == "hidden" or k == "style" and _UNSEEN.search(v) or k == "aria-hidden" and v.lower() == "true" for k, v in marks):
        return "gone"
    if tag == "header":
        return "header"
    if tag in ("body", "html"):
        return ""
    found = ""
    for key, value in marks:
        if key not in ("class", "id", "role"):
            continue
        for token in value.split():
            words = set(_WORD.findall(_CAMEL.sub(" ", token).lower()))
            words = {w for w in words if not w.isdigit()}
            if words & CONTENT and not words & BOILERPLATE:
                return ""
            if words & BOILERPLATE and words <= BOILERPLATE | NEUTRAL | HEADERS | CONTENT:
                found = "soft"
            elif words & HEADERS and words <= HEADERS | NEUTRAL and not found and tag not in ("article", "main"):
                found = "header"
    return found or ("soft" if tag == "form" else "")


def parse(page: str) -> tuple[Element, list[Element]]:
    """The root and all elements in page order."""
    root = Element("#root", None, "", "")
    every, now, at, links = [root], root, 0, 0
    page_lower = None

    def text(raw: str) -> None:
        if now.kind != "gone" and raw:
            now.children.append(raw)
            if not links:
                now.plain += len(raw.strip())

    while m := _TAG.search(page, at):
        if m.start() > at:
            text(_html.unescape(page[at : m.start()]) if "&" in page[at : m.start()] else page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            up = now
            while up is not root and up.tag != tag and not (tag in INLINE and up.tag not in INLINE):
                up = up.parent
            if up is not root and up.tag == tag:
                now = up.parent
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE:
                links = 0
            continue
        if tag in CLOSES_P or tag in SELF_CLOSING:
            wanted = ("p",) if tag in CLOSES_P else tuple(SELF_CLOSING[tag].split())
            stop = CONTAINERS | {"ul", "ol", "table", "dl"} if tag != "td" else {"table"}
            up = now
            while up is not root and up.tag not in wanted and (up.tag not in stop or up.tag in wanted):
                up = up.parent
            if up is not root and up.tag in wanted:
                now, links = up.parent, 0
        if tag in ("br", "wbr", "img"):
            text(" ")
            continue
        if tag == "a":
            links += 1
        marks = [(a[0].lower(), a[1] or a[2] or a[3]) for a in _ATTR.findall(m[3])] if m[3] else []
        kind = "gone" if now.kind == "gone" else _kind(tag, marks)
        if tag in INLINE:
            path = now.path
        else:
            classes = sorted({_DIGITS.sub("#", c) for k, v in marks if k == "class" for c in v.split()})[:2]
            path = _path(now.path, ".".join([tag[:40], *(c[:40] for c in classes)]))
        if tag in VOID:
            continue
        el = Element(tag, now, path, kind)
        now.children.append(el)
        every.append(el)
        if kind == "gone" and now.kind != "gone" and tag in ("nav", "footer", "aside"):
            now.top = True
        if tag in ("h1", "article", "main") and kind not in ("gone", "soft"):
            up = el
            while up is not None and not up.heading:
                up.heading = True
                up = up.parent
        if tag in RAW:
            if page_lower is None:
                page_lower = page.lower()
                if len(page_lower) != len(page):
                    page_lower = re.sub(r"</[A-Za-z]+", lambda t: t[0].lower(), page)
            end = page_lower.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
        if not m[3].endswith("/") or tag not in RAW:
            now = el
    if at < len(page):
        text(_html.unescape(page[at:]))
    _settle(every)
    return root, every


def _settle(every: list[Element]) -> None:
    """What marks only weighed: such an element stays if the page's main heading or article is in it and in no other, and a
    form if it lays out the page, with at least half of its text and blocks of it; its controls go by their tags."""
    said = {id(el): 0 for el in every}
    for el in reversed(every):
        if el.kind != "gone":
            said[id(el)] += el.plain
            if el.parent is not None and (el.kind != "soft" or el.tag == "form" or el.heading):
                said[id(el.parent)] += said[id(el)]
    whole = said[id(every[0])]
    blocks_in = {id(el): False for el in every}
    for el in reversed(every):
        blocks_in[id(el)] |= el.tag in ("p", "article", "main", "h1", "h2") and el.kind == ""
        if el.parent is not None:
            blocks_in[id(el.parent)] |= blocks_in[id(el)]
    outside = False  # whether a main heading or an article is outside all that is marked
    marked = {id(every[0]): False}
    for el in every[1:]:
        marked[id(el)] = marked[id(el.parent)] or el.kind in ("gone", "soft") and el.tag != "form"
        if not marked[id(el)] and (el.tag in ("article", "main") or el.tag == "h1" and not _in_header(el)):
            outside = True
    for el in every:  # parents come before their children
        if el.parent is not None and el.parent.kind == "gone":
            el.kind = "gone"
        elif el.kind == "soft" and el.tag == "form" and blocks_in[id(el)] and 2 * said[id(el)] >= whole:
            el.kind = ""
        elif el.kind == "soft" and el.tag != "form" and el.heading and not outside:
            el.kind = ""
        elif el.kind == "soft":
            el.kind = "gone"
            el.parent.top = el.parent.top or el.tag not in INLINE and el.tag != "form"


def _in_header(el: Element) -> bool:
    while el is not None:
        if el.kind == "header":
            return True
        el = el.parent
    return False


def rate(every: list[Element]) -> list[Element]:
    """Give every element the text below it that is not in links; containers with any, in page order."""
    for el in reversed(every):
        if el.kind != "gone":
            el.score += el.plain
            if el.parent is not None and el.kind != "header":
                el.parent.score += el.score
    return [el for el in every if el.tag in CONTAINERS and el.score > 0 and el.kind == ""]


def article_of(root: Element) -> Element:
    """The smallest container that holds the article."""
    now = best = root
    while True:
        if now.tag in CONTAINERS:
            best = now
        kids = [c for c in now.children if isinstance(c, Element) and c.kind != "gone"]
        main = max((c for c in kids if c.kind == ""), key=lambda c: c.score, default=None)
        if now.tag == "article" or main is None or not main.score or main.tag in ("p", "ul", "ol", "dl", "li", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"):
            return best
        # what would be lost: headings, text and sections beside the child weigh, other elements only if they are large
        beside = [c for c in kids if c is not main]
        title = any(c.tag in ("h1", "h2") or c.kind == "header" and c.heading and not now.top for c in beside) and not main.heading
        bare = now.plain + sum(c.score for c in beside if c.tag not in ("div", "center", "table", "td", "tr", "tbody"))
        if title or bare > (0.3 * now.score if now.top else 0) or main.score < (0.6 if now.top else 0.9) * now.score:
            return best
        now = main


def blocks(el: Element) -> list[str]:
    """Text of each block below an element, in page order, with single spaces.  A site's header has none."""
    out: list[str] = []
    part: list[str] = []

    def close() -> None:
        if part:
            if line := " ".join("".join(part).split()):
                out.append(line)
            part.clear()

    todo: list[Element | str | None] = [el]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            part.append(x)
        elif x is None:
            close()
        elif x.kind == "gone" or x.kind == "header" and (x.parent.top or not x.heading and x.parent.tag in PAGE):
            if x.tag not in INLINE:
                close()
        elif x.tag in INLINE:
            todo.extend(reversed(x.children))
        else:
            close()
            todo.append(None)
            todo.extend(reversed(x.children))
    close()
    return out


def _digest(every: list[Element]) -> None:
    for el in reversed(every):
        if el.kind == "gone":
            continue
        parts = []
        for c in el.children:
            if isinstance(c, str):
                if said := " ".join(c.split()):
                    parts.append(said)
            elif c.digest:
                parts.append(f"<{c.tag} {c.digest}>")
        if parts:
            el.digest = int.from_bytes(hashlib.blake2b("\n".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _lays_out(el: Element) -> bool:
    """Whether an element holds containers and lists only, and no text of its own."""
    return not any(c.strip() if isinstance(c, str) else c.kind != "gone" and c.digest and c.kind != "header" and c.tag not in CONTAINERS and c.tag not in LISTS and c.tag not in ("tr", "tbody", "thead") for c in el.children)


def furniture(root: Element, every: list[Element]) -> list[Element]:
    """Elements of a rated page that could be a host's furniture: containers and lists with text beside others, but
    not the page's heading, or half of the text of a page without one.  What stands among paragraphs is part of an article."""
    _digest(every)
    layout = {id(el): _lays_out(el) for el in every}
    return [el for el in every if el.digest and el.kind == "" and not el.heading and not el.top and (el.tag in CONTAINERS or el.tag in LISTS) and (root.heading or 2 * el.score < root.score) and layout[id(el.parent)]]


def extract(page: str | None, path: str | None, gone: frozenset[int] = frozenset()) -> str:
    """Text of the containers on ``path``, or of the page's own choice if they hold less than half as much; without
    elements whose digests are in ``gone``."""
    if not page:
        return ""
    root, every = parse(page)
    rated = rate(every)
    if gone and (found := [el for el in furniture(root, every) if el.digest in gone]):
        for el in found:
            el.kind = "gone"
            el.parent.top = True
        for el in every:
            el.score = 0
            if el.parent is not None and el.parent.kind == "gone":
                el.kind = "gone"
        rated = rate(every)
    chosen = [e for e in rated if e.path == path]
    own = article_of(root)
    outer: list[Element] = []
    for e in chosen:
        up = e.parent
        while up is not None and up.path != path:
            up = up.parent
        if up is None:
            outer.append(e)
    if 2 * sum(e.score for e in outer) < own.score or not outer:
        outer = [own]
    return "\n".join(b for e in outer for b in blocks(e))


def votes(page: str) -> dict[str, float]:
    """A page's votes by path: 1 for its choice, half of its share for each container with half of all text."""
    root, every = parse(page)
    return _votes_of(root, rate(every))


def _votes_of(root: Element, rated: list[Element]) -> dict[str, float]:
    out: dict[str, float] = {}
    for e in rated:
        if 2 * e.score >= root.score:
            out[e.path] = max(out.get(e.path, 0), e.score / root.score / 2)
    own = article_of(root)
    if own.score and own is not root:
        out[own.path] = 1.0
    return out


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's votes for paths, the digest of its article, and with it those of elements that may be furniture."""
    for batch in T.slices(batches):
        rows: list[tuple] = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if page:
                root, every = parse(page)
                rated = rate(every)
                rows += [(host, path, share, None, None) for path, share in _votes_of(root, rated).items()]
                found = {el.digest for el in furniture(root, every)}
                article = article_of(root).digest
                rows += [(host, None, None, article, d) for d in (None, *found)]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["host", "path", "share", "article", "block"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches):
        texts = [extract(h, p, frozenset(g or ())) for h, p, g in zip(*(batch.column(c).to_pylist() for c in ("_html", "_path", "_gone")), strict=True)]
        kept = [n for n in batch.schema.names if n not in ("_html", "_path", "_gone")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*kept, "text", "n_chars"])


def host_votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, path, article, block, share)``: votes by path, and each host's articles with the elements beside them."""
    rows = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html"))
    votes = rows.mapInArrow(_votes, "host string, path string, share double, article long, block long")
    return votes.groupBy("host", "path", "article", "block").agg(F.sum("share").alias("share"))


def host_paths(votes: DataFrame) -> DataFrame:
    """``(host, path)``: each host's path with most votes, ties to the first in order.  One row per host."""
    votes = votes.where("path is not null").groupBy("host", "path").agg(F.round(F.sum("share"), 6).alias("votes"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def host_furniture(votes: DataFrame) -> DataFrame:
    """``(host, gone)``: digests of elements that recur beside most of a host's articles.

    Articles are told apart by their text, so that copies of one article make no furniture of what is in it.
    """
    blocks_ = votes.where("block is not null").groupBy("host", "block").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ARTICLES)
    articles = votes.where("path is null and block is null").groupBy("host").agg(F.count("*").alias("articles"))
    most = blocks_.join(articles, "host").where(F.col("n") >= F.col("articles") * FURNITURE_SHARE)
    return most.groupBy("host").agg(F.collect_list("block").alias("gone"))


def _host(url_col: str):
    """Lower-case host without port; a url without one is its own host, and null is the host ''."""
    found = F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(F.when(found != "", found).otherwise(F.col(url_col)), F.lit(""))


def extract_main_text(pages: DataFrame, keep: list[str], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars``, one row per page.

    Null and empty html give empty text; pages without any tag give all their text; repeated rows count as
    repeated votes.  Winning paths are one row per host: Spark broadcasts them only if the written table is small.
    Kept columns of the results' names give way to them.
    """
    keep = [k for k in keep if k not in ("text", "n_chars", "_html", "_host", "_path", "_gone")]
    stash = Stash(pages.sparkSession, "html")
    votes = stash.put(host_votes(pages, url_col, html_col))
    won = stash.put(host_paths(votes).join(host_furniture(votes), "host", "full"))
    won = won.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("gone").alias("_gone"))
    rows = pages.select(*keep, F.col(html_col).alias("_html"), _host(url_col).alias("_host")).join(won, "_host", "left").drop("_host")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("_html", "_path", "_gone")), "text string, n_chars long"])
    return rows.mapInArrow(_extract, schema)
