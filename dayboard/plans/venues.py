"""Events from landed pages of venues: one function for each shape of listing, ``pages(url, html)`` to events.

Every function gives the columns of :data:`COLUMNS`, one row an event, dates as ISO text.  Whatever depends on today
takes ``as_of``.  Rows without a title or a date are left out; null and empty pages give none.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, extract, text, urls
from ..functions.values import filled, once
from ..operators.dedupe import keep_last_at_first
from ..sources import dom
from ..sources.readers import csv_cells

COLUMNS = ["source_url", "title", "date_from", "date_to", "open_time", "start_time", "end_time", "price", "contact", "venue_name", "body", "description", "image_url", "status"]
_RANGE = "[~～－−-]"


def _events(rows: DataFrame, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    # As one generated row, so that the filter below reads the columns instead of computing all of them once more.
    out = rows.select(F.inline(F.array(F.struct(*[columns.get(c, none).cast("string").alias(c) for c in COLUMNS]))))
    out = out.withColumn("date_to", F.coalesce("date_to", "date_from"))
    return out.where(~text.is_blank(F.col("title")) & F.col("date_from").isNotNull())


def _parts(html: Column, pattern: str) -> Column:
    """All blocks that a pattern's first group matches."""
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def _plain(html: Column) -> Column:
    return text.normalize_space(text.strip_tags(text.decode_entities(html)))


def _cell(html: Column, label: str, head: str, body: str) -> Column:
    """Text of the ``body`` element after a ``head`` element that has a label; null without one."""
    return filled(_plain(text.first_capture(html, rf"(?is)<{head}[^>]*>[^<]*{label}[^<]*</{head}>\s*<{body}[^>]*>(.*?)</{body}>")))


def _date(t: Column, as_of: dt.date) -> Column:
    """The first full date, else the first month and day in the year that a listing means."""
    day = lambda p: dates.make_date(dates.target_year(F.get(p, 0).cast("int"), as_of), F.get(p, 0), F.get(p, 1))
    short = lambda x: once(F.regexp_extract(x, r"\d{1,2}\s*[月/]\s*\d{1,2}", 0), lambda m: F.when(m != "", once(F.split(m, r"\s*[月/]\s*"), day)))
    return once(t, lambda x: F.coalesce(dates.single_date(x), short(x)))


def listing(pages: DataFrame, as_of: dt.date) -> DataFrame:
    """Links whose text has a title and a date."""
    link = _parts(F.col("html"), r"""(?is)(<a\b[^>]*href=["'][^"']+["'][^>]*>.*?</a>)""")
    rows = pages.select("url", F.explode(link).alias("a"))
    rows = rows.select("url", text.first_capture(F.col("a"), r"""(?i)href=["']([^"']+)["']""").alias("href"), text.normalize_space(text.decode_entities(text.strip_tags_with_breaks(F.col("a")))).alias("t"))
    return _events(rows, source_url=urls.resolve(F.col("href"), F.col("url")), title=F.col("t"), date_from=dates.single_date(F.col("t"))).where("source_url is not null")


def _first(of: Column, at) -> Column:
    """The first of an element's own elements of a kind."""
    return at(F.get(of, 0))


def _said(of: Column, at) -> Column:
    """Its text, null without one."""
    return filled(text.normalize_space(_first(of, at)["text"]))


def cards(pages: DataFrame, as_of: dt.date) -> DataFrame:
    """Cards with name, date, times from opening to end, place and price."""
    fields = {"title": ("p", "event-name"), "times": ("p", "event-time"), "price": ("div", "event-info1"), "place": ("span", "event-place1")}

    def columns(e: Column, at) -> dict[str, Column]:
        lines = F.array_join(F.transform(e["line"], lambda i: at(i)["text"]), " ")
        return {name: _said(e[name], at) for name in fields} | {"href": _first(e["link"], at)["href"], "lines": lines}

    kinds = {"card": (None, "event-wrap"), "link": ("a", None, "href"), "line": ("p",), **fields}
    rows = dom.chosen(pages, kinds, "card", columns, texts=("line", *fields), own={name: ("card", name) for name in ("link", "line", *fields)})
    span = extract.time_range(F.col("times"))
    return _events(
        rows,
        source_url=urls.resolve(F.col("href"), F.col("url")),
        title=F.col("title"),
        date_from=_date(F.col("lines"), as_of),
        open_time=text.first_capture(F.col("times"), r"(\d{1,2}:\d{2})\s*開場"),
        start_time=span["start"],
        end_time=span["end"],
        price=F.coalesce("price", F.lit("")),
        venue_name=F.coalesce("place", F.lit("")),
    ).where("source_url is not null")


def boxes(pages: DataFrame, as_of: dt.date) -> DataFrame:
    """Boxes with a heading and a list of terms: days from and to, opening hours, who may come and where."""
    named = {"when": "開催日", "hours": "営業時間", "who": "対象", "place": "会場場所"}

    def columns(e: Column, at) -> dict[str, Column]:
        value = lambda label: F.get(F.filter(e["term"], lambda i: at(i)["value"].isNotNull() & at(i)["text"].contains(label)), 0)
        return {"title": _said(e["head"], at)} | {name: filled(text.normalize_space(at(at(value(label))["value"])["text"])) for name, label in named.items()}

    kinds = {"box": ("div", "box"), "head": ("div", "mid"), "term": ("dt",), "value": ("dd",)}
    rows = dom.chosen(pages, kinds, "box", columns, texts=("head", "term", "value"), own={"head": ("box", "head"), "term": ("box", "term")}, after={"value": ("term", "value")})
    sides = F.split(F.translate("when", "０１２３４５６７８９", "0123456789"), _RANGE)
    hours = F.regexp_extract(text.half_width(F.col("hours")), r"(\d{1,2}:\d{2})", 1)
    first, last = _date(F.get(sides, 0), as_of), _date(F.get(sides, 1), as_of)
    body = F.concat(F.lit("対象: "), F.coalesce("who", F.lit("制限なし")), F.lit("\n会場: "), F.coalesce("place", F.lit("不明")))
    return _events(rows, source_url=F.col("url"), title=F.col("title"), date_from=first, date_to=last, start_time=dates.clock(hours), body=body)


def labelled_blocks(pages: DataFrame, label: str = r"と\s*き\s*:", furniture: str = "近日開催|イベント情報|ホーム|施設概要") -> DataFrame:
    """Plain text cut at a label: a block has date, time and price, and the last line of the block before it is the title."""
    plain = text.strip_tags(F.regexp_replace(text.decode_entities(F.col("html")), r"(?i)<br\s*/?>", "\n"))
    rows = pages.select("url", F.split(plain, label).alias("b"))
    rows = rows.select("url", F.explode(F.arrays_zip(F.slice("b", 2, 1 << 30).alias("now"), F.slice("b", 1, F.size("b") - 1).alias("before"))).alias("x")).select("url", "x.now", "x.before")
    lines = F.filter(F.transform(F.split("before", "\n"), lambda x: text.trim_space(text.remove_zero_width(x))), lambda x: (x != "") & ~x.rlike(furniture))
    price = F.regexp_extract("now", r"((?:前売り|一般|大人|高校生)[\s\S]*?\d{1,3}(?:,\d{3})*円)", 1)
    start = F.regexp_extract(F.regexp_replace("now", "：", ":"), r"開演\s*(\d{1,2}:\d{2})", 1)
    day = F.regexp_extract("now", r"(\d{4}年\s*\d{1,2}月\s*\d{1,2}日)", 1)
    return _events(rows, source_url=F.col("url"), title=F.coalesce(F.get(lines, F.size(lines) - 1), F.lit("名称未設定のイベント")), date_from=dates.single_date(day), start_time=dates.clock(start), price=filled(F.trim(F.replace(price, F.lit("\n"), F.lit(" ")))))


def month_tables(pages: DataFrame, as_of: dt.date, place: str = "") -> DataFrame:
    """Tables below a month: days and time, title, contact and price.  A day is one that has its weekday in brackets."""
    page = text.decode_entities(F.col("html"))
    month = F.coalesce(filled(F.regexp_extract(page, r'<div class="month">(\d{1,2})', 1)).cast("int"), F.lit(as_of.month))
    hall = F.coalesce(filled(_plain(text.first_capture(page, r'(?is)<div class="stitle"><h3>(.*?)</h3></div>'))), F.lit(place))
    rows = pages.select("url", month.alias("m"), hall.alias("hall"), F.explode(_parts(page, r"(?is)<tr[^>]*>(.*?)</tr>")).alias("r")).where(~F.col("r").rlike("催し物|日時"))
    rows = rows.select("*", _parts(F.col("r"), r"(?is)<td[^>]*>(.*?)</td>").alias("td")).where(F.size("td") >= 2)
    cell = lambda i: _plain(F.get("td", F.lit(i)))
    when = text.strip_tags_compact(F.get("td", F.lit(0)))
    sides, year = F.split(when, _RANGE), dates.target_year(F.col("m"), as_of)
    day = lambda i: dates.make_date(year, F.col("m"), filled(F.regexp_extract(F.get(sides, i), r"(\d{1,2})\s*[(（]", 1)))
    start = dates.clock(F.regexp_replace(when, "：", ":"))
    return _events(rows, source_url=F.col("url"), title=cell(1), date_from=day(0), date_to=day(1), start_time=start, price=F.coalesce(cell(3), F.lit("")), venue_name=F.lit(place), body=F.concat(F.lit("会場: "), F.col("hall"), F.lit("\nお問合せ先: "), F.coalesce(cell(2), F.lit(""))))


def calendar(months: DataFrame, details: DataFrame) -> DataFrame:
    """Events of month calendars, which have their day from the cell around them, joined to the events' own tables of
    labels.

    Closed days are left out; of events of one day and title the last counts.  An event whose detail page did not
    land stays with what the calendar says.
    """
    kinds = {"cell": ("td",), "daily": (None, "daily"), "event": (None, "event"), "link": ("a", None, "href"), "day": ("a", None, "href", "daily")}

    def columns(e: Column, at) -> dict[str, Column]:
        return {"node": e["node"], "text": e["text"], "cell_href": _first(at(e["cell"])["days"], at)["href"], "event_href": _first(e["links"], at)["href"]}

    rows = dom.chosen(months, kinds, "event", columns, texts=("event",), up={"cell": ("event", "cell")}, own={"days": ("cell", "day"), "links": ("event", "link")})
    rows = rows.where("cell_href is not null and event_href is not null")
    rows = rows.select(F.struct("url", "node").alias("ord"), dates.compact_date(F.col("cell_href")).alias("date_from"), text.normalize_space(F.col("text")).alias("title"), urls.resolve(F.col("event_href"), F.col("url")).alias("source_url"))
    rows = keep_last_at_first(rows.where("title <> '' and date_from is not null and source_url is not null and not contains(title, '休館日')"), ["date_from", "title"], "ord")
    row = lambda label: _cell(F.col("html"), label, "th", "td")
    found = details.select(F.col("url").alias("source_url"), row("日時").alias("when"), row("開催場所").alias("place"), row("入場料等").alias("fee"), row("イベント内容").alias("about"))
    start = F.coalesce(dates.clock(text.first_capture(F.col("when"), r"開演(\d{1,2}:\d{2})")), dates.clock(F.col("when")))
    body = filled(F.concat_ws("\n", F.concat(F.lit("会場: "), F.col("place")), F.col("about")))
    return _events(rows.join(found, "source_url", "left"), source_url=F.col("source_url"), title=F.col("title"), date_from=F.col("date_from"), start_time=start, price=F.col("fee"), body=body)


def entries_with_details(lists: DataFrame, details: DataFrame, as_of: dt.date, place: str = "") -> DataFrame:
    """Entries of a list joined to their pages, which have the date; entries whose page is lacking or undated go."""
    items = lists.select("url", F.explode(_parts(F.col("html"), r'(?is)<li class="c-entries__item">(.*?)</li>')).alias("i"))
    items = items.select(urls.resolve(text.first_capture(F.col("i"), r'(?i)<a href="([^"]+)"'), F.col("url")).alias("url"), F.coalesce(filled(_plain(text.first_capture(F.col("i"), r"(?is)<h3[^>]*>(.*?)</h3>"))), F.lit("Untitled")).alias("listed"))
    rows = items.join(details.select("url", text.decode_entities(F.col("html")).alias("html")), "url")
    own = filled(_plain(text.first_capture(F.col("html"), r'(?is)<h1[^>]*class="[^"]*entry-title[^"]*"[^>]*>(.*?)</h1>')))
    row = lambda *labels: F.coalesce(*(_cell(F.col("html"), x, "t[dh]", "td") for x in labels))
    return _events(rows, source_url=F.col("url"), title=F.coalesce(own, "listed"), date_from=_date(row("開催日", "日時", "期間"), as_of), start_time=dates.clock(F.regexp_replace(row("開催時間", "時間"), "：", ":")), price=row("入場料"), venue_name=F.lit(place))


# Columns of a hall's sheet that hold times, and the rooms they stand for.
ROOMS = [(3, "主競技場"), (4, "補助競技場"), (6, "補助競技場")]


def sheet(lines: DataFrame, as_of: dt.date, place: str = "") -> DataFrame:
    """Rows of sheets ``(url, n, line)`` in order, where day and title hold until the next one and a heading begins a month.

    Rows shorter than three cells, without a time, or on days that do not exist are left out; of rows of one day,
    title and start the last counts.
    """
    rows = lines.select("url", "n", csv_cells(F.col("line")).alias("c")).where(F.size("c") >= 3)
    cell = lambda i: F.coalesce(F.get("c", F.lit(i)), F.lit(""))
    month = filled(F.regexp_extract(F.array_join("c", " "), r"(\d{1,2})\s*月\s*行\s*事", 1)).cast("int")
    so_far = Window.partitionBy("url").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("head", month).withColumn("part", F.count("head").over(so_far)).withColumn("m", F.coalesce(F.last("head", True).over(so_far), F.lit(as_of.month)))
    inside = Window.partitionBy("url", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said = text.normalize_space(cell(2))
    proper = (said != "") & ~said.rlike("^(行事名|曜|日|※)")
    rows = rows.where("head is null").withColumn("day", F.last(F.when(cell(0).rlike(r"^\d{1,2}$"), cell(0)), True).over(inside)).withColumn("held", F.last(F.when(proper, said), True).over(inside))
    times = [(F.when(cell(i).contains("～"), cell(i)), room) for i, room in ROOMS]
    span = F.coalesce(*(F.when(extract.time_range(t)["start"].isNotNull(), extract.time_range(t)) for t, _ in reversed(times)))
    rooms = F.array_join(F.array_distinct(F.array_compact(F.array(*(F.when(t.isNotNull(), F.lit(room)) for t, room in times)))), "・")
    title = F.when(said != "", said).otherwise(F.col("held"))
    day = dates.make_date(dates.target_year(F.col("m"), as_of), F.col("m"), F.col("day"))
    found = _events(rows.withColumn("span", span).where("span is not null"), source_url=F.col("url"), title=F.nullif(title, F.lit("行事名")), date_from=day, start_time=F.col("span.start"), end_time=F.col("span.end"), venue_name=F.concat(F.lit(place + "（"), rooms, F.lit("）")), body=F.col("n"))
    return keep_last_at_first(found.withColumn("body", F.col("body").cast("long")), ["source_url", "date_from", "title", "start_time"], "body").withColumn("body", F.lit(None).cast("string")).select(COLUMNS)


def finalize(events: DataFrame, before_write=None) -> DataFrame:
    """Events checked by the schema's rules, then changed by a hook, ready to be written."""
    from ..operators.stats import require_valid

    checked = require_valid(events, "source_url")
    return checked.transform(before_write) if before_write else checked
