"""Events of single sources from their landed pages, one function a source's way of listing.

Like :mod:`.venues`: ``pages(url, html)`` with one row an address to the columns of ``venues.COLUMNS``; lists are joined
to the pages of details that they link to.  Whatever depends on today takes ``as_of``.  A detail page that did not land
leaves what the list says where the list has a date, else the event goes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, extract, text, urls
from ..functions.values import filled, once
from ..operators import dedupe, events, graph, spans
from ..sources.readers import api_posts, embedded_object, relaxed_json_map
from ..sources.shared import keep
from .venues import COLUMNS, _cell, _events, _parts, _plain

__all__ = [
    "anchor_blocks",
    "crawled_details",
    "date_rows",
    "dated_text",
    "day_objects",
    "described_posts",
    "event_posts",
    "exhibitions",
    "headed_section",
    "list_cards",
    "mixed_blocks",
    "month_crawl",
    "month_links",
    "next_month_pages",
    "special_and_lines",
    "term_details",
    "windowed_links",
]

# Bounds of texts, and forms of dates, links and times.
BODY, NOTE = 5000, 500
JP_DATE = r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日"
LINK = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
HREF = r"""(?i)href=["']([^"']+)["']"""


def _rooted(url: Column, base: Column) -> Column:
    """A path below the host of a page; what has a scheme stays."""
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1), url))


def _or_null(t: Column) -> Column:
    return filled(t)


def _jp_dates(t: Column) -> Column:
    """All days of a text that are written in full; days that do not exist are null."""
    digits = F.translate(t, "０１２３４５６７８９", "0123456789")
    return F.transform(F.regexp_extract_all(digits, F.lit(f"({JP_DATE})"), F.lit(1)), dates.single_date)


def _first_jp_date(html: Column) -> Column:
    """The first of :func:`_jp_dates` of the text of HTML, without making the text: one pass goes over what stands before
    the day, tags as a whole, and only what the day spans is cleaned.  Breaks count before other tags, which may hold
    them.

    All repetitions are possessive, so nothing is tried again and long texts need no deep stack.  Full-width digits are
    replaced beforehand where there are any; a class that holds them as well would take ten times as long.
    """
    digits = once(html, lambda t: F.when(t.rlike("[０-９]"), F.translate(t, "０１２３４５６７８９", "0123456789")).otherwise(t))
    brk = r"(?i:<br\s*/?>|</(?:p|li|div|dt|dd)>)"
    tag = rf"(?>{brk}|<(?>[^<>]++|{brk}|<)*+>)"
    gap = rf"(?>{text.SPACE}++|{tag}|&(?:amp;)?nbsp;)*+"
    day = rf"[0-9]{{4}}{gap}年{gap}[0-9]{{1,2}}{gap}月{gap}[0-9]{{1,2}}{gap}日"
    found = text.first_capture(digits, rf"\A(?>[^<0-9]++|{tag}|(?!{day})[<0-9])*+({day})")
    return F.get(_jp_dates(text.normalize_space(text.decode_entities(text.strip_tags_with_breaks(found)))), 0)


def _compact(html: Column) -> Column:
    return text.normalize_space(text.strip_tags_compact(text.decode_entities(html)))


def _terms(html: Column, label: str) -> Column:
    """The definition after a term that ends with a label, with its markup."""
    return text.first_capture(html, rf"(?is){label}</dt>\s*<dd[^>]*>(.*?)</dd>")


def _once(df: DataFrame, *columns) -> DataFrame:
    """Like ``select``, but as one generated row: later filters read the columns and do not compute them again."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def _hrefs(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` of all links of pages, resolved."""
    rows = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
    return rows.select(F.col("url").alias("src"), urls.resolve(F.col("href"), F.col("url")).alias("dst")).where("dst is not null")


def date_rows(lists: DataFrame, details: DataFrame, place: str = "") -> DataFrame:
    """Rows of a table, an event for each fragment of the date cell that has a day; times and text from the detail."""
    table = text.first_capture(text.decode_entities(F.col("html")), r"(?is)<tbody>(.*?)</tbody>")
    rows = lists.select("url", F.explode(_parts(table, r"(?is)<tr>(.*?)</tr>")).alias("r"))
    link = r'(?is)<td class="title_link">.*?<a href="([^"]+)">(.*?)</a>'
    rows = rows.select(
        _rooted(text.first_capture(F.col("r"), link), F.col("url")).alias("url"),
        text.strip_tags_compact(text.first_capture(F.col("r"), link, 2)).alias("title"),
        _rooted(text.first_capture(F.col("r"), r'(?i)<img[^>]+src="([^"]+)"'), F.col("url")).alias("image_url"),
        F.explode(F.split(text.first_capture(F.col("r"), r'(?is)<td class="date">(.*?)</td>'), r"(?i)</p>|</span>|<br\s*/?>")).alias("part"),
    ).withColumn("part", text.trim_space(text.strip_tags_compact(F.col("part"))))
    day = F.transform(F.regexp_extract_all("part", F.lit(r"(\d{4}年\d{2}月\d{2}日)"), F.lit(1)), dates.single_date)
    content = text.first_capture(text.decode_entities(F.col("html")), r'(?is)<div class="text-beginning">(.*?)</div>')
    when = text.first_capture(content, r"(?is)日時</strong></h3>.*?<p[^>]*>(.*?)</p>")
    clock = lambda label: dates.kanji_clock(text.first_capture(when, rf"{label}／([^（）\s]+)"))
    found = details.select("url", F.left(text.strip_tags_compact(content), F.lit(NOTE)).alias("description"), clock("開演").alias("start"), clock("開場").alias("open"))
    rows = rows.withColumn("day", day).where("size(day) > 0").join(found, "url", "left")
    return _events(rows, source_url=F.col("url"), title=F.col("title"), date_from=F.array_min("day"), date_to=F.array_max("day"), open_time=F.col("open"), start_time=F.col("start"), venue_name=F.lit(place), body=F.concat(F.lit("開催分: "), F.col("part")), description=_or_null(F.col("description")), image_url=F.col("image_url"))


def windowed_links(lists: DataFrame, details: DataFrame) -> DataFrame:
    """Links to events with what stands around them (500 signs before, 1500 after): the first heading there names the
    event, and its first day counts where the detail's table has none."""
    link = r"""(?is)<a\b[^>]*href=["'][^"']+["'][^>]*>.*?</a>"""
    rows = spans.contexts(lists, ["url"], "html", link, 500, 1500, where=lambda m: m.contains("/event/event-"))
    clean = lambda t: text.trim_space(F.regexp_replace(F.regexp_replace(text.normalize_space(text.strip_tags(text.decode_entities(t))), r"^(開催日|会期|日時)\s*[:：]?\s*", ""), r"\s*開催日\s*[:：]?.*$", ""))
    head = F.coalesce(text.first_capture(F.col("context"), r"(?is)<h3\b[^>]*>(.*?)</h3>"), text.first_capture(F.col("match"), LINK, 2))
    rows = _once(rows, "n", "url", text.first_capture(F.col("match"), HREF).alias("href"), head.alias("head"), _first_jp_date(F.col("context")).alias("near"))
    rows = _once(rows, "n", "url", urls.resolve(F.col("href"), F.col("url")).alias("source_url"), clean(F.col("head")).alias("listed"), "near")
    rows = rows.where(F.col("source_url").rlike(r"^[^?#]*/event/event-[^/?#]+/?(?:[?#]|$)") & (F.col("listed") != "") & ~F.col("listed").rlike(r"(?i)^(詳細を見る|more|read\s*more|view\s*more)$"))
    rows = dedupe.keep_first(rows.withColumn("ord", F.struct("url", "n")), ["source_url"], "ord")
    table = text.first_capture(F.col("html"), r"""(?is)<table\b[^>]*class=["'][^"']*eventTable[^"']*["'][^>]*>(.*?)</table>""")
    cell = lambda label: _cell(F.col("t"), label, "th", "td")
    content = _or_null(text.normalize_space(text.decode_entities(text.strip_tags_with_breaks(text.first_capture(F.col("html"), r"""(?is)<[^>]*class=["'][^"']*entry-content[^"']*["'][^>]*>(.*?)</[^>]+>""")))))
    image = F.coalesce(text.first_capture(F.col("html"), r"""(?is)<[^>]*class=["'][^"']*mec-events-event-image[^"']*["'][^>]*>.*?<img\b[^>]*src=["']([^"']+)["']"""), text.first_capture(F.col("html"), r"""(?is)<article\b[^>]*>.*?<img\b[^>]*src=["']([^"']+)["']"""))
    found = details.select(F.col("url").alias("source_url"), table.alias("t"), content.alias("content"), urls.resolve(image, F.col("url")).alias("image_url"))
    rows = _once(rows.join(found, "source_url"), *found.columns, "listed", "near", cell("開催日").alias("held")).withColumn("days", _jp_dates(F.col("held")))
    first = F.get("days", 0)
    start = F.when(F.col("held").isNull(), F.coalesce(first, "near")).otherwise(first)
    last = F.coalesce(F.when(first.isNotNull(), F.get("days", F.size("days") - 1)), start)
    hour = dates.clock(text.half_width(cell("時間")))
    about = F.concat_ws("\n", F.concat(F.lit("会場: "), cell("会場")), "content")
    return _events(rows, source_url=F.col("source_url"), title=F.col("listed"), date_from=start, date_to=last, start_time=hour, price=text.normalize_price(cell("料金")), contact=text.normalize_contact(cell("お問合せ")), description=_or_null(about), image_url=F.col("image_url"))


def event_posts(posts: DataFrame, details: DataFrame, as_of: dt.date, months: int = 7) -> DataFrame:
    """Posts of REST pages ``(url, body)`` that begin within so many months from this one; times that the post lacks are
    looked up behind their labels in the detail page."""
    rows = posts.select(F.explode(api_posts(F.col("body"))).alias("p")).select("p.*")
    group = F.col("acf.detail_group")
    hour = lambda name: dates.clock(text.half_width(group[name]))
    rows = rows.select(
        F.trim("link").alias("url"),
        text.normalize_decoded(text.strip_tags_compact(text.decode_entities(F.col("title.rendered")))).alias("title"),
        dates.strict_date(F.trim("acf.start_date")).alias("first"),
        dates.strict_date(F.trim("acf.end_date")).alias("last"),
        hour("e_start").alias("open"),
        hour("e_start2").alias("start"),
        hour("e_end").alias("end"),
        _or_null(F.trim(group["e_price"])).alias("price"),
        _or_null(F.trim(group["e_contact"])).alias("contact"),
    ).where("url <> ''")
    rows = rows.where(events.month_window(F.col("first"), as_of, months))
    said = lambda label: dates.clock(text.first_capture(F.col("html"), rf"{label}[^<]*?(?:<[^>]+>)*\s*(\d{{1,2}}:\d{{2}})"))
    found = details.select("url", said("開場").alias("d_open"), F.coalesce(said("開演"), said("開始")).alias("d_start"), F.coalesce(said("終演"), said("終了")).alias("d_end"))
    rows = rows.join(found, "url", "left")
    lacking = F.col("start").isNull() | F.col("open").isNull()
    return _events(rows, source_url=F.col("url"), title=F.col("title"), date_from=F.col("first"), date_to=F.col("last"), open_time=F.coalesce("open", "d_open"), start_time=F.coalesce("start", "d_start"), end_time=F.coalesce("end", F.when(lacking, F.col("d_end"))), price=F.col("price"), contact=F.col("contact"))


def term_details(lists: DataFrame, details: DataFrame, address: str, place: str = "") -> DataFrame:
    """Details whose address, a pattern, stands anywhere in a list; days, hours and place from their list of terms."""
    wanted = lists.select(F.explode(F.regexp_extract_all(text.decode_entities(F.col("html")), F.lit(f"({address})"), F.lit(1))).alias("url")).distinct()
    rows = details.select("url", text.decode_entities(F.col("html")).alias("html")).join(wanted, "url", "left_semi")
    rows = rows.withColumn("terms", text.label_map(text.first_capture(F.col("html"), r'(?is)<dl class="list">(.*?)</dl>')))
    term = lambda name: F.coalesce(F.get(F.map_values(F.map_filter("terms", lambda k, v: k == name)), 0), F.lit(""))
    found = F.transform(F.regexp_extract_all(term("開催日"), F.lit(r"(\d{4}/\d{2}/\d{2})"), F.lit(1)), dates.single_date)
    hours, content = term("開催時間"), text.first_capture(F.col("html"), r'(?is)<div class="post_content">(.*?)</div>')
    title = F.coalesce(F.trim(text.first_capture(F.col("html"), r"(?is)<h1[^>]*>(.*?)</h1>")), F.lit("無題"))
    body = F.concat(F.lit("時間: "), hours, F.lit("\n備考: "), term("参加費・応募など"))
    return _events(rows, source_url=F.col("url"), title=title, date_from=F.get(found, 0), date_to=F.get(found, 1), start_time=text.first_capture(hours, r"(\d{1,2}:\d{2})"), end_time=text.first_capture(hours, r"～(\d{1,2}:\d{2})"), venue_name=F.coalesce(_or_null(term("開催場所")), F.lit(place)), body=text.trim_space(body), description=F.left(F.coalesce(text.strip_tags_compact(content), F.lit("")), F.lit(NOTE)), image_url=text.first_capture(F.col("html"), r"""(?is)class="post_content">.*?<img[^>]+src=['"]([^'"]+)['"]"""))


def list_cards(lists: DataFrame, details: DataFrame, as_of: dt.date, place: str = "") -> DataFrame:
    """Cards of a list with month and day of this year, and the text and picture of their pages."""
    rows = lists.select("url", F.explode(_parts(text.decode_entities(F.col("html")), r'(?is)<li class="card_list">(.*?)</li>')).alias("c"))
    said = F.transform(_parts(F.col("c"), r'(?is)<span class="date_start">(.*?)</span>'), text.strip_tags_compact)
    title = F.coalesce(text.strip_tags_compact(text.first_capture(F.col("c"), r'(?s)<div class="detail_name">(.*?)</div>')), F.lit("無題のイベント"))
    rows = rows.select(_rooted(text.first_capture(F.col("c"), r'href="([^"]+)"'), F.col("url")).alias("url"), title.alias("title"), said.alias("said")).where("url is not null and size(said) > 0")
    page = text.decode_entities(F.col("html"))
    note = text.strip_tags_compact(text.first_capture(page, r'(?is)<div class="p-news-detail__content">(.*?)</div>'))
    image = text.first_capture(page, r"""(?is)<div class="p-news-detail__thumb">.*?<img[^>]+src=['"]([^'"]+)['"]""")
    found = details.select("url", F.left(note, F.lit(NOTE)).alias("description"), _rooted(image, F.col("url")).alias("image_url"))
    day = lambda i: dates.this_year(text.first_capture(F.get("said", F.lit(i)), r"(\d{1,2}月\d{1,2}日)"), as_of)
    return _events(rows.join(found, "url", "left"), source_url=F.col("url"), title=F.col("title"), date_from=day(0), date_to=day(1), venue_name=F.lit(place), body=F.concat(F.lit("開催期間: "), F.array_join("said", "〜")), description=_or_null(F.col("description")), image_url=F.col("image_url"))


def dated_text(pages: DataFrame, as_of: dt.date) -> DataFrame:
    """Plain text cut at days with their weekdays; what stands before the next label is the title.  Of events of one day
    and title the last counts."""
    flat = text.normalize_space(text.decode_entities(text.strip_tags(F.col("html"))))
    day = r"(?<!\d)\d{1,2}/\d{1,2}\s*\([月火水木金土日]\)"
    rows = pages.select("url", F.posexplode(text.pieces(flat, day)).alias("n", "p"))
    rest = text.trim_space(F.regexp_replace("p", f"^{day}", ""))
    title = F.regexp_replace(F.regexp_replace(F.get(F.split(rest, "施設|主催|主管|TEL|日時|競輪情報", 2), 0), r"^(行事|名称|大会名)[\s：:]*", ""), r"[\s：:]+$", "")
    month, number = (F.regexp_extract("p", r"^(\d{1,2})/(\d{1,2})", i).cast("int") for i in (1, 2))
    rows = rows.select("url", F.struct("url", "n").alias("ord"), text.trim_space(title).alias("title"), F.concat_ws("/", month, number).alias("day"), text.first_capture(rest, r"施設\s*(\S+)").alias("place"), text.first_capture(rest, r"主催・主管\s*(\S+)").alias("host"))
    rows = dedupe.keep_last_at_first(rows.where((F.length("title") > 1) & ~F.col("title").contains("休館日")), ["day", "title"], "ord")
    return _events(rows, source_url=F.col("url"), title=F.col("title"), date_from=dates.date_range(F.col("day"), as_of)["date_from"], contact=F.col("host"), description=F.concat(F.lit("会場: "), F.col("place")))


def exhibitions(shows: DataFrame, lists: DataFrame, details: DataFrame, as_of: dt.date, place: str = "", past: int = 365) -> DataFrame:
    """Exhibitions with their detail pages, merged with a list of events that are not long past: an event of both keeps
    the exhibition's fields, and of the two addresses that of a detail page."""
    show = r'(?is)<(?:section|li) class="exhibition-(?:lg-box|simple-item|item)"[^>]*>(.*?)</(?:section|li)>'
    rows = shows.select("url", F.posexplode(_parts(F.col("html"), show)).alias("n", "b"))
    term = text.normalize_space(text.strip_tags_compact(F.coalesce(text.first_capture(F.col("b"), r'(?is)<p class="(?:post-term|exhibition-simple-item__date)">(.*?)</p>'), F.lit(""))))
    rows = _once(rows, F.struct("url", "n").alias("ord"), urls.resolve(text.first_capture(F.col("b"), r'(?i)<a[^>]*href="([^"]+)"'), F.col("url")).alias("source_url"), _compact(text.first_capture(F.col("b"), r"(?is)<h[34][^>]*>(.*?)</h[34]>")).alias("title"), term.alias("term"))
    rows = dedupe.keep_first(rows.where("source_url is not null and title <> ''"), ["source_url"], "ord")
    sides = F.split("term", r"\s*[~～〜]\s*")
    day = lambda i: dates.single_date(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.get(sides, F.lit(i)), r"[（(][^）)]*[）)]", ""), r"\s+", ""), r"(\d)-", "$1/"))
    page = F.col("page")
    said = _once(details, F.col("url").alias("source_url"), text.decode_entities(F.col("html")).alias("page"))
    said = _once(said, "source_url", *(_terms(page, label).alias(name) for name, label in (("hours", "開館時間"), ("hall", "会場"), ("fee", "料金"))))
    hours, hall, fee = (F.col(name) for name in ("hours", "hall", "fee"))
    general = text.normalize_space(text.first_capture(fee, r"(?is)<th[^>]*>一般</th>.*?<td[^>]*>\s*([^<]+?)\s*</td>"))
    plain_fee = text.normalize_space(text.strip_tags_compact(fee))
    said = _once(said, "source_url", "hall", general.alias("general"), plain_fee.alias("plain_fee"), text.normalize_space(text.strip_tags_compact(hours)).alias("time"))
    general, plain_fee, time = (F.col(name) for name in ("general", "plain_fee", "time"))
    price = F.when(general.rlike(r"\d"), general).when(plain_fee.rlike("^無料$|観覧料：?無料") | F.coalesce(general.contains("無料"), F.lit(False)), F.lit("無料"))
    edge = lambda i: F.lpad(text.first_capture(time, r"(\d{1,2}:\d{2})[～~](\d{1,2}:\d{2})", i), 5, "0")
    found = said.select("source_url", edge(1).alias("start_time"), edge(2).alias("end_time"), F.concat(F.lit("\n開館時間: "), time).alias("hours"), text.normalize_space(text.strip_tags_compact(hall)).alias("hall"), price.alias("price"), F.concat(F.lit("\n料金詳細: "), plain_fee).alias("fee"))
    rows = rows.join(found, "source_url", "left")
    body = F.concat(F.lit("期間原文: "), F.col("term"), F.coalesce("hours", F.lit("")), F.coalesce("fee", F.lit("")))
    shown = _events(rows, source_url=F.col("source_url"), title=F.col("title"), date_from=day(0), date_to=day(1), start_time=F.col("start_time"), end_time=F.col("end_time"), price=F.col("price"), venue_name=F.concat_ws(" ", F.lit(place), "hall"), body=body)

    items = lists.select("url", F.posexplode(_parts(F.col("html"), r"""(?is)(<a\b[^>]*class=["'][^"']*event-item[^"']*["'][^>]*>.*?</a>)""")).alias("n", "b"))
    said = _compact(F.regexp_replace(text.first_capture(F.col("b"), r"""(?is)<p[^>]*class=["'][^"']*post-term[^"']*["'][^>]*>(.*?)</p>"""), r"(?i)<br\s*/?\s*>", " "))
    items = _once(items, F.struct("url", "n").alias("ord"), urls.resolve(text.first_capture(F.col("b"), HREF), F.col("url")).alias("source_url"), _compact(text.first_capture(F.col("b"), r"""(?is)<h2[^>]*class=["'][^"']*event-item__title[^"']*["'][^>]*>(.*?)</h2>""")).alias("title"), said.alias("said"))
    items = _once(items, "ord", "source_url", "title", "said", _jp_dates(dates.normalize_date_text(F.col("said"), drop_parens=True)).alias("days")).where(~F.exists("days", lambda x: x.isNull()))
    listed = _events(items, source_url=F.col("source_url"), title=F.col("title"), date_from=F.array_min("days"), date_to=F.array_max("days"), venue_name=F.lit(place), body=F.concat(F.lit("期間原文: "), F.col("said"))).where("source_url is not null")
    listed = listed.where(F.col("date_to") >= F.lit((as_of - dt.timedelta(past)).isoformat()))

    both = dedupe.union_sources(shown, listed)
    key, rest = ["title", "date_from", "date_to"], [c for c in COLUMNS if c not in ("title", "date_from", "date_to")]
    is_detail = F.coalesce(F.col("source_url").contains("/event/info/") | F.col("source_url").contains("/exhibition/detail/"), F.lit(False))
    # The later exhibition of a key stands for it, but the earlier item of the list.
    better = F.min_by("source_url", F.struct((~is_detail).alias("worse"), "source_ord", "source_url"))
    row = F.coalesce(F.max_by(F.struct(*rest), F.when(F.col("source_ord") == 0, F.col("source_url"))), F.min_by(F.struct(*rest), F.when(F.col("source_ord") == 1, F.col("source_url"))))
    merged = both.groupBy(*key).agg(row.alias("row"), better.alias("better"))
    own = F.coalesce(F.col("row.source_url").contains("/event/info/") | F.col("row.source_url").contains("/exhibition/detail/"), F.lit(False))
    merged = merged.select(*key, "row.*", F.when(own, F.col("row.source_url")).otherwise(F.col("better")).alias("address"))
    return merged.withColumn("source_url", F.col("address")).select(COLUMNS)


def headed_section(pages: DataFrame, heading: str, ends: list[str]) -> DataFrame:
    """Dated links between a heading and the next heading of an end; the day and its weekday leave the title."""
    head = r"<h[1-6][^>]*>"
    parts = F.transform(text.pieces(F.col("html"), head), lambda p: F.struct(_compact(text.first_capture(p, r"(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>")).alias("h"), p.alias("p")))
    rows = pages.select("url", parts.alias("parts"))
    begin = F.array_position(F.transform("parts", lambda x: F.coalesce(x["h"].contains(heading), F.lit(False))), True)
    rows = rows.withColumn("at", begin.cast("int")).where("at > 0").withColumn("tail", F.expr("slice(parts, at, size(parts))"))
    stop = F.array_position(F.transform("tail", lambda x: F.coalesce(text.contains_any(x["h"], ends), F.lit(False))), True).cast("int")
    rows = rows.withColumn("stop", stop).withColumn("kept", F.expr("if(stop > 0, slice(tail, 1, stop - 1), tail)"))
    rows = rows.select("url", F.explode(_parts(F.array_join(F.transform("kept", lambda x: x["p"]), ""), r"""(?is)(<a\b[^>]*href=['"][^'"]+['"][^>]*>.*?</a>)""")).alias("a"))
    rows = rows.select("url", text.first_capture(F.col("a"), HREF).alias("href"), text.decode_entities(text.normalize_space(text.strip_tags(F.col("a")))).alias("t"))
    day = r"\d{4}[./年]\d{1,2}[./月]\d{1,2}日?"
    title = text.heading_title(F.regexp_replace(F.regexp_replace("t", rf"^(.*?){day}(?:\s*[（(][^）)]+[）)])?", "$1 "), r"\s+", " "))
    return _events(rows, source_url=urls.resolve(F.col("href"), F.col("url")), title=title, date_from=dates.single_date(text.first_capture(F.col("t"), f"({day})")))


def described_posts(lists: DataFrame, details: DataFrame, as_of: dt.date, days: int = 365) -> DataFrame:
    """Linked posts with a list of terms, no more than so many days from today; the page's text where it says neither
    time, price nor contact."""
    wanted = _hrefs(lists).where(urls.is_event_detail(F.col("dst"))).select(F.col("dst").alias("url")).distinct()
    block = F.array_join(_parts(F.col("html"), r'(?s)(<dl class="dl_postevent[^"]*">.*?</dl>)'), "")
    rows = details.join(wanted, "url", "left_semi").withColumn("terms", text.label_map(block))
    term = lambda name: F.coalesce(F.get(F.map_values(F.map_filter("terms", lambda k, v: k == name)), 0), F.lit(""))
    span = extract.implied_end_range_of_list(dates.normalize_date_text(F.coalesce(_or_null(term("イベント開催期間")), term("開催期間"))))
    hours = F.regexp_extract_all(text.half_width(term("時間")), F.lit(r"(\d{1,2}:\d{2})"), F.lit(1))
    rows = rows.select("url", "html", span.alias("span"), _plain(text.first_capture(F.col("html"), r'(?is)<h3 class="h3_title01[^"]*">(.*?)</h3>')).alias("title"), dates.clock(F.get(hours, 0)).alias("start"), dates.clock(F.when(F.size(hours) > 1, F.get(hours, F.size(hours) - 1))).alias("end"), _or_null(term("入場料")).alias("price"), _or_null(term("お問合せ先")).alias("contact"))
    rows = rows.where(events.within_days(F.col("span.date_from"), as_of, days, oldest=True))
    lines = F.filter(F.transform(F.split(text.decode_entities(text.strip_tags(F.col("html"))), r"\r?\n"), text.trim_space), lambda x: x != "")
    silent = F.coalesce("start", "end", "price", "contact").isNull()
    return _events(rows, source_url=F.col("url"), title=F.col("title"), date_from=F.col("span.date_from"), date_to=F.col("span.date_to"), start_time=F.col("start"), end_time=F.col("end"), price=F.col("price"), contact=F.col("contact"), body=F.when(silent, _or_null(text.line_budget(lines, BODY, cut_first=False, within=True))))


def mixed_blocks(pages: DataFrame, as_of: dt.date, folder: str, index: str, months: int = 7) -> DataFrame:
    """Items, rows and boxes of a page whose first link leads into a folder, with days that may lack their year; an end
    before the start makes a single day.  A block inside a block counts with both, as the page says it."""
    kinds = [r"(?s)(<li.*?</li>)", r"(?s)(<tr.*?</tr>)", r"""(?s)(<div[^>]*class=["'][^"']*event[^"']*["'].*?</div>)"""]
    rows = pages.select("url", F.explode(F.concat(*(_parts(F.col("html"), k) for k in kinds))).alias("b")).withColumn("b", text.decode_entities(F.col("b")))
    link = r"""(?is)<a[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
    rows = _once(rows, "url", F.trim(text.first_capture(F.col("b"), link)).alias("href"), text.normalize_space(text.strip_tags_compact(text.first_capture(F.col("b"), link, 2))).alias("title"), dates.normalize_date_text(text.normalize_space(text.strip_tags_compact(F.col("b"))), commas=True).alias("t"))
    rows = rows.where(F.col("href").contains(folder) & ~F.col("href").rlike("(?i)^(#|mailto:|tel:)") & ~F.col("href").endswith(index))
    rows = _once(rows, "url", "href", "title", "t", F.transform(dates.date_parts(F.col("t")), lambda x: F.split(x, "-")).alias("found"))

    def day(i: int, year: Column) -> Column:
        x = F.get("found", F.lit(i))
        full = F.size(x) == 3
        return dates.make_date(F.when(full, F.get(x, 0)).otherwise(year.cast("string")), F.get(x, F.when(full, 1).otherwise(0)), F.get(x, F.when(full, 2).otherwise(1)))

    first = day(0, F.lit(as_of.year))
    ranged = (F.size("found") > 1) & F.col("t").rlike("[~-]")
    rows = _once(rows, "url", "href", "title", "found", first.alias("first"), ranged.alias("ranged"))
    rows = _once(rows, "url", "href", "title", "first", F.when(F.col("ranged"), day(1, F.year("first"))).otherwise(F.col("first")).alias("last"))
    rows = rows.where("last is not null").where(events.month_window(F.col("first"), as_of, months))
    return _events(rows, source_url=urls.resolve(F.col("href"), F.col("url")), title=F.col("title"), date_from=F.col("first"), date_to=extract.inverted_to_single(F.col("first"), F.col("last"))).where("source_url is not null")


def month_links(pages: DataFrame, as_of: dt.date, days: int = 365) -> DataFrame:
    """``(src, dst, place)`` of links between landed pages to months that touch the days around today, in their order on
    the page."""
    rows = pages.select(F.col("url").alias("src"), F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("place", "href"))
    rows = rows.select("src", "place", urls.month_page(urls.resolve(F.col("href"), F.col("src"))).alias("m")).where("m is not null")
    near = (F.col("m.month") <= F.lit(as_of + dt.timedelta(days))) & (F.last_day("m.month") >= F.lit(as_of - dt.timedelta(days)))
    return rows.where(near).groupBy("src", F.col("m.url").alias("dst")).agg(F.min("place").alias("place"))


def _reached(pages: DataFrame, seed: str, as_of: dt.date, most: int) -> DataFrame:
    """The seed and the landed ones of the first ``most`` pages that a queue of its links of months reads."""
    links = keep(month_links(pages, as_of), "links")
    seen = graph.crawl_in_order(links.where(F.col("src") == seed).select(F.col("dst").alias("node"), "place"), links, most)
    read = seen.select(F.col("node").alias("url")).unionByName(pages.sparkSession.createDataFrame([(seed,)], "url string")).distinct()
    return pages.join(read, "url", "left_semi")


def month_crawl(pages: DataFrame, details: DataFrame, seed: str, as_of: dt.date, most: int = 36) -> DataFrame:
    """Details linked from the months around today: labelled values first, the whole text where there are none."""
    href = _hrefs(_reached(pages, seed, as_of, most))
    wanted = href.where(F.col("dst").rlike(r"/event/\d+/?(?:$|[?#])") & ~F.col("dst").rlike("/event/(?:date|feed)/")).select(F.col("dst").alias("url")).distinct()
    rows = details.join(wanted, "url", "left_semi").withColumn("lines", text.text_lines(F.col("html")))
    value = lambda *labels: _or_null(F.coalesce(*(_or_null(text.labeled_value(F.col("lines"), [x])) for x in labels), F.lit("")))
    rows = rows.withColumn("all", text.half_width(F.array_join("lines", " ")))
    day = text.half_width(F.coalesce(value("開催日"), "all"))
    hour = lambda label: text.first_capture(F.col("all"), rf"{label}\s*:?\s*(\d{{1,2}}:\d{{2}})")
    rows = rows.select("url", "lines", extract.fallback_title(F.col("html"), value("イベント名")).alias("title"), dates.single_date(text.first_capture(day, r"(\d{4}年\d{1,2}月\d{1,2}日)")).alias("first"), hour("開場").alias("open"), hour("開演").alias("start"), hour("終演").alias("end"), value("入場料など", "入場料").alias("price"), text.contact_line(F.transform("lines", lambda x: text.normalize_space(text.half_width(x)))).alias("contact"))
    silent = F.coalesce("open", "start", "end", "price", "contact").isNull()
    return _events(rows, source_url=F.col("url"), title=F.col("title"), date_from=F.col("first"), open_time=F.col("open"), start_time=F.col("start"), end_time=F.col("end"), price=F.col("price"), contact=F.col("contact"), body=F.when(silent, _or_null(text.line_budget(F.col("lines"), BODY))))


def crawled_details(pages: DataFrame, details: DataFrame, seed: str, as_of: dt.date, most: int = 36) -> DataFrame:
    """All pages that months around today link to with a text, by their first heading and first day."""
    reached = _reached(pages, seed, as_of, most)
    rows = reached.select("url", F.explode(_parts(F.col("html"), r"""(?is)(<a\b[^>]*href=['"][^'"]+['"][^>]*>.*?</a>)""")).alias("a"))
    rows = rows.where(_plain(F.col("a")) != "").select(urls.resolve(text.first_capture(F.col("a"), HREF), F.col("url")).alias("url")).where("url is not null").distinct()
    found = details.join(rows, "url", "left_semi")
    plain = text.normalize_space(text.decode_entities(text.strip_tags_with_breaks(F.col("html"))))
    return _events(found, source_url=F.col("url"), title=extract.fallback_title(F.col("html"), F.lit("")), date_from=dates.single_date(plain))


def anchor_blocks(pages: DataFrame, places: list[str]) -> DataFrame:
    """Blocks from one numbered anchor to the next: title, days whose year and month carry on, and a place that must be
    one of those named."""
    anchor = r'<a[^>]*\b(?:name|id)="no\d+"[^>]*>'
    rows = pages.select("url", F.explode(text.pieces(F.col("html"), anchor)).alias("b"))
    part = lambda tag, name: text.first_capture(F.col("b"), rf"""(?is)<{tag}[^>]*class=["']{name}["'][^>]*>(.*?)</{tag}>""")
    meta = text.lines_at(part("td", "mainTit2"))
    rows = rows.select(
        F.concat("url", F.lit("#"), F.regexp_extract("b", r'(?i)\b(?:name|id)="(no\d+)"', 1)).alias("source_url"),
        _compact(F.regexp_replace(part("td", "mainTit1"), r"(?i)<br\s*/?>", " ")).alias("title"),
        F.get(meta, 0).alias("line"),
        F.array_join(F.slice(meta, 2, 1 << 30), " ").alias("place"),
        F.coalesce(F.array_join(text.lines_at(part("div", "mainTx0")), "\n"), F.lit("")).alias("about"),
    ).where(text.contains_any(F.col("place"), places))
    said = F.regexp_replace("line", r"\s+", "")
    group = lambda i: F.regexp_extract_all(said, F.lit(r"(?:(\d{4})年)?(?:(\d{1,2})月)?(\d{1,2})日"), F.lit(i))
    zipped = F.arrays_zip(group(1).alias("y"), group(2).alias("m"), group(3).alias("d"))

    def carry(done: Column, x: Column) -> Column:
        y, m = F.coalesce(_or_null(x["y"]), done["y"]), F.coalesce(_or_null(x["m"]), done["m"])
        day = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(x["d"], 2, "0"))
        return F.struct(y.alias("y"), m.alias("m"), F.concat(done["days"], F.array(F.when(y.isNotNull() & m.isNotNull(), day))).alias("days"))

    none = F.lit(None).cast("string")
    rows = rows.withColumn("days", F.aggregate(zipped, F.struct(none.alias("y"), none.alias("m"), F.array().cast("array<string>").alias("days")), carry, lambda a: a["days"]))
    rows = rows.where(~F.exists("days", lambda x: x.isNull()))
    over = F.col("about").contains("公演は終了しました") | F.col("about").contains("イベントは終了しました")
    suffix = "…（省略）"
    body = F.when(F.length("about") > BODY, F.concat(F.left("about", F.lit(BODY - len(suffix))), F.lit(suffix))).otherwise(F.col("about"))
    return _events(rows, source_url=F.col("source_url"), title=F.col("title"), date_from=F.array_min("days"), date_to=F.array_max("days"), venue_name=F.col("place"), body=_or_null(body), description=_or_null(F.col("about")), status=F.when(over, F.lit("finished")).otherwise(F.lit("scheduled")))


def day_objects(pages: DataFrame, names: tuple[str, ...] = ("e_icon", "event_detail")) -> DataFrame:
    """Events of an object in the page's script from days to HTML, the first of the names that has days; what is not
    public, closed days and blocks without a title go."""
    rows = pages.select("url", *[relaxed_json_map(embedded_object(F.col("html"), n)).alias(n) for n in names])
    dated = [F.map_filter(n, lambda k, v: k.rlike(r"^\d{4}/\d{2}/\d{2}$")) for n in names]
    chosen = F.coalesce(*(F.when(F.size(m) > 0, m) for m in dated))
    rows = rows.select("url", F.explode(chosen).alias("day", "html")).withColumn("html", text.decode_entities(F.col("html")))
    head = r"""<span[^>]*class=['"][^"']*\be_icon\b[^"']*['"][^>]*>"""
    blocks = text.pieces(F.col("html"), head)
    rows = rows.select("url", "day", F.explode(once(blocks, lambda b: F.when(F.size(b) > 0, b).otherwise(F.array("html")))).alias("b"))
    rows = _once(rows, "url", "day", "b", text.normalize_space(text.strip_tags(F.col("b"))).alias("t"), text.normalize_space(text.strip_tags(text.first_capture(F.col("b"), r"""(?s)<a[^>]*href=['"][^'"]+['"][^>]*>(.*?)</a>"""))).alias("title"))
    rows = rows.where((F.col("title") != "非公開") & ~F.col("t").contains("休館"))
    hour = lambda label: text.first_capture(F.col("t"), rf"{label}\s*(\d{{1,2}}:\d{{2}})")
    suffix = "…（省略）"
    body = F.when(F.length("t") > BODY, F.concat(F.left("t", F.lit(BODY - len(suffix))), F.lit(suffix))).otherwise(F.col("t"))
    return _events(rows, source_url=urls.resolve(text.first_capture(F.col("b"), r"""<a[^>]*href=['"]([^'"]+)['"]"""), F.col("url")), title=F.col("title"), date_from=extract.slash_key(F.col("day")), open_time=hour("開場"), start_time=hour("開演"), end_time=hour("終演"), body=_or_null(body))


def next_month_pages(pages: DataFrame, seed: str, most: int = 7) -> DataFrame:
    """Headed events of the pages that links to the next month lead to from a seed; of equal title, day, place and start
    the first counts."""
    anchors = pages.select("url", F.posexplode(_parts(F.col("html"), r"""(?is)(<a\b[^>]*href=['"][^'"]+['"][^>]*>.*?</a>)""")).alias("n", "a"))
    named = text.heading_title(text.strip_tags_compact(F.col("a"))).rlike("(?:来月|次月|翌月)のイベント")
    href = dedupe.keep_first(anchors.where(named), ["url"], "n")
    links = href.select(F.col("url").alias("src"), urls.resolve(text.first_capture(F.col("a"), HREF), F.col("url")).alias("dst")).where("dst is not null")
    chain = graph.next_links(pages.sparkSession.createDataFrame([(seed,)], "node string"), links, most)
    rows = pages.join(chain.select(F.col("node").alias("url"), "depth"), "url")
    rows = rows.select("url", "depth", F.posexplode(text.pieces(F.col("html"), r"<h4\b[^>]*>")).alias("n", "p"))
    # a few pages hold all events: these are dealt out before they are read
    rows = rows.repartition("depth", "n")
    rows = _once(rows, "url", "depth", "n", text.first_capture(F.col("p"), r"(?is)^<h4\b[^>]*>(.*?)</h4>").alias("head"), F.regexp_replace("p", r"(?is)^<h4\b[^>]*>.*?</h4>", "").alias("rest"))
    rows = _once(rows, "url", "depth", "n", "head", "rest", text.lines_at(F.col("rest"), "p|div|li").alias("lines")).withColumn("line", F.get("lines", 0))
    links_in = F.transform(_parts(F.col("rest"), r"""(?is)(<a\s+[^>]*href=["'][^"']+["'][^>]*>.*?</a>)"""), lambda a: F.struct(text.first_capture(a, HREF).alias("href"), text.strip_tags_compact(a).alias("t")))
    first_of = lambda keep: F.get(F.filter("links", keep), 0)["href"]
    address = F.coalesce(text.first_capture(F.col("head"), r"""(?i)<a\s+[^>]*href=["']([^"']+)["']"""), first_of(lambda x: x["t"].contains("詳細")), first_of(lambda x: x["href"].contains("/event/")), F.get("links", 0)["href"])
    span = r"(\d{1,2}:\d{2})\s*[〜～\-–—]\s*(\d{1,2}:\d{2})"
    start, end, opens = (text.first_capture(F.col("line"), p, i) for p, i in ((span, 1), (span, 2), (r"開場\s*(\d{1,2}:\d{2})", 1)))
    alone = F.when(F.coalesce(start, end, opens).isNull(), text.first_capture(F.col("line"), r"(\d{1,2}:\d{2})"))
    place = F.concat_ws("", F.split("line", r"\d{4}年\s*\d{1,2}月\s*\d{1,2}日", 2))
    for gone in (r"[（(][^）)]+[）)]", r"開場\s*\d{1,2}:\d{2}", span, r"\d{1,2}:\d{2}"):
        place = F.regexp_replace(place, gone, "")
    value = lambda labels: _or_null(text.normalize_space(text.labeled_value(F.col("lines"), labels)))
    day = dates.single_date(text.first_capture(F.col("line"), r"(\d{4}年\s*\d{1,2}月\s*\d{1,2}日)"))
    rows = _once(_once(rows, "*", links_in.alias("links")), F.struct("depth", "n").alias("ord"), F.coalesce(urls.resolve(address, F.col("url")), "url").alias("source_url"), text.heading_title(text.strip_tags_compact(F.col("head"))).alias("title"), day.alias("day"), F.coalesce(start, alone).alias("start"), end.alias("end"), opens.alias("open"), _or_null(text.normalize_space(place)).alias("place"), value(["入場料等", "入場料", "料金"]).alias("price"), value(["お問合せ", "お問い合わせ", "問合せ", "問い合わせ"]).alias("contact"))
    rows = dedupe.keep_first(rows.where("day is not null"), ["title", "day", "place", "start"], "ord")
    return _events(rows, source_url=F.col("source_url"), title=F.col("title"), date_from=F.col("day"), open_time=F.col("open"), start_time=F.col("start"), end_time=F.col("end"), price=F.col("price"), contact=F.col("contact"), venue_name=F.col("place"))


# Kinds of exhibitions that title lines name.
SHOWS = ["特別展", "コレクション展", "その他展覧会", "日本伝統漆芸展", "企画展", "常設展"]
SPECIAL, AFTER_SPECIAL = "特別展", ["コレクション展", "その他展覧会", "企画展", "常設展"]
_BREAKS = r"p|div|h[1-6]|section|li"


def _date_span(t: Column) -> Column:
    """``struct(first, last)`` of a full day, a sign of a range after it, and an end whose year may be implied."""

    def near(first: Column, p: Column) -> Column:
        day = lambda year: dates.make_date(year, F.get(p, 0), F.get(p, 1))
        return once(day(F.year(first)), lambda d: F.when(d < first, day(F.year(first) + 1)).otherwise(d))

    def last(first: Column, rest: Column) -> Column:
        short = once(F.regexp_extract(rest, r"\d{1,2}\s*月\s*\d{1,2}\s*日", 0), lambda m: F.when(m != "", near(first, F.split(m, r"\s*[月日]\s*"))))
        return F.coalesce(dates.single_date(text.first_capture(rest, f"({JP_DATE})")), F.when(~rest.rlike(JP_DATE), short))

    def span(x: Column) -> Column:
        return once(F.when(x["rest"].rlike("~|-|から|まで"), last(x["first"], x["rest"])), lambda d: F.when(x["first"] <= d, F.struct(x["first"].alias("first"), d.alias("last"))))

    parts = lambda x: F.struct(dates.single_date(text.first_capture(x, f"({JP_DATE})")).alias("first"), F.get(F.split(x, JP_DATE, 2), 1).alias("rest"))
    return once(t, lambda x: once(parts(x), span))


def special_and_lines(pages: DataFrame) -> DataFrame:
    """The linked exhibitions of a page's special section, and elsewhere lines that name one with a range of days below;
    of equal ones the one with its own page stays."""
    page = F.regexp_replace(F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>", ""), "(?s)<!--.*?-->", "")
    rows = _once(pages, "url", page.alias("html")).where("html <> ''").withColumn("parts", F.split("html", r"(?is)(?=<h[1-6][^>]*>)"))
    titled = F.transform("parts", lambda p: F.coalesce(_compact(text.first_capture(p, r"(?is)^(<h[1-6][^>]*>.*?</h[1-6]>)")).contains(SPECIAL), F.lit(False)))
    rows = _once(rows, "url", "html", "parts", F.array_position(titled, True).cast("int").alias("at"))
    start = F.instr("html", SPECIAL)
    after = F.substr(F.col("html"), start + len(SPECIAL))
    stop = F.least(F.length(after) + 1, *(F.when(F.instr(after, e) > 0, F.instr(after, e)) for e in AFTER_SPECIAL))
    loose = F.when(start > 0, F.concat(F.lit(SPECIAL), F.substr(after, F.lit(1), stop - 1))).otherwise("")
    unheaded = F.when(start > 0, F.concat(F.substr(F.col("html"), F.lit(1), start - 1), F.substr(after, stop))).otherwise(F.col("html"))
    rows = _once(rows, "url", F.when(F.col("at") > 0, F.expr("parts[at - 1]")).otherwise(loose).alias("special"), F.when(F.col("at") > 0, F.array_join(F.filter("parts", lambda p, i: i + 1 != F.col("at")), "")).otherwise(unheaded).alias("others"))
    plain = lambda t: dates.normalize_date_text(text.normalize_space(t), drop_parens=True, commas=True)

    ahead = _parts(F.col("special"), r"""(?is)(?=<a[^>]*href=["'][^"']+["'])(?=(.{1,900}))""")
    linked = rows.select("url", F.posexplode(ahead).alias("n", "w"))
    link = r"""(?is)^<a[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
    name = F.regexp_replace(F.regexp_replace(_compact(text.first_capture(F.col("w"), link, 2)), r"^(特別展)\s*(開催予定|開催中)\s*", "$1 "), r"^(開催予定|開催中)\s*", "")
    dated = F.get(F.filter(F.transform(text.lines_at(F.col("w"), _BREAKS), plain), lambda x: x.rlike(JP_DATE)), 0)
    linked = _once(linked, "url", F.lit(0).alias("kind"), "n", text.first_capture(F.col("w"), link).alias("href"), text.trim_space(name).alias("title"), dated.alias("dated"))
    linked = linked.select("url", "kind", "n", urls.resolve(F.col("href"), F.col("url")).alias("address"), "title", "dated")

    lines = F.transform(text.lines_at(F.col("others"), _BREAKS), plain)
    paired = rows.select("url", lines.alias("l")).select("url", F.posexplode(F.arrays_zip(F.col("l").alias("t"), F.slice("l", 2, 1 << 30).alias("below"))).alias("n", "x")).select("url", "n", "x.*")
    paired = paired.where(extract.is_title_candidate(F.col("t"), SHOWS)).select("url", F.lit(1).alias("kind"), "n", F.col("url").alias("address"), F.col("t").alias("title"), F.col("below").alias("dated"))
    both = _once(linked.unionByName(paired), "url", "address", "title", F.struct("kind", "n").alias("ord"), _date_span(F.col("dated")).alias("span"))
    both = both.where("span is not null and title <> ''").select("*", "span.*")
    kept = dedupe.keep_preferred(both, ["url", "title", "first", "last"], F.coalesce(F.col("address"), "url") == F.col("url"), "ord")
    return _events(kept, source_url=F.coalesce("address", "url"), title=F.col("title"), date_from=F.col("first"), date_to=F.col("last"))
