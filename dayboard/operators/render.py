"""Pages, cards, sitemaps and structured data as string columns and aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import range_label
from ..functions.extract import description
from ..functions.text import escape_html, escape_json_ld, escape_xml
from ..functions.urls import encode_component
from .events import noindex
from .joins import with_counts
from .ordering import positions
from .ranking import ja, neighbours, top_per_group


def event_card(title: Column, label: Column, url: Column) -> Column:
    return F.concat(F.lit('<li class="event-card"><a href="'), escape_html(url), F.lit('"><span class="event-card__title">'), escape_html(title), F.lit('</span><span class="event-card__date">'), escape_html(label), F.lit("</span></a></li>"))


def json_ld_event(name: Column, start: Column, end: Column, status: Column, place: Column) -> Column:
    """schema.org data of an event; what is null is left out."""
    body = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), name.alias("name"), start.alias("startDate"), end.alias("endDate"), status.alias("eventStatus"), F.when(place.isNotNull(), F.struct(F.lit("Place").alias("@type"), place.alias("name"))).alias("location"))
    return escape_json_ld(F.to_json(body))


def sitemap_entries(rows: DataFrame, loc: str, lastmod: str, category: str, ordinal: str | None = None) -> DataFrame:
    """One entry per address, with its last change; of repeated ones the last by ``ordinal``, or the latest without it."""
    last = F.max(lastmod) if ordinal is None else F.max_by(lastmod, ordinal)
    return rows.groupBy(category, loc).agg(last.alias(lastmod))


def sitemap_files(entries: DataFrame, base: str, as_of: dt.date, most: int = 50_000) -> DataFrame:
    """``(file, n_entries, xml)`` of entries ``(category, loc, lastmod)``: url sets of a category by address, with at most
    ``most`` entries each as the protocol wants, and an index of all of them.

    The first set of a category is called by it, further ones have a number too.  No entries give an empty index.
    """
    rows = entries.select("category", F.col("loc"), F.col("lastmod").cast("string").alias("lastmod"))
    rows = positions(rows, ["loc", "lastmod"], ["category"]).withColumn("part", F.floor(F.col("position") / most))
    name = F.concat(F.lit("sitemap-"), F.col("category"), F.when(F.col("part") > 0, F.concat(F.lit("-"), (F.col("part") + 1).cast("string"))).otherwise(""), F.lit(".xml"))

    def document(outer: str, inner: str, items: Column) -> Column:
        lines = F.transform(items, lambda x: F.concat(F.lit(f"  <{inner}>\n    <loc>"), escape_xml(x["loc"]), F.lit("</loc>\n    <lastmod>"), escape_xml(x["lastmod"]), F.lit(f"</lastmod>\n  </{inner}>\n")))
        head = f'<?xml version="1.0" encoding="UTF-8"?>\n<{outer} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
        return F.concat(F.lit(head), F.array_join(lines, ""), F.lit(f"</{outer}>\n"))

    files = rows.groupBy("category", "part").agg(F.array_sort(F.collect_list(F.struct("loc", "lastmod"))).alias("items")).select(name.alias("file"), "items")
    index = rows.select(name.alias("file")).distinct().agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit(base + "/"), "file").alias("loc"), F.lit(as_of.isoformat()).alias("lastmod")))).alias("items"))
    sets = files.select("file", F.size("items").alias("n_entries"), document("urlset", "url", F.col("items")).alias("xml"))
    return sets.unionByName(index.select(F.lit("sitemap.xml").alias("file"), F.size("items").alias("n_entries"), document("sitemapindex", "sitemap", F.col("items")).alias("xml")))


def sitemap_xml(loc: Column, lastmod: Column) -> Column:
    return F.concat(F.lit("<url><loc>"), escape_xml(loc), F.lit("</loc><lastmod>"), lastmod, F.lit("</lastmod></url>"))


def report_line(cells: list[tuple[Column, int]]) -> Column:
    """A line of left-aligned cells; longer ones are not cut."""
    return F.concat_ws("  ", *(F.when(F.length(c) < w, F.rpad(c, w, " ")).otherwise(c) for c, w in cells))


def day_documents(days: DataFrame, as_of: dt.date, all_days: DataFrame | None = None) -> DataFrame:
    """``(day, n_events, noindex, html)``: the page of every day of ``days(day, ord, title, url, date_from)``.

    A page has its day and count as title, links to the days before and after that have events, a card and a block of
    structured data for each event in the order of ``ord``; days outside the index window are not to be indexed.  If
    ``days`` are not all that there are, ``all_days(day)`` has them.
    """
    card = event_card(F.col("title"), F.col("date_from").cast("string"), F.col("url"))
    data = escape_json_ld(F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), F.col("title").alias("name"), F.col("date_from").cast("string").alias("startDate"), F.col("url").alias("url"))))
    shown = F.col("date_from").isNotNull() & (F.coalesce(F.col("title"), F.lit("")) != "")  # what has no date or title has no data
    rows = days.groupBy("day").agg(F.count("*").alias("n_events"), F.array_sort(F.collect_list(F.struct("ord", card.alias("card"), F.when(shown, data).alias("data")))).alias("rows"))
    pages = rows.join(neighbours(rows.select("day") if all_days is None else all_days, "day"), "day").withColumn("noindex", noindex(F.col("day"), F.col("n_events"), as_of))
    link = lambda rel: F.when(F.col(f"{rel}_day").isNotNull(), F.concat(F.lit(f'<a rel="{rel}" href="/date/'), F.col(f"{rel}_day").cast("string"), F.lit('/">'), F.col(f"{rel}_day").cast("string"), F.lit("</a>"))).otherwise("")
    html = F.concat(
        F.lit('<!DOCTYPE html><html lang="ja"><head><title>'), F.col("day").cast("string"), F.lit("のイベント（"), F.col("n_events").cast("string"), F.lit("件）</title>"),
        F.when(F.col("noindex"), F.lit('<meta name="robots" content="noindex">')).otherwise(""),
        F.lit('<script type="application/ld+json">['), F.array_join(F.col("rows.data"), ","), F.lit("]</script></head><body><nav>"), link("prev"), link("next"), F.lit("</nav><ul>"), F.array_join(F.col("rows.card"), ""), F.lit("</ul></body></html>"),
    )
    return pages.select("day", "n_events", "noindex", html.alias("html"))


# Marks on the front page between which the links to days stand.
NAV_START, NAV_END = "<!-- DATE_NAV_START -->", "<!-- DATE_NAV_END -->"


def day_links(days: DataFrame, as_of: dt.date) -> DataFrame:
    """One row ``(html)``: links to today, tomorrow and the days of the coming week that have events, and to all days."""
    offset = F.datediff("day", F.lit(as_of))
    near = days.select("day").distinct().where(offset.between(0, 6))
    key = F.date_format("day", "yyyy-MM-dd")
    link = lambda label: F.concat(F.lit('<a href="date/'), key, F.lit('/">'), label, F.lit("</a>"))
    first = F.when(offset == 0, link(F.lit("今日"))).when(offset == 1, link(F.lit("明日")))
    label = F.concat(F.month("day").cast("string"), F.lit("/"), F.dayofmonth("day").cast("string"))
    rows = near.agg(F.array_sort(F.collect_list(F.struct("day", first.alias("first"), link(label).alias("week")))).alias("d"))  # seven at most
    return rows.select(F.concat(F.lit("<nav>"), F.array_join("d.first", ""), F.array_join("d.week", ""), F.lit('<a href="date/">日付一覧</a></nav>')).alias("html"))


def front_page(page: str, days: DataFrame, as_of: dt.date) -> str | None:
    """The front page with its links to days renewed; null if it has no marks for them."""
    start, end = page.find(NAV_START), page.find(NAV_END)
    if start < 0 or end < start:
        return None
    return page[: start + len(NAV_START)] + "\n" + day_links(days, as_of).first().html + "\n" + page[end:]


def day_data(days: DataFrame, site: str) -> DataFrame:
    """``(day, data)``: structured data of day pages from ``days(day, ord, title, url, date_from, date_to, venue_id,
    venue_name, organizer, performer, price)``: the list of its events, each with its place, organiser and performer as far
    as they are known, and the path of pages that leads to it, as one array of JSON-LD."""
    kind = lambda t: F.lit(t).alias("@type")
    context = F.lit("https://schema.org").alias("@context")
    page = F.concat(F.lit(f"{site}/date/"), F.col("day").cast("string"), F.lit("/"))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    named = lambda c, t: F.when(filled(c).isNotNull(), F.struct(kind(t), F.col(c).alias("name")))
    place = F.when(filled("venue_name").isNotNull(), F.struct(kind("Place"), F.col("venue_name").alias("name"), F.concat(F.lit(f"{site}/spot/"), F.nullif(encode_component(F.col("venue_id")), F.lit("")), F.lit("/")).alias("url")))
    free = F.when(F.col("price").contains("無料") & ~F.col("price").contains("円"), F.lit(True))
    event = F.struct(kind("Event"), filled("title").alias("name"), F.col("date_from").cast("string").alias("startDate"), F.coalesce("date_to", "date_from").cast("string").alias("endDate"), F.coalesce(filled("url"), page).alias("url"), place.alias("location"), named("organizer", "Organization").alias("organizer"), named("performer", "PerformingGroup").alias("performer"), free.alias("isAccessibleForFree"))
    shown = days.where(filled("title").isNotNull() & F.col("date_from").isNotNull())
    rows = shown.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("ord", F.to_json(event).alias("event")))).alias("rows"))
    entries = F.array_join(F.transform("rows", lambda x, i: F.concat(F.lit('{"@type":"ListItem","position":'), (i + 1).cast("string"), F.lit(',"item":'), x["event"], F.lit("}"))), ",")
    listing = F.concat(F.lit('{"@context":"https://schema.org","@type":"ItemList","name":"'), F.col("day").cast("string"), F.lit('のイベント","numberOfItems":'), F.size("rows").cast("string"), F.lit(',"itemListElement":['), entries, F.lit("]}"))
    crumb = lambda n, name, url: F.struct(kind("ListItem"), F.lit(n).alias("position"), name.alias("name"), url.alias("item"))
    path = F.to_json(F.struct(context, kind("BreadcrumbList"), F.array(crumb(1, F.lit("トップ"), F.lit(f"{site}/")), crumb(2, F.lit("日付一覧"), F.lit(f"{site}/date/")), crumb(3, F.col("day").cast("string"), page)).alias("itemListElement")))
    return rows.select("day", escape_json_ld(F.concat(F.lit("["), listing, F.lit(","), path, F.lit("]"))).alias("data"))


def index_page(days: DataFrame, most: int, site: str) -> DataFrame:
    """One row ``(n_days, n_events, html)``: the whole page of all days in order, each with its first titles.

    The document names every day of the publish window once; a section is bounded by ``most`` titles.
    """
    rows = index_sections(days, most).agg(F.count("*").alias("n_days"), F.sum("n_events").alias("n_events"), F.array_sort(F.collect_list(F.struct("day", "section"))).alias("s"))
    head = F.concat(F.lit(f'<!DOCTYPE html><html lang="ja"><head><title>日付別イベント一覧</title><link rel="canonical" href="{site}/date/"></head><body><h1>日付別イベント一覧</h1><p>'), F.col("n_days").cast("string"), F.lit("日・"), F.coalesce("n_events", F.lit(0)).cast("string"), F.lit("件</p>"))
    return rows.select("n_days", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.concat(head, F.array_join("s.section", ""), F.lit("</body></html>")).alias("html"))


def name_pages(venues: DataFrame, key: str, name: str) -> DataFrame:
    """``(initial, n_venues, html)``: a page of the venues with each first letter, in Japanese order."""
    rows = venues.withColumn("initial", F.upper(F.left(F.trim(F.col(name)), F.lit(1)))).where("initial <> ''").groupBy("initial")
    rows = rows.agg(F.count("*").alias("n_venues"), F.array_sort(F.collect_list(F.struct(ja(name).alias("place"), F.col(key).cast("string").alias("key"), F.col(name).alias("name")))).alias("v"))
    items = F.array_join(F.transform("v", lambda x: F.concat(F.lit('<li><a href="/spot/'), encode_component(x["key"]), F.lit('/">'), escape_html(x["name"]), F.lit("</a></li>"))), "")
    return rows.select("initial", "n_venues", F.concat(F.lit("<h1>"), escape_html(F.col("initial")), F.lit("</h1><ul>"), items, F.lit("</ul>")).alias("html"))


def index_sections(days: DataFrame, most: int) -> DataFrame:
    """``(day, n_events, section)``: for every day its first titles in the order of ``ord``, and how many more there are."""
    day = F.col("day").cast("string")
    top = top_per_group(days, ["day"], [F.asc("ord")], most).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("position", "title"))).alias("top"))
    rows = days.groupBy("day").agg(F.count("*").alias("n_events")).join(top, "day")
    items = F.array_join(F.transform("top.title", lambda t: F.concat(F.lit("<li>"), escape_html(t), F.lit("</li>"))), "")
    more = F.when(F.col("n_events") > most, F.concat(F.lit("<p>ほか"), (F.col("n_events") - most).cast("string"), F.lit("件</p>"))).otherwise("")
    return rows.select("day", "n_events", F.concat(F.lit('<section><h2><a href="/date/'), day, F.lit('/">'), day, F.lit("</a></h2><ul>"), items, F.lit("</ul>"), more, F.lit("</section>")).alias("section"))


def venue_pages(venues: DataFrame, events: DataFrame, key: str, name: str, region: str) -> DataFrame:
    """``(region, n_venues, n_events, html)``: a page of each region with its venues in Japanese order and their counts."""
    counted = with_counts(venues.select(key, name, region), events.select(key), key)
    rows = counted.groupBy(region).agg(F.count("*").alias("n_venues"), F.sum("n_events").alias("n_events"), F.array_sort(F.collect_list(F.struct(ja(name).alias("place"), F.col(key), F.col("n_events").alias("n"), F.col(name).alias("name")))).alias("v"))
    items = F.array_join(F.transform("v", lambda x: F.concat(F.lit("<li>"), escape_html(x["name"]), F.lit("（"), x["n"].cast("string"), F.lit("件）</li>"))), "")
    return rows.select(region, "n_venues", "n_events", F.concat(F.lit("<h1>"), escape_html(F.coalesce(F.col(region), F.lit("その他"))), F.lit("</h1><ul>"), items, F.lit("</ul>")).alias("html"))


def spot_pages(spots: DataFrame, events: DataFrame, site: str, most: int = 10) -> DataFrame:
    """``(spot_id, n_events, html)``: the page of every spot ``(spot_id, name, category, prefecture, municipality,
    description)`` with its first ``most`` events ``(spot_id, ord, title, url, date_from, date_to)`` by day and ``ord``.

    Structured data holds the spot as a place, the list of its events and each event that has a day and a title.  A
    spot without events has a page that says so.
    """
    day = lambda c: F.col(c).cast("string")
    first = top_per_group(events, ["spot_id"], [F.col("date_from").asc_nulls_first(), F.asc("ord")], most)
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("イベント名未定"))
    shown = F.struct("position", title.alias("title"), F.col("title").alias("name"), F.col("url"), day("date_from").alias("start"), F.coalesce(day("date_to"), day("date_from")).alias("end"), F.coalesce(range_label(F.col("date_from"), F.col("date_to")), F.lit("日程未定")).alias("label"))
    listed = first.groupBy("spot_id").agg(F.array_sort(F.collect_list(shown)).alias("e"))
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("施設詳細"))
    page = F.concat(F.lit(site + "/spot/"), encode_component(F.col("spot_id").cast("string")), F.lit("/"))
    rows = spots.join(listed, "spot_id", "left").withColumn("e", F.coalesce("e", F.array().cast(listed.schema["e"].dataType)))
    about = description(F.col("description"), name, prefecture=F.col("prefecture"), municipality=F.col("municipality"), category=F.col("category"))
    rows = rows.select("spot_id", "e", F.size("e").alias("n_events"), name.alias("name"), page.alias("page"), about.alias("about"), F.col("prefecture").alias("region"), F.col("municipality").alias("town"))
    kind = lambda k: F.lit(k).alias("@type")
    context = F.lit("https://schema.org").alias("@context")
    address = F.struct(kind("PostalAddress"), F.coalesce("region", F.lit("")).alias("addressRegion"), F.coalesce("town", F.lit("")).alias("addressLocality")).alias("address")
    place = F.to_json(F.struct(context, kind("Place"), F.col("name"), F.col("page").alias("url"), F.col("about").alias("description"), address))
    entry = F.transform("e", lambda x: F.struct(kind("ListItem"), x["position"].alias("position"), x["title"].alias("name"), F.coalesce(x["url"], F.col("page")).alias("url")))
    listing = F.to_json(F.struct(context, kind("ItemList"), F.concat("name", F.lit("の開催予定イベント")).alias("name"), F.col("n_events").alias("numberOfItems"), entry.alias("itemListElement")))
    dated = F.filter("e", lambda x: x["start"].isNotNull() & (F.coalesce(x["name"], F.lit("")) != ""))
    each = F.transform(dated, lambda x: F.to_json(F.struct(context, kind("Event"), x["name"].alias("name"), x["start"].alias("startDate"), x["end"].alias("endDate"), F.struct(kind("Place"), F.col("name"), address).alias("location"), F.coalesce(x["url"], F.col("page")).alias("url"), F.lit("https://schema.org/EventScheduled").alias("eventStatus"))))
    data = F.array_join(F.concat(F.array(place), F.when(F.col("n_events") > 0, F.array(listing)).otherwise(F.array().cast("array<string>")), each), ",")
    card = F.transform("e", lambda x: F.concat(F.lit("<li><p>"), escape_html(x["label"]), F.lit("</p><h4>"), escape_html(x["title"]), F.lit("</h4>"), F.coalesce(F.concat(F.lit('<a href="'), escape_html(x["url"]), F.lit('">'), escape_html(x["title"]), F.lit("</a>")), F.lit("")), F.lit("</li>")))
    body = F.when(F.col("n_events") > 0, F.concat(F.lit("<ul>"), F.array_join(card, ""), F.lit("</ul>"))).otherwise("<p>現在公開中のイベント情報はありません。</p>")
    html = F.concat(
        F.lit('<!DOCTYPE html><html lang="ja"><head><title>'), escape_html(F.col("name")), F.lit("のイベント情報（"), F.col("n_events").cast("string"), F.lit('件）</title><meta name="description" content="'), escape_html(F.col("about")),
        F.lit('"><link rel="canonical" href="'), escape_html(F.col("page")), F.lit('"><script type="application/ld+json">['), escape_json_ld(data), F.lit("]</script></head><body><h1>"), escape_html(F.col("name")), F.lit("</h1>"), body, F.lit("</body></html>"),
    )
    return rows.select("spot_id", "n_events", html.alias("html"))
