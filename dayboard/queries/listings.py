"""Predicates, dates, addresses, tags and references of listings, over the whole driver tables."""

from __future__ import annotations

from ..functions import dates, extract, tags, text, urls, values
from ..operators import events as ev
from ..operators import ordering, render, rules, stats
from ..plans import listing, venues
from ..schema import RAW_EVENT
from ..sources import dom
from .base import AS_OF, F, order_events, table

LABELS = {"sports": "スポーツ", "exhibition": "展覧会", "performance": "公演"}


def common_path(spark, sf):
    """Documents of orders by customer through the whole listing pipeline; all events of a customer have one address."""
    o, k = order_events(spark, sf), F.col("o_orderkey")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    named = {"title": F.concat(F.lit("第"), k.cast("string"), F.when(k % 2 == 0, F.lit("回音楽ライブ")).otherwise(F.lit("回"))), "date_from": F.when(k % 11 > 0, day("date_from")), "date_to": F.when(k % 3 > 0, day("date_to")), "source_url": F.concat(F.lit("https://v.jp/"), F.col("o_custkey").cast("string"))}
    event = F.struct(*[named.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in RAW_EVENT.fields])
    docs = o.groupBy(F.col("o_custkey").cast("string").alias("venue_id")).agg(F.collect_list(event).alias("events"))
    docs = docs.select("venue_id", *[F.lit(None).cast("string").alias(c) for c in ("venue_name", "venue_category", "last_success_at")], "events", F.concat("venue_id", F.lit(".json")).alias("file_name"))
    silver = listing.silver_events(docs, as_of=AS_OF)
    days = listing.gold_days(silver, as_of=AS_OF).withColumn("music", (F.col("tags.type") == "performance").cast("int"))
    return listing.day_pages(days, as_of=AS_OF).join(days.groupBy("day").agg(F.sum("music").alias("n_music")), "day").select("day", "n_events", "n_music", "prev_day", "next_day", "noindex")


def _urls(spark, sf):
    n = F.col("page_id").cast("string")
    kinds = [F.concat(F.lit("https://a.jp/event/event-"), n), F.concat(F.lit("https://b.jp/07event"), n, F.lit(".html")), F.lit("https://b.jp/07event/index.html"), F.concat(F.lit("https://c.jp/exhibition/"), n), F.concat(F.lit("https://d.jp/event/"), n), F.concat(F.lit("https://d.jp/event/"), n, F.lit("/feed/"))]
    return table(spark, sf, "pages").select("page_id", F.get(F.array(*kinds), (F.col("page_id") % 6).cast("int")).alias("u"))


def detail_urls(spark, sf):
    return _urls(spark, sf).select("page_id", *[urls.is_detail(F.col("u"), k).alias(k) for k in urls.DETAIL_PATHS])


def month_urls(spark, sf):
    o = order_events(spark, sf)
    m = F.month("date_from").cast("string")
    u = F.concat(F.lit("http://old.example/event/"), F.year("date_from").cast("string"), F.lit("/"), m, F.when(F.col("o_orderkey") % 3 == 0, F.lit("/x")).otherwise(F.lit("")))
    return o.select("o_orderkey", urls.month_url(u, "new.example").alias("u"), urls.month_of(F.concat(u, F.lit("/"))).getField("month").alias("month"))


def resolved_urls(spark, sf):
    n = F.col("page_id").cast("string")
    u = F.get(F.array(F.concat(F.lit("https://x.jp/"), n), F.concat(F.lit("//y.jp/"), n), F.concat(F.lit("/root/"), n), F.concat(F.lit("rel/"), n), F.concat(F.lit("../up/"), n)), (F.col("page_id") % 5).cast("int"))
    return table(spark, sf, "pages").select("page_id", urls.resolve(u, F.lit("https://z.jp/a/b/c.html")).alias("full"), urls.prefix_join(u, "https://z.jp/").alias("joined"))


def map_links(spark, sf):
    c = table(spark, sf, "customer")
    lat = F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey").cast("int"))
    lng = F.when(F.col("c_custkey") % 4 > 0, F.lit(134))
    return c.select("c_custkey", urls.maps_link(lat, lng, F.concat("c_name", F.lit(" (x)"))).alias("link"), ev.has_place(lat, lng).alias("placed"))


def open_window(spark, sf):
    return order_events(spark, sf).where(ev.within_days(F.col("date_from"), AS_OF)).select("o_orderkey", "date_from")


def required_fields(spark, sf):
    o = order_events(spark, sf).select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit(" t"), F.col("o_orderkey").cast("string"))).otherwise(F.lit(" 　")).alias("title"), F.when(F.col("o_orderkey") % 5 > 0, F.col("date_from")).alias("date_from"))
    return ev.with_required(o, "title", "date_from").select("o_orderkey")


def body_rules(spark, sf):
    k = F.col("o_orderkey")
    price, contact = F.when(k % 3 == 0, "無料"), F.when(k % 4 == 0, " ").when(k % 4 == 1, "TEL")
    title, place = ev.page_event(F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("x")), price)
    return order_events(spark, sf).select("o_orderkey", ev.has_details(price, contact).alias("details"), ev.needs_body(price, contact).alias("body"), title.alias("title"), place.alias("price"))


def title_candidates(spark, sf):
    t = F.get(F.array(F.lit("特別展"), F.lit("特別展 海"), F.lit("常設"), F.lit("海の 企画展"), F.lit(None).cast("string")), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf, "part").groupBy(extract.is_title_candidate(t, ["特別展", "企画展"]).alias("candidate")).agg(F.count("*").alias("n"))


def written_dates(spark, sf):
    """Dates of a text in several forms, and what they become."""
    d = F.col("date_from")
    y, m, day = (f(d).cast("string") for f in (F.year, F.month, F.dayofmonth))
    full = F.concat(y, F.lit("年"), m, F.lit("月"), day, F.lit("日"))
    slashed, dotted, short = F.concat_ws("/", y, m, day), F.concat_ws(".", y, m, day), F.concat(m, F.lit("月"), day, F.lit("日"))
    mixed = F.concat(F.lit("受付 "), short, F.lit(" 開催 "), F.when(F.col("o_orderkey") % 2 == 0, slashed).otherwise(dotted))
    return order_events(spark, sf).select(
        "o_orderkey",
        F.array_join(dates.date_parts(mixed), ",").alias("parts"),
        dates.single_date(mixed).alias("single"),
        dates.this_year(short, AS_OF).alias("in_year"),
        dates.compact_date(F.concat(F.lit("e?d="), F.date_format(d, "yyyyMMdd"))).alias("compact"),
        extract.inverted_to_single(d, F.date_sub(d, 2)).alias("not_inverted"),
        dates.normalize_date_text(F.concat(full, F.lit("（月）から　"), short), drop_parens=True, range_words=True).alias("normal"),
    )


def listed_ranges(spark, sf):
    """A year's date and a later month and day, or two years' dates."""
    a, b = F.col("date_from"), F.col("date_to")
    sign = lambda d, with_year: F.date_format(d, "yyyy年M月d日" if with_year else "M月d日")
    t = F.concat(sign(a, True), F.lit("〜"), F.when(F.col("o_orderkey") % 2 == 0, sign(b, True)).otherwise(sign(b, False)))
    r = extract.implied_end_range_of_list(t)
    days = F.concat(F.dayofmonth(a).cast("string"), F.lit("(火)～28(木)"))
    in_month = dates.day_range_in_month(days, F.year(a).cast("string"), F.month(a).cast("string"))
    return order_events(spark, sf).select("o_orderkey", r.date_from.alias("first"), r.date_to.alias("last"), in_month.date_from.alias("page_first"), in_month.date_to.alias("page_last"))


def small_texts(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    html = F.concat(F.lit(" ・<b>"), F.col("p_name"), F.lit("</b> &amp; "), F.col("p_brand"))
    prefecture = F.get(F.array(F.lit("香川県"), F.lit("愛媛県"), F.lit("東京都")), (k % 3).cast("int"))
    return p.select(
        "p_partkey",
        text.strip_tags_compact(html).alias("compact"),
        text.normalize_decoded(F.when(k % 4 > 0, html)).alias("decoded"),
        text.heading_title(F.concat(F.lit("― ："), F.col("p_name"))).alias("heading"),
        values.tail(F.col("p_type"), 3).alias("tail"),
        values.prefecture_slug(prefecture).alias("slug"),
        values.seconds(k * 150).alias("s"),
        text.plain_newlines(F.concat(F.lit("a\r\nb\t　c"), F.lit(" "), F.col("p_brand"))).alias("plain"),
    )


def tag_policy(spark, sf):
    """Tags without and with overwriting, their labels, and keys that have none."""
    k = F.col("o_orderkey")
    old = F.struct(F.when(k % 3 == 0, F.lit(" ")).when(k % 3 == 1, F.lit("sports")).alias("type"))
    new = F.struct(F.lit("performance").alias("type"))
    keys = F.array(tags.unless_tagged(old, new, overwrite=False)["type"], F.when(k % 2 == 0, "sports").otherwise("zoo"))
    return order_events(spark, sf).select("o_orderkey", tags.unless_tagged(old, new, overwrite=True)["type"].alias("over"), F.array_join(tags.labels_of(keys, LABELS), ",").alias("labels"), F.array_join(tags.unlabelled(keys, LABELS), ",").alias("unlabelled"))


def missing_references(spark, sf):
    p = table(spark, sf, "pages")
    n = F.col("page_id")
    t = F.concat(F.lit("see `a/"), n.cast("string"), F.lit(".js` and `a/"), (n + 1).cast("string"), F.lit(".js`, `a/"), n.cast("string"), F.lit(".js` but not `x y`"))
    files = p.select(F.concat(F.lit("a/"), n.cast("string"), F.lit(".js")).alias("path"))
    return stats.missing_references(p.select("page_id", t.alias("text")), "page_id", "text", files, "path")


def column_widths(spark, sf):
    return stats.column_widths(table(spark, sf, "part"), ["p_partkey", "p_name", "p_brand"])


def venue_lists(spark, sf):
    """Distinct venues of each day as one text, in order of first appearance."""
    o = order_events(spark, sf).groupBy("date_from").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("v"))
    return o.select("date_from", F.array_join(F.array_distinct(F.col("v.o_orderpriority")), "・").alias("venues"))


def sorted_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url").orderBy("url", "page_id")


def day_documents(spark, sf):
    """Whole pages of the days with events: title, neighbours, cards, structured data."""
    o = order_events(spark, sf).select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("E<"), F.col("o_orderkey").cast("string")).alias("title"), F.concat(F.lit("/e/"), F.col("o_orderkey").cast("string")).alias("url"), "date_from", F.col("date_from").alias("day"))
    return render.day_documents(o, AS_OF).select("day", "n_events", "noindex", F.md5("html").alias("digest"))


def index_document(spark, sf):
    """One page that lists each day with its first three events."""
    o = order_events(spark, sf).select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("title"), F.col("date_from").alias("day"))
    return render.index_sections(o, 3).select("day", "n_events", "section")


def venue_pages(spark, sf):
    """A page of each nation's suppliers with their numbers of line items."""
    venues = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    facts = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"))
    return render.venue_pages(venues, facts, "s_suppkey", "s_name", "n_name")


def spot_pages(spark, sf):
    """A page of each customer as a spot, with the first of their orders as events."""
    c, k = table(spark, sf, "customer"), F.col("o_orderkey")
    spots = c.select(F.col("c_custkey").alias("spot_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), F.lit("香川県").alias("prefecture"), F.lit(None).cast("string").alias("municipality"), F.lit(None).cast("string").alias("description"))
    o = order_events(spark, sf).select(F.col("o_custkey").alias("spot_id"), k.alias("ord"), F.when(k % 7 > 0, F.concat(F.lit("T<"), k.cast("string"))).alias("title"), F.when(k % 2 == 0, F.concat(F.lit("https://v.jp/?a&b="), k.cast("string"))).alias("url"), "date_from", "date_to")
    return render.spot_pages(spots, o, "https://v.jp")


def _pages_of_orders(spark, sf, before, item, after=""):
    """A page for each customer, with an item for each order."""
    o = order_events(spark, sf).groupBy(F.col("o_custkey").cast("string").alias("c")).agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"))
    return o.select(F.concat(F.lit("https://v.jp/"), F.col("c"), F.lit("/")).alias("url"), F.concat(F.lit(before), F.col("items"), F.lit(after)).alias("html"))


def listed_events(spark, sf):
    k = F.col("o_orderkey").cast("string")
    item = F.concat(F.lit("<p><a class=x href='"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/e/"), k)).otherwise(F.concat(F.lit("e/"), k)), F.lit("'>Event <b>"), k, F.lit("</b> "), F.when(F.col("o_orderkey") % 3 > 0, F.date_format("date_from", "yyyy年M月d日")).otherwise(F.lit("未定")), F.lit("</a></p>"))
    return venues.listing(_pages_of_orders(spark, sf, "<body>", item), AS_OF).select("source_url", "title", "date_from", "date_to")


def card_events(spark, sf):
    k = F.col("o_orderkey").cast("string")
    item = F.concat(F.lit('<div class="event-wrap"><a href="/e/'), k, F.lit('"></a><p class="event-name">A &amp; '), k, F.lit("</p><p>"), F.date_format("date_from", "yyyy/M/d"), F.lit('</p><p class="event-time">9:30開場 10:00～12:00</p><div class="event-info1">'), F.when(F.col("o_orderkey") % 2 == 0, "無料").otherwise("500円"), F.lit('</div><div class="event-info2"></div></div>'))
    return venues.cards(_pages_of_orders(spark, sf, "", item), AS_OF).select("source_url", "title", "date_from", "open_time", "start_time", "end_time", "price")


def box_events(spark, sf):
    k = F.col("o_orderkey").cast("string")
    item = F.concat(F.lit('<div class="box"><div class="mid">B '), k, F.lit("</div><dl><dt>開催日</dt><dd>"), F.date_format("date_from", "yyyy年M月d日"), F.lit("～"), F.date_format("date_to", "yyyy年M月d日"), F.lit("</dd><dt>営業時間</dt><dd>10：30</dd></dl></div>"))
    return venues.boxes(_pages_of_orders(spark, sf, "", item), AS_OF).select("source_url", "title", "date_from", "date_to", "start_time")


def _cells(spark, sf):
    """Calendars of orders by customer: rows and cells that nothing closes, a table inside every second cell."""
    k = F.col("o_orderkey").cast("string")
    inner = F.when(F.col("o_orderkey") % 2 == 0, F.lit("<table><tr><td>x</table>")).otherwise("")
    item = F.concat(F.lit('<tr><td><div class="daily"><a href="/d/'), F.date_format("date_from", "yyyyMMdd"), F.lit('/">1</a></div>'), inner, F.lit('<p>a<div class="big event"><a href=/e/'), k, F.lit(">E &lt; "), k, F.lit("</a></div>"))
    return _pages_of_orders(spark, sf, "<!-- <td> --><body><table class=m>", item)


def dom_cells(spark, sf):
    """Each event's cell, innermost table and next element of its kind, by the places of elements on the page."""
    kinds = {"event": (None, "event"), "cell": ("td",), "table": ("table",), "daily": ("div", "daily"), "day": ("a", None, None, "daily"), "p": ("p",), "div": ("div",)}

    def columns(e, at):
        days = F.transform(at(e["cell"])["days"], lambda i: at(i)["href"])
        return {c: e[c] for c in ("node", "last", "depth", "nth", "text")} | {"cell": at(e["cell"])["node"], "table_node": at(e["table"])["node"], "days": days, "befores": F.transform(e["follows_of"], lambda i: at(i)["text"])}

    rows = dom.chosen(_cells(spark, sf), kinds, "event", columns, texts=("event", "p"), up={"cell": ("event", "cell"), "table": ("event", "table")}, own={"days": ("cell", "day")}, after={"follows": ("p", "div")})
    rows = rows.withColumn("day", F.explode("days")).withColumn("before", F.explode("befores"))
    return rows.select("url", "node", "last", "depth", "nth", "cell", "table_node", "text", "day", "before")


def calendar_events(spark, sf):
    """Events of calendars; the pages of every third order's event landed."""
    o, k = order_events(spark, sf), F.col("o_orderkey").cast("string")
    details = o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("https://v.jp/e/"), k).alias("url"), F.concat(F.lit("<table><tr><th>日時</th><td>開場17:30 開演18:00</td></tr><tr><th>開催場所</th><td>H"), k, F.lit("</td></tr></table>")).alias("html"))
    return venues.calendar(_cells(spark, sf), details).select("source_url", "title", "date_from", "start_time", "body")


def rule_table_hits(spark, sf):
    """Rules from tables: the first letters of nations as words for their region, and a pattern for each region."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    words = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("ord"), F.col("r_name").alias("key"), F.lit("text").alias("kind"), F.lower(F.left("n_name", F.lit(2))).alias("value"))
    patterns = r.select((F.col("r_regionkey") + 100).cast("long").alias("ord"), F.col("r_name").alias("key"), F.lit("pattern").alias("kind"), F.concat(F.lit("^"), F.lower(F.left("r_name", F.lit(1))), F.lit("[a-m]+ ")).alias("value"))
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("name"))
    hits = rules.rule_hits(p, "name", words.unionByName(patterns))
    return hits.select("p_partkey", F.array_join("hits", ",").alias("hits"), rules.first_key(F.col("hits")).alias("first"), F.array_join(rules.first_keys(F.col("hits")), ",").alias("two"))


def late_page(spark, sf):
    """The fortieth page of 500 line items by day, and each day's place among the days of its month."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))  # noqa: E741
    rows = ordering.page_at(l, ["day", "l_orderkey", "l_linenumber"], 19_500, 500)
    days = ordering.positions(l.select("day", F.date_format("day", "yyyy-MM").alias("month")).distinct(), ["day"], ["month"], position="place")
    return rows.join(days, "day").select("l_orderkey", "l_linenumber", "day", "position", "place")


QUERIES = {f.__name__: f for f in (common_path, rule_table_hits, late_page, dom_cells, calendar_events, listed_events, card_events, box_events, venue_pages, spot_pages, detail_urls, month_urls, resolved_urls, map_links, open_window, required_fields, body_rules, title_candidates, written_dates, listed_ranges, small_texts, tag_policy, missing_references, column_widths, venue_lists, sorted_paths, day_documents, index_document)}

_EV = "WITH ev AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 30)::INT AS b, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)"
_CARD = """concat('<li class="event-card"><a href="/e/', o_orderkey, '"><span class="event-card__title">E&lt;', o_orderkey, '</span><span class="event-card__date">', a, '</span></a></li>')"""
_LD = """concat('{"@context":"https://schema.org","@type":"Event","name":"E\\u003c', o_orderkey, '","startDate":"', a, '","url":"/e/', o_orderkey, '"}')"""
SQL = {
    "rule_table_hits": """WITH rules AS (SELECT n_nationkey AS ord, r_name AS key, lower(left(n_name, 2)) AS word, NULL AS pattern FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey + 100, r_name, NULL, concat('^', lower(left(r_name, 1)), '[a-m]+ ') FROM region),
      place AS (SELECT key, min(ord) AS place FROM rules GROUP BY 1),
      h AS (SELECT DISTINCT p_partkey, key, place FROM part JOIN rules ON contains(lower(p_name), word) OR regexp_matches(lower(p_name), pattern) JOIN place USING (key)),
      g AS (SELECT p_partkey, list(key ORDER BY place) AS hits FROM h GROUP BY 1)
      SELECT p_partkey, coalesce(array_to_string(hits, ','), '') AS hits, coalesce(hits[1], 'other') AS first, coalesce(array_to_string(hits[1:2], ','), '') AS two FROM part LEFT JOIN g USING (p_partkey)""",
    "late_page": "WITH l AS (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day, row_number() OVER (ORDER BY l_shipdate::DATE, l_orderkey, l_linenumber) - 1 AS position FROM lineitem), d AS (SELECT day, row_number() OVER (PARTITION BY strftime(day, '%Y-%m') ORDER BY day) - 1 AS place FROM (SELECT DISTINCT day FROM l)) SELECT l_orderkey, l_linenumber, day, position, place FROM l JOIN d USING (day) WHERE position BETWEEN 19500 AND 19999",
    "dom_cells": _EV + """, i AS (SELECT *, concat('<tr><td><div class="daily"><a href="/d/', strftime(a, '%Y%m%d'), '/">1</a></div>', CASE WHEN o_orderkey % 2 = 0 THEN '<table><tr><td>x</table>' ELSE '' END, '<p>a<div class="big event"><a href=/e/', o_orderkey, '>E &lt; ', o_orderkey, '</a></div>') AS item, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END AS more FROM ev),
      p AS (SELECT *, 2 + coalesce(sum(7 + more) OVER (PARTITION BY o_custkey ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tr FROM i)
      SELECT concat('https://v.jp/', o_custkey, '/') AS url, (tr + 5 + more)::INT AS node, (tr + 6 + more)::INT AS last, 4 AS depth, CASE WHEN more > 0 THEN 3 ELSE 2 END AS nth, (tr + 1)::INT AS cell, 1 AS table_node, concat('E < ', o_orderkey) AS text, concat('/d/', strftime(a, '%Y%m%d'), '/') AS day, 'a' AS before FROM p""",
    "calendar_events": _EV + " SELECT concat('https://v.jp/e/', o_orderkey) AS source_url, concat('E < ', o_orderkey) AS title, a::VARCHAR AS date_from, CASE WHEN o_orderkey % 3 = 0 THEN '18:00' END AS start_time, CASE WHEN o_orderkey % 3 = 0 THEN concat('会場: H', o_orderkey) END AS body FROM ev",
    "common_path": _EV + """, kept AS (SELECT o_orderkey AS k, a, CASE WHEN o_orderkey % 3 > 0 THEN b ELSE a END AS b FROM ev WHERE o_orderkey % 11 > 0 OR o_orderkey % 3 > 0),
      e AS (SELECT * FROM kept WHERE b >= DATE '1997-06-15' AND k % 11 > 0), d AS (SELECT k, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM e),
      g AS (SELECT day, count(*) AS n_events, sum((k % 2 = 0)::INT)::BIGINT AS n_music FROM d WHERE day BETWEEN DATE '1997-06-15' AND DATE '1999-06-15' GROUP BY 1)
      SELECT day, n_events, n_music, lag(day) OVER (ORDER BY day) AS prev_day, lead(day) OVER (ORDER BY day) AS next_day, day < DATE '1998-06-15' OR day > DATE '1998-10-13' AS noindex FROM g""",
    "listed_events": _EV + " SELECT CASE WHEN o_orderkey % 2 = 0 THEN concat('https://v.jp/e/', o_orderkey) ELSE concat('https://v.jp/', o_custkey, '/e/', o_orderkey) END AS source_url, concat('Event ', o_orderkey, ' ', y, '年', m, '月', d, '日') AS title, a::VARCHAR AS date_from, a::VARCHAR AS date_to FROM ev WHERE o_orderkey % 3 > 0",
    "card_events": _EV + " SELECT concat('https://v.jp/e/', o_orderkey) AS source_url, concat('A & ', o_orderkey) AS title, a::VARCHAR AS date_from, '9:30' AS open_time, '10:00' AS start_time, '12:00' AS end_time, CASE WHEN o_orderkey % 2 = 0 THEN '無料' ELSE '500円' END AS price FROM ev",
    "box_events": _EV + " SELECT concat('https://v.jp/', o_custkey, '/') AS source_url, concat('B ', o_orderkey) AS title, a::VARCHAR AS date_from, b::VARCHAR AS date_to, '10:30' AS start_time FROM ev",
    "spot_pages": r"""WITH o AS (SELECT *, o_custkey AS c, o_orderkey AS k, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 30)::INT AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS n FROM orders),
      s AS (SELECT c_custkey AS c, c_name AS name, concat('https://v.jp/spot/', c_custkey, '/') AS page, concat('香川県にある', c_mktsegment, 'の', c_name, 'の施設詳細ページです。開催予定のイベントやアクセス情報を確認できます。') AS t FROM customer),
      q AS (SELECT *, concat(t, ' 公式サイトや開催予定イベント、アクセス情報への導線をこのページでまとめて確認できます。') AS about, '"address":{"@type":"PostalAddress","addressRegion":"香川県","addressLocality":""}' AS adr FROM s),
      e AS (SELECT q.*, n, CASE WHEN k % 7 > 0 THEN concat('T<', k) END AS own, CASE WHEN k % 7 > 0 THEN concat('T<', k) ELSE 'イベント名未定' END AS title, CASE WHEN k % 2 = 0 THEN concat('https://v.jp/?a&b=', k) END AS url, a, b FROM o JOIN q USING (c) WHERE n <= 10),
      g AS (SELECT c, count(*) AS m, string_agg(concat('{"@type":"ListItem","position":', n, ',"name":"', title, '","url":"', coalesce(url, page), '"}'), ',' ORDER BY n) AS items,
        string_agg(concat(',{"@context":"https://schema.org","@type":"Event","name":"', own, '","startDate":"', a, '","endDate":"', b, '","location":{"@type":"Place","name":"', name, '",', adr, '},"url":"', coalesce(url, page), '","eventStatus":"https://schema.org/EventScheduled"}'), '' ORDER BY n) FILTER (WHERE own IS NOT NULL) AS each,
        string_agg(concat('<li><p>', a, CASE WHEN a < b THEN concat('〜', b) END, '</p><h4>', replace(title, '<', '&lt;'), '</h4>', CASE WHEN url IS NOT NULL THEN concat('<a href="', replace(url, '&', '&amp;'), '">', replace(title, '<', '&lt;'), '</a>') END, '</li>'), '' ORDER BY n) AS cards FROM e GROUP BY c)
      SELECT q.c AS spot_id, coalesce(m, 0)::INT AS n_events, concat('<!DOCTYPE html><html lang="ja"><head><title>', name, 'のイベント情報（', coalesce(m, 0), '件）</title><meta name="description" content="', about, '"><link rel="canonical" href="', page, '"><script type="application/ld+json">[',
        replace(concat('{"@context":"https://schema.org","@type":"Place","name":"', name, '","url":"', page, '","description":"', about, '",', adr, '}', CASE WHEN m > 0 THEN concat(',{"@context":"https://schema.org","@type":"ItemList","name":"', name, 'の開催予定イベント","numberOfItems":', m, ',"itemListElement":[', items, ']}') END, each), '<', '\u003c'),
        ']</script></head><body><h1>', name, '</h1>', CASE WHEN m > 0 THEN concat('<ul>', cards, '</ul>') ELSE '<p>現在公開中のイベント情報はありません。</p>' END, '</body></html>') AS html FROM q LEFT JOIN g USING (c)""",
    "venue_pages": "WITH c AS (SELECT s_suppkey, s_name, n_name, count(l_suppkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2, 3) SELECT n_name, count(*) AS n_venues, sum(n)::BIGINT AS n_events, concat('<h1>', n_name, '</h1><ul>', string_agg(concat('<li>', s_name, '（', n, '件）</li>'), '' ORDER BY lower(s_name), s_suppkey), '</ul>') AS html FROM c GROUP BY 1",
    "detail_urls": "SELECT page_id, page_id % 6 = 0 AS named, page_id % 6 = 1 AS folder, page_id % 6 = 3 AS museum, page_id % 6 = 4 AS numbered FROM pages",
    "month_urls": _EV + " SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN concat('https://new.example/', y, '/', lpad(m::VARCHAR, 2, '0'), '/') END AS u, m::INT AS month FROM ev",
    "resolved_urls": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('https://x.jp/', page_id) WHEN 1 THEN concat('https://y.jp/', page_id) WHEN 2 THEN concat('https://z.jp/root/', page_id) WHEN 3 THEN concat('https://z.jp/a/b/rel/', page_id) ELSE concat('https://z.jp/a/up/', page_id) END AS full, concat(CASE WHEN page_id % 5 > 0 THEN 'https://z.jp/' END, CASE page_id % 5 WHEN 0 THEN 'https://x.jp/' WHEN 1 THEN '//y.jp/' WHEN 2 THEN '/root/' WHEN 3 THEN 'rel/' ELSE '../up/' END, page_id) AS joined FROM pages",
    "map_links": "SELECT c_custkey, 'https://www.google.com/maps/search/?api=1&query=' || CASE WHEN c_custkey % 3 > 0 AND c_custkey % 4 > 0 THEN concat(c_nationkey, ',134') ELSE concat(replace(c_name, '#', '%23'), '%20(x)') END AS link, c_custkey % 3 > 0 AND c_custkey % 4 > 0 AND c_nationkey <> 0 AS placed FROM customer",
    "open_window": _EV + " SELECT o_orderkey, a AS date_from FROM ev WHERE a > DATE '1997-06-15' AND a <= DATE '1999-06-15'",
    "required_fields": "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey % 5 > 0",
    "body_rules": "SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey % 4 = 1 AS details, NOT (o_orderkey % 3 = 0 OR o_orderkey % 4 = 1) AS body, CASE WHEN o_orderkey % 2 = 0 THEN 'イベント名未定' ELSE 'x' END AS title, CASE WHEN o_orderkey % 3 = 0 THEN '無料' ELSE '' END AS price FROM orders",
    "title_candidates": "SELECT p_partkey % 5 IN (1, 3) AS candidate, count(*) AS n FROM part GROUP BY 1",
    "written_dates": _EV + " SELECT o_orderkey, concat(y, '-', m, '-', d, ',', m, '-', d) AS parts, a AS single, CASE WHEN NOT (m = 2 AND d = 29) THEN make_date(1998, m, d) END AS in_year, a AS compact, a - 2 + 2 - 2 AS not_inverted0, concat(y, '年', m, '月', d, '日 ~ ', m, '月', d, '日') AS normal FROM ev",
    "listed_ranges": _EV + " SELECT o_orderkey, a AS first, b AS last, a AS page_first, make_date(y, m, 28) AS page_last FROM ev",
    "small_texts": "SELECT p_partkey, concat(' ・', p_name, ' &amp; ', p_brand) AS compact, CASE WHEN p_partkey % 4 > 0 THEN concat('・<b>', p_name, '</b> & ', p_brand) ELSE '' END AS decoded, p_name AS heading, right(p_type, 3) AS tail, ['kagawa', 'ehime', 'others'][(p_partkey % 3) + 1] AS slug, round(p_partkey * 150 / 1000, 1) AS s, concat('a', chr(10), 'b c ', p_brand) AS plain FROM part",
    "tag_policy": "SELECT o_orderkey, 'performance' AS over, concat(CASE WHEN o_orderkey % 3 = 1 THEN 'スポーツ' ELSE '公演' END, ',', CASE WHEN o_orderkey % 2 = 0 THEN 'スポーツ' ELSE 'zoo' END) AS labels, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'zoo' END AS unlabelled FROM orders",
    "missing_references": "SELECT page_id, concat('a/', page_id + 1, '.js') AS reference FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id = p.page_id + 1)",
    "column_widths": "SELECT max(length(p_partkey::VARCHAR))::INT AS p_partkey, max(length(p_name))::INT AS p_name, max(length(p_brand))::INT AS p_brand FROM part",
    "venue_lists": _EV + ", f AS (SELECT a, o_orderpriority, min(o_orderkey) AS k FROM ev GROUP BY 1, 2) SELECT a AS date_from, string_agg(o_orderpriority, '・' ORDER BY k) AS venues FROM f GROUP BY 1",
    "sorted_paths": "SELECT page_id, url FROM pages ORDER BY url, page_id",
    "day_documents": _EV + f""", g AS (SELECT a AS day, count(*) AS n, string_agg({_CARD}, '' ORDER BY o_orderkey) AS cards, string_agg({_LD}, ',' ORDER BY o_orderkey) AS ld FROM ev GROUP BY 1),
      w AS (SELECT *, lag(day) OVER (ORDER BY day) AS p, lead(day) OVER (ORDER BY day) AS x, day < DATE '1998-06-15' OR day > DATE '1998-10-13' AS ni FROM g)
      SELECT day, n AS n_events, ni AS noindex, md5(concat('<!DOCTYPE html><html lang="ja"><head><title>', day, 'のイベント（', n, '件）</title>', CASE WHEN ni THEN '<meta name="robots" content="noindex">' END, '<script type="application/ld+json">[', ld, ']</script></head><body><nav>',
        CASE WHEN p IS NOT NULL THEN concat('<a rel="prev" href="/date/', p, '/">', p, '</a>') END, CASE WHEN x IS NOT NULL THEN concat('<a rel="next" href="/date/', x, '/">', x, '</a>') END, '</nav><ul>', cards, '</ul></body></html>')) AS digest FROM w""",
    "index_document": _EV + ", r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY a) AS n FROM ev) SELECT a AS day, n AS n_events, concat('<section><h2><a href=\"/date/', a, '/\">', a, '</a></h2><ul>', string_agg(concat('<li>E', o_orderkey, '</li>'), '' ORDER BY k), '</ul>', CASE WHEN n > 3 THEN concat('<p>ほか', n - 3, '件</p>') END, '</section>') AS section FROM r WHERE k <= 3 GROUP BY a, n",
}
SQL["written_dates"] = SQL["written_dates"].replace("a - 2 + 2 - 2 AS not_inverted0", "a AS not_inverted")
