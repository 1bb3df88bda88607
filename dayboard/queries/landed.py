"""Extractors of single sources over pages made from the whole driver tables: a page a customer, an item an order."""

from __future__ import annotations

import datetime as dt

from ..plans import sources
from .base import AS_OF, F, order_events

FIRST = dt.date(1995, 1, 1)
HOST = "https://v.jp/"


def _orders(spark, sf):
    return order_events(spark, sf).select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"), F.col("o_custkey").cast("string").alias("c"), "date_from", "date_to", "o_orderpriority")


def _jp(d, padded=False):
    return F.date_format(d, "yyyy年MM月dd日" if padded else "yyyy年M月d日")


def _lists(rows, item, before="", after=""):
    """A page for each customer with the items of its orders, in order.

    An item that is a function of an order is written where its page is made, so that long texts are not shuffled.  These
    partitions, four a core, keep their number: by the bytes of orders Spark would coalesce what the texts make large.
    """
    if callable(item):
        rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "c")
        html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "k", "date_from"))), item), "")
    else:
        html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("i")))), lambda x: x["i"]), "")
    return rows.groupBy("c").agg(html.alias("i")).select(F.concat(F.lit(HOST), "c", F.lit("/")).alias("url"), F.concat(F.lit(before), "i", F.lit(after)).alias("html"))


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def date_row_events(spark, sf):
    o, k = _orders(spark, sf), F.col("k")
    row = _text('<tr><td class="title_link"><a href="/d/', k, '">T<b>', k, '</b></a></td><td class="date"><p>', _jp("date_to", True), "～", _jp("date_from", True), "</p>未定<br>", F.when(F.col("o_orderkey") % 2 == 0, _jp("date_from", True)).otherwise(F.lit("")), "</td></tr>")
    details = o.where("o_orderkey % 3 = 0").select(_text(HOST, "d/", k).alias("url"), _text('<div class="text-beginning"><strong>日時</strong></h3><p>開場／午後', (F.col("o_orderkey") % 12).cast("string"), "時 開演／午前9時30分</p></div>").alias("html"))
    return sources.date_rows(_lists(o, row, "<tbody>", "</tbody>"), details).select("source_url", "title", "date_from", "date_to", "open_time", "start_time")


def card_list_events(spark, sf):
    o, k = _orders(spark, sf), F.col("k")
    sign = lambda d: F.date_format(d, "M月d日")
    card = _text('<li class="card_list"><a href="/n/', k, '"><div class="detail_name">N', k, '</div><span class="date_start">', sign("date_from"), "</span></a></li>")
    details = o.select(_text(HOST, "n/", k).alias("url"), _text('<div class="p-news-detail__content">', F.col("o_orderpriority"), "</div>").alias("html"))
    return sources.list_cards(_lists(o, card), details, AS_OF).select("source_url", "title", "date_from", "body", "description")


def post_events(spark, sf):
    o = _orders(spark, sf)
    post = F.struct(F.struct(_text("P &amp; ", F.col("k")).alias("rendered")).alias("title"), _text(HOST, "p/", F.col("k")).alias("link"), F.struct(F.col("date_from").cast("string").alias("start_date"), F.when(F.col("o_orderkey") % 2 == 0, F.col("date_to").cast("string")).otherwise(F.lit("")).alias("end_date"), F.struct(F.lit("９：００").alias("e_start"), F.when(F.col("o_orderkey") % 3 == 0, "10:30").alias("e_start2"), F.lit(" ").alias("e_price"), F.lit("TEL").alias("e_contact")).alias("detail_group")).alias("acf"))
    posts = o.groupBy("c").agg(F.to_json(F.collect_list(post)).alias("body")).select(F.col("c").alias("url"), "body")
    details = o.select(_text(HOST, "p/", F.col("k")).alias("url"), F.lit("<b>開始</b> 11:00 終了 12:00").alias("html"))
    return sources.event_posts(posts, details, AS_OF).select("source_url", "title", "date_from", "date_to", "open_time", "start_time", "end_time", "price", "contact")


def term_events(spark, sf):
    o, k = _orders(spark, sf), F.col("k")
    sign = lambda d: F.date_format(d, "yyyy/MM/dd")
    html = _text("<h1>H", k, '</h1><dl class="list"><dt>開催日</dt><dd>', sign("date_from"), "～", sign("date_to"), "</dd><dt>開催時間</dt><dd>9:00～10:30</dd></dl>")
    details = o.select(_text(HOST, "events/event/", k, "/").alias("url"), html.alias("html"))
    return sources.term_details(_lists(o.where("o_orderkey % 4 > 0"), _text("<a href='", HOST, "events/event/", k, "/'>")), details, r"https://v\.jp/events/event/\d+/", "館").select("source_url", "title", "date_from", "date_to", "start_time", "end_time", "venue_name")


def section_events(spark, sf):
    o, k = _orders(spark, sf), F.col("k")
    item = _text("<a href='/s/", k, "'>", F.date_format("date_from", "yyyy.M.d"), "（土）S ", k, "</a>")
    return sources.headed_section(_lists(o, item, "<a href='/x'>1998.1.1 x</a><h2>自主<i>事業</i></h2>", "<h3>開催終了</h3><a href='/y'>1998.1.1 y</a>"), "自主事業", ["開催終了"]).select("source_url", "title", "date_from")


def block_events(spark, sf):
    o, k = _orders(spark, sf), F.col("k")
    day = _text(_jp("date_from"), "〜", F.when(F.col("o_orderkey") % 2 == 0, _jp("date_to")).otherwise(_jp(F.date_sub("date_from", 3))))
    item = _text("<li><a href='/event/07event/", k, ".html'>B ", k, "</a> ", day, "</li>")
    return sources.mixed_blocks(_lists(o, item), FIRST, "/event/07event/", "/07event/07event.html", 24).select("source_url", "title", "date_from", "date_to")


def anchor_events(spark, sf):
    o, k = _orders(spark, sf), F.col("k")
    block = _text('<a id="no', k, '"></a><td class="mainTit1">A<br>', k, '</td><td class="mainTit2">', _jp("date_from"), "・", F.date_format("date_from", "d日"), "<br>", F.when(F.col("o_orderkey") % 3 > 0, "アイレックス 小").otherwise("別館"), "</td><div class='mainTx0'>x<br>", F.when(F.col("o_orderkey") % 2 == 0, "公演は終了しました").otherwise("y"), "</div>")
    return sources.anchor_blocks(_lists(o, block), ["アイレックス"]).select("source_url", "title", "date_from", "date_to", "venue_name", "body", "status")


def day_object_events(spark, sf):
    o, k = _orders(spark, sf), F.col("k")
    day = _text(F.date_format("date_from", "yyyy/MM/dd"))
    named = o.groupBy("c", day.alias("day")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "k"))), lambda x: _text("<span class='e_icon'></span><a href='/o/", x["k"], "'>", F.when(x["o_orderkey"] % 5 == 0, "非公開").otherwise(_text("O", x["k"])), "</a> 開演 18:00")), "").alias("h"))
    html = named.groupBy("c").agg(F.concat_ws(",", F.collect_list(_text('"', F.col("day"), '": "', F.col("h"), '"'))).alias("h"))
    pages = html.select(_text(HOST, F.col("c"), "/").alias("url"), _text("<script>var e_icon = {", F.col("h"), ",};</script>").alias("html"))
    return sources.day_objects(pages).select("source_url", "title", "date_from", "start_time", "body")


def described_events(spark, sf):
    o, k = _orders(spark, sf), F.col("k")
    html = _text('<h3 class="h3_title01">D', k, '</h3><dl class="dl_postevent"><dt>開催期間</dt><dd>', _jp("date_from"), "〜", F.date_format("date_to", "M月d日"), "</dd>", F.when(F.col("o_orderkey") % 2 == 0, "<dt>時間</dt><dd>9：00〜17:00</dd>").otherwise(""), "</dl>")
    details = o.select(_text(HOST, "event/", k, "/").alias("url"), html.alias("html"))
    return sources.described_posts(_lists(o, _text("<a href='/event/", k, "/'>")), details, AS_OF).select("source_url", "title", "date_from", "date_to", "start_time", "end_time", "body")


def show_events(spark, sf):
    """Exhibitions of all orders merged with a list of every other one under the address of its detail."""
    o, k = _orders(spark, sf), F.col("k")
    show = _text('<li class="exhibition-item"><a href="/x/', k, '"><h3>E', k, '</h3></a><p class="post-term">', _jp("date_from"), "～", _jp("date_to"), "</p></li>")
    item = _text('<a class="event-item" href="/event/info/', k, '"><h2 class="event-item__title">E', k, '</h2><p class="post-term">', _jp("date_from"), "<br>", _jp("date_to"), "</p></a>")
    details = o.where("o_orderkey % 3 = 0").select(_text(HOST, "x/", k).alias("url"), F.lit("<dt>開館時間</dt><dd>9:40～18:00</dd><dt>料金</dt><dd>無料</dd>").alias("html"))
    return sources.exhibitions(_lists(o, show), _lists(o.where("o_orderkey % 2 = 0"), item), details, dt.date(1990, 1, 1), "館").select("source_url", "title", "date_from", "date_to", "start_time", "end_time", "price", "venue_name")


def special_events(spark, sf):
    o, k = _orders(spark, sf), F.col("k")
    lines = _text("<p>企画展 ", k, "</p><p>", _jp("date_from"), "～", F.date_format("date_to", "M月d日"), "</p>")
    linked = _text('<h2>特別展</h2><a href="/m/', k, '">開催中 企画展 ', k, "</a><p>", _jp("date_from"), "から", _jp("date_to"), "まで</p><h2>他</h2>", lines)
    pages = o.select(_text(HOST, "q/", k).alias("url"), F.when(F.col("o_orderkey") % 2 == 0, linked).otherwise(lines).alias("html"))
    return sources.special_and_lines(pages).select("source_url", "title", "date_from", "date_to")


def text_events(spark, sf):
    o, k = _orders(spark, sf), F.col("k")
    item = _text(F.date_format("date_from", "M/d"), " (火) 行事：W", k, F.when(F.col("o_orderkey") % 4 == 0, " 休館日").otherwise(""), " 施設 場", k, " TEL 1 ")
    return sources.dated_text(_lists(o, item), AS_OF).select("source_url", "title", "date_from", "description")


def window_events(spark, sf):
    o, k = _orders(spark, sf), F.col("k")
    item = lambda x: _text("<p>", F.lit("." * 600), "</p><h3>開催日 V", x["k"], "</h3><a href='/event/event-", x["k"], "/'>詳細</a>", _jp(x["date_from"]), F.lit("." * 1600))
    cell = F.when(F.col("o_orderkey") % 2 == 0, _text("<table class='eventTable'><tr><th>開催日</th><td>", _jp("date_from"), "～", _jp("date_to"), "</td></tr></table>")).otherwise("x")
    details = o.select(_text(HOST, "event/event-", k, "/").alias("url"), cell.alias("html"))
    return sources.windowed_links(_lists(o, item), details).select("source_url", "title", "date_from", "date_to")


def crawled_events(spark, sf):
    """Months chained by links from the first of 1998 on, each with links to the orders of that month."""
    o, k = _orders(spark, sf), F.col("k")
    month = F.trunc("date_from", "month")
    address = lambda m: _text(HOST, "event/date/", F.date_format(m, "yyyy/MM"), "/")
    by_month = o.groupBy(month.alias("m")).agg(F.array_join(F.collect_list(_text("<a href='/event/", k, "/'>x</a>")), "").alias("h"))
    pages = by_month.select(address(F.col("m")).alias("url"), _text("<a href='", address(F.add_months("m", 1)), "'>次</a><a href='", address(F.add_months("m", -1)), "'>前</a>", F.col("h")).alias("html"))
    details = o.select(_text(HOST, "event/", k, "/").alias("url"), _text("<h1>C", k, "</h1><p>開催日：", _jp("date_from"), "</p><p>開演18:00</p>").alias("html"))
    return sources.month_crawl(pages, details, HOST + "event/date/1998/06/", AS_OF).select("source_url", "title", "date_from", "start_time", "body")


def next_month_events(spark, sf):
    """Seven months of 1995 by their next links; the month of a page is written into its events."""
    o, k = _orders(spark, sf), F.col("k")
    address = lambda m: _text(HOST, F.date_format(m, "yyyyMM"))
    block = _text("<h4>・M", k, "</h4><p>", _jp("date_from"), " 大ホール 18:00〜20:00</p><p>入場料：", F.col("o_orderpriority"), "</p>")
    by_month = o.groupBy(F.trunc("date_from", "month").alias("m")).agg(F.array_join(F.collect_list(block), "").alias("h"))
    pages = by_month.select(address(F.col("m")).alias("url"), _text("<a href='/", F.date_format(F.add_months("m", 1), "yyyyMM"), "'>次月のイベント</a>", F.col("h")).alias("html"))
    return sources.next_month_pages(pages, HOST + "199501").select("title", "date_from", "venue_name", "start_time", "end_time", "price")


QUERIES = {f.__name__: f for f in (date_row_events, card_list_events, post_events, term_events, section_events, block_events, anchor_events, day_object_events, described_events, show_events, special_events, text_events, window_events, crawled_events, next_month_events)}

_EV = "WITH ev AS (SELECT *, o_orderkey AS k, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 30)::INT AS b FROM orders)"
SQL = {
    "date_row_events": _EV + """, part AS (SELECT k, a, b FROM ev UNION ALL SELECT k, a, a FROM ev WHERE k % 2 = 0)
      SELECT concat('https://v.jp/d/', k) AS source_url, concat('T', k) AS title, a::VARCHAR AS date_from, b::VARCHAR AS date_to, CASE WHEN k % 3 = 0 THEN concat(lpad((k % 12 + 12)::VARCHAR, 2, '0'), ':00') END AS open_time, CASE WHEN k % 3 = 0 THEN '09:30' END AS start_time FROM part""",
    "card_list_events": _EV + " SELECT concat('https://v.jp/n/', k) AS source_url, concat('N', k) AS title, make_date(1998, month(a), day(a))::VARCHAR AS date_from, concat('開催期間: ', month(a), '月', day(a), '日') AS body, o_orderpriority AS description FROM ev WHERE NOT (month(a) = 2 AND day(a) = 29)",
    "post_events": _EV + " SELECT concat('https://v.jp/p/', k) AS source_url, concat('P & ', k) AS title, a::VARCHAR AS date_from, CASE WHEN k % 2 = 0 THEN b ELSE a END::VARCHAR AS date_to, '09:00' AS open_time, CASE WHEN k % 3 = 0 THEN '10:30' ELSE '11:00' END AS start_time, CASE WHEN k % 3 > 0 THEN '12:00' END AS end_time, NULL::VARCHAR AS price, 'TEL' AS contact FROM ev WHERE a >= DATE '1998-06-01' AND a < DATE '1999-01-01'",
    "term_events": _EV + " SELECT concat('https://v.jp/events/event/', k, '/') AS source_url, concat('H', k) AS title, a::VARCHAR AS date_from, b::VARCHAR AS date_to, '9:00' AS start_time, '10:30' AS end_time, '館' AS venue_name FROM ev WHERE k % 4 > 0",
    "section_events": _EV + " SELECT concat('https://v.jp/s/', k) AS source_url, concat('S ', k) AS title, a::VARCHAR AS date_from FROM ev",
    "block_events": _EV + " SELECT concat('https://v.jp/event/07event/', k, '.html') AS source_url, concat('B ', k) AS title, a::VARCHAR AS date_from, CASE WHEN k % 2 = 0 THEN b ELSE a END::VARCHAR AS date_to FROM ev WHERE a >= DATE '1995-01-01' AND a < DATE '1997-01-01'",
    "anchor_events": _EV + " SELECT concat('https://v.jp/', o_custkey, '/#no', k) AS source_url, concat('A ', k) AS title, a::VARCHAR AS date_from, a::VARCHAR AS date_to, 'アイレックス 小' AS venue_name, CASE WHEN k % 2 = 0 THEN 'x\n公演は終了しました' ELSE 'x\ny' END AS body, CASE WHEN k % 2 = 0 THEN 'finished' ELSE 'scheduled' END AS status FROM ev WHERE k % 3 > 0",
    "day_object_events": _EV + " SELECT concat('https://v.jp/o/', k) AS source_url, concat('O', k) AS title, a::VARCHAR AS date_from, '18:00' AS start_time, concat('O', k, ' 開演 18:00') AS body FROM ev WHERE k % 5 > 0",
    "described_events": _EV + " SELECT concat('https://v.jp/event/', k, '/') AS source_url, concat('D', k) AS title, a::VARCHAR AS date_from, b::VARCHAR AS date_to, CASE WHEN k % 2 = 0 THEN '09:00' END AS start_time, CASE WHEN k % 2 = 0 THEN '17:00' END AS end_time, CASE WHEN k % 2 = 1 THEN concat('D', k, '   開催期間  ', year(a), '年', month(a), '月', day(a), '日〜', month(b), '月', day(b), '日') END AS body FROM ev WHERE a BETWEEN DATE '1997-06-15' AND DATE '1999-06-15'",
    "show_events": _EV + " SELECT concat('https://v.jp/', CASE WHEN k % 2 = 0 THEN 'event/info/' ELSE 'x/' END, k) AS source_url, concat('E', k) AS title, a::VARCHAR AS date_from, b::VARCHAR AS date_to, CASE WHEN k % 3 = 0 THEN '09:40' END AS start_time, CASE WHEN k % 3 = 0 THEN '18:00' END AS end_time, CASE WHEN k % 3 = 0 THEN '無料' END AS price, '館' AS venue_name FROM ev",
    "special_events": _EV + " SELECT concat('https://v.jp/', CASE WHEN k % 2 = 0 THEN 'm/' ELSE 'q/' END, k) AS source_url, concat('企画展 ', k) AS title, a::VARCHAR AS date_from, b::VARCHAR AS date_to FROM ev",
    "text_events": _EV + " SELECT concat('https://v.jp/', o_custkey, '/') AS source_url, concat('W', k) AS title, concat('1998-', lpad(month(a)::VARCHAR, 2, '0'), '-', lpad(day(a)::VARCHAR, 2, '0')) AS date_from, concat('会場: 場', k) AS description FROM ev WHERE k % 4 > 0",
    "window_events": _EV + " SELECT concat('https://v.jp/event/event-', k, '/') AS source_url, concat('V', k) AS title, a::VARCHAR AS date_from, CASE WHEN k % 2 = 0 THEN b ELSE a END::VARCHAR AS date_to FROM ev",
    "crawled_events": _EV + " SELECT concat('https://v.jp/event/', k, '/') AS source_url, concat('C', k) AS title, a::VARCHAR AS date_from, '18:00' AS start_time, NULL::VARCHAR AS body FROM ev WHERE a >= DATE '1997-06-01' AND a < DATE '1999-07-01'",
    "next_month_events": _EV + " SELECT concat('M', k) AS title, a::VARCHAR AS date_from, '大ホール' AS venue_name, '18:00' AS start_time, '20:00' AS end_time, o_orderpriority AS price FROM ev WHERE a >= DATE '1995-01-01' AND a < DATE '1995-08-01'",
}
