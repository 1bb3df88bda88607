"""Publishing, checks, upkeep, crawls and the listings that are shown, over the whole driver tables."""

from __future__ import annotations

import uuid

from ..functions import dates, extract, urls
from ..operators import checks, graph, ranking, render, spans, stats
from ..operators import events as ev
from ..plans import sources, upkeep, venues
from ..sources import publish, readers
from ..sources.shared import keep, shared_dir
from .base import AS_OF, F, order_events, table
from .landed import HOST, _jp, _lists, _orders, _text


def published_parts(spark, sf):
    """Orders by priority published twice, the second time with changed prices in one and without another priority."""
    folder = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("part"))
    publish.publish(o, folder)
    first = F.substring("part", 1, 1)
    done = publish.publish(o.where(first != "5").withColumn("o_totalprice", F.when(first == "2", F.lit(0.0)).otherwise(F.col("o_totalprice"))), folder)
    rows = publish.published(spark, folder).groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    versions = publish.manifest(spark, folder).select("part", "version")
    return rows.join(versions, "part").withColumns({"written": F.lit(done.written), "unchanged": F.lit(done.unchanged), "removed": F.lit(done.removed)})


def enforced_gate(spark, sf):
    """Orders of each customer as outputs: some lack titles or days, one in seven outputs is missing."""
    o, k = order_events(spark, sf), F.col("o_orderkey")
    events = o.select(F.col("o_custkey").alias("venue"), F.when(k % 40 > 0, F.lit("t")).otherwise(" ").alias("title"), F.when(k % 25 > 0, F.col("date_from")).alias("day")).where("venue % 7 <> 0")
    expected = table(spark, sf, "customer").select(F.col("c_custkey").alias("venue"), (F.col("c_custkey") % 7 != 0).alias("there"))
    return checks.gate(expected, events, "venue", F.col("title"), F.col("day").isNotNull(), title_rates=(0.02, 0.2), date_rates=(0.0, 0.1), enforce=False)


def checked_texts(spark, sf):
    """Documents as bodies, some cut inside a character, written with their reasons in one pass; counts of that pass."""
    d = table(spark, sf, "documents").where("doc_id is not null and text is not null")
    k = F.col("doc_id")
    body = F.when(k % 10 == 0, F.encode(F.lit(""), "utf-8")).when(k % 10 == 1, F.unhex(F.lit("FFFE41"))).otherwise(F.encode("text", "utf-8"))
    folder = f"{shared_dir(spark)}/checked-{uuid.uuid4().hex}"
    seen = checks.write_checked(checks.checked_bodies(d.select("doc_id", body.alias("body")), "body", "utf-8"), folder)
    bad = checks.quarantined(spark, folder).groupBy("reason").agg(F.count("*").alias("n"))
    good = checks.good(spark, folder).agg(F.lit("").alias("reason"), F.count("*").alias("n"))
    return bad.unionByName(good).withColumns({"rows_seen": F.lit(seen["rows"]).cast("long"), "bad_seen": F.lit(seen["bad"]).cast("long")})


def refreshed_days(spark, sf):
    """Event days after every hundredth order moved by a day and every hundred-and-first went: days whose pages change."""
    o, k = order_events(spark, sf).select("o_orderkey", "date_from", "date_to"), F.col("o_orderkey")
    later = lambda c: F.when(k % 100 == 0, F.date_add(c, 1)).otherwise(F.col(c)).alias(c)
    after = o.where("o_orderkey % 101 <> 0").select("o_orderkey", later("date_from"), later("date_to"))
    days = keep(ev.expand_days(ev.sane_range(o), window=ev.publish_window(AS_OF)), "days")
    done = upkeep.refresh_days(days, upkeep.event_changes(o, after, "o_orderkey"), "o_orderkey", AS_OF)
    counts = done.rows.groupBy("day").agg(F.count("*").alias("n_events"))
    return done.touched.join(counts, "day", "left").select("day", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def queue_reach(spark, sf):
    """The first 60 orders that a queue reads from order 1, each leading to others by its lines in order."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    dst = F.col("l_partkey") % 97 * 32 + F.col("l_linenumber")
    links = l.select(F.col("l_orderkey").cast("string").alias("src"), dst.cast("string").alias("dst"), (F.col("l_linenumber") * 10_000 + dst).alias("place"))
    return graph.crawl_in_order(spark.createDataFrame([("1", 0)], "node string, place int"), links, 60)


def linked_texts(spark, sf):
    """Texts of parts cut at their links, and where each link stands."""
    k = F.col("p_partkey").cast("string")
    t = _text("at ", F.col("p_name"), " https://x.jp/", k, "). or https://y.jp/?q=", k, F.when(F.col("p_partkey") % 2 == 0, "、").otherwise(" end"))
    p = table(spark, sf, "part").select("p_partkey", t.alias("t"))
    parts = p.select("p_partkey", F.transform(extract.auto_link_parts(F.col("t")), lambda x: F.coalesce(F.concat(F.lit("["), x["url"], F.lit("]")), x["text"])).alias("parts"))
    where = spans.match_spans(p, ["p_partkey"], "t", extract.LINKED).groupBy("p_partkey").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    return parts.join(where, "p_partkey").select("p_partkey", F.array_join("parts", "|").alias("parts"), "first", "last")


def day_events_ja(spark, sf):
    """Events of a page: by day, then title in Japanese order, then place in the source."""
    o = order_events(spark, sf).select("o_orderkey", "date_from", F.get(F.array(*map(F.lit, ["あ", "ア", "か", "が", "漢", "b", "A"])), (F.col("o_orderkey") % 7).cast("int")).alias("title"))
    return o.where("date_from = date '1998-06-15' or date_from = date '1998-06-16'").orderBy("date_from", ranking.ja("title"), "o_orderkey").select("o_orderkey", "date_from", "title")


def today_events(spark, sf):
    """The first five events of today by title."""
    o = order_events(spark, sf).withColumn("title", F.concat("o_orderpriority", F.lit(" "), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")))
    return ranking.page(o.where(ev.held_on(F.col("date_from"), F.col("date_to"), AS_OF)).select("o_orderkey", "title"), [ranking.ja("title"), F.col("o_orderkey")], 0, 5)


def table_month_events(spark, sf):
    """Tables of months, a page a customer and month; days of the month with their weekday in brackets."""
    o, k = _orders(spark, sf), F.col("k")
    item = _text("<tr><td>", F.dayofmonth("date_from").cast("string"), "（土） 18:30", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("～"), "</td><td>M ", k, "</td><td>088</td><td>", F.when(F.col("o_orderkey") % 2 == 0, "無料").otherwise("500円"), "</td></tr>")
    pages = _lists(o.where("month(date_from) = 7"), item, "<div class=\"month\">7月</div><div class=\"stitle\"><h3>小</h3></div><table><tr><td>日時</td><td>催し物</td></tr>", "</table>")
    return venues.month_tables(pages, AS_OF, "館").select("source_url", "title", "date_from", "start_time", "price", "venue_name", "body")


def entry_events(spark, sf):
    """Entries of lists joined to their pages."""
    o, k = _orders(spark, sf), F.col("k")
    item = _text("<li class=\"c-entries__item\"><a href=\"/n/", k, "\"><h3>L ", k, "</h3></a></li>")
    details = o.where("o_orderkey % 4 > 0").select(_text(HOST, "n/", k).alias("url"), _text(F.when(F.col("o_orderkey") % 2 == 0, _text("<h1 class=\"entry-title\">T &amp; ", k, "</h1>")).otherwise(""), "<table><tr><th>日時</th><td>", _jp("date_from"), "</td></tr><tr><th>開催時間</th><td>9：05～</td></tr><tr><th>入場料</th><td>1 円</td></tr></table>").alias("html"))
    return venues.entries_with_details(_lists(o, item), details, AS_OF, "館").select("source_url", "title", "date_from", "start_time", "price", "venue_name")


def labelled_events(spark, sf):
    """Plain blocks with a labelled day each, whose title is the line before."""
    o, k = _orders(spark, sf), F.col("k")
    item = _text("B ", k, "<br>と き: ", _jp("date_from"), " 開演 ", F.when(F.col("o_orderkey") % 2 == 0, "9：30").otherwise("18:00"), "<br>一般 1,000円<br>")
    return venues.labelled_blocks(_lists(o, item, "ホーム<br>")).select("source_url", "title", "date_from", "start_time", "price")


def linked_page_events(spark, sf):
    """Pages that months around today link to, by heading and first day; a queue of at most 36 months."""
    o, k = _orders(spark, sf), F.col("k")
    month = F.trunc("date_from", "month")
    address = lambda m: _text(HOST, "event/date/", F.date_format(m, "yyyy/MM"), "/")
    by_month = o.groupBy(month.alias("m")).agg(F.array_join(F.collect_list(_text("<a href='/event/", k, "/'>x</a>")), "").alias("h"))
    pages = by_month.select(address(F.col("m")).alias("url"), _text("<a href='", address(F.add_months("m", 1)), "'>次</a><a href='", address(F.add_months("m", -1)), "'>前</a>", F.col("h")).alias("html"))
    details = o.select(_text(HOST, "event/", k, "/").alias("url"), _text("<h1>C", k, "</h1><p>", _jp("date_from"), "</p>").alias("html"))
    return sources.crawled_details(pages, details, HOST + "event/date/1998/06/", AS_OF, most=4).select("source_url", "title", "date_from")


def sheet_events(spark, sf):
    """Sheets of a hall, one a customer: a heading for the month, then a line an order with day, name and time."""
    o, n = _orders(spark, sf).where("month(date_from) = 7"), F.col("o_orderkey") * 2
    line = o.select(_text(HOST, F.col("c")).alias("url"), n.alias("n"), _text(F.dayofmonth("date_from").cast("string"), ",\"土\",\"S, ", F.col("k"), "\",9:00～17:00,,x,", F.when(F.col("o_orderkey") % 2 == 0, "10:00～12:00").otherwise("")).alias("line"))
    head = o.select(_text(HOST, F.col("c")).alias("url")).distinct().select("url", F.lit(-1).cast("long").alias("n"), F.lit("7 月 行 事,,,").alias("line"))
    return venues.sheet(head.unionByName(line), AS_OF, "館").select("source_url", "title", "date_from", "start_time", "end_time", "venue_name")


def structured_days(spark, sf):
    """Structured data of the pages of each first day of orders."""
    o, k = order_events(spark, sf), F.col("o_orderkey")
    none = F.lit(None).cast("string")
    days = o.select(F.col("date_from").alias("day"), k.alias("ord"), F.concat(F.lit("E<"), k.cast("string")).alias("title"), F.when(k % 2 == 0, F.concat(F.lit("https://x.jp/"), k.cast("string"))).alias("url"), "date_from", "date_to", F.col("o_custkey").cast("string").alias("venue_id"), F.when(k % 3 > 0, F.lit("H")).alias("venue_name"), F.when(k % 5 == 0, F.lit("市")).alias("organizer"), none.alias("performer"), F.when(k % 7 == 0, F.lit("無料")).alias("price"))
    return render.day_data(days, "https://v.jp").select("day", F.md5("data").alias("digest"), F.length("data").alias("n"))


def aligned_report(spark, sf):
    """Line items by flag and status as a report."""
    file = F.concat_ws(" ", F.lit("items"), "l_returnflag", "l_linestatus").alias("file")
    rows = table(spark, sf, "lineitem").groupBy(file).agg(F.count("*").alias("items"), F.countDistinct("l_orderkey").alias("orders"))
    return stats.report(rows, "file", ["items", "orders"])


def initial_pages(spark, sf):
    """Pages of parts by their first letter."""
    return render.name_pages(table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("name")), "p_partkey", "name")


def listed_spots(spark, sf):
    """Pages of a sitemap, spots that addresses mean, and days as browsers read them."""
    k = F.col("page_id")
    path = F.when(k % 5 == 0, "spot/index.html").when(k % 5 == 1, F.concat(F.lit("google"), k.cast("string"), F.lit(".html"))).otherwise(F.concat(F.lit("spot/s"), k.cast("string"), F.lit("/index.html")))
    html = F.when(k % 7 == 0, "<meta name='robots' content='noindex'>").otherwise("x")
    rows = readers.listed_pages(table(spark, sf, "pages").select("page_id", path.alias("path"), html.alias("html")))
    address = F.concat(F.lit("https://v.jp/"), F.col("path"), F.when(k % 2 == 0, F.concat(F.lit("?spot_id=q"), k.cast("string"))).otherwise(""))
    return rows.select("page_id", urls.spot_id(address).alias("spot"), dates.lenient_day(F.concat(F.lit("2026-02-"), F.lpad((k % 31 + 1).cast("string"), 2, "0"))).alias("day"))


QUERIES = {f.__name__: f for f in (structured_days, aligned_report, initial_pages, listed_spots, published_parts, enforced_gate, checked_texts, refreshed_days, queue_reach, linked_texts, day_events_ja, today_events, table_month_events, entry_events, labelled_events, linked_page_events, sheet_events)}

_EV = "WITH ev AS (SELECT *, o_orderkey AS k, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 30)::INT AS b FROM orders)"
SQL = {
    "structured_days": _EV + r""", e AS (SELECT a AS day, k, concat('{"@type":"Event","name":"E<', k, '","startDate":"', a, '","endDate":"', b, '","url":"', CASE WHEN k % 2 = 0 THEN concat('https://x.jp/', k) ELSE concat('https://v.jp/date/', a, '/') END, '"',
        CASE WHEN k % 3 > 0 THEN concat(',"location":{"@type":"Place","name":"H","url":"https://v.jp/spot/', o_custkey, '/"}') END, CASE WHEN k % 5 = 0 THEN ',"organizer":{"@type":"Organization","name":"市"}' END, CASE WHEN k % 7 = 0 THEN ',"isAccessibleForFree":true' END, '}') AS j FROM ev),
      n AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY k) AS nth FROM e),
      g AS (SELECT day, concat('[{"@context":"https://schema.org","@type":"ItemList","name":"', day, 'のイベント","numberOfItems":', count(*), ',"itemListElement":[', string_agg(concat('{"@type":"ListItem","position":', nth, ',"item":', j, '}'), ',' ORDER BY nth), ']},{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"トップ","item":"https://v.jp/"},{"@type":"ListItem","position":2,"name":"日付一覧","item":"https://v.jp/date/"},{"@type":"ListItem","position":3,"name":"', day, '","item":"https://v.jp/date/', day, '/"}]}]') AS t FROM n GROUP BY day)
      SELECT day, md5(replace(t, '<', '\u003c')) AS digest, length(replace(t, '<', '\u003c'))::INT AS n FROM g""",
    "aligned_report": "WITH g AS (SELECT concat('items ', l_returnflag, ' ', l_linestatus) AS f, count(*)::VARCHAR AS i, count(DISTINCT l_orderkey)::VARCHAR AS o FROM lineitem GROUP BY 1), w AS (SELECT max(length(f)) AS a, greatest(max(length(i)), 5) AS b, greatest(max(length(o)), 6) AS c FROM g) SELECT 0 AS ord, concat(rpad('file', a::INT, ' '), ' | ', lpad('items', b::INT, ' '), ' | ', lpad('orders', c::INT, ' ')) AS line FROM w UNION ALL SELECT 1, concat(repeat('-', a), '-+-', repeat('-', b), '-+-', repeat('-', c)) FROM w UNION ALL SELECT 2, concat(rpad(f, a::INT, ' '), ' | ', lpad(i, b::INT, ' '), ' | ', lpad(o, c::INT, ' ')) FROM g, w",
    "initial_pages": "SELECT upper(left(p_name, 1)) AS initial, count(*) AS n_venues, concat('<h1>', upper(left(p_name, 1)), '</h1><ul>', string_agg(concat('<li><a href=\"/spot/', p_partkey, '/\">', p_name, ' ', lpad(p_partkey::VARCHAR, 9, '0'), '</a></li>'), '' ORDER BY p_name, p_partkey), '</ul>') AS html FROM part GROUP BY 1",
    "listed_spots": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('q', page_id) ELSE concat('s', page_id) END AS spot, DATE '2026-02-01' + (page_id % 31)::INT AS day FROM pages WHERE page_id % 5 > 1 AND page_id % 7 > 0",
    "published_parts": "SELECT o_orderpriority AS part, count(*) AS n, round(sum(CASE WHEN o_orderpriority LIKE '2%' THEN 0 ELSE o_totalprice END), 2) AS total, CASE WHEN o_orderpriority LIKE '2%' THEN 2 ELSE 1 END::BIGINT AS version, 1 AS written, 3 AS unchanged, 1 AS removed FROM orders WHERE o_orderpriority NOT LIKE '5%' GROUP BY 1",
    "enforced_gate": """WITH e AS (SELECT o_custkey AS venue, count(*) AS total, sum((o_orderkey % 40 = 0)::INT)::BIGINT AS mt, sum((o_orderkey % 25 = 0)::INT)::BIGINT AS md FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1),
      c AS (SELECT c_custkey AS venue, coalesce(total, 0) AS total, coalesce(mt, 0) AS missing_title, coalesce(md, 0) AS missing_date, coalesce(mt / total, 0) AS tr, coalesce(md / total, 0) AS dr FROM customer LEFT JOIN e ON venue = c_custkey),
      s AS (SELECT *, CASE WHEN tr > 0.2 THEN 'fail' WHEN tr > 0.02 THEN 'warn' ELSE 'ok' END AS title_status, CASE WHEN dr > 0.1 THEN 'fail' WHEN dr > 0 THEN 'warn' ELSE 'ok' END AS date_status FROM c),
      t AS (SELECT *, CASE WHEN venue % 7 = 0 THEN 'fail' WHEN total = 0 THEN 'warn' WHEN 'fail' IN (title_status, date_status) THEN 'fail' WHEN 'warn' IN (title_status, date_status) THEN 'warn' ELSE 'ok' END AS status FROM s)
      SELECT venue, total, missing_title, missing_date, title_status, date_status, status, CASE WHEN status = 'fail' THEN 'warn' ELSE status END AS enforced FROM t""",
    "checked_texts": "WITH d AS (SELECT CASE WHEN doc_id % 10 = 0 OR (text = '' AND doc_id % 10 > 1) THEN 'EMPTY_RESULT' WHEN doc_id % 10 = 1 THEN 'UNDECODABLE' ELSE '' END AS reason FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) SELECT reason, count(*) AS n, (SELECT count(*) FROM d) AS rows_seen, (SELECT count(*) FROM d WHERE reason <> '') AS bad_seen FROM d GROUP BY 1",
    "refreshed_days": _EV + """, n AS (SELECT k, CASE WHEN k % 100 = 0 THEN a + 1 ELSE a END AS a, CASE WHEN k % 100 = 0 THEN b + 1 ELSE b END AS b FROM ev WHERE k % 101 <> 0),
      od AS (SELECT * FROM (SELECT k, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM ev) WHERE day BETWEEN DATE '1997-06-15' AND DATE '1999-06-15'),
      nd AS (SELECT * FROM (SELECT k, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM n) WHERE day BETWEEN DATE '1997-06-15' AND DATE '1999-06-15'),
      touched AS (SELECT day FROM od WHERE k % 100 = 0 OR k % 101 = 0 UNION SELECT day FROM nd WHERE k % 100 = 0),
      o2 AS (SELECT day, lag(day) OVER (ORDER BY day) AS p, lead(day) OVER (ORDER BY day) AS x FROM (SELECT DISTINCT day FROM od)),
      n2 AS (SELECT day, lag(day) OVER (ORDER BY day) AS p, lead(day) OVER (ORDER BY day) AS x FROM (SELECT DISTINCT day FROM nd)),
      every AS (SELECT day FROM touched UNION SELECT n2.day FROM n2 LEFT JOIN o2 USING (day) WHERE n2.p IS DISTINCT FROM o2.p OR n2.x IS DISTINCT FROM o2.x)
      SELECT day, count(k) AS n_events FROM every LEFT JOIN nd USING (day) GROUP BY 1""",
    "queue_reach": """WITH RECURSIVE l AS (SELECT l_orderkey AS src, l_partkey % 97 * 32 + l_linenumber AS dst, (l_linenumber * 10000 + l_partkey % 97 * 32 + l_linenumber)::INT AS place FROM lineitem),
      q AS (SELECT 1::BIGINT AS node, 0 AS depth, [0]::INT[] AS path UNION ALL SELECT dst, depth + 1, list_append(path, place) FROM (SELECT l.dst, q.depth, q.path, l.place, row_number() OVER (PARTITION BY l.dst ORDER BY q.path, l.place) AS nth FROM q JOIN l ON l.src = q.node WHERE q.depth < 5) WHERE nth = 1),
      f AS (SELECT node, depth, path FROM q QUALIFY row_number() OVER (PARTITION BY node ORDER BY depth, path) = 1)
      SELECT node::VARCHAR AS node, row_number() OVER (ORDER BY depth, path) - 1 AS place FROM f QUALIFY row_number() OVER (ORDER BY depth, path) <= 60""",
    "linked_texts": "SELECT p_partkey, concat('at ', p_name, ' |[https://x.jp/', p_partkey, ']|).| or |[https://y.jp/?q=', p_partkey, ']|', CASE WHEN p_partkey % 2 = 0 THEN '、' ELSE ' end' END) AS parts, (4 + length(p_name))::INT AS first, (4 + length(p_name) + 13 + length(p_partkey::VARCHAR) + 2 + 4 + 16 + length(p_partkey::VARCHAR) + (p_partkey % 2 = 0)::INT)::INT AS last FROM part",
    "day_events_ja": _EV + " SELECT k AS o_orderkey, a AS date_from, ['あ', 'ア', 'か', 'が', '漢', 'b', 'A'][(k % 7) + 1] AS title FROM ev WHERE a IN (DATE '1998-06-15', DATE '1998-06-16') ORDER BY a, [3, 4, 5, 6, 7, 2, 1][(k % 7) + 1], k",
    "today_events": _EV + " SELECT k AS o_orderkey, concat(o_orderpriority, ' ', lpad(k::VARCHAR, 12, '0')) AS title FROM ev WHERE DATE '1998-06-15' BETWEEN a AND b ORDER BY title LIMIT 5",
    "table_month_events": _EV + " SELECT concat('https://v.jp/', o_custkey, '/') AS source_url, concat('M ', k) AS title, make_date(1998, 7, day(a))::VARCHAR AS date_from, '18:30' AS start_time, CASE WHEN k % 2 = 0 THEN '無料' ELSE '500円' END AS price, '館' AS venue_name, '会場: 小\nお問合せ先: 088' AS body FROM ev WHERE month(a) = 7",
    "entry_events": _EV + " SELECT concat('https://v.jp/n/', k) AS source_url, CASE WHEN k % 2 = 0 THEN concat('T & ', k) ELSE concat('L ', k) END AS title, a::VARCHAR AS date_from, '09:05' AS start_time, '1 円' AS price, '館' AS venue_name FROM ev WHERE k % 4 > 0",
    "labelled_events": _EV + " SELECT concat('https://v.jp/', o_custkey, '/') AS source_url, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY k) = 1 THEN concat('B ', k) ELSE concat('B ', k) END AS title, a::VARCHAR AS date_from, CASE WHEN k % 2 = 0 THEN '09:30' ELSE '18:00' END AS start_time, '一般 1,000円' AS price FROM ev",
    "linked_page_events": _EV + " SELECT concat('https://v.jp/event/', k, '/') AS source_url, concat('C', k) AS title, a::VARCHAR AS date_from FROM ev WHERE a >= DATE '1998-05-01' AND a < DATE '1998-09-01'",
    "sheet_events": _EV + " SELECT concat('https://v.jp/', o_custkey) AS source_url, concat('S, ', k) AS title, make_date(1998, 7, day(a))::VARCHAR AS date_from, CASE WHEN k % 2 = 0 THEN '10:00' ELSE '09:00' END AS start_time, CASE WHEN k % 2 = 0 THEN '12:00' ELSE '17:00' END AS end_time, CASE WHEN k % 2 = 0 THEN '館（主競技場・補助競技場）' ELSE '館（主競技場）' END AS venue_name FROM ev WHERE month(a) = 7",
}
