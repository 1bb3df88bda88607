"""Pages, their data and links, and small rules of listings, compared whole with hand-made ones."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from dayboard.functions import dates, extract, urls
from dayboard.operators import ranking, render, stats
from dayboard.sources import readers

DAY = dt.date(2026, 6, 13)


def days(spark, *rows):
    return spark.createDataFrame(list(rows), "day date, ord int, title string, url string, date_from date, date_to date, venue_id string, venue_name string, organizer string, performer string, price string")


def test_structured_data_of_a_day(spark):
    a = (DAY, 1, "劇 </script>", "https://x.jp/1", DAY, dt.date(2026, 6, 14), "h a", "Hall", "市", "劇団", "無料")
    b = (DAY, 0, "会", None, DAY, None, None, None, "", None, "無料（材料費100円）")
    c = (DAY, 2, "", "https://x.jp/3", DAY, None, None, None, None, None, None)
    got = render.day_data(days(spark, a, b, c, (DAY + dt.timedelta(1), *a[1:])), "https://v.jp").orderBy("day").collect()
    assert len(got) == 2 and "</script>" not in got[0].data
    listing, path = json.loads(got[0].data)
    assert listing == {
        "@context": "https://schema.org", "@type": "ItemList", "name": "2026-06-13のイベント", "numberOfItems": 2,
        "itemListElement": [
            {"@type": "ListItem", "position": 1, "item": {"@type": "Event", "name": "会", "startDate": "2026-06-13", "endDate": "2026-06-13", "url": "https://v.jp/date/2026-06-13/"}},
            {"@type": "ListItem", "position": 2, "item": {"@type": "Event", "name": "劇 </script>", "startDate": "2026-06-13", "endDate": "2026-06-14", "url": "https://x.jp/1", "location": {"@type": "Place", "name": "Hall", "url": "https://v.jp/spot/h%20a/"}, "organizer": {"@type": "Organization", "name": "市"}, "performer": {"@type": "PerformingGroup", "name": "劇団"}, "isAccessibleForFree": True}},
        ],
    }
    assert [(x["position"], x["name"], x["item"]) for x in path["itemListElement"]] == [(1, "トップ", "https://v.jp/"), (2, "日付一覧", "https://v.jp/date/"), (3, "2026-06-13", "https://v.jp/date/2026-06-13/")]


def test_front_page_links_days_with_events(spark):
    rows = spark.createDataFrame([(DAY + dt.timedelta(k),) for k in (-1, 1, 1, 3, 6, 7)], "day date")
    page = "<body><!-- DATE_NAV_START -->old<!-- DATE_NAV_END --></body>"
    link = lambda d, t: f'<a href="date/{d}/">{t}</a>'
    nav = "<nav>" + link("2026-06-14", "明日") + link("2026-06-14", "6/14") + link("2026-06-16", "6/16") + link("2026-06-19", "6/19") + '<a href="date/">日付一覧</a></nav>'
    assert render.front_page(page, rows, DAY) == f"<body><!-- DATE_NAV_START -->\n{nav}\n<!-- DATE_NAV_END --></body>"
    assert render.front_page("<body></body>", rows, DAY) is None
    assert render.day_links(rows.limit(0), DAY).first().html == '<nav><a href="date/">日付一覧</a></nav>'


def test_index_and_name_pages(spark):
    rows = days(spark, *[(DAY, k, f"t{k}<", None, DAY, None, None, None, None, None, None) for k in range(3)], (DAY - dt.timedelta(1), 0, "x", None, DAY, None, None, None, None, None, None))
    got = render.index_page(rows, 2, "https://v.jp").first()
    section = lambda d, body: f'<section><h2><a href="/date/{d}/">{d}</a></h2><ul>{body}</section>'
    assert (got.n_days, got.n_events) == (2, 4)
    assert got.html == '<!DOCTYPE html><html lang="ja"><head><title>日付別イベント一覧</title><link rel="canonical" href="https://v.jp/date/"></head><body><h1>日付別イベント一覧</h1><p>2日・4件</p>' + section("2026-06-12", "<li>x</li></ul>") + section("2026-06-13", "<li>t0&lt;</li><li>t1&lt;</li></ul><p>ほか1件</p>") + "</body></html>"
    assert render.index_page(rows.limit(0), 2, "https://v.jp").first().n_events == 0
    venues = spark.createDataFrame([("1", "あさひ"), ("2", "あお"), ("3", "bar"), ("4", "Bär & Co"), ("5", " "), ("6", None)], "id string, name string")
    pages = {r.initial: (r.n_venues, r.html) for r in render.name_pages(venues, "id", "name").collect()}
    assert pages == {"あ": (2, '<h1>あ</h1><ul><li><a href="/spot/2/">あお</a></li><li><a href="/spot/1/">あさひ</a></li></ul>'), "B": (2, '<h1>B</h1><ul><li><a href="/spot/3/">bar</a></li><li><a href="/spot/4/">Bär &amp; Co</a></li></ul>')}


def test_linked_card(spark):
    cards = spark.createDataFrame([(3, "劇", "大"), (1, " 劇 ", "小"), (2, "劇\n", "大"), (4, None, None)], "ord int, title string, venue string")
    found = lambda t, v: [r.ord for r in ranking.linked_card(cards, "title", "venue", t, v, "ord").collect()]
    assert found("劇", "") == [1] and found(" 劇", "大 ") == [2] and found("劇", "中") == [] and found("x", None) == [] and found(" ", "") == [] and found("劇", None) == [1]


@pytest.mark.parametrize("url,want", [("https://v.jp/spot/a-1/", "a-1"), ("/spot/b", "b"), ("https://v.jp/spot/?spot_id=c%20d", "c d"), ("https://v.jp/spot/a/?x=1&spot_id=e#f", "e"), ("https://v.jp/spot/", ""), ("https://v.jp/x/spot/a/", ""), ("https://v.jp/spot/a?spot_id=", "a"), ("", "")])
def test_spot_ids(one, url, want):
    assert one(urls.spot_id(F.lit(url))) == want


def test_pages_of_a_sitemap(spark):
    html = "<meta name='robots' content='x, NOINDEX'>"
    rows = spark.createDataFrame([("index.html", "<p>"), ("spot/index.html", ""), ("spot/a/index.html", None), ("google0a-b.html", ""), ("x/google1.html", ""), ("d.html", html), ("e.html", "noindex")], "path string, html string")
    assert sorted(r.path for r in readers.listed_pages(rows).collect()) == ["e.html", "index.html", "spot/a/index.html", "x/google1.html"]


@pytest.mark.parametrize("text,want", [("2026-02-30", "2026-03-02"), ("2026-06-13", "2026-06-13"), (" 2026-06-13 ", "2026-06-13"), ("2026-06", "2026-06-01"), ("2026", "2026-01-01"), ("2026-13-01", None), ("2026-06-32", None), ("2026-6-1", None), ("x", None), ("", None), (None, None)])
def test_lenient_days(one, text, want):
    got = one(dates.lenient_day(F.lit(text).cast("string")))
    assert (str(got) if got else None) == want


def test_introductions(one):
    say = lambda n, m, c: one(extract.introduction(*(F.lit(x).cast("string") for x in (n, m, c))))
    whole = say("館", "高松市", "ホール")
    assert whole.startswith("館は、高松市にあるホールスポットです。イベントや施設利用の立ち寄り先として訪れやすい場所です。\n高松市周辺での外出や用事") and whole.endswith("つかみやすくなります。") and len(whole) <= 300
    assert say(None, "", None).startswith("名称不明は、イベント施設スポットです。") and "周辺での" not in say("a", None, "b")
    full = len(whole) - len("館")
    assert say("館" * (300 - full), "高松市", "ホール").endswith("つかみやすくなります。")
    assert say("館" * (301 - full), "高松市", "ホール").endswith("おすすめです。")
    assert say("館" * 400, "高松市", "ホール").endswith("つかみやすくなります。")
    tell = lambda *x: one(extract.summary(*(F.lit(v).cast("string") for v in x)))
    assert tell("ホール", "香川県", "高松市", "t") == "ホール / 香川県 高松市" and tell(None, "香川県", "", None) == "香川県"
    assert tell("", None, "", "あ" * 31) == "あ" * 30 + "…" and tell(None, None, None, "あ" * 30) == "あ" * 30 and tell(None, None, None, "") == "詳細は下部カードをご覧ください"


def test_report_latest_and_counts(spark):
    rows = spark.createDataFrame([("long-name.json", 12345678, 7), ("b", 3, None)], "file string, before long, after long")
    got = [r.line for r in stats.report(rows, "file", ["before", "after"]).collect()]
    assert got == ["file           |   before | after", "---------------+----------+------", "b              |        3 |      ", "long-name.json | 12345678 |     7"]
    assert stats.latest(rows, "before") == 12345678 and stats.latest(rows.limit(0), "before") == 0
    assert stats.problem_count(rows, rows.limit(1)) == 3
