"""Listings of each shape on small hand-made pages."""

import datetime as dt

import pytest

from dayboard.operators.stats import InvalidEvents
from dayboard.plans import venues as V

DAY = dt.date(2026, 11, 26)


def pages(spark, *rows):
    return spark.createDataFrame([*rows, ("https://v.jp/none", None), ("https://v.jp/empty", "")], "url string, html string")


def got(df, *columns):
    assert df.columns == V.COLUMNS
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_listing(spark):
    p = pages(spark, ("https://v.jp/list/", "<a href='/e/1'>春の <b>会</b> 2026年3月1日</a><a href='e2'>undated</a><a class=x href=\"e3\">C 2026/4/5</a>"))
    assert got(V.listing(p, DAY), "source_url", "title", "date_from", "date_to") == [("https://v.jp/e/1", "春の 会 2026年3月1日", "2026-03-01", "2026-03-01"), ("https://v.jp/list/e3", "C 2026/4/5", "2026-04-05", "2026-04-05")]


def test_cards(spark):
    card = '<div class="event-wrap x"><a href="/e/{0}"></a><p class="event-name">A &amp; {0}</p><p>{1}</p><p class="event-time">9:30開場 10:00～12:00</p><span class="event-place1">大ホール</span><div class="event-info1">無料</div><div class="event-info2"></div></div>'
    p = pages(spark, ("https://v.jp/", card.format(1, "2026年12月3日") + card.format(2, "1/5") + card.format(3, "未定")))
    assert got(V.cards(p, DAY), "source_url", "title", "date_from", "open_time", "start_time", "end_time", "price", "venue_name") == [
        ("https://v.jp/e/1", "A & 1", "2026-12-03", "9:30", "10:00", "12:00", "無料", "大ホール"),
        ("https://v.jp/e/2", "A & 2", "2027-01-05", "9:30", "10:00", "12:00", "無料", "大ホール"),
    ]


def test_boxes(spark):
    box = '<div class="box" id=1><div class="mid">市 <i>場</i></div><dl><dt>開催日</dt><dd>{0}</dd><dt>営業時間</dt><dd>１０：３０～</dd></dl></div>'
    p = pages(spark, ("https://v.jp/", box.format("２０２６年１２月１日～２０２６年１２月３日") + box.format("未定")))
    assert got(V.boxes(p, DAY), "title", "date_from", "date_to", "start_time", "body") == [("市 場", "2026-12-01", "2026-12-03", "10:30", "対象: 制限なし\n会場: 不明")]


def test_cards_and_boxes_hold_nested_elements(spark):
    card = "<section class='x event-wrap'><div><div class='wrap'><a title='none'>n</a><a href=/e/1><img></a></div></div><p class='event-name'>A<div>not the name</div><p class='event-time big'>10:00～12:00<div class='event-info1'><div>500円</div>（税込）</div><p>2026/12/3</section>"
    p = pages(spark, ("https://v.jp/", f"<!-- {card} -->{card}<div class='event-wrap'><p class=event-name>B<p>2026/12/4</div>"))
    assert got(V.cards(p, DAY), "source_url", "title", "date_from", "start_time", "price") == [("https://v.jp/e/1", "A", "2026-12-03", "10:00", "500円 （税込）".replace(" ", ""))]
    box = "<div id=1 class='box wide'><div><div class='mid'><div>市</div>場</div><dl><dt><b>開催日</b></dt><dd><div>2026年12月1日</div>～<div>2026年12月3日</div></dd><dt>対象<dd>子</dl></div></div>"
    p = pages(spark, ("https://v.jp/", box + "<div class=boxes><div class=mid>no</div></div>"))
    assert got(V.boxes(p, DAY), "title", "date_from", "date_to", "body") == [("市場", "2026-12-01", "2026-12-03", "対象: 子\n会場: 不明")]


def test_labelled_blocks(spark):
    p = pages(spark, ("https://v.jp/", "ホーム<br>春の会​<br>と き : 2026年 3月 1日 開演 9：05<br>一般 1,200円<br>秋の会<br>とき: 2026年10月2日<br>"))
    assert got(V.labelled_blocks(p), "title", "date_from", "start_time", "price") == [("春の会", "2026-03-01", "09:05", "一般 1,200円"), ("秋の会", "2026-10-02", None, None)]


def test_month_tables(spark):
    row = "<tr><td>{0}</td><td>{1}</td><td>088-1</td><td>無料</td></tr>"
    p = pages(spark, ("https://v.jp/2", '<div class="month">2月</div><div class="stitle"><h3>小ホール</h3></div><table><tr><td>日時</td><td>催し物</td></tr>' + row.format("5（木）～7（土） 18:30", "劇") + row.format("28(土)～30(月)", "絵") + row.format("毎日", "x") + "</table>"))
    assert got(V.month_tables(p, DAY, "館"), "title", "date_from", "date_to", "start_time", "price", "body") == [
        ("劇", "2027-02-05", "2027-02-07", "18:30", "無料", "会場: 小ホール\nお問合せ先: 088-1"),
        ("絵", "2027-02-28", "2027-02-28", None, "無料", "会場: 小ホール\nお問合せ先: 088-1"),
    ]


def test_calendar(spark):
    cell = '<td><div class="daily"><a href="/d/20261203/">3</a></div>{0}</td>'
    event = '<div class="event"><a href="{0}">{1}</a></div>'
    p = pages(spark, ("https://v.jp/m/", cell.format(event.format("/e/1", "劇") + event.format("/e/0", "休館日") + event.format("/e/2", "劇") + event.format("/e/3", "絵"))))
    d = pages(spark, ("https://v.jp/e/2", "<table><tr><th>日時</th><td>開場17:30 開演18:00</td></tr><tr><th>開催場所</th><td>大</td></tr><tr><th>入場料等</th><td>500円</td></tr></table>"))
    assert got(V.calendar(p, d), "title", "source_url", "date_from", "start_time", "price", "body") == [("劇", "https://v.jp/e/2", "2026-12-03", "18:00", "500円", "会場: 大"), ("絵", "https://v.jp/e/3", "2026-12-03", None, None, None)]


def test_entries_with_details(spark):
    item = '<li class="c-entries__item"><a href="{0}"><h3>{1}</h3></a></li>'
    p = pages(spark, ("https://v.jp/", item.format("https://v.jp/1", "a") + item.format("https://v.jp/2", "b") + item.format("https://v.jp/3", "c")))
    d = pages(spark, ("https://v.jp/1", '<h1 class="x entry-title">劇</h1><table><tr><td>開催日</td><td>1月5日</td></tr><tr><td>開催時間</td><td>9：30</td></tr></table>'), ("https://v.jp/2", "<table><tr><td>開催日</td><td>2月30日</td></tr></table>"))
    assert got(V.entries_with_details(p, d, DAY, "館"), "title", "date_from", "start_time", "venue_name") == [("劇", "2027-01-05", "09:30", "館")]


def test_sheet(spark):
    text = ["12 月 行 事,,", "日,曜,行事名,主,補,x,y", "3,木,剣道,9:00～12:00,13:00～15:00,,", ",,,13:00～17:00,,,", "x,y", "31,日,柔道,,,,10:00～11:00", "1月行事,,", "31,日,,,,,", "32,日,卓球,9:00～10:00,,,"]
    lines = spark.createDataFrame([("https://v.jp", n, x) for n, x in enumerate(text)], "url string, n long, line string")
    assert got(V.sheet(lines, DAY, "館"), "title", "date_from", "start_time", "end_time", "venue_name") == [
        ("剣道", "2026-12-03", "13:00", "17:00", "館（主競技場）"),
        ("柔道", "2026-12-31", "10:00", "11:00", "館（補助競技場）"),
    ]


def test_finalize(spark):
    p = pages(spark, ("https://v.jp/list/", "<a href='/e/1'>春 2026年3月1日</a>"))
    out = V.finalize(V.listing(p, DAY), lambda df: df.withColumnRenamed("title", "name"))
    assert out.first()["name"] == "春 2026年3月1日"
    with pytest.raises(InvalidEvents):
        V.finalize(V.listing(p.limit(0), DAY))
