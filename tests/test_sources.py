"""Extractors of single sources on small hand-made pages."""

import datetime as dt
import json

import pytest

from dayboard.plans import sources as S
from dayboard.plans import venues as V

DAY = dt.date(2026, 11, 26)


def pages(spark, *rows):
    return spark.createDataFrame([*rows, ("https://v.jp/none", None), ("https://v.jp/empty", "")], "url string, html string")


def got(df, *columns):
    assert df.columns == V.COLUMNS
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_date_rows(spark):
    row = '<tr><td><img src="/i.png"></td><td class="title_link"><a href="{0}">劇 <b>{0}</b></a></td><td class="date">{1}</td></tr>'
    p = pages(spark, ("https://v.jp/list/x", "<tbody>" + row.format("/a", "<p>2026年12月01日</p><p>2026年12月05日～2026年12月03日</p>") + row.format("https://w.jp/b", "未定<br>2027年01月02日") + row.format("/c", "2026年2月1日") + "</tbody>"))
    d = pages(spark, ("https://v.jp/a", '<div class="text-beginning">本文<h3><strong>日時</strong></h3><p>開場／午後1時（x） 開演／午後1時30分</p></div>'))
    out = S.date_rows(p, d, "館")
    assert got(out, "source_url", "title", "date_from", "date_to", "open_time", "start_time", "body", "image_url") == [
        ("https://v.jp/a", "劇 /a", "2026-12-01", "2026-12-01", "13:00", "13:30", "開催分: 2026年12月01日", "https://v.jp/i.png"),
        ("https://v.jp/a", "劇 /a", "2026-12-03", "2026-12-05", "13:00", "13:30", "開催分: 2026年12月05日～2026年12月03日", "https://v.jp/i.png"),
        ("https://w.jp/b", "劇 https://w.jp/b", "2027-01-02", "2027-01-02", None, None, "開催分: 2027年01月02日", "https://v.jp/i.png"),
    ]


def test_windowed_links(spark):
    gap = "x" * 2100
    p = pages(spark, ("https://v.jp/event/?method=list", '<a href="/event/event-1/">詳細を見る</a><h3>開催日: 春の会 開催日：あり</h3>２０２６年１２月１日' + gap + '<a href="/event/event-2/">秋の会</a> 2026年12月9日' + gap + '<a href="/event/event-3/">more</a>' + gap + '<a href="/event/">一覧</a><a href="/event/event-2/">また</a>'))
    table = '<table class="x eventTable"><tr><th>開催日</th><td>2026年12月2日～2026年12月4日</td></tr><tr><th>時間</th><td>9：30～</td></tr><tr><th>会場</th><td>大</td></tr><tr><th>料金</th><td>500円</td></tr><tr><th>お問合せ</th><td>こちら</td></tr></table>'
    d = pages(spark, ("https://v.jp/event/event-1/", table + '<article><img src="/p.png"></article>'), ("https://v.jp/event/event-2/", '<div class="entry-content">本文</div>'), ("https://v.jp/event/event-3/", "x"))
    assert got(S.windowed_links(p, d), "source_url", "title", "date_from", "date_to", "start_time", "price", "contact", "description", "image_url") == [
        ("https://v.jp/event/event-1/", "春の会", "2026-12-02", "2026-12-04", "09:30", "500円", None, "会場: 大", "https://v.jp/p.png"),
        ("https://v.jp/event/event-2/", "秋の会", "2026-12-09", "2026-12-09", None, None, None, "本文", None),
    ]


def test_event_posts(spark):
    post = lambda n, first, **g: {"title": {"rendered": f"劇 &amp; <b>{n}</b>"}, "link": f"https://v.jp/{n}", "acf": {"start_date": first, "end_date": "", "detail_group": g}}
    body = json.dumps([post(1, "2026-11-01", e_start="９：００", e_start2="9:30", e_price=" 500円 "), post(2, "2027-05-31"), post(3, "2027-06-01"), post(4, "2026-10-31"), post(5, "20261201")])
    posts = spark.createDataFrame([("u", body), ("v", "[]"), ("w", None)], "url string, body string")
    d = pages(spark, ("https://v.jp/1", "終演 12:00"), ("https://v.jp/2", "<p>開場</p><b> 17:00</b> 開始<i> 18:00</i>終了 20:00"))
    assert got(S.event_posts(posts, d, DAY), "source_url", "title", "date_from", "date_to", "open_time", "start_time", "end_time", "price") == [
        ("https://v.jp/1", "劇 & 1", "2026-11-01", "2026-11-01", "09:00", "09:30", None, "500円"),
        ("https://v.jp/2", "劇 & 2", "2027-05-31", "2027-05-31", "17:00", "18:00", "20:00", None),
    ]


def test_term_details(spark):
    p = pages(spark, ("https://v.jp/l", "https://v.jp/events/event/1/ x <a href='https://v.jp/events/event/2/'> https://v.jp/events/event/1/"))
    d = pages(spark, ("https://v.jp/events/event/1/", '<h1>祭</h1><dl class="list"><dt>開催日</dt><dd>2026/12/01 ～ 2026/12/03</dd><dt>開催時間</dt><dd>9:00～10:30</dd></dl><div class="post_content">文<img src="a.png"></div>'), ("https://v.jp/events/event/2/", "<h1>x</h1>"), ("https://v.jp/events/event/3/", "<h1>x</h1>"))
    assert got(S.term_details(p, d, r"https://v\.jp/events/event/\d+/", "館"), "source_url", "title", "date_from", "date_to", "start_time", "end_time", "venue_name", "description", "image_url") == [("https://v.jp/events/event/1/", "祭", "2026-12-01", "2026-12-03", "9:00", "10:30", "館", "文", "a.png")]


def test_list_cards(spark):
    card = '<li class="card_list"><a href="/n/{0}"><div class="detail_name">市 {0}</div>{1}</a></li>'
    p = pages(spark, ("https://v.jp/n", card.format(1, '<span class="date_start">12月1日</span><span class="date_start">12月<b>3日</b></span>') + card.format(2, "") + card.format(3, '<span class="date_start">1月5日</span>')))
    d = pages(spark, ("https://v.jp/n/1", '<div class="p-news-detail__thumb"><img src="/t.png"></div><div class="p-news-detail__content">本<b>文</b></div>'))
    assert got(S.list_cards(p, d, DAY), "source_url", "title", "date_from", "date_to", "body", "description", "image_url") == [
        ("https://v.jp/n/1", "市 1", "2026-12-01", "2026-12-03", "開催期間: 12月1日〜12月3日", "本文", "https://v.jp/t.png"),
        ("https://v.jp/n/3", "市 3", "2026-01-05", "2026-01-05", "開催期間: 1月5日", None, None),
    ]


def test_dated_text(spark):
    p = pages(spark, ("https://v.jp/", "前 12/1 (火) 行事：剣道 大会 施設 主道場 主催・主管 県 <br>1/5(火)<b>休館日</b> 1/6(水) 柔道：TEL 1 1/6(水) 柔道 施設 副道場"))
    assert got(S.dated_text(p, DAY), "title", "date_from", "description", "contact") == [("剣道 大会", "2026-12-01", "会場: 主道場", "県"), ("柔道", "2027-01-06", "会場: 副道場", None)]


def test_exhibitions(spark):
    show = '<li class="exhibition-item"><a href="{0}"><h3>{1}</h3></a><p class="post-term">{2}</p></li>'
    item = '<a class="event-item" href="{0}"><h2 class="event-item__title">{1}</h2><p class="post-term">{2}</p></a>'
    shows = pages(spark, ("https://v.jp/exhibition/", show.format("/x/1", "海展", "2026年12月1日（火）～2027年1月5日") + show.format("/x/1", "again", "2026年12月1日") + show.format("/x/2", "山展", "2026-12-02") + show.format("/x/3", "無", "未定")))
    lists = pages(spark, ("https://v.jp/event", item.format("/event/info/9", "海展", "2026年12月1日<br>2027年1月5日") + item.format("/event/info/8", "話", "２０２６年１２月４日") + item.format("/event/info/7", "古", "2025年11月25日") + item.format("/event/info/6", "際", "2025年11月26日")))
    d = pages(spark, ("https://v.jp/x/1", "<dt>開館時間</dt><dd>9:40～18:00</dd><dt>会場</dt><dd>本館</dd><dt>料金</dt><dd><table><tr><th>一般</th> <td> 800円 </td></tr></table></dd>"), ("https://v.jp/x/2", "<dt>料金</dt><dd>無料</dd>"))
    assert got(S.exhibitions(shows, lists, d, DAY, "館"), "title", "source_url", "date_from", "date_to", "start_time", "end_time", "price", "venue_name") == [
        ("山展", "https://v.jp/x/2", "2026-12-02", "2026-12-02", None, None, "無料", "館"),
        ("海展", "https://v.jp/event/info/9", "2026-12-01", "2027-01-05", "09:40", "18:00", "800円", "館 本館"),
        ("話", "https://v.jp/event/info/8", "2026-12-04", "2026-12-04", None, None, None, "館"),
        ("際", "https://v.jp/event/info/6", "2025-11-26", "2025-11-26", None, None, None, "館"),
    ]


def test_headed_section(spark):
    p = pages(spark, ("https://v.jp/e/", "<a href=x>2026.1.1 前</a><h2>開催予定の<b>自主事業</b></h2><a href='/1'>2026.12.5（土）　冬の 会</a><a href='2'>2026年12月6日 鐘</a><a href='3'>未定</a><h3>小</h3><a href='/4'>会 2026/12/7(月)</a><h2>開催終了</h2><a href='/5'>2026.12.8 後</a>"))
    assert got(S.headed_section(p, "自主事業", ["お預かりチケット", "開催終了"]), "source_url", "title", "date_from") == [("https://v.jp/1", "冬の 会", "2026-12-05"), ("https://v.jp/4", "会", "2026-12-07"), ("https://v.jp/e/2", "鐘", "2026-12-06")]


def test_described_posts(spark):
    p = pages(spark, ("https://v.jp/event/", "".join(f'<a href="/event/{n}/">x</a>' for n in (1, 2, 3, 1))))
    post = '<h3 class="h3_title01 a">{0}</h3><dl class="dl_postevent"><dt>イベント開催期間</dt><dd>{1}</dd>{2}</dl>'
    d = pages(spark, ("https://v.jp/event/1/", post.format("市", "２０２６年１２月３０日〜１月２日", "<dt>時間</dt><dd>9：00〜17:00</dd><dt>入場料</dt><dd>無料</dd>")), ("https://v.jp/event/2/", post.format("祭", "2026年12月1日", "")), ("https://v.jp/event/3/", post.format("遠", "2027年11月27日", "")), ("https://v.jp/event/4/", post.format("無", "2026年12月1日", "")))
    assert got(S.described_posts(p, d, DAY), "source_url", "title", "date_from", "date_to", "start_time", "end_time", "price", "body") == [
        ("https://v.jp/event/1/", "市", "2026-12-30", "2027-01-02", "09:00", "17:00", "無料", None),
        ("https://v.jp/event/2/", "祭", "2026-12-01", "2026-12-01", None, None, None, "祭   イベント開催期間  2026年12月1日"),
    ]


def test_mixed_blocks(spark):
    link = '<a href="/event/07event/{0}.html">{1}</a>'
    p = pages(spark, ("https://v.jp/k/", "<li>" + link.format(1, "展 示") + " 2026年12月1日（火）〜12月5日</li><tr>" + link.format(2, "話") + "１２月９日</tr><div class='x event'>" + link.format(3, "逆") + "2026年12月9日-12月1日</div><li>" + link.format("07event", "一覧") + "12月1日</li><li>" + link.format(4, "昔") + "10月1日</li>"))
    assert got(S.mixed_blocks(p, DAY, "/event/07event/", "/07event/07event.html"), "source_url", "title", "date_from", "date_to") == [
        ("https://v.jp/event/07event/1.html", "展 示", "2026-12-01", "2026-12-05"),
        ("https://v.jp/event/07event/2.html", "話", "2026-12-09", "2026-12-09"),
        ("https://v.jp/event/07event/3.html", "逆", "2026-12-09", "2026-12-09"),
    ]


def months(spark):
    return pages(
        spark,
        ("https://v.jp/event/", '<a href="/event/date/2026/12">次</a><a href="/event/date/2029/01/">遠</a><a href="/event/1/">一</a>'),
        ("https://v.jp/event/date/2026/12/", '<a href="../../../date/2027/1/?x=1">次</a><a href="/event/2/">二</a><a href="/event/feed/7/">f</a>'),
        ("https://v.jp/event/date/2027/01/", '<a href="/event/date/2026/12/">前</a><a href="/event/3/#a">三</a><a href="/event/3/"><img></a>'),
        ("https://v.jp/event/date/2029/01/", '<a href="/event/9/">九</a>'),
    )


def test_month_crawl(spark):
    d = pages(
        spark,
        ("https://v.jp/event/1/", "<p>イベント名：春の会</p><p>開催日</p><p>２０２６年１２月１日</p><p>開場１７：００ 開演 18:00</p><p>入場料　500円</p><p>電話 ０８９-111-2222</p>"),
        ("https://v.jp/event/2/", "<h2>秋 の会</h2><p>2026年12月2日</p>"),
        ("https://v.jp/event/3/", "<h2>x</h2>2026年12月3日"),
        ("https://v.jp/event/9/", "<h2>x</h2>2026年12月3日"),
    )
    assert got(S.month_crawl(months(spark), d, "https://v.jp/event/", DAY), "source_url", "title", "date_from", "open_time", "start_time", "price", "contact", "body") == [
        ("https://v.jp/event/1/", "春の会", "2026-12-01", "17:00", "18:00", "500円", "電話 089-111-2222", None),
        ("https://v.jp/event/2/", "秋 の会", "2026-12-02", None, None, None, None, "秋 の会 2026年12月2日"),
        ("https://v.jp/event/3/", "x", "2026-12-03", None, None, None, None, "x 2026年12月3日"),
    ]


def test_crawled_details(spark):
    d = pages(spark, ("https://v.jp/event/1/", "<h1>春</h1>2026/12/1 または 2026/12/2"), ("https://v.jp/event/2/", "<h1>undated</h1>"), ("https://v.jp/event/9/", "<h1>x</h1>2026/12/1"))
    assert got(S.crawled_details(months(spark), d, "https://v.jp/event/", DAY), "source_url", "title", "date_from") == [("https://v.jp/event/1/", "春", "2026-12-01")]


def test_anchor_blocks(spark):
    block = '<a name="no{0}"></a><td class="mainTit1">劇<br>{0}</td><td class="mainTit2">{1}<br>{2}</td><div class="mainTx0">一行 <b>目</b><br>{3}</div>'
    p = pages(spark, ("https://v.jp/i.html", "x" + block.format(1, "2026年12月5日・6日・1月2日", "アイレックス 大ホール", "二行目") + block.format(2, "12月5日", "アイレックス", "") + block.format(3, "2026年12月7日", "別館", "") + block.format(4, "2026年12月8日", "アイレックス", "公演は終了しました")))
    assert got(S.anchor_blocks(p, ["アイレックス"]), "source_url", "title", "date_from", "date_to", "venue_name", "body", "status") == [
        ("https://v.jp/i.html#no1", "劇 1", "2026-01-02", "2026-12-06", "アイレックス 大ホール", "一行 目\n二行目", "scheduled"),
        ("https://v.jp/i.html#no4", "劇 4", "2026-12-08", "2026-12-08", "アイレックス", "一行 目\n公演は終了しました", "finished"),
    ]


def test_day_objects(spark):
    event = "<span class='e_icon a'></span><a href='{0}'>{1}</a>{2}"
    value = event.format("/1", "劇", "開場 17:00 開演 18:00") + event.format("/2", "非公開", "") + event.format("/3", "点検", "休館") + event.format("/4", "", "")
    p = pages(spark, ("https://v.jp/c", f'<script>var event_detail = {{"2026/12/09": "<a href=\'/9\'>x</a>"}}; var e_icon = {{"2026/12/05": "{value}", "bad": "<a href=\'/0\'>x</a>", "2026/12/06": "<a href=\'6\'>話</a>",}};</script>'), ("https://v.jp/d", '<script>var event_detail = {"2026/12/09": "<a href=\'/9\'>絵</a>"};</script>'))
    assert got(S.day_objects(p), "source_url", "title", "date_from", "open_time", "start_time") == [("https://v.jp/1", "劇", "2026-12-05", "17:00", "18:00"), ("https://v.jp/6", "話", "2026-12-06", None, None), ("https://v.jp/9", "絵", "2026-12-09", None, None)]


def test_next_month_pages(spark):
    block = "<h4>―{0}</h4><p>{1}</p><p>入場料：500円</p><p>お問合せ</p><p>087-1</p>{2}"
    p = pages(
        spark,
        ("https://v.jp/1", "<a href='/2'>・来月の<b>イベント</b></a>" + block.format("劇", "2026年12月5日（土） 大ホール 開場17:00 18:00〜20:00", "<a href='/x'>x</a><a href='/d'>詳細</a>") + block.format("無", "未定", "")),
        ("https://v.jp/2", "<a href='/1'>翌月のイベント</a>" + block.format('<a href="/h">絵</a>', "2027年1月2日 小ホール 10:00", "") + block.format("絵", "2027年1月2日 小ホール 10:00", "")),
        ("https://v.jp/3", block.format("他", "2027年1月2日", "")),
    )
    assert got(S.next_month_pages(p, "https://v.jp/1"), "source_url", "title", "date_from", "venue_name", "open_time", "start_time", "end_time", "price", "contact") == [
        ("https://v.jp/d", "劇", "2026-12-05", "大ホール", "17:00", "18:00", "20:00", "500円", "087-1"),
        ("https://v.jp/h", "絵", "2027-01-02", "小ホール", None, "10:00", None, "500円", "087-1"),
    ]


@pytest.mark.parametrize("heading", ["<h2>特別展</h2>", "特別展<br>"])
def test_special_and_lines(spark, heading):
    page = heading + '<a href="/s/1">特別展 開催中 海</a><p>２０２６年１２月１日（火）から１月５日まで</p><a href="/s/2">単</a><p>2026年12月1日</p><h2>企画展</h2><p>企画展 山</p><p>2026年12月2日～2026年12月4日</p><p>特別展 海</p><p>2026年12月1日～2027年1月5日</p><p>常設展</p><p>2026年1月1日～12月1日</p>'
    assert got(S.special_and_lines(pages(spark, ("https://v.jp/m/", page))), "source_url", "title", "date_from", "date_to") == [("https://v.jp/m/", "企画展 山", "2026-12-02", "2026-12-04"), ("https://v.jp/s/1", "特別展 海", "2026-12-01", "2027-01-05")]
