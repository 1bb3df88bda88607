"""The common path on documents of the shape of a published set: 45 events of eight venues, 449 event-days."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dayboard.functions import tags
from dayboard.plans import listing
from dayboard.schema import RAW_EVENT, VENUE_DOCUMENT
from dayboard.streaming.arrivals import landed_events

AS_OF = dt.date(2026, 6, 13)

#: Venue, whether all its events have the address of the list page, and the events' first days with their lengths.
SHAPE = [
    ("a-hall", False, [("06-20", 1), ("06-21", 1)]),
    ("plaza", False, [("06-19", 3), ("06-01", 30), ("06-10", 5), ("06-13", 9), ("06-17", 1), ("04-29", 1)]),
    ("h-hall", False, [("06-21", 1), ("08-16", 1), ("09-21", 1), ("09-23", 1)]),
    ("fair", False, [("08-30", 1), ("08-29", 1), ("08-01", 2), ("06-20", 1), ("06-21", 1), ("06-13", 1), ("06-14", 1), ("06-06", 1), ("06-06", 1), ("06-04", 1)]),
    ("port", False, [("07-28", 1), ("09-20", 1), ("08-22", 1), ("07-14", 1), ("06-27", 1), ("05-09", 1), ("04-07", 1)]),
    ("centre", True, [("05-01", 1), ("08-01", 2), ("07-14", 2), ("06-17", 1), ("05-20", 1), ("02-08", 2), ("02-06", 3)]),
    ("town", True, [("05-31", 1), ("06-07", 1), ("07-05", 1), ("08-30", 1)]),
    ("museum", True, [("04-04", 86), ("07-04", 86), ("09-30", 89), ("2027-01-05", 83), ("2027-03-13", 16)]),
]


def documents():
    for venue, shared, events in SHAPE:
        rows = []
        for k, (day, length) in enumerate(events):
            first = dt.date.fromisoformat(day if len(day) > 5 else f"2026-{day}")
            event = {"title": f"{venue} {k}", "date_from": str(first), "date_to": str(first + dt.timedelta(length - 1)), "source_url": f"https://{venue}.jp/" + ("" if shared else str(k))}
            rows.append(event)
        yield venue, rows


def frame(spark):
    schema = StructType([*VENUE_DOCUMENT.fields, StructField("file_name", StringType())])
    names = [f.name for f in RAW_EVENT.fields]
    rows = [(v, None, None, None, [tuple(e.get(n) for n in names) for e in events], f"{v}.json") for v, events in documents()]
    return spark.createDataFrame(rows, schema)


def test_every_event_reaches_its_days(spark):
    silver = listing.silver_events(frame(spark), as_of=AS_OF)
    assert silver.count() == 45
    days = listing.gold_days(silver, as_of=AS_OF)
    assert days.count() == 449
    pages = listing.day_pages(days, as_of=AS_OF)
    assert pages.agg(F.sum("n_events")).first()[0] == 449
    by_venue = dict(days.groupBy("venue_id").agg(F.countDistinct("title")).collect())
    assert by_venue == {v: len(e) for v, _, e in SHAPE}


def test_stream_keeps_events_that_share_an_address(spark, tmp_path):
    import json

    for v, rows in documents():
        (tmp_path / f"{v}.json").write_text(json.dumps({"venue_id": v, "last_success_at": "2026-06-01T00:00:00Z", "events": [*rows, {**rows[0], "source_url": None}, {**rows[0], "source_url": None, "title": "other"}, rows[0]]}))
    q = landed_events(spark, str(tmp_path)).writeStream.format("memory").queryName("shared_addresses").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("shared_addresses").count() == 45 + 2 * len(SHAPE)


#: Titles in the forms that listings have, with their tags: type, genres, flags; prices, starts and days where they matter.
TAGGED = [
    ("古楽の旋律～歌曲の夕べ～ コンサート", None, "19:00", "2026-06-20", "performance", ["music"], ["night", "weekend"]),
    ("レクチャーコンサート「歌劇」", None, "13:30", "2026-06-21", "performance", ["music"], ["weekend"]),
    ("6月ポイント３倍デー♪", None, None, "2026-06-19", "other", [], []),
    ("梅雨のハッピーフェア", None, None, "2026-06-01", "business", [], []),
    ("TAX FREE SHOP", None, None, "2026-04-29", "other", [], []),
    ("独奏 ピアノ・リサイタル", None, None, "2026-08-16", "performance", ["music"], ["weekend"]),
    ("人形劇「あれこれ」", None, None, "2026-09-23", "other", [], []),
    ("第10回 青空市場", "無料", "10:00", "2026-08-30", "festival", ["food"], ["free", "weekend"]),
    ("BIG LOVE FES", "男性6,900円", "18:00", "2026-08-29", "other", [], ["paid", "night"]),
    ("花火観覧席", "大人6,000円 ※3歳未満の方は無料", "19:00", "2026-08-01", "other", ["nature"], ["free", "paid"]),
    ("おでかけライブ", "有料 900円", "11:30", "2026-06-21", "performance", ["music"], ["paid", "weekend"]),
    ("中古車展示即売会", "無料", "10:00", "2026-06-12", "exhibition", [], ["free"]),
    ("インターンシップ＆キャリア発見フェア 松山会場", "無料", "13:00", "2026-06-06", "lecture", ["nature", "business"], ["free", "weekend"]),
    ("進学フェア 松山会場", "無料", "10:00", "2026-06-04", "business", ["nature"], ["free"]),
    ("夏休みこども体験教室", None, None, "2026-07-28", "workshop", ["kids"], ["family"]),
    ("街の音楽祭2026", None, None, "2026-09-20", "festival", ["music"], ["weekend"]),
    ("第5回 高知市夏季大学", None, "18:30", "2026-07-14", "festival", [], ["night"]),
    ("いきいき講座", None, "13:30", "2026-04-07", "lecture", [], []),
    ("まちシネマ 上映会", "一般前売 1,000円", "10:00", "2026-05-31", "screening", ["theater", "local"], ["paid", "weekend"]),
    ("弾き語り LIVE 2026", "全席指定 5,000円", "16:00", "2026-08-30", "performance", [], ["paid", "weekend"]),
    ("第44回伝統漆芸展", None, None, "2027-03-13", "exhibition", ["culture"], ["weekend"]),
]


def test_tags_of_listed_titles(spark):
    rows = spark.createDataFrame([t[:4] for t in TAGGED], "title string, price string, start string, day string")
    text = tags.search_text(F.col("title"), F.lit(None).cast("string"))
    got = rows.select("title", tags.event_type(F.col("title"), F.lit(None).cast("string")).alias("type"), tags.genres(text).alias("genres"), tags.flags(text, F.col("price"), F.col("start"), F.lit(None).cast("string"), F.col("day"), F.col("day")).alias("flags")).collect()
    assert {r.title: (r.type, r.genres, r.flags) for r in got} == {t[0]: t[4:] for t in TAGGED}
