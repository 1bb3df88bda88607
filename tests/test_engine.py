"""Operators, sources, sinks, the listing pipeline and the streaming extension on small inputs."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from dayboard.functions import values
from dayboard.operators import dedupe, events, graph, ranking, render, stats
from dayboard.plans import listing
from dayboard.sources import readers, writers

AS_OF = dt.date(2026, 11, 26)


@pytest.fixture()
def corpus(tmp_path):
    doc = {
        "venue_id": "hall", "venue_category": "文化ホール", "last_success_at": "2026-11-20",
        "events": [
            {"title": "ピアノ コンサート", "date_from": "2026-11-28", "date_to": "2026-11-29", "time_start": "18:30", "start_time": "", "price": "無料", "source_url": "https://x.jp/event/1/", "other": 1},
            {"title": "ピアノ コンサート 再", "date_from": "2026-12-01", "source_url": "https://x.jp/event/1/"},
            {"title": "古い展示", "date_from": "2025-01-01", "date_to": "2025-11-25", "source_url": "https://x.jp/event/2/"},
            {"title": "長期展示", "date_from": "2026-06-01", "date_to": "2028-01-01"},
        ],
    }
    (tmp_path / "hall.json").write_text(json.dumps(doc, ensure_ascii=False, indent=2), encoding="utf-8")
    (tmp_path / "noid.json").write_text(json.dumps({"events": [{"title": "市場", "date_from": "2026-11-26"}]}, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "template.json").write_text("{}")
    return str(tmp_path)


def test_pipeline(spark, corpus):
    docs = readers.latest_documents(readers.venue_documents(spark, corpus))
    silver = listing.silver_events(docs, as_of=AS_OF)
    rows = {r.title: r for r in silver.collect()}
    assert set(rows) == {"ピアノ コンサート", "ピアノ コンサート 再", "長期展示", "市場"}  # two of one address
    first = rows["ピアノ コンサート"]
    assert first.start_time == "18:30" and first.tags.type == "performance" and first.tags.flags == ["free", "night"]
    assert rows["市場"].venue_id == "noid" and rows["市場"].tags.type == "festival"
    days = listing.gold_days(silver, as_of=AS_OF)
    assert days.where("title = 'ピアノ コンサート'").count() == 2
    assert days.where("title = '長期展示'").count() == 1  # too long a range is its first day
    pages = {r.day: r for r in listing.day_pages(days, as_of=AS_OF).collect()}
    assert pages[dt.date(2026, 11, 28)].prev_day == dt.date(2026, 11, 26)
    assert pages[dt.date(2026, 6, 1)].noindex and not pages[dt.date(2026, 11, 28)].noindex


def test_write_and_read_back(spark, corpus, tmp_path):
    silver = listing.silver_events(readers.venue_documents(spark, corpus), as_of=AS_OF)
    out = str(tmp_path / "out")
    assert writers.write_events(silver, out)
    assert spark.read.json(out).count() == silver.count()
    assert not writers.write_events(silver.limit(0), out)
    assert spark.read.json(out).count() == silver.count()


@pytest.mark.parametrize("text, want", [("2025-11-25", "expired"), ("2025-11-26", "in_range"), ("", "missing_date"), ("2025-13-01", "invalid_date")])
def test_retention(one, text, want):
    assert one(events.retention_reason(F.lit(None).cast("string"), F.lit(text), AS_OF)) == want


def test_ranges(spark):
    d = dt.date
    rows = spark.createDataFrame([("a", d(2026, 1, 1), d(2027, 1, 1)), ("b", d(2026, 1, 1), d(2027, 1, 2)), ("c", d(2026, 1, 2), d(2026, 1, 1)), ("d", d(2026, 1, 1), None)], "k string, date_from date, date_to date")
    got = {r.k: r.date_to for r in events.sane_range(rows).collect()}
    assert got == {"a": d(2027, 1, 1), "b": d(2026, 1, 1), "d": d(2026, 1, 1)}


def test_survivors(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("a", 3, 2)], "k string, v int, o int")
    assert {tuple(r) for r in dedupe.keep_first(rows, ["k"], "o").collect()} == {("a", 1, 0), ("b", 2, 1)}
    assert {tuple(r) for r in dedupe.keep_last_at_first(rows, ["k"], "o").collect()} == {("a", 0, 3), ("b", 1, 2)}


def test_validation(spark):
    good = spark.createDataFrame([(0, "ab", "2026-01-01")], "o int, title string, date_from string")
    assert stats.require_valid(good, "o").count() == 1
    with pytest.raises(stats.InvalidEvents, match="row 0: title"):
        stats.require_valid(good.withColumn("title", F.lit("a")), "o")
    with pytest.raises(stats.InvalidEvents):
        stats.require_valid(good.limit(0), "o")


def test_bytes(spark):
    rows = spark.createDataFrame([(1, bytearray(gzip.compress("日本".encode("shift_jis")))), (2, bytearray(b"\xff\xff\xff")), (3, None)], "k int, body binary")
    got = {r.k: r.t for r in rows.select("k", readers.decode_bytes(F.col("body"), "shift_jis").alias("t")).collect()}
    assert got == {1: "日本", 2: None, 3: None}


def test_embedded_object(one):
    page = "<script>var x = {'2026/01/02': '<b class=\"e_icon\">}</b>',};</script>"
    found = readers.embedded_object(F.lit(page), "x")
    assert one(readers.relaxed_json_map(found)) == {"2026/01/02": '<b class="e_icon">}</b>'}


def test_carry_in_row(one):
    parts = F.array(*[F.struct(F.lit(y).cast("string").alias("y"), F.lit(m).cast("string").alias("m")) for y, m in ((None, None), ("2026", "1"), (None, "2"), (None, None))])
    assert [tuple(r) for r in one(ranking.carry_in_row(parts, ["y", "m"]))] == [(None, None), ("2026", "1"), ("2026", "2"), ("2026", "2")]


def test_html_tree_and_sitemap(spark, tmp_path):
    for p in ("a/index.html", "partials/x.html", ".hidden.html"):
        (tmp_path / "site" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "site" / p).write_text("<title>t</title>")
    assert readers.html_tree(spark, str(tmp_path / "site")).count() == 1
    rows = spark.createDataFrame([Row(category="date", loc="https://x/?a&b", lastmod=dt.date(2026, 1, 1))])
    writers.write_sitemap(rows, str(tmp_path / "map"))
    assert "a&amp;b" in spark.read.text(str(tmp_path / "map" / "category=date")).first()[0]


def test_stream_of_documents(spark, corpus):
    from dayboard.streaming.arrivals import landed_events

    q = landed_events(spark, corpus).writeStream.format("memory").queryName("landed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("landed").where("title like 'ピアノ%'").count() == 2


def test_search(spark):
    spots = spark.createDataFrame([(i, n) for i, n in enumerate(["Hall", "hall", None, "", "a hall", "hall b", "hall c", "hall d", "hall e"])], "id int, name string")
    assert [r.id for r in ranking.search(spots, "name", " hall ").orderBy("id").collect()] == [1, 4, 5, 6, 7, 8]
    assert ranking.search(spots, "name", " ").count() == 8
    assert [r.id for r in ranking.suggestions(spots, "name", "hall", "id").collect()] == [1, 4, 5, 6, 7]
    assert ranking.suggestions(spots, "name", " ", "id").count() == 0


def test_spot_pages(spark):
    spots = spark.createDataFrame([("a/b", "館 & 堂", None, None, None, "x" * 60), ("c", None, "公園", "愛媛県", "松山市", "短い。")], "spot_id string, name string, category string, prefecture string, municipality string, description string")
    rows = [("a/b", 1, "later", None, dt.date(2026, 2, 2), dt.date(2026, 2, 3)), ("a/b", 2, "first </script>", "u", dt.date(2026, 2, 1), None), ("a/b", 3, None, "v", None, None)]
    shows = spark.createDataFrame(rows, "spot_id string, ord int, title string, url string, date_from date, date_to date")
    a, c = render.spot_pages(spots, shows, "https://s").orderBy("spot_id").collect()
    assert (a.n_events, c.n_events) == (3, 0)
    data = json.loads(a.html.split("ld+json\">")[1].split("</script>")[0])
    assert [x["@type"] for x in data] == ["Place", "ItemList", "Event", "Event"]
    assert [(x["position"], x["name"], x["url"]) for x in data[1]["itemListElement"]] == [(1, "イベント名未定", "v"), (2, "first </script>", "u"), (3, "later", "https://s/spot/a%2Fb/")]
    assert [(x["startDate"], x["endDate"]) for x in data[2:]] == [("2026-02-01", "2026-02-01"), ("2026-02-02", "2026-02-03")]
    assert "<h1>館 &amp; 堂</h1>" in a.html and "<p>日程未定</p>" in a.html and "<p>2026-02-02〜2026-02-03</p>" in a.html
    assert "<h1>施設詳細</h1><p>現在公開中のイベント情報はありません。</p>" in c.html and 'content="短い。 公式サイト' in c.html
    assert len(json.loads(c.html.split("ld+json\">")[1].split("</script>")[0])) == 1


def test_strict_json(spark):
    df = spark.createDataFrame([('{"a": 1}',), (None,)], "t string")
    assert [r.v and r.v.a for r in df.select(values.require_json(F.col("t"), "a int").alias("v")).collect()] == [1, None]
    with pytest.raises(Exception, match="パース"):
        spark.createDataFrame([("{",)], "t string").select(values.require_json(F.col("t"), "a int").alias("v")).collect()


def test_pretty_json(spark, tmp_path):
    rows = [Row(venue_id="v", venue_name=None, ord=2, title='a "b"', tags=Row(type=None, genres=["x", "y"], flags=[])), Row(venue_id="v", venue_name=None, ord=1, title="あ", tags=None)]
    df = spark.createDataFrame(rows, "venue_id string, venue_name string, ord int, title string, tags struct<type:string,genres:array<string>,flags:array<string>>")
    want = {"venue_id": "v", "last_success_at": "2026-01-02", "events": [{"title": "あ", "tags": None}, {"title": 'a "b"', "tags": {"type": None, "genres": ["x", "y"], "flags": []}}]}
    got = writers.venue_outputs(df, dt.date(2026, 1, 2), "ord")
    assert got.first().json == json.dumps(want, indent=2, ensure_ascii=False)
    assert writers.venue_outputs(df.limit(0), dt.date(2026, 1, 2), "ord").count() == 0


def test_sitemap_files(spark):
    empty = render.sitemap_files(spark.createDataFrame([], "category string, loc string, lastmod date"), "https://x", dt.date(2026, 1, 2)).collect()
    assert [(r.file, r.n_entries) for r in empty] == [("sitemap.xml", 0)]
    rows = spark.createDataFrame([("date", "b", dt.date(2026, 1, 1), 1), ("date", "b", dt.date(2025, 1, 1), 2), ("date", "a", dt.date(2026, 1, 1), 3), ("date", "c", dt.date(2026, 1, 1), 4)], "category string, loc string, lastmod date, n int")
    files = {r.file: r for r in render.sitemap_files(render.sitemap_entries(rows, "loc", "lastmod", "category", "n"), "https://x", dt.date(2026, 1, 2), 2).collect()}
    assert {k: r.n_entries for k, r in files.items()} == {"sitemap-date.xml": 2, "sitemap-date-2.xml": 1, "sitemap.xml": 2}
    assert "<loc>b</loc>\n    <lastmod>2025-01-01</lastmod>" in files["sitemap-date.xml"].xml and "<loc>https://x/sitemap-date-2.xml</loc>" in files["sitemap.xml"].xml
