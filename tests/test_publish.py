"""Publishing in versions, errors as rows, gates, and upkeep from differences."""

import datetime as dt
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from dayboard.operators import checks, render, stats
from dayboard.operators.events import expand_days, publish_window, sane_range
from dayboard.operators.stats import InvalidEvents
from dayboard.plans import upkeep
from dayboard.sources import publish as P
from dayboard.sources import readers, writers

DAY = dt.date(2026, 6, 13)


def rows(spark, *items):
    return spark.createDataFrame(list(items), "part string, path string, content string")


def held(spark, folder):
    return sorted((r.part, r.path, r.content) for r in P.published(spark, folder).collect())


def test_only_what_changed_is_written(spark, tmp_path):
    out = str(tmp_path / "out")
    one = [("a", "1", "x"), ("a", "2", "y"), ("b/c=1 %", "1", "z"), (None, "n", "w")]
    assert P.publish(rows(spark, *one), out) == (1, 3, 0, 0)
    want = sorted((p or "", a, b) for p, a, b in one)
    assert held(spark, out) == want
    assert P.publish(rows(spark, *reversed(one)).repartition(3), out) == (1, 0, 3, 0)  # the same rows in another order
    two = [("a", "1", "x"), ("a", "2", "CHANGED"), ("b/c=1 %", "1", "z"), ("d", "1", None)]
    assert P.publish(rows(spark, *two), out) == (2, 2, 1, 1)
    assert held(spark, out) == sorted(two, key=str)
    folders = sorted(p.name for p in (tmp_path / "out" / "data").iterdir() if p.is_dir())
    assert len(folders) == 3 and not any("DEFAULT" in f for f in folders)
    assert [p.name for p in (tmp_path / "out" / "manifest").iterdir()] == ["version=2"]
    assert P.publish(rows(spark).limit(0), out) == (2, 0, 0, 0) and held(spark, out) == sorted(two, key=str)
    assert P.publish(rows(spark, ("a", "1", "x"), ("a", "1", "x"), ("d", "1", None)), out).removed == 1
    assert held(spark, out) == [("a", "1", "x"), ("a", "1", "x"), ("d", "1", None)]


def test_a_run_that_fails_leaves_the_old_output_whole(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    one = [("a", "1", "x"), ("b", "1", "y"), ("c", "1", "z")]
    P.publish(rows(spark, *one), out)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(P, "_write_manifest", fail)
        with pytest.raises(OSError):
            P.publish(rows(spark, ("a", "1", "NEW"), ("b", "1", "NEW")), out)
    assert (tmp_path / "out" / "data" / "part=a" / "version=2").exists()
    assert held(spark, out) == one
    # a manifest that was begun and never completed does not count either
    (tmp_path / "out" / "manifest" / "version=2").mkdir()
    assert held(spark, out) == one
    assert P.publish(rows(spark, ("a", "1", "LATER"), ("b", "1", "y")), out) == (2, 1, 1, 1)
    assert held(spark, out) == [("a", "1", "LATER"), ("b", "1", "y")]


def test_finalize(spark, tmp_path):
    out = str(tmp_path / "out")
    events = spark.createDataFrame([("h", "Hall", 0, "春の会", "2026-07-01"), ("h", "Hall", 1, "秋の会", "2026-10-01"), ("k", None, 0, "市場", "2026-06-20")], "venue_id string, venue_name string, ord int, title string, date_from string")
    hook = lambda d: d.withColumn("json", F.replace("json", F.lit("春"), F.lit("夏")))
    assert P.finalize(events, out, DAY, before_write=hook) == (1, 2, 0, 0)
    docs = {r.part: json.loads(r.json) for r in P.published(spark, out).collect()}
    assert [e["title"] for e in docs["h"]["events"]] == ["夏の会", "秋の会"] and "venue_name" not in docs["k"]
    with pytest.raises(InvalidEvents):
        P.finalize(events.withColumn("title", F.lit("x")), out, DAY)
    with pytest.raises(InvalidEvents):
        P.finalize(events.limit(0), out, DAY)
    assert {r.part for r in P.published(spark, out).collect()} == {"h", "k"}
    assert P.finalize(events.where("venue_id = 'k'"), out, DAY) == (2, 0, 1, 1)
    assert sorted((r.version, r.written, r.removed) for r in spark.read.json(f"{out}/log").collect()) == [(1, 2, 0), (2, 0, 1)]


def test_errors_are_rows(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for name, text in {"good": '{"venue_id": "g", "events": [{"title": "a", "date_from": "2026-01-01"}]}', "none": '{"venue_id": "n", "events": []}', "broken": '{"venue_id": "b", "events": [', "empty": "", "blank": " \n", "shape": '{"venue_id": "s"}', "undated": '{"venue_id": "u", "events": [{"title": "a"}, {"title": "b", "date_from": " "}]}', "template": "{}"}.items():
        (land / f"{name}.json").write_text(text)
    found = checks.checked_documents(spark, str(land))
    assert {r.file_name: r.reason for r in found.collect()} == {"good.json": None, "none.json": None, "broken.json": "PARSE", "empty.json": "EMPTY_RESULT", "blank.json": "PARSE", "shape.json": "SHAPE", "undated.json": "UNDATED"}
    out = str(tmp_path / "sorted")
    seen = checks.write_checked(found, out, n_events=F.sum(F.coalesce(F.size("events"), F.lit(0))))
    assert seen["rows"] == 7 and seen["bad"] == 5
    assert {r.file_name for r in checks.good(spark, out).collect()} == {"good.json", "none.json"}
    assert checks.quarantined(spark, out).groupBy("reason").count().count() == 4


def test_bodies_that_cannot_be_read_are_rows(spark):
    data = [(1, "市場".encode("shift_jis")), (2, b"\xff\xff\xff"), (3, gzip.compress("市".encode("shift_jis"))), (4, gzip.compress(b"x")[:8]), (5, b""), (6, None)]
    got = {r.id: (r.html, r.reason) for r in checks.checked_bodies(spark.createDataFrame(data, "id int, body binary"), "body", "shift_jis").collect()}
    assert got == {1: ("市場", None), 2: (None, "UNDECODABLE"), 3: ("市", None), 4: (None, "UNDECODABLE"), 5: ("", "EMPTY_RESULT"), 6: (None, "EMPTY_RESULT")}


def test_gate(spark):
    events = spark.createDataFrame([("a", "t" if k else None, "2026-01-01") for k in range(100)] + [("b", "t", None if k < 2 else "d") for k in range(100)] + [("c", "t", "d"), ("e", " ", "d")], "venue string, title string, day string")
    expected = spark.createDataFrame([(v, v != "d") for v in "abcdef"], "venue string, there boolean")
    got = {r.venue: r for r in checks.gate(expected, events, "venue", F.col("title"), F.col("day").isNotNull(), date_rates=(0.01, 0.02)).collect()}
    assert {v: r.status for v, r in got.items()} == {"a": "ok", "b": "warn", "c": "ok", "d": "fail", "e": "fail", "f": "warn"}
    assert got["b"].date_status == "warn" and got["b"].title_status == "ok" and got["e"].missing_title == 1 and got["d"].total == 0
    mild = checks.gate(expected, events, "venue", F.col("title"), F.col("day").isNotNull(), enforce=False)
    assert {r.venue: r.enforced for r in mild.where("status = 'fail'").collect()} == {"d": "warn", "e": "warn"}


def full(events):
    return expand_days(sane_range(events), window=publish_window(DAY))


def test_upkeep_equals_a_full_run(spark, tmp_path):
    rng = random.Random(12)
    day = lambda: DAY + dt.timedelta(rng.randint(-380, 380)) if rng.random() < 0.3 else DAY + dt.timedelta(rng.randint(-20, 20))

    def event(k):
        first = day()
        return (k, f"t{rng.randrange(1000)}", f"/e/{k}", first, first + dt.timedelta(rng.choice([0, 0, 1, 3, 9])))

    schema = "ord int, title string, url string, date_from date, date_to date"
    before = {k: event(k) for k in range(60)}
    df = spark.createDataFrame([*before.values()], schema)
    path = str(tmp_path / "days")
    full(df).write.partitionBy("day").parquet(path)
    days = spark.read.parquet(path).select(*full(df).columns)
    for step in range(3):
        after = dict(before)
        for k in rng.sample(sorted(after), 4):
            del after[k]
        for k in [*rng.sample(sorted(after), 4), 100 + 2 * step, 101 + 2 * step]:
            after[k] = event(k)
        if step == 2:
            after = dict(before)
            after[3] = (*before[3][:1], None, *before[3][2:])
        changes = upkeep.event_changes(df, spark.createDataFrame([*after.values()], schema), "ord")
        assert {r.ord for r in changes.collect()} == {k for k in {*before, *after} if before.get(k) != after.get(k)}
        done = upkeep.refresh_days(days, changes, "ord", DAY)
        pages, gone = upkeep.refresh_pages(done, DAY)
        old = {r.day: r.html for r in render.day_documents(full(df), DAY).collect()}
        want = {r.day: r.html for r in render.day_documents(full(spark.createDataFrame([*after.values()], schema)), DAY).collect()}
        got = {r.day: r.html for r in pages.collect()}
        lost = {r.day for r in gone.collect()}
        assert lost == set(old) - set(want)
        assert {**{d: h for d, h in old.items() if d not in lost}, **got} == want
        assert len(got) < len(want)


def test_upkeep_reads_touched_days_only(spark, tmp_path):
    df = spark.createDataFrame([(k, "t", "/", DAY + dt.timedelta(k), DAY + dt.timedelta(k)) for k in range(30)], "ord int, title string, url string, date_from date, date_to date")
    path = str(tmp_path / "days")
    full(df).write.partitionBy("day").parquet(path)
    days = spark.read.parquet(path).select(*full(df).columns)
    plan = days.where(F.col("day").isin([DAY]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    done = upkeep.refresh_days(days, upkeep.event_changes(df, df.where("ord <> 7"), "ord"), "ord", DAY)
    assert sorted((r.day - DAY).days for r in done.touched.collect()) == [6, 7, 8]


def test_dated_rows_are_counted(spark):
    rows = spark.createDataFrame([("a", None), ("b", " "), ("c", "2026-01-01")], "title string, date_from string")
    assert stats.dated_rows(rows) == 1 and stats.require_dated(rows) is rows
    for bad, least in ((rows.where("title <> 'c'"), 1), (rows.limit(0), 1), (rows, 2)):
        with pytest.raises(InvalidEvents, match="date_from"):
            stats.require_dated(bad, least=least)


def test_venues_with_an_id_and_a_name(spark, tmp_path):
    (tmp_path / "spots.json").write_text(json.dumps([{"spot_id": "a", "name": "A", "lat": 34.0}, {"spot_id": "", "name": "B"}, {"spot_id": "c", "name": None}, {"name": "D"}, {"spot_id": "e", "name": "E", "extra": 1}]))
    got = readers.spots(spark, str(tmp_path / "spots.json"))
    assert sorted((r.spot_id, r.lat) for r in got.collect()) == [("a", 34.0), ("e", None)]
    (tmp_path / "none.json").write_text("[]")
    assert readers.spots(spark, str(tmp_path / "none.json")).count() == 0


def test_a_large_group_is_one_document(spark):
    events = spark.range(60_000).select(F.lit("v").alias("venue_id"), F.lit("V").alias("venue_name"), F.col("id").alias("ord"), F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"))
    doc = json.loads(writers.venue_outputs(events.repartition(8), DAY, "ord").first().json)
    assert [e["title"] for e in doc["events"]] == [f"title {k}" for k in range(60_000)]
