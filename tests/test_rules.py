"""Rules as tables against loops and against the rules built in."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dayboard.functions import tags
from dayboard.operators import rules as R
from tests.test_golden import TAGGED


def plain(text, rows):
    if text is None:
        return []
    place, hit = {}, set()
    for _, key, kind, value in sorted(rows):
        if key is None or value is None:
            continue
        place.setdefault(key, len(place))
        if (value in text) if kind == "text" else re.search(value, text):
            hit.add(key)
    return sorted(hit, key=place.get)


@pytest.mark.parametrize("most", [R.MOST_BYTES, 4000])
def test_many_random_rules(spark, most):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdé市", k=rng.randint(1, 6)))
    rows = [(i, f"k{rng.randrange(40)}", "text", word()) for i in range(5000)] + [(i, f"p{i % 3}", "pattern", p) for i, p in ((5000, "^a+$"), (5001, "市.*市"), (2500, "d{3}"))]
    rows += [(9000, "none", "text", None), (9001, None, "text", "a")]
    texts = [(k, "".join(rng.choices("abcdé市z", k=rng.randint(0, 12)))) for k in range(60)] + [(100, None), (101, ""), (102, "ab" * 3000), (103, "aaa"), (104, "aaa")]
    table = spark.createDataFrame(rows, "ord long, key string, kind string, value string").repartition(3)
    df = spark.createDataFrame(texts, "id long, text string").withColumn("ord", F.lit(1)).withColumn("key", F.lit(2))
    got = {r.id: r.hits for r in R.rule_hits(df, "text", table, most_bytes=most).collect()}
    assert got == {i: plain(t, rows) for i, t in texts}


def test_order_empty_words_and_no_rules(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    table = spark.createDataFrame([(3, "late", "text", "b"), (1, "all", "text", ""), (2, "late", "pattern", "^x")], "ord long, key string, kind string, value string")
    assert {r.id: r.hits for r in R.rule_hits(df, "text", table).collect()} == {1: ["all", "late"], 2: []}
    assert {r.id: r.hits for r in R.rule_hits(df, "text", table.limit(0)).collect()} == {1: [], 2: []}
    with pytest.raises(ValueError, match="patterns"):
        R.rule_hits(df, "text", table, most_bytes=10)


def test_plan_does_not_grow_with_rules(spark):
    df = spark.createDataFrame([("a",)], "text string")
    size = [len(R.rule_hits(df, "text", R.rule_rows(spark, {f"k{i}": [f"w{i}"] for i in range(n)}))._jdf.queryExecution().optimizedPlan().toString()) for n in (5, 5000)]
    assert abs(size[0] - size[1]) < 20


def test_tables_tag_as_built_in_rules_do(spark):
    titles = [t[0] for t in TAGGED] + [w for rules in (tags.TYPE_RULES, tags.GENRE_RULES) for ws in rules.values() for w in ws] + ["", None, "On The Road 2026"]
    df = spark.createDataFrame([(t, c) for t in titles for c in (None, "文化ホール")], "title string, venue_category string")
    made = R.default_rules(spark)
    text = tags.search_text(F.col("title"), F.col("venue_category"))
    got = R.tagged(df, made["type"], made["genres"]).withColumns({"want": tags.event_type(F.col("title"), F.col("venue_category")), "wants": tags.genres(text)})
    assert got.where("type <> want or genres <> wants").count() == 0 and got.count() == len(titles) * 2
    assert got.where("type = 'other'").count() > 0


def test_compiled_patterns_are_rules(spark):
    table = R.rule_rows(spark, {"year": [re.compile(r"20\d\d"), "令和"], "fes": ["FES"]})
    got = {r.t: r.hits for r in R.rule_hits(spark.createDataFrame([("love fes2026",), ("令和",), ("x",)], "t string"), "t", table).collect()}
    assert got == {"love fes2026": ["year", "fes"], "令和": ["year"], "x": []}
