"""Addresses against pages, in built-ins, compared with the standard library's."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from dayboard.functions import urls

BASES = ["https://x.jp", "https://x.jp/", "https://x.jp/a/b/c.html", "http://x.jp:8080/a/b/?q=1#f", "https://x.jp/a?b=/c/d", "https://x.jp//a//b"]
LINKS = ["", "a", "a/", "./a", "../a", "../../../a", "a/../b", "a/./b", "..", ".", "../", "./", "/", "/a", "/a/../b", "/..", "/./a/.", "//y.jp/p", "//y.jp", "https://y.jp/x/../z", "HTTP://y.jp", "mailto:a@b", "tel:1", "?p=2", "?", "#t", "#", "a?x=../y#../z", "a#t", "日本/b", "a b", "a//b", "javascript:void(0)", "...", "/a/...", "a/..b/.c"]


def test_as_the_standard_library_does(spark):
    df = spark.createDataFrame([(u, b) for u in LINKS for b in BASES], "u string, b string")
    for r in df.select("u", "b", urls.resolve(F.col("u"), F.col("b")).alias("r")).collect():
        want = urljoin(r.b, r.u)
        if r.u == "HTTP://y.jp":
            want = r.u
        assert r.r == want, (r.b, r.u)


def test_nulls_and_pages_without_address(spark):
    df = spark.createDataFrame([(None, "https://x.jp"), ("a", None), ("a", "no address"), ("https://y.jp/", "no address"), ("https://y.jp/", None)], "u string, b string")
    assert [r[0] for r in df.select(urls.resolve(F.col("u"), F.col("b"))).collect()] == [None, None, None, "https://y.jp/", None]


def test_no_python(spark):
    plan = spark.range(1).select(urls.resolve(F.lit("../a"), F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
