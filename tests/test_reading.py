"""Queues of pages, lines of trees, paged posts, objects in scripts, and links in texts."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from dayboard.functions import extract, text
from dayboard.operators import graph, spans, stats
from dayboard.sources import readers


def queue(starts, edges, most):
    todo, queued, read = deque(), set(), []
    for s in starts:
        if s not in queued:
            todo.append(s), queued.add(s)
    while todo and len(read) < most:
        now = todo.popleft()
        read.append(now)
        for dst in edges.get(now, []):
            if dst not in queued:
                todo.append(dst), queued.add(dst)
    return read


@pytest.mark.parametrize("seed,most,sorted_rows", [(1, 7, 10_000), (2, 12, 10_000), (3, 12, 0), (4, 500, 10_000), (5, 1, 10_000)])
def test_crawl_is_a_queue(spark, monkeypatch, seed, most, sorted_rows):
    monkeypatch.setattr(graph, "MOST_SORTED", sorted_rows)
    rng = random.Random(seed)
    edges = {n: [rng.randrange(40) for _ in range(rng.choice([0, 2, 6]))] for n in range(30)}  # repeats, loops, pages that never landed
    starts = [rng.randrange(30) for _ in range(3)]
    links = spark.createDataFrame([(str(a), str(b), i) for a, bs in edges.items() for i, b in enumerate(bs)] + [("1", None, 99)], "src string, dst string, place int").repartition(3)
    start = spark.createDataFrame([(str(s), i) for i, s in enumerate(starts)] + [(None, 0)], "node string, place int")
    got = [r.node for r in graph.crawl_in_order(start, links, most).orderBy("place").collect()]
    assert got == [str(x) for x in queue(starts, edges, most)]


def test_crawl_of_nothing(spark):
    none = spark.createDataFrame([], "node string, place int")
    assert graph.crawl_in_order(none, spark.createDataFrame([], "src string, dst string, place int"), 5).count() == 0


def test_lines_of_files_in_splits(spark, tmp_path):
    rng = random.Random(2)
    want = {}
    for name in ("a.js", "sub/b.js", "node_modules/c.js", "d.txt", "sub/node_modules/e.js", "one.js", "empty.js"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True, parents=True)
        n = 9000 if name == "a.js" else 30 if name != "one.js" else 1
        lines = [rng.choice(["<<<<<<< HEAD", "=======", ">>>>>>> x", "======= =", "=========", "x = 1;", "", "市 " * rng.randint(1, 40), "<<<<<<<\r"]) for _ in range(0 if name == "empty.js" else n)]
        f.write_bytes(("\n".join(lines) + ("\n" if name != "one.js" else "")).encode() if lines else b"")
        if name in ("a.js", "sub/b.js", "one.js"):
            want[name] = [x.removesuffix("\r") for x in lines]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = {}
        rows = readers.source_lines(spark, str(tmp_path))
        assert spark.read.option("recursiveFileLookup", True).text(str(tmp_path)).rdd.getNumPartitions() > 5
        for r in rows.collect():
            got.setdefault(r.file_path.split(f"{tmp_path.name}/")[1], {})[r.line_no] = r.line
        assert got == {k: dict(enumerate(v, 1)) for k, v in want.items()}
        import re

        marks = {(r.file_path.split(f"{tmp_path.name}/")[1], r.line_no) for r in stats.conflicts_in_tree(spark, str(tmp_path)).collect()}
        assert marks == {(k, n) for k, v in want.items() for n, x in enumerate(v, 1) if re.search(stats.CONFLICT, x)} and len(marks) > 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pages_up_to_the_first_gap_or_empty_one(spark, tmp_path):
    def land(name, pages):
        for n, body in pages.items():
            f = tmp_path / name / f"page={n}"
            f.mkdir(parents=True)
            (f / "body.json").write_text(body)
        return str(tmp_path / name)

    post = '[{"title": {"rendered": "a"}, "link": "x"}]'
    pages = lambda p, **k: sorted(r.page for r in readers.paged_posts(spark, p, **k).collect())
    gap = land("gap", {1: post, 2: post, 3: post, 5: post, 10: post})
    assert pages(gap) == [1, 2, 3] and pages(gap, most=2) == [1, 2]
    assert pages(land("empty", {1: post, 2: "[]", 3: post})) == [1]
    assert pages(land("error", {1: post, 2: post, 3: '{"code": "rest_post_invalid_page_number"}', 4: post})) == [1, 2]
    assert pages(land("none", {2: post})) == []
    df = readers.paged_posts(spark, gap)
    assert df.dtypes == [("page", "int"), ("body", "string")]
    plan = df.select("page")._jdf.queryExecution().executedPlan().toString()
    assert "page#" in plan and "IN (1,2,3)" in plan.replace("page#", "page#") and "ReadSchema: struct<>" in plan
    files = df.select(F.input_file_name()).distinct().count()
    assert files == 3


@pytest.mark.parametrize(
    "page,want",
    [
        ("var e_icon = {a: {b: '}'}, \"c\\\"}\": 1}; x = {}", "{a: {b: '}'}, \"c\\\"}\": 1}"),
        ("e_icon={'a\\\\': 1}rest", "{'a\\\\': 1}"),
        ("e_icon = {never", None),
        ("e_icon = {'never }", None),
        ("my_e_icon = {}", None),
        (None, None),
        ("", None),
        ("e_icon = {" + ("'k': {'v': '" + "x" * 50000 + "'},") * 3 + "}", None),
    ],
)
def test_embedded_object(spark, page, want):
    got = spark.createDataFrame([(page,)], "h string").select(readers.embedded_object(F.col("h"), "e_icon").alias("o")).first().o
    if page and len(page) > 1000:
        want = page.split("= ", 1)[1]
    assert got == want


def test_links_stand_between_texts(one):
    parts = lambda t: [(p.text, p.url) for p in one(extract.auto_link_parts(F.lit(t).cast("string")))]
    u = "https://x.jp/a?b=1"
    assert parts(f"see {u}). and {u}、{u}") == [("see ", None), (u, u), (").", None), (" and ", None), (f"{u}、{u}", f"{u}、{u}")]
    assert parts(f"{u}\n{u}。") == [(u, u), ("\n", None), (u, u), ("。", None)]
    assert parts("none") == [("none", None)] and parts("") == [] and parts(None) == []
    assert parts("https://...") == [("https://", "https://"), ("...", None)]


def test_spans_against_finditer(spark):
    import re

    rng = random.Random(9)
    rows = [(k, "".join(rng.choices(["<a>", "</a>", "x", "市", "\n", "😀"], k=rng.randint(0, 60)))) for k in range(40)] + [(99, None), (100, "")]
    df = spark.createDataFrame(rows, "id int, t string").repartition(3)
    pattern = "<a>.*?</a>"
    want = {(i, n): (m.start(), m.end(), m[0]) for i, t in rows for n, m in enumerate(re.finditer(pattern, t or ""))}
    got = {(r.id, r.n): r for r in spans.match_spans(df, ["id"], "t", pattern).collect()}
    assert {k: (r.start, r.end, r.match) for k, r in got.items()} == want
    text_of = dict(rows)
    for (i, n), r in got.items():
        assert r.before == text_of[i][want[i, n - 1][1] if n else 0 : r.start]
        assert r.after == text_of[i][r.end : want[i, n + 1][0] if (i, n + 1) in want else None]
    for r in spans.contexts(df, ["id"], "t", pattern, 5, 8).collect():
        a, b, m = want[r.id, r.n]
        assert r.context == text_of[r.id][max(0, a - 5) : b + 8] and r.match == m
    joined = df.select("t", F.array_join(text.alternate(F.col("t"), pattern), "").alias("j")).where("t is not null and t <> j")
    assert joined.count() == 0
