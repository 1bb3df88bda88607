"""Faults of the fourth round's findings, each on rows that showed it."""

import random

from pyspark.sql import functions as F

from dayboard.functions import text
from dayboard.operators import spans
from dayboard.plans import sources as S
from dayboard.queries import landed


def test_contexts_repeat_no_text_and_go_beyond_blocks_and_parts(spark):
    link = lambda i: f"<a>{i}</a>"
    page = "".join("市x" * (i % 40) + link(i) for i in range(300)) + "<a>" + "😀" * 5000 + "</a>" + "." * 3000 + link("z")
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "none"), (5, link(5))], "id int, t string")
    rows = spans.contexts(df, ["id"], "t", "<a>.*?</a>", 500, 1500, where=lambda m: ~m.contains("7"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert "_text" not in generate and "Join" not in plan and "Exchange" not in plan
    want, at = set(), 0
    for n in range(302):
        a, b = page.index("<a>", at), page.index("</a>", at) + 4
        if "7" not in page[a:b]:
            want.add((1, n, page[a:b], page[max(0, a - 500) : b + 1500]))
        at = b
    assert {tuple(r) for r in rows.collect()} == want | {(5, 0, link(5), link(5))}


def test_first_day_of_html_without_its_text(spark):
    rng = random.Random(4)
    signs = ["1", "20", "2026", "２０２６", "３", "年", "月", "日", "年1月2日", "2026年", "12月", "31日", "<b>", "</b>", "<br>", "<BR />", "</p>", "<a <br> x", "<i title='1998年2月3日'>", "<", ">", "&nbsp;", "&amp;nbsp;", "&amp;amp;nbsp;", "&lt;", "&#039;", " ", "　", " ", "\n", "x", "</", "br>"]
    often = ["2026", "２０２６", "年", "月", "日", "12", "3", "</p>", " ", "<b>", "&nbsp;"]
    rows = ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(3000)] + ["".join(rng.choices(often, k=rng.randint(5, 25))) for _ in range(3000)]
    day = ["2026", "年", "1２", "月", "3", "日"]
    rows += ["".join(x + rng.choice(["", "", "", *signs[12:]]) for x in day) + "".join(rng.choices(signs, k=5)) for _ in range(3000)]
    rows += ["<" * 2000 + "2026年1月2日", "<b>" * 20000 + "2026年1月2日", "<i " + "<br>" * 20000 + ">2026年1月2日", None, ""]
    df = spark.createDataFrame([(r,) for r in rows], "h string").repartition(4)
    plain = text.normalize_space(text.decode_entities(text.strip_tags_with_breaks(F.col("h"))))
    got = df.select("h", S._first_jp_date(F.col("h")).alias("got"), F.get(S._jp_dates(plain), 0).alias("want")).collect()
    assert [r for r in got if r.got != r.want] == []
    assert sum(r.want is not None for r in got) > 300


def test_long_items_are_not_shuffled(spark):
    """The texts of items are written after the orders are shuffled, and their partitions are not coalesced."""
    plan = landed.window_events(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning(c#", 1)[1]
    assert "." * 600 not in below
    assert "REPARTITION_BY_NUM" in below.splitlines()[0]
