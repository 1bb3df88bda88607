"""Articles without an <article>, pages inside a form, furniture under misleading and neutral names."""

import random
import re

import pytest

from dayboard.llm import html_extract as H

SAID = "It was a long day and much was said about it by all who had come to see it end."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<form id=aspnetForm><input type=hidden value=x><div class=content><p>%s</p><p>More of it.</p><label>Name</label><select><option>a</select></div></form>", "{}\nMore of it."),
        ("<form id=aspnetForm><div class=top-menu><a href=x>Menu</a></div><div class=content><h1>T</h1><p>%s</p></div></form>", "T\n{}"),
        ("<div class=post><h1>T</h1><p>%s</p><form><p>Your name</p><input></form></div>", "T\n{}"),
        ("<div><p data-class='sidebar'>%s</p><p title='x class=sidebar'>Second.</p></div>", "{}\nSecond."),
        ("<main><article><h1>T</h1><p>%s</p></article><div class=comments><article class=comment><h1>Me</h1><p>A reader says very much more than the article ever did, again and again and again, on and on.</p></article></div></main>", "T\n{}"),
        ("<div class=story><h1>T</h1><p>%s</p></div><div class=advertisement><h1>Buy</h1><p>It is cheap.</p></div>", "T\n{}"),
        ("<main><h1>T</h1><p>%s</p><section class=promo><h1>Buy</h1><p>Now.</p></section></main>", "T\n{}"),
        ("<main><h1>T</h1><p>%s</p><div class=related-articles><p>Others</p></div><div id=gdpr><p>We store things.</p></div><div role=alert><p>Old browser!</p></div></main>", "T\n{}"),
        ("<main><h1>T</h1><p>%s</p><p hidden>Not seen</p><div style='color:red; display: none'><p>Nor this</p></div><p aria-hidden=true>Nor that</p></main>", "T\n{}"),
        ("<div class='sidebar-wrap'><main><h1>T</h1><p>%s</p></main></div>", "T\n{}"),
        ("<header class=banner><h1>Site</h1></header><div class='widget'><article><h2>T</h2><p>%s</p></article></div>", "T\n{}"),
    ],
)
def test_marked_elements(page, text):
    page = f"<html><body>{page.replace('%s', SAID)}</body></html>"
    assert H.extract(page, None) == text.replace("{}", SAID)


WORDS = "red green blue long short house river stone cloud winter people market window silver paper".split()


def planted(rng, host, n):
    """A page of a host without <article>: its furniture has neutral names and stands on all pages of the host."""
    say = lambda k: " ".join(rng.choices(WORDS, k=k)).capitalize() + "."
    article = [f"Title {say(4)}"] + [say(rng.randint(15, 50)) for _ in range(rng.randint(2, 7))]
    fixed = random.Random(host)
    tell = lambda k: " ".join(fixed.choices(WORDS, k=k)).capitalize() + "."
    left, right, low = tell(25), tell(30), tell(12)
    head, *rest = article
    body = f"<h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in rest)
    if host % 3 == 0:
        page = f"<div id=page><div id=left-col><p>{left}</p></div><div class=c1>{body}</div><div class=c2><p>{right}</p></div><div class=low><p>{low}</p></div></div>"
    elif host % 3 == 1:
        page = f"<table><tr><td><p>{left}</p></td><td>{body}</td><td><p>{right}</p></td></tr><tr><td><div class=box7><p>{low}</p></div></td></tr></table>"
    else:
        page = f"<form id=f><div class=t><p>{low}</p></div><div class=x><div class=y>{body}</div><ul><li>{left}<li>{right}</ul></div></form>"
    return f"<html><head><title>{n}</title></head><body>{page}</body></html>", "\n".join(article)


def overlap(a, b):
    x, y = (re.findall(r"\w+", t) for t in (a, b))
    from collections import Counter

    both = (Counter(x) & Counter(y)).total()
    return 2 * both / max(1, len(x) + len(y))


def test_furniture_under_neutral_names_goes_by_recurrence(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for host in range(9):
        for k in range(14):
            html, article = planted(rng, host, k)
            i = host * 100 + k
            rows.append((i, f"https://h{host}.example/{k}", html))
            want[i] = article
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in H.extract_main_text(pages, ["page_id", "url"]).collect()}
    found = [overlap(got[i], want[i]) for i in want]
    assert sum(found) / len(found) > 0.97 and min(found) > 0.95


def test_copies_of_an_article_are_not_furniture(spark):
    html, article = planted(random.Random(1), 0, 0)
    html = html.replace("<div id=left-col>", "<div id=left-col class=nav>")
    rows = [(i, f"https://same.example/{i}", html) for i in range(30)] + [(i, "https://few.example/", html) for i in range(100, 103)]
    got = [r.text for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()]
    assert all(article in t for t in got)


def test_odd_pages(spark):
    long = "<div class=post><h1>T</h1>" + "".join(f"<p>{SAID} {k}</p>" for k in range(8000)) + "</div>"
    rows = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (2, "https://x/", long), (3, "", None), (None, "https://x/", "<p>b"), (5, "https://x/", "<!-- -->")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("text", "n_chars", "host", "path"):
        pages = pages.withColumn(c, pages.page_id)
    got = H.extract_main_text(pages, ["page_id", "text", "host", "path"])
    assert got.columns == ["page_id", "host", "path", "text", "n_chars"]
    by = {}
    for r in got.collect():
        by.setdefault(r.page_id, []).append(r.text)
    assert by[1] == ["a", "a"] and by[3] == [""] and by[None] == ["b"] and by[5] == [""]
    assert by[2][0].count("\n") == 8000 and by[2][0].endswith("7999")
