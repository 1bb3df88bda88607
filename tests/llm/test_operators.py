"""The training-data operators against brute force, round trips and planted cases, on small inputs."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from dayboard.llm import ann, bpe, chat, chroma, components, html_extract, langid, minhash, mixing, packing, storage, substring, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n, vocab=4000):
    return [f"w{rng.randrange(vocab):x}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd_rows():
    """Null, empty, blank, very long, repeated and tied texts, and a null id."""
    long = " ".join(words(random.Random(3), 20000)) + "."
    return [(1, None), (2, ""), (3, " \n "), (4, long), (5, long), (5, long), (None, "Ein Satz mit acht Wörtern steht hier ganz allein."), (7, "***"), (8, "***"), (9, "a")]


# substring dedup


def plain_units(text, least=20):
    """Lines, paragraphs and shortest runs of sentences from each sentence on, by trying every range of sentences."""
    parts, line, para, empty = [], 0, 0, True
    for m in substring._UNIT.finditer(text):
        said = m[0].lower().encode("utf-8", "surrogatepass").split()
        if said:
            parts.append((m.start(), m.end(), said, line, para))
            empty = False
        if m[0].endswith("\n"):
            line, para, empty = line + 1, para + empty, True
    out = set()
    for i in range(len(parts)):
        for j in range(i, len(parts)):
            if parts[j][4] != parts[i][4]:
                break
            words = [w for p in parts[i : j + 1] for w in p[2]]
            if len(words) >= least:
                whole = [(i == 0 or parts[i - 1][k] != parts[i][k]) and (j + 1 == len(parts) or parts[j + 1][k] != parts[j][k]) and parts[i][k] == parts[j][k] for k in (3, 4)]
                if any(whole) or len(words) - len(parts[j][2]) < least:
                    out.add((parts[i][0], parts[j][1], b" ".join(words)))
    return out


def brute_units(rows):
    first, spans = {}, collections.defaultdict(set)
    units = [(i, a, b, d) for i, t in rows if i is not None and t is not None for a, b, d in plain_units(t)]
    for i, a, b, d in units:
        first[d] = min(first.get(d, (i, a, b)), (i, a, b))
    for i, a, b, d in units:
        if i > first[d][0] or a >= first[d][2]:
            spans[i].add((a, b))
    return {i: substring.merge(list(s)) for i, s in spans.items()}


def test_substring_against_brute_force(spark, odd_rows):
    rng = random.Random(1)
    pool = [" ".join(words(rng, rng.randint(2, 14))) + rng.choice([". ", "! ", "\n", ".\n", ".\n\n", ""]) for _ in range(30)]
    rows = odd_rows + [(100 + k, "".join(rng.choice(pool) for _ in range(rng.randint(1, 15)))) for k in range(60)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = brute_units(rows)
    for r in got.collect():
        spans = want.get(r.doc_id, []) if r.text is not None else []
        assert list(zip(r.deduped.start, r.deduped.end, strict=True)) == spans
        kept, at = "", 0
        for a, b in spans:
            kept, at = kept + r.text[at:a], b
        assert r.deduped.text == (None if r.text is None else kept + r.text[at:])


def test_passage_inside_a_line_goes_whole_and_lone_sentences_stay(spark):
    rng = random.Random(15)
    short = [" ".join(words(rng, 4)) + "." for _ in range(15)]  # sixty words in short sentences
    lone = "Nobody said anything about this before."
    rows = [(i, f"{lone} {' '.join(words(rng, 30))}. {' '.join(short)} {' '.join(words(rng, 30))}.") for i in range(3)]
    got = {r.doc_id: r.deduped for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1]
    for i in (1, 2):
        assert not any(s in got[i].text for s in short) and lone in got[i].text
        assert rows[i][1][got[i].start[0] : got[i].end[0]].split() == " ".join(short).split()


def test_equal_neighbours_keep_one_whole_unit(spark):
    same = " ".join(f"w{k}" for k in range(10)) + ". "
    got = substring.remove_repeats(spark.createDataFrame([(1, same * 4)], "doc_id long, text string").withColumn("spans", F.lit(0)).withColumn("_repeat", F.lit(1))).first()
    assert got.deduped.text == same * 2 and got.spans == 0


def test_shared_passage_goes_and_the_rest_stays(spark):
    rng = random.Random(2)
    passage = ". ".join(" ".join(words(rng, 12)) for _ in range(5)) + "."
    own = [" ".join(words(rng, 30)) + "." for _ in range(3)]
    rows = [(i, f"{own[i]}\n{passage}\n{own[i][::-1]}") for i in range(3)]
    got = {r.doc_id: r.deduped.text for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all(passage[:40] not in got[i] and own[i] in got[i] for i in (1, 2))


def test_units_cover_the_text():
    text = "One two three four five. Six!\n\nseven eight nine ten eleven twelve"
    assert "".join(m[0] for m in substring._UNIT.finditer(text)) == text


# near duplicates


def brute_classes(rows):
    sets = {i: dict(zip(*(x.tolist() for x in minhash.weighted_shingles(t or "", 5)), strict=True)) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = sum(min(n, sets[b].get(k, 0)) for k, n in sets[a].items())
                if common >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - common):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_against_all_pairs(spark, odd_rows):
    rng = random.Random(4)
    rows = [r for r in odd_rows if r[0] not in (4, 5)] + [(20, odd_rows[3][1]), (21, odd_rows[3][1] + " more")]
    for g in range(8):
        base = words(rng, 150)
        for k in range(8):
            copy = list(base)
            for _ in range(k // 2):
                copy[rng.randrange(150)] = "x"
            rows.append((1000 - 10 * g - k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash")).repartition(4)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect() if r.doc_id is not None}
    assert got == brute_classes(rows)


def template_rows(rng, n):
    """Texts of one template, mostly below the threshold to each other, and some pairs above it."""
    base, rows = words(rng, 150), []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(150), 5):
            text[at] = f"own{i}x{at}"
        rows.append((i, " ".join(text)))
        if i % 8 == 0:
            text[rng.randrange(150)] = "other"
            text[rng.randrange(150)] = "another"
            rows.append((10_000 + i, " ".join(text)))
    return rows


def bucket_classes(rows, bands, rows_a_band):
    """Classes by all pairs that share a bucket, of texts that have words."""
    sigs, sets = {}, {}
    for i, t in rows:
        el, w = minhash.weighted_shingles(t, 5)
        sigs[i] = minhash.dart_signature(el, w, bands * rows_a_band).reshape(bands, rows_a_band)
        sets[i] = collections.Counter(dict(zip(el.tolist(), w.tolist(), strict=True)))
    label = {i: i for i in sigs}
    for a in sorted(sigs):
        for b in sorted(sigs):
            if a < b and label[a] != label[b] and (sigs[a] == sigs[b]).all(axis=1).any():
                common = (sets[a] & sets[b]).total()
                if common >= 0.8 * (sets[a].total() + sets[b].total() - common):
                    low, high = sorted((label[a], label[b]))
                    label = {i: low if x == high else x for i, x in label.items()}
    return label, max(collections.Counter(tuple(s[0]) for s in sigs.values()).values())


def test_bucket_of_several_hundred_classes_against_all_pairs(spark):
    rows = template_rows(random.Random(21), 400)
    want, largest = bucket_classes(rows, 2, 1)
    assert largest > 300 and 300 < len(set(want.values())) < len(rows) - 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for options in ({}, {"block_rows": 50}):  # one block a bucket, and many
        got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, bands=2, rows=1, **options).collect()}
        assert got == want


def test_small_buckets_are_whole_however_rows_are_dealt(spark):
    rng = random.Random(22)
    rows = [(100 * g + i, t) for g in range(30) for i, t in template_rows(rng, 12)]
    want, largest = bucket_classes(rows, 1, 1)
    assert largest < 32 and len(set(want.values())) < len(rows) - 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df, bands=1, rows=1).collect()} == want, n
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_signature_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(5)
    el = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(0, 4, 300), rng.integers(0, 4, 300)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    x, y = (minhash.dart_signature(el[w > 0], w[w > 0], 2000) for w in (a, b))
    assert abs((x == y).mean() - want) < 0.05
    half = minhash.dart_signature(el[a > 0], a[a > 0] * 0.5, 2000)
    assert len(half) == 2000 and half.all()


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    stash = storage.Stash(spark, "test")
    got = {r.id: r.label for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), stash).collect()}
    parent = list(range(60))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), stash).count() == 0


# language ID


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_language_model(docs.where(~langid.held_out("doc_id", 3, 1)), "doc_id", "text", "lang")
    assert model.families == ["germanic", "romance"]
    got = langid.identify(docs.where(langid.held_out("doc_id", 3, 1)), "text", model, ["lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    odd = langid.identify(spark.createDataFrame([(1, None), (2, ""), (3, "123 !!!"), (4, "the of and that the with")], "k int, text string"), "text", model, ["k"])
    assert {r.k: r.lang_pred for r in odd.collect()} == {1: "und", 2: "und", 3: "und", 4: "en"}


def test_language_model_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit_language_model(none, "doc_id", "text", "lang")
    assert model.predict("words")[0] == "und"


# toxicity


def test_noisy_or_finds_the_sentences(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        s = [" ".join(words(rng, 8, 300)) for _ in range(6)]
        toxic = int(i % 4 == 0)
        if toxic:
            s[2] += " vile idiot"
        rows.append((i, ". ".join(s) + "."))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(lab.where("doc_id < 300"), docs)
    got = {r.doc_id: r for r in toxicity.score(docs, "text", model, ["doc_id"]).collect()}
    assert np.mean([(got[i].score >= 0.3) == bool(y) for i, y in labels if i >= 300]) > 0.97
    hit = got[396]
    assert hit.offending.start and "idiot" in rows[396][1][hit.offending.start[0] : hit.offending.end[0]]
    odd = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, "...")], "k int, text string"), "text", model, ["k"])
    assert [r.score for r in odd.collect()] == [0, 0, 0]
    assert toxicity.fit_toxicity(lab.limit(0), docs).bias == -np.inf


# nearest neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[700:720] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [1.0]), (2004, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 50 = 0").select("vec_id"), "vec_id", "embedding", block=256).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r["rank"]))
    assert set(got) == set(range(0, 1500, 50))
    y = x.astype(float)
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = sorted(range(1500), key=lambda i: (d[i], i))[:10]
        assert [f[2] for f in found] == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-12 for v, s, _ in found)
        hits += len(set(want) & {f[0] for f in found})
    assert hits >= 0.95 * 10 * len(got)
    assert [f[0] for f in got[700]] == [5, *range(701, 710)]


def test_cluster_of_jittered_copies(spark):
    """A third of all vectors differ by less than a hundredth of a byte's step of their components."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1800, 16))
    x[::3] = x[0] + rng.standard_normal((600, 16)) * 2e-4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumn("node", F.lit("x")).repartition(3)
    hits = total = 0
    for r in ann.search(df, df.where("vec_id % 100 = 0").select("vec_id"), "vec_id", "embedding", block=256).groupBy("query_id").agg(F.collect_list("vec_id").alias("v")).collect():
        d = np.sqrt(((x - x[r.query_id]) ** 2).sum(1))
        d[r.query_id] = np.inf
        hits, total = hits + len(set(np.argsort(d)[:10].tolist()) & set(r.v)), total + 10
    assert total == 180 and hits >= 0.95 * total


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.search(df, df.select("vec_id").where("vec_id % 100 = 0"), "vec_id", "embedding").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 7), (0, 100), (100, 7), (100, 0)]
    assert ann.search(df.limit(0), df.select("vec_id"), "vec_id", "embedding").count() == 0


def test_clashing_columns(spark):
    """Columns with the names of results or of inner columns neither break an operator nor get lost in the pipeline."""
    import corpus_pipeline as P

    names = ["score", "lang_pred", "id", "key", "label", "size", "_text", "digest", "start", "spans", "class_id", "rate", "tokens", "posterior", "row", "band"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit("x").alias(n) for n in names])
    stash = storage.Stash(spark, "test")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = stash.put(out)
        assert docs.where("score = 'x' and _text = 'x'").count() == docs.count() > 0
    assert packing.pack(docs, PATH).count() > 0
    model = toxicity.ToxicityModel(bias=-1.0)
    assert toxicity.score(docs, "text", model, ["doc_id", "score", "label"]).columns == ["doc_id", "label", "score", "offending"]


def test_empty_tables(spark):
    import corpus_pipeline as P

    none = spark.createDataFrame([], DOC)
    stash = storage.Stash(spark, "test")
    docs = none
    for _, stage in P.STAGES[:-1]:
        docs = stash.put(stage(spark, docs, SF))
        assert docs.count() == 0 and docs.columns == none.columns
    assert P.STAGES[-1][1](spark, docs, SF).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_main_text(pages, ["page_id"]).count() == 0
    talk = spark.createDataFrame([], "conv_id long, turn long, text string")
    assert chat.link_quotes(talk).count() == 0
    members, found = chroma.align(chroma.fingerprints(spark.createDataFrame([], "id long, audio binary"), "id", "audio"), spark.createDataFrame([], "id long"))
    assert members.count() == found.count() == 0


def test_deep_pages_stay_small():
    page = "<div>" * 5000 + "<p>deep text of the page</p>" + "</div>" * 5000
    assert html_extract.extract(page, None) == "deep text of the page"


# HTML


PAGE = """<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, many of them, really</p></div>
<div class="post post-{n}"><h1>Head &amp; tail {n}</h1><p>First <b>para</b>graph,
 with   space.<p>Second &eacute; one<br>here.<ul><li>item<li>other</ul>
<form><input value="x">Send</form><div id="comments"><p>A reader says a lot of things here</p></div></div>
<aside><p>Related things</p></aside><footer>&copy; me</footer></body></html>"""


def test_extraction_by_host(spark):
    rows = [(i, f"https://a.example.com/{i}", PAGE.replace("{n}", str(i))) for i in range(6)]
    rows += [(10, "https://b.example.com/x", "plain &lt;text"), (11, "https://b.example.com/y", None), (12, None, "<p>a</p>"), (13, "nohost", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract_main_text(pages, ["page_id", "url"]).collect()}
    for i in range(6):
        assert got[i].text == f"Head & tail {i}\nFirst paragraph, with space.\nSecond é one here.\nitem\nother"
        assert got[i].n_chars == len(got[i].text)
    assert got[10].text == "plain <text" and got[11].text == "" and got[12].text == "a" and got[13].n_chars == 0
    assert {r.host: r.path for r in html_extract.host_paths(html_extract.host_votes(pages)).collect()}["a.example.com"] == ">html>body>div.post.post-#"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class=content><h1>Title</h1><p>The lead says it.</p><div class=text><p>%s</p><p>More.</p></div></div>", "Title\nThe lead says it.\n{}\nMore."),
        ("<article><section class=intro><p>Short intro.</p></section><section class=rest><p>%s</p></section></article>", "Short intro.\n{}"),
        ("<article><p>%s</p><p class='share-price'>Shares rose.</p><div class='feature-tags-explained'>Tags are these.</div></article>", "{}\nShares rose.\nTags are these."),
        ("<div class=post><header><h1>Title</h1></header><div class=b><p>%s</p></div></div>", "Title\n{}"),
        ("<p>%s <span class=ad>A<span>B</span>LEAK</span> end</p>", "{} end"),
        ("<div id=wrap><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class=story><h2>Title</h2><p>%s</p></div><div class='side-bar'><p>Other things</p></div><footer>Foot</footer></div>", "Title\n{}"),
        ("<form id=aspnet><div class=top-menu><a href=x>Menu</a></div><div><h1>Title</h1><p>%s</p><input value=x></div></form>", "Title\n{}"),
        ("<main><div class='entry-content sidebar-left'><p>%s</p></div><div class='comment-list'><p>A reader writes.</p></div></main>", "{}"),
        ("<body><div class=cookie-notice>We use cookies</div>%s<br>second<div class='ad ad-slot-3'>Buy</div></body>", "{} second"),
        ("<div><b>Bold <i>both</i> text</b>, %s</div>", "Bold both text, {}"),
    ],
)
def test_article_is_whole_and_alone(page, text):
    said = "It was a long day and much was said about it by all who had come to see it end."
    page, text = page.replace("%s", said), text.replace("{}", said)
    page = f"<html><head><title>T</title></head><body>{page}</body></html>"
    assert html_extract.extract(page, None) == text
    path = max(html_extract.votes(page).items(), key=lambda v: v[1])[0]
    assert html_extract.extract(page, path) == text


def test_registered_pages_hold_their_articles(spark):
    """The tables' articles stand in <article> elements: what is in them, and nothing else, comes out; hosts vote as a plain loop does."""
    import html
    import re

    from dayboard.llm import queries as Q

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in Q.op8_html_extraction(spark, SF).collect()}
    plain = collections.defaultdict(collections.Counter)
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", part)).split()) for part in re.split(r"</?(?:p|h1|h2|ul|li)>", body)]
        assert got[r.page_id].split() == " ".join(want).split()
        plain[re.match(r"\w+://([^/]+)", r.url)[1].lower()].update(html_extract.votes(r.html))
    won = {r.host: r.path for r in html_extract.host_paths(html_extract.host_votes(pages)).collect()}
    assert won == {h: max(c, key=lambda p: (round(c[p], 6), p)) for h, c in plain.items()}


# mixing


def test_rates_meet_targets_and_match_a_plain_loop(spark):
    rng = random.Random(9)
    kinds = {"good": "alpha beta gamma", "plain": "delta epsilon zeta", "toxic": "eta theta iota"}
    rows, labels = [], []
    for i in range(300):
        kind = "good" if i % 10 < 7 else "plain" if i % 10 < 9 else "toxic"
        rows.append((i, " ".join(rng.choice(kinds[kind].split()) for _ in range(rng.randint(5, 60)))))
        labels.append((i, kind))
    rows += [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = mixing.fit_domains(spark.createDataFrame(labels, "doc_id long, domain string").where("doc_id % 3 > 0"), docs, "domain")
    targets = {"good": 0.5, "plain": 0.4, "toxic": 0.1}
    got = mixing.fit_rates(docs, model, targets).collect()
    p = np.array([r.posterior for r in got])
    n, rate = np.array([r.tokens for r in got], float), np.array([r.rate for r in got])
    assert (rate >= 0).all() and len(got) == 302
    mass = (rate * n) @ p
    assert np.allclose(mass / n.sum(), [targets[d] for d in model.domains], atol=1e-4)
    goal, plain = np.array([targets[d] for d in model.domains]) * n.sum(), np.ones(len(n))
    inverse = np.linalg.pinv(p.T @ (p * n[:, None]), rcond=1e-10, hermitian=True)
    for _ in range(40):
        plain = np.maximum(0, plain - p @ (inverse @ ((plain * n) @ p - goal)))
    assert np.allclose(rate, plain, atol=1e-3)
    kept = mixing.fit_rates(docs, model, targets, protected="good", most=1.0).collect()
    assert all(r.rate == 1 for r in kept if r.posterior[model.domains.index("good")] >= 0.5)
    assert mixing.fit_rates(docs.limit(0), model, targets).count() == 0


# packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizers(tokenizer):
    import pyarrow.parquet as pq

    rng = random.Random(10)
    texts = ["", " ", "it's don't've 'tis \"'s ''s", "a  b\n\n c \t d", "İ ʼ 12 3१ 😀", "<|endoftext|> x", "hello <|endoftext|> world", "a<|endoftext|><|endoftext|>", "<|endoftext| > don't<|endoftext|>'s"] + ["".join(rng.choice(" '\nabst re12.é!s　") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    texts += pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist()
    texts.append("word and another word " * 60000)  # split into blocks
    coder = bpe.FastIds(open(PATH, encoding="utf-8").read())
    for text, ids, want in zip(texts, coder.encode(texts), tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, text[:80]


def test_packing_round_trip(spark, tokenizer, odd_rows):
    rows = [(100 + i if r[0] is not None else None, r[1]) for i, r in enumerate(odd_rows)]
    rows += [(i, " ".join(words(random.Random(i), random.Random(i).randint(1, 900)))) for i in range(60)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    at = collections.defaultdict(list)
    for r in got:
        assert 1 <= r.length <= 1024
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
        at[r.sequence_id].append((r.offset, r.length))
    for spans in at.values():
        end = 0
        for a, n in sorted(spans):
            assert a == end
            end += n
        assert end <= 1024
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append((r.start, r.length))
    assert {d: sum(n for _, n in s) for d, s in by_doc.items()} == {d: len(x) for d, x in ids.items()}
    assert len(at) <= 1.02 * sum(len(x) for x in ids.values()) / 1024 + 1


def test_plan_is_best_fit_decreasing():
    rng = random.Random(11)
    for _ in range(100):
        cap = rng.randint(4, 50)
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(0, 80))]
        bins = []
        for s in sorted(sizes, reverse=True):
            fit = [i for i, b in enumerate(bins) if b >= s]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= s
            else:
                bins.append(cap - s)
        counts = collections.Counter(sizes)
        runs = packing.plan(counts, cap)
        fill = collections.Counter()
        for s, n in counts.items():
            own = sorted(r for r in runs if r[0] == s)
            for k in range(n):
                r = [r for r in own if r[1] <= k][-1]
                fill[r[2] + (k - r[1]) // r[3]] += s
        assert sorted(cap - f for f in fill.values()) == sorted(bins)


# chat


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "Hello there, how\nis the weather?\n\nAlso: second paragraph."),
        (1, 1, "> hello there, how\n> is the  weather?\nFine."),
        (1, 2, ">> hello there, how\n>> is the weather?\n> Fine.\nGood!"),
        (1, 3, "> Also: second paragraph.\n> unknown\nYes"),
        (1, 4, "> nothing anyone said\nno"),
        (2, 0, None), (2, 1, ""), (None, 1, "> x\ny"), (2, 1, ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("hash", F.lit(1)).withColumn("level", F.lit(2))
    out = chat.reply_order(chat.link_quotes(df)).select("conv_id", "turn", "reply.*").collect()
    got = {(r.conv_id, r.turn): r for r in out}
    assert len(out) == len(rows)
    assert [got[1, t].parent_turn for t in range(5)] == [None, 0, 1, 0, None]
    assert [got[1, t].text for t in range(1, 5)] == ["Fine.", "Good!", "Yes", "no"]
    assert [r.turn for r in out if r.conv_id == 1] == [0, 1, 2, 3, 4]
    assert (got[1, 2].root_turn, got[1, 2].depth, got[1, 2].place) == (0, 2, 2) and got[1, 2].n_quotes == 2
    assert got[2, 0].text is None and got[None, 1].text == "y" and got[None, 1].place is None and got[None, 1].depth is None


def test_long_and_negative_turns_sort_as_numbers(spark):
    turns = [-(10**12), -3, 0, 7, 10**9, 10**10, 10**10 + 1, 10**15]
    rows = [(1, t, f"line {t}" if k == 0 else f"> line {turns[k - 1]}\nline {t}") for k, t in enumerate(turns)]
    rows += [(2, t, f"said {t}") for t in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    out = chat.reply_order(chat.link_quotes(df)).select("conv_id", "turn", "reply.*").collect()
    assert [r.turn for r in out if r.conv_id == 1] == turns == [r.turn for r in out if r.conv_id == 2]
    assert [r.parent_turn for r in out if r.conv_id == 1] == [None, *turns[:-1]]
    assert all(r.root_turn == (turns[0] if r.conv_id == 1 else r.turn) for r in out)


def test_chat_runs_no_python(spark):
    plan = chat.link_quotes(spark.createDataFrame([(1, 0, "> a\nb")], "conv_id long, turn long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# chroma


def test_alignment_finds_the_offset(spark):
    rng = np.random.default_rng(12)
    t = np.arange(chroma.HOP) / chroma.RATE

    def tune(notes, noise=0.0):
        x = np.concatenate([np.sin(2 * np.pi * 110 * 2 ** (n / 12) * t) * 9000 for n in notes])
        return x + rng.standard_normal(len(x)) * noise

    a, b = rng.integers(0, 24, 120), rng.integers(0, 24, 120)
    rows = [(0, tune(a)), (1, tune(np.concatenate([b[:40], a]), 60)), (2, tune(b)), (3, tune(a)), (4, None), (5, np.zeros(9000))]
    media = spark.createDataFrame([(i, None if x is None else bytearray(chroma.wav_bytes(x))) for i, x in rows] + [(6, bytearray(b"junk")), (7, bytearray(b""))], "id long, audio binary")
    members, found = chroma.align(chroma.fingerprints(media, "id", "audio"), spark.createDataFrame([(0,), (2,)], "id long"))
    assert {r.id: r.class_id for r in members.collect()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 4, 5: 5, 6: 6, 7: 7}
    got = {(r.query_class, r.match_class): r for r in found.collect()}
    assert got[0, 1].frame_offset == 40 and got[0, 1].bit_error < 0.15
    assert (0, 2) not in got


def test_matches_against_all_alignments(spark):
    """Cut-outs and noisy copies: what aligning every pair at every offset finds under the error bound is found."""
    rng = np.random.default_rng(14)
    t = np.arange(chroma.HOP) / chroma.RATE
    notes = np.stack([np.sin(2 * np.pi * 110 * 2 ** (k / 12) * t) for k in range(24)]) * np.hanning(chroma.HOP)
    tunes = [notes[rng.integers(0, 24, int(n))].ravel() * 12000 for n in rng.integers(50, 120, 20)]
    rows = list(enumerate(tunes))
    for k, x in enumerate(tunes):
        a = int(rng.integers(0, 15)) * chroma.HOP
        cut = x[a : a + (30, 45, 1000)[k % 3] * chroma.HOP]
        rows.append((100 + k, cut + rng.standard_normal(len(cut)) * (0, 200, 600)[k % 3]))
    rows += [(200, tunes[0]), (201, tunes[0][: 19 * chroma.HOP]), (202, tunes[0][: 5 * chroma.HOP])]
    media = spark.createDataFrame([(i, bytearray(chroma.wav_bytes(x))) for i, x in rows], "id long, audio binary").withColumn("key", F.lit(1)).repartition(5)
    prints = chroma.fingerprints(media, "id", "audio")
    members, found = chroma.align(prints, spark.createDataFrame([(i,) for i in range(20)], "id long"))
    got = {(r.query_class, r.match_class) for r in found.collect()}
    assert {r.id: r.class_id for r in members.collect()}[200] == 0
    p = {r.id: np.frombuffer(r.prints, "<u4") for r in prints.collect()}
    want = set()
    for q in range(20):
        for m in p:
            if m not in (q, 200):
                for off in range(4 - len(p[q]), len(p[m]) - 3):
                    x, y = p[q][max(0, -off) : len(p[m]) - off], p[m][max(0, off) : len(p[q]) + off]
                    if np.bitwise_count(x ^ y).sum() <= 0.1 * 32 * len(x) and len(x) > 8:
                        want.add((q, m))
    assert len(want) >= 20 and len(want & got) >= 0.9 * len(want)


def test_fingerprint_equals_direct_sums():
    rng = np.random.default_rng(13)
    frames = rng.random((40, 12))
    got, weak = chroma.fingerprint([np.zeros((3, 12)), frames, np.zeros((0, 12))])[1]
    assert len(weak) == len(got) == 40 - chroma.SPAN + 1
    frames = np.rint(frames * 4096) / 4096
    for at in (0, 7, len(got) - 1):
        shape, p, high, wide = chroma.filters()[0]
        win = frames[at : at + wide]
        a = win[:, p : p + high].sum()
        b = (win.sum() - a) * high / max(12 - high, 1)
        bits = chroma._GRAY[np.searchsorted(chroma._STEPS, np.log((1 + a) / (1 + b)))]
        assert shape == 0 and got[at] >> np.uint32(30) == bits


# pipeline


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as P

    rng = random.Random(14)
    base = [" ".join(words(rng, 80)) + "." for _ in range(4)]
    shared = " ".join(words(rng, 60)) + "."
    extra = [(10**6 + i, f"{t}\n{shared}", "en", "s", 0) for i, t in enumerate(base)] + [(10**6 + 50, base[0] + f"\n{shared}", "en", "s", 0), (10**6 + 51, "12345 !!!", None, "s", 0), (10**6 + 52, None, None, None, None)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, DOC))
    stash = storage.Stash(spark, "test")
    cols, seen = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        docs = stash.put(stage(spark, docs, SF))
        assert docs.columns == cols
        seen[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert 10**6 + 51 not in seen["language_id"] and 10**6 + 52 not in seen["language_id"]
    rows = list(seen["language_id"].items())
    classes = brute_classes(rows)
    assert set(seen["near_dedup"]) == set(classes.values())
    for i, spans in brute_units(list(seen["near_dedup"].items())).items():
        assert i not in seen["substring_dedup"] or len(seen["substring_dedup"][i]) == len(seen["near_dedup"][i]) - sum(b - a for a, b in spans)
    assert sum(shared in t for t in seen["substring_dedup"].values()) == 1
    assert set(seen["mixing"]) <= set(seen["substring_dedup"])
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(seen["mixing"])
