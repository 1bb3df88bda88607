"""Ranked search of many queries against loops over queries and documents."""

import collections
import random
import re
from math import floor, log

import numpy as np
from pyspark.sql import functions as F

from dayboard.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    counts = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(plain_terms(t))
    out = []
    for i, ts in asked.items():
        found = []
        for d, c in counts:
            m = 100 - 90 + (90 * c.total() * n_docs) // n_terms if c else 0
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_against_loops_in_any_partitions_and_blocks(spark):
    rng = random.Random(7)
    vocab = [f"t{k}" for k in range(60)] + ["É", "né", "Zwei", "zwei", "日本", "a_b", "x-y"]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    text = lambda n: " ".join(rng.choices(vocab, weights, k=n))
    docs = [(k, text(rng.randint(0, 40))) for k in range(150)] + [(900, None), (901, ""), (902, "..."), (903, text(5000)), (None, text(30)), (5, text(9))]
    docs += [(1000 + k, docs[3][1]) for k in range(40)]  # copies: equal scores
    items = [(k, text(rng.randint(1, 12))) for k in range(40)] + [(50, None), (51, ""), (52, "unheard"), (53, text(200)), (7, text(3)), (None, "t1 t2")]
    want = plain(docs, items)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(lexical.search(d, q)) == want
    d = d.withColumn("id", F.lit(1)).withColumn("terms", F.lit("x")).withColumn("score", F.lit(0))
    for parts, size in ((1, 40), (7, 3)):
        assert rows(lexical.search(d.repartition(parts), q.withColumn("rank", F.lit(9)), block_terms=size)) == want


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for x, y in ((d.limit(0), q), (d, q.limit(0)), (d, q.where("item_id > 5"))):
        out = lexical.search(x, y)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_shared_sums_are_right_and_fewer():
    rng = np.random.default_rng(5)
    for window in (4, 64):
        common = [rng.choice(120, 12, replace=False) for _ in range(6)]
        queries = [sorted({*common[k % 6].tolist(), *common[(k * 5) % 6].tolist(), *rng.choice(200, 6).tolist()}) for k in range(60)]
        plan = lexical.share(queries, 200, window)
        value = rng.integers(0, 1 << 40, 200)
        doc, term = np.zeros(200, np.int64), np.arange(200)
        got = lexical.scores(plan, doc, term, value, 2)
        assert got[:, 0].tolist() == [int(value[q].sum()) for q in queries] and not got[:, 1].any()
        adds = len(plan.pairs) + len(plan.nodes) - len(queries) + 200 - plan.n_base
        assert adds < 0.6 * sum(len(q) - 1 for q in queries)


def test_terms():
    assert lexical.terms("Ab_c9 ÉÀ x\x00y Zz".encode()) == [t.encode() for t in plain_terms("Ab_c9 ÉÀ x\x00y Zz")]
