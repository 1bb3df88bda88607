"""Spelling variants against every pair of words, hot blocks, and planted cases."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayboard.llm import queries as Q
from dayboard.llm import spelling, storage
from dayboard.llm import textops as T

SF = "/root/testdata/sf0.001"


def near(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=10):
    by = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(by[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(by[w]), counts.get(form.get(w))) for w, n in counts.items()}


def rows(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(set(got)) == len(got)
    return set(got)


@pytest.mark.parametrize("seed,alphabet,most", [(1, "ab", 9), (2, "abcdé", 6), (3, "aÿ😀z", 5)])
def test_all_pairs_of_dense_vocabularies(spark, seed, alphabet, most):
    rng = random.Random(seed)
    counts = {}
    for _ in range(420):
        counts["".join(rng.choices(alphabet, k=rng.randint(1, most)))] = rng.choice([1, 2, 3, 10, 20, 30, 300, 4000])
    counts["".join(rng.choices(alphabet, k=3000))] = 2
    df = spark.createDataFrame([*counts.items(), (None, 5), ("", 5)], "word string, n long").withColumn("m", F.lit(1)).withColumn("block", F.lit("x"))
    want = plain(counts)
    for block_words, parts in ((4096, 1), (3, 5)):  # the second deals nearly every block anew
        assert rows(spelling.variants(df.repartition(parts), block_words=block_words)) == want


def test_every_pair_is_met_in_one_block(spark):
    words = [f"{a}{b}{c}word" for a in "abcde" for b in "abcde" for c in "xyz"] + ["aaaword", "aaaaword", "aaaaaword"]
    for block_words in (4096, 10):
        found = spelling.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), storage.Stash(spark, "t"), block_words)
        got = {r.word: r.n for r in found.groupBy("word").agg(F.sum("near").alias("n")).collect()}
        assert got == {w: n for w in words if (n := sum(near(w, x) for x in words))}


def test_the_acceptor_is_minimal_and_numbers_words():
    words = sorted(a + b for a in ("str", "k", "spr", "w") for b in ("ing", "ings", "ong", "ongs"))
    off = np.cumsum([0, *map(len, words)])
    v = spelling.minimal_acceptor(T.codes("".join(words)), off, np.zeros(len(words), np.int64))
    # the ends are shared: i/o, n, g, s and the end of all, and before them s, t/p, r (k and w lead there too)
    assert len(v.final) == 8
    for k, w in enumerate(words):
        q, n = v.initial, 0
        for c in w:
            e = v.step(q, np.array([ord(c)]))
            assert e[0] >= 0
            q, n = v.target[e], n + int(v.skip[e][0])
        assert v.final[q][0] and n == k
    assert v.step(v.initial, np.array([ord("z")]))[0] == -1


def test_chains_of_forms_and_ties(spark):
    counts = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 1000, "abcdefgx": 10, "lonely": 3}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame([*counts.items()], "word string, n long")).collect()}
    assert got["abcdefg"].form == "abcdefgh" and got["abcdefg"].root == "abcdefghij" and got["abcdefg"].n_near == 2
    assert got["lonely"].form is None and got["lonely"].root == "lonely" and got["lonely"].n_near == 0
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def expected(docs):
    c = collections.Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 31 == 0 and i is not None:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                c[w] += 1
    return plain({w: n for w, n in c.items() if n >= 2})


def test_registered_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(9)
    stems = ["".join(rng.choices("abcdeéÀ×÷Z", k=rng.randint(6, 9))) for _ in range(60)]
    docs = [(k, " ".join(rng.choices(stems, k=200))) for k in range(40)] + [(90, None), (91, ""), (92, "1 2"), (None, " ".join(stems)), (7, "Straße" * 3000 + " ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ")]
    docs += [(7, docs[3][1])]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("run", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(Q.op11_spelling_variants(spark, str(tmp_path))) == expected(docs)
