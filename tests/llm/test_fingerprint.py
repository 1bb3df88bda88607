"""One-permutation fingerprints against a plain version and planted cases."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from dayboard.llm import fingerprint as fp
from dayboard.llm import queries as Q

SF = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def h_long(x, seed):
    return xxhash.xxh64((x & M64).to_bytes(8, "little"), seed=seed & M64).intdigest()


def h_int(x, seed):
    """Spark hashes a 32-bit integer by the four-byte step of XXH64, as XXH64 of its four bytes."""
    return xxhash.xxh64((x & 0xFFFFFFFF).to_bytes(4, "little"), seed=seed & M64).intdigest()


def h_text(x, seed):
    return xxhash.xxh64(x.encode(), seed=seed & M64).intdigest()


def plain(text, n=5):
    """The fingerprint by loops over bins."""
    text = text or ""
    w = [h_text(x, 42) for x in re.split(r"[^\w]|_", text.lower()) if x]
    if w:
        hashes = []
        for i in range(max(1, len(w) - n + 1)):
            s = 42
            for x in w[i : i + n]:
                s = h_long(x, s)
            hashes.append(signed(s))
    else:
        hashes = [signed(h_text(text, h_text("bare", 42)))]
    bins = [None] * 256
    for x in hashes:
        b = (x >> 56) + 128
        bins[b] = x if bins[b] is None else min(bins[b], x)
    out = []
    for i, x in enumerate(bins):
        for t in range(8):
            if x is None:
                x = bins[signed(h_int(t, h_int(i, 42))) % 256]
        if x is None:
            x = min((signed(h_long(y >> 56, h_int(i, 42))), y) for y in bins if y is not None)[1]
        out.append(h_int(i, h_long(x, 42)) & 255)
    return "".join(f"{int.from_bytes(bytes(out[k : k + 8]), 'little'):016X}" for k in range(0, 256, 8))


def bits(a, b):
    same = sum(x == y for x, y in zip(bytes.fromhex(a), bytes.fromhex(b), strict=True))
    return max(0.0, (same / 256 - 1 / 256) / (1 - 1 / 256))


def shingles(t):
    w = [x for x in re.split(r"[^\w]|_", t.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {t}


def expected(rows):
    rows = sorted((i, t or "") for i, t in rows)
    for k, (i, t) in enumerate(rows):
        half, after = len(t) // 2, rows[(k + 1) % len(rows)][1]
        yield i, t, t[: len(t) - half] + after[:half], after


def test_registered_query_against_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in Q.op12_fingerprints(spark, SF).collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    off = []
    for i, t, edited, after in expected(rows):
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == plain(t) and r.edited_fingerprint == plain(edited)
        assert r.near_edited == pytest.approx(bits(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(bits(r.fingerprint, plain(after)))
        a, b = shingles(t), shingles(edited)
        off.append(abs(r.near_edited - len(a & b) / len(a | b)))
    assert max(off) < 0.15 and sum(off) / len(off) < 0.035  # a deviation is 0.03 at most


def test_likeness_is_unbiased(spark):
    rng = random.Random(4)
    rows, want = [], []
    for k in range(60):
        share = k / 60
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        other = base[: int(400 * share)] + [f"v{rng.randrange(10**6)}" for _ in range(400 - int(400 * share))]
        rows.append((" ".join(base), " ".join(other)))
        a, b = map(shingles, rows[-1])
        want.append(len(a & b) / len(a | b))
    df = fp.with_fingerprint(fp.with_fingerprint(spark.createDataFrame(rows, "a string, b string"), "a", "fa"), "b", "fb")
    got = [r[0] for r in df.select(fp.likeness(F.col("fa"), F.col("fb"))).collect()]
    assert abs(sum(g - w for g, w in zip(got, want, strict=True))) / 60 < 0.012
    assert max(abs(g - w) for g, w in zip(got, want, strict=True)) < 0.13


def test_odd_rows(spark):
    long = " ".join(f"w{k % 9000}" for k in range(60000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, long), (7, "***"), (8, "***"), (9, "a"), (10, "a b c d"), (11, "😀 é😀")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (docs, docs.withColumn("id", F.lit(1)).withColumn("edited", F.lit("x")).withColumn("fingerprint", F.lit("y")).repartition(3)):
        got = {r.doc_id: r for r in fp.fingerprints(df).collect()}
        for i, t, edited, _ in expected(rows):
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
            assert got[i].fingerprint == plain(t) and got[i].edited_fingerprint == plain(edited)
    assert got[1].fingerprint == got[2].fingerprint and got[7].fingerprint == got[8].fingerprint != got[3].fingerprint
    assert got[1].near_edited == 1.0


def test_repeated_and_missing_ids(spark):
    rows = [(1, "one two three"), (1, "one two three"), (2, "zwei"), (2, "drei vier"), (None, "nobody's words")]
    got = sorted((r.doc_id or 0, r.n_chars, r.edited_sha256, r.near_next) for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [g[:3] for g in got] == sorted([(0, 14, sha("nobody's words")), (1, 13, sha("one twodrei v")), (1, 13, sha("one twodrei v")), (2, 4, sha("zwon")), (2, 9, sha("drei one "))])
    assert got[0][3] is None and all(g[3] is not None for g in got[1:])
    alone = fp.fingerprints(spark.createDataFrame([(5, "all alone here")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == sha("all aloall alo"[:7] + "all alo")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fp.fingerprints(empty).count() == 0


def test_native_plan_shuffles_texts_once(spark, capsys):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    df = fp.fingerprints(docs)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ReusedExchange" in plan
