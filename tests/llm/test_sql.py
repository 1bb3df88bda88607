"""Registered queries against their SQL, and a run of each on the smallest tables."""

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from dayboard.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(Q.SQL[name])
    names = [c[0] for c in cur.description]
    got = Q.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    left = sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr)
    assert left == sorted((tuple(r[names.index(c)] for c in order) for r in cur.fetchall()), key=repr)


def test_quotes_same_as_sql(spark, tmp_path):
    """The tables hold few quotes; these are planted."""
    rows = [(1, 0, "u", "How are\nyou all?"), (1, 1, "a", "> how  are\n> you all?\nFine"), (1, 2, "u", ">> how are\n>> you all?\n> Fine\n> lost\nGood"), (1, 3, "u", "> Good\n"), (2, 0, "u", "> x"), (2, 1, "u", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cur = con.execute(Q.OP2_SQL)
    names = [c[0] for c in cur.description]
    got = Q.op2_quotation_linking(spark, str(tmp_path)).select(names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(cur.fetchall(), key=repr)
    assert max(r.depth for r in got) == 3


def test_contracts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    four = Q.op4_language_id(spark, SF)
    assert four.count() == n and {"doc_id", "held_out", "lang_pred", "score"} <= set(four.columns)
    five = Q.op5_toxicity(spark, SF)
    assert five.count() == n and five.where("score between 0 and 1 and predicted = cast(score >= 0.3 as int)").count() == n
    nine = Q.op9_mixing(spark, SF)
    assert nine.count() == n and nine.where("rate >= 0").count() == n
    eight = Q.op8_html_extraction(spark, SF)
    assert eight.where("n_chars = length(text)").count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_registered_packing_equals_the_tokenizers_ids(spark, tmp_path):
    """Every document of the tables and one with added tokens, by the registered query."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(-1, "hello <|endoftext|> world"), (-2, None), (-3, "<|endoftext|>" * 1500)], "doc_id long, text string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(str(tmp_path / "documents.parquet"))
    tok, ids = Tokenizer.from_file(Q.tokenizer_path()), {}
    for r in spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "text").collect():
        ids[r.doc_id] = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
    rows = Q.op10_packing(spark, str(tmp_path)).orderBy("doc_id", "piece").collect()
    ends: dict = {}
    for r in rows:
        assert r.start == ends.get(r.doc_id, 0) and zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        ends[r.doc_id] = r.start + r.length
    assert ends == {k: len(v) for k, v in ids.items()}
    used = sum(len(v) for v in ids.values())
    assert used / 1024 <= len({r.sequence_id for r in rows}) <= 1.02 * used / 1024 + 1


def test_registered_near_dedup_against_all_pairs(spark):
    from .test_operators import brute_classes

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in Q.op6_near_dedup(spark, SF).collect()} == brute_classes(rows)


def test_registered_search_against_brute_force(spark):
    import numpy as np

    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect() if r.embedding is not None]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got: dict = {}
    for r in Q.op7_ann_search(spark, SF).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        hits, total = hits + len(set(want.tolist()) & set(found)), total + len(want)
        assert all(abs(d[ids == v][0] - s) < 1e-9 for v, s in found.items())
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0} and hits >= 0.9 * total


def test_registered_fingerprints_hold_equal_turns_together(spark):
    out = Q.op3_chroma_fingerprints(spark, SF)
    talk = spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id is not null and turn is not null")
    members = {r.recording: r.class_id for r in out.where("kind = 'member'").collect()}
    assert len(members) == talk.count()
    by_text: dict = {}
    for r in talk.where("text is not null").collect():
        by_text.setdefault(r.text, set()).add(members[(r.conv_id << 32) + r.turn])
    assert all(len(c) == 1 for c in by_text.values())
    assert out.where("kind = 'match' and (bit_error > 0.25 or recording = class_id)").count() == 0
