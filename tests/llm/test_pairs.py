"""Pairs of texts just above the threshold: whatever shares a bucket is compared on its shingles."""

import random

from dayboard.llm import minhash


def test_lone_pairs_at_the_threshold_are_linked_if_they_share_a_bucket(spark):
    rng = random.Random(21)
    rows, near = [], 0
    for k in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        other = list(words)
        for at in rng.sample(range(0, 120, 12), rng.choice([2, 2, 3])):
            other[at] = f"v{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(116)} for i, t in rows}
    keys = {}
    for i, t in rows:
        el, w = minhash.weighted_shingles(t, 5)
        keys[i] = minhash.dart_signature(el, w, 150).reshape(25, 6)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(60):
        a, b = sets[2 * k], sets[2 * k + 1]
        similar = len(a & b) / len(a | b) >= 0.8 and (keys[2 * k] == keys[2 * k + 1]).all(axis=1).any()
        near += similar
        assert (got[2 * k] == got[2 * k + 1]) == similar
    assert near > 20
