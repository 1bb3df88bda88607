"""Reply order of trees of answers against a plain walk, long chains, and quotes that many answer."""

import random

import pytest

from dayboard.llm import chat, storage


def walk(parents):
    """Root, depth and place of each turn of trees with any answer, by recursion over sorted answers."""
    kids, out = {}, {}
    for t, p in parents.items():
        kids.setdefault(p, []).append(t)
    for root in sorted(p for p in {p for p in parents.values() if p is not None} if parents.get(p) is None):
        todo, place = [(root, 0)], 0
        while todo:
            t, d = todo.pop()
            out[t] = (root, d, place)
            place += 1
            todo += [(c, d + 1) for c in sorted(kids.get(t, []), reverse=True)]
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_places_are_those_of_a_walk(spark, parts):
    rng = random.Random(parts)
    links, want = [], {}
    for conv in range(6):
        n = rng.choice([2, 9, 60])
        turns = sorted(rng.sample(range(-500, 10**12 if conv == 5 else 500), n))
        parents = {t: rng.choice(turns[max(0, i - 4) : i]) if i and rng.random() < 0.8 else None for i, t in enumerate(turns)}
        links += [(conv, t, p) for t, p in parents.items() if p is not None or rng.random() < 0.5]
        want.update({(conv, t): v for t, v in walk(parents).items()})
    df = spark.createDataFrame(links, "conv long, turn long, parent long").repartition(parts)
    got = {(r.conv, r.turn): (r.root, r.depth, r.place) for r in chat.reply_places(df, storage.Stash(spark, "t")).collect()}
    assert got == want


def test_a_long_chain_and_a_hot_message(spark):
    chain = [(1, k, k - 1) for k in range(1, 3001)]
    star = [(2, k, 0) for k in range(1, 3001)]
    df = spark.createDataFrame(chain + star, "conv long, turn long, parent long")
    got = chat.reply_places(df, storage.Stash(spark, "t"))
    assert got.count() == 6002
    assert got.where("conv = 1 and (root <> 0 or depth <> turn or place <> turn)").isEmpty()
    assert got.where("conv = 2 and turn > 0 and (root <> 0 or depth <> 1 or place <> turn)").isEmpty()
    assert len(got.schema) == 5 and "string" not in str(got.dtypes)


def test_nested_quotes_of_many_messages(spark):
    """Every message quotes the one before with all that it quotes, ten deep at most."""
    rows = []
    for conv in range(3):
        said = []
        for k in range(40):
            own = f"message {k} of {conv} says this"
            quoted = [f"{'> ' * (d + 1)}{said[-1 - d]}" for d in range(min(10, len(said)))]
            rows.append((conv, k, "\n".join([*quoted, own])))
            said.append(own)
    rows += rows[:3] + [(0, 100, None), (0, 101, "> nobody said this\nmine"), (0, 102, "> " + "x" * 200000)]
    got = {(r.conv_id, r.turn): r.reply for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    for (conv, k), r in got.items():
        if k < 40:
            assert (r.text, r.root_turn, r.depth, r.place, r.n_quotes, r.n_linked) == (f"message {k} of {conv} says this", 0, k, k, min(10, k), min(10, k))
    assert got[0, 101].root_turn == 101 and got[0, 101].n_linked == 0 and got[0, 101].place == 0 and got[0, 102].text == ""
