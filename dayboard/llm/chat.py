"""Quotation linking: who replies to whom, from quoted passages.  DataFrame functions only.

Lines that start with ``>`` are quoted, as deep as they have such signs.  A run of lines of equal depth is a
passage.  Passages and, for partial quotes, their single lines are normalised and hashed; so are the bodies,
paragraphs and lines that messages say themselves.  A quote is joined to the earliest message of its conversation
that says it, which is one row per hash however often it is said.  A message answers the latest original of its
shallowest linked quote; the trees of these answers order a conversation by replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dayboard.operators.ordering import positions

from .storage import Stash

_QUOTED = r"^\s*>"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _own(text: Column) -> Column:
    """The text without quoted lines and without blank lines around it."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(_QUOTED))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def _key(conv: str, hashed: Column) -> list[Column]:
    return [F.col(conv), hashed.alias("hash")]


def quoted_passages(messages: DataFrame) -> DataFrame:
    """``(conv, turn, passage, level, body, lines)`` of every quoted run of the messages ``(conv, turn, text)``."""
    rows = messages.where(F.col("text").rlike("(?m)" + _QUOTED)).distinct().withColumn("digest", F.md5("text"))
    lines = rows.select("conv", "turn", "digest", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    prefix = F.regexp_extract("line", r"^((?:\s*>)*)", 1)
    lines = lines.withColumn("level", F.length(prefix) - F.length(F.replace(prefix, F.lit(">"), F.lit(""))))
    by_message = Window.partitionBy("conv", "turn", "digest").orderBy("n")
    change = F.when(F.col("level") == F.lag("level").over(by_message), 0).otherwise(1)
    lines = lines.withColumn("change", change).withColumn("run", F.sum("change").over(by_message)).where("level > 0")
    body = F.regexp_replace("line", r"^(?:\s*>)+\s?", "")
    runs = lines.groupBy("conv", "turn", "digest", "run", "level").agg(F.array_sort(F.collect_list(F.struct("n", body.alias("body")))).alias("lines"))
    return runs.select("conv", "turn", F.struct("digest", "run").alias("passage"), "level", F.col("lines.body").alias("lines"))


def reply_places(links: DataFrame, stash: Stash) -> DataFrame:
    """``(conv, turn, root, depth, place)`` of every message that answers or is answered, from ``links(conv, turn, parent)``:
    its place, from 0, when its tree is read with each message right after what it answers and the earlier answers there.

    A walk round each tree enters and leaves every message once; which step follows which is known from first answers
    and next ones.  Ranking that list by jumping over twice as many steps each round gives all three numbers, so a row
    stays of one size however long a chain of answers is, and a chain of n takes about log n rounds.
    """
    children = stash.put(links.where("parent is not null").select("conv", "turn", "parent"))
    nodes = children.select("conv", "turn").unionByName(children.select("conv", F.col("parent").alias("turn"))).distinct()
    first = children.groupBy("conv", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    nth = positions(children, ["turn"], ["conv", "parent"])
    after = nth.select("conv", "parent", F.col("turn").alias("sibling"), (F.col("position") - 1).alias("position"))
    tree = nodes.join(first, ["conv", "turn"], "left").join(nth.join(after, ["conv", "parent", "position"], "left").select("conv", "turn", "parent", "sibling"), ["conv", "turn"], "left")
    there = lambda turn, leave: F.struct(F.col(turn).alias("turn"), F.lit(leave).alias("leave"))
    enter = F.struct(F.lit(False).alias("leave"), F.coalesce(F.when(F.col("child").isNotNull(), there("child", False)), there("turn", True)).alias("next"))
    leave = F.struct(F.lit(True).alias("leave"), F.coalesce(F.when(F.col("sibling").isNotNull(), there("sibling", False)), F.when(F.col("parent").isNotNull(), there("parent", True))).alias("next"))
    steps = tree.select("conv", "turn", F.explode(F.array(enter, leave)).alias("s")).select("conv", "turn", "s.leave", "s.next")
    # from a step up to the one that it points at: messages entered, and how much deeper it leads
    up = F.when(F.col("leave"), -1).otherwise(1).cast("long")
    steps = stash.put(steps.select("conv", "turn", "leave", F.col("next.turn").alias("to"), F.col("next.leave").alias("to_leave"), F.greatest(up, F.lit(0)).alias("entered"), up.alias("deeper"), F.when(F.col("next").isNull(), F.col("turn")).alias("root")))
    while not steps.where("to is not null").isEmpty():
        ahead = steps.select("conv", F.col("turn").alias("to"), F.col("leave").alias("to_leave"), F.col("to").alias("far"), F.col("to_leave").alias("far_leave"), F.col("entered").alias("more"), F.col("deeper").alias("more_deep"), F.col("root").alias("last"))
        both = steps.where("to is not null").join(ahead, ["conv", "to", "to_leave"])
        moved = both.select("conv", "turn", "leave", F.col("far").alias("to"), F.col("far_leave").alias("to_leave"), (F.col("entered") + F.col("more")).alias("entered"), (F.col("deeper") + F.col("more_deep")).alias("deeper"), F.col("last").alias("root"))
        done = steps.where("to is null")
        after_round = stash.put(moved.unionByName(done.select(moved.columns)))
        stash.drop(steps)
        steps = after_round
    entered = steps.where("not leave").select("conv", "turn", "root", "entered", (-F.col("deeper")).alias("depth"))
    sizes = entered.where("turn = root").select("conv", "root", F.col("entered").alias("size"))
    return entered.join(sizes, ["conv", "root"]).select("conv", "turn", "root", "depth", (F.col("size") - F.col("entered")).alias("place"))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``messages`` with ``reply``: a struct of the text without quotes, the counts of quoted passages and of those
    that were linked, the turn answered, the root that answers lead up to, the depth below it, and the place in the
    root's tree of answers; root and place sort a conversation in reply order (each message right after what it answers
    and its earlier answers).

    Messages that link to nothing are roots.  Null texts have null text and no quotes; a null conversation or turn
    links to nothing and has neither root, depth nor place.  Rows that repeat a turn are told apart by nothing and share their links.
    An existing column ``reply`` is replaced; columns of other names do not matter.
    """
    stash = Stash(messages.sparkSession, "chat")
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(text_col).alias("text")).where("conv is not null and turn is not null and text is not null")
    quotes = stash.put(quoted_passages(rows))

    own = _own(F.col("text"))
    said = F.flatten(F.array(F.array(own), F.split(own, r"\n\s*\n", -1), F.split(own, "\n", -1)))
    units = rows.join(quotes.select("conv").distinct(), "conv", "left_semi").select("conv", "turn", F.explode(F.array_distinct(F.transform(said, _normal))).alias("unit")).where("unit <> ''")
    first = units.groupBy(*_key("conv", F.md5("unit"))).agg(F.min("turn").alias("original"))

    whole = F.array(F.struct(F.lit(0).alias("part"), F.array_join("lines", "\n").alias("unit")))
    parts = F.when(F.size("lines") > 1, F.transform("lines", lambda x: F.struct(F.lit(1).alias("part"), x.alias("unit")))).otherwise(F.array())
    asked = quotes.select("conv", "turn", "passage", "level", F.explode(F.concat(whole, parts)).alias("u")).select("conv", "turn", "passage", "level", "u.part", _normal(F.col("u.unit")).alias("unit"))
    met = asked.withColumn("hash", F.md5("unit")).join(first, ["conv", "hash"], "left").withColumn("original", F.when((F.col("original") < F.col("turn")) & (F.col("unit") != ""), F.col("original")))
    linked = met.groupBy("conv", "turn", "passage", "level").agg(F.coalesce(F.max(F.when(F.col("part") == 0, F.col("original"))), F.max("original")).alias("original"))
    best = F.max(F.when(F.col("original").isNotNull(), F.struct((-F.col("level")).alias("depth"), F.col("original")))).getField("original")
    links = stash.put(linked.groupBy("conv", "turn").agg(F.count("*").alias("n_quotes"), F.count("original").alias("n_linked"), best.alias("parent")))

    placed = stash.put(reply_places(links, stash))
    found = links.join(placed, ["conv", "turn"], "full").select(F.col("conv").alias("_link_conv"), F.col("turn").alias("_link_turn"), F.struct("n_quotes", "n_linked", "parent", "root", "depth", "place").alias("_link"))
    joined = messages.join(found, (messages[conv_col] == found["_link_conv"]) & (messages[turn_col] == found["_link_turn"]), "left")
    known = messages[conv_col].isNotNull() & messages[turn_col].isNotNull()
    reply = F.struct(
        _own(messages[text_col]).alias("text"),
        F.coalesce("_link.n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("_link.n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("_link.parent").cast("long").alias("parent_turn"),
        F.when(known, F.coalesce("_link.depth", F.lit(0))).cast("long").alias("depth"),
        F.when(known, F.coalesce("_link.root", messages[turn_col])).cast("long").alias("root_turn"),
        F.when(known, F.coalesce("_link.place", F.lit(0))).cast("long").alias("place"),
    )
    return joined.withColumn("reply", reply).drop("_link_conv", "_link_turn", "_link")


def reply_order(linked: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The messages sorted by conversation, root and place; large conversations spread over several tasks."""
    return linked.orderBy(conv_col, "reply.root_turn", "reply.place")
