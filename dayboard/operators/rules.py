"""Rules as data: which rules of a table hit each text.

``rules(ord, key, kind, value)`` has one row for each word or pattern, in the order in which rules are tried: ``kind``
is "text" for a word that the text must contain, or "pattern" for a regular expression that must match somewhere.  A
key may have any number of rows; its place is that of its first.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.text import tag_search_text

#: Bytes of rules up to which each task holds all of them in one automaton.
MOST_BYTES = 32 << 20


def rule_rows(spark: SparkSession, rules: dict[str, list]) -> DataFrame:
    """A rule table of a dictionary of words and compiled patterns; words are lower-cased, as texts are."""
    rows = [(key, "pattern", w.pattern) if isinstance(w, re.Pattern) else (key, "text", str(w).lower()) for key, words in rules.items() for w in words]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, key string, kind string, value string")


def default_rules(spark: SparkSession) -> dict[str, DataFrame]:
    """The rules of types and genres as tables."""
    return {"type": rule_rows(spark, tags.TYPE_RULES), "genres": rule_rows(spark, tags.GENRE_RULES)}


def rule_hits(df: DataFrame, text: str, rules: DataFrame, out: str = "hits", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` with the keys of all rules that hit a text column, in the order of rules; null and no hit give none.

    Rules of up to ``most_bytes`` go to every task, which looks for all words at once with an automaton, one pass over
    a text however many words there are, and tries patterns one by one.  More words are joined instead; more patterns
    are an error, as nothing tells beforehand which could match.  Empty words hit every text that is not null; null
    values hit none.
    """
    rules = rules.where("value is not null and key is not null")
    heavy = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.octet_length("value") + F.octet_length("key") + 64)), F.lit(0))
    words, patterns = rules.agg(heavy("text"), heavy("pattern")).first()
    if patterns > most_bytes:
        raise ValueError(f"patterns take {patterns} bytes; at most {most_bytes} can be tried on every text")
    if words + patterns > most_bytes:
        return _joined(df, text, rules, out, most_bytes)
    keys: dict[str, int] = {}
    table = [(keys.setdefault(r.key, len(keys)), r.kind, r.value) for r in rules.orderBy("ord").select("key", "kind", "value").collect()]
    return df.withColumn(out, _automaton(list(keys), table)(F.col(text)))


def _automaton(keys: list[str], table: list[tuple[int, str, str]]):
    import ahocorasick

    words: dict[str, list[int]] = {}
    always = sorted({k for k, kind, v in table if kind == "text" and v == ""})
    for k, kind, v in table:
        if kind == "text" and v:
            words.setdefault(v, []).append(k)
    patterns = [(k, v) for k, kind, v in table if kind == "pattern"]
    made: list = []  # in each worker once, not sent

    def run(texts: pd.Series) -> pd.Series:
        if not made:
            a = ahocorasick.Automaton()
            for w, ks in words.items():
                a.add_word(w, ks)
            a.make_automaton()
            made.append((a, [(k, re.compile(p)) for k, p in patterns]))
        automaton, compiled = made[0]
        rows = []
        for t in texts:
            if t is None:
                rows.append([])
                continue
            hit = set(always)
            if words:
                for _, ks in automaton.iter(t):
                    hit.update(ks)
            hit.update(k for k, p in compiled if k not in hit and p.search(t))
            rows.append([keys[k] for k in sorted(hit)])
        return pd.Series(rows)

    return F.pandas_udf(run, "array<string>")


def _joined(df: DataFrame, text: str, rules: DataFrame, out: str, most_bytes: int) -> DataFrame:
    """The same for any number of words: the parts of distinct texts that are as long as some word are joined to the
    words."""
    texts = df.select(F.col(text).alias("_t")).where("_t is not null").distinct()
    words = rules.where("kind = 'text'")
    lengths = sorted(r[0] for r in words.select(F.length("value")).distinct().collect())  # no more than the longest word has letters
    places = texts.select("_t", F.explode(F.array(*map(F.lit, lengths))).alias("n")).where("n <= length(_t)")
    parts = places.select("_t", "n", F.explode(F.sequence(F.lit(1), F.length("_t") - F.col("n") + 1)).alias("at"))
    parts = parts.select("_t", F.expr("substring(_t, at, n)").alias("value")).distinct()
    found = parts.join(words.select("key", "value"), "value").select("_t", "key")
    tried = rule_hits(texts, "_t", rules.where("kind = 'pattern'"), "_keys", most_bytes)
    found = found.unionByName(tried.select("_t", F.explode("_keys").alias("key")))
    place = rules.groupBy("key").agg(F.min("ord").alias("place"))
    hits = found.select("_t", "key").distinct().join(place, "key").groupBy("_t").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("_h"))
    hits = hits.select("_t", F.col("_h.key").alias("_hits"))
    return df.join(hits, df[text] == hits["_t"], "left").select(*df.columns, F.coalesce("_hits", F.array().cast("array<string>")).alias(out))


def first_key(hits: Column, default: str = "other") -> Column:
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(default))


def first_keys(hits: Column, most: int = 2) -> Column:
    return F.slice(hits, 1, most)


def tagged(events: DataFrame, types: DataFrame, genres: DataFrame) -> DataFrame:
    """Events ``(title, venue_category, ..)`` with ``type`` and ``genres`` by tables of rules."""
    rows = events.withColumn("_text", tag_search_text(tags.search_text(F.col("title"), F.col("venue_category"))))
    rows = rule_hits(rule_hits(rows, "_text", types, "_types"), "_text", genres, "_genres")
    return rows.select(*events.columns, first_key(F.col("_types")).alias("type"), first_keys(F.col("_genres")).alias("genres"))
