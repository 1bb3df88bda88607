"""A training-corpus pipeline over ``documents``: part of the subpackage ``dayboard.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and gets all that the stage before it kept.  All but the last return the
columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayboard.llm import langid, mixing, minhash, packing, substring
from dayboard.llm.data import table
from dayboard.llm.queries import TARGETS, domains, language_model, tokenizer_path
from dayboard.llm.storage import Stash

_BASE = "documents"


#: Texts whose language scores less are rejected.  Of held-out texts in a learned language none scored below 0.49.
MIN_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: null texts, texts without a letter and those under ``MIN_SCORE`` go.

    Without labelled rows there is no model and no score, and only what has no letter goes.
    """
    model = language_model(docs)
    if not model.families:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")  # whatever the columns are called
    told = langid.identify(rows, "text", model, ["row"])
    return told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id.

    Rows that repeat an id are one document, of which the row with the least text stays (null last); rows without an
    id all stay, and so do blank texts.
    """
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("text")))
        row = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
        docs = row.withColumn("nth", nth).where("nth = 1").select("row.*").unionByName(docs.where("doc_id is null"))
    classes = minhash.near_duplicates(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(classes, docs["doc_id"] == classes["_gone"], "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines, paragraphs and runs of sentences that stand earlier in the corpus; documents left blank by
    that go.  Null texts and rows without an id stay as they are."""
    out = substring.remove_repeats(docs, out_col="_deduped_text")
    blank = (F.size("_deduped_text.start") > 0) & (F.trim(F.regexp_replace("_deduped_text.text", r"\s+", " ")) == "")
    changed = {"text": F.col("_deduped_text.text"), "n_chars": F.length("_deduped_text.text").cast("long")}
    return out.where(~F.coalesce(blank, F.lit(False))).withColumns({k: v for k, v in changed.items() if k in docs.columns}).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned towards the target weights.

    Rates run from 0 to 1, and good documents have rate 1, so they all stay; the others stay with a chance of their
    rate, by a hash of the id.  Rows without an id stay; rows that repeat an id go together if the rate of any says so.
    """
    model = mixing.fit_domains(domains(table(spark, sf_dir, "labels")), docs, "domain")
    rates = mixing.fit_rates(docs, model, TARGETS, protected="good", most=1.0)
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    gone = rates.where((F.col("rate") < 1) & (draw >= F.col("rate"))).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, null and empty texts too, with their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mix), ("packing", pack)]

#: Classifiers and hashed signatures are beyond SQL; the tests run each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again by the next."""
    stash = Stash(spark, "pipeline")
    docs = table(spark, sf_dir, _BASE)
    for _, stage in STAGES[:-1]:
        docs = stash.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
