"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches


def labelled_sample(rows: DataFrame, label_col: str, id_col: str, per_class: int, most_labels: int = 256) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each label, drawn by a hash of the id, and the count of every label.

    The draw is a filter on the scan: no shuffle of texts.  All rows of rarer labels are taken.  A model learns the
    ``most_labels`` most frequent labels, so that a dirty label column cannot make it or the sample large.
    """
    small_batches(rows.sparkSession)
    most = rows.groupBy(label_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label_col).limit(most_labels)
    counts = {r[0]: r[1] for r in most.collect()}
    if not counts:
        return rows.limit(0), counts
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_class / n))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(draw < share[F.col(label_col)]), counts


def labelled_texts(labels: DataFrame, docs: DataFrame, label_col: str, id_col: str, text_col: str, per_class: int) -> tuple[DataFrame, dict]:
    """``(label, text)`` of a sample of the labelled documents, and the count of every label.

    Only the sampled ids are broadcast: about ``per_class`` for each label, however large the tables are.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label")).where("id is not null and label is not null")
    sample, counts = labelled_sample(rows, "label", "id", per_class)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return texts.join(F.broadcast(sample), "id").select("label", "text"), counts
