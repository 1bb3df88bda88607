"""Document fingerprints by one-permutation MinHash, in built-in functions only.

A text is the set of its shingles of ``n_words`` words (lower case; words are runs of letters, digits and marks).
Each shingle is hashed once.  The upper eight bits of a hash name one of 256 bins, and a bin keeps its least hash: the
hashes are sorted with an upper bound of every bin among them, so the first of each bin is its least, or the bound
where the bin is empty.  An empty bin takes the value of the first filled bin in a random order of its own (optimal
densification): eight draws, then all filled bins in the order of a hash, so every bin ends up filled.  Stored are
the eight low bits of each value hashed with its bin (else chance would make the copies of one value agree together),
eight to an integer.

Two fingerprints agree in a value with probability ``J + (1 - J) / 256`` for texts of similarity J, which
``likeness`` turns round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayboard.operators.ordering import followers

from .storage import Stash

BINS = 256
_LOW = 56  # bits of a hash below the bin's number
_DRAWS = 8
_LANES = 8  # values of eight bits in a packed integer

_long = lambda x: F.lit(x).cast("long")


def _bound(bin_: Column) -> Column:
    """The largest number in a bin, which stands for "empty" (bins are signed, as the hashes are)."""
    return F.shiftleft(bin_, _LOW).bitwiseOR(_long((1 << _LOW) - 1))


def with_fingerprint(df: DataFrame, text: str, out: str, n_words: int = 5) -> DataFrame:
    """``df`` with the fingerprint of a text column: ``array<bigint>`` of 32 packed integers, equal for equal texts.

    A text of fewer words is one shingle of all its words; one without a word (blank and punctuation too) is one
    shingle of its own; a null is as an empty text.
    """
    # steps are columns of their own, so that a step is computed once and lambdas only look things up in it
    w, h, firsts, full = (f"{out}_{x}" for x in ("words", "hashes", "firsts", "full"))
    body = F.coalesce(F.col(text), F.lit(""))
    split = F.array_remove(F.split(F.lower(body), r"[^\p{L}\p{N}\p{M}]+"), "")
    df = df.withColumn(w, F.transform(split, lambda x: F.xxhash64(x)))
    runs = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(F.col(w), i + k) for k in range(1, n_words)]))  # null, which a hash skips, beyond the end
    shingles = F.slice(runs, 1, F.greatest(F.size(w) - n_words + 1, F.lit(1)))
    shingles = F.when(F.size(w) > 0, shingles).otherwise(F.array(F.xxhash64(F.lit("bare"), body)))
    bounds = F.array(*[_bound(_long(b)) for b in range(-BINS // 2, BINS // 2)])
    df = df.withColumn(h, F.sort_array(F.concat(shingles, bounds))).drop(w)
    bin_ = lambda x: F.shiftright(x, _LOW)
    df = df.withColumn(firsts, F.filter(h, lambda x, i: (i == 0) | (bin_(x) != bin_(F.get(F.col(h), i - 1))))).drop(h)
    empty = lambda x: x == _bound(bin_(x))
    df = df.withColumn(full, F.transform(firsts, lambda x: F.when(~empty(x), x)))

    def drawn(x: Column, i: Column) -> Column:
        draws = [F.get(F.col(full), F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(_DRAWS)]
        rest = F.array_min(F.transform(F.filter(full, lambda y: y.isNotNull()), lambda y: F.struct(F.xxhash64(i, bin_(y)).alias("draw"), y.alias("value"))))["value"]
        return F.coalesce(x, *draws, rest)

    df = df.withColumn(firsts, F.transform(full, drawn)).drop(full)

    def packed(p: Column) -> Column:
        value = lambda i: F.xxhash64(F.get(F.col(firsts), i), i)  # noqa: E731  copies of one value differ from bin to bin
        lanes = [F.shiftleft(value(p * _LANES + k).bitwiseAND(_long(255)), 8 * k) for k in range(_LANES)]
        return _either(lanes)

    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(BINS // _LANES - 1)), packed)).drop(firsts)


def _either(lanes: list[Column]) -> Column:
    out = lanes[0]
    for x in lanes[1:]:
        out = out.bitwiseOR(x)
    return out


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two fingerprints' texts, from 0 to 1; null if either is null."""

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for k in (4, 2, 1):  # gather the bits of each lane in its lowest
            d = d.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(d.bitwiseAND(_long(0x0101010101010101)))

    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    agree = 1 - off / BINS
    return F.when(off.isNotNull(), F.greatest(F.lit(0.0), (agree - 1 / 256) / (1 - 1 / 256)))


def as_text(fingerprint: Column) -> Column:
    """A fingerprint in hexadecimal digits."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, n_chars, fingerprint, edited, next_fingerprint)`` of every row: the edited text has its last
    floor(n_chars / 2) code points replaced by the first as many, or all, of the next document's.

    The next document is that of the next greater id, after the greatest that of the least; of rows that repeat an id
    the one with the least text is it.  Rows without an id have no next document: their edited text is their own and
    the next fingerprint null.  Null texts are as empty ones.  Texts are shuffled once by their ids, and what a
    document lends to the one before it once more.
    """
    stash = Stash(docs.sparkSession, "fingerprint")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = stash.put(base.where("id is not null").groupBy("id").agg((F.max(F.length("text")) / 2).cast("int").alias("most"), F.count("*").alias("rows")))
    links = stash.put(followers(sizes, "id").join(sizes.select("id", "most"), "id").select("id", "most", "next"))
    hashed = with_fingerprint(base, "text", "fingerprint")
    known = hashed.where("id is not null")
    lent = links.select("most", F.col("id").alias("to"), F.col("next").alias("id")).join(known.hint("merge"), "id")  # by sorting: the same shuffle of texts then serves both joins
    lent = lent.select(F.col("to").alias("id"), F.expr("left(text, most)").alias("lent"), F.col("fingerprint").alias("next_fingerprint"), F.col("text").alias("whole"))
    if sizes.where("rows > 1").isEmpty():
        lent = lent.drop("whole")
    else:
        lent = lent.groupBy("id").agg(F.min(F.struct("whole", "lent", "next_fingerprint")).alias("r")).select("id", "r.lent", "r.next_fingerprint")
    n, half = F.length("text"), (F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("lent", half))
    own = known.join(lent.hint("merge"), "id", "left").select("id", "text", n.alias("n_chars"), "fingerprint", edited.alias("edited"), "next_fingerprint")
    alone = hashed.where("id is null").select("id", "text", n.alias("n_chars"), "fingerprint", F.col("text").alias("edited"), F.lit(None).cast("array<bigint>").alias("next_fingerprint"))
    return own.unionByName(alone)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    See ``edited_texts`` for what is compared, and for nulls and repeated ids; other columns are not read, whatever
    their names.  Without a next document ``near_next`` is null.
    """
    rows = with_fingerprint(edited_texts(docs, id_col, text_col).drop("text"), "edited", "edited_fingerprint")
    return rows.select(
        F.col("id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
