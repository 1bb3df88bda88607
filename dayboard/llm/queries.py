"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, chroma, fingerprint, html_extract, langid, lexical, minhash, mixing, packing, spelling, substring, toxicity
from .data import table

TOKENIZER = "byte_bpe_50k.json"
#: Weights that the mixing query and the pipeline aim at; domains come from the labels table.
TARGETS = {"good": 0.90, "plain": 0.08, "toxic": 0.02}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def domains(labels: DataFrame) -> DataFrame:
    """Labelled documents by domain: toxic, else good or plain by quality."""
    return labels.withColumn("domain", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain"))


def language_model(docs: DataFrame) -> langid.LanguageModel:
    return langid.fit_language_model(docs.where(~langid.held_out("doc_id", 3, 1)), "doc_id", "text", "lang")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", langid.held_out("doc_id", 3, 1).alias("held_out"))
    return langid.identify(rows, "text", language_model(docs), ["doc_id", "held_out"])


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.zip_with("deduped.start", "deduped.end", lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string")))
    gone = F.aggregate(F.zip_with("deduped.start", "deduped.end", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return out.select("doc_id", F.col("deduped.text").alias("text"), F.array_join(spans, ",").alias("removed"), gone.alias("chars_removed"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixing.fit_domains(domains(table(spark, sf_dir, "labels")), docs, "domain")
    out = mixing.fit_rates(docs, model, TARGETS)
    return out.select("doc_id", "tokens", "rate", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(labels.where(~langid.held_out("doc_id", 4, 2)), docs)
    rows = docs.select("doc_id", "text", langid.held_out("doc_id", 4, 2).alias("held_out"))
    out = toxicity.score(rows, "text", model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int")).select("doc_id", "held_out", "score", "predicted", F.col("offending.start").alias("offending_start"), F.col("offending.end").alias("offending_end"), F.col("offending.score").alias("offending_score"))


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0").select("vec_id"), "vec_id", "embedding")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(table(spark, sf_dir, "conversations"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for conversations in which every message quotes the two before it, as replies by mail do."""
    c = table(spark, sf_dir, "conversations")
    said = c.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    back = lambda n, name: said.select("conv_id", (F.col("turn") + n).alias("turn"), F.concat(F.lit(">" * n + " "), F.replace("said", F.lit("\n"), F.lit("\n" + ">" * n + " "))).alias(name))
    both = c.join(back(2, "two"), ["conv_id", "turn"], "left").join(back(1, "one"), ["conv_id", "turn"], "left")
    return _linked(both.select("conv_id", "turn", "role", F.concat_ws("\n", "two", "one", "text").alias("text")))


def _linked(conversations: DataFrame) -> DataFrame:
    linked = chat.link_quotes(conversations)
    return linked.select("conv_id", "turn", "role", "reply.text", "reply.n_quotes", "reply.n_linked", "reply.parent_turn", "reply.depth", "reply.root_turn", "reply.place")


def op3_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` as a recording; turns of conversations divisible by 50 are the queries.

    A recording's number is the conversation's times 2^32 and the turn's, for numbers below 2^31.
    """
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    key = F.shiftleft(F.col("conv_id").cast("long"), 32) + F.col("turn")
    prints = chroma.fingerprints(chroma.sonify(turns.select(key.alias("id"), "text")), "id", "audio")
    queries = turns.where("conv_id % 50 = 0").select(key.alias("id"))
    members, matches = chroma.align(prints, queries)
    empty = {"frame_offset": "int", "votes": "long", "overlap": "int", "bit_error": "double"}
    member_rows = members.select(F.lit("member").alias("kind"), F.col("id").alias("recording"), "class_id", *[F.lit(None).cast(t).alias(n) for n, t in empty.items()])
    match_rows = matches.select(F.lit("match").alias("kind"), F.col("query_class").alias("recording"), F.col("match_class").alias("class_id"), *empty)
    return member_rows.unionByName(match_rows)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document's runs one in 31, by a hash, loses a letter; a document without an id keeps its runs as they are."""
    upper = "".join(map(chr, range(65, 91)))
    runs = F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit("[A-Za-z\u00C0-\u00FF]{7,}"), F.lit(0))  # shorter ones make no word
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run"))))
    cut = F.expr("concat(left(run, int(h % length(run))), substring(run, int(h % length(run)) + 2))")
    return spelling.variants(spelling.vocabulary(rows.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word")), "word"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, md5(text) AS digest FROM conversations),
d AS (SELECT DISTINCT conv_id, turn, text, digest FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL),
lines AS (SELECT conv_id, turn, digest, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
lv AS (SELECT *, length(regexp_extract(line, '^((?:\s*>)*)', 1)) - length(replace(regexp_extract(line, '^((?:\s*>)*)', 1), '>', '')) AS level FROM lines),
ch AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY conv_id, turn, digest ORDER BY n) THEN 0 ELSE 1 END AS change FROM lv),
rn AS (SELECT *, sum(change) OVER (PARTITION BY conv_id, turn, digest ORDER BY n) AS run, regexp_replace(line, '^(?:\s*>)+\s?', '') AS body FROM ch),
q AS (SELECT conv_id, turn, digest, run, level, string_agg(body, chr(10) ORDER BY n) AS whole, list(body ORDER BY n) AS bodies FROM rn WHERE level > 0 GROUP BY ALL),
own AS (SELECT conv_id, turn, digest, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT regexp_matches(line, '^\s*>')), ''), '^\s+|\s+$', '', 'g') AS text FROM lines GROUP BY conv_id, turn, digest),
said AS (SELECT conv_id, turn, text AS u FROM own UNION SELECT conv_id, turn, unnest(regexp_split_to_array(text, '
\s*
')) FROM own UNION SELECT conv_id, turn, unnest(string_split(text, chr(10))) FROM own),
firsts AS (SELECT conv_id, trim(regexp_replace(lower(u), '\s+', ' ', 'g')) AS unit, min(turn) AS original FROM said GROUP BY 1, 2),
asked AS (SELECT conv_id, turn, digest, run, level, 0 AS part, whole AS u FROM q UNION ALL SELECT conv_id, turn, digest, run, level, 1, unnest(bodies) FROM q WHERE len(bodies) > 1),
met AS (SELECT a.*, CASE WHEN f.original < a.turn AND f.unit <> '' THEN f.original END AS original FROM asked a LEFT JOIN firsts f ON f.conv_id = a.conv_id AND f.unit = trim(regexp_replace(lower(a.u), '\s+', ' ', 'g'))),
linked AS (SELECT conv_id, turn, digest, run, level, coalesce(max(original) FILTER (WHERE part = 0), max(original)) AS original FROM met GROUP BY ALL),
links AS (SELECT conv_id, turn, count(*) AS n_quotes, count(original) AS n_linked, max(struct_pack(d := -level, o := original)) FILTER (WHERE original IS NOT NULL) AS best FROM linked GROUP BY ALL),
parents AS (SELECT conv_id, turn, n_quotes, n_linked, best.o AS parent FROM links),
walk AS (SELECT conv_id, turn, parent AS up, lpad(turn::VARCHAR, 10, '0') AS path FROM parents WHERE parent IS NOT NULL
  UNION ALL SELECT w.conv_id, w.turn, p.parent, concat(lpad(w.up::VARCHAR, 10, '0'), '/', w.path) FROM walk w LEFT JOIN parents p ON p.conv_id = w.conv_id AND p.turn = w.up WHERE w.up IS NOT NULL),
paths AS (SELECT conv_id, turn, path, string_split(path, '/')[1]::BIGINT AS root, len(string_split(path, '/')) - 1 AS depth FROM walk WHERE up IS NULL),
nodes AS (SELECT * FROM paths UNION SELECT DISTINCT conv_id, root, lpad(root::VARCHAR, 10, '0'), root, 0 FROM paths),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, root ORDER BY path) - 1 AS place FROM nodes)
SELECT m.conv_id, m.turn, m.role, CASE WHEN m.text IS NULL THEN NULL WHEN o.text IS NOT NULL THEN o.text ELSE m.text END AS text, coalesce(p.n_quotes, 0)::BIGINT AS n_quotes, coalesce(p.n_linked, 0)::BIGINT AS n_linked, p.parent AS parent_turn,
  CASE WHEN m.conv_id IS NOT NULL AND m.turn IS NOT NULL THEN coalesce(w.depth, 0) END::BIGINT AS depth, CASE WHEN m.conv_id IS NOT NULL THEN coalesce(w.root, m.turn) END::BIGINT AS root_turn, CASE WHEN m.conv_id IS NOT NULL AND m.turn IS NOT NULL THEN coalesce(w.place, 0) END::BIGINT AS place
FROM m LEFT JOIN own o USING (conv_id, turn, digest) LEFT JOIN parents p USING (conv_id, turn) LEFT JOIN placed w USING (conv_id, turn)
"""

QUOTED_SQL = OP2_SQL.replace(
    "WITH RECURSIVE m AS",
    """WITH RECURSIVE said AS (SELECT conv_id, turn, min(text) AS said FROM conversations GROUP BY ALL),
mail AS (SELECT c.conv_id, c.turn, c.role, concat_ws(chr(10), '>> ' || replace(b.said, chr(10), chr(10) || '>> '), '> ' || replace(a.said, chr(10), chr(10) || '> '), c.text) AS text FROM conversations c LEFT JOIN said b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2 LEFT JOIN said a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1),
m AS""",
).replace("FROM conversations)", "FROM mail)").replace("said AS (SELECT conv_id, turn, text AS u", "spoken AS (SELECT conv_id, turn, text AS u").replace("original FROM said GROUP", "original FROM spoken GROUP")

OP1_SQL = r"""
WITH parts AS (SELECT doc_id, text, regexp_extract_all(text, '[^.!?\n]*(?:[.!?]+[ \t]*\n?|\n)|[^.!?\n]+') AS us FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
a AS (SELECT doc_id, unnest(us) AS u, generate_subscripts(us, 1) AS k FROM parts),
b AS (SELECT *, sum(length(u)) OVER w - length(u) AS s, sum(length(u)) OVER w AS e, coalesce(sum(CASE WHEN u LIKE '%' || chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line,
  trim(regexp_replace(u, '\s+', ' ', 'g')) AS n FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
c AS (SELECT *, CASE WHEN n = '' THEN 0 ELSE length(n) - length(replace(n, ' ', '')) + 1 END AS words FROM b),
lines AS (SELECT doc_id, line, sum(words) = 0 AS empty FROM c GROUP BY doc_id, line),
paras AS (SELECT doc_id, line, coalesce(sum(empty::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS para FROM lines),
said AS (SELECT c.*, p.para, sum(words) OVER (PARTITION BY doc_id, para ORDER BY k) AS total FROM c JOIN paras p USING (doc_id, line) WHERE words > 0),
spans AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM said GROUP BY doc_id, line HAVING sum(words) >= 20
  UNION SELECT doc_id, min(s), max(e) FROM said GROUP BY doc_id, para HAVING sum(words) >= 20
  UNION SELECT x.doc_id, x.s, y.e FROM (SELECT *, total - words + 20 AS target FROM said) x ASOF JOIN said y ON x.doc_id = y.doc_id AND x.para = y.para AND x.target <= y.total),
units AS (SELECT doc_id, s, e, trim(regexp_replace(lower(regexp_replace(substring(text, (s + 1)::BIGINT, (e - s)::BIGINT), '([.!?]+)', '\1 ', 'g')), '\s+', ' ', 'g')) AS n FROM spans JOIN parts USING (doc_id)),
ranked AS (SELECT *, min(struct_pack(i := doc_id, s := s, e := e)) OVER (PARTITION BY n) AS f FROM units),
gone AS (SELECT DISTINCT doc_id, s, e FROM ranked WHERE doc_id > f.i OR s >= f.e),
marked AS (SELECT b.doc_id, b.k, b.u, b.s, b.e, EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = b.doc_id AND g.s <= b.s AND b.e <= g.e) AS out FROM b),
islands AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, out ORDER BY k) AS island FROM marked),
cut AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM islands WHERE out GROUP BY doc_id, island),
r AS (SELECT doc_id, string_agg(concat(s, '-', e), ',' ORDER BY s) AS removed, sum(e - s) AS chars FROM cut GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(u, '' ORDER BY k) FILTER (WHERE NOT out) AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(r.removed, '') AS removed, coalesce(r.chars, 0)::BIGINT AS chars_removed
FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN r USING (doc_id)
"""

OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(k))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
long AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT *, hex(encode(concat(doc_id, ':', run))) AS x FROM long),
hashed AS (SELECT doc_id, run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i : ('0x' || substring(x, 2 * i + 1, 2))::BIGINT)), lambda c, b : xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
words AS (SELECT CASE WHEN doc_id IS NOT NULL AND h % 31 = 0 THEN concat(substring(run, 1, h % length(run)), substring(run, h % length(run) + 2)) ELSE run END AS word, sum(times)::BIGINT AS n FROM hashed GROUP BY 1),
v AS (SELECT * FROM words WHERE length(word) >= 7 AND n >= 2),
cuts AS (SELECT word, n, i, concat(substring(word, 1, i), substring(word, i + 2)) AS rest FROM v, LATERAL (SELECT unnest(range(length(word))) AS i)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cuts a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -m, other := other)) AS b FROM pairs GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * v.n THEN b.other END AS form, CASE WHEN -b.m >= 10 * v.n THEN -b.m END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form FROM walk w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL),
roots AS (SELECT w.word, w.root FROM walk w JOIN f ON f.word = w.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN roots r USING (word)
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(ts)) AS n_terms FROM d WHERE len(ts) > 0),
w AS (SELECT k, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
tf AS (SELECT k, doc_id, n, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, s GROUP BY term, n_docs),
c AS (SELECT k, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * n_docs) // n_terms)))) AS part FROM tf JOIN df USING (term), s),
r AS (SELECT item_id, k, doc_id, sum(part)::BIGINT AS score FROM q JOIN c USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quotation_linking": op2_quotation_linking,
    "quoted_conversations": quoted_conversations,
    "op3_chroma_fingerprints": op3_chroma_fingerprints,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_near_dedup": op6_near_dedup,
    "op7_ann_search": op7_ann_search,
    "op8_html_extraction": op8_html_extraction,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_fingerprints": op12_fingerprints,
    "op13_lexical_search": op13_lexical_search,
}
SQL = {"op1_substring_dedup": OP1_SQL, "op2_quotation_linking": OP2_SQL, "quoted_conversations": QUOTED_SQL, "op11_spelling_variants": OP11_SQL, "op13_lexical_search": OP13_SQL}
