"""Text units, phrase search, exact locations and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ternweave.functions import text as X
from ternweave.functions.session import checkpoint_dir
from ternweave.operators import corpus as C
from ternweave.operators.encode import encode_ngrams
from ternweave.plans.common import HEX, codebook_sql, hex_text, query, spread_table, table, words_sql

D = 64

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def strip_sql(e):
    return _STRIP.format(e)


UNITS = f"""
pp AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi FROM
  (SELECT doc_id, list_filter(regexp_split_to_array({strip_sql('text')}, '\\n\\s*\\n'), lambda p: {strip_sql('p')} <> '') AS ps FROM documents)),
ph AS (SELECT *, CAST(regexp_matches(lower(p), '^chapter\\s+[\\p{{L}}\\p{{N}}_]+') AS INT) AS hd FROM pp),
pc AS (SELECT *, 1 + sum(hd) OVER (PARTITION BY doc_id ORDER BY pi) AS chapter FROM ph),
pn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chapter ORDER BY pi) AS paragraph FROM pc WHERE hd = 0),
sx AS (SELECT doc_id, chapter, paragraph, pi, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sentence_index FROM
  (SELECT *, string_split(regexp_replace({strip_sql('p')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM pn)),
sw AS (SELECT *, {words_sql('sentence')} AS ws FROM sx),
un AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pi, sentence_index) - 1 AS unit FROM sw
       WHERE length({strip_sql('sentence')}) >= 10 AND len(ws) > 0)"""


@query(f"WITH {UNITS} SELECT doc_id, CAST(unit AS INT) AS unit, CAST(chapter AS INT) AS chapter, CAST(paragraph AS INT) AS paragraph, "
       "CAST(unit // 50 + 1 AS INT) AS page, CAST(sentence_index AS INT) AS sentence_index, sentence, CAST(len(ws) AS INT) AS words FROM un")
def text_units(spark, sf):
    """Paragraphs, sentences and chapter / paragraph / page counters of every document."""
    return C.units(spread_table(spark, sf, "documents")).withColumn("words", F.size("words"))


@query(f"SELECT doc_id, CAST(len(ws) AS INT) AS n, md5(array_to_string(ws, ' ')) AS digest FROM (SELECT doc_id, {words_sql('text')} AS ws FROM documents)")
def text_words(spark, sf):
    """Normalised words of whole texts."""
    w = spread_table(spark, sf, "documents").select("doc_id", X.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


_STRIPPED = ("regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), "
             "'(?s)<[^>]*>', ' ', 'g')")


@query(f"SELECT page_id, CAST(len(ws) AS INT) AS n, md5(array_to_string(ws, ' ')) AS digest FROM (SELECT page_id, {words_sql(_STRIPPED)} AS ws FROM pages)")
def page_words(spark, sf):
    """Words of web pages without tags, scripts and styles."""
    w = spread_table(spark, sf, "pages").select("page_id", X.words(X.strip_tags(F.col("html"))).alias("w"))
    return w.select("page_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


_URL = f"""WITH seg AS (SELECT page_id AS id, unnest(s) AS a, generate_subscripts(s, 1) AS i, len(s) AS n FROM
  (SELECT page_id, list_filter(regexp_split_to_array(url, '[/:?#&=.]+'), lambda x: x <> '') AS s FROM pages)),
{codebook_sql("SELECT a FROM seg", D)},
pr AS (SELECT *, lead(a) OVER (PARTITION BY id ORDER BY i) AS a1 FROM seg),
al AS (SELECT id, d, x FROM seg JOIN cb USING (a)
       UNION ALL SELECT id, c.d, c.x * e.x FROM pr JOIN cb c ON c.a = pr.a JOIN cb e ON e.a = pr.a1 AND e.d = c.d),
s AS (SELECT id, d, CAST(sign(sum(x)) AS INT) AS x FROM al GROUP BY id, d)
SELECT id AS page_id, {HEX} AS vec FROM s GROUP BY id"""


@query(_URL)
def encode_urls(spark, sf):
    """URL segments as n-gram sequences."""
    seg = F.filter(F.split("url", "[/:?#&=.]+"), lambda x: x != "")
    return spread_table(spark, sf, "pages").select("page_id", hex_text(encode_ngrams(seg, D)).alias("vec"))


def stored_units(spark, sf):
    """Units checkpointed once, for jobs that read them several times."""
    checkpoint_dir(spark)
    return C.units(spread_table(spark, sf, "documents")).select("doc_id", "unit", "words").checkpoint()


def phrases(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), X.words(F.col("text")).alias("words"))


def _vec_sql(items, book, name):
    """Default n-gram vectors of ``items(id, a, i, n)`` through distinct grams."""
    return f"""
{name}_pr AS (SELECT *, lead(a) OVER (PARTITION BY id ORDER BY i) AS a1 FROM {items}),
{name}_g AS (SELECT a, CAST(NULL AS VARCHAR) AS a1, id FROM {items} UNION ALL SELECT a, a1, id FROM {name}_pr WHERE a1 IS NOT NULL),
{name}_p AS (SELECT p.a, p.a1, c.d, c.x * coalesce(e.x, 1) AS x FROM (SELECT DISTINCT a, a1 FROM {name}_g) p
  JOIN {book} c ON c.a = p.a LEFT JOIN {book} e ON e.a = p.a1 AND e.d = c.d),
{name} AS (SELECT id, d, CAST(sign(sum(x)) AS INT) AS x FROM {name}_g g JOIN {name}_p p
  ON p.a = g.a AND p.a1 IS NOT DISTINCT FROM g.a1 GROUP BY id, d)"""


PHRASE = f"""{UNITS},
ui AS (SELECT doc_id || '-' || unit AS id, chapter, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM un),
bi AS (SELECT item_id AS id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, {words_sql('text')} AS ws FROM benchmark)),
{codebook_sql("SELECT a FROM ui UNION SELECT a FROM bi", D)}, {_vec_sql('ui', 'cb', 'uv')}, {_vec_sql('bi', 'cb', 'bv')},
ul AS (SELECT id, list(x ORDER BY d)::FLOAT[] AS v FROM uv GROUP BY id), bl AS (SELECT id, list(x ORDER BY d)::FLOAT[] AS v FROM bv GROUP BY id),
ps AS (SELECT bl.id AS query_id, ul.id AS unit_id, CAST(list_dot_product(bl.v, ul.v) AS BIGINT) AS s FROM bl, ul),
pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, unit_id) AS rank FROM ps WHERE s / {D}.0 >= 0.1)"""


@query(f"WITH {PHRASE} SELECT query_id, unit_id, round(s / {D}.0, 6) AS score, CAST(rank AS INT) AS rank FROM pr WHERE rank <= 10")
def phrase_search(spark, sf):
    """Fuzzy search of every benchmark passage among all sentences."""
    return C.phrase_search(C.units(spread_table(spark, sf, "documents")), phrases(spark, sf), D).withColumn(
        "score", F.round("score", 6))


@query(f"""WITH {PHRASE.replace("WHERE s / 64.0 >= 0.1)", "WHERE s / 64.0 >= 0.1 AND unit_id IN (SELECT id FROM ui WHERE chapter > 1 OR id LIKE '%-0'))")}
SELECT query_id, unit_id, round(s / {D}.0, 6) AS score, CAST(rank AS INT) AS rank FROM pr WHERE rank <= 5""")
def phrase_search_guarded(spark, sf):
    """The same search among first sentences and later chapters only."""
    guard = (F.col("chapter") > 1) | (F.col("unit") == 0)
    return C.phrase_search(C.units(spread_table(spark, sf, "documents")), phrases(spark, sf), D, 5, guard=guard).withColumn(
        "score", F.round("score", 6))


_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_LOCATE = f"""
WITH b AS (SELECT item_id, {_NORM.format('text')} AS q FROM benchmark), t AS (SELECT doc_id, {_NORM.format('text')} AS t FROM documents),
c AS (SELECT item_id, doc_id, q, t FROM b JOIN t ON contains(t, q)),
p AS (SELECT *, unnest(list_filter(range(1, length(t) + 1), lambda i: t[i:i + length(q) - 1] = q)) AS position FROM c)
SELECT item_id AS query_id, doc_id, CAST(position AS INT) AS position,
  substr(t, greatest(position - 100, 1), position - greatest(position - 100, 1) + length(q) + 100) AS context FROM p"""


@query(_LOCATE)
def locate_phrases(spark, sf):
    """All verbatim occurrences of the passages with their context."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase"))
    return C.locate_phrases(spread_table(spark, sf, "documents"), b)


@query(_LOCATE.replace("FROM benchmark)", "FROM (SELECT DISTINCT 1 AS item_id, 'the and' AS text FROM region "
                       "UNION SELECT 2, 'th' FROM region UNION SELECT 3, 'r and the' FROM region))").replace(", p AS (SELECT *", ", p AS (SELECT *")
       + " ", name="locate_short_phrases")
def locate_short_phrases(spark, sf):
    """Phrases of one, two and three words, which may begin and end inside words."""
    b = spark.createDataFrame([(1, "the and"), (2, "th"), (3, "r and the")], "query_id INT, phrase STRING")
    return C.locate_phrases(spread_table(spark, sf, "documents"), b)


@query(f"""WITH {PHRASE},
h AS (SELECT query_id, unit_id FROM pr WHERE rank <= 10),
o AS (SELECT h.query_id, un.doc_id, h.unit_id, len(list_intersect(list_distinct(b.ws), un.ws)) / CAST(len(list_distinct(b.ws)) AS DOUBLE) AS overlap
  FROM h JOIN un ON un.doc_id || '-' || un.unit = h.unit_id JOIN (SELECT item_id, {words_sql('text')} AS ws FROM benchmark) b ON b.item_id = h.query_id)
SELECT query_id, doc_id, unit_id, round(overlap, 6) AS overlap FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY overlap DESC, unit_id) AS n FROM o) WHERE n = 1""")
def phrase_best_sentence(spark, sf):
    """Best sentence per passage and document by word overlap."""
    u, q = stored_units(spark, sf), phrases(spark, sf)
    return C.best_sentences(C.phrase_search(u, q, D), u, q).withColumn("overlap", F.round("overlap", 6))


_OVERLAP = f"""
ut AS (SELECT DISTINCT doc_id || '-' || unit AS unit_id, unnest(ws) AS w FROM un),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({words_sql('text')}) AS w FROM benchmark),
qm AS (SELECT query_id, count(*) AS m FROM qt GROUP BY query_id),
ov AS (SELECT query_id, unit_id, count(*) / CAST(any_value(m) AS DOUBLE) AS overlap FROM qt JOIN ut USING (w) JOIN qm USING (query_id)
       GROUP BY query_id, unit_id HAVING count(*) / CAST(any_value(m) AS DOUBLE) >= 0.3)"""


@query(f"WITH {UNITS}, {_OVERLAP} SELECT query_id, unit_id, round(overlap, 6) AS overlap FROM ov")
def overlap_matches(spark, sf):
    """Sentences holding at least 30 % of a passage's distinct words."""
    return C.overlap_matches(C.units(spread_table(spark, sf, "documents")), phrases(spark, sf), 0.3).withColumn(
        "overlap", F.round("overlap", 6))


@query(f"""WITH {PHRASE}, {_OVERLAP},
nr AS (SELECT query_id, unit_id, s / {D}.0 AS score, 'vector' AS source FROM pr WHERE rank <= 5 AND s / {D}.0 >= 0.3),
lx AS (SELECT query_id, unit_id, overlap AS score, 'words' AS source FROM ov WHERE (query_id, unit_id) NOT IN (SELECT (query_id, unit_id) FROM nr)),
al AS (SELECT * FROM nr UNION ALL SELECT * FROM lx)
SELECT query_id, unit_id, source, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER
 (PARTITION BY query_id ORDER BY source, score DESC, unit_id) AS rank FROM al) WHERE rank <= 5""")
def hybrid_search(spark, sf):
    """Vector hits filled up with word-overlap hits."""
    return C.hybrid_search(stored_units(spark, sf), phrases(spark, sf), D, 5, 0.3, 0.3).withColumn(
        "score", F.round("score", 6))


@query(f"""WITH {PHRASE}, loc AS ({_LOCATE.strip().replace('WITH b AS', 'WITH b AS', 1)}),
truth AS (SELECT DISTINCT query_id, doc_id FROM loc),
got AS (SELECT DISTINCT query_id, CAST(split_part(unit_id, '-', 1) AS BIGINT) AS doc_id FROM pr WHERE rank <= 10),
j AS (SELECT coalesce(t.query_id, g.query_id) AS query_id, t.doc_id IS NOT NULL AS t, g.doc_id IS NOT NULL AS g
      FROM truth t FULL JOIN got g ON t.query_id = g.query_id AND t.doc_id = g.doc_id),
c AS (SELECT query_id, count(*) FILTER (t AND g) AS tp, count(*) FILTER (g AND NOT t) AS fp, count(*) FILTER (t AND NOT g) AS fn FROM j GROUP BY query_id)
SELECT query_id, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall FROM c""")
def phrase_retrieval_quality(spark, sf):
    """Precision and recall of phrase search against verbatim occurrences."""
    from ternweave.operators.scoring import retrieval_scores
    docs = spread_table(spark, sf, "documents")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase"))
    truth = C.locate_phrases(docs, b).select("query_id", "doc_id").distinct()
    got = C.phrase_search(C.units(docs), phrases(spark, sf), D).select(
        "query_id", F.substring_index("unit_id", "-", 1).cast("bigint").alias("doc_id")).distinct()
    out = retrieval_scores(truth, got)
    return out.select("query_id", "tp", "fp", "fn", F.round("precision", 6).alias("precision"),
                      F.round("recall", 6).alias("recall"))
