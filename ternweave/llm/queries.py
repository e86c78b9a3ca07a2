"""Registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternweave.llm import (common, decontaminate, exact_dedup, filter_audit, hard_negatives, jaccard_join, language_id, mixing,
                           near_dedup, token_binary, token_counts, toxicity, url_filter, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_language_id(spark, sf_dir):
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(common.crc_of("doc_id"), F.lit(4)) == 2
    languages, vectors = language_id.prototypes(docs.where(~held_out))
    return language_id.predict(docs, languages, vectors).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op2_token_files(spark, sf_dir):
    """Token ids of every document, written to Huffman-coded files and read back."""
    return token_binary.token_files(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                    public_tokenizers.path("word_bpe_49k.json"))


@query("""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""")
def op3_exact_dedup(spark, sf_dir):
    """Exact duplicates of every document."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query()
def op4_mixing(spark, sf_dir):
    """Place of every document in a mixture of its sources, by the square roots of their sizes."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query()
def op5_token_counts(spark, sf_dir):
    """Tokens of every document under the 32k piece model."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op6_warc(spark, sf_dir):
    """Metadata and conversion records of every page's response."""
    return warc.derivatives(warc.responses_of_pages(table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


@query()
def op7_decontamination(spark, sf_dir):
    """Benchmark passages in every document."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op8_near_dedup(spark, sf_dir):
    """Near-duplicate class of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op9_url_filter(spark, sf_dir):
    """Verdict on every page's URL; the model learns from the pages that a rule fits."""
    pages = table(spark, sf_dir, "pages")
    model = url_filter.fit(url_filter.labelled_by_rules(pages))
    return url_filter.url_verdicts(pages, model=model)


@query()
def op10_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from four fifths of the labelled ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(common.crc_of("doc_id"), F.lit(5)) == 0
    net = toxicity.fit(toxicity.labelled_sample(docs, labels, ~held_out))
    return toxicity.toxicity(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted", "threshold", "rejected")


@query("""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                                     ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(shingle) AS n_shingles FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, n_shingles, component_id FROM n JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) USING (doc_id)
""")
def op11_jaccard_join(spark, sf_dir):
    """Component of every document under links of shingle-set similarity 0.8 or more."""
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


@query("""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
q AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM q JOIN p USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
""")
def op12_hard_negatives(spark, sf_dir):
    """Three hard negatives for each of five positives of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved))


@query("""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > first, first IS NOT NULL)::INT AS mask FROM w),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(k, b)),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM x a, x b, x c, x d, x e
      WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, step, bits[step]::INT AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step::INT AS step, bit,
             sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
""")
def op13_filter_audit(spark, sf_dir):
    """Every order of five filters over every document."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
