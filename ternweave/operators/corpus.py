"""Text corpora: units, phrase search, exact locations, overlap re-ranking, hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternweave.functions import text as X
from ternweave.functions.rows import explode_into
from ternweave.operators import phrases as P
from ternweave.operators import search as S
from ternweave.operators.encode import encode_ngrams


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentence units: (doc_id, unit, chapter, paragraph, page, sentence_index, sentence, words).

    A header paragraph (``chapter <word>``) starts a chapter, restarts the paragraph count and
    is dropped; a page turns every 50 kept units; sentences under 10 characters or without
    words are dropped.  Counters are computed inside the row, so there is no shuffle.
    """
    staged = docs.select(doc_id, X.paragraphs(F.col(text)).alias("paras"))
    staged = staged.select(doc_id, "paras", F.filter(
        F.transform("paras", lambda p, i: F.when(X.is_chapter_header(p), i + 1).otherwise(F.lit(0))),
        lambda h: h > 0).alias("headers"))

    def paragraph_units(p, i):
        above = F.filter("headers", lambda h: h <= i)
        chapter = F.size(above) + 1
        paragraph = i + 1 - F.coalesce(F.array_max(above), F.lit(0))
        return F.transform(X.sentences(p), lambda s, j: F.struct(
            chapter.alias("chapter"), paragraph.alias("paragraph"), j.alias("sentence_index"), s.alias("sentence")))

    body = F.flatten(F.transform("paras", lambda p, i: F.when(
        X.is_chapter_header(p), F.array().cast(_UNIT_TYPE)).otherwise(paragraph_units(p, i))))
    kept = F.filter(body, lambda u: (F.length(X.strip(u["sentence"])) >= X.MIN_SENTENCE) & X.has_word(u["sentence"]))
    return (explode_into(staged, kept, "u", doc_id, position="unit")
            .select(doc_id, "unit", "u.chapter", "u.paragraph",
                    (F.floor(F.col("unit") / X.PAGE_UNITS) + 1).cast("int").alias("page"),
                    "u.sentence_index", "u.sentence", X.words(F.col("u.sentence")).alias("words")))


_UNIT_TYPE = "array<struct<chapter:int,paragraph:int,sentence_index:int,sentence:string>>"


def unit_vectors(unit_table: DataFrame, dims: int, doc_id: str = "doc_id", **config) -> DataFrame:
    """Search corpus of units: ``doc_id`` becomes ``<document>-<unit>``; metadata stays beside
    the vector and never enters it."""
    key = F.concat_ws("-", doc_id, "unit")
    return unit_table.withColumn("vec", encode_ngrams("words", dims, **config)).withColumn("unit_id", key)


def phrase_search(unit_table: DataFrame, phrases: DataFrame, dims: int, k: int = 10, threshold: float = 0.1,
                  guard: Column | None = None, **config) -> DataFrame:
    """Fuzzy search of phrases (query_id, words) among units: (query_id, unit_id, score, rank)."""
    kept = unit_table if guard is None else unit_table.where(guard)
    corpus = unit_vectors(kept, dims, **config).select(F.col("unit_id").alias("doc_id"), "vec")
    probes = phrases.select("query_id", encode_ngrams("words", dims, **config).alias("vec"))
    return (S.search_table(corpus, probes, dims, k, threshold)
            .select("query_id", F.col("doc_id").alias("unit_id"), "score", "rank"))


def locate_phrases(docs: DataFrame, phrases: DataFrame, margin: int = 100) -> DataFrame:
    """All occurrences of phrases (query_id, phrase) in the normalised text of docs (doc_id, text):
    (query_id, doc_id, position, context), position 1-based.

    A match may begin and end inside a word.  One automaton finds all phrases in one run over each text, where the text
    lies; a document that is there twice gives its matches twice.
    """
    text = docs.select("doc_id", X.normalized(F.col("text")).alias("text"))
    return P.occurrences(text, phrases.select("query_id", X.normalized(F.col("phrase")).alias("phrase")), margin)


def best_sentences(hits: DataFrame, unit_table: DataFrame, phrases: DataFrame) -> DataFrame:
    """Re-rank hits by token overlap and keep the best unit per query and document."""
    u = unit_table.select(F.concat_ws("-", "doc_id", "unit").alias("unit_id"), "doc_id", "words")
    scored = (hits.select("query_id", "unit_id").join(u, "unit_id")
              .join(phrases.select("query_id", F.col("words").alias("query_words")), "query_id")
              .withColumn("overlap", X.token_overlap(F.col("query_words"), F.col("words"))))
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("overlap"), "unit_id")
    return (scored.withColumn("_n", F.row_number().over(w)).where("_n = 1")
            .select("query_id", "doc_id", "unit_id", "overlap"))


def overlap_matches(unit_table: DataFrame, phrases: DataFrame, min_overlap: float = 0.5) -> DataFrame:
    """Units sharing at least ``min_overlap`` of a phrase's distinct words: (query_id, unit_id, overlap).

    Units are compared where they lie: a phrase's rarest words lead to it, so frequent words are
    looked up only where a phrase has nothing rarer, and no word of a unit is shuffled.
    """
    units_ = unit_table.select(F.concat_ws("-", "doc_id", "unit").alias("unit_id"), "words")
    return P.overlaps(units_, phrases.select("query_id", "words"), min_overlap)


def hybrid_search(unit_table: DataFrame, phrases: DataFrame, dims: int, k: int = 10, threshold: float = 0.1,
                  min_overlap: float = 0.5, **config) -> DataFrame:
    """Vector hits first, then word-overlap hits not already found, up to k per query."""
    near = phrase_search(unit_table, phrases, dims, k, threshold, **config).select(
        "query_id", "unit_id", "score", F.lit("vector").alias("source"))
    lexical = overlap_matches(unit_table, phrases, min_overlap).join(
        near.select("query_id", "unit_id"), ["query_id", "unit_id"], "left_anti").select(
        "query_id", "unit_id", F.col("overlap").alias("score"), F.lit("words").alias("source"))
    w = Window.partitionBy("query_id").orderBy(F.col("source") == "words",
                                               F.desc("score"), "unit_id")
    return (near.unionByName(lexical).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
