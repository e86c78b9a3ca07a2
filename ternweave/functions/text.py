"""Text expressions: words, paragraphs, sentences, phrase positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}_\s]"
MIN_SENTENCE = 10
PAGE_UNITS = 50


def normalized(text: Column) -> Column:
    """Lower case, punctuation to blanks, blanks collapsed."""
    clean = F.regexp_replace(F.lower(text), NOT_WORD, " ")
    return F.trim(F.regexp_replace(clean, r"\s+", " "))


def words(text: Column) -> Column:
    """Words of the normalised text, found in one pass over it."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def has_word(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}_]")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def paragraphs(text: Column) -> Column:
    """Non-empty pieces between blank lines."""
    return F.filter(F.split(strip(text), r"\n\s*\n"), lambda p: strip(p) != "")


def is_chapter_header(paragraph: Column) -> Column:
    return F.lower(paragraph).rlike(r"^chapter\s+[\p{L}\p{N}_]+")


def sentences(text: Column) -> Column:
    """Pieces after ``. ! ?`` and blanks."""
    return F.split(F.regexp_replace(strip(text), r"([.!?])\s+", "$1\u0001"), "\u0001")


def strip_tags(html: Column) -> Column:
    no_code = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.regexp_replace(no_code, r"(?s)<[^>]*>", " ")


def phrase_positions(text: Column, phrase: Column) -> Column:
    """All 1-based starts of a phrase, overlapping ones included.

    The text is cut in front of every occurrence (a zero-width look-ahead), and the starts are
    the running lengths of the pieces: one pass over the text.
    """
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        F.split(text, quoted), start,
        lambda acc, piece: F.struct((acc["at"] + F.length(piece)).alias("at"),
                                    F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
        lambda acc: acc["starts"])
    return F.when(
        F.contains(text, phrase) & (F.length(phrase) > 0),
        F.filter(starts, lambda i: (i > 1) | F.startswith(text, phrase)),
    ).otherwise(F.array().cast("array<int>"))


def context(text: Column, start: Column, length: Column, margin: int = 100) -> Column:
    begin = F.greatest(start - margin, F.lit(1))
    return F.substring(text, begin, start - begin + length + margin)


def token_overlap(query: Column, sentence: Column) -> Column:
    """Share of the query's distinct words found in the sentence."""
    distinct = F.array_distinct(query)
    return F.when(F.size(distinct) > 0, F.size(F.array_intersect(query, sentence)) / F.size(distinct)).otherwise(0.0)
