"""Session memory: latest states, briefings and hypothesis re-probing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternweave.operators import algebra as A
from ternweave.operators import search as S


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Last row per key.  ``max_by`` combines before the shuffle, so a key with most of the rows
    needs no large sort."""
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return last.select(key, *[F.col("r")[c].alias(c) for c in rest])


def briefing(hits: DataFrame, docs: DataFrame, group: str, text: str, k: int) -> DataFrame:
    """The k best hits of each query per group as an ordered list."""
    w = Window.partitionBy("query_id", group).orderBy(F.desc("score"), "doc_id")
    top = hits.join(docs, "doc_id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    listed = top.groupBy("query_id", group).agg(F.array_sort(F.collect_list(F.struct("n", text))).alias("items"))
    return listed.select("query_id", group, F.transform("items", lambda i: i[text]).alias("briefing"))


def refine(corpus: DataFrame, probe: dict, dims: int, keep: Column, k: int = 5, then: int = 10) -> DataFrame:
    """Bundle the k best hits among the rows that pass ``keep`` and search again with the bundle:
    (doc_id, score, rank)."""
    allowed = corpus.where(keep)
    hits = S.search(allowed, probe, dims, k)
    chosen = corpus.join(hits.select("doc_id"), "doc_id", "left_semi")
    merged = A.bundle_by(chosen.select(F.lit(0).alias("g"), "vec"), "g", "vec", dims)
    again = S.search_table(allowed.select("doc_id", "vec"), merged.select(F.col("g").alias("query_id"), "vec"), dims, then)
    return again.drop("query_id")
