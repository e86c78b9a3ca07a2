"""Scores of predictions, retrievals, trials and query logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def label_scores(pairs: DataFrame, predicted: str, actual: str, by=()) -> DataFrame:
    """Precision, recall, F1 and accuracy of aligned labels; a miss counts as one false
    positive and one false negative.  Null labels never match."""
    hit = F.coalesce(F.col(predicted) == F.col(actual), F.lit(False)).cast("bigint")
    c = pairs.groupBy(*by).agg(F.sum(hit).alias("tp"), F.count(F.lit(1)).alias("n"))
    c = c.withColumn("miss", F.col("n") - F.col("tp"))
    p = _ratio(F.col("tp"), F.col("tp") + F.col("miss"))
    return c.select(*by, "tp", F.col("miss").alias("fp"), F.col("miss").alias("fn"), p.alias("precision"),
                    p.alias("recall"), _f1(p, p).alias("f1"), _ratio(F.col("tp"), F.col("n")).alias("accuracy"))


def retrieval_scores(truth: DataFrame, got: DataFrame, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """Set precision, recall and F1 per query."""
    t = truth.select(query, item).distinct().withColumn("t", F.lit(1))
    g = got.select(query, item).distinct().withColumn("g", F.lit(1))
    j = t.join(g, [query, item], "full_outer")

    def count(cond):
        return F.sum(cond.cast("bigint"))
    in_t, in_g = F.col("t").isNotNull(), F.col("g").isNotNull()
    c = j.groupBy(query).agg(count(in_t & in_g).alias("tp"), count(~in_t & in_g).alias("fp"),
                             count(in_t & ~in_g).alias("fn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(query, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def neighbour_accuracy(hits: DataFrame, labels: DataFrame, top: int = 2) -> DataFrame:
    """Share of queries with an equally labelled hit among the first ``top``, per class, with
    the population deviation.  ``hits`` must not contain the query itself; queries without
    hits count as wrong."""
    mine = labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("mine"))
    found = (hits.where(F.col("rank") <= top)
             .join(labels.select("doc_id", "label"), "doc_id").join(mine, "query_id")
             .groupBy("query_id").agg(F.max((F.col("label") == F.col("mine")).cast("int")).alias("ok")))
    per = mine.join(found, "query_id", "left").select("mine", F.coalesce("ok", F.lit(0)).alias("ok"))
    return per.groupBy(F.col("mine").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ok").alias("accuracy"), F.stddev_pop("ok").alias("std_dev"))


def purity(hits: DataFrame, families: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Share of hits in the query's own family, and whether it counts as a cluster."""
    q = families.select(F.col("doc_id").alias("query_id"), F.col("family").alias("query_family"))
    j = hits.join(families, "doc_id").join(q, "query_id")
    same = (F.col("family") == F.col("query_family")).cast("int")
    return (j.groupBy("query_id", "query_family").agg(F.count(F.lit(1)).alias("hits"), F.avg(same).alias("purity"))
            .withColumn("is_cluster", F.col("purity") > threshold))


def confidence_interval(trials: DataFrame, value: str, by=()) -> DataFrame:
    """Mean, population deviation and the half width ``1.96 * sd / sqrt(n)``."""
    a = trials.groupBy(*by).agg(F.count(value).alias("trials"), F.avg(value).alias("mean"),
                                F.stddev_pop(value).alias("std_dev"))
    half = F.lit(1.96) * F.col("std_dev") / F.sqrt("trials")
    return a.withColumn("half_width", half)


def expectations(counts: DataFrame, minimums: DataFrame, key: str = "query_type") -> DataFrame:
    """Result counts against minimum counts: (key, minimum, n, passed)."""
    return (minimums.join(counts, key, "left")
            .select(key, "minimum", F.coalesce("n", F.lit(0)).alias("n"))
            .withColumn("passed", F.col("n") >= F.col("minimum")))


def latency_stats(log: DataFrame, seconds: str, by=()) -> DataFrame:
    """Count, mean, maximum, total, median and 1 / mean rate of a query log."""
    s = F.col(seconds)
    a = log.groupBy(*by).agg(F.count(s).alias("queries"), F.avg(s).alias("mean"), F.max(s).alias("max"),
                             F.sum(s).alias("total"), F.percentile_approx(s, 0.5, 10000).alias("median"))
    return a.withColumn("per_second", _ratio(F.col("queries"), F.col("total")))


def rule_accuracy(results: DataFrame, by: str = "rule", baseline: float = 0.05) -> DataFrame:
    """Accuracy per rule and its gain over a random baseline, in percent."""
    a = results.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("bigint")).alias("hits"))
    acc = F.col("hits") / F.col("n")
    return a.select(by, "n", "hits", acc.alias("accuracy"), ((acc - baseline) / baseline * 100).alias("gain_percent"))


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """First row per key in the given order."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
