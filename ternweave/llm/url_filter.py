"""URL filter: rules by host and path, and a logistic regression for what no rule fits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternweave.llm.common import store

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the labelled table that the model is fitted on, buckets of the n-grams and their lengths.
MAX_LABELLED = 4000
BUCKETS = 2 ** 15
LENGTHS = (3, 4, 5)


def host_of(url: Column | str) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    empty for null or without ``://``."""
    u = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column | str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    u = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: str, path: str, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does.

    The rules are a short list given by the caller, so they are an expression of the scan: no join
    and no shuffle, whichever host holds most of the rows."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def ngrams(host: str, path: str, lengths=LENGTHS) -> Column:
    """Character n-grams of host and of path, marked by where they come from."""
    def grams(mark: str, text: Column, n: int) -> Column:
        last = F.length(text) - (n - 1)
        every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                            lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))
        return F.when(last > 0, every).otherwise(F.array().cast("array<string>"))

    return F.concat(*[grams(mark, F.concat(F.lit("^"), F.col(c), F.lit("$")), n) for mark, c in (("h", host), ("p", path)) for n in lengths])


def buckets_of(host: str, path: str, buckets: int) -> Column:
    """The different buckets of a URL's n-grams."""
    return F.array_distinct(F.transform(ngrams(host, path), lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int")))


@dataclass(frozen=True)
class UrlModel:
    """A logistic regression: a weight for each bucket, and the intercept."""
    weights: np.ndarray
    intercept: float

    def score(self, host: str, path: str) -> Column:
        """Probability of ``block``, as a plain expression: the weights are one literal of the scan."""
        weights = F.lit(self.weights)
        total = F.aggregate(buckets_of(host, path, len(self.weights)), F.lit(float(self.intercept)), lambda s, b: s + weights[b])
        return 1 / (1 + F.exp(-total))


def fit(labelled: DataFrame, buckets: int = BUCKETS, max_labelled: int = MAX_LABELLED) -> UrlModel | None:
    """Model of ``labelled(host, path, verdict)``, or None without rows of both verdicts.

    At most ``max_labelled`` different rows, first in the order of a hash, are used; they stand in
    one partition, so that a repeated fit adds in the same order."""
    sample = (labelled.select("host", "path", (F.col("verdict") == "block").cast("double").alias("label")).distinct()
              .orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(max_labelled))
    sample = store(sample, "url-labels").coalesce(1).sortWithinPartitions("host", "path", "label")
    if sample.select("label").distinct().count() < 2:
        return None
    vectors = CountVectorizerModel.from_vocabulary([str(b) for b in range(buckets)], inputCol="_buckets", outputCol="_features").setBinary(True)
    rows = vectors.transform(sample.withColumn("_buckets", buckets_of("host", "path", buckets).cast("array<string>")))
    model = LogisticRegression(featuresCol="_features", labelCol="label", regParam=0.001, maxIter=60, standardization=False).fit(rows)
    return UrlModel(model.coefficients.toArray(), model.intercept)


def url_verdicts(pages: DataFrame, rules=RULES, model: UrlModel | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every page.

    A rule's verdict stands; elsewhere the model blocks at a score of 0.5 or more.  Without a
    model everything that no rule fits is allowed, with a null score.  A null url has an empty host
    and path and is judged by the model.  Repeated rows give repeated results, an empty table none;
    other columns are ignored, whatever their names."""
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    judged = judged.withColumn("_rule", rule_of("host", "path", rules))
    judged = judged.withColumn("_score", F.lit(None).cast("double") if model is None else model.score("host", "path"))
    score = F.col("_score")
    learned = F.when(score >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                         F.coalesce("_rule.verdict", learned).alias("verdict"), score.alias("block_score"))


def labelled_by_rules(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """A labelled URL table: the pages that a rule fits, with its verdict."""
    p = pages.select(host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    return p.withColumn("_rule", rule_of("host", "path", rules)).where("_rule is not null").select(
        "host", "path", F.col("_rule.verdict").alias("verdict"))
