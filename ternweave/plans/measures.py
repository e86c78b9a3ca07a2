"""Similarity measures on embeddings: every vector against the mean of its label."""

from __future__ import annotations

from pyspark.sql import functions as F

from ternweave.functions import metrics as M
from ternweave.operators import search as S
from ternweave.plans.common import query, table

N = 64


def centroids(e):
    return (e.groupBy("label").agg(*[F.avg(F.col("embedding")[i].cast("double")).alias(f"c{i}") for i in range(N)])
            .select("label", F.array(*[f"c{i}" for i in range(N)]).alias("b")))


def pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a")).join(centroids(e), "label")


PAIRS = f"""WITH ex AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cx AS (SELECT label, i, avg(x) AS x FROM ex GROUP BY label, i), cl AS (SELECT label, list(x ORDER BY i) AS b FROM cx GROUP BY label),
p0 AS (SELECT vec_id, label, embedding::DOUBLE[] AS a, b FROM embeddings JOIN cl USING (label)),
p AS (SELECT *, list_dot_product(a, b) AS ab, list_dot_product(a, a) AS aa, list_dot_product(b, b) AS bb,
  list_distance(a, b) AS dist, list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) AS man FROM p0),
q AS (SELECT *, ab / (sqrt(aa) * sqrt(bb)) AS cos FROM p)"""


def _sub(lo, hi, expr):
    return expr.replace("A_", f"a[{lo}:{hi}]").replace("B_", f"b[{lo}:{hi}]")


_C01 = "((list_dot_product(A_, B_) / (sqrt(list_dot_product(A_, A_)) * sqrt(list_dot_product(B_, B_))) + 1) / 2)"
_BLEND = f"({_C01} * 0.7 + exp(-list_distance(A_, B_) / 10) * 0.3)"


def _levels(expr):
    return " + ".join(f"{w} * {_sub(i * 8 + 1, i * 8 + 8, expr)}" for i, w in enumerate((0.5, 0.3, 0.2)))


_HIER, _SUBS = _levels(_C01), _levels(_BLEND)
_MULTI = "(0.4 * (cos + 1) / 2 + 0.3 * ((cos + 1) / 2 + 100) / 200 + 0.2 * exp(-dist / 10) + 0.1 * exp(-man / 640))"
_CTX = "least((cos + 1) / 2 * 0.8 * 1.1, 1.0)"


def _measure(name, sql, fn):
    query(f"{PAIRS} SELECT vec_id, round({sql}, 6) AS score FROM q", name=f"measure_{name}")(
        lambda spark, sf: pairs(spark, sf).select("vec_id", F.round(fn(F.col("a"), F.col("b")), 6).alias("score")))


_measure("normalized_dot", "ab / 64", M.normalized_dot)
_measure("cosine", "cos", M.cosine)
_measure("cosine01", "(cos + 1) / 2", M.cosine01)
_measure("dot01", "(cos + 1) / 2", M.dot01)
_measure("euclidean", "exp(-dist / 10)", M.euclidean)
_measure("manhattan", "exp(-man / 640)", M.manhattan)
_measure("multi_metric", _MULTI, M.multi_metric)
_measure("contextual", _CTX, lambda a, b: M.contextual(a, b, query_length=2, target_length=5, domain_match=True))
_measure("hierarchical", _HIER, lambda a, b: M.hierarchical(a, b, N))
_measure("ensemble", f"least(0.5 * (cos + 1) / 2 + 0.3 * ({_HIER}) + 0.2 * (cos + 1) / 2, 1.0)",
         lambda a, b: M.ensemble(a, b, N))
_measure("length_normalized", "cos * least(sqrt(aa), sqrt(bb)) / greatest(sqrt(aa), sqrt(bb))", M.length_normalized)
_measure("contiguous_bonus", "least(cos + 0.1 * 0.5, 1.0)", M.contiguous_bonus)
_measure("subspace_blend", _SUBS, lambda a, b: M.subspace_blend(a, b, N))


@query(f"""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1) * 8) AS a FROM embeddings),
n AS (SELECT vec_id, sqrt(list_dot_product(a, a)) AS n, len(list_filter(a, lambda x: abs(x) < 0.1)) / 64.0 AS sp FROM s)
SELECT vec_id, CASE WHEN n < 10 THEN 'short' WHEN sp > 0.8 THEN 'exact' WHEN n > 50 THEN 'long' ELSE 'fuzzy' END AS kind FROM n""")
def measure_query_type(spark, sf):
    """Query type label by norm and sparsity."""
    e = table(spark, sf, "embeddings")
    a = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1) * 8)
    return e.select("vec_id", a.alias("a")).select("vec_id", M.query_type(F.col("a")).alias("kind"))


_MANY = """
s AS (SELECT c.label AS query_id, e.vec_id AS doc_id, e.label, list_dot_product(e.embedding::DOUBLE[], c.b)
  / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(c.b, c.b))) AS sc FROM embeddings e, cl c)"""


@query(f"""{PAIRS}, {_MANY} SELECT query_id, doc_id, round(sc, 6) AS score, CAST(rank AS INT) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def measure_one_vs_many(spark, sf):
    """The ten vectors nearest to each label mean."""
    e = table(spark, sf, "embeddings")
    probes = centroids(e).select(F.col("label").alias("query_id"), F.col("b").alias("vec"))
    corpus = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return S.search_table(corpus, probes, N, 10, None, "cosine").withColumn("score", F.round("score", 6))


@query(f"""{PAIRS}, {_MANY}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, doc_id) AS r FROM s),
b AS (SELECT *, least(sc + CASE WHEN label = query_id THEN 0.1 ELSE 0 END, 1.0) AS bs FROM h WHERE r <= 20)
SELECT query_id, doc_id, round(bs, 6) AS score, CAST(rank AS INT) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bs DESC, doc_id) AS rank FROM b) WHERE rank <= 10""")
def measure_category_rerank(spark, sf):
    """Hits re-ranked with a boost for the probe's own category."""
    from pyspark.sql import Window
    e = table(spark, sf, "embeddings")
    probes = centroids(e).select(F.col("label").alias("query_id"), F.col("b").alias("vec"))
    corpus = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    hits = S.search_table(corpus, probes, N, 20, None, "cosine").drop("rank")
    boosted = hits.join(e.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").withColumn(
        "score", M.category_boost(F.col("score"), F.col("label") == F.col("query_id")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return (boosted.withColumn("rank", F.row_number().over(w)).where("rank <= 10")
            .select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank"))


@query("""WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS a FROM embeddings),
s AS (SELECT x.vec_id AS query_id, x.label AS lx, y.vec_id AS doc_id, y.label AS ly,
  list_dot_product(x.a, y.a) / (sqrt(list_dot_product(x.a, x.a)) * sqrt(list_dot_product(y.a, y.a))) AS sc FROM n x, n y WHERE x.vec_id <> y.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, doc_id) AS rn FROM s),
o AS (SELECT query_id, lx, max(CAST(lx = ly AS INT)) AS ok FROM r WHERE rn <= 2 GROUP BY query_id, lx)
SELECT lx AS label, count(*) AS n, round(avg(ok), 6) AS accuracy, round(stddev_pop(ok), 6) AS std_dev FROM o GROUP BY lx""")
def leave_one_out_accuracy(spark, sf):
    """Class accuracy of the two nearest other vectors."""
    from ternweave.operators.scoring import neighbour_accuracy
    e = table(spark, sf, "embeddings")
    hits = S.search_table(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")),
                          e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")),
                          N, 2, None, "cosine", exclude_self=True)
    out = neighbour_accuracy(hits, e.select(F.col("vec_id").alias("doc_id"), "label"))
    return out.select("label", "n", F.round("accuracy", 6).alias("accuracy"), F.round("std_dev", 6).alias("std_dev"))
