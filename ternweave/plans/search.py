"""Top-k searches, guards, negations and probe tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ternweave.functions import text as X
from ternweave.functions.predicates import guard_predicate, negation_predicate
from ternweave.operators import encode as E
from ternweave.operators import inverted as I
from ternweave.operators import search as S
from ternweave.plans.common import codebook_sql, flat_map_sql, map_sql, pairs_sql, query, scratch, spread_table, table, words_sql

D = 256
PART = ("p_brand", "p_type", "p_size")
K = 20


def parts(spark, sf):
    p = spread_table(spark, sf, "part").withColumnRenamed("p_partkey", "doc_id")
    return p.withColumn("vec", E.encode_row(*PART, dims=D))


def probe_cte(probes: dict, subtract: dict | None = None) -> str:
    """Probe documents (flat) as ``qv(q, d, x)``; ``subtract`` gives the negation maps."""
    def rows(docs):
        return ", ".join(f"({q}, '{k}', '{v}')" for q, doc in docs.items() for k, v in doc.items())
    out = f"qkv(id, k, v) AS (VALUES {rows(probes)}), {map_sql('qm', 'qkv', 'qb')}"
    if subtract:
        return (out + f", nkv(id, k, v) AS (VALUES {rows(subtract)}), {map_sql('nm', 'nkv', 'qb')}, "
                "qv AS (SELECT id AS q, d, qm.x - coalesce(nm.x, 0) AS x FROM qm LEFT JOIN nm USING (id, d))")
    return out + ", qv AS (SELECT id AS q, d, x FROM qm)"


def search_sql(probes: dict, where: str = "TRUE", k: int = K, threshold: float = 0.0, subtract: dict | None = None,
               post: str | None = None, extra: str = "", final: str | None = None) -> str:
    docs = {**probes}
    atoms = {a for doc in [*docs.values(), *(subtract or {}).values()] for kv in doc.items() for a in map(str, kv)}
    book = codebook_sql(" UNION ALL ".join(f"SELECT '{a}' AS a" for a in sorted(atoms)), D, "qb")
    cond = f"AND ({post})" if post else ""
    final = final or (f"SELECT q AS query_id, doc_id, round(s / {D}.0, 6) AS score, CAST(row_number() OVER "
                      f"(PARTITION BY q ORDER BY s DESC, doc_id) AS INT) AS rank FROM hit JOIN part ON p_partkey = doc_id "
                      f"WHERE rn <= {k} {cond}")
    return f"""WITH {flat_map_sql('part', 'p_partkey', PART, D)}, {book}, {probe_cte(docs, subtract)},
sc AS (SELECT q, id AS doc_id, CAST(sum(dv.x * qv.x) AS BIGINT) AS s FROM dv JOIN qv USING (d)
       WHERE id IN (SELECT p_partkey FROM part WHERE {where}) GROUP BY q, id),
hit AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, doc_id) AS rn FROM sc WHERE s / {D}.0 >= {threshold})
{extra} {final}"""


def one(spark, sf, probe, **options):
    out = S.batch_search(parts(spark, sf), [S.Probe(0, probe, options.pop("k", K), options.pop("threshold", 0.0),
                                                    options.pop("guard", None), options.pop("negations", None),
                                                    or_order=options.pop("or_order", "alternative"))], D, **options)
    return out.withColumn("score", F.round("score", 6)).withColumn("query_id", F.col("query_id").cast("int"))


P = {"p_brand": "Brand#13", "p_type": "ECONOMY"}


def _search(name, sql_where="TRUE", doc="", probe=P, sql_probe=None, post=None, subtract=None, threshold=0.0, **options):
    query(search_sql({0: sql_probe or probe}, sql_where, post=post, subtract={0: subtract} if subtract else None,
                     threshold=threshold), name=name)(
        lambda spark, sf: one(spark, sf, probe, threshold=threshold, **{k: (v(spark) if callable(v) else v)
                                                                       for k, v in options.items()}))


_search("search_topk")
_search("search_threshold", threshold=0.25)
_search("search_guard_equality", "p_size = 15", guard={"p_size": 15})
_search("search_guard_existence", "p_type IS NOT NULL", guard={"p_type": None})
_search("search_guard_any_marker", "p_type IS NOT NULL", guard={"p_type": {"$any": True}})
_search("search_guard_missing_key", "FALSE", guard={"no_such_field": 1})
_search("search_guard_list_membership", "p_size IN (1, 15, 30)", guard={"p_size": [1, 15, 30]})
_search("search_guard_empty_list", "FALSE", guard={"p_size": []})
_search("search_guard_or", "(p_size = 15 OR p_type = 'SMALL')", guard={"$or": [{"p_size": 15}, {"p_type": "SMALL"}]})
_search("search_guard_or_with_sibling", "(p_size = 15 OR p_type = 'SMALL') AND p_brand = 'Brand#13'",
        guard={"$or": [{"p_size": 15}, {"p_type": "SMALL"}], "p_brand": "Brand#13"})
_search("search_guard_or_sibling_ignored", "(p_size = 15 OR p_type = 'SMALL')",
        guard={"$or": [{"p_size": 15}, {"p_type": "SMALL"}], "p_brand": "Brand#13"}, compat=True)
_search("search_guard_nested_or", "p_type IN ('SMALL', 'LARGE')", guard={"p_type": {"$or": ["SMALL", "LARGE"]}})
_search("search_guard_empty", guard={})
_search("search_guard_range", "p_size >= 10 AND p_size < 20 AND p_retailprice > 950",
        guard={"p_size": {"$gte": 10, "$lt": 20}, "p_retailprice": {"$gt": 950.0}})
_search("search_guard_contains", "p_name LIKE '%red%' AND p_name NOT LIKE '%bolt%'",
        guard={"$or": [{"p_name": {"$contains": "red", "$not_contains": "bolt"}}]})
_search("search_guard_column", "p_size % 2 = 0", guard=lambda spark: F.col("p_size") % 2 == 0)
_search("search_guard_post_filter", guard={"p_size": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]}, filter_mode="post",
        post="p_size BETWEEN 1 AND 10")
_search("search_wildcard", probe={**P, "p_size": {"$any": True}}, sql_probe=P)
_search("search_negation", "p_size <> 15", subtract={"p_size": 15}, negations={"p_size": {"$not": 15}})
_search("search_negation_list", "p_type NOT IN ('SMALL', 'LARGE')", probe={"p_brand": "Brand#13"},
        subtract={"p_type": "SMALL"}, negations={"p_type": {"$not": ["SMALL", "LARGE"]}})
_search("search_negation_vector_only", subtract={"p_size": 15}, negations={"p_size": 15})
_search("search_negation_missing_path", subtract={"no_such_field": "x"}, negations={"no_such_field": {"$not": "x"}})

_ALTS = [{"p_brand": "Brand#7"}, {"p_brand": "Brand#13", "p_type": "ECONOMY"}, {"p_type": "SMALL"}]
_OR_EXTRA = f""", best AS (SELECT q AS alt, doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY __ORDER__) AS f
  FROM hit WHERE rn <= {K})"""


def _or_sql(order, final_order):
    return search_sql(dict(enumerate(_ALTS)), extra=_OR_EXTRA.replace("__ORDER__", order),
                      final=f"""SELECT * FROM (SELECT 0 AS query_id, doc_id, round(s / {D}.0, 6) AS score,
  CAST(row_number() OVER (ORDER BY {final_order}) AS INT) AS rank FROM best WHERE f = 1) WHERE rank <= {K}""")


@query(_or_sql("alt, s DESC", "alt, s DESC, doc_id"))
def search_or_alternatives(spark, sf):
    """Disjunctive probe, results in the order of the alternatives."""
    return one(spark, sf, {"$or": _ALTS})


@query(_or_sql("s DESC, alt", "s DESC, doc_id"))
def search_or_by_score(spark, sf):
    """Disjunctive probe ranked by score."""
    return one(spark, sf, {"$or": _ALTS}, or_order="score")


_BATCH = {1: {"p_brand": "Brand#1"}, 2: {"p_type": "SMALL", "p_size": "5"}, 3: {"p_brand": "Brand#20", "p_type": "LARGE"}}


@query(search_sql(_BATCH, extra=""", lim(q, k, t) AS (VALUES (1, 5, 0.0), (2, 50, 0.3), (3, 10, 0.0))""",
                  final=f"""SELECT CAST(q AS BIGINT) AS query_id, doc_id, round(s / {D}.0, 6) AS score, CAST(rank AS INT) AS rank
FROM (SELECT sc.*, row_number() OVER (PARTITION BY q ORDER BY s DESC, doc_id) AS rank, lim.k FROM sc JOIN lim USING (q)
      JOIN part ON p_partkey = doc_id WHERE s / {D}.0 >= t AND (q <> 3 OR p_size < 25)) WHERE rank <= k"""))
def search_batch(spark, sf):
    """Several requests, each with its own k, threshold and guard, in one pass."""
    probes = [S.Probe(1, _BATCH[1], 5), S.Probe(2, _BATCH[2], 50, 0.3),
              S.Probe(3, _BATCH[3], 10, guard={"p_size": {"$lt": 25}})]
    return S.batch_search(parts(spark, sf), probes, D).withColumn("score", F.round("score", 6))


@query(search_sql({0: P}, "p_size = 15", threshold=0.1))
def search_by_vector(spark, sf):
    """A ready vector as the probe, with the strict guard rules."""
    vec = E.encode_document(P, D)
    return (S.search_by_vector(parts(spark, sf), vec, D, K, 0.1, guard={"p_size": 15}, strict=True)
            .select(F.lit(0).alias("query_id"), "doc_id", F.round("score", 6).alias("score"), "rank"))


def _metric_sql(score, order="sc DESC"):
    return search_sql({0: P}, extra=f""", nn AS (SELECT id, sum(x * x) AS n FROM dv GROUP BY id),
qn AS (SELECT sum(x * x) AS n FROM qv), ms AS (SELECT doc_id, round({score}, 9) AS sc FROM sc JOIN nn ON id = doc_id, qn)""",
                      final=f"""SELECT doc_id, round(sc, 6) AS score, CAST(rank AS INT) AS rank FROM
(SELECT doc_id, sc, row_number() OVER (ORDER BY {order}, doc_id) AS rank FROM ms) WHERE rank <= 2000""")


@query(_metric_sql(f"s / sqrt(CAST(nn.n AS DOUBLE) * qn.n)").replace(", CAST(rank AS INT) AS rank", "").replace("WHERE rank <= 2000", ""))
def search_metric_cosine(spark, sf):
    """Every part scored by cosine against one probe."""
    return _all_scores(spark, sf, "cosine")


def _all_scores(spark, sf, metric):
    probe = spark.createDataFrame([(0, bytearray(E.encode_document(P, D)))], "query_id INT, vec BINARY")
    return S.score_table(parts(spark, sf), probe, D, None, metric).select(
        "doc_id", F.round(F.round("score", 9), 6).alias("score"))


@query(_metric_sql("exp(-sqrt(CAST(nn.n + qn.n - 2 * s AS DOUBLE)) / 10)")
       .replace(", CAST(rank AS INT) AS rank", "").replace("WHERE rank <= 2000", ""))
def search_metric_euclidean(spark, sf):
    """Every part scored by the euclidean measure."""
    return _all_scores(spark, sf, "euclidean")


@query(_metric_sql("s / sqrt(CAST(nn.n AS DOUBLE) * qn.n) * sqrt(CAST(least(nn.n, qn.n) AS DOUBLE)) / sqrt(CAST(greatest(nn.n, qn.n) AS DOUBLE))")
       .replace(", CAST(rank AS INT) AS rank", "").replace("WHERE rank <= 2000", ""))
def search_metric_length_normalized(spark, sf):
    """Every part scored by the length-normalised measure."""
    return _all_scores(spark, sf, "length_normalized")


_C01 = "CASE WHEN nn.n * qn.n = 0 THEN 0 ELSE (coalesce(s / sqrt(CAST(nn.n AS DOUBLE) * qn.n), 0) + 1) / 2 END"
_EUCLIDEAN = "exp(-sqrt(CAST(nn.n + qn.n - 2 * s AS DOUBLE)) / 10)"
_MANHATTAN = f"exp(-CAST(mh.m AS DOUBLE) / (10 * {D}))"
_METRICS = {
    "raw_dot": "CAST(s AS DOUBLE)", "cosine01": _C01, "contextual": _C01, "manhattan": _MANHATTAN,
    "contiguous_bonus": "least(coalesce(s / sqrt(CAST(nn.n AS DOUBLE) * qn.n), 0) + 0.1 * 0.5, 1.0)",
    "multi": f"0.4 * {_C01} + 0.3 * ({_C01} + 100) / 200 + 0.2 * {_EUCLIDEAN} + 0.1 * {_MANHATTAN}",
    "hierarchical": "hi.h", "ensemble": f"0.5 * {_C01} + 0.3 * hi.h + 0.2 * least({_C01}, 1.0)"}


def _metric_query(metric):
    sql = search_sql({0: P}, extra=f""", nn AS (SELECT id, sum(x * x) AS n FROM dv GROUP BY id), qn AS (SELECT sum(x * x) AS n FROM qv),
mh AS (SELECT dv.id, sum(abs(dv.x - qv.x)) AS m FROM dv JOIN qv USING (d) GROUP BY dv.id),
sg AS (SELECT dv.id, d // {D // 8} AS g, sum(dv.x * qv.x) AS s, sum(dv.x * dv.x) AS a, sum(qv.x * qv.x) AS b FROM dv JOIN qv USING (d) WHERE d < {3 * (D // 8)} GROUP BY 1, 2),
hi AS (SELECT id, sum([0.5, 0.3, 0.2][g + 1] * CASE WHEN a * b = 0 THEN 0 ELSE (s / sqrt(CAST(a AS DOUBLE) * b) + 1) / 2 END) AS h FROM sg GROUP BY id),
ms AS (SELECT doc_id, round({_METRICS[metric]}, 9) AS sc FROM sc JOIN nn ON nn.id = doc_id JOIN mh ON mh.id = doc_id JOIN hi ON hi.id = doc_id, qn)""",
                     final="SELECT doc_id, round(sc, 6) AS score FROM ms")

    @query(sql, name=f"search_metric_{metric}")
    def run(spark, sf):
        return _all_scores(spark, sf, metric)


for _metric in _METRICS:
    _metric_query(_metric)


# ---- probe tables ----------------------------------------------------------------------------

_BRANDS = f"""WITH {pairs_sql("part", "p_partkey", PART)}, bkv AS (SELECT DISTINCT p_brand AS id, 'p_brand' AS k, p_brand AS v FROM part),
{codebook_sql("SELECT k AS a FROM kv UNION SELECT v FROM kv", D)}, {map_sql("dv")}, {map_sql("qv", "bkv")},
sc AS (SELECT qv.id AS q, dv.id AS doc_id, CAST(sum(dv.x * qv.x) AS BIGINT) AS s FROM dv JOIN qv USING (d) GROUP BY qv.id, dv.id),
hit AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, doc_id) AS rn FROM sc WHERE s >= 0)"""


def _brand_probes(spark, sf):
    b = table(spark, sf, "part").select("p_brand").distinct()
    return b.select(F.col("p_brand").alias("query_id"), E.encode_row("p_brand", dims=D).alias("vec"))


@query(_BRANDS + f" SELECT q AS query_id, doc_id, round(s / {D}.0, 6) AS score, CAST(rn AS INT) AS rank FROM hit WHERE rn <= 10")
def search_probe_table(spark, sf):
    """One probe per brand; the probe table is encoded by the same job."""
    return S.search_table(parts(spark, sf), _brand_probes(spark, sf), D, 10).withColumn("score", F.round("score", 6))


@query(_BRANDS + f" SELECT q AS query_id, doc_id, round(s / {D}.0, 6) AS score, CAST(rn AS INT) AS rank FROM hit WHERE rn <= 10")
def search_probe_table_grid(spark, sf):
    """The same search with both sides cut into a grid of cells, as for large probe tables."""
    return S.search_table(parts(spark, sf), _brand_probes(spark, sf), D, 10, cells=(3, 2)).withColumn(
        "score", F.round("score", 6))


_REQUESTS = f"""WITH {pairs_sql("part", "p_partkey", PART)}, rq AS (SELECT p_brand || '/' || p_size AS id, p_brand AS b, CAST(p_size AS VARCHAR) AS z,
  1 + p_size % 7 AS k, (p_size % 4) * 0.1 AS t, CASE p_size % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'not_economy' END AS g
  FROM (SELECT DISTINCT p_brand, p_size FROM part)),
bkv AS (SELECT id, 'p_brand' AS k, b AS v FROM rq UNION ALL SELECT id, 'p_size', z FROM rq),
{codebook_sql("SELECT k AS a FROM kv UNION SELECT v FROM kv", D)}, {map_sql("dv")}, {map_sql("qv", "bkv")},
dl AS (SELECT id, list(x ORDER BY d)::FLOAT[] AS v FROM dv GROUP BY id), ql AS (SELECT id, list(x ORDER BY d)::FLOAT[] AS v FROM qv GROUP BY id),
sc AS (SELECT rq.id AS q, rq.k, dl.id AS doc_id, CAST(list_dot_product(dl.v, ql.v) AS DOUBLE) / {D}.0 AS s, t FROM rq JOIN ql USING (id), dl JOIN part ON p_partkey = dl.id
  WHERE g IS NULL OR (g = 'small' AND part.p_size < 20) OR (g = 'not_economy' AND part.p_type <> 'ECONOMY')),
hit AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, doc_id) AS rn FROM sc WHERE s >= t)
SELECT q AS query_id, doc_id, round(s, 6) AS score, CAST(rn AS INT) AS rank FROM hit WHERE rn <= k"""


@query(_REQUESTS)
def search_request_table(spark, sf):
    """A request per brand and size, each with its own k, threshold and guard."""
    size = F.col("p_size")
    asks = table(spark, sf, "part").select("p_brand", "p_size").distinct().select(
        F.concat_ws("/", "p_brand", size.cast("string")).alias("query_id"), E.encode_row("p_brand", "p_size", dims=D).alias("vec"),
        (1 + size % 7).alias("k"), ((size % 4) * F.lit(0.1)).alias("threshold"),
        F.when(size % 3 == 0, "small").when(size % 3 == 1, "not_economy").alias("guard"))
    guards = {"small": F.col("p_size") < 20, "not_economy": F.col("p_type") != "ECONOMY"}
    return S.search_requests(parts(spark, sf), asks, D, guards).withColumn("score", F.round("score", 6))


@query(_BRANDS + f""", dl AS (SELECT id, list(x ORDER BY d)::FLOAT[] AS v FROM dv GROUP BY id), ql AS (SELECT id, list(x ORDER BY d)::FLOAT[] AS v FROM qv GROUP BY id),
al AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, doc_id) AS rn FROM (SELECT ql.id AS q, dl.id AS doc_id, list_dot_product(dl.v, ql.v) AS s FROM dl, ql) WHERE s >= 0),
bo AS (SELECT coalesce(a.q, b.q) AS q, a.s AS sa, b.s AS sb FROM (SELECT * FROM hit WHERE rn <= 10) a FULL JOIN (SELECT * FROM al WHERE rn <= 10) b ON a.q = b.q AND a.doc_id = b.doc_id)
SELECT q AS query_id, count(sa) AS hits_a, count(sb) AS hits_b, count(*) FILTER (sa IS NOT NULL AND sb IS NOT NULL) AS shared,
  count(sa) = count(sb) AND bool_and(coalesce(abs(sa - sb) / {D} <= 0.001, FALSE)) AS consistent FROM bo GROUP BY q""")
def search_consistency(spark, sf):
    """Broadcast and grid plans agree on every probe."""
    a = S.search_table(parts(spark, sf), _brand_probes(spark, sf), D, 10)
    b = S.search_table(parts(spark, sf), _brand_probes(spark, sf), D, 10, cells=(2, 3))
    return S.compare_results(a, b).select("query_id", "hits_a", "hits_b", "shared", "consistent")


def _inverted_sql() -> str:
    """CTEs of an inverted file over the parts: centroids ``ce``, cell of each part ``ho``, scored candidates ``ca`` of the brands."""
    home = "SELECT id, j FROM (SELECT dl.id, c.j, row_number() OVER (PARTITION BY dl.id ORDER BY {near} DESC, c.j) AS rn FROM dl, {c} c) WHERE rn = 1"
    near = "CAST(list_dot_product({v}, c.v) AS DOUBLE) / sqrt(greatest(CAST(list_dot_product(c.v, c.v) AS DOUBLE), 1))"
    out = f"""WITH {pairs_sql("part", "p_partkey", PART)}, bkv AS (SELECT DISTINCT p_brand AS id, 'p_brand' AS k, p_brand AS v FROM part),
{codebook_sql("SELECT k AS a FROM kv UNION SELECT v FROM kv", D)}, {map_sql("dv")}, {map_sql("qv", "bkv")},
dl AS MATERIALIZED (SELECT id, list(x ORDER BY d)::FLOAT[] AS v FROM dv GROUP BY id), ql AS (SELECT id, list(x ORDER BY d)::FLOAT[] AS v FROM qv GROUP BY id),
nc AS (SELECT CAST(ceil(8 * sqrt(count(*))) AS INT) AS c FROM part),
c0 AS MATERIALIZED (SELECT j, v FROM (SELECT row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS j, v FROM dl) WHERE j < (SELECT c FROM nc))"""
    for i in range(I.ROUNDS):
        out += f""",
a{i} AS MATERIALIZED ({home.format(near=near.format(v='dl.v'), c=f'c{i}')}),
c{i + 1} AS MATERIALIZED (SELECT j, list(sign(s) ORDER BY d)::FLOAT[] AS v FROM (SELECT j, d, sum(x) AS s FROM a{i} JOIN dv USING (id) GROUP BY j, d) GROUP BY j
  UNION ALL SELECT j, v FROM c{i} WHERE j NOT IN (SELECT j FROM a{i}))"""
    return out + f""",
ho AS MATERIALIZED ({home.format(near=near.format(v='dl.v'), c=f'c{I.ROUNDS}')}),
pr AS (SELECT q, j FROM (SELECT ql.id AS q, c.j, row_number() OVER (PARTITION BY ql.id ORDER BY {near.format(v='ql.v')} DESC, c.j) AS rn FROM ql, c{I.ROUNDS} c)
  WHERE rn <= greatest(1, (SELECT c // 25 FROM nc))),
ca AS (SELECT q, ho.id AS doc_id, CAST(list_dot_product(dl.v, ql.v) AS DOUBLE) / {D}.0 AS s FROM pr JOIN ho USING (j) JOIN dl ON dl.id = ho.id JOIN ql ON ql.id = q)"""


def _inverted(spark, sf):
    """An inverted file of the parts, and the number of cells a probe reads: one of 25."""
    cells = I.cells_for(table(spark, sf, "part").count())
    return I.build(parts(spark, sf), D, scratch(spark, "inverted"), cells), max(1, cells // 25)


@query(_inverted_sql() + """ SELECT q AS query_id, doc_id, round(s, 6) AS score, CAST(rn AS INT) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, doc_id) AS rn FROM ca WHERE s >= 0) WHERE rn <= 10""")
def search_approximate(spark, sf):
    """A probe per brand against a stored inverted file: exact scores in the nearest cells."""
    index, near = _inverted(spark, sf)
    return I.search(index, _brand_probes(spark, sf), 10, near).withColumn("score", F.round("score", 6))


@query(_inverted_sql() + f""", al AS (SELECT ql.id AS q, dl.id AS doc_id, row_number() OVER (PARTITION BY ql.id ORDER BY list_dot_product(dl.v, ql.v) DESC, dl.id) AS rn
  FROM dl, ql WHERE list_dot_product(dl.v, ql.v) >= 0),
hi AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, doc_id) AS rn FROM ca WHERE s >= 0)
SELECT q AS query_id, n.n AS candidates, (SELECT count(*) FROM al WHERE al.q = n.q AND rn <= 10) AS hits_a, (SELECT count(*) FROM hi WHERE hi.q = n.q AND rn <= 10) AS hits_b,
  (SELECT count(*) FROM al JOIN hi USING (q, doc_id) WHERE al.q = n.q AND al.rn <= 10 AND hi.rn <= 10) AS shared
FROM (SELECT q, count(*) AS n FROM ca GROUP BY q) n""")
def search_approximate_recall(spark, sf):
    """Candidates of the inverted file, and what it finds of the exact result."""
    index, near = _inverted(spark, sf)
    probes = _brand_probes(spark, sf)
    both = S.compare_results(S.search_table(parts(spark, sf), probes, D, 10), I.search(index, probes, 10, near))
    return both.select("query_id", "hits_a", "hits_b", "shared").join(I.candidates(index, probes, near), "query_id")


@query(_BRANDS + f""" SELECT q AS query_id, count(*) AS hits FROM sc WHERE s / {D}.0 >= {S.noise_threshold(D, 6.0)!r} GROUP BY q""")
def search_noise_threshold(spark, sf):
    """Hits above the noise level of unrelated documents."""
    floor = S.noise_threshold(D, 6.0)
    hits = S.score_table(parts(spark, sf), _brand_probes(spark, sf), D, floor)
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))


@query(search_sql({0: P}, final=f"""SELECT doc_id, p_name, round(s / {D}.0, 6) AS score FROM (SELECT * FROM
 (SELECT doc_id, s, row_number() OVER (ORDER BY s DESC, doc_id) AS n FROM hit WHERE rn <= 20) WHERE n > 8 AND n <= 14)
 JOIN part ON p_partkey = doc_id"""))
def search_page(spark, sf):
    """Selected fields of one result page, continued after a known row (S15, S17)."""
    hits = S.search(parts(spark, sf), P, D, K)
    last = S.page(hits, 8).orderBy("score", F.desc("doc_id")).limit(1).first()
    rows = S.page(hits, 6, (last["score"], last["doc_id"]))
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    return rows.join(names, "doc_id").select("doc_id", "p_name", F.round("score", 6).alias("score"))


# ---- guards as plain predicates --------------------------------------------------------------

@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < "
       "TIMESTAMP '1998-01-01' AND o_totalprice > 100000 AND o_orderstatus IN ('O', 'P')")
def guard_date_price_range(spark, sf):
    """Range guard on typed columns, pushed to the scan."""
    import datetime as dt
    o = table(spark, sf, "orders")
    start, end = dt.datetime(1997, 1, 1), dt.datetime(1998, 1, 1)
    g = {"o_orderdate": {"$gte": start, "$lt": end}, "o_totalprice": {"$gt": 100000.0}, "o_orderstatus": ["O", "P"]}
    return o.where(guard_predicate(o.schema, g)).select("o_orderkey", "o_orderpriority")


@query("""WITH n AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey FROM n WHERE len(w) = 2 AND w[2] = 'bolt'""")
def guard_list_wildcard(spark, sf):
    """List guard with a wildcard element."""
    p = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return p.where(guard_predicate(p.schema, {"words": [{"$any": True}, "bolt"]})).select("p_partkey")


#: Documents with a key that is absent in some, null in others, and a list or a number elsewhere.
_TAGGED = """e AS (SELECT event_id, event_id % 5 AS r, CAST(json_extract(props, '$.k') AS INT) AS k, event_type AS t FROM events)"""


def _tagged(spark, sf):
    k, t = F.from_json("props", "k INT")["k"].cast("string"), F.concat(F.lit('"'), "event_type", F.lit('"'))
    value = F.element_at(F.array(F.lit('{}'), F.lit('{"tag": null}'), F.concat(F.lit('{"tag": '), t, F.lit("}")),
                                 F.concat(F.lit('{"tag": ['), t, F.lit(", "), k, F.lit("]}")), F.concat(F.lit('{"tag": {"in": '), k, F.lit("}}"))),
                         (F.col("event_id") % 5 + 1).cast("int"))
    return spread_table(spark, sf, "events").select("event_id", F.parse_json(value).alias("doc"))


def _tag_query(name, guard, sql, doc):
    @query(f"WITH {_TAGGED} SELECT event_id FROM e WHERE {sql}", name=name)
    def run(spark, sf):
        e = _tagged(spark, sf)
        return e.where(guard_predicate("doc", guard)).select("event_id")
    run.__doc__ = doc


_tag_query("guard_document_existence", {"tag": None}, "r >= 1", "Documents that have the key, whatever its value: null counts, absence does not.")
_tag_query("guard_document_any_marker", {"tag": {"$any": True}}, "r >= 1", "The same by the marker.")
_tag_query("guard_document_value", {"tag": "click"}, "r = 2 AND t = 'click'", "A value; lists, null and absent keys do not match.")
_tag_query("guard_document_nested", {"tag": {"in": 7}}, "r = 4 AND k = 7", "A nested key that most documents lack.")


@query("""SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) IN (1, 5, 42)
  AND event_type <> 'error'""")
def guard_nested_document(spark, sf):
    """Nested guard and negation on JSON documents of unknown shape."""
    doc = F.to_json(F.struct("event_type", F.from_json("props", "k INT").alias("props")))
    e = spread_table(spark, sf, "events").select("event_id", F.parse_json(doc).alias("doc"))
    keep = (guard_predicate("doc", {"props": {"k": [1, 5, 42]}})
            & negation_predicate("doc", {"event_type": {"$not": "error"}}))
    return e.where(keep).select("event_id")


# ---- retrieval over text ---------------------------------------------------------------------

@query(f"""
WITH u AS (SELECT conv_id, turn, role, {words_sql('text')} AS ws FROM conversations),
kv AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) || '-' || turn AS id, w AS a FROM (SELECT conv_id, turn, unnest(ws) AS w FROM u WHERE role = 'user')),
ck AS (SELECT id, a FROM kv), q AS (SELECT item_id, unnest(list_distinct({words_sql('text')})) AS a FROM benchmark)
SELECT q.item_id, count(DISTINCT ck.id) AS turns, count(*) AS shared FROM q JOIN ck USING (a) GROUP BY q.item_id""")
def shared_atoms(spark, sf):
    """Benchmark passages against user turns by shared atoms."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    u = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"),
                 F.explode(F.array_distinct(X.words(F.col("text")))).alias("a"))
    q = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("a"))
    per_turn = q.join(u, "a").groupBy("item_id", "id").agg(F.count(F.lit(1)).alias("n"))
    return per_turn.groupBy("item_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("n").alias("shared"))
