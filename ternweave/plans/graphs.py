"""Trade graphs: one graph per ship date, nations as nodes, an edge from a customer's to a
supplier's nation for the lines shipped that day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ternweave.functions.session import checkpoint_dir
from ternweave.operators import graphs as G
from ternweave.operators import scoring
from ternweave.operators import search as S
from ternweave.operators import signatures
from ternweave.plans.common import HEX, codebook_sql, flat_map_sql, hex_text, query, table

D = 64

GRAPH = """
eg AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS graph_id, 'NATION_' || c_nationkey AS src, 'NATION_' || s_nationkey AS dst, 'ships' AS label
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
nd AS (SELECT graph_id, src AS node FROM eg UNION SELECT graph_id, dst FROM eg),
gr AS (SELECT graph_id, CASE WHEN CAST(substr(graph_id, 10, 1) AS INT) % 2 = 0 THEN 'directed' ELSE 'undirected' END AS type
  FROM (SELECT DISTINCT graph_id FROM eg)),
dg AS (SELECT graph_id, node, count(*) AS degree FROM (SELECT graph_id, src AS node FROM eg UNION ALL SELECT graph_id, dst FROM eg) GROUP BY graph_id, node),
ro AS (SELECT *, CASE WHEN degree / CAST(top AS DOUBLE) >= 0.9 THEN 'hub' WHEN degree / CAST(top AS DOUBLE) >= 0.5 THEN 'high'
  WHEN degree / CAST(top AS DOUBLE) >= 0.2 THEN 'medium' ELSE 'leaf' END AS role FROM (SELECT *, max(degree) OVER (PARTITION BY graph_id) AS top FROM dg)),
sg AS (SELECT eg.graph_id, src, dst, CASE WHEN type = 'directed' THEN a.role || '_to_' || b.role || '_directed_' || label
  ELSE least(a.role, b.role) || '_connects_' || greatest(a.role, b.role) || '_' || label END AS signature
  FROM eg JOIN gr USING (graph_id) JOIN ro a ON a.graph_id = eg.graph_id AND a.node = src JOIN ro b ON b.graph_id = eg.graph_id AND b.node = dst),
rh AS (SELECT g.graph_id, r.role, count(ro.node) AS n, count(ro.node) / CAST(any_value(t.total) AS DOUBLE) AS ratio
  FROM gr g CROSS JOIN (SELECT unnest(['hub', 'high', 'medium', 'leaf']) AS role) r JOIN (SELECT graph_id, count(*) AS total FROM ro GROUP BY graph_id) t USING (graph_id)
  LEFT JOIN ro ON ro.graph_id = g.graph_id AND ro.role = r.role GROUP BY g.graph_id, r.role),
ue AS (SELECT DISTINCT graph_id, least(src, dst) AS x, greatest(src, dst) AS y FROM eg WHERE src <> dst),
tr AS (SELECT a.graph_id, a.x AS a, a.y AS b, b.y AS c FROM ue a JOIN ue b ON b.graph_id = a.graph_id AND b.x = a.y
  JOIN ue c ON c.graph_id = a.graph_id AND c.x = a.x AND c.y = b.y),
fa AS (SELECT graph_id, count(*) AS n, max(degree) AS top, sum(degree) AS total, sum(degree * degree) AS total2, min(degree) AS low,
  count(*) FILTER (degree = 1) AS ones, count(*) FILTER (degree = 2) AS twos,
  count(*) FILTER (role = 'hub') AS role_hub, count(*) FILTER (role = 'high') AS role_high, count(*) FILTER (role = 'medium') AS role_medium,
  count(*) FILTER (role = 'leaf') AS role_leaf FROM ro GROUP BY graph_id),
fe AS (SELECT graph_id, count(*) AS m FROM eg GROUP BY graph_id),
ft AS (SELECT graph_id, type AS graph_type, n AS num_nodes, m AS num_edges,
  CASE WHEN n > 1 THEN round(m / (n * (n - 1) / 2.0::DOUBLE), 6) ELSE 0 END AS density, round(CAST(total AS DOUBLE) / (n * n), 6) AS avg_degree_ratio,
  round(CAST(top AS DOUBLE) / n, 6) AS max_degree_ratio, round(CAST(n * total2 - total * total AS DOUBLE) / (n * n), 6) AS degree_variance,
  CAST(top >= n - 1 AS INT) AS has_hub, CAST(low = top AS INT) AS is_regular, CAST(m = n - 1 AS INT) AS is_tree, CAST(m >= n AS INT) AS is_cyclic,
  CASE WHEN top >= n - 1 AND ones = n - 1 THEN 'star' WHEN m = n AND twos = n THEN 'cycle' WHEN m = n - 1 AND top = n - 1 THEN 'star'
    WHEN m = n - 1 AND top <= 3 THEN 'tree' WHEN m > n AND top = n - 1 THEN 'complete' ELSE 'complex' END AS topology_type,
  role_hub, role_high, role_medium, role_leaf FROM fa JOIN fe USING (graph_id) JOIN gr USING (graph_id))"""


def trade(spark, sf, reuse=False):
    """(nodes, edges, graphs).  Lines are reduced to distinct nation pairs per day before
    anything else is derived; with ``reuse`` the edges are checkpointed, for jobs that read
    them many times."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    edges = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
             .join(s, li.l_suppkey == s.s_suppkey)
             .select(day.alias("graph_id"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("src"),
                     F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("dst"),
                     F.lit("ships").alias("label")).distinct())
    if reuse:
        checkpoint_dir(spark)
        edges = edges.checkpoint()
    nodes = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    odd = F.substring("graph_id", 10, 1).cast("int") % 2
    graphs = edges.select("graph_id").distinct().withColumn(
        "type", F.when(odd == 0, "directed").otherwise("undirected"))
    return nodes, edges, graphs


@query(f"WITH {GRAPH} SELECT graph_id, node, degree FROM dg")
def graph_degrees(spark, sf):
    """Degree per node."""
    n, e, _ = trade(spark, sf)
    return G.degrees(n, e)


@query(f"WITH {GRAPH} SELECT graph_id, role, count(*) AS nodes FROM ro GROUP BY graph_id, role")
def graph_roles(spark, sf):
    """Degree roles."""
    n, e, _ = trade(spark, sf)
    return G.roles(n, e).groupBy("graph_id", "role").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"WITH {GRAPH} SELECT graph_id, src, dst, signature FROM sg")
def graph_edge_signatures(spark, sf):
    """Role signature of every edge."""
    return G.edge_signatures(*trade(spark, sf, reuse=True))


@query(f"WITH {GRAPH} SELECT graph_id, 'dist_' || role || '_' || format('{{:.2f}}', ratio) AS atom FROM rh")
def graph_role_histogram(spark, sf):
    """Role shares as atoms."""
    n, e, _ = trade(spark, sf)
    h = G.role_histogram(n, e)
    return h.select("graph_id", F.concat(F.lit("dist_"), "role", F.lit("_"), G.two_decimals("ratio")).alias("atom"))


@query(f"WITH {GRAPH} SELECT graph_id, a, b, c FROM tr")
def graph_triangles(spark, sf):
    """All triangles."""
    return G.triangles(trade(spark, sf, reuse=True)[1])


@query(f"WITH {GRAPH} SELECT * FROM ft")
def graph_features(spark, sf):
    """Features and topology class per graph."""
    return G.features(*trade(spark, sf))


_VECTOR = f"""{GRAPH},
al AS (SELECT graph_id AS id, signature AS a FROM sg UNION ALL SELECT graph_id, 'dist_' || role || '_' || format('{{:.2f}}', ratio) FROM rh
  UNION ALL SELECT DISTINCT graph_id, 'has_triangles' FROM tr),
{flat_map_sql('ft', 'graph_id', G.META, D, 'mt', 'SELECT a FROM al')},
bd AS (SELECT id, d, CAST(sign(sum(x)) AS INT) AS x FROM al JOIN cb USING (a) GROUP BY id, d),
gv AS (SELECT id, d, bd.x * mt.x AS x FROM bd JOIN mt USING (id, d)),
gl AS (SELECT id, list(x ORDER BY d)::FLOAT[] AS v FROM gv GROUP BY id),
rp AS (SELECT min(graph_id) AS q FROM ft GROUP BY topology_type, graph_type)"""


@query(f"WITH {_VECTOR} SELECT id AS graph_id, {HEX} AS vec FROM gv GROUP BY id")
def graph_vectors(spark, sf):
    """Graph vectors."""
    return G.graph_vectors(*trade(spark, sf, reuse=True), D).select("graph_id", hex_text("vec").alias("vec"))


_SCORED = f"""{_VECTOR}, sc AS (SELECT q, gl.id AS doc_id, CAST(list_dot_product(p.v, gl.v) AS BIGINT) AS s FROM rp JOIN gl p ON p.id = q, gl),
hit AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, doc_id) AS rank FROM sc WHERE s / {D}.0 >= 0.1)"""


def _hits(spark, sf, k):
    n, e, g = trade(spark, sf, reuse=True)
    v = G.graph_vectors(n, e, g, D).checkpoint()
    rep = G.representatives(G.features(n, e, g))
    probes = v.join(rep, "graph_id", "left_semi").select(F.col("graph_id").alias("query_id"), "vec")
    return S.search_table(v.select(F.col("graph_id").alias("doc_id"), "vec"), probes, D, k, 0.1)


@query(f"WITH {_SCORED} SELECT q AS query_id, doc_id, round(s / {D}.0, 6) AS score, CAST(rank AS INT) AS rank FROM hit WHERE rank <= 5")
def graph_similar_by_vector(spark, sf):
    """Nearest graphs of the first graph of each class."""
    return _hits(spark, sf, 5).withColumn("score", F.round("score", 6))


@query(f"""WITH {GRAPH}, rp AS (SELECT min(graph_id) AS graph_id FROM ft GROUP BY topology_type, graph_type),
p AS (SELECT b.graph_id AS query_id, a.graph_id, round((CAST(a.topology_type = b.topology_type AS INT) * 1.0::DOUBLE + CAST(a.graph_type = b.graph_type AS INT) * 0.8::DOUBLE
  + CAST(a.has_hub = b.has_hub AS INT) * 0.5::DOUBLE + CAST(a.is_tree = b.is_tree AS INT) * 0.4::DOUBLE + CAST(a.is_cyclic = b.is_cyclic AS INT) * 0.4::DOUBLE
  + CAST(a.is_regular = b.is_regular AS INT) * 0.3::DOUBLE + 0.6 * (1 - least(abs(a.density - b.density), 1.0))
  + 0.5 * (4 - abs(a.role_hub / a.num_nodes::DOUBLE - b.role_hub / b.num_nodes::DOUBLE) - abs(a.role_high / a.num_nodes::DOUBLE - b.role_high / b.num_nodes::DOUBLE)
    - abs(a.role_medium / a.num_nodes::DOUBLE - b.role_medium / b.num_nodes::DOUBLE) - abs(a.role_leaf / a.num_nodes::DOUBLE - b.role_leaf / b.num_nodes::DOUBLE)) / 4) / 4.5, 9) AS score
  FROM ft a, ft b JOIN rp ON rp.graph_id = b.graph_id)
SELECT query_id, graph_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, graph_id) AS rank FROM p) WHERE rank <= 5""")
def graph_similar_by_features(spark, sf):
    """Nearest graphs by weighted feature agreement."""
    f = G.features(*trade(spark, sf, reuse=True)).checkpoint()
    probes = f.join(G.representatives(f), "graph_id", "left_semi")
    return G.similar_by_features(f, probes, 5).withColumn("score", F.round("score", 6))


@query(f"WITH {GRAPH} SELECT graph_id FROM eg WHERE (src, dst) IN (('NATION_1', 'NATION_2'), ('NATION_3', 'NATION_4')) "
       "GROUP BY graph_id HAVING count(DISTINCT src) = 2")
def graph_containing_edges(spark, sf):
    """Graphs holding two given edges."""
    pattern = spark.createDataFrame([("NATION_1", "NATION_2"), ("NATION_3", "NATION_4")], "src STRING, dst STRING")
    return G.containing(trade(spark, sf)[1], pattern)


@query(f"""WITH {_SCORED}, h AS (SELECT q, doc_id, b.topology_type AS qf, CAST(a.topology_type = b.topology_type AS INT) AS same FROM hit
  JOIN ft a ON a.graph_id = doc_id JOIN ft b ON b.graph_id = q WHERE rank <= 30)
SELECT q AS query_id, qf AS query_family, count(*) AS hits, round(avg(same), 6) AS purity, avg(same) > 0.6 AS is_cluster FROM h GROUP BY q, qf""")
def graph_family_purity(spark, sf):
    """Share of same-class graphs among the 30 nearest."""
    f = G.features(*trade(spark, sf)).select(F.col("graph_id").alias("doc_id"), F.col("topology_type").alias("family"))
    return scoring.purity(_hits(spark, sf, 30), f).withColumn("purity", F.round("purity", 6))


@query(f"WITH {_VECTOR}, sc AS (SELECT g.id, max(CAST(list_dot_product(p.v, g.v) AS BIGINT)) AS s FROM gl g, rp JOIN gl p ON p.id = q GROUP BY g.id) "
       f"SELECT id AS graph_id, round(s / {D}.0, 6) AS best FROM sc WHERE s / {D}.0 < 0.3")
def graph_anomalies(spark, sf):
    """Graphs unlike every known good graph."""
    n, e, g = trade(spark, sf, reuse=True)
    v = G.graph_vectors(n, e, g, D).checkpoint()
    good = v.join(G.representatives(G.features(n, e, g)), "graph_id", "left_semi")
    best = S.search_table(good.select(F.col("graph_id").alias("doc_id"), "vec"),
                          v.select(F.col("graph_id").alias("query_id"), "vec"), D, 1, None)
    return best.where("score < 0.3").select(F.col("query_id").alias("graph_id"), F.round("score", 6).alias("best"))


@query(f"""WITH {GRAPH} SELECT graph_id, num_nodes AS n, num_edges AS e, round(2 * num_edges / CAST(num_nodes AS DOUBLE), 6) AS avg_degree,
  round(CASE WHEN num_nodes > 1 THEN num_edges / (num_nodes * (num_nodes - 1) / 2.0::DOUBLE) ELSE 0 END, 6) AS density,
  round(CASE WHEN num_edges > 10 THEN top / (2 * num_edges / CAST(num_nodes AS DOUBLE)) END, 6) AS hub_dominance,
  round(CASE WHEN num_edges > 10 THEN CASE WHEN 2 * num_edges / CAST(num_nodes AS DOUBLE) > 1 THEN ln(num_nodes) / ln(2 * num_edges / CAST(num_nodes AS DOUBLE)) ELSE num_nodes END END, 6) AS avg_path_length
  FROM ft JOIN fa USING (graph_id)""")
def topology_properties(spark, sf):
    """Average degree, density, hub dominance and path estimate."""
    n, e, _ = trade(spark, sf)
    p = signatures.topology_properties(n, e)
    return p.select("graph_id", "n", "e", *[F.round(c, 6).alias(c) for c in (
        "avg_degree", "density", "hub_dominance", "avg_path_length")])


@query(f"""WITH {GRAPH}, m AS (SELECT graph_id, count(*) AS node_count FROM nd GROUP BY graph_id)
SELECT graph_id, type, node_count, m AS edge_count FROM m JOIN fe USING (graph_id) JOIN gr USING (graph_id)""")
def graph_metadata(spark, sf):
    """Node and edge counts of ingested graphs."""
    n, e, g = trade(spark, sf)
    return (g.join(n.groupBy("graph_id").agg(F.count(F.lit(1)).alias("node_count")), "graph_id")
            .join(e.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edge_count")), "graph_id"))
