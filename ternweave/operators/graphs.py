"""Graph jobs over ``nodes(graph_id, node)``, ``edges(graph_id, src, dst, label)`` and
``graphs(graph_id, type)``."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ternweave.operators import algebra as A
from ternweave.operators.encode import encode_atom, encode_row

ROLES = ("hub", "high", "medium", "leaf")


def endpoint_degrees(edges: DataFrame) -> DataFrame:
    """Degree per endpoint; a self-loop counts twice."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("degree"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of every listed node, 0 for isolated ones."""
    return (nodes.select("graph_id", "node").join(endpoint_degrees(edges), ["graph_id", "node"], "left")
            .withColumn("degree", F.coalesce("degree", F.lit(0))))


def role(degree: Column, top: Column) -> Column:
    """Degree role relative to the largest degree of the graph."""
    ratio = F.when(top > 0, degree / top).otherwise(0.0)
    return (F.when(ratio >= 0.9, "hub").when(ratio >= 0.5, "high").when(ratio >= 0.2, "medium").otherwise("leaf"))


def roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, degree, role)."""
    d = degrees(nodes, edges)
    top = d.groupBy("graph_id").agg(F.max("degree").alias("top"))
    return d.join(top, "graph_id").select("graph_id", "node", "degree", role(F.col("degree"), F.col("top")).alias("role"))


def edge_signatures(nodes: DataFrame, edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """Role pair and label of every edge; undirected pairs are sorted.  An unlisted endpoint
    has degree 0."""
    r = roles(nodes, edges)
    joined = edges
    for end in ("src", "dst"):
        side = r.select("graph_id", F.col("node").alias(end), F.col("role").alias(f"{end}_role"))
        joined = joined.join(side, ["graph_id", end], "left")
    a, b = F.coalesce("src_role", F.lit("leaf")), F.coalesce("dst_role", F.lit("leaf"))
    pair = F.array_sort(F.array(a, b))
    label = F.coalesce("label", F.lit("connects"))
    text = F.when(F.col("type") == "directed", F.concat(a, F.lit("_to_"), b, F.lit("_directed_"), label)).otherwise(
        F.concat(pair[0], F.lit("_connects_"), pair[1], F.lit("_"), label))
    return joined.join(graphs.select("graph_id", "type"), "graph_id").select("graph_id", "src", "dst",
                                                                            text.alias("signature"))


def two_decimals(ratio: Column | str) -> Column:
    """Correctly rounded two-decimal text of a double (the JVM formatter rounds the printed
    digits, which differs on ties)."""
    @arrow_udf("string")
    def text(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.2f}" for v in x.to_pylist()], pa.string())
    return text(F.col(ratio) if isinstance(ratio, str) else ratio)


def role_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, role, n, ratio) for all four roles."""
    r = roles(nodes, edges)
    wide = r.groupBy("graph_id").agg(F.count(F.lit(1)).alias("total"), *[
        F.sum((F.col("role") == x).cast("int")).alias(x) for x in ROLES])
    return (wide.select("graph_id", "total", F.explode(F.array(*[
        F.struct(F.lit(x).alias("role"), F.col(x).alias("n")) for x in ROLES])).alias("h"))
        .select("graph_id", "h.role", "h.n", (F.col("h.n") / F.col("total")).alias("ratio")))


def triangles(edges: DataFrame) -> DataFrame:
    """Mutually connected node triples, once each: (graph_id, a, b, c) with a < b < c.

    Edges are made undirected and distinct and point from the lower to the higher (degree,
    name), so a hub has few outgoing edges and the wedge count stays within E ** 1.5.
    """
    und = (edges.where(F.col("src") != F.col("dst"))
           .select("graph_id", F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct())
    deg = endpoint_degrees(und.select("graph_id", F.col("x").alias("src"), F.col("y").alias("dst")))
    for end in ("x", "y"):
        und = und.join(deg.select("graph_id", F.col("node").alias(end), F.col("degree").alias(f"d{end}")),
                       ["graph_id", end])
    forward = F.struct("dx", "x") < F.struct("dy", "y")
    e = und.select("graph_id", F.when(forward, F.col("x")).otherwise(F.col("y")).alias("lo"),
                   F.when(forward, F.col("y")).otherwise(F.col("x")).alias("hi"),
                   F.when(forward, F.col("dy")).otherwise(F.col("dx")).alias("dh"))
    one = e.select("graph_id", "lo", F.col("hi").alias("m"), F.col("dh").alias("dm"))
    two = e.select("graph_id", "lo", F.col("hi").alias("t"), F.col("dh").alias("dt"))
    wedges = one.join(two, ["graph_id", "lo"]).where(F.struct("dm", "m") < F.struct("dt", "t"))
    closed = wedges.join(e.select("graph_id", F.col("lo").alias("m"), F.col("hi").alias("t")), ["graph_id", "m", "t"])
    s = F.array_sort(F.array("lo", "m", "t"))
    return closed.select("graph_id", s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def features(nodes: DataFrame, edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """Scale-free features and the topology class by ordered rules.

    Tree and cycle flags compare edge and node counts, as the class rules do.
    """
    r = roles(nodes, edges)
    d = F.col("degree")
    agg = r.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(d).alias("top"), F.sum(d).alias("total"), F.sum(d * d).alias("total2"),
        F.min(d).alias("low"), F.sum((d == 1).cast("int")).alias("ones"), F.sum((d == 2).cast("int")).alias("twos"),
        *[F.sum((F.col("role") == x).cast("int")).alias(f"role_{x}") for x in ROLES])
    e = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("e"))
    g = (graphs.select("graph_id", "type").join(agg, "graph_id", "left").join(e, "graph_id", "left")
         .na.fill(0, ["n", "top", "total", "total2", "low", "ones", "twos", "e", *[f"role_{x}" for x in ROLES]]))
    n, m, top = F.col("n"), F.col("e"), F.col("top")
    kind = (F.when((top >= n - 1) & (F.col("ones") == n - 1), "star")
            .when((m == n) & (F.col("twos") == n), "cycle")
            .when((m == n - 1) & (top == n - 1), "star")
            .when((m == n - 1) & (top <= 3), "tree")
            .when((m > n) & (top == n - 1), "complete")
            .otherwise("complex"))

    def ratio(a, b):
        return F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return g.select(
        "graph_id", F.col("type").alias("graph_type"), n.alias("num_nodes"), m.alias("num_edges"),
        F.when(n > 1, F.round(m / (n * (n - 1) / 2), 6)).otherwise(0.0).alias("density"),
        ratio(F.col("total"), n * n).alias("avg_degree_ratio"),
        ratio(top, n).alias("max_degree_ratio"),
        ratio(n * F.col("total2") - F.col("total") * F.col("total"), n * n).alias("degree_variance"),
        (top >= n - 1).cast("int").alias("has_hub"),
        ((n > 0) & (F.col("low") == top)).cast("int").alias("is_regular"),
        (m == n - 1).cast("int").alias("is_tree"), (m >= n).cast("int").alias("is_cyclic"),
        kind.alias("topology_type"), *[f"role_{x}" for x in ROLES])


META = ("density", "avg_degree_ratio", "max_degree_ratio", "degree_variance", "graph_type", "has_hub", "is_regular",
        "is_tree", "is_cyclic", "topology_type")


def graph_atoms(nodes: DataFrame, edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """(graph_id, atom, times): edge signatures, role histogram and triangle flag of graphs with
    edges; node names of graphs without."""
    sig = edge_signatures(nodes, edges, graphs).select("graph_id", F.col("signature").alias("atom"))
    linked = edges.select("graph_id").distinct()
    hist = (role_histogram(nodes, edges).join(linked, "graph_id", "left_semi")
            .select("graph_id", F.concat(F.lit("dist_"), "role", F.lit("_"), two_decimals("ratio")).alias("atom")))
    tri = triangles(edges).select("graph_id").distinct().select("graph_id", F.lit("has_triangles").alias("atom"))
    bare = nodes.join(linked, "graph_id", "left_anti").select("graph_id", F.col("node").alias("atom"))
    both = sig.unionByName(hist).unionByName(tri)
    return (both.groupBy("graph_id", "atom").agg(F.count(F.lit(1)).alias("times"))
            .unionByName(bare.select("graph_id", "atom", F.lit(1).cast("bigint").alias("times"))))


def graph_vectors(nodes: DataFrame, edges: DataFrame, graphs: DataFrame, dims: int) -> DataFrame:
    """(graph_id, vec): bundle of the atoms bound with the encoded feature map.

    Repeated atoms are counted first, so one vector exists per distinct (graph, atom).
    """
    atoms = graph_atoms(nodes, edges, graphs)
    body = A.bundle_by(atoms.select("graph_id", "times", encode_atom("atom", dims).alias("vec")), "graph_id", "vec",
                       dims, weight="times")
    meta = (features(nodes, edges, graphs)
            .select("graph_id", (F.col("num_edges") > 0).alias("linked"), encode_row(*META, dims=dims).alias("meta")))
    return (body.join(meta, "graph_id")
            .select("graph_id", F.when(F.col("linked"), A.bind("vec", "meta", dims)).otherwise(F.col("vec")).alias("vec")))


def distribution_similarity(a: str, b: str) -> Column:
    """Mean over the roles of 1 - |difference of shares|."""
    def share(side, x):
        total = reduce(lambda p, q: p + q, [F.col(f"{side}.role_{r}") for r in ROLES])
        return F.col(f"{side}.role_{x}") / F.when(total > 0, total).otherwise(1)
    parts = [1 - F.least(F.abs(share(a, x) - share(b, x)), F.lit(1.0)) for x in ROLES]
    return reduce(lambda p, q: p + q, parts) / 4


# Weights of the topological similarity.
SIMILARITY_WEIGHTS = {"topology_type": 1.0, "graph_type": 0.8, "has_hub": 0.5, "is_tree": 0.4, "is_cyclic": 0.4,
                      "is_regular": 0.3}
DENSITY_WEIGHT = 0.6
ROLE_WEIGHT = 0.5


def topological_similarity(a: str = "a", b: str = "b") -> Column:
    """Weighted feature agreement of two aliased feature rows, in 0..1."""
    total = DENSITY_WEIGHT + ROLE_WEIGHT + sum(SIMILARITY_WEIGHTS.values())
    score = F.lit(0.0)
    for name, w in SIMILARITY_WEIGHTS.items():
        score = score + F.when(F.col(f"{a}.{name}") == F.col(f"{b}.{name}"), F.lit(w)).otherwise(0.0)
    gap = F.least(F.abs(F.col(f"{a}.density") - F.col(f"{b}.density")), F.lit(1.0))
    return (score + DENSITY_WEIGHT * (1 - gap) + ROLE_WEIGHT * distribution_similarity(a, b)) / F.lit(total)


def similar_by_features(feature_table: DataFrame, probes: DataFrame, k: int = 5) -> DataFrame:
    """Top-k graphs per probe graph by feature agreement: (query_id, graph_id, score, rank).

    Equal feature rows score alike, so both sides are cut to their different feature combinations, graphs
    with the k smallest ids of each; combinations are compared once, and each probe graph
    then takes the result of its own.  Neither table passes through the driver.
    """
    cols = [*SIMILARITY_WEIGHTS, "density", *[f"role_{x}" for x in ROLES]]
    same = Window.partitionBy(*cols).orderBy("graph_id")
    reps = feature_table.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k)
    kinds = probes.groupBy(*cols).agg(F.min("graph_id").alias("kind"))
    # every combination meets every graph combination: a nested loop over the two reduced tables, streamed over one of them
    scored = (reps.select("graph_id", F.struct(*cols).alias("a"))
              .join(kinds.select("kind", F.struct(*cols).alias("b")), F.col("a").isNotNull() & F.col("b").isNotNull())
              .select("kind", "graph_id", F.round(topological_similarity(), 9).alias("score")))
    w = Window.partitionBy("kind").orderBy(F.desc("score"), "graph_id")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    on = [probes[c].eqNullSafe(kinds[c]) for c in cols]
    asked = probes.join(kinds, on).select(probes["graph_id"].alias("query_id"), "kind")
    return asked.join(best, "kind").select("query_id", "graph_id", "score", "rank")


def representatives(feature_table: DataFrame) -> DataFrame:
    """First graph per topology class and graph type."""
    return (feature_table.groupBy("topology_type", "graph_type").agg(F.min("graph_id").alias("graph_id"))
            .select("graph_id"))


def containing(edges: DataFrame, pattern: DataFrame) -> DataFrame:
    """Graphs holding every edge of ``pattern(src, dst)`` (exact containment)."""
    wanted = pattern.select("src", "dst").distinct()
    size = wanted.agg(F.count(F.lit(1))).scalar()
    have = edges.select("graph_id", "src", "dst").distinct().join(wanted, ["src", "dst"])
    return (have.groupBy("graph_id").agg(F.count(F.lit(1)).alias("found"))
            .where(F.col("found") == size).select("graph_id"))
