"""Signatures of numeric properties: band labels bound into one vector."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternweave.functions import bands as B
from ternweave.operators import algebra as A
from ternweave.operators.encode import encode

RULES = ("fractal", "wave", "polynomial")
TOPOLOGIES = ("scale_free", "small_world", "random")


def encode_primitive(primitive: str, value: Column, dims: int) -> Column:
    return encode(B.primitive_label(primitive, value), dims)


def signature(labels: list[Column], dims: int) -> Column:
    """Product of the label atoms: one chained list, so a single pass over the batch."""
    return encode(F.array(*labels), dims, modes={"": "chained"})


def _p(prefix: str, label: Column) -> Column:
    return F.concat(F.lit(prefix), label)


def _or(value, default) -> Column:
    if value is None:
        return F.lit(default)
    return F.coalesce(value, F.lit(default))


def fractal_labels(convergence=None, iterations=None, boundary=None, self_similarity=None) -> list[Column]:
    return [F.lit("fractal_pattern"),
            _p("convergence_", B.band(_or(convergence, 0.5), B.CONVERGENCE)),
            _p("iteration_", B.band(_or(iterations, 10.0), B.ITERATION)),
            _p("boundary_", B.band(_or(boundary, 0.5), B.BOUNDARY)),
            _p("self_similarity_", B.level(_or(self_similarity, 0.5)))]


def wave_labels(frequency=None, amplitude=None, phase=None, interference=None) -> list[Column]:
    turn = F.abs(_or(phase, 0.0)) % F.lit(2 * math.pi)
    return [F.lit("wave_phenomenon"),
            _p("frequency_", B.band(_or(frequency, 1.0), B.FREQUENCY)),
            _p("amplitude_", B.band(_or(amplitude, 1.0), B.AMPLITUDE)),
            _p("phase_", B.band(turn, B.PHASE)),
            _p("interference_", B.band(_or(interference, 0.0), B.INTERFERENCE))]


def polynomial_labels(degree=None, coefficients=None, root="real", behavior="monotonic") -> list[Column]:
    d = _or(degree, 2)
    name = F.lit("higher_order")
    for n, label in B.DEGREE.items():
        name = F.when(d == n, F.lit(label)).otherwise(name)
    if coefficients is None:
        coefficients = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    size = F.array_max(F.transform(coefficients, lambda c: F.abs(c)))

    def text(v):
        return v if isinstance(v, Column) else F.lit(v)
    return [F.lit("polynomial_curve"), _p("degree_", name), _p("coefficient_", B.band(size, B.COEFFICIENT)),
            _p("root_", text(root)), _p("domain_", text(behavior))]


def scale_free_labels(exponent=None, hub_dominance=None, growth="preferential") -> list[Column]:
    return [F.lit("scale_free_topology"), _p("power_law_", B.band(_or(exponent, 2.5), B.POWER_LAW)),
            _p("hub_", B.band(_or(hub_dominance, 0.5), B.HUB)),
            _p("growth_", growth if isinstance(growth, Column) else F.lit(growth))]


def small_world_labels(clustering=None, path_length=None, rewiring=None) -> list[Column]:
    return [F.lit("small_world_topology"), _p("clustering_", B.band(_or(clustering, 0.6), B.CLUSTERING)),
            _p("path_", B.above(_or(path_length, 3.0), B.DISTANCE, "minimal")),
            _p("rewiring_", B.band(_or(rewiring, 0.1), B.REWIRING))]


def random_labels(connection=None, variance=None, clustering=None) -> list[Column]:
    return [F.lit("random_topology"), _p("connection_", B.band(_or(connection, 0.1), B.CONNECTION)),
            _p("variance_", B.band(_or(variance, 0.5), B.VARIANCE)),
            _p("clustering_", B.band(_or(clustering, 0.1), B.CLUSTERING_LEVEL))]


def panel_properties(panels: DataFrame, matrix: str = "matrix_id", iterations: str = "iterations",
                     interference: str = "interference") -> DataFrame:
    """Per matrix: mean iterations, share below 50, complexity flag, mean and largest interference,
    and the fixed boundary (0.7), self-similarity (0.6) and frequency (1.0) values."""
    i, x = F.col(iterations), F.col(interference)
    return panels.groupBy(matrix).agg(
        (F.sum(i) / F.count(i)).alias("avg_iterations"),
        (F.sum(F.when(i < 50, 1).when(i.isNotNull(), 0)) / F.count(i)).alias("convergence_rate"),
        F.when(F.count(i) > 0, F.when(F.max(i) > 100, "high").otherwise("moderate")).alias("complexity_level"),
        (F.sum(x) / F.count(x)).alias("interference_strength"),
        F.max(x).alias("amplitude"),
        F.when(F.count(x) > 0, F.lit(1.0)).alias("frequency"),
        F.lit(0.7).alias("boundary_complexity"), F.lit(0.6).alias("self_similarity"))


def topology_properties(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph: average degree 2E/N, density, and (above 10 edges) hub dominance max/average,
    a logarithmic path estimate and the fixed exponent (2.5) and clustering (0.6) values."""
    from ternweave.operators.graphs import endpoint_degrees
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("e"))
    top = endpoint_degrees(edges).groupBy("graph_id").agg(F.max("degree").alias("top"))
    g = n.join(e, "graph_id", "left").join(top, "graph_id", "left").withColumn("e", F.coalesce("e", F.lit(0)))
    avg = 2 * F.col("e") / F.col("n")
    big = F.col("e") > 10
    return g.select(
        "graph_id", "n", "e", avg.alias("avg_degree"),
        F.when(F.col("n") > 1, F.col("e") / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(0.0).alias("density"),
        F.when(big, F.when(avg > 0, F.col("top") / avg).otherwise(0.0)).alias("hub_dominance"),
        F.when(big, F.lit(2.5)).alias("power_law_exponent"),
        F.when(big, F.lit(0.6)).alias("clustering_coefficient"),
        F.when(big, F.when(avg > 1, F.log(F.col("n").cast("double")) / F.log(avg)).otherwise(
            F.col("n").cast("double"))).alias("avg_path_length"))


def _by_kind(kind: Column, choices: dict[str, list[Column]]) -> Column:
    out = None
    for name, labels in choices.items():
        out = F.when(kind == name, F.array(*labels)) if out is None else out.when(kind == name, F.array(*labels))
    return out


def semantic_vector(structural: Column, labels: Column, dims: int) -> Column:
    """sign(structural * signature), or the structural vector alone where ``labels`` is null."""
    sig = encode(F.coalesce(labels, F.array(F.lit(""))), dims, modes={"": "chained"})
    return F.when(labels.isNull(), structural).otherwise(A.bind(structural, sig, dims))


def matrix_labels(rule: Column) -> Column:
    """Signature labels of a row with :func:`panel_properties` columns; null for other rules."""
    c = F.col
    return _by_kind(rule, {
        "fractal": fractal_labels(c("convergence_rate"), c("avg_iterations"), c("boundary_complexity"),
                                  c("self_similarity")),
        "wave": wave_labels(c("frequency"), c("amplitude"), None, c("interference_strength")),
        "polynomial": polynomial_labels()})


def topology_labels(topology: Column) -> Column:
    """Signature labels of a row with :func:`topology_properties` columns; null for other kinds."""
    c = F.col
    return _by_kind(topology, {
        "scale_free": scale_free_labels(c("power_law_exponent"), c("hub_dominance")),
        "small_world": small_world_labels(c("clustering_coefficient"), c("avg_path_length")),
        "random": random_labels()})


def composed_fractal(avg_iterations: Column, avg_convergence: Column, self_similarity=0.8) -> list[Column]:
    return [B.primitive_label("iteration_complexity", avg_iterations),
            B.primitive_label("convergence_rate", avg_convergence),
            B.primitive_label("self_similarity", F.lit(self_similarity))]


def composed_wave(avg_frequency: Column, avg_amplitude: Column) -> list[Column]:
    return [B.primitive_label("frequency_domain", avg_frequency), B.primitive_label("amplitude_scale", avg_amplitude)]


def composed_topology(avg_degree: Column, topology: Column) -> Column:
    degree = B.primitive_label("topological_distance", avg_degree)
    return (F.when(topology == "scale_free", F.array(degree, B.primitive_label("power_law_exponent", F.lit(2.5))))
            .when(topology == "small_world", F.array(degree, B.primitive_label("clustering_coefficient", F.lit(0.6))))
            .otherwise(F.array(degree)))
