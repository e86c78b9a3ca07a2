"""Numeric bands: a number becomes a label, and the label's atom becomes its vector.

Bands are ``(upper bound, label)`` lists tested with ``<`` in order; NaN and null fall to the
last label, as every comparison with them fails.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band limits and labels of the numeric primitives.
PRIMITIVES = {
    "convergence_rate": ([(0.2, "very_slow_convergence"), (0.4, "slow_convergence"),
                          (0.6, "moderate_slow_convergence"), (0.8, "moderate_convergence"),
                          (0.9, "fast_convergence"), (0.95, "very_fast_convergence")], "divergent"),
    "iteration_complexity": ([(10, "low_complexity"), (50, "moderate_complexity"), (200, "high_complexity")],
                             "extreme_complexity"),
    "frequency_domain": ([(0.01, "very_low_frequency"), (0.1, "low_frequency"), (1.0, "medium_low_frequency"),
                          (10.0, "medium_frequency"), (100.0, "high_frequency")], "ultrasonic_frequency"),
    "amplitude_scale": ([(0.1, "micro_scale"), (0.5, "small_scale"), (2.0, "medium_scale"), (10.0, "large_scale")],
                        "macro_scale"),
    "power_law_exponent": ([(2.0, "shallow_power_law"), (2.5, "typical_power_law"), (3.0, "steep_power_law")],
                           "extreme_power_law"),
    "clustering_coefficient": ([(0.2, "low_clustering"), (0.5, "moderate_clustering"), (0.8, "high_clustering")],
                               "extreme_clustering"),
}
DISTANCE = [(10, "long"), (5, "moderate"), (2, "short")]

# Band limits and labels used by the pattern and topology signatures.
CONVERGENCE = ([(0.3, "slow"), (0.7, "medium"), (0.9, "fast")], "divergent")
ITERATION = ([(10, "low"), (50, "medium"), (200, "high")], "extreme")
BOUNDARY = ([(0.3, "smooth"), (0.7, "jagged")], "chaotic")
FREQUENCY = ([(0.1, "low"), (1.0, "medium"), (10.0, "high")], "ultrasonic")
AMPLITUDE = ([(0.1, "micro"), (0.5, "small"), (2.0, "medium"), (10.0, "large")], "macro")
PHASE = ([(math.pi / 4, "in_phase"), (math.pi / 2, "quadrature"), (3 * math.pi / 4, "out_phase")], "complex")
INTERFERENCE = ([(0.3, "constructive"), (0.7, "destructive")], "standing")
COEFFICIENT = ([(0.1, "small"), (1.0, "medium"), (10.0, "large")], "extreme")
POWER_LAW = ([(2.0, "shallow"), (2.5, "typical"), (3.0, "steep")], "extreme")
HUB = ([(0.3, "weak_hubs"), (0.6, "moderate_hubs"), (0.8, "strong_hubs")], "dominant_hubs")
CLUSTERING = ([(0.2, "low"), (0.5, "moderate"), (0.8, "high")], "extreme")
REWIRING = ([(0.05, "low"), (0.2, "moderate")], "high")
CONNECTION = ([(0.05, "sparse"), (0.2, "moderate"), (0.5, "dense")], "complete")
VARIANCE = ([(0.3, "uniform"), (0.6, "moderate"), (0.8, "variable")], "extreme")
CLUSTERING_LEVEL = ([(0.1, "minimal"), (0.3, "weak"), (0.6, "moderate")], "strong")
DEGREE = {1: "linear", 2: "quadratic", 3: "cubic"}


def band(value: Column, bands) -> Column:
    limits, last = bands
    number = F.when(F.isnan(value.cast("double")), F.lit(None)).otherwise(value)
    out = F.lit(last)
    for limit, label in reversed(limits):
        out = F.when(number < limit, F.lit(label)).otherwise(out)
    return out


def above(value: Column, limits, last: str) -> Column:
    number = F.when(F.isnan(value.cast("double")), F.lit(None)).otherwise(value)
    out = F.lit(last)
    for limit, label in reversed(limits):
        out = F.when(number > limit, F.lit(label)).otherwise(out)
    return out


def primitive_label(primitive: str, value: Column) -> Column:
    """Band label of one of the eight numeric primitives."""
    if primitive in PRIMITIVES:
        return band(value, PRIMITIVES[primitive])
    if primitive == "topological_distance":
        return F.concat(above(value, DISTANCE, "minimal"), F.lit("_distance"))
    if primitive == "self_similarity":
        return F.concat(F.lit("self_similarity_level_"), level(value))
    raise ValueError(f"unknown primitive {primitive!r}")


def level(value: Column) -> Column:
    """``int(3 * x) + 1`` as text (truncation towards zero)."""
    return ((value * 3).cast("bigint") + 1).cast("string")
