"""Pairwise similarity measures as column expressions.

Each function takes two ``ARRAY<numeric>`` columns of one length and stays on the JVM side.
``from_sums`` variants work on precomputed dot products and squared norms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default weights.
MULTI_WEIGHTS = {"cosine": 0.4, "dot": 0.3, "euclidean": 0.2, "manhattan": 0.1}
ENSEMBLE_WEIGHTS = {"cosine": 0.5, "hierarchical": 0.3, "contextual": 0.2}
LEVEL_WEIGHTS = (0.5, 0.3, 0.2)


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda s, x: s + x)


def _zip(a: Column, b: Column, fn) -> Column:
    return F.zip_with(a, b, lambda x, y: fn(x.cast("double"), y.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: x * y))


def norm2(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def normalized_dot(a: Column, b: Column) -> Column:
    return dot(a, b) / F.size(a)


def cosine_of(d: Column, na2: Column, nb2: Column) -> Column:
    return F.when((na2 == 0) | (nb2 == 0), F.lit(0.0)).otherwise(d / (F.sqrt(na2) * F.sqrt(nb2)))


def cosine(a: Column, b: Column) -> Column:
    """cos in [-1, 1]; a zero norm gives 0 and unequal lengths are an error."""
    same = F.size(a) == F.size(b)
    return F.when(same, cosine_of(dot(a, b), norm2(a), norm2(b))).otherwise(
        F.raise_error(F.lit("vector dimensions must match")).cast("double"))


def cosine01(a: Column, b: Column) -> Column:
    """(cos + 1) / 2; a zero norm gives 0."""
    na2, nb2 = norm2(a), norm2(b)
    return F.when((na2 == 0) | (nb2 == 0), F.lit(0.0)).otherwise((cosine_of(dot(a, b), na2, nb2) + 1) / 2)


dot01 = cosine01


def distance2(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.exp(-F.sqrt(distance2(a, b)) / 10)


def manhattan(a: Column, b: Column) -> Column:
    return F.exp(-_sum(_zip(a, b, lambda x, y: F.abs(x - y))) / (F.size(a) * 10))


def check_weights(weights: dict) -> dict:
    total = sum(weights.values())
    if abs(total - 1.0) > 1e-6:
        raise ValueError(f"weights must sum to 1.0, got {total}")
    unknown = set(weights) - set(MULTI_WEIGHTS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    return weights


def multi_metric(a: Column, b: Column, weights: dict | None = None) -> Column:
    weights = check_weights(weights or MULTI_WEIGHTS)
    terms = {"cosine": cosine01(a, b), "dot": (dot01(a, b) + 100) / 200,
             "euclidean": euclidean(a, b), "manhattan": manhattan(a, b)}
    total = F.lit(0.0)
    for name, w in weights.items():
        if w > 0:
            total = total + terms[name] * F.lit(float(w))
    return total


def contextual_from(base: Column, query_length=1, target_length=1, domain_match=False, recent=False) -> Column:
    """Base score with length, domain and recency factors, capped at 1."""
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)
    q, t = col(query_length), col(target_length)
    boost = (F.when((q < 3) & (F.abs(q - t) > 1), F.lit(0.8)).otherwise(F.lit(1.0))
             * F.when(col(domain_match), F.lit(1.1)).otherwise(F.lit(1.0))
             * F.when(col(recent), F.lit(1.05)).otherwise(F.lit(1.0)))
    return F.least(base * boost, F.lit(1.0))


def contextual(a: Column, b: Column, **context) -> Column:
    return contextual_from(cosine01(a, b), **context)


def hierarchical(a: Column, b: Column, dims: int, levels: int = 3, pair=cosine01) -> Column:
    """Weighted score of the first ``levels`` blocks of ``dims / 2**levels`` dimensions."""
    size = dims // 2**levels
    total = F.lit(0.0)
    for level, w in enumerate(LEVEL_WEIGHTS[:levels]):
        if size:
            total = total + F.lit(w) * pair(F.slice(a, level * size + 1, size), F.slice(b, level * size + 1, size))
    return total


def ensemble(a: Column, b: Column, dims: int, weights: dict | None = None) -> Column:
    parts = {"cosine": cosine01(a, b), "hierarchical": hierarchical(a, b, dims),
             "contextual": contextual(a, b, query_length=dims // 100)}
    total = F.lit(0.0)
    for name, w in (weights or ENSEMBLE_WEIGHTS).items():
        total = total + parts[name] * F.lit(float(w))
    return F.least(total, F.lit(1.0))


def length_normalized(a: Column, b: Column) -> Column:
    na, nb = F.sqrt(norm2(a)), F.sqrt(norm2(b))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(cosine(a, b) * F.least(na, nb) / F.greatest(na, nb))


def contiguous_bonus(a: Column, b: Column, bonus=0.1, overlap=0.5) -> Column:
    """cos plus ``bonus * overlap``, capped at 1; pass a measured overlap column for a real one."""
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)
    return F.least(cosine(a, b) + col(bonus) * col(overlap), F.lit(1.0))


def query_type(a: Column) -> Column:
    """Label by norm and sparsity."""
    norm = F.sqrt(norm2(a))
    sparse = F.size(F.filter(a, lambda x: F.abs(x) < 0.1)) / F.size(a)
    return (F.when(norm < 10, "short").when(sparse > 0.8, "exact").when(norm > 50, "long").otherwise("fuzzy"))


def blend(a: Column, b: Column, cosine_weight=0.7, euclidean_weight=0.3) -> Column:
    total = cosine_weight + euclidean_weight
    return (cosine01(a, b) * cosine_weight + euclidean(a, b) * euclidean_weight) / total


def subspace_blend(a: Column, b: Column, dims: int) -> Column:
    return hierarchical(a, b, dims, pair=blend)


def category_boost(score: Column, same: Column, boost: float = 0.1) -> Column:
    return F.least(score + F.when(same, F.lit(boost)).otherwise(F.lit(0.0)), F.lit(1.0))
