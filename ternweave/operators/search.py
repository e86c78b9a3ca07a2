"""Exact and approximate top-k search of probe vectors over a vector table.

The unit of work is always "a table of probes against a corpus": scores are blocked matrix
products inside tasks, each task keeps its own best k per probe, and one small shuffle of at
most tasks x probes x k rows gives the final ranking.  Ties are broken by document id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ternweave.functions import kernels as K
from ternweave.functions.encoding import encode_value
from ternweave.functions.predicates import (ANY, check_request, guard_predicate, negation_predicate, negation_specs)
from ternweave.functions.session import checkpoint_dir

BROADCAST_BYTES = 64 << 20
CELL_BYTES = 64 << 20
#: Probes scored at once, and bytes counted for the id of a broadcast row.
TILE, ID_BYTES = 2048, 64
#: Results per probe up to which the best are picked one by one.
FEW = 4


@dataclass(frozen=True)
class Probe:
    """One search request.  ``doc`` is a partial document, or ``vec`` a ready vector."""

    query_id: object
    doc: dict | None = None
    k: int = 10
    threshold: float = 0.0
    guard: dict | Column | None = None
    negations: dict | None = None
    vec: bytes | None = None
    any_marker: str = ANY
    or_order: str = "alternative"
    strict: bool = False
    extra: dict = field(default_factory=dict)


def probe_vector(doc: dict, dims: int, negations: dict | None = None, any_marker: str = ANY) -> np.ndarray:
    """Probe with top-level wildcard fields dropped, minus the vector of the cleaned negations."""
    kept = {k: v for k, v in doc.items() if not (isinstance(v, dict) and any_marker in v)}
    vec = encode_value(kept, dims).astype(np.int8)
    clean = negation_specs(negations)[1]
    return vec - encode_value(clean, dims) if clean else vec


class _Best:
    """Best k (score, id) per probe, exact under ties."""

    def __init__(self, ks: np.ndarray, floors: np.ndarray):
        self.ks, self.floors = ks, floors.astype(np.float64)
        self.rows: list[tuple] = []
        self.held = 0

    def offer(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None = None, first: int = 0):
        """Scores of documents against the probes from ``first`` on."""
        if allowed is not None:
            scores = np.where(allowed, scores, -np.inf)
        n = len(scores)
        kmax = int(self.ks.max())
        floor = self.floors[first:first + scores.shape[1]]
        if n > 4 * kmax:
            kth = np.partition(scores, n - kmax, axis=0)[n - kmax]
            floor = np.maximum(floor, kth)
        docs, probes = np.nonzero((scores >= floor) & (scores > -np.inf))
        if len(docs):
            self.rows.append((probes + first, scores[docs, probes], ids[docs]))
            self.held += len(docs)
            if self.held > 4 * int(self.ks.sum()) + 4096:
                self.compact()

    def compact(self):
        if not self.rows:
            return
        probes, scores, ids = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((ids, -scores, probes))
        probes, scores, ids = probes[order], scores[order], ids[order]
        first = np.searchsorted(probes, probes)
        rank = np.arange(len(probes)) - first
        keep = rank < self.ks[probes]
        last = keep & (rank == self.ks[probes] - 1)
        self.floors[probes[last]] = np.maximum(self.floors[probes[last]], scores[last])
        self.rows = [(probes[keep], scores[keep], ids[keep])]
        self.held = int(keep.sum())

    def result(self):
        self.compact()
        return self.rows[0] if self.rows else (np.array([], np.int64), np.array([]), np.array([]))


def _ids(col) -> np.ndarray:
    values = col.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _vectors(col, dims):
    if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
        return K.float_matrix(col)
    return K.to_matrix(col, dims)


def _emit(best, query_ids, doc_type, query_type):
    probes, scores, ids = best.result()
    if not len(probes):
        return
    yield pa.RecordBatch.from_arrays(
        [pa.array([query_ids[p] for p in probes], query_type),
         pa.array(ids.tolist(), doc_type), pa.array(scores, pa.float64())],
        names=["query_id", "doc_id", "score"])


def _arrow(dtype: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(dtype)


def _result_schema(query_type: T.DataType, doc_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("query_id", query_type), T.StructField("doc_id", doc_type),
                         T.StructField("score", T.DoubleType())])


def _scan(corpus: DataFrame, flags: list[str], query_type: T.DataType, query_ids, matrix: np.ndarray, ks, floors,
          flag_of, dims: int, metric: str) -> DataFrame:
    """Score a bounded probe matrix against every partition of the corpus.  Without ``ks`` every score
    from the floor on is given as it is found, and nothing is held or ranked."""
    binary = isinstance(corpus.schema["vec"].dataType, T.BinaryType)
    spark = corpus.sparkSession
    doc_type = corpus.schema["doc_id"].dataType
    shared = spark.sparkContext.broadcast((list(query_ids), matrix, None if ks is None else np.asarray(ks), np.asarray(floors, float),
                                           np.asarray(flag_of)))
    a_doc, a_query = _arrow(doc_type), _arrow(query_type)

    def run(batches):
        ids_, probes, k_, floors_, flag_ = shared.value
        probes = K.widened(probes, binary)
        best = None if k_ is None else _Best(k_, floors_)
        step = max(1, min(K.rows_per_block(dims), K.BLOCK_BYTES // (8 * min(TILE, len(ids_)))))
        for whole in batches:
            for s in range(0, whole.num_rows, step):
                b = whole.slice(s, step)
                docs, names = _vectors(b.column("vec"), dims), _ids(b.column("doc_id"))
                masks = np.column_stack([b.column(f).to_numpy(zero_copy_only=False).astype(bool) for f in flags]) if flags else None
                for t in range(0, len(ids_), TILE):
                    scores = K.score_block(metric, docs, probes[t:t + TILE])
                    if best is not None:
                        best.offer(scores, names, masks[:, flag_[t:t + TILE]] if flags else None, t)
                        continue
                    at, found = np.nonzero(scores >= floors_[t:t + TILE])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids_[t + i] for i in found], a_query), b.column("doc_id").take(pa.array(at)),
                         pa.array(scores[at, found], pa.float64())], names=["query_id", "doc_id", "score"])
        if best is not None:
            yield from _emit(best, ids_, a_doc, a_query)

    return corpus.select("doc_id", "vec", *flags).mapInArrow(run, _result_schema(query_type, doc_type))


def _rank(scored: DataFrame, k: Column) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def batch_search(corpus: DataFrame, probes: list[Probe], dims: int, metric: str = "dot",
                 filter_mode: str = "pre", schema=None, compat: bool = False, max_k: int | None = None) -> DataFrame:
    """Many requests in one pass: (query_id, doc_id, score, rank).

    ``corpus`` has ``doc_id``, ``vec`` and the columns guards refer to.  With
    ``filter_mode='pre'`` guards and negations are applied before scoring, so k matching rows
    return when there are k; ``'post'`` cuts to k first and filters afterwards.  ``schema`` is
    the guard source (a VARIANT column's name, or the corpus schema by default).  ``max_k`` is the limit
    that a service may set; there is none by default.
    """
    if filter_mode not in ("pre", "post"):
        raise ValueError("filter_mode must be 'pre' or 'post'")
    source = schema if schema is not None else corpus.schema
    plain: list[Probe] = []
    order: list[tuple] = []
    for p in probes:
        check_request(p.k, max(p.threshold, 0.0), max_k)
        alternatives = p.doc.get("$or") if p.doc else None
        if isinstance(alternatives, list):
            for alt, doc in enumerate(alternatives):
                order.append((p.query_id, alt, p.k, p.or_order))
                plain.append(Probe((p.query_id, alt), doc, p.k, p.threshold, p.guard, p.negations))
        else:
            order.append((p.query_id, 0, p.k, p.or_order))
            plain.append(Probe((p.query_id, 0), p.doc, p.k, p.threshold, p.guard, p.negations, p.vec, p.any_marker,
                               strict=p.strict))
    if not plain:
        return _empty(corpus, probes)

    flags, conditions, flag_of, seen = [], [], [], {}
    for p in plain:
        if p.guard is None and not p.negations:
            cond, key = F.lit(True), "all"
        else:
            cond = guard_predicate(source, p.guard, compat, p.strict) & negation_predicate(source, p.negations)
            key = (id(p.guard) if isinstance(p.guard, Column) else repr(p.guard), repr(p.negations), p.strict)
        if key not in seen:
            seen[key] = len(flags)
            flags.append(f"_allow{len(flags)}")
            conditions.append(cond)
        flag_of.append(seen[key])
    view = corpus
    if filter_mode == "pre" and "all" not in seen:
        view = view.where(reduce(lambda a, b: a | b, conditions))    # bare, so it reaches the scan
    for flag, cond in zip(flags, conditions):
        view = view.withColumn(flag, F.coalesce(cond, F.lit(False)))
    matrix = np.stack([np.frombuffer(p.vec, np.int8) if p.vec is not None
                       else probe_vector(p.doc, dims, p.negations, p.any_marker) for p in plain])
    ks = [p.k for p in plain]
    floors = [p.threshold for p in plain]
    slots = list(range(len(plain)))
    step = _fitting(corpus, dims, BROADCAST_BYTES)
    groups = [slots[i:i + step] for i in range(0, len(slots), step)]
    used = flags if filter_mode == "pre" and len(flags) > 1 else []
    scored = None
    for g in groups:
        part = _scan(view, used, T.IntegerType(), g, matrix[g], [ks[i] for i in g], [floors[i] for i in g],
                     [flag_of[i] for i in g], dims, metric)
        scored = part if scored is None else scored.unionByName(part)
    spark = corpus.sparkSession
    table = spark.createDataFrame(
        [(i, q[0], q[1], q[2], q[3], flag_of[i]) for i, q in enumerate(order)],
        T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("qid", _python_type(order)),
                      T.StructField("alt", T.IntegerType()), T.StructField("k", T.IntegerType()),
                      T.StructField("or_order", T.StringType()), T.StructField("flag", T.IntegerType())]))
    hits = (scored.join(F.broadcast(table), F.col("query_id") == F.col("slot"))
            .select(F.col("query_id").alias("slot"), "qid", "alt", "k", "or_order", "flag", "doc_id", "score"))
    w = Window.partitionBy("slot").orderBy(F.desc("score"), "doc_id")
    hits = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("k"))
    if filter_mode == "post" and (len(flags) > 1 or "all" not in seen):
        marks = view.select("doc_id", *flags)
        hits = hits.join(marks, "doc_id").where(
            F.element_at(F.array(*[F.col(f) for f in flags]), F.col("flag") + 1)).drop(*flags)
    if any(isinstance(p.doc, dict) and isinstance(p.doc.get("$or"), list) for p in probes):
        by_alt = (F.when(F.col("or_order") == "score", F.lit(0)).otherwise(F.col("alt")))
        first = Window.partitionBy("qid", "doc_id").orderBy(by_alt, F.desc("score"), "alt")
        hits = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        final = Window.partitionBy("qid").orderBy(by_alt, F.desc("score"), "doc_id")
    else:
        final = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return (hits.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= F.col("k"))
            .select(F.col("qid").alias("query_id"), "doc_id", "score", "rank"))


def _python_type(order) -> T.DataType:
    return T.StringType() if any(isinstance(q[0], str) for q in order) else T.LongType()


def _empty(corpus, probes):
    kind = T.StringType() if any(isinstance(p.query_id, str) for p in probes) else T.LongType()
    schema = T.StructType([*_result_schema(kind, corpus.schema["doc_id"].dataType),
                           T.StructField("rank", T.IntegerType())])
    return corpus.sparkSession.createDataFrame([], schema)


def search(corpus: DataFrame, probe: dict, dims: int, k: int = 10, threshold: float = 0.0, guard=None,
           negations=None, **options) -> DataFrame:
    """One request: (doc_id, score, rank)."""
    p = Probe(0, probe, k, threshold, guard, negations, any_marker=options.pop("any_marker", ANY),
              or_order=options.pop("or_order", "alternative"))
    return batch_search(corpus, [p], dims, **options).drop("query_id")


def search_by_vector(corpus: DataFrame, vec: bytes, dims: int, k: int = 10, threshold: float = 0.0, guard=None,
                     negations=None, strict: bool = False, **options) -> DataFrame:
    """A ready vector as the probe; ``negations`` only filter."""
    if len(vec) != dims:
        raise ValueError(f"vector length mismatch: expected {dims}, found {len(vec)}")
    p = Probe(0, None, k, threshold, guard, negations, vec=vec, strict=strict)
    return batch_search(corpus, [p], dims, **options).drop("query_id")


def search_table(corpus: DataFrame, probes: DataFrame, dims: int, k: int = 10, threshold: float | None = 0.0,
                 metric: str = "dot", exclude_self: bool = False, broadcast_bytes: int = BROADCAST_BYTES,
                 cells: tuple[int, int] | None = None) -> DataFrame:
    """A probe table (query_id, vec) against a corpus (doc_id, vec): (query_id, doc_id, score, rank).

    Both sides are counted.  The smaller one is broadcast if it fits ``broadcast_bytes`` in the type it is
    multiplied in, ids included; the larger one is never collected, copied or shuffled.  If neither fits,
    the probes pass over the corpus in slices of that size, and the results of each slice are stored in the
    shared folder before the next.  ``cells`` asks for a grid of bounded cells instead, which
    copies both sides.  ``threshold=None`` keeps every score.
    """
    if metric not in K.METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {K.METRICS}")
    if k < 1:
        raise ValueError("k must be >= 1")
    floor = -math.inf if threshold is None else float(threshold)
    ask = k + 1 if exclude_self else k
    if cells is not None:
        scored = _grid(corpus, probes, dims, ask, floor, metric, cells)
    else:
        limit = _fitting(corpus, dims, broadcast_bytes)
        asked, known = probes.count(), corpus.count()
        if 0 < known <= limit and known < asked:
            few = corpus.select("doc_id", "vec").collect()
            return _scan_probes(few, corpus.schema["doc_id"].dataType, probes, dims, k, floor, metric, exclude_self)
        scored = _slices(corpus, probes, asked, limit, ask, floor, dims, metric)
    if exclude_self:
        scored = scored.where(F.col("query_id") != F.col("doc_id"))
    return _rank(scored, F.lit(k))


def search_classes(corpus: DataFrame, probes: DataFrame, dims: int, k: int = 10, threshold: float | None = 0.0, metric: str = "dot",
                   exclude_self: bool = False) -> DataFrame:
    """The results of :func:`search_table`, where many probes or documents have one and the same vector.

    Each distinct probe vector is compared once, with the first documents by id of each distinct vector: no others can be among its
    results.  So copies add nothing to what is compared."""
    checkpoint_dir(corpus.sparkSession)
    ask = k + 1 if exclude_self else k
    copies = Window.partitionBy("vec").orderBy("doc_id")
    first = corpus.select("doc_id", "vec", F.row_number().over(copies).alias("_n")).where(F.col("_n") <= ask).drop("_n").checkpoint()
    own = probes.select("query_id", "vec").checkpoint()
    asks = own.groupBy("vec").agg(F.min("query_id").alias("_class")).checkpoint()
    hits = search_table(first, asks.select(F.col("_class").alias("query_id"), "vec"), dims, ask, threshold, metric)
    members = own.join(asks, "vec").select("query_id", "_class")
    out = members.join(hits.select(F.col("query_id").alias("_class"), "doc_id", "score", "rank"), "_class")
    if not exclude_self:
        return out.select("query_id", "doc_id", "score", "rank")
    return _rank(out.where(F.col("query_id") != F.col("doc_id")).select("query_id", "doc_id", "score"), F.lit(k))


def search_requests(corpus: DataFrame, requests: DataFrame, dims: int, guards: dict[str, Column] | None = None,
                    metric: str = "dot") -> DataFrame:
    """A table of requests (query_id, vec, k, threshold, guard) against a corpus: (query_id, doc_id, score, rank).

    Every request has its own k, threshold and guard.  ``guards`` names the conditions over the corpus's columns;
    a null guard lets every document through and an unknown name is an error.  Each guard filters the
    corpus before anything is scored, where the scan can use it, and only the requests that name it are
    compared with what it leaves."""
    guards = guards or {}
    named = {r["guard"] for r in requests.select("guard").distinct().collect()}
    if unknown := sorted(g for g in named if g is not None and g not in guards):
        raise ValueError(f"unknown guards {unknown}")
    if requests.where("k < 1 or k is null").limit(1).count():
        raise ValueError("k must be >= 1")
    out = None
    for g in sorted(named, key=lambda x: (x is not None, x)):
        own = requests.where(F.col("guard").eqNullSafe(F.lit(g)))
        view = corpus if g is None else corpus.where(guards[g])
        asks = own.agg(F.max("k").alias("k"), F.min(F.coalesce("threshold", F.lit(-math.inf))).alias("t")).first()
        hits = search_table(view.select("doc_id", "vec"), own.select("query_id", "vec"), dims, int(asks["k"]), float(asks["t"]), metric)
        limits = own.select("query_id", F.col("k").alias("_k"), F.coalesce("threshold", F.lit(-math.inf)).alias("_t"))
        part = hits.join(limits, "query_id").where((F.col("rank") <= F.col("_k")) & (F.col("score") >= F.col("_t"))).drop("_k", "_t")
        out = part if out is None else out.unionByName(part)
    if out is None:
        schema = T.StructType([*_result_schema(requests.schema["query_id"].dataType, corpus.schema["doc_id"].dataType),
                               T.StructField("rank", T.IntegerType())])
        return corpus.sparkSession.createDataFrame([], schema)
    return out.select("query_id", "doc_id", "score", "rank")


def score_table(corpus: DataFrame, probes: DataFrame, dims: int, threshold: float | None = None, metric: str = "dot",
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every (query_id, doc_id, score) from the threshold on: no k, no rank, and no state in the tasks."""
    if metric not in K.METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {K.METRICS}")
    floor = -math.inf if threshold is None else float(threshold)
    return _slices(corpus, probes, probes.count(), _fitting(corpus, dims, broadcast_bytes), None, floor, dims, metric)


def _fitting(corpus: DataFrame, dims: int, broadcast_bytes: int) -> int:
    """Rows that fit a broadcast, as wide as they are multiplied."""
    binary = isinstance(corpus.schema["vec"].dataType, T.BinaryType)
    return max(1, broadcast_bytes // (dims * (4 if binary else 8) + ID_BYTES))


def _slices(corpus, probes, asked: int, limit: int, k: int | None, floor: float, dims: int, metric: str) -> DataFrame:
    query_type, doc_type = probes.schema["query_id"].dataType, corpus.schema["doc_id"].dataType
    binary = isinstance(probes.schema["vec"].dataType, T.BinaryType)

    def scan(rows):
        matrix = np.stack([np.frombuffer(r["vec"], np.int8) if binary else np.asarray(r["vec"], np.float64) for r in rows])
        return _scan(corpus, [], query_type, [r["query_id"] for r in rows], matrix, None if k is None else [k] * len(rows),
                     [floor] * len(rows), [0] * len(rows), dims, metric)

    if not asked:
        return corpus.sparkSession.createDataFrame([], _result_schema(query_type, doc_type))
    if asked <= limit:
        return scan(probes.select("query_id", "vec").collect())
    return _grid(corpus, probes, dims, k, floor, metric, (-(-corpus.count() // limit), -(-asked // limit)))


def _first_columns(metric: str, asks: np.ndarray, known: np.ndarray, take: int, binary: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ``take`` best columns of each row's scores and those scores, best first and ties in column order, without sorting all
    columns.  Inner products of ternary vectors are ranked as they come."""
    plain = binary and metric in ("dot", "raw_dot")
    scores = asks.astype(np.float32) @ known.T if plain else K.score_block(metric, asks, known)
    size = asks.shape[1] if plain and metric == "dot" else 1
    if take <= FEW:
        rows, order, best = np.arange(len(scores)), np.empty((len(scores), take), np.int64), np.empty((len(scores), take), scores.dtype)
        for t in range(take):
            order[:, t] = scores.argmax(axis=1)
            best[:, t] = scores[rows, order[:, t]]
            scores[rows, order[:, t]] = -np.inf
        return order, best.astype(np.float64) / size
    last = scores.shape[1] - take
    least = np.partition(scores, last, axis=1)[:, last]
    at, to = np.nonzero(scores >= least[:, None])
    by = np.lexsort((to, -scores[at, to], at))
    at, to = at[by], to[by]
    kept = np.arange(len(at)) - np.searchsorted(at, at) < take
    order = to[kept].reshape(len(scores), take)
    return order, np.take_along_axis(scores, order, axis=1).astype(np.float64) / size


def _scan_probes(docs, doc_type, probes, dims, k, floor, metric, exclude_self) -> DataFrame:
    """Many probes against a small corpus: the corpus is broadcast and every probe row is ranked
    where it lies, without a shuffle."""
    binary = isinstance(probes.schema["vec"].dataType, T.BinaryType)
    docs = sorted(docs, key=lambda r: r["doc_id"])
    matrix = np.stack([np.frombuffer(r["vec"], np.int8) if binary else np.asarray(r["vec"], np.float64) for r in docs])
    shared = probes.sparkSession.sparkContext.broadcast(([r["doc_id"] for r in docs], matrix))
    wide = isinstance(probes.schema["vec"].dataType, T.BinaryType)
    query_type = probes.schema["query_id"].dataType
    a_doc, a_query = _arrow(doc_type), _arrow(query_type)

    def run(batches):
        names, known = shared.value
        known = K.widened(known, wide)
        take = min(len(names), k + 1 if exclude_self else k)
        step = max(1, min(K.rows_per_block(dims), K.BLOCK_BYTES // (8 * len(names))))
        for whole in batches:
            for s in range(0, whole.num_rows, step):
                b = whole.slice(s, step)
                order, best = _first_columns(metric, _vectors(b.column("vec"), dims), known, take, wide)
                rows, ranks = np.divmod(np.arange(order.size), take)
                order, best = order.ravel(), best.ravel()
                keep = best >= floor
                yield pa.RecordBatch.from_arrays(
                    [b.column("query_id").take(pa.array(rows[keep])),
                     pa.array([names[j] for j in order[keep]], a_doc),
                     pa.array(best[keep], pa.float64()), pa.array((ranks[keep] + 1).astype(np.int32))],
                    names=["query_id", "doc_id", "score", "rank"])

    schema = T.StructType([*_result_schema(query_type, doc_type), T.StructField("rank", T.IntegerType())])
    out = probes.select("query_id", "vec").mapInArrow(run, schema)
    if exclude_self:
        out = _rank(out.where(F.col("query_id") != F.col("doc_id")).drop("rank"), F.lit(k))
    return out


def _grid(corpus, probes, dims, k, floor, metric, cells) -> DataFrame:
    """Every (corpus slice, probe slice) cell is one cogroup of bounded size."""
    rows, cols = cells
    doc_type, query_type = corpus.schema["doc_id"].dataType, probes.schema["query_id"].dataType
    left = (corpus.select("doc_id", "vec",
                          F.pmod(F.xxhash64("doc_id", "vec"), F.lit(rows)).cast("int").alias("row"))
            .withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))))
    right = (probes.select("query_id", "vec",
                           F.pmod(F.xxhash64("query_id", "vec"), F.lit(cols)).cast("int").alias("col"))
             .withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))))
    a_doc, a_query = _arrow(doc_type), _arrow(query_type)
    schema = _result_schema(query_type, doc_type)
    a_schema = pa.schema([("query_id", a_query), ("doc_id", a_doc), ("score", pa.float64())])
    wide = isinstance(corpus.schema["vec"].dataType, T.BinaryType)

    def run(docs: pa.Table, asks: pa.Table) -> pa.Table:
        n = asks.num_rows
        if not n or not docs.num_rows:
            return a_schema.empty_table()
        query_ids = asks.column("query_id").to_pylist()
        probes_ = K.widened(_vectors(asks.column("vec").combine_chunks(), dims), wide)
        best = None if k is None else _Best(np.full(n, k), np.full(n, floor))
        step, out = max(1, min(K.rows_per_block(dims), K.BLOCK_BYTES // (8 * n))), []
        for s in range(0, docs.num_rows, step):
            b = docs.slice(s, step)
            scores = K.score_block(metric, _vectors(b.column("vec").combine_chunks(), dims), probes_)
            if best is not None:
                best.offer(scores, _ids(b.column("doc_id")))
                continue
            at, found = np.nonzero(scores >= floor)                     # no k: every score from the floor on
            out.append(pa.RecordBatch.from_arrays([pa.array([query_ids[i] for i in found], a_query), b.column("doc_id").combine_chunks().take(pa.array(at)),
                                                   pa.array(scores[at, found], pa.float64())], schema=a_schema))
        if best is not None:
            out = list(_emit(best, query_ids, a_doc, a_query))
        return pa.Table.from_batches(out, a_schema) if out else a_schema.empty_table()

    return (left.groupBy("row", "col").cogroup(right.groupBy("row", "col"))
            .applyInArrow(run, schema))


def top_k(scored: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """Single-probe ranking of an already scored table (doc_id, score)."""
    kept = scored if threshold is None else scored.where(F.col("score") >= threshold)
    return kept.orderBy(F.desc("score"), "doc_id").limit(k)


def noise_threshold(dims: int, z: float = 3.0, pair_density: float = 4.0 / 9.0) -> float:
    """Score an unrelated pair exceeds only with the tail probability of ``z`` standard
    deviations: ``z * pair_density / sqrt(dims)``."""
    return z * pair_density / math.sqrt(dims)


# ---- approximate search --------------------------------------------------------------------

def band_keys(vec: Column, dims: int, bands: int, width: int) -> Column:
    """``ARRAY<STRUCT<band, key>>``: band b hashes the bytes of ``width`` fixed dimensions."""
    stride = dims // bands
    if width > stride:
        raise ValueError("bands overlap: lower width or bands")
    return F.array(*[
        F.struct(F.lit(b).alias("band"), F.xxhash64(F.substring(vec, b * stride + 1, width)).alias("key"))
        for b in range(bands)])


def approximate_search(corpus: DataFrame, probes: DataFrame, dims: int, k: int = 10, bands: int = 32,
                       width: int = 4, threshold: float = 0.0) -> DataFrame:
    """Candidates share at least one band of ``width`` trits, then are scored exactly.

    Of documents with one and the same vector only the first k by id can be in a top k, so the
    rest are dropped before anything is paired (exact, and a mass of copies cannot fill a
    bucket).  Band keys are shuffled without vectors; a bucket is joined with probes only,
    never with itself, and vectors join back per distinct candidate pair.  Choose ``width`` so
    that ``3**width`` is well above the number of documents a probe may be compared with.
    """
    from ternweave.operators.algebra import dot
    copies = Window.partitionBy("vec").orderBy("doc_id")
    corpus = (corpus.select("doc_id", "vec", F.row_number().over(copies).alias("_n"))
              .where(F.col("_n") <= k).drop("_n"))
    left = corpus.select("doc_id", F.explode(band_keys(F.col("vec"), dims, bands, width)).alias("b"))
    right = probes.select("query_id", F.explode(band_keys(F.col("vec"), dims, bands, width)).alias("b"))
    pairs = left.join(right, "b").select("query_id", "doc_id").distinct()
    scored = (pairs.join(corpus.select("doc_id", F.col("vec").alias("dv")), "doc_id")
              .join(probes.select("query_id", F.col("vec").alias("qv")), "query_id")
              .select("query_id", "doc_id", (dot("dv", "qv", dims) / F.lit(dims)).alias("score"))
              .where(F.col("score") >= threshold))
    return _rank(scored, F.lit(k))


def compare_results(a: DataFrame, b: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Agreement of two result tables per query: hits on each side, shared hits, recall of ``b``
    against ``a``, and the largest score difference."""
    j = (a.select("query_id", "doc_id", F.col("score").alias("sa"))
         .join(b.select("query_id", "doc_id", F.col("score").alias("sb")), ["query_id", "doc_id"], "full_outer"))
    both = F.col("sa").isNotNull() & F.col("sb").isNotNull()
    diff = F.abs(F.col("sa") - F.col("sb"))
    out = j.groupBy("query_id").agg(
        F.count("sa").alias("hits_a"), F.count("sb").alias("hits_b"),
        F.sum(both.cast("int")).alias("shared"), F.max(diff).alias("max_diff"))
    return (out.withColumn("recall", F.when(F.col("hits_a") > 0, F.col("shared") / F.col("hits_a")).otherwise(1.0))
            .withColumn("consistent", (F.col("shared") == F.col("hits_a")) & (F.col("hits_a") == F.col("hits_b"))
                        & (F.coalesce("max_diff", F.lit(0.0)) <= tolerance)))


def page(results: DataFrame, size: int, after: tuple | None = None, columns=None) -> DataFrame:
    """Keyset pagination by (score desc, doc_id): ``after`` is the last (score, doc_id) seen."""
    kept = results
    if after is not None:
        score, doc_id = after
        kept = kept.where((F.col("score") < score) | ((F.col("score") == score) & (F.col("doc_id") > doc_id)))
    kept = kept.orderBy(F.desc("score"), "doc_id").limit(size)
    return kept.select(*columns) if columns else kept


def cleanup(noisy: DataFrame, codebook: DataFrame, dims: int, key: str = "doc_id") -> DataFrame:
    """Nearest known pattern of each noisy vector: (key, name, score)."""
    hits = search_table(codebook.select(F.col("name").alias("doc_id"), "vec"),
                        noisy.select(F.col(key).alias("query_id"), "vec"), dims, k=1, threshold=None)
    return hits.select(F.col("query_id").alias(key), F.col("doc_id").alias("name"), "score")
