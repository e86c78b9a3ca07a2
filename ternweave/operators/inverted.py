"""Inverted-file search: a stored table of vectors by nearest centroid, of which a probe reads the nearest cells only."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternweave.functions import kernels as K
from ternweave.operators import search as S

#: Centroids are fitted on at most so many documents and bytes of vectors; there are at most so many cells.
SAMPLE_ROWS, SAMPLE_BYTES, MAX_CELLS = 65_536, 64 << 20, 4096
ROUNDS = 2
#: Directories of an index.
SHELVES = 16
#: Documents and probes of a cell that one task compares at most.
PART_ROWS, CHUNK_PROBES = 32_768, 4096


def cells_for(rows: int) -> int:
    """Cells of an index of so many documents: eight times the square root, within the limit."""
    return max(1, min(MAX_CELLS, rows, math.ceil(8 * math.sqrt(rows))))


def nearness(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """float64[vectors, centroids]: inner product over the centroid's norm."""
    norm = np.sqrt(np.maximum(np.count_nonzero(centroids, axis=1), 1).astype(np.float64))
    return (vectors.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64) / norm


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """int8[cells, dims]: the first vectors of the sample, each moved to the majority bundle of the vectors next to it."""
    centroids = sample[:cells].copy()
    for _ in range(rounds if len(sample) else 0):
        home = np.concatenate([nearness(sample[a:a + 4096], centroids).argmax(axis=1) for a in range(0, len(sample), 4096)])
        order = np.argsort(home, kind="stable")
        starts = np.flatnonzero(np.diff(home[order], prepend=-1))
        centroids[home[order][starts]] = np.sign(np.add.reduceat(sample[order].astype(np.int32), starts, axis=0))
    return centroids


@dataclass(frozen=True)
class InvertedFile:
    """An index at ``path``: ``rows`` (doc_id, vec, cell, part) in SHELVES directories of neighbouring cells, sorted by cell, and ``centroids``."""

    path: str
    dims: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def centroids(self, spark: SparkSession) -> np.ndarray:
        """At most MAX_CELLS vectors."""
        found = spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        return np.stack([np.frombuffer(r.vec, np.int8) for r in found]) if found else np.zeros((0, self.dims), np.int8)


def build(corpus: DataFrame, dims: int, path: str, cells: int | None = None, sample: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> InvertedFile:
    """Write the index of a corpus (doc_id, vec).  Cells are cut into few directories and sorted there, so that a scan for some cells
    skips directories by their names and row groups by their statistics.

    The centroids come from a bounded sample, the first documents in the order of the md5 of their ids; every document is indexed.
    A cell's rows are dealt to as many tasks as its size asks for, so a cell with a third of all rows is no larger task than others."""
    spark = corpus.sparkSession
    corpus = corpus.select("doc_id", "vec")
    some = (corpus.where("vec is not null").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
            .limit(max(1, min(sample, SAMPLE_BYTES // dims))).select("vec").toArrow())
    matrix = K.to_matrix(some.column("vec"), dims)
    known = corpus.count() if cells is None else 0
    centroids = fit_centroids(matrix, min(len(matrix), cells or cells_for(known)), rounds)
    spark.createDataFrame([(i, bytearray(c.tobytes())) for i, c in enumerate(centroids)], "cell int, vec binary").coalesce(1).write.parquet(f"{path}/centroids")
    shared = spark.sparkContext.broadcast(centroids)                     # MAX_CELLS vectors at most

    def place(batches):
        own = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                b = whole.slice(a, 4096)
                cell = nearness(K.to_matrix(b.column("vec"), dims), own).argmax(axis=1).astype(np.int32) if len(own) else np.zeros(b.num_rows, np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("vec"), pa.array(cell)], names=["doc_id", "vec", "cell"])

    kind = corpus.schema["doc_id"].dataType.simpleString()
    placed = corpus.mapInArrow(place, f"doc_id {kind}, vec binary, cell int")
    placed.write.parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    shelf = F.floor(F.col("cell") * SHELVES / max(1, len(centroids))).cast("int").alias("shelf")
    (placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("doc_id", "vec"), "parts").cast("int"))
     .select("doc_id", "vec", "cell", "part", shelf).repartition("shelf", "part").sortWithinPartitions("shelf", "cell")
     .write.partitionBy("shelf").parquet(f"{path}/rows"))
    return InvertedFile(path, dims)


def nearest_cells(index: InvertedFile, probes: DataFrame, near: int) -> DataFrame:
    """(query_id, vec, cell): the ``near`` nearest cells of each probe; the first, of equally near ones."""
    spark, dims = probes.sparkSession, index.dims
    shared = spark.sparkContext.broadcast(index.centroids(spark))

    def pick(batches):
        own = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                b = whole.slice(a, 4096)
                order = np.argsort(-nearness(K.to_matrix(b.column("vec"), dims), own), axis=1, kind="stable")[:, :near].astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vec"), cells], names=["query_id", "vec", "cells"])

    kind = probes.schema["query_id"].dataType.simpleString()
    found = probes.select("query_id", "vec").mapInArrow(pick, f"query_id {kind}, vec binary, cells array<int>")
    return found.select("query_id", "vec", F.explode("cells").alias("cell"))


def candidates(index: InvertedFile, probes: DataFrame, near: int) -> DataFrame:
    """(query_id, candidates): documents that a search scores for each probe."""
    sizes = index.rows(probes.sparkSession).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return (nearest_cells(index, probes, near).join(F.broadcast(sizes), "cell", "left").groupBy("query_id")
            .agg(F.sum(F.coalesce("n", F.lit(0))).alias("candidates")))


def search(index: InvertedFile, probes: DataFrame, k: int = 10, near: int = 8, threshold: float | None = 0.0, metric: str = "dot") -> DataFrame:
    """A probe table (query_id, vec) against the index: (query_id, doc_id, score, rank), exact scores among the
    documents of each probe's ``near`` nearest cells.

    Documents and probes meet cell by cell, in parts of
    bounded size; neither side passes through the driver, and no pairs are formed."""
    if metric not in K.METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {K.METRICS}")
    if k < 1 or near < 1:
        raise ValueError("k and near must be >= 1")
    spark, dims = probes.sparkSession, index.dims
    asked = nearest_cells(index, probes, near)
    rows = index.rows(spark)
    grid = F.broadcast(rows.groupBy("cell").agg(F.max("part").alias("last"))              # a row per cell
                       .join(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK_PROBES).cast("int").alias("chunks")), "cell"))
    docs = rows.join(grid.drop("last"), "cell").select(
        "cell", "part", "doc_id", "vec", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    asks = asked.join(grid, "cell").select("cell", "query_id", "vec", F.pmod(F.xxhash64("query_id", "vec"), "chunks").cast("int").alias("chunk"),
                                           F.explode(F.sequence(F.lit(0), "last")).alias("part"))
    kinds = probes.schema["query_id"].dataType, rows.schema["doc_id"].dataType
    names = pa.schema([("query_id", S._arrow(kinds[0])), ("doc_id", S._arrow(kinds[1])), ("score", pa.float64())])
    floor = -math.inf if threshold is None else float(threshold)

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        n = y.num_rows
        if not n or not x.num_rows:
            return names.empty_table()
        best = S._Best(np.full(n, k), np.full(n, floor))
        wide = K.widened(K.to_matrix(y.column("vec"), dims), True)
        step = max(1, min(K.rows_per_block(dims), K.BLOCK_BYTES // (8 * n)))
        for a in range(0, x.num_rows, step):
            b = x.slice(a, step).combine_chunks()
            best.offer(K.score_block(metric, K.to_matrix(b.column("vec"), dims), wide), S._ids(b.column("doc_id").combine_chunks()))
        out = list(S._emit(best, y.column("query_id").to_pylist(), names.field(1).type, names.field(0).type))
        return pa.Table.from_batches(out, names) if out else names.empty_table()

    keys = ["cell", "part", "chunk"]
    scored = docs.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(compare, S._result_schema(*kinds))
    return S._rank(scored, F.lit(k))


def search_one(spark: SparkSession, index: InvertedFile, vec: bytes, k: int = 10, near: int = 8, **options) -> DataFrame:
    """One probe: (doc_id, score, rank).  The scan is pruned to the directories and row groups of its nearest cells."""
    centroids = index.centroids(spark)
    cells = np.argsort(-nearness(np.frombuffer(vec, np.int8)[None], centroids)[0], kind="stable")[:near].tolist()
    shelves = sorted({c * SHELVES // len(centroids) for c in cells})
    return S.search_by_vector(index.rows(spark).where(F.col("shelf").isin(shelves) & F.col("cell").isin(cells)), vec, index.dims, k, **options)
