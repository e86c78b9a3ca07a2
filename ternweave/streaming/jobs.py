"""Structured Streaming versions of ingest, profiles and standing probes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ternweave.functions import kernels as K
from ternweave.operators import algebra as A
from ternweave.operators.search import BROADCAST_BYTES, _arrow, _ids, _result_schema


def stream_table(spark, folder: str, file: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """File stream over the files of a folder whose name matches ``file``."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", file)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def instant(column: str) -> Column:
    """Timestamp of a zone-less column read as UTC, whatever the session's time zone."""
    seconds = f"cast(cast({column} - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20,6))"
    return F.expr(f"timestamp_micros(cast({seconds} * 1000000 as bigint))")


def write_append(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to Parquet with a checkpoint; ``once`` processes what is there and stops."""
    w = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start(path)


def deduplicate(df: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Idempotent ingest: one row per key, with state bounded by the watermark."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def windowed_sums(df: DataFrame, window: Column, keys: list[str], vec: Column, dims: int) -> DataFrame:
    """Sums of vectors per event-time window and key, in blocks: (window, keys..., block, s0..s63).

    ``df`` carries its watermark; ``window`` is ``F.window(...)`` or ``F.session_window(...)``.
    State per window and key is ``dims`` integers, combined on the map side first.
    """
    n = A.SLOTS
    blocks = df.withColumn("_a", A.to_array(vec, dims)).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(dims // n - 1))))
    part = blocks.withColumn("_p", F.slice("_a", F.col("block") * n + 1, n))
    return part.groupBy(window.alias("window"), *keys, "block").agg(
        *[F.sum(F.get("_p", F.lit(i))).alias(f"s{i}") for i in range(n)])


def profiles_from_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Signed profile vectors (keys..., vec) from the written block sums."""
    digits = F.concat(*[A._sign_hex(F.col(f"s{i}")) for i in range(A.SLOTS)])
    texts = sums.select(*keys, "block", digits.alias("digits"))
    joined = texts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "digits"))).alias("parts"))
    return joined.select(*keys, F.unhex(F.array_join(F.transform("parts", lambda p: p["digits"]), "")).alias("vec"))


def running_sums(df: DataFrame, keys: list[str], vec: str, dims: int) -> DataFrame:
    """Sums per key without a window, for ``outputMode("update")``.  Each batch is summed inside
    its tasks before it meets the state, so a hot key costs one row per task and block."""
    partial = A._partial_sums(df, keys, vec, dims, None, lambda m: m)
    return partial.groupBy(*keys, "block").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(A.SLOTS)])


def write_updates(sums: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the changed rows of every batch under ``batch=<id>``.  The folder of a batch is
    overwritten, so a batch that is retried does not count twice."""
    def save(batch: DataFrame, epoch: int):
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")
    w = sums.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (w.trigger(availableNow=True) if once else w).start()


def latest_sums(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row per key and block of :func:`write_updates` output."""
    slots = [f"s{i}" for i in range(A.SLOTS)]
    last = updates.groupBy(*keys, "block").agg(F.max_by(F.struct(*slots), F.col("batch")).alias("r"))
    return last.select(*keys, "block", *[F.col("r")[s].alias(s) for s in slots])


def match_probes(docs: DataFrame, probes: DataFrame, dims: int, threshold: float, guard: Column | None = None) -> DataFrame:
    """Standing probes: every (query_id, doc_id, score) at or above the threshold, for a stream or
    a batch of (doc_id, vec).  The static probe table (query_id, vec) is measured and broadcast;
    a larger one is an error, since a stream cannot be re-read per probe slice."""
    limit = max(1, BROADCAST_BYTES // dims)
    rows = probes.select("query_id", "vec").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} standing probes: split them over several streams")
    spark = docs.sparkSession
    matrix = (np.stack([np.frombuffer(r["vec"], np.int8) for r in rows]) if rows else np.zeros((0, dims), np.int8))
    shared = spark.sparkContext.broadcast(([r["query_id"] for r in rows], matrix))
    doc_type, query_type = docs.schema["doc_id"].dataType, probes.schema["query_id"].dataType
    a_doc, a_query = _arrow(doc_type), _arrow(query_type)

    def run(batches):
        names, known = shared.value
        step = max(1, min(K.rows_per_block(dims), K.BLOCK_BYTES // (8 * max(1, len(names)))))
        for whole in batches:
            for s in range(0, whole.num_rows, step):
                b = whole.slice(s, step)
                scores = K.score_block("dot", K.to_matrix(b.column("vec"), dims), known)
                docs_, hits = np.nonzero(scores >= threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[j] for j in hits], a_query), pa.array(_ids(b.column("doc_id"))[docs_].tolist(), a_doc),
                     pa.array(scores[docs_, hits], pa.float64())], names=["query_id", "doc_id", "score"])

    kept = docs if guard is None else docs.where(guard)
    return kept.select("doc_id", "vec").mapInArrow(run, _result_schema(query_type, doc_type))


def apply_changes(changes: DataFrame, store, checkpoint: str, order: str = "ts", once: bool = True) -> StreamingQuery:
    """Upserts and deletes: ``changes(doc_id, op, doc, <order>)`` with op ``upsert`` or ``delete``,
    applied to a :class:`DocumentStore`, last change per document first reduced within the batch.

    The time of the newest change of a document is kept beside the store, a folder per batch, so
    an older change in a later batch has no effect, whether the newer one was an upsert or a delete.
    Replaying a batch gives the same store."""
    seen = f"{store.path}/applied/{store.collection}"

    def save(batch: DataFrame, epoch: int):
        spark = batch.sparkSession
        last = batch.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max_by(F.struct("op", "doc", F.col(order).alias("at")), F.col(order)).alias("r")).select(
            "doc_id", "r.op", "r.doc", "r.at")
        if store._exists(seen):
            known = (spark.read.option("basePath", seen).parquet(seen).where(F.col("epoch") < epoch)
                     .join(last.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("at").alias("newest")))
            last = last.join(known, "doc_id", "left").where("newest is null or at >= newest").drop("newest")
        last = last.persist()
        try:
            last.select("doc_id", "at").write.mode("overwrite").parquet(f"{seen}/epoch={epoch}")
            gone, new = last.where("op = 'delete'"), last.where("op = 'upsert'")
            if not gone.isEmpty():
                store.delete(gone)
            if not new.isEmpty():
                store.upsert(new)
        finally:
            last.unpersist()
    w = changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (w.trigger(availableNow=True) if once else w).start()


SUM_SCHEMA = T.StructType([T.StructField("block", T.IntegerType())] + [
    T.StructField(f"s{i}", T.LongType()) for i in range(A.SLOTS)])
