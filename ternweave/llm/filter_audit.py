"""Filter interaction audit: what every order of the text filters removes, from additive counts of filter masks."""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternweave.llm.common import attach, bit_set, slices, store, store_counted

#: Bit of each filter in a mask.
FILTERS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
ALL = sum(FILTERS.values())
CAPITAL, MARK, FOLLOWS = 1, 2, 3
#: What a byte of UTF-8 is to the filters: a capital A-Z, one of the marks of filter D, or a later byte of a code point.
KIND = np.zeros(256, np.uint8)
KIND[65:91], KIND[list(b"#$%&*|")], KIND[128:192] = CAPITAL, MARK, FOLLOWS
#: Counters of the Bloom sketch: per row, in all at most (32 MB once they are bits), in a segment, and per digest.
COUNTERS_PER_ROW, MAX_COUNTERS, SEGMENT, PROBES = 16, 2 ** 28, 2 ** 15, 3
#: Partial sketches of a segment are merged in so many groups first.
FANS = 64


def text_masks(texts: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails.

    Words are counted text by text; capitals, code points and marks in the bytes of all texts at once."""
    raw = texts.cast(pa.large_binary())
    edge = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[edge[0]:edge[-1]]
    at = edge - edge[0]

    def count(kind: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(KIND[data] == kind, dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]]

    held = memoryview(data)
    n, distinct = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    for i in range(len(raw)):
        words = bytes(held[at[i]:at[i + 1]]).split()                  # at exactly the six ASCII white-space characters
        n[i], distinct[i] = len(words), len(set(words))
    chars = np.diff(at) - count(FOLLOWS)
    return ((n < 50) * FILTERS["A"] + (100 * distinct < 65 * n) * FILTERS["B"]
            + (100 * count(CAPITAL) > 5 * chars) * FILTERS["C"] + (count(MARK) > 0) * FILTERS["D"]).astype(np.int32)


def with_masks(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, part, text, digest)`` with the filter mask in place of the text."""
    def compute(batches):
        for batch in slices(batches):
            mask = text_masks(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "part")] + [pa.array(mask), batch.column("digest")],
                                             names=["doc_id", "part", "mask", "digest"])
    return rows.mapInArrow(compute, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary")


def cells(digest: str, segments: int) -> tuple[Column, list[Column]]:
    """Segment of a digest, and its counters there."""
    seed = F.xxhash64(F.col(digest), F.lit(7))
    return (F.pmod(F.xxhash64(F.col(digest)), F.lit(segments)).cast("int"),
            [F.pmod(F.shiftright(seed, 15 * i), F.lit(SEGMENT)).cast("int") for i in range(PROBES)])


def counting_sketch(rows: DataFrame, digest: str, segments: int) -> DataFrame:
    """(bucket, bitmap): counters of the counting Bloom sketch that more than one row has raised.

    Every task counts the rows it has; of a segment it sends the counters that aren't zero.  Counters stop
    at two, and a digest raises each of its counters once per row, so a digest of a third of all rows adds a few bytes per task.
    The sketches are added in two steps, so no task meets those of all tasks."""
    def count(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            where = batch.column("segment").to_numpy()
            at = np.stack([batch.column(f"c{i}").to_numpy() for i in range(PROBES)], 1)
            at.sort(axis=1)
            new = np.ones(at.shape, bool)
            new[:, 1:] = at[:, 1:] != at[:, :-1]                       # one count per row and counter
            key, times = np.unique((where[:, None].astype(np.int64) * SEGMENT + at)[new], return_counts=True)
            edge = np.flatnonzero(np.diff(key // SEGMENT, prepend=-1))
            for part, n in zip(np.split(key, edge[1:]), np.split(times, edge[1:]), strict=True):
                if len(part):
                    mine = held.setdefault(int(part[0] // SEGMENT), np.zeros(SEGMENT, np.uint8))
                    mine[part % SEGMENT] = np.minimum(mine[part % SEGMENT] + np.minimum(n, 2), 2)
            if len(held) >= 1024:                                        # 32 MB of counters at a time
                yield packed(held)
                held.clear()
        if held:
            yield packed(held)

    def packed(held) -> pa.RecordBatch:
        one = [np.flatnonzero(v == 1).astype("<u2").tobytes() for v in held.values()]
        two = [np.flatnonzero(v == 2).astype("<u2").tobytes() for v in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(one, pa.binary()), pa.array(two, pa.binary())],
                                          names=["bucket", "one", "two"])

    def added(table: pa.Table) -> np.ndarray:
        total = np.zeros(SEGMENT, np.int64)
        for name, n in (("one", 1), ("two", 2)):
            for chunk in table.column(name).to_pylist():
                total[np.frombuffer(chunk, "<u2")] += n
        return total

    def merge(table: pa.Table) -> pa.Table:
        total = np.minimum(added(table), 2).astype(np.uint8)
        return pa.Table.from_batches([packed({table.column("bucket")[0].as_py(): total})])

    def finish(table: pa.Table) -> pa.Table:
        bits = np.packbits(added(table) > 1, bitorder="little").tobytes()
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "bitmap": pa.array([bits], pa.binary())})

    segment, at = cells(digest, segments)
    kind = "bucket int, one binary, two binary"
    own = rows.select(segment.alias("segment"), *[c.alias(f"c{i}") for i, c in enumerate(at)]).mapInArrow(count, kind)
    fan = F.pmod(F.spark_partition_id(), F.lit(FANS)).alias("fan")
    return (own.select("*", fan).groupBy("bucket", "fan").applyInArrow(merge, kind)
            .groupBy("bucket").applyInArrow(finish, "bucket int, bitmap binary"))


def may_repeat(rows: DataFrame, digest: str, sketch: DataFrame, segments: int) -> DataFrame:
    """Rows whose digest isn't known to be unique: all its counters were raised by more than one row."""
    segment, at = cells(digest, segments)
    held = rows.withColumn("_audit_bucket", segment).join(
        F.broadcast(sketch.select(F.col("bucket").alias("_audit_bucket"), F.col("bitmap").alias("_audit_bits"))), "_audit_bucket")
    hit = bit_set(F.col("_audit_bits"), at[0])
    for c in at[1:]:
        hit = hit & bit_set(F.col("_audit_bits"), c)
    return held.where(hit).drop("_audit_bucket", "_audit_bits")


def first_of_equal(docs: DataFrame, sketch: DataFrame, segments: int) -> DataFrame:
    """(digest, first, size) of the texts of ``docs(doc_id, text, digest)`` that several rows have: the smallest id and the
    number of rows.  Texts are grouped as a whole, after the sketch has let go of those that are unique; copies are
    combined in every task first."""
    return (may_repeat(docs, "digest", sketch, segments).groupBy("text", "digest")
            .agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("text"))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                max_counters: int = MAX_COUNTERS) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part that fail exactly the filters of the mask; how many of them
    are labelled quality 1 and toxic 1.

    The counts are additive: a row counts under the mask of its text, and a row whose text a smaller
    id has as well is then moved to the same mask with E.  A null id is larger than all others, and of rows
    that share text and id none is a repetition of the other.  Of several labels of an id, one of value 1 is enough."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"),
                      F.unhex(F.sha2(text, 256)).alias("digest"))
    rows, seen = store_counted(with_masks(own), "audit-rows")
    segments = 1
    while segments * SEGMENT < min(max_counters, COUNTERS_PER_ROW * seen["n"]):
        segments *= 2
    sketch = store(counting_sketch(rows, "digest", segments), "audit-sketch")
    firsts = store(first_of_equal(own.select("doc_id", "text", "digest"), sketch, segments), "audit-firsts")
    again = (attach(may_repeat(rows, "digest", sketch, segments), firsts, "digest", "size", seen["n"])
             .where("doc_id > first or (doc_id is null and first is not null)"))
    moves = F.explode(F.array(F.struct(F.col("mask"), F.lit(-1).alias("n")),
                              F.struct((F.col("mask") + FILTERS["E"]).alias("mask"), F.lit(1).alias("n"))))
    each = (rows.select("doc_id", "part", "mask", F.lit(1).alias("n"))
            .unionByName(again.select("doc_id", "part", moves.alias("m")).select("doc_id", "part", "m.mask", "m.n"))
            .groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).where("n <> 0"))
    known = (labels.where("doc_id is not null").groupBy("doc_id")
             .agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
                  F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")))
    n = F.col("n")
    return (each.join(known, "doc_id", "left").groupBy("part", "mask")
            .agg(F.sum(n).alias("n"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"),
                 F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic")))


def _steps() -> str:
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            out.append({"o": "".join(order), "s": step, "b": before, "f": FILTERS[f]})
            before |= FILTERS[f]
    return json.dumps(out)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                 max_counters: int = MAX_COUNTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every
    part, each of the 120 orders of the five filters and each step.

    ``pass[S]``, the number of rows that no filter of the set S removes, is a sum of mask counts; all columns are
    differences of it, so the orders are never run.  Null texts are empty, null sources are the part ``''``, repeated rows
    count as often as they stand; other columns are ignored and an empty table gives no rows."""
    counts = mask_counts(docs, labels, id_col, text_col, part_col, max_counters)
    passing = (counts.select("part", F.explode(F.filter(F.sequence(F.lit(0), F.lit(ALL)), lambda s: s.bitwiseAND(F.col("mask")) == 0)).alias("set"),
                             "n", "good", "toxic")
               .groupBy("part", "set").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
               .groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("set", F.struct("n", "good", "toxic")))).alias("pass")))

    def every_set(what: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(ALL)), lambda i: F.coalesce(F.col("pass")[i][what], F.lit(0).cast("long"))).alias(what)

    steps = F.from_json(F.lit(_steps()), "array<struct<o:string,s:int,b:int,f:int>>")
    row = (passing.select("part", *map(every_set, ("n", "good", "toxic")))
           .select("part", "n", "good", "toxic", F.explode(steps).alias("e")).select("part", "n", "good", "toxic", "e.*"))
    b, f = F.col("b"), F.col("f")
    after = b.bitwiseOR(f)

    def left(of: Column, what: str = "n") -> Column:
        return F.col(what)[of]

    removed = left(b) - left(after)
    weight = F.array(*[F.lit(factorial(s.bit_count()) * factorial(max(4 - s.bit_count(), 0))).cast("long") for s in range(ALL + 1)])
    value = F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(ALL)), lambda s: s.bitwiseAND(f) == 0), F.lit(0).cast("long"),
                        lambda total, s: total + weight[s] * (left(s) - left(s.bitwiseOR(f))))
    return row.select("part", F.col("o").alias("filter_order"), F.col("s").alias("step"), left(after).alias("kept"), removed.alias("removed"),
                      (left(F.lit(0)) - left(f) - removed).alias("redundant"),
                      (left(F.lit(ALL) - f) - left(F.lit(ALL))).alias("unique_fails"),
                      (left(b, "good") - left(after, "good")).alias("good_lost"),
                      (left(b, "toxic") - left(after, "toxic")).alias("toxic_lost"), value.alias("shapley"))
