"""Mixing sources to target weights: Pfair schedules of source blocks."""

from __future__ import annotations

import bisect
import heapq
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternweave.llm.common import store

#: Documents of a block, and blocks of a row of the schedule's table.
BLOCK, PERIOD = 64, 1000
MAX_SOURCES = 2000


def shares(weights: dict, period: int) -> dict:
    """Whole numbers of slots per period in proportion to the weights, at least 1, by largest remainders.
    Schedules don't round: see :func:`whole`."""
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) * period / total for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (exact[s] - int(exact[s]), str(s)), reverse=True)
    i = 0
    while sum(slots.values()) < period:
        slots[order[i % len(order)]] += 1
        i += 1
    while (over := sum(slots.values()) - period) > 0:
        largest = max(slots, key=lambda s: (slots[s], str(s)))
        slots[largest] -= min(over, slots[largest] - 1)
    return slots


def whole(weights: dict) -> dict:
    """The weights as the least whole numbers in exactly the same proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * scale) for s, x in exact.items()}
    by = math.gcd(*out.values())
    return {s: x // by for s, x in out.items()}


def pfair(slots: dict, blocks: dict | None = None) -> dict:
    """One period: for each source the slots of its blocks; with ``blocks`` only up to the slot where the first source is used up.

    Block k of a source with q of the period's T slots is released at floor(k T / q) and due at ceil((k + 1) T / q).
    Each slot goes to the released block with the earliest deadline; so after every slot a source has had less
    than one block more or less than its share, and after the period exactly its share."""
    period = sum(slots.values())
    names = sorted(slots, key=str)
    rank = {s: i for i, s in enumerate(names)}
    done = dict.fromkeys(slots, 0)
    heapq.heapify(waiting := [(0, rank[s]) for s in names])
    ready, out = [], {s: [] for s in slots}
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _r, i = heapq.heappop(waiting)
            s = names[i]
            heapq.heappush(ready, (-(-(done[s] + 1) * period // slots[s]), i))
        due, i = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a block is late")
        s = names[i]
        out[s].append(t)
        done[s] += 1
        if blocks is not None and done[s] == blocks[s]:
            break
        if done[s] < slots[s]:
            heapq.heappush(waiting, (done[s] * period // slots[s], i))
    return out


def plan(blocks: dict, weights: dict) -> list[tuple]:
    """Rows (source, first block, last block, first slot, blocks per period, slots of the period, slots per period).

    The sources run at exactly their weights until one is used up; from that slot on the others share its weight in
    proportion, in a new schedule.  There are as many schedules as sources at most, and each is one period, or
    ends before: the slots of all are no more than the blocks."""
    left = {s: n for s, n in blocks.items() if n > 0}
    used = dict.fromkeys(left, 0)
    at, rows = 0, []
    while left:
        share = whole({s: weights[s] for s in left})
        period = sum(share.values())
        table = pfair(share, left)

        def slot(s, k, share=share, table=table, period=period):
            return k // share[s] * period + table[s][k % share[s]]

        over = [s for s, n in left.items() if len(table[s]) == n]
        # the first source is used up here: within the first period, or in a later one
        end = min(table[s][-1] for s in over) + 1 if over else min(slot(s, n - 1) for s, n in left.items()) + 1
        for s in list(left):
            full, part = divmod(end, period)
            n = min(left[s], full * share[s] + bisect.bisect_left(table[s], part))
            if n:
                rows.append((s, used[s], used[s] + n - 1, at, *((n, table[s], 0) if over else (share[s], table[s], period))))
            used[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        at += end
    return rows


def ranked(docs: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, rank): place of each row in its source, in the order of a hash of the id.

    Rows are dealt out by range of (source, hash), so a source of a third of all rows is spread over as many tasks;
    only the number of rows per task and source passes through the driver."""
    rows = store(docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(id_col).alias("doc_id"),
                             F.xxhash64(F.col(id_col)).alias("h"), F.monotonically_increasing_id().alias("row")), "mix-rows")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()

    def number(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            places = []
            for s in batch.column("source").to_pylist():
                places.append(seen.get(s, 0))
                seen[s] = places[-1] + 1
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("source"), pa.array(places, pa.int64())],
                                             names=["part", "doc_id", "source", "place"])

    local = store(rows.repartitionByRange(n, "source", "h", "row").sortWithinPartitions("source", "h", "row")
                  .select(F.spark_partition_id().alias("part"), "doc_id", "source")
                  .mapInArrow(number, f"part int, doc_id {kind}, source string, place long"), "mix-places")
    counts = local.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n")).orderBy("source", "part").collect()
    first, seen = [], {}
    for r in counts:
        first.append((r.source, r.part, seen.get(r.source, 0)))
        seen[r.source] = seen.get(r.source, 0) + r.n
    if len(seen) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    offsets = docs.sparkSession.createDataFrame(first, "source string, part int, before long")
    return (local.join(F.broadcast(offsets), ["source", "part"]).select("doc_id", "source", (F.col("before") + F.col("place")).alias("rank"))), seen


def target_weights(counts: dict, exponent: float = 0.5) -> dict:
    """Weights in proportion to a power of the sources' sizes, in millionths; the usual smoothing of a mixture."""
    total = sum(n ** exponent for n in counts.values()) or 1
    return {s: max(1, round(1e6 * n ** exponent / total)) for s, n in counts.items()}


def mixed(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK,
          period: int = PERIOD) -> DataFrame:
    """(doc_id, source, block, slot, place) of every row: the place of its block in the mixture and its own in the block.

    A source's documents, in the order of a hash of their ids, are cut into blocks; sorted by (slot, place) the
    documents of any number of first slots, up to where a source is used up, hold each source to its exact weight with a
    deviation of less than one block.  Every row is placed exactly once: when a
    source is used up, the others go on at their own proportions.  Without ``weights`` a source's weight is the
    square root of its size.  A row of the broadcast schedule holds the slots of at most ``period`` blocks.

    A null source is the source named ''.  A source without a weight is an error.  Repeated and null ids are
    rows like others.  An empty table gives no rows; other columns are not read."""
    rows, counts = ranked(docs, id_col, source_col)
    weights = {("" if s is None else s): w for s, w in weights.items()} if weights is not None else target_weights(counts)
    if missing := sorted(set(counts) - set(weights)):
        raise ValueError(f"sources without a weight: {missing[:5]}")
    if bad := [s for s in counts if weights[s] <= 0]:
        raise ValueError(f"weights must be positive: {bad[:5]}")
    parts = plan({s: -(-n // block) for s, n in counts.items()}, weights)
    spark = docs.sparkSession
    runs = spark.createDataFrame([(i, *r[:5], r[6]) for i, r in enumerate(parts)],
                                 "run int, source string, first long, last long, start long, share long, cycle long")
    schedule = spark.createDataFrame([(i, a // period, r[5][a:a + period]) for i, r in enumerate(parts) for a in range(0, len(r[5]), period)],
                                     "run int, chunk long, slots array<long>")
    b = F.floor(F.col("rank") / block)
    k = F.col("block") - F.col("first")
    slot = F.col("start") + F.floor(k / F.col("share")) * F.col("cycle") + F.col("slots")[F.pmod("turn", F.lit(period)).cast("int")]
    return (rows.withColumn("block", b)
            .join(F.broadcast(runs), "source").where("block between first and last")
            .withColumn("turn", F.pmod(k, F.col("share"))).withColumn("chunk", F.floor(F.col("turn") / period))
            .join(F.broadcast(schedule), ["run", "chunk"])
            .select("doc_id", "source", "block", slot.cast("long").alias("slot"), F.pmod("rank", F.lit(block)).cast("int").alias("place")))
