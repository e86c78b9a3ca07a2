"""What the text operators share: stored intermediate tables, words and joins that survive hot keys."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ternweave.functions.session import checkpoint_dir

WORD = re.compile(r"\w+")
#: A key with at least 1 / HOT_SHARE of all rows is hot; there are at most HOT_SHARE of them.
HOT_SHARE = 1000
#: Links that one task joins at a time, and at most in all where components are finished without further rounds.
LINKS = 2 ** 18


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_counted(df: DataFrame, name: str, **more: Column) -> tuple[DataFrame, dict]:
    """:func:`store`, and the number of rows (``n``) and further aggregates, observed while writing."""
    seen = Observation()
    out = store(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()]), name)
    return out, {"n": 0} | seen.get


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`store` that are no longer read."""
    for df in tables:
        spark = df.sparkSession
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


_KEPT: dict[str, dict] = {}


def kept_by(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task.  Workers outlive a stage, so
    everything that other operators have kept is forgotten, and memory that no longer holds anything goes back to the system."""
    for other in [k for k in _KEPT if k != owner]:
        del _KEPT[other]
    give_back()
    return _KEPT.setdefault(owner, {})


def give_back() -> None:
    """Return unused memory of a Python worker, which would otherwise stay as large as its largest task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):                        # not glibc
        pass


def fresh(rows: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``rows`` has."""
    have = {c.lower() for c in rows.columns}
    while name.lower() in have:
        name += "_"
    return name


def slices(batches, rows: int = 1000) -> Iterator:
    """The batches in slices of at most ``rows`` rows, so that few texts are Python strings at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


class Cache(dict):
    """``fn`` of a key, remembered for at most ``limit`` keys."""

    def __init__(self, fn, limit: int = 400_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def word_hashes() -> Cache:
    """64-bit hashes of words; equal in every process."""
    return Cache(xxhash.xxh3_64_intdigest)


def portions(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs [a, b) of about ``most`` units; a larger row is a run of its own."""
    a = i = total = 0
    for n in sizes:
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
        i += 1
    if a < i:
        yield a, i


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def crc_of(doc_id: Column | str) -> Column:
    """crc32 of an id written as text."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary"))


def attach(rows: DataFrame, lookup: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``lookup``, which has one row per key and in ``size`` the number of
    its rows.  Keys with at least ``total / HOT_SHARE`` rows, at most HOT_SHARE of them, are
    broadcast, so that their rows stay where they are; the others are joined by a shuffle."""
    least = max(2, total // HOT_SHARE)
    hot = F.broadcast(lookup.where(F.col(size) >= least))
    cold = lookup.where(F.col(size) < least)
    return (rows.join(hot, key).unionByName(
        rows.join(F.broadcast(lookup.where(F.col(size) >= least).select(key)), key, "left_anti").join(cold, key)))


def join_skewed(rows: DataFrame, lookup: DataFrame, key: str, spread: str, total: int, how: str = "inner",
                counted: DataFrame | None = None) -> DataFrame:
    """Join of ``rows`` (``total`` of them) to ``lookup``, which has one row per key, without gathering a hot key.

    Keys with at least one HOT_SHARE-th of the rows (there are at most HOT_SHARE) are split by a hash of
    the column ``spread``; their lookup rows are repeated once per part, at most 2 * HOT_SHARE in all.
    ``counted`` has the same keys as ``rows`` where counting those would repeat work."""
    least = max(50, total // HOT_SHARE)
    hot = ((rows if counted is None else counted).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") >= least).select(key, F.ceil(F.col("_n") / least).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = (rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts"))
    right = (lookup.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts"))
    return left.join(right, [key, "_part"], how).drop("_part")


def id_filter(ids: DataFrame, name: str, rows: int, max_bits: int = 2 ** 27) -> tuple[DataFrame, int]:
    """A Bloom filter of one hash over ids, as (bucket, bitmap); of ``max_bits`` at most."""
    bits = 2 ** 15
    while bits < min(max_bits, 16 * rows):
        bits *= 2
    cell = ids.select(F.pmod(F.xxhash64(name), F.lit(bits)).alias("cell"))
    return cell.groupBy(F.shiftright("cell", 15).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("cell").bitwiseAND(2 ** 15 - 1)).alias("bitmap")), bits


def bit_set(bitmap: Column, cell: Column) -> Column:
    """Whether the bit of a cell is set in the bitmap of its bucket; false for a null bitmap."""
    place = cell.bitwiseAND(2 ** 15 - 1).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte.cast("long"), place.bitwiseAND(7)) == 1, F.lit(False))


def may_be_in(rows: DataFrame, name: str, filter_: DataFrame, bits: int) -> DataFrame:
    """Rows whose id may be in an :func:`id_filter`: all that are, and few others."""
    rows_, maybe = marked(rows, name, filter_, bits)
    return rows_.where(F.col(maybe)).select(*rows.columns)


def marked(rows: DataFrame, name: str, filter_: DataFrame, bits: int) -> tuple[DataFrame, str]:
    """``rows`` and a further column, named in the result, that says whether their id may be in the filter."""
    cell = F.pmod(F.xxhash64(name), F.lit(bits))
    bucket, bitmap, maybe = (fresh(rows, c) for c in ("_bucket", "_bitmap", "_maybe"))
    part = F.broadcast(filter_.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
    return (rows.withColumn(bucket, F.shiftright(cell, 15)).join(part, bucket, "left")
            .withColumn(maybe, F.col(name).isNotNull() & bit_set(F.col(bitmap), cell))), maybe


def stars(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(node, the smallest node that the links u - v connect it with) of all their nodes."""
    held = pa.concat_arrays([u, v]).dictionary_encode()
    order = pc.sort_indices(held.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    a, b = np.split(rank[held.indices.to_numpy()], 2)
    root = np.arange(len(order))
    while True:
        x, y = root[a], root[b]
        on = x != y
        if not on.any():
            return held.dictionary.take(pa.array(order)), held.dictionary.take(pa.array(order[root]))
        a, b, low = a[on], b[on], np.minimum(x[on], y[on])
        np.minimum.at(root, x[on], low)
        np.minimum.at(root, y[on], low)
        while (root[root] != root).any():
            root = root[root]


def contracted(edges: DataFrame, roots: bool = False) -> DataFrame:
    """The edges (u, v) with those that a task holds, LINKS of them at a time, replaced by stars around their smallest nodes.

    Connected nodes stay connected.  With ``roots``, a smallest node is a row as well, linked to itself."""
    def compute(batches):
        held, n = [], 0

        def close():
            table = pa.Table.from_batches(held)
            u, v = stars(*(table.column(c).combine_chunks() for c in ("u", "v")))
            out = pa.RecordBatch.from_arrays([u, v], names=["u", "v"])
            return out if roots else out.filter(pc.not_equal(u, v))

        for batch in batches:
            for part in (batch.slice(i, LINKS) for i in range(0, batch.num_rows, LINKS)):
                if held and n + part.num_rows > LINKS:
                    yield close()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield close()

    kind = edges.schema["u"].dataType.simpleString()
    return edges.select("u", "v").mapInArrow(compute, f"u {kind}, v {kind}")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the edges: the smallest node that it is connected with."""
    return sized_components(edges, a, b)[0]


def sized_components(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, bool]:
    """:func:`components`, and whether they fit a broadcast.

    Tasks first replace the edges they hold by stars.  If LINKS are left at most, they are joined in one more step, and the
    result is small enough for a broadcast.  Otherwise, in each round all neighbours of a node are linked to the smallest of them, until only
    stars are left.  Edges stay in stored tables, one job per round; minima are combined before the shuffle,
    and the neighbours of hot nodes stay where they are."""
    first, seen = store_counted(contracted(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")), "edges")
    if seen["n"] <= LINKS:
        out = store(contracted(first.coalesce(1), roots=True).toDF("node", "root"), "edges")
        discard(first)
        return out, True
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    now, old = store_counted(first.distinct(), "edges", mark=mark)
    discard(first)
    while old["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count(F.lit(1)).alias("size"))
        near = attach(both, least, "u", "size", 2 * old["n"])
        nxt, new = store_counted(near.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
                                 .select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct(), "edges", mark=mark)
        discard(now)
        now = nxt
        if new == old:
            break
        old = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), False


def merged(state: DataFrame, links: DataFrame, nodes: int, name: str) -> DataFrame:
    """``state`` of so many ``nodes``, stored, with the classes in its column ``class`` that the links (ca, cb) connect made one."""
    roots, small = sized_components(links, "ca", "cb")
    roots = roots.withColumnRenamed("node", "class")
    if small:
        both = state.join(F.broadcast(roots), "class", "left")
    else:
        both = attach(state, state.groupBy("class").agg(F.count(F.lit(1)).alias("n")).join(roots, "class", "left"), "class", "n", nodes)
    return store(both.withColumn("class", F.coalesce("root", "class")).select(*state.columns), name)


def without_ids(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` whose id in column ``name`` isn't among ``ids`` (one column, no null).

    A Bloom filter of a bounded size lets most of the other rows pass where they are; only rows that may be
    among the ids are shuffled and compared."""
    own = fresh(rows, "_id")
    ids, seen = store_counted(ids.toDF(own).distinct(), "left-out")
    filter_, bits = id_filter(ids, own, seen["n"])
    rows_, maybe = marked(rows, name, filter_, bits)
    clear, unsure = (rows_.where(c).select(*rows.columns) for c in (~F.col(maybe), F.col(maybe)))
    return clear.unionByName(unsure.join(ids, unsure[name] == ids[own], "left_anti"))
