"""Near duplicates of documents: BagMinHash signatures of word shingles, bands, and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternweave.llm.common import (attach, discard, id_filter, join_skewed, kept_by, may_be_in, merged, mix64, portions, slices,
                                  store, store_counted, word_hashes, words)

SHINGLE, THRESHOLD = 5, 0.8
#: Two documents of similarity 0.8 share one of 40 bands of 6 components but for 5 in a million.
BANDS, ROWS = 40, 6
#: Rounds in which a document is compared with one leader, before what is left is compared in full.
LEADER_ROUNDS = 2
#: Rows of a bucket that are joined pair by pair at most; larger buckets are compared in cells of CELL x CELL rows by
#: sketches of SKETCH components, with a margin of MARGIN standard deviations (a loss of one in a million).
SMALL, CELL, SKETCH, MARGIN = 24, 256, 1200, 4.75
CHARS = 2_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Multisets of word shingles."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.hashes = size, word_hashes()

    def split(self, texts: list[str]):
        """(words of each text, hashes of all words, number of words of each text)."""
        lists = [words(t) for t in texts]
        n = np.array([len(w) for w in lists], np.int64)
        flat = np.fromiter((self.hashes[w] for ws in lists for w in ws), np.uint64, int(n.sum()))
        return lists, flat, n

    def bags(self, flat: np.ndarray, n: np.ndarray):
        """(text, shingle of 48 bits, count) of the different shingles, ordered by text and shingle.  A text
        of fewer words than a shingle has one shingle, of all its words."""
        k = self.size
        first = np.cumsum(n) - n
        per = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
        text = np.repeat(np.arange(len(n)), per)
        at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        end = (first + n)[text]
        value = np.zeros(len(text), np.uint64)
        for i in range(k):
            w = np.where(at + i < end, flat[np.minimum(at + i, len(flat) - 1)] if len(flat) else 0, 0).astype(np.uint64)
            value = value * PRIME + w + np.uint64(1)
        key = (text.astype(np.uint64) << np.uint64(48)) | (mix64(value) >> np.uint64(16))
        key, count = np.unique(key, return_counts=True)
        return (key >> np.uint64(48)).astype(np.int64), key & np.uint64(2 ** 48 - 1), count


def bag_minhash(text: np.ndarray, item: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """BagMinHash signatures [texts, size] of weighted sets, given as (text, item, weight) rows.

    The weights are cut at the levels 1, 2, 4, 8 ...  Each item has a Poisson process of its own
    between two neighbouring levels, at a rate of the levels' distance; it gives points in the order
    of time, each with a component and a level.  A text sees the points up to its weight.  A
    component keeps the time of its first point, so two texts agree in it with a probability of
    their weighted Jaccard similarity.  An item is left as soon as its time is past every component
    of its text, so that the work is in proportion to items plus size * log(size).  Times are
    summed in one order, whatever else is in the batch, so equal points are equal numbers.
    Texts without items have infinite components."""
    out = np.full(texts * size, np.inf)
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    own = np.repeat(np.arange(len(item)), levels)
    level = np.arange(len(own)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    cover = (weight[own] - low) / width
    seed = mix64(item[own] * PRIME + level.astype(np.uint64))
    doc, time, drawn = text[own], np.zeros(len(own)), 0
    while len(doc):
        k = int(np.clip(30_000 // len(doc), 1, 64))
        step = np.arange(drawn, drawn + k, dtype=np.uint64)
        draw = mix64(seed[:, None] + step[None, :] * np.uint64(0xC2B2AE3D27D4EB4F))
        wait = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / width[:, None]
        wait[:, 0] += time
        times = np.cumsum(wait, axis=1)
        more = mix64(draw ^ np.uint64(0x165667B19E3779F9))
        place = (more >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)
        seen = (more & np.uint64(2 ** 32 - 1)).astype(np.float64) * 2.0 ** -32 < cover[:, None]
        at = doc[:, None] * size + place.astype(np.int64)
        np.minimum.at(out, at[seen], times[seen])
        time, drawn = times[:, -1], drawn + k
        on = time < out.reshape(texts, size).max(1)[doc]
        doc, time, seed, width, cover = doc[on], time[on], seed[on], width[on], cover[on]
    return out.reshape(texts, size)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    for r in range(rows):
        key = mix64(key * PRIME + bits[:, :, r])
    return key.view(np.int64)


def features(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key_a, key_b, bands): 128 bits of the word sequence, and the band keys (null without words)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def compute(batches):
        import xxhash
        kept_by("near_dedup")
        shingles = Shingles()
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys, found = [], []
            for a, b in portions(map(len, texts), CHARS):
                for i in range(a, b, 2 ** 14):
                    part = texts[i:min(i + 2 ** 14, b)]
                    lists, flat, n = shingles.split(part)
                    keys += [xxhash.xxh3_128_digest(" ".join(w) if w else "\0" + t) for w, t in zip(lists, part, strict=True)]
                    sig = bag_minhash(*shingles.bags(flat, n), len(part), bands * rows)
                    found += [k.tolist() if m else None for k, m in zip(band_keys(sig, bands, rows), n, strict=True)]
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "key_a", "key_b", "bands"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        compute, f"doc_id {kind}, key_a long, key_b long, bands array<long>")


def _bags(docs: DataFrame) -> DataFrame:
    """(id, items, counts) of documents (id, text): their shingle multisets as binary arrays."""
    def compute(batches):
        shingles = Shingles()
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            items, counts = [], []
            for a, b in portions(map(len, texts), CHARS):
                for i in range(a, b, 2 ** 14):
                    part = texts[i:min(i + 2 ** 14, b)]
                    _lists, flat, n = shingles.split(part)
                    text, item, count = shingles.bags(flat, n)
                    edge = np.searchsorted(text, np.arange(1, len(part)))
                    for x, y in zip(np.split(item, edge), np.split(count, edge), strict=True):
                        x, y = packed(x, y)
                        items.append(x)
                        counts.append(y)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(items, pa.binary()), pa.array(counts, pa.binary())],
                                             names=["id", "items", "counts"])
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(compute, f"id {kind}, items binary, counts binary")


def packed(items: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """A multiset as bytes: six of each item, and four of each count, none where all are 1."""
    return items.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), counts.astype("<u4").tobytes() if (counts > 1).any() else b""


def unpacked(items, counts) -> tuple[np.ndarray, np.ndarray]:
    """(items, counts) of buffers of :func:`packed`."""
    six = np.frombuffer(items, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    n = np.frombuffer(counts, "<u4").astype(np.int64)
    return out.view("<u8").ravel(), n if len(n) else np.ones(len(six), np.int64)


def overlap(items_a: bytes, counts_a: bytes, items_b: bytes, counts_b: bytes) -> tuple[int, int]:
    """(sum of minima, sum of maxima) of two multisets."""
    (a, x), (b, y) = unpacked(items_a, counts_a), unpacked(items_b, counts_b)
    if not len(a) or not len(b):
        return 0, int(x.sum() + y.sum())
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    common = int(np.minimum(x[same], y[at[same]]).sum())
    return common, int(x.sum() + y.sum()) - common


def _verified(pairs: DataFrame, count: int, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, ca, cb) of at least the threshold's similarity, as (ca, cb)."""
    def check(batches):
        for batch in batches:
            cols = [batch.column(c) for c in ("ia", "na", "ib", "nb")]
            keep = []
            for i in range(batch.num_rows):
                common, union = overlap(*[c[i].as_buffer() for c in cols])          # no copies of a batch of bags
                keep.append(union > 0 and common >= threshold * union - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("ca"), batch.column("cb")], names=["ca", "cb"]).filter(pa.array(keep, pa.bool_()))

    def of(c: str) -> DataFrame:                                             # few other bags are moved
        filter_, bits = id_filter(pairs.select(F.col(c).alias("id")), "id", count)
        return may_be_in(bags, "id", filter_, bits).select(F.col("id").alias(c), F.col("items").alias(f"i{c}"), F.col("counts").alias(f"n{c}"))

    both = join_skewed(join_skewed(pairs, of("a"), "a", "b", count), of("b"), "b", "a", count, counted=pairs)
    kind = pairs.schema["ca"].dataType.simpleString()
    return both.select("ca", "cb", "ia", "na", "ib", "nb").mapInArrow(check, f"ca {kind}, cb {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, class_id, kept).

    Documents whose multisets of five-word shingles have a weighted Jaccard similarity of the
    threshold or more are linked; a class is what links connect, its id is its smallest doc_id, and
    that document is kept.  Words are lower-case runs of letters, digits and underscores.

    Documents of equal words are copies: only their first one is banded and compared.  In a
    bucket of documents that share a band, all are first compared with one leader per round, a
    member of the bucket's largest class so far that shares many buckets with others.  Then the rows of a bucket
    that are still of another class than the largest one are compared with all of the bucket that
    is not of their own class; so every pair that shares a bucket is checked unless it is in one
    class already, and none is formed inside a class.  Large buckets are cut into bounded cells, in which
    sketches are compared without forming pairs; only pairs whose sketches may reach the threshold are verified.

    Null and empty texts are copies of each other; texts without any word are compared as they
    are.  Rows of a null id have a null class and are kept.  Rows that share an id are one document.  An
    empty table gives no rows, other columns are not read."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    feats, seen = store_counted(features(own, "doc_id", "text", bands, rows), "near-features")
    total = seen["n"]
    key = F.struct("key_a", "key_b")
    copies = store(feats.where("doc_id is not null").groupBy("key_a", "key_b").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size")).withColumn("key", key), "near-copies")
    firsts = copies.select(F.col("first").alias("id")).distinct()
    banded = store(feats.where("bands is not null").select(F.col("doc_id").alias("id"), "bands").join(firsts, "id", "left_semi"), "near-banded")
    exploded = banded.select("id", F.explode("bands").alias("bucket"))
    shared, seen = store_counted(exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-buckets")
    filter_, bits = id_filter(shared, "bucket", seen["n"])                   # rows alone in their bucket don't shuffle again
    maybe = may_be_in(exploded, "bucket", filter_, bits)
    placed, seen = store_counted(attach(maybe, shared, "bucket", "n", total * bands).select("bucket", "id", "n"), "near-placed")
    discard(shared, banded)
    count = seen["n"]
    state, seen = store_counted(placed.groupBy("id").agg(F.sum("n").alias("weight")).withColumn("class", F.col("id")), "near-classes")
    placed = placed.select("bucket", "id")
    ids = seen["n"]
    if count:
        filter_, bits = id_filter(state, "id", ids)
        texts = may_be_in(own.withColumnRenamed("doc_id", "id"), "id", filter_, bits).join(state.select("id"), "id", "left_semi")
        bags = store(_bags(texts.select("id", "text")).dropDuplicates(["id"]), "near-bags")
        for turn in range(LEADER_ROUNDS + 1):
            if turn < LEADER_ROUNDS:
                pairs, n = _leader_pairs(placed, state, count, turn)
            else:
                pairs, n = _remaining_pairs(placed, state, count, bags, threshold)
            if not n:
                break
            links, found = store_counted(_verified(pairs, n, bags, threshold), "near-links")
            if found["n"]:
                nxt = merged(state, links, ids, "near-classes")
                discard(state)
                state = nxt
        discard(bags)
    named = (copies.join(state.withColumnRenamed("id", "first"), "first", "left")
             .select("key", F.coalesce("class", "first").alias("class_id"), "size"))
    known = attach(feats.where("doc_id is not null").select("doc_id", key.alias("key")), named, "key", "size", total)
    nameless = feats.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return (known.select("doc_id", "class_id").unionByName(nameless)
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))))


def _open_buckets(placed: DataFrame, state: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(rows (bucket, id, class), buckets of several classes (bucket, top, n)): ``top`` is the largest class, with its
    number of rows ``n`` and its leader ``id``."""
    rows = store(placed.join(state, "id"), "near-rows")
    chance = F.lit(1.0) if turn == 0 else 0.6 + 0.4 * F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1000)) / 1000
    lead = F.max(F.struct((F.col("weight") * chance).alias("w"), "id")).alias("lead")
    tops = store(rows.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"), lead)
                 .groupBy("bucket").agg(F.max(F.struct("n", F.col("lead.id").alias("id"), F.col("class").alias("class"))).alias("top"),
                                        F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes")).where("classes > 1"), "near-tops")
    return rows, tops


def _leader_pairs(placed: DataFrame, state: DataFrame, count: int, turn: int) -> tuple[DataFrame, int]:
    """Pairs (a, b, ca, cb) of a document and the leader of the largest foreign class in its buckets, and their number."""
    rows, tops = _open_buckets(placed, state, turn)
    rest = attach(rows, tops, "bucket", "n", count).where("class <> top.class")
    best = F.max(F.struct(F.col("top.n").alias("n"), F.col("top.id").alias("id"), F.col("top.class").alias("class"))).alias("to")
    pairs = (rest.groupBy("id", "class").agg(best)
             .select(F.col("id").alias("a"), F.col("to.id").alias("b"), F.col("class").alias("ca"), F.col("to.class").alias("cb")))
    out, seen = store_counted(pairs, "near-pairs")
    discard(rows)
    return out, seen["n"]


def _remaining_pairs(placed: DataFrame, state: DataFrame, count: int, bags: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """All pairs (a, b, ca, cb) of different classes in one bucket that may reach the threshold, and their number."""
    rows, tops = _open_buckets(placed, state, 0)
    open_ = store(attach(rows, tops, "bucket", "n", count).select("bucket", "id", "class", F.col("top.class").alias("large"), "n"), "near-open")
    one = open_.where("class <> large").withColumnsRenamed({"id": "a", "class": "ca"})
    two = open_.select("bucket", F.col("id").alias("b"), F.col("class").alias("cb"), "n")
    few = (one.where(F.col("n") <= SMALL).join(two.where(F.col("n") <= SMALL).drop("n"), "bucket")
           .where("ca <> cb and (cb = large or a < b)").select("a", "b", "ca", "cb"))
    wide = open_.where(F.col("n") > SMALL)
    own_buckets = wide.groupBy("id").agg(F.collect_list("bucket").alias("buckets"))       # as many as bands at most
    sketches = store(_sketches(bags.join(wide.select("id").distinct(), "id", "left_semi")).join(own_buckets, "id"), "near-sketches")
    cells = F.ceil(F.col("n") / CELL).cast("int")
    every = F.explode(F.sequence(F.lit(0), cells - 1))
    own = F.pmod(F.xxhash64("id", "bucket"), cells).cast("int")
    marked = wide.join(sketches, "id").select("bucket", "id", "class", "large", "sketch", "buckets", own.alias("own"), every.alias("other"))

    def side(i: str, j: str) -> DataFrame:
        return marked.select(*[F.col(c).alias(c) for c in ("bucket", "id", "class", "large", "sketch", "buckets")], F.col(i).alias("i"), F.col(j).alias("j"))

    left, right = side("own", "other").where("class <> large"), side("other", "own")
    kind = state.schema["id"].dataType.simpleString()
    least = int((threshold - MARGIN * (threshold * (1 - threshold) / SKETCH) ** 0.5) * SKETCH)

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        mine, theirs = (np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH) for t in (x, y))
        a, ca = (x.column(c).to_numpy() for c in ("id", "class"))
        b, cb, large = (y.column(c).to_numpy() for c in ("id", "class", "large"))
        at, to = [], []
        here = x.column("bucket")[0].as_py() if len(a) else None
        shared, sets = x.column("buckets").to_pylist(), {}
        for i in range(len(a)):
            may = np.flatnonzero((cb != ca[i]) & ((cb == large) | (a[i] < b)))
            near = may[(theirs[may] == mine[i]).sum(1) >= least].tolist()
            mine_too = set(shared[i]) if near else None
            for j in near:                                                # once, in the first bucket that both are in
                if j not in sets:
                    sets[j] = set(y.column("buckets")[j].as_py())
                if min(mine_too & sets[j]) == here:
                    at.append(i)
                    to.append(j)
        return pa.table({"a": a[at], "b": b[to], "ca": ca[at], "cb": cb[to]}) if at else pa.table(
            {c: x.column(n).slice(0, 0) for c, n in (("a", "id"), ("b", "id"), ("ca", "class"), ("cb", "class"))})

    many = (left.groupBy("bucket", "i", "j").cogroup(right.groupBy("bucket", "i", "j"))
            .applyInArrow(compare, f"a {kind}, b {kind}, ca {kind}, cb {kind}"))
    out, seen = store_counted(few.unionByName(many).distinct(), "near-pairs")
    discard(rows, open_, sketches)
    return out, seen["n"]


def _sketches(bags: DataFrame) -> DataFrame:
    """(id, sketch): one byte of each of SKETCH signature components."""
    def compute(batches):
        for batch in batches:
            both = [unpacked(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("items"), batch.column("counts"), strict=True)]
            items, counts = [x for x, _ in both], [y for _, y in both]
            out = []
            for a, b in portions((max(len(x), 200) for x in items), 200_000):            # 1000 texts at most
                text = np.repeat(np.arange(b - a), [len(x) for x in items[a:b]])
                sig = bag_minhash(text, np.concatenate(items[a:b]), np.concatenate(counts[a:b]), b - a, SKETCH)
                out += [x.tobytes() for x in (mix64(sig.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "sketch"])
    return bags.mapInArrow(compute, f"id {bags.schema['id'].dataType.simpleString()}, sketch binary")
