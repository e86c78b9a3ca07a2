"""Similarity join of word-shingle sets in the Jaccard metric: pivots, Voronoi regions, triangle-inequality windows, exact ends."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternweave.llm.common import (attach, discard, give_back, id_filter, join_skewed, kept_by, may_be_in, merged, mix64, portions, slices,
                                  store, store_counted, without_ids)

SHINGLE = 5
#: Two sets are linked from this similarity on, in percent.
PERCENT = 80
#: Counters of the sketch of shingle frequencies, and of a part of it that is merged as one row.
COUNTERS, PART, FANS = 2 ** 21, 2 ** 16, 8
#: Rounds in which every set is compared with one pivot before regions are split.
PIVOT_ROUNDS = 2
#: Regions of at most SMALL sets are compared pair by pair, and of at most CELL sets in one task.  Larger ones are split at PIVOTS pivots each,
#: LEVELS times at most, if their parts hold at most SPREAD times their sets; the others are compared in cells of CELL x CELL sets.
SMALL, PIVOTS, LEVELS, SPREAD, CELL = 24, 8, 4, 2.0, 256
#: Least and largest length, in bits, of the parity vectors that bound an intersection from above, and 64-bit words of a least one.
FOLD, MOST_FOLD = 512, 2 ** 18
WORDS = FOLD // 64
CHARS = 2_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Sets:
    """Sets of five-word shingles, as sorted 64-bit hashes."""

    #: Bytes that are hashed at a time, and of the longest word among them; longer words are hashed one by one.
    BLOCK, LONGEST = 2 ** 17, 2 ** 12

    def __init__(self):
        lower = np.arange(256, dtype=np.uint64)
        lower[65:91] += np.uint64(32)
        self.byte = mix64((lower + np.uint64(1)) * PRIME)
        self.space = np.isin(np.arange(256), [32, *range(9, 14)])
        self.power = _powers(int(PRIME), self.BLOCK + self.LONGEST)
        self.inverse = _powers(pow(int(PRIME), -1, 2 ** 64), self.BLOCK)

    def words(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words at the places [start, end) of the bytes ``text``: the value of a polynomial whose coefficients are the
        lower-cased bytes, as a difference of its running sums."""
        out = np.zeros(len(start), np.uint64)
        cut = np.searchsorted(start, np.arange(0, len(text) + self.BLOCK, self.BLOCK))
        long = np.flatnonzero(end - start > self.LONGEST)
        for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if a == b:
                continue
            low = i * self.BLOCK
            x = self.byte[text[low:low + self.BLOCK + self.LONGEST]]
            x *= self.power[:len(x)]
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x, out=total[1:])
            s = start[a:b] - low
            out[a:b] = (total[np.minimum(end[a:b] - low, len(x))] - total[s]) * self.inverse[s]
        if len(long):
            import xxhash
            out[long] = [xxhash.xxh3_64_intdigest(text[start[i]:end[i]].tobytes().lower()) for i in long.tolist()]
        return mix64(out + PRIME)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the sets one after the other, their sizes).  Words are lower-cased (A-Z only) and split at ASCII white space;
        a text of fewer words than a shingle has one, of all its words, and a text without words none."""
        text = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        gap = np.concatenate([[True], self.space[text]])
        turn = np.flatnonzero(gap[1:] != gap[:-1])                            # every text ends with a space
        start, end = turn[::2], turn[1::2]
        value = self.words(text, start, end)
        first = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))
        n, first = np.diff(first), first[:-1]
        width = np.minimum(n, SHINGLE)
        per = np.where(n == 0, 0, n - width + 1)
        edge = np.cumsum(per)
        out = np.zeros(int(edge[-1]) if len(edge) else 0, np.uint64)
        whole, spans = max(len(value) - SHINGLE + 1, 0), np.repeat(n >= SHINGLE, per)
        full = np.full(whole, SHINGLE, np.uint64)
        for i in range(SHINGLE):
            full *= PRIME
            full += value[i:i + whole]
        at = np.ones(len(value), bool)                                        # words that begin a shingle of full width
        at[whole:] = False
        for i in range(SHINGLE - 1):
            at[(first + n - 1 - i)[n > i]] = False
        out[spans] = full[at[:whole]]
        few = np.flatnonzero((n > 0) & (n < SHINGLE))
        short = width[few].astype(np.uint64)
        for i in range(SHINGLE - 1):
            on = n[few] > i
            short[on] = short[on] * PRIME + value[first[few][on] + i]
        out[edge[few] - 1] = short
        out = mix64(out)
        for a, b in zip((edge - per).tolist(), edge.tolist(), strict=True):
            out[a:b].sort()
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        new[(edge - per)[per > 0]] = True
        total = np.concatenate([[0], np.cumsum(new)])
        return out[new], total[edge] - total[edge - per]

    def batches(self, batches, column: str = "text"):
        """(rows, their sets one after the other, their sizes), for bounded runs of rows."""
        for batch in slices(batches):
            texts = batch.column(column).cast(pa.large_binary()).to_pylist()
            for a, b in portions((len(t or b"") for t in texts), CHARS):
                flat, size = self.of([t or b"" for t in texts[a:b]])
                yield batch.slice(a, b - a), flat, size


def frequencies(docs: DataFrame) -> np.ndarray:
    """About the logarithm of how many documents hold a shingle, by the low bits of its hash, from a sketch of all documents(text)."""
    def count(batches):
        give_back()
        total = np.zeros(COUNTERS, np.int64)
        for _rows, flat, _size in Sets().batches(batches):
            total += np.bincount((flat % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        yield rows(np.arange(COUNTERS // PART), total.reshape(-1, PART))

    def rows(part, counts):
        kept = np.minimum(counts, 2 ** 32 - 1).astype("<u4")
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([c.tobytes() for c in kept], pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(PART, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_buffer(), "<u4")
        return pa.Table.from_batches([rows(table.column("part").slice(0, 1).to_numpy(), total[None])])

    kind = "part int, counts binary"
    fan = F.pmod(F.spark_partition_id(), F.lit(FANS)).alias("fan")
    found = (docs.select("text").mapInArrow(count, kind).select("*", fan).groupBy("part", "fan").applyInArrow(add, kind)
             .groupBy("part").applyInArrow(add, kind).collect())                          # COUNTERS numbers, whatever the input
    total = np.zeros((COUNTERS // PART, PART), np.int64)
    for r in found:
        total[r.part] = np.frombuffer(r.counts, "<u4")
    return np.round(8 * np.log2(total.ravel() + 1)).clip(0, 255).astype(np.uint8)


def prefix(shingles: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, one of which every linked set has among its own rarest ones."""
    n = len(shingles)
    order = np.argsort(level[(shingles % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")       # then by hash
    return shingles[order[:n + (PERCENT * n) // -100 + 1]]


def features(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """(row, doc_id, mark, key_a, key_b, n, prefix, fold) of documents (row, doc_id, mark, text): the key is 128 bits of the set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def compute(batches):
        import xxhash
        kept_by("jaccard_join")
        for rows, flat, size in Sets().batches(batches):
            sets = np.split(flat, np.cumsum(size)[:-1])
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            rare = [prefix(s, level).view(np.int64) for s in sets]
            ends = np.cumsum([0] + [len(r) for r in rare]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rare)))
            folds = pa.array([fold(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("row", "doc_id", "mark")]
                                             + [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(size), lists, folds],
                                             names=["row", "doc_id", "mark", "key_a", "key_b", "n", "prefix", "fold"])
    return docs.mapInArrow(compute, f"row long, doc_id {kind}, mark long, key_a long, key_b long, n long, prefix array<long>, fold binary")


def linked(common, n, m):
    """Whether sets of sizes n and m with so many common shingles are linked, in integers."""
    return 100 * common >= PERCENT * (n + m - common)


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def sizes_fit(n: Column, m: Column) -> Column:
    """Whether sets of sizes n and m may be linked, whatever they hold."""
    return linked(F.least(n, m), n, m)


def fold(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's shingles falls into each cell, one bit per cell: FOLD cells, or as many as the set has shingles
    (a power of two, MOST_FOLD at most).

    A cell in which two such vectors differ has a shingle of only one of the sets: their number is at most the size of the sets'
    symmetric difference.  It rules most pairs out, and no linked one."""
    n = FOLD
    while n < min(len(shingles), MOST_FOLD):
        n *= 2
    odd = np.bincount((shingles % np.uint64(n)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def narrowed(vector: np.ndarray, words: int) -> np.ndarray:
    """A fold of so many 64-bit words, of one of more."""
    return np.bitwise_xor.reduce(vector.reshape(-1, words), axis=0)


def may_link(one: np.ndarray, n, two: np.ndarray, m) -> np.ndarray:
    """Whether sets of sizes n and m may be linked, by their folds of equally many words."""
    apart = np.bitwise_count(one ^ two).sum(axis=-1, dtype=np.int64)
    return linked(np.minimum((n + m - apart) // 2, np.minimum(n, m)), n, m)


class Folds:
    """Folds of a column, of as many words as are asked for."""

    def __init__(self, column):
        self.own = [np.frombuffer(v.as_buffer(), np.uint64) for v in column]
        self.words = np.array([len(x) for x in self.own], np.int64)
        self.base = np.array([narrowed(x, WORDS) for x in self.own], np.uint64).reshape(-1, WORDS)

    def at(self, rows: np.ndarray, words: int) -> np.ndarray:
        return self.base[rows] if words == WORDS else np.array([narrowed(self.own[i], words) for i in rows.tolist()])


def near_rows(one: Folds, i: int, n: int, two: Folds, rows: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Those of the ``rows`` of ``two``, of sizes ``m``, that may be linked with row ``i`` of ``one``: coarse folds are compared first."""
    on = may_link(one.base[i], n, two.base[rows], m)
    rows, m = rows[on], m[on]
    words = np.minimum(two.words[rows], one.words[i])
    keep = np.ones(len(rows), bool)
    for c in np.unique(words[words > WORDS]).tolist():
        at = np.flatnonzero(words == c)
        for a in range(0, len(at), 64):
            part = at[a:a + 64]
            keep[part] = may_link(narrowed(one.own[i], c), n, two.at(rows[part], c), m[part])
    return rows[keep]


def near_pairs(one: Folds, n: np.ndarray, two: Folds, m: np.ndarray) -> np.ndarray:
    """Whether row i of ``one``, of size n[i], may be linked with row i of ``two``, of size m[i]."""
    keep = may_link(one.base, n, two.base, m)
    words = np.minimum(one.words, two.words)
    for i in np.flatnonzero(keep & (words > WORDS)).tolist():
        keep[i] = may_link(narrowed(one.own[i], words[i]), n[i], narrowed(two.own[i], words[i]), m[i])
    return keep


class Texts:
    """The sets of nodes, made from their texts again whenever they are needed: folds are stored for all, and sets for the few
    whose pairs the folds leave.  Rows of the same id and text are combined first."""

    def __init__(self, own: DataFrame, feats: DataFrame, state: DataFrame):
        self.own = own
        self.folds = feats.where("n > 0").select(F.col("row").alias("node"), F.col("n").alias("size"), "fold")
        self.wanted = store(feats.join(state.select(F.col("node").alias("row")), "row", "left_semi").select(
            F.col("row").alias("node"), "mark", "key_a", "key_b"), "join-wanted")
        self.again, again = store_counted(feats.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark"), "join-again")
        self.repeated = again["n"]

    def sets(self, ids: DataFrame) -> DataFrame:
        """(node, items), stored, of the nodes ``ids``."""
        few, seen = store_counted(self.wanted.join(ids, "node", "left_semi"), "join-few")
        filter_, bits = id_filter(few, "mark", seen["n"])
        texts = may_be_in(self.own.select("mark", "text"), "mark", filter_, bits)
        if not self.repeated:
            return store(_sets_of(texts, few), "join-sets")
        filter_, bits = id_filter(self.again, "mark", self.repeated)
        once = texts.join(self.again, "mark", "left_anti")
        twice = may_be_in(texts, "mark", filter_, bits).join(self.again, "mark", "left_semi").distinct()
        return store(_sets_of(once, few).unionByName(_sets_of(twice, few)), "join-sets")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, items) of the ``wanted(node, mark, key_a, key_b)`` from documents (mark, text)."""
    def compute(batches):
        import xxhash
        give_back()
        for rows, flat, size in Sets().batches(batches):
            parts = np.split(flat, np.cumsum(size)[:-1])
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in parts), np.int64).reshape(-1, 2)
            same = (rows.column("key_a").to_numpy() == keys[:, 0]) & (rows.column("key_b").to_numpy() == keys[:, 1])
            items = pa.array([s.tobytes() for s in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("node"), items], names=["node", "items"]).filter(pa.array(same))

    return docs.join(wanted, "mark").mapInArrow(compute, "node long, items binary")


def _verified(pairs: DataFrame, count: int, texts: Texts) -> DataFrame:
    """The linked ones of the pairs (a, b, ca, cb), as (ca, cb).  Folds are compared first, so that few pairs need their sets."""
    def rule_out(batches):
        give_back()
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("size_a", "size_b"))
            one, two = Folds(batch.column("fold_a")), Folds(batch.column("fold_b"))
            keep = near_pairs(one, n, two, m)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names], names=names).filter(pa.array(keep, pa.bool_()))

    def check(batches):
        give_back()
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("items_a", "items_b"))
            keep = [bool(linked(common_size(a, b), len(a), len(b))) for a, b in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("ca"), batch.column("cb")], names=["ca", "cb"]).filter(pa.array(keep, pa.bool_()))

    def with_both(rows: DataFrame, n: int, held: DataFrame, *columns: str) -> DataFrame:
        one, two = (held.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns]) for c in "ab")
        return join_skewed(join_skewed(rows, two, "b", "a", n), one, "a", "b", n, counted=rows)

    names = ["a", "b", "ca", "cb"]
    left, seen = store_counted(with_both(pairs, count, texts.folds, "size", "fold").select(*names, "size_a", "fold_a", "size_b", "fold_b").mapInArrow(
        rule_out, ", ".join(f"{c} long" for c in names)), "join-near")
    if not seen["n"]:
        return left.select("ca", "cb")
    sets = texts.sets(left.select(F.explode(F.array("a", "b")).alias("node")))
    return with_both(left, seen["n"], sets, "items").select("ca", "cb", "items_a", "items_b").mapInArrow(check, "ca long, cb long")


def _open_regions(placed: DataFrame, state: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(rows (region, node, held, class), regions of several classes (region, top, n)): ``top`` is the largest class with
    its number of sets and its pivot, a member that is in many large regions."""
    rows = store(placed.join(state, "node"), "join-rows")
    chance = F.lit(1.0) if turn == 0 else 0.6 + 0.4 * F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1000)) / 1000
    pivot = F.max(F.struct((F.col("weight") * chance).alias("w"), "node", "held")).alias("pivot")
    tops = (rows.groupBy("region", "class").agg(F.count(F.lit(1)).alias("n"), pivot)
            .groupBy("region").agg(F.max(F.struct("n", F.col("pivot.node").alias("node"), "class", F.col("pivot.held").alias("held"))).alias("top"),
                                   F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes")).where("classes > 1"))
    return rows, store(tops, "join-tops")


def _pivot_pairs(rows: DataFrame, tops: DataFrame, count: int) -> DataFrame:
    """A set and the pivot of the largest class, of all that its regions have, that it isn't in and may be linked with by size: a pair (a, b, ca, cb) per set."""
    rest = attach(rows, tops, "region", "n", count).where((F.col("class") != F.col("top.class")) & sizes_fit(F.col("held"), F.col("top.held")))
    best = F.max(F.struct(F.col("top.n").alias("n"), F.col("top.node").alias("node"), F.col("top.class").alias("class"))).alias("to")
    return (rest.groupBy("node", "class").agg(best)
            .select(F.col("node").alias("a"), F.col("to.node").alias("b"), F.col("class").alias("ca"), F.col("to.class").alias("cb")))


def _pairs_within(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, ca, cb) of different classes in one region (region, node, held, class, home) of at most SMALL sets, which may be linked by
    their sizes ``held``; one of them is at home."""
    one, two = (rows.select("region", *[F.col(c).alias(n) for c, n in (("node", x), ("class", "c" + x), ("home", "h" + x), ("held", "n" + x))]) for x in "ab")
    near = one.join(two, "region").where(F.expr("a < b and ca <> cb and (ha or hb)") & sizes_fit(F.col("na"), F.col("nb")))
    return near.select("a", "b", "ca", "cb").distinct()


def voronoi(rows: DataFrame, count: int, sets: DataFrame, level: int) -> DataFrame:
    """(region, node, class, home, near) of the regions (region, node, class, home, n), split at pivots of their own.

    Every set goes to the region of its nearest pivot, its home, and as a guest to each region whose pivot
    is not farther than the nearest one by more than twice the distance of a link: by the triangle inequality a linked set
    that is at home there can't be missed.  ``near`` has the (pivot, class) that the set itself is linked with."""
    first = Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(level)), "node")
    pivots = rows.where("home").withColumn("place", F.row_number().over(first)).where(F.col("place") <= PIVOTS).select("region", "node", "class", "n")
    held = (pivots.join(sets.select("node", "items"), "node").groupBy("region").agg(F.collect_list(F.struct("node", "class", "items")).alias("pivots"), F.max("n").alias("size")))
    window = 2 * (100 - PERCENT) / 100 + 1e-9

    def deal(batches):
        give_back()
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                region, home, near = [], [], []
                for pivot_list, own_class, own in zip(batch.column("pivots").to_pylist(), batch.column("class").to_pylist(), batch.column("items"), strict=True):
                    x = np.frombuffer(own.as_buffer(), np.uint64)
                    n = np.array([len(p["items"]) // 8 for p in pivot_list])
                    c = np.array([common_size(x, np.frombuffer(p["items"], np.uint64)) for p in pivot_list])
                    d = 1 - c / (n + len(x) - c)
                    stays = np.flatnonzero(d <= d.min() + window)
                    region.append([pivot_list[i]["node"] for i in stays])
                    home.append([bool(i == d.argmin()) for i in stays])
                    near.append([pivot_list[i]["class"] for i in np.flatnonzero(linked(c, n, len(x))) if pivot_list[i]["class"] != own_class])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("region", "node", "class", "home", "n")]
                    + [pa.array(region, pa.list_(pa.int64())), pa.array(home, pa.list_(pa.bool_())), pa.array(near, pa.list_(pa.int64()))],
                    names=["region", "node", "class", "home", "n", "to", "stays", "near"])

    with_sets = join_skewed(rows, sets.select("node", "items"), "node", "region", count)
    dealt = attach(with_sets, held, "region", "size", count).select(
        "region", "node", "class", "home", "n", "items", "pivots").mapInArrow(
        deal, "region long, node long, class long, home boolean, n long, to array<long>, stays array<boolean>, near array<long>")
    return dealt


def _cells(rows: DataFrame, count: int, texts: Texts) -> DataFrame:
    """Pairs (a, b, ca, cb) of regions (region, node, class, home, n) that no pivot splits, which their folds don't rule out: folds are compared
    in cells of CELL x CELL sets, so that no other pairs are formed."""
    parts = F.ceil(F.col("n") / CELL).cast("int")
    own, every = F.pmod(F.xxhash64("node", "region"), parts).cast("int"), F.explode(F.sequence(F.lit(0), parts - 1))
    held = join_skewed(rows, texts.folds, "node", "region", count).select(
        "region", "node", "class", "home", "size", "fold", own.alias("own"), every.alias("other"))

    def side(i: str, j: str) -> DataFrame:
        return held.select(*[F.col(c).alias(c) for c in ("region", "node", "class", "home", "size", "fold")],
                           F.col(i).alias("i"), F.col(j).alias("j")).where("i <= j")

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        (a, ca, ha, n), (b, cb, hb, m) = ([t.column(c).to_numpy() for c in ("node", "class", "home", "size")] for t in (x, y))
        same = bool(x.num_rows) and x.column("i")[0].as_py() == x.column("j")[0].as_py()
        left, right, at, to = Folds(x.column("fold")), Folds(y.column("fold")), [], []
        for k in range(len(a)):
            may = np.flatnonzero((cb != ca[k]) & (ha[k] | hb) & ((a[k] < b) if same else (a[k] != b)) & linked(np.minimum(m, n[k]), m, n[k]))
            may = near_rows(left, k, n[k], right, may, m[may])
            at += [k] * len(may)
            to += may.tolist()
        return pa.table({"a": a[at], "b": b[to], "ca": ca[at], "cb": cb[to]}) if at else pa.table({c: np.zeros(0, np.int64) for c in ("a", "b", "ca", "cb")})

    cell = ["region", "i", "j"]
    return side("own", "other").groupBy(*cell).cogroup(side("other", "own").groupBy(*cell)).applyInArrow(compare, "a long, b long, ca long, cb long")


def _told_apart(met: DataFrame, count: int) -> DataFrame:
    """(region, node, held, n) of the regions (region, node, held) that can hold a link, with their number of sets; one region of all that have the same sets.

    Near copies share many of their rarest shingles, each of which is a region of the same sets."""
    alike = ["n", "low", "high", "members"]
    regions = met.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"),
                                        F.bit_xor(F.xxhash64("node")).alias("members")).where("n > 1")
    once, seen = store_counted(regions.groupBy(*alike).agg(F.min("region").alias("region")).select("region", "n"), "join-alike")
    filter_, bits = id_filter(once, "region", seen["n"])
    rows, seen = store_counted(attach(may_be_in(met, "region", filter_, bits), once, "region", "n", count), "join-apart")
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("held").alias("least"), F.max("held").alias("most"))
    may = sizes.where((F.col("n") > 2) | sizes_fit(F.col("least"), F.col("most"))).select("region", "n")
    return attach(rows.select("region", "node", "held"), may, "region", "n", seen["n"])


def _gathered(rows: DataFrame, count: int) -> DataFrame:
    """(region, node) of the regions (region, node, n), those made one that have most of their sets in common.

    The sets of a large group of near copies are together in one region for each shingle that most of them share.  A region of more than SMALL sets goes to the one that is
    the largest for half of its sets or more, where those that go to it have at least as many pairs by themselves as in one.  Sets that share a region always share the
    one that it goes to."""
    large = rows.where(F.col("n") > SMALL)
    main = large.groupBy("node").agg(F.max(F.struct("n", "region")).alias("main")).select("node", F.col("main.region").alias("main"))
    votes = large.join(main, "node").groupBy("region", "n", "main").agg(F.count(F.lit(1)).alias("votes"))
    goes = votes.groupBy("region", "n").agg(F.max(F.struct("votes", "main")).alias("to")).where("2 * to.votes >= n").select("region", "n", F.col("to.main").alias("to"))
    goes = store(goes, "join-goes")
    moved = store(attach(large.drop("n"), goes, "region", "n", count).select("to", "node").distinct(), "join-moved")
    pairs = goes.groupBy("to").agg(F.sum(F.col("n") * F.col("n")).alias("apart"), F.count(F.lit(1)).alias("regions")).where("regions > 1")
    fewer = store(moved.groupBy("to").agg(F.count(F.lit(1)).alias("n")).join(pairs, "to").where("n * n <= apart").select("to", "n"), "join-fewer")
    stay = rows.where(F.col("n") <= SMALL).unionByName(large.join(goes.join(fewer, "to", "left_semi"), "region", "left_anti"))
    return stay.select("region", "node").unionByName(
        attach(moved, fewer, "to", "n", count).select(F.xxhash64("to", F.lit("all")).alias("region"), "node"))


def _sized(rows: DataFrame) -> DataFrame:
    """Regions (region, node, class, home) of several classes, each set of members once, with their size ``n``."""
    seen = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("x"), F.max("class").alias("y"),
                                      F.sum(F.xxhash64("node", "home").cast("decimal(38,0)")).alias("members")).where("x <> y")
    once = seen.groupBy("members", "n").agg(F.min("region").alias("region")).select("region", "n")
    return once


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id).

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; ``component_id`` is
    the smallest doc_id that links connect a document with, its own included.  No link between different sets is lost.

    Equal sets are one node.  Texts that share no shingle are all at distance 1, so that documents as pivots could not tell
    them apart; the first pivots are therefore single shingles.  A set belongs to the regions of its rarest shingles (a fifth of them and one
    more), which all sets linked with it meet.  In a region documents are the pivots: first one for each set,
    which makes one class of nearly all that are linked; then regions that still have several classes are split at pivots of their own
    (:func:`voronoi`) until they are small, and compared exactly.  Pairs within a class need no comparison.

    Null and empty texts, and those of white space, have no shingles and are linked with nothing.  Equal rows are linked, also those of one
    id.  A null id is never a component's id where there is another one.  An empty table gives no rows; other columns are not read."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("doc_id", F.lit(0), "text"))
    level = frequencies(own)
    feats, seen = store_counted(features(own.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "mark", "text"), level), "join-features")
    total, key = seen["n"], ["key_a", "key_b"]
    groups = store(feats.where("n > 0").groupBy(*key).agg(F.min("row").alias("node"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size")), "join-groups")
    copies = attach(feats.where("n > 0").select("row", F.struct(*key).alias("key")), groups.where("size > 1").select(F.struct(*key).alias("key"), "node", "size"),
                    "key", "size", total).where("row <> node").select("row")
    nodes = without_ids(feats.where("n > 0").select("row", "n", "prefix"), copies, "row")
    exploded = nodes.select(F.col("row").alias("node"), F.col("n").alias("held"), F.explode("prefix").alias("region"))
    shared, seen = store_counted(exploded.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "join-regions")
    filter_, bits = id_filter(shared, "region", seen["n"])                    # shingles of a single set don't shuffle again
    met, seen = store_counted(may_be_in(exploded, "region", filter_, bits), "join-met")
    told, seen = store_counted(_told_apart(met, seen["n"]), "join-told")
    state, nodes = store_counted(told.groupBy("node").agg(F.sum("n").alias("weight"), F.max("held").alias("held")).withColumn("class", F.col("node")), "join-classes")
    near = nodes["n"]
    placed, seen = store_counted(_gathered(told, seen["n"]), "join-placed")
    count = seen["n"]
    discard(shared, met, told)
    if count:
        texts = Texts(own, feats, state)
        for turn in range(PIVOT_ROUNDS):
            rows, tops = _open_regions(placed, state, turn)
            pairs, seen = store_counted(_pivot_pairs(rows, tops, count), "join-pairs")
            discard(rows, tops)
            if not seen["n"]:
                break
            state = _after(state, _verified(pairs, seen["n"], texts), near)
            discard(pairs)
        state = _ends(placed, state, near, texts)
    named = store(groups.join(state.select("node", "class"), "node", "left").withColumn("class", F.coalesce("class", "node")), "join-classed")
    least = named.groupBy("class").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    named = store(attach(named.select("class", *key, "size"), least, "class", "sets", total).select(*key, "size", "component_id"), "join-named")
    return (attach(feats.where("n > 0").select("doc_id", "n", F.struct(*key).alias("key")), named.select(F.struct(*key).alias("key"), "size", "component_id"),
                   "key", "size", total).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
            .unionByName(feats.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))))


def _after(state: DataFrame, links: DataFrame, nodes: int) -> DataFrame:
    found, seen = store_counted(links, "join-links")
    if not seen["n"]:
        return state
    out = merged(state, found, nodes, "join-classes")
    discard(state, found)
    return out


def _ends(placed: DataFrame, state: DataFrame, nodes: int, texts: Texts) -> DataFrame:
    """The final state: regions that still have several classes are split and compared until none is left.

    A region that is too large for a task is split where its parts hold at most SPREAD times its sets, guests included; another one is compared as it is."""
    rows = placed.join(state.select("node", "held", "class"), "node").withColumn("home", F.lit(True))
    for level in range(LEVELS + 1):
        rows = store(rows.select("region", "node", "held", "class", "home"), "join-level")
        sized = store(_sized(rows), "join-sized")
        count = sized.agg(F.sum("n")).first()[0] or 0
        if not count:
            break
        open_ = store(attach(rows, sized, "region", "n", count), "join-open")
        discard(rows, sized)
        large = open_.where(F.col("n") > CELL)
        last = level == LEVELS or large.isEmpty()
        whole = open_.where(F.col("n") > SMALL)                               # what is compared in cells
        if not last:
            dealt = store(voronoi(large, count, texts.sets(large.select("node")), level), "join-dealt")
            parts = dealt.groupBy("region").agg(F.sum(F.size("to")).alias("parts"), F.count(F.lit(1)).alias("n"))
            parts = store(parts.select("region", "n", (F.col("parts") <= SPREAD * F.col("n")).alias("split")), "join-parts")
            cut = store(attach(dealt.drop("n"), parts, "region", "n", count), "join-cut")
            whole = whole.where(F.col("n") <= CELL).select("region", "node", "class", "home", "n").unionByName(
                cut.where("not split").select("region", "node", "class", "home", "n"))
            moved = cut.where("split").select("region", "node", "home", F.explode(F.arrays_zip("to", "stays")).alias("t"))
            rows = moved.select(F.xxhash64("region", "t.to").alias("region"), "node", (F.col("home") & F.col("t.stays")).alias("home"))
        pairs = _pairs_within(open_.where(F.col("n") <= SMALL).drop("n")).unionByName(_cells(whole, count, texts))
        pairs, seen = store_counted(pairs.distinct(), "join-pairs")
        links = _verified(pairs, seen["n"], texts)
        if not last:
            links = links.unionByName(dealt.select(F.col("class").alias("ca"), F.explode("near").alias("cb")))
        state = _after(state, links, nodes)
        discard(open_, pairs)
        if last:
            break
        rows = rows.join(state.select("node", "held", "class"), "node")
    return state
