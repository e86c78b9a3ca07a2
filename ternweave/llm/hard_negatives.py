"""Hard negatives: a multiway hyperplane tree with distance ranges between sibling subtrees, and exact leaves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ternweave.llm.common import store

#: Rows that the split points are chosen from, split points of a node, leaves at most, and rows that a leaf should hold.
SAMPLE, FANOUT, MAX_LEAVES, LEAF_ROWS = 8192, 8, 1024, 4096
#: Index rows and anchors that one task compares at most; larger leaves are cut into such cells.
CELL_ROWS, CELL_ANCHORS, BLOCK = 32_768, 8192, 256
#: Stands for a null id, which is larger than all others.
NO_ID = 2 ** 63 - 1
SLACK = 1e-6


def packed(vectors: np.ndarray) -> list[bytes]:
    """Integer vectors as bytes: 16 bits a component where they fit, 64 otherwise."""
    small = np.abs(vectors).max(axis=1, initial=0) < 2 ** 15
    return [v.astype("<i2" if s else "<i8").tobytes() for v, s in zip(vectors, small, strict=True)]


def unpacked(column, dim: int) -> np.ndarray:
    """The integer vectors of a column of :func:`packed`, [rows, dim]."""
    raw = column.to_pylist()
    if all(len(v) == 2 * dim for v in raw):
        return np.frombuffer(b"".join(raw), "<i2").reshape(len(raw), dim).astype(np.int64)
    return np.stack([np.frombuffer(v, "<i2" if len(v) == 2 * dim else "<i8").astype(np.int64) for v in raw])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products [len(a), len(b)] of integer vectors."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    kind = np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class Tree:
    """A tree of nodes with up to FANOUT split points; a row belongs to the nearest one (the first, of equally near ones).

    ``low`` and ``high`` hold, for each node, the smallest and largest distance between each split point and
    the rows of each sibling subtree.  The origin is one more split point, whose ranges are those of the norms."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.points: list[np.ndarray] = []
        self.child: list[list[int]] = []                     # a node, or -1 - leaf
        self.leaves = 0
        least = max(2, len(sample) // max(1, min(leaves, MAX_LEAVES)))
        self._grow(np.unique(sample, axis=0), least)
        self.low = [np.full((len(p) + 1, len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p) + 1, len(p)), -np.inf) for p in self.points]

    def _grow(self, sample: np.ndarray, least: int) -> int:
        if len(sample) <= least or len(sample) < 2 or self.leaves + FANOUT > MAX_LEAVES:
            self.leaves += 1
            return -self.leaves
        node, picked = len(self.points), [0]
        near = self.distances(sample, sample[:1])[:, 0]
        while len(picked) < min(FANOUT, len(sample)) and near.max() > 0:             # each the farthest from those before
            picked.append(int(near.argmax()))
            near = np.minimum(near, self.distances(sample, sample[picked[-1:]])[:, 0])
        self.points.append(sample[picked])
        self.child.append([])
        home = self.distances(sample, sample[picked]).argmin(axis=1)
        for j in range(len(picked)):
            self.child[node].append(self._grow(sample[home == j], least) if (home == j).sum() < len(sample) else self._leaf())
        return node

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    @staticmethod
    def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        a, b = rows.astype(np.float64), points.astype(np.float64)
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))

    def place(self, rows: np.ndarray, seen=None) -> np.ndarray:
        """Leaf of each row; ``seen(node, low, high)`` is told the ranges of the rows at every node."""
        leaf = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))] if self.points else []
        while todo:
            node, own = todo.pop()
            near = self.distances(rows[own], self.points[node])
            home = near.argmin(axis=1)
            if seen is not None:
                far = np.concatenate([near, np.sqrt((rows[own].astype(np.float64) ** 2).sum(1))[:, None]], axis=1)
                low, high = np.full_like(self.low[node], np.inf), np.full_like(self.high[node], -np.inf)
                for j in np.unique(home):
                    low[:, j], high[:, j] = far[home == j].min(axis=0), far[home == j].max(axis=0)
                seen(node, low, high)
            for j, to in enumerate(self.child[node]):
                mine = own[home == j]
                if to < 0:
                    leaf[mine] = -1 - to
                elif len(mine):
                    todo.append((to, mine))
        return leaf

    def survivors(self, rows: np.ndarray, least: np.ndarray, most: np.ndarray) -> list[np.ndarray]:
        """Leaves that may hold a row of a score from ``least`` to ``most`` with each anchor.

        A score window is an annulus of distances once the norms of a subtree are known.  A subtree is left out if
        for one split point the triangle inequality puts its whole range inside or outside of that annulus."""
        if not self.points:
            return [np.zeros(1, np.int64)] * len(rows)
        keep = np.zeros((len(rows), self.leaves), bool)
        norm = (rows.astype(np.float64) ** 2).sum(1)
        todo = [(0, np.flatnonzero(least <= most))]
        while todo:
            node, own = todo.pop()
            low, high = self.low[node], self.high[node]
            r = np.concatenate([self.distances(rows[own], self.points[node]), np.sqrt(norm[own])[:, None]], axis=1)
            inner = np.sqrt(np.maximum(norm[own, None] + low[-1] ** 2 - 2 * most[own, None], 0)) - SLACK
            outer = np.sqrt(np.maximum(norm[own, None] + high[-1] ** 2 - 2 * least[own, None], -1)) if len(own) else inner
            outer = np.where(np.isnan(outer), -1, outer) + SLACK
            nearest = np.maximum(r[:, :, None] - high[None], low[None] - r[:, :, None]).max(axis=1)
            farthest = (r[:, :, None] + high[None]).min(axis=1)
            stays = (nearest <= outer) & (farthest >= inner) & np.isfinite(low[-1])
            for j, to in enumerate(self.child[node]):
                mine = own[stays[:, j]]
                if to < 0:
                    keep[mine, -1 - to] = True
                elif len(mine):
                    todo.append((to, mine))
        return [np.flatnonzero(k) for k in keep]


def rows_of(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int, int]:
    """(row, vec_id, label, vec): rows that take part, with the integer components floor(256 x), and their number and length
    (negative where a component needs more than 16 bits).

    Shorter vectors are filled up with zeros.  Rows with a null label or vector, or with a null or non-finite component, are left out."""
    own = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                       F.col(vector_col).cast("array<double>").alias("x")).where("label is not null and x is not null")
    own = own.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    dim = max(own.agg(F.max(F.size("x")).alias("d")).first().d or 1, 1)

    def compute(batches):
        for batch in batches:
            lists = batch.column("x")
            size = np.diff(lists.offsets.to_numpy())
            value = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False))
            if np.abs(value).max(initial=0) >= 2 ** 62:
                raise ValueError("a component times 256 doesn't fit 64 bits")
            full = np.zeros((batch.num_rows, dim), np.int64)
            full[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = value
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "vec_id", "label")] + [pa.array(packed(full), pa.binary())],
                                             names=["row", "vec_id", "label", "vec"])

    out = store(own.mapInArrow(compute, f"row long, vec_id long, label {own.schema['label'].dataType.simpleString()}, vec binary"), "negatives-rows")
    seen = out.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("vec") > 2 * dim).alias("wide")).first()
    return out, seen["n"], -dim if seen["wide"] else dim


class Index:
    """All rows by leaf in a stored table; the tree, with the ranges over all rows; and the sampled rows, whose scores bound a search."""

    def __init__(self, rows: DataFrame, n: int, dim: int, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS):
        wide, dim = dim < 0, abs(dim)
        self.dim = dim
        some = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(sample).toArrow()
        self.some = {"row": some.column("row").to_numpy(), "label": np.array(some.column("label").to_pylist()),
                     "vec": unpacked(some.column("vec"), dim) if len(some) else np.zeros((0, dim), np.int64)}
        tree = self.tree = Tree(self.some["vec"], 1 if wide else -(-n // leaf_rows))

        def placed(batches):
            for batch in batches:
                leaf = tree.place(unpacked(batch.column("vec"), dim)) if batch.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", *batch.schema.names])

        kind = "leaf long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        self.rows = store(rows.mapInArrow(placed, kind), "negatives-index")
        self.sizes = self.rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))

        def ranges(batches):
            low, high = [x.copy() for x in tree.low], [x.copy() for x in tree.high]

            def seen(node, least, most):
                np.minimum(low[node], least, out=low[node])
                np.maximum(high[node], most, out=high[node])

            for batch in batches:
                tree.place(unpacked(batch.column("vec"), dim), seen)
            at = [(i, *ij) for i in range(len(low)) for ij in np.argwhere(np.isfinite(low[i]))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in at], pa.int32()) for k in range(3)]
                                             + [pa.array([x[i][p, j] for i, p, j in at], pa.float64()) for x in (low, high)],
                                             names=["node", "point", "subtree", "low", "high"])

        if tree.points:                                      # FANOUT + 1 rows a split point, for all the rows there are
            for r in (self.rows.select("vec").mapInArrow(ranges, "node int, point int, subtree int, low double, high double")
                      .groupBy("node", "point", "subtree").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()):
                tree.low[r.node][r.point, r.subtree], tree.high[r.node][r.point, r.subtree] = r.low, r.high

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor, window, row, vec_id, score): of each window (``low`` to ``high``, arrays of scores) of
        ``anchors(anchor, label, vec, low, high)`` the ``k`` rows of the same or of another label that score most, the smaller id
        first; the anchor itself is never among them.

        Leaves that can't hold one of them are left out: the k-th score of the sampled rows in a window is its new
        lower end.  What is left is compared in full, leaf by leaf, in cells of bounded size."""
        tree, some, dim = self.tree, self.some, self.dim

        def leaves(batches):
            for whole in batches:
                for a in range(0, whole.num_rows, 1024):
                    batch = whole.slice(a, 1024)
                    x = unpacked(batch.column("vec"), dim)
                    score = products(x, some["vec"])
                    label, row = np.array(batch.column("label").to_pylist()), batch.column("anchor").to_numpy()
                    fits = ((label[:, None] == some["label"]) == same) & (row[:, None] != some["row"])
                    least, most = np.full(len(x), np.inf), np.full(len(x), -np.inf)
                    for i, (low, high) in enumerate(zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True)):
                        for lo, hi in zip(low, high, strict=True):
                            inside = score[i][fits[i] & (score[i] >= lo) & (score[i] <= hi)]
                            if lo <= hi:
                                least[i] = min(least[i], np.partition(inside, -k)[-k] if len(inside) >= k else lo)
                                most[i] = max(most[i], hi)
                    found = [f.tolist() for f in tree.survivors(x, least, most)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "leaves"])

        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
        asked = store(anchors.mapInArrow(leaves, kind + ", leaves array<long>").select(*anchors.columns, F.explode("leaves").alias("leaf")), "negatives-asked")
        grid = F.broadcast(self.sizes.join(asked.groupBy("leaf").agg(F.count(F.lit(1)).alias("m")), "leaf").select(    # a row a leaf
            "leaf", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts"), F.ceil(F.col("m") / CELL_ANCHORS).cast("int").alias("chunks")))

        def cell(key: str, own: str, n_own: str, other: str, n_other: str) -> list:
            return [F.pmod(F.xxhash64(key), F.col(n_own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)).alias(other)]

        left = asked.join(grid, "leaf").select("leaf", *anchors.columns, *cell("anchor", "chunk", "chunks", "part", "parts"))
        right = self.rows.join(grid, "leaf").select("leaf", "row", "vec_id", "label", "vec", *cell("row", "part", "parts", "chunk", "chunks"))
        names = ["anchor", "window", "row", "vec_id", "score"]

        def compare(x: pa.Table, y: pa.Table) -> pa.Table:
            out: list[list[np.ndarray]] = [[] for _ in names]
            if x.num_rows and y.num_rows:
                ids = y.column("vec_id").combine_chunks().fill_null(NO_ID).to_numpy()
                row = y.column("row").to_numpy()
                order = np.lexsort((row, ids))                                       # equal scores: the smaller id first
                ids, row = ids[order], row[order]
                vec, label = unpacked(y.column("vec"), dim)[order], np.array(y.column("label").to_pylist())[order]
                mine, own, anchor = unpacked(x.column("vec"), dim), np.array(x.column("label").to_pylist()), x.column("anchor").to_numpy()
                low, high = x.column("low").to_pylist(), x.column("high").to_pylist()
                for a in range(0, len(mine), BLOCK):
                    score = products(mine[a:a + BLOCK], vec)
                    for i in range(len(score)):
                        fits = np.flatnonzero(((label == own[a + i]) == same) & (row != anchor[a + i]))
                        s = score[i][fits]
                        for w, (lo, hi) in enumerate(zip(low[a + i], high[a + i], strict=True)):
                            at = np.flatnonzero((s >= lo) & (s <= hi))
                            if len(at) > k:
                                at = at[s[at] >= np.partition(s[at], -k)[-k]]        # with all that tie
                            at = at[np.argsort(-s[at], kind="stable")][:k]
                            for column, v in zip(out, (np.full(len(at), anchor[a + i]), np.full(len(at), w), row[fits[at]], ids[fits[at]], s[at]), strict=True):
                                column.append(v.astype(np.int64))
            return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in zip(names, out, strict=True)})

        cells = ["leaf", "part", "chunk"]
        near = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(compare, ", ".join(f"{c} long" for c in names))
        best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "row")
        return near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def hard_negatives(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   is_anchor=None, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
                   leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor.

    Scores are integer inner products of floor(256 x).  The positives of an anchor are the best other rows of its label;
    for each, the negatives are the best rows of another label whose score is from ``window[0]`` to ``window[1]`` percent
    of the positive's.  Equal scores are in the order of the ids, and equal ids in the order of the rows.
    ``is_anchor`` is a condition on ``vec_id``, divisible by 50 if none is given.

    The tree is fitted on at most SAMPLE rows and indexes all; searches are exact.  Rows with a null label, vector
    or component, or with a non-finite one, take no part.  With components of 128 or more there is one leaf, since distances
    in doubles would no longer be exact.  A row without id is no anchor and comes last among equal
    scores.  Repeated rows are rows of their own: each may be an anchor and a positive of the other.  Empty
    vectors are zeros, and an empty table gives no rows; other columns are not read."""
    rows, n, dim = rows_of(table, id_col, vector_col, label_col)
    index = Index(rows, n, dim, leaf_rows=leaf_rows)
    chosen = F.col("vec_id") % 50 == 0 if is_anchor is None else is_anchor
    ends = [F.array(F.lit(e).cast("long")) for e in (-2 ** 62, 2 ** 62)]
    anchors = rows.where(chosen).select(F.col("row").alias("anchor"), "label", "vec", ends[0].alias("low"), ends[1].alias("high"))
    near = store(index.search(anchors, True, positives).select("anchor", F.col("vec_id").alias("positive_id"), "score", "place"), "negatives-positives")
    lists = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score", "positive_id"))).alias("p"))     # ``positives`` at most
    low, high = (F.transform("p.score", lambda s: F.ceil(s * window[0] / F.lit(100).cast("decimal(3,0)")).cast("long")),
                 F.transform("p.score", lambda s: F.floor(s * window[1] / F.lit(100).cast("decimal(3,0)")).cast("long")))
    wanted = store(rows.where(chosen).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vec").join(lists, "anchor")
                   .select("anchor", "anchor_id", "label", "vec", low.alias("low"), high.alias("high"), "p"), "negatives-wanted")
    found = index.search(wanted.select("anchor", "label", "vec", "low", "high"), False, negatives)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = (found.join(wanted.select("anchor", "anchor_id", "p"), "anchor").withColumn("q", F.col("p")[F.col("window").cast("int")])
           .select("anchor_id", F.col("q.positive_id").alias("positive_id"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"),
                   F.col("q.score").alias("positive_score"), F.col("score").alias("negative_score")))
    return out.withColumn("positive_id", real("positive_id")).withColumn("negative_id", real("negative_id"))
