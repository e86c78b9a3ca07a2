"""Inverted files, block pairs, many phrases and 3 x 3 grids against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ternweave.functions.session import shared_folder
from ternweave.operators import blocks as B
from ternweave.operators import corpus as C
from ternweave.operators import duplicates as Dup
from ternweave.operators import inverted as I
from ternweave.operators import phrases as P
from ternweave.operators import rules as R
from ternweave.operators import search as S
from ternweave.sources.tables import spread

D = 64


def clustered(seed, n, groups=12, flips=9):
    """Ternary vectors around a few centres, some of them copies, and a zero vector."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(-1, 2, (groups, D))
    v = centres[rng.integers(0, groups, n)].astype(np.int8)
    for row in v:
        at = rng.integers(0, D, rng.integers(0, flips))
        row[at] = rng.integers(-1, 2, len(at))
    v[3:8], v[9] = v[2], 0
    return v


def table_of(spark, v, name="doc_id"):
    return spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(v)], f"{name} LONG, vec BINARY").repartition(5)


@pytest.mark.parametrize("block_bytes, threshold", [(8 << 20, 0.4), (700, 0.4), (700, -0.2)])
def test_pairs_above_match_brute_force(spark, block_bytes, threshold):
    v = clustered(1, 150)
    score = v.astype(int) @ v.astype(int).T / D
    want = {(i, j): score[i, j] for i in range(150) for j in range(150) if i != j and score[i, j] >= threshold}
    got = B.pairs_above(table_of(spark, v), D, threshold, block_bytes=block_bytes).collect()
    assert len(got) == len(want) and {(r.doc_id, r.other_id): r.score for r in got} == want
    assert B.pairs_above(table_of(spark, v).where("false"), D, threshold).collect() == []


@pytest.mark.parametrize("dims, threshold", [(64, 0.4), (128, 0.75), (128, 0.004), (192, 0.5)])
def test_pairs_have_rounded_scores_and_bytes_never_overflow(spark, dims, threshold):
    """Full vectors with copies and opposites have the largest products there are; rounding is that of Spark."""
    rng = np.random.default_rng(31)
    v = np.where(rng.random((6, dims)) < 0.5, -1, 1).astype(np.int8)[rng.integers(0, 6, 100)]
    for row in v[20:]:
        at = rng.integers(0, dims, rng.integers(0, 20))
        row[at] = rng.integers(-1, 2, len(at))
    v[5:8], v[8] = v[4], -v[4]
    score = v.astype(int) @ v.astype(int).T / dims
    want = sorted((i, j, float(score[i, j])) for i in range(100) for j in range(100) if i != j and score[i, j] >= threshold)
    got = B.pairs_above(table_of(spark, v), dims, threshold, digits=6)
    assert sorted(map(tuple, B.pairs_above(table_of(spark, v), dims, threshold).collect())) == want
    rounded = spark.createDataFrame(want, "doc_id LONG, other_id LONG, score DOUBLE").withColumn("score", F.round("score", 6))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rounded.collect()))


def test_tasks_give_a_list_per_row_not_a_row_per_pair(spark, monkeypatch):
    v, rows, real = clustered(32, 150), [], B._compared
    monkeypatch.setattr(B, "_compared", lambda *a: rows.append(real(*a)) or rows[-1])
    pairs = B.pairs_above(table_of(spark, v), D, 0.4).count()
    assert rows[0].count() < pairs / 4


def test_pairs_above_of_float_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(f"d{i}", [float(y) for y in x]) for i, x in enumerate(v)], "doc_id STRING, vec ARRAY<DOUBLE>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(f"d{i}", f"d{j}") for i in range(60) for j in range(60) if i != j and unit[i] @ unit[j] >= 0.5}
    assert {(r.doc_id, r.other_id) for r in B.pairs_above(df, 5, 0.5, "cosine", 400).collect()} == want


def test_no_vector_of_a_self_join_is_collected(spark, monkeypatch):
    v = clustered(3, 80)
    monkeypatch.setattr(S, "_scan", None)
    monkeypatch.setattr(S, "_scan_probes", None)
    got = Dup.similar_pairs(table_of(spark, v), D, None, 0.5).collect()
    first = {i: min(j for j in range(80) if (v[j] == v[i]).all()) for i in range(80)}
    score = v.astype(int) @ v.astype(int).T / D
    want = {(i, j) for i in range(80) for j in range(80) if i != j and score[i, j] >= 0.5
            and ((first[i] == i and first[j] == j) or first[i] == j or first[j] == i)}
    assert {(r.doc_id, r.other_id) for r in got} == want and len(got) == len(want)


def test_two_large_sides_meet_in_a_grid(spark):
    v, q = clustered(4, 90), clustered(5, 40)
    docs, probes = table_of(spark, v), table_of(spark, q, "query_id")
    small = 20 * (D * 4 + S.ID_BYTES)
    score = q.astype(int) @ v.astype(int).T / D
    want = {(i, d, round(score[i, d], 6)) for i in range(40) for d in sorted(range(90), key=lambda d: (-score[i, d], d))[:4] if score[i, d] >= 0.1}
    got = S.search_table(docs, probes, D, 4, 0.1, broadcast_bytes=small).collect()
    assert {(r.query_id, r.doc_id, round(r.score, 6)) for r in got} == want
    every = S.score_table(docs, probes, D, 0.3, broadcast_bytes=small).collect()
    assert {(r.query_id, r.doc_id) for r in every} == {(i, d) for i in range(40) for d in range(90) if score[i, d] >= 0.3}


# ---- inverted file -----------------------------------------------------------------------------

def brute_inverted(v, q, cells, near):
    """The documents that each probe meets: centroids, cells and probed cells one by one."""
    import hashlib
    order = sorted(range(len(v)), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    s = v[order].astype(int)
    c = s[:cells].copy()

    def closeness(x, y):
        return (x @ y) / np.sqrt(max(1, np.count_nonzero(y)))

    for _ in range(I.ROUNDS):
        home = [max(range(cells), key=lambda j: (closeness(x, c[j]), -j)) for x in s]
        for j in range(cells):
            own = [x for x, h in zip(s, home, strict=True) if h == j]
            if own:
                c[j] = np.sign(np.sum(own, axis=0))
    at = [max(range(cells), key=lambda j: (closeness(x.astype(int), c[j]), -j)) for x in v]
    return [[i for i in range(len(v)) if at[i] in sorted(range(cells), key=lambda j: (-closeness(p.astype(int), c[j]), j))[:near]] for p in q]


@pytest.mark.parametrize("part_rows, chunk", [(32_768, 4096), (7, 3)])
def test_inverted_file_matches_brute_force(spark, monkeypatch, part_rows, chunk):
    monkeypatch.setattr(I, "PART_ROWS", part_rows)
    monkeypatch.setattr(I, "CHUNK_PROBES", chunk)
    v, q = clustered(6, 200), clustered(7, 25)
    index = I.build(table_of(spark, v), D, shared_folder(spark, "inverted-test"), cells=14)
    probes = table_of(spark, q, "query_id")
    meets = brute_inverted(v, q, 14, 3)
    score = q.astype(int) @ v.astype(int).T / D
    want = {(i, d, rank) for i in range(25) for rank, d in enumerate(sorted((d for d in meets[i] if score[i, d] >= 0.05), key=lambda d: (-score[i, d], d))[:5], 1)}
    got = I.search(index, probes, 5, 3, 0.05).collect()
    assert {(r.query_id, r.doc_id, r.rank) for r in got} == want and len(got) == len(want)
    assert {r.query_id: r.candidates for r in I.candidates(index, probes, 3).collect()} == {i: len(m) for i, m in enumerate(meets)}
    one = I.search_one(spark, index, q[0].tobytes(), 5, 3, threshold=0.05).collect()
    assert {(0, r.doc_id, r.rank) for r in one} == {w for w in want if w[0] == 0}
    assert "PartitionFilters: [" in I.search_one(spark, index, q[0].tobytes(), 5, 3)._jdf.queryExecution().toString()


def test_inverted_file_reaches_its_recall(spark):
    v, q = clustered(8, 3000, 60, 20), clustered(8, 3000, 60, 20)[::50]
    index = I.build(table_of(spark, v), D, shared_folder(spark, "inverted-test"))
    cells = I.cells_for(3000)
    got = collections.defaultdict(set)
    for r in I.search(index, table_of(spark, q, "query_id"), 10, cells // 25, None).collect():
        got[r.query_id].add(round(r.score * D))
    score = q.astype(int) @ v.astype(int).T
    hits = [max(got[i]) == score[i].max() for i in range(len(q))]
    assert np.mean(hits) >= 0.9
    share = I.candidates(index, table_of(spark, q, "query_id"), cells // 25).agg(F.avg("candidates")).first()[0] / 3000
    assert share < 0.08


def test_inverted_file_of_nothing(spark):
    none = table_of(spark, clustered(1, 10)).where("false")
    index = I.build(none, D, shared_folder(spark, "inverted-test"), cells=4)
    assert index.centroids(spark).shape == (0, D)


# ---- phrases -----------------------------------------------------------------------------------

@pytest.mark.parametrize("most", [1 << 20, 4])
def test_phrases_in_slices(spark, monkeypatch, most):
    monkeypatch.setattr(P, "SLICE_CHARS", most)
    monkeypatch.setattr(P, "SLICE_WORDS", most)
    monkeypatch.setattr(P, "EMIT", 3)
    docs = [(1, "aa aaa, AA"), (2, None), (3, ""), (1, "aa aaa, AA"), (4, "b " * 5000 + "aaa")]
    asks = [("x", "aa"), ("y", "AA"), ("z", "a a"), ("n", None), ("e", ""), ("p", "b b")]
    d = spark.createDataFrame(docs, "doc_id INT, text STRING")
    q = spark.createDataFrame(asks, "query_id STRING, phrase STRING")
    norm = {0: "aa aaa aa", 3: "aa aaa aa", 4: ("b " * 5000 + "aaa")}
    want = sorted((name, docs[k][0], i + 1) for name, p in asks if p for k, t in norm.items() for i in range(len(t)) if t.startswith(p.lower(), i))
    got = C.locate_phrases(d, q, 2).collect()
    assert sorted((r.query_id, r.doc_id, r.position) for r in got) == want
    assert {r.context for r in got if r.query_id == "x" and r.doc_id == 1 and r.position == 4} == {"a aaa "}
    assert C.locate_phrases(d, q.where("false")).collect() == []
    u = spark.createDataFrame([(1, 0, ["a", "b", "c"]), (2, 0, []), (3, 1, None), (4, 0, ["c", "c", "z"])], "doc_id INT, unit INT, words ARRAY<STRING>")
    w = spark.createDataFrame([("q", ["a", "c", "c", "y"]), ("r", []), ("s", None), ("t", ["z"])], "query_id STRING, words ARRAY<STRING>")
    assert sorted((r.query_id, r.unit_id, round(r.overlap, 3)) for r in C.overlap_matches(u, w, 0.3).collect()) == [
        ("q", "1-0", 0.667), ("q", "4-0", 0.333), ("t", "4-0", 1.0)]


# ---- grids ---------------------------------------------------------------------------------------

def test_grids_of_three_by_three(spark):
    rng = random.Random(5)
    cells, want = [], {}
    for m in range(60):
        rule, mr, mc = rng.choice(["union", "intersection", "xor", "progression"]), rng.randint(1, 3), rng.randint(1, 3)
        held = {(r, c): sorted(rng.sample(R.SHAPES, rng.randint(0, 5))) for r in (1, 2, 3) for c in (1, 2, 3) if rng.random() < 0.8 or m % 3 == 0}
        cells += [(m, rule, mr, mc, r, c, s, len(s), "black", (r, c) != (mr, mc)) for (r, c), s in held.items()]
        seen = {k: set(s) for k, s in held.items() if k != (mr, mc)}
        row, col = [s for (r, _), s in seen.items() if r == mr], [s for (_, c), s in seen.items() if c == mc]
        row, col = (set.intersection(*x) if x else set() for x in (row, col))
        shapes = {"union": row | col, "intersection": row & col, "progression": set(R.SHAPES[:min(mr + mc - 1, 5)]),
                  "xor": {s for i, s in enumerate(R.XOR_SHAPES) if (mr ^ mc) >> i & 1}}[rule]
        if held:
            want[m] = sorted(shapes)
    df = spark.createDataFrame(cells, "matrix_id INT, rule STRING, missing_row INT, missing_col INT, row INT, col INT, shapes ARRAY<STRING>, count INT, "
                               "color STRING, visible BOOLEAN").repartition(4)
    assert {r.matrix_id: list(r.shapes) for r in R.complete_cells(df).collect()} == want
    assert all(r["count"] == len(r.shapes) for r in R.complete_cells(df).collect())
    truth = {(c[0]): (c[6], c[8]) for c in cells if not c[9]}
    got = {r.matrix_id: (list(r.shapes), r.color) for r in R.complete_cells(df).collect()}
    judged = {r.matrix_id: r.correct for r in R.judge_cells(df).collect()}
    assert judged == {m: got[m] == t for m, t in truth.items()} and len(judged) < 60
    plan = R.judge_cells(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    with pytest.raises(Exception, match="unknown shapes"):
        R.complete_cells(df.withColumn("shapes", F.array(F.lit("cube")))).collect()


def test_spread(spark):
    few = spark.range(100).coalesce(1)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(few).count() == 100


def test_pairs_of_blocks_are_dealt_evenly(spark):
    v = clustered(21, 240)
    got = B.pairs_above(table_of(spark, v), D, -2.0, block_bytes=20 * D).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert sum(r["count"] for r in got) == 240 * 239
    assert max(r["count"] for r in got) < 240 * 239 * 0.05                      # 78 pairs of 12 blocks


@pytest.mark.parametrize("block_bytes", [8 << 20, 900])
def test_links_above_have_the_groups_of_all_pairs(spark, block_bytes):
    v = clustered(22, 150)
    df = table_of(spark, v)
    pairs, links = (f(df, D, 0.6, block_bytes=block_bytes) for f in (B.pairs_above, B.links_above))
    assert links.count() < pairs.count() / 2
    want, got = ({r.doc_id: r.group for r in Dup.connected_groups(df.select("doc_id"), e).collect()} for e in (pairs, links))
    assert got == want and len(set(got.values())) > 5


@pytest.mark.parametrize("block_bytes, threshold", [(8 << 20, 0.5), (900, 0.5), (900, 0.7)])
def test_leaders_above_match_the_greedy_order(spark, block_bytes, threshold, monkeypatch):
    monkeypatch.setattr(B, "STEP", 7)
    v = clustered(23, 150, flips=20)
    score, heads, want = v.astype(int) @ v.astype(int).T / D, [], {}
    for i in range(150):
        if score[i].max() >= threshold:
            want[i] = next((h for h in heads if score[i, h] >= threshold), i)
            heads += [i] if want[i] == i else []
    got = {r.doc_id: r.leader for r in B.leaders_above(table_of(spark, v), D, threshold, block_bytes=block_bytes).collect()}
    assert {i: h for i, h in got.items() if i != h} == {i: h for i, h in want.items() if i != h} and set(want) <= set(got)
    assert B.leaders_above(table_of(spark, v).where("false"), D, threshold).collect() == []


def test_groups_and_clusters_make_no_list_of_pairs(spark, monkeypatch):
    df = table_of(spark, clustered(24, 60))
    monkeypatch.setattr(B, "pairs_above", None)
    assert Dup.duplicate_groups(df, D, 0.6).count() and Dup.greedy_duplicates(df, D, 0.6).count()


@pytest.mark.parametrize("k, exclude_self", [(1, True), (7, False)])
def test_copies_are_compared_once(spark, monkeypatch, k, exclude_self):
    v = np.concatenate([clustered(25, 60)] * 5)
    docs, probes = table_of(spark, v), table_of(spark, v, "query_id")
    want = S.search_table(docs, probes, D, k, None, exclude_self=exclude_self).collect()
    seen, real = [], S.search_table
    monkeypatch.setattr(S, "search_table", lambda c, p, *a, **b: seen.append((c.count(), p.count())) or real(c, p, *a, **b))
    got = S.search_classes(docs, probes, D, k, None, exclude_self=exclude_self).collect()
    assert sorted(map(tuple, (r.asDict().values() for r in got))) == sorted(map(tuple, (r.asDict().values() for r in want)))
    n = len(np.unique(v, axis=0))
    assert seen == [(n * min(5, k + exclude_self) + sum(max(0, min(c, k + exclude_self) - 5) for c in np.unique(v, axis=0, return_counts=True)[1]), n)]


@pytest.mark.parametrize("take", [1, 3, 9])
def test_first_columns_are_those_of_a_stable_sort(take):
    rng = np.random.default_rng(26)
    known, asks = rng.integers(-1, 2, (50, 8)).astype(np.int8), rng.integers(-1, 2, (20, 8)).astype(np.int8)
    score = asks.astype(int) @ known.astype(int).T / 8
    want = np.argsort(-score, axis=1, kind="stable")[:, :take]
    order, best = S._first_columns("dot", asks, known.astype(np.float32), take, True)
    assert (order == want).all() and (best == np.take_along_axis(score, want, axis=1)).all()


@pytest.mark.parametrize("block_bytes", [8 << 20, 900])
def test_a_large_group_costs_a_link_per_document_not_per_pair_of_blocks(spark, block_bytes):
    """300 documents of one group in up to 22 blocks, with pivots first; a chain through documents that no pivot reaches is kept."""
    rng = np.random.default_rng(33)
    v = np.repeat(rng.integers(-1, 2, (1, D)), 300, axis=0).astype(np.int8)
    for row in v:
        row[rng.integers(0, D, 3)] = 0
    v = np.concatenate([v, clustered(34, 20, groups=9)])
    df = table_of(spark, v)
    links = B.links_above(df, D, 0.45, block_bytes=block_bytes)
    assert links.count() < 1600
    got, want = ({r.doc_id: r.group for r in Dup.connected_groups(df.select("doc_id"), e).collect()} for e in (links, B.pairs_above(df, D, 0.45)))
    assert got == want and 3 < len(set(got.values())) < 20
    assert B.links_above(df.where("false"), D, 0.45).collect() == []


@pytest.mark.parametrize("few", [1e9, 3.0, -1.0])
def test_the_rest_of_the_order_is_decided_by_its_links(spark, few, monkeypatch):
    """Blocks of 20 rows: one round and then the links, rounds until few links are left, or rounds alone give the same leaders."""
    monkeypatch.setattr(B, "DECIDED", 20)
    monkeypatch.setattr(B, "FEW_LINKS", few)
    listed = []
    links = B.earlier_links
    monkeypatch.setattr(B, "earlier_links", lambda *a: listed.append(1) or links(*a))
    v = np.unique(clustered(35, 220, flips=20), axis=0)
    v = v[np.random.default_rng(36).permutation(len(v))]
    score, heads, want = v.astype(int) @ v.astype(int).T / D, [], {}
    for i in range(len(v)):
        if score[i].max() >= 0.5:
            want[i] = next((h for h in heads if score[i, h] >= 0.5), i)
            heads += [i] if want[i] == i else []
    got = [tuple(r) for r in B.leaders_above(table_of(spark, v), D, 0.5).collect()]
    assert sorted(got) == sorted(want.items()) and len(set(want.values())) < len(want)
    assert bool(listed) == (few > 0)
