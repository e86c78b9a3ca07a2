"""Similarity join, hard negatives and the filter audit against brute force, on odd rows and on hot groups."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ternweave.llm import filter_audit, hard_negatives, jaccard_join

DOCS = "doc_id LONG, text STRING, source STRING, region STRING, class LONG, node LONG, mark STRING, part STRING, mask STRING"
LONG = "und die Katze sitzt " * 20_000
ODD = [(1, "the cat sat on the mat", "a", "x", 1, 1, "m", "p", "q"), (1, "the cat sat on the mat", "a", "x", 1, 1, "m", "p", "q"),
       (2, None, None, None, None, None, None, None, None), (3, "", "", None, None, None, None, None, None),
       (None, "THE cat\tsat  on the mat", "b", "", 0, 0, "", "", ""), (None, None, None, None, None, None, None, None, None),
       (4, LONG, "a", "x", 1, 1, "", "", ""), (5, " \x0b\x0c", "a", "x", 1, 1, "", "", ""), (6, "one two", "b", "x", 1, 1, "", "", ""),
       (7, "ONE\ntwo ", "b", "x", 1, 1, "", "", ""), (8, "one two", "c", "x", 1, 1, "", "", ""), (9, LONG + "x", "a", "", 0, 0, "", "", "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(7)


# ---- 11 --------------------------------------------------------------------------------------

def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), least.get(root(k))) for k, (i, s) in enumerate(sets)), key=str)


def joined(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_components(df).collect()), key=str)


def test_similarity_join_of_odd_rows(spark, odd):
    assert joined(odd) == brute_components([(r[0], r[1]) for r in ODD])
    assert joined(odd.where("false")) == []
    assert joined(odd.where("text is null")) == [(2, 0, 2), (None, 0, None)]


def edited(rng, words, share):
    return [w if rng.random() > share else rng.choice("pqrstuvwxyz") * 3 for w in words]


def near_groups(rng):
    """Chains at the edge of the threshold, a large group of near copies, and texts that share most of a passage."""
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, passage = [], rng.choices(vocabulary, k=30)
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([6, 25, 60, 120]))
        for _ in range(6):
            base = edited(rng, base, 0.025)
            rows.append(base)
    big = rng.choices(vocabulary, k=80)
    rows += [edited(rng, big, rng.choice([0, 0.01, 0.02, 0.05])) for _ in range(90)]
    rows += [passage + rng.choices(vocabulary, k=rng.choice([2, 6, 9, 20])) for _ in range(80)]
    rows += [rng.choices(vocabulary[:5], k=rng.randint(1, 9)) for _ in range(60)]
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_similarity_join_matches_brute_force(spark):
    rows = near_groups(random.Random(3))
    want = brute_components(rows)
    assert len({c for *_, c in want}) < len(rows) - 100
    assert joined(docs_of(spark, rows)) == want


@pytest.mark.parametrize("small, levels, spread, cell", [(2, 4, 2.0, 10), (2, 1, 9.0, 7), (3, 0, 2.0, 16), (2, 4, 9.0, 3)])
def test_every_way_through_the_regions_is_exact(spark, monkeypatch, small, levels, spread, cell):
    for name, value in (("PIVOT_ROUNDS", 0), ("SMALL", small), ("LEVELS", levels), ("SPREAD", spread), ("CELL", cell)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_groups(random.Random(small + levels))
    assert joined(docs_of(spark, rows)) == brute_components(rows)


def test_pairs_of_near_copies_are_compared_once(spark, monkeypatch):
    """Near copies share many of their rarest shingles, but a pair of them is formed for one of these alone."""
    rng, made, cells = random.Random(8), [], jaccard_join._cells
    base = [f"v{i}" for i in range(140)]
    rows = [(i, " ".join(edited(rng, base, 0.04))) for i in range(120)] + [(i, f"one of {i} texts of its own") for i in range(120, 140)]

    def counted(*args):
        made.append(cells(*args).count())
        return cells(*args)
    monkeypatch.setattr(jaccard_join, "_cells", counted)
    monkeypatch.setattr(jaccard_join, "PIVOT_ROUNDS", 0)
    assert joined(docs_of(spark, rows)) == brute_components(rows)
    assert 0 < sum(made) <= 120 * 119 // 2


def test_regions_of_the_same_sets_are_one(spark):
    """Sets that meet in a region and may be linked still meet; no region is there twice, and gathered ones form no more pairs."""
    rng, met = random.Random(4), []
    for r in range(60):
        met += [(r, i, 100) for i in range(40) if rng.random() < 0.9] + [(100 + r, 50 + r % 3, 90), (100 + r, 60 + r % 2, 100)]
        met += [(200 + r, 70, 50), (200 + r, 71, 100), (300 + r, r, 100)]
    of = collections.defaultdict(set)
    for r, i, _ in met:
        of[r].add(i)
    want = {p for m in of.values() for p in itertools.combinations(sorted(m), 2)} - {(70, 71)}       # 50 of 100 shingles at most
    told = jaccard_join._told_apart(spark.createDataFrame(met, "region LONG, node LONG, held LONG").repartition(5), len(met))
    for rows, most in ((told, 66), (jaccard_join._gathered(told, told.count()), 7)):
        regions = collections.defaultdict(set)
        for r in rows.collect():
            regions[r.region].add(r.node)
        assert {p for m in regions.values() for p in itertools.combinations(sorted(m), 2)} == want
        assert len({frozenset(m) for m in regions.values()}) == len(regions) <= most


def test_words_are_hashed_as_they_are_split():
    rng, sets = random.Random(5), jaccard_join.Sets()
    odd = [b"", b" ", b"A b", b"a B\t", b"a b c d e", b"A b\x0bc\r\nd e F", b"\xc2\xa0 A", b"x" * 5000 + b" Y", b"X" * 5000 + b" y", b"w" * 300_000 + b" k l m n o p" * 30_000]
    texts = odd + [b" ".join(rng.choice([b"Aa", b"aa", b"b", b"cc", b"\xc3\xa9"]) for _ in range(rng.randrange(40))) for _ in range(200)]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    want = [shingles(t) for t in texts]
    flat, size = sets.of(texts)
    assert size.tolist() == [len(x) for x in want]
    assert len(set(flat.tolist())) == len(set().union(*want))
    parts = np.split(flat, np.cumsum(size)[:-1])
    for t, p in zip(texts, parts, strict=True):                               # whatever else is in the batch
        assert sets.of([t])[0].tolist() == p.tolist()


def test_folds_of_long_sets_rule_out_what_is_not_linked():
    rng = np.random.default_rng(3)
    sets, items = [], rng.integers(0, 2 ** 63, 60_000).astype(np.uint64)
    for n, same in ((9000, 0), (9000, 8000), (9000, 6500), (7500, 7400), (300, 290), (240, 235), (100, 0)):
        sets.append(np.sort(np.concatenate([items[:same], rng.integers(0, 2 ** 63, n - same).astype(np.uint64)])))
    folds = jaccard_join.Folds(pa.array([jaccard_join.fold(x).tobytes() for x in sets], pa.binary()))
    size, rows = np.array([len(x) for x in sets]), np.arange(len(sets))
    for i, x in enumerate(sets):
        left = set(jaccard_join.near_rows(folds, i, size[i], folds, rows, size).tolist())
        linked = {j for j, y in enumerate(sets) if jaccard_join.linked(jaccard_join.common_size(x, y), len(x), len(y))}
        assert linked <= left
        assert left <= {j for j, y in enumerate(sets) if 100 * jaccard_join.common_size(x, y) >= 70 * (len(x) + len(y) - jaccard_join.common_size(x, y))}
    assert jaccard_join.may_link(folds.base[0], size[0], folds.base[1], size[1])       # which short folds do not


def test_pairs_are_listed_where_sizes_may_link_and_folds_are_a_bit_a_cell(spark):
    """Pairs move with their folds, so few of them and short ones are moved."""
    size = [100, 81, 80, 79, 300, 240, 20]
    rows = spark.createDataFrame([(1, i, i, n, True) for i, n in enumerate(size)], "region LONG, node LONG, class LONG, held LONG, home BOOLEAN")
    want = {(a, b) for a, b in itertools.combinations(range(7), 2) if 100 * min(size[a], size[b]) >= 80 * max(size[a], size[b])}
    assert {(r.a, r.b) for r in jaccard_join._pairs_within(rows).collect()} == want
    tops = spark.createDataFrame([(1, (7, 0, 0, 100), 7)], "region LONG, top STRUCT<n: LONG, node: LONG, class: LONG, held: LONG>, n LONG")
    assert {(r.a, r.b) for r in jaccard_join._pivot_pairs(rows, tops, 7).collect()} == {(1, 0), (2, 0)}
    items = np.random.default_rng(6).integers(0, 2 ** 63, 700).astype(np.uint64)
    assert [len(jaccard_join.fold(items[:n]).tobytes()) for n in (0, 1, 512, 513, 700)] == [64, 64, 64, 128, 128]
    folds = jaccard_join.Folds(pa.array([jaccard_join.fold(items[a:b]).tobytes() for a, b in ((0, 700), (60, 640), (300, 700), (0, 0))], pa.binary()))
    n = np.array([700, 580, 400, 0])
    keep = [jaccard_join.near_pairs(folds, n, jaccard_join.Folds(pa.array([folds.own[0].tobytes()] * 4, pa.binary())), np.full(4, 700))]
    assert [x.tolist() for x in keep] == [[True, True, False, False]]


def test_voronoi_windows_lose_no_link(spark):
    """Every linked pair meets in a region in which one of them is at home."""
    rng = random.Random(9)
    base = [f"v{i}" for i in range(40)]
    texts = [" ".join(edited(rng, base, rng.choice([0, 0.02, 0.1]))) for _ in range(60)]
    sets, size = jaccard_join.Sets().of([t.encode() for t in texts])
    sets = np.split(sets, np.cumsum(size)[:-1])
    rows = spark.createDataFrame([(1, i, i, True, 60) for i in range(60)], "region LONG, node LONG, class LONG, home BOOLEAN, n LONG")
    held = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node LONG, items BINARY")
    homes, guests = {}, collections.defaultdict(set)
    for r in jaccard_join.voronoi(rows, 60, held, 0).collect():
        for to, stays in zip(r.to, r.stays, strict=True):
            guests[to].add(r.node)
            if stays:
                homes[r.node] = to
    assert len(homes) == 60
    for a, b in itertools.permutations(range(60), 2):
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        if 100 * len(x & y) >= 80 * len(x | y):
            assert b in guests[homes[a]]


# ---- 12 --------------------------------------------------------------------------------------

def brute_negatives(rows, every=50):
    own = [(k, i, lab, np.floor(256 * np.array(v, float)).astype(int)) for k, (i, v, lab) in enumerate(rows)
           if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    last = 2 ** 63
    out = []
    for k, i, lab, v in own:
        if i is None or i % every:
            continue
        scored = sorted(((-int(v @ w), last if j is None else j, m, other) for m, j, other, w in own if m != k))
        for s, j, _, _ in [x for x in scored if x[3] == lab][:5]:
            fits = [x for x in scored if x[3] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, None if j == last else j, r, None if x[1] == last else x[1], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out, key=str)


def mined(df, **options):
    return sorted((tuple(r) for r in hard_negatives.hard_negatives(df, **options).collect()), key=str)


VECTORS = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, leaf STRING, row STRING, anchor STRING"


def test_hard_negatives_of_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (50, [0.5, 1.0], 2), (100, None, 1), (150, [1.0, None], 1), (200, [1.0, float("nan")], 1),
            (250, [1.0, 0.0], None), (None, [0.9, 0.4], 1), (None, [0.5, 0.5], 2), (3, [float("inf"), 1.0], 2), (4, [0.7, 0.3], 2), (5, [0.7, 0.3], 2),
            (6, [0.4, 0.4], 3), (7, [-0.1, 0.9], 1), (300, [], 1), (8, [0.6, 0.6], 2)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS)
    padded = [(i, None if v is None else v + [0.0] * (2 - len(v)), lab) for i, v, lab in rows]
    want = brute_negatives(padded)
    assert want and mined(df) == want
    assert mined(df.where("false")) == [] and mined(df.where("label is null")) == []


@pytest.mark.parametrize("leaf_rows, scale", [(40, 1.0), (4096, 1.0), (40, 3000.0)])
def test_hard_negatives_match_brute_force(spark, leaf_rows, scale):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 12))
    v = np.concatenate([centres[rng.integers(0, 20, 500)] + 0.2 * rng.normal(size=(500, 12)), np.repeat(centres[:1], 300, 0)]) * scale
    rows = [(i, [float(np.float32(x)) for x in w], int(rng.integers(0, 4))) for i, w in enumerate(v)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS).repartition(5)
    assert mined(df, leaf_rows=leaf_rows) == brute_negatives(rows)


def test_tree_leaves_out_only_what_cannot_score(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16)) * 200
    x = np.floor(centres[rng.integers(0, 30, 900)] + 5 * rng.normal(size=(900, 16))).astype(np.int64)
    tree = hard_negatives.Tree(x[:300], 30)

    def seen(node, low, high):
        np.minimum(tree.low[node], low, out=tree.low[node])
        np.maximum(tree.high[node], high, out=tree.high[node])

    leaf = tree.place(x, seen)
    score = x[:50] @ x.T
    least, most = np.quantile(score, 0.9, axis=1), np.quantile(score, 0.96, axis=1)
    visited = tree.survivors(x[:50], least, most)
    for i in range(50):
        assert set(leaf[(score[i] >= least[i]) & (score[i] <= most[i])]) <= set(visited[i].tolist())
    assert tree.leaves >= 20 and sum(map(len, visited)) < 0.4 * 50 * tree.leaves


# ---- 13 --------------------------------------------------------------------------------------

def brute_audit(rows, labels):
    texts, first = [(i, p or "", t or "") for i, t, p in rows], {}
    for i, _, t in texts:
        if i is not None:
            first[t] = min(i, first.get(t, i))

    def fails(i, t):
        w = [x for x in t.encode().split()]
        out = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t))
        out += "D" * any(c in "#$%&*|" for c in t)
        return out + "E" * (t in first and (i is None or i > first[t]))

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {p for _, p, _ in texts}:
        own = [(fails(i, t), i in good, i in toxic) for i, p, t in texts if p == part]
        removed = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                removed[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in x[0] for x in own) - len(gone), sum(x[0] == f for x in own),
                                          sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(docs, labels, **options):
    rows = filter_audit.filter_audit(docs, labels, **options).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id LONG, quality INT, toxic INT")


def test_filter_audit_of_odd_rows(spark, odd):
    labels = [(1, 1, 0), (1, 0, None), (2, 1, 1), (None, 1, 1), (6, None, 1), (7, 1, 0), (9, 0, 1), (99, 1, 1)]
    want = brute_audit([(r[0], r[1], r[2]) for r in ODD], labels)
    assert audited(odd, labels_of(spark, labels)) == want
    assert audited(odd.where("false"), labels_of(spark, labels)) == {}
    assert audited(odd, labels_of(spark, []))["a", "ABCDE", 1][0] == want["a", "ABCDE", 1][0]


@pytest.mark.parametrize("counters", [2 ** 15, 2 ** 28])
def test_filter_audit_matches_brute_force(spark, counters):
    rng = random.Random(8)
    hot = " ".join(rng.choices("abcdefgh", k=60))
    rows = []
    for i in range(600):
        words = [rng.choice(["", "A", "Zz", "ü", "#"]) * (rng.random() < 0.05) + f"w{rng.randint(0, rng.choice([3, 400]))}" for _ in range(rng.choice([3, 49, 50, 51, 90]))]
        rows.append((rng.randint(0, 700), hot if i % 3 == 0 else " ".join(words) if rng.random() < 0.8 or not rows else rng.choice(rows)[1],
                     rng.choice(["x", "y", "", None])))
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 700, 2)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING").repartition(6)
    assert audited(docs, labels_of(spark, labels), max_counters=counters) == brute_audit([(i, t, s) for i, t, s in rows], labels)


def test_the_sketch_lets_no_repeated_text_go(spark):
    rows = spark.range(3000).select((F.col("id") % 1700).cast("string").cast("binary").alias("digest"))
    for segments in (1, 4):
        sketch = filter_audit.counting_sketch(rows.repartition(5), "digest", segments)
        left = filter_audit.may_repeat(rows, "digest", sketch, segments).groupBy("digest").count()
        assert left.where("count = 2").count() == 1300
        assert segments == 1 or left.count() < 1500


def test_masks_of_texts_in_bytes():
    texts = ["", "Ä" * 30 + "AB", "x" * 38 + "AB", "x" * 39 + "A|", "  a", "ẞ A"]
    got = filter_audit.text_masks(pa.array(["skipped", *texts]).slice(1)) & 12
    assert got.tolist() == [0, 4, 0, 8, 0, 4]
