import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ternweave.functions import bands as B
from ternweave.functions import metrics as M
from ternweave.functions import text as X
from ternweave.operators import corpus as C
from ternweave.operators import duplicates as Dup
from ternweave.operators import graphs as G
from ternweave.operators import rules as R
from ternweave.operators import scoring as Sc
from ternweave.operators import sessions as Se
from ternweave.sources import documents as Docs
from ternweave.sources.store import DocumentStore
from ternweave.streaming import jobs as J
from ternweave.operators.encode import encode_json, encode_row


def test_units_counters(spark):
    text = ("First sentence here. Second one follows! Tiny.\n\nNext paragraph starts now.\n\nChapter two\n\n"
            "After the header we go on. ... --- !!! ???\n\n  \n\nLast paragraph of it all.")
    got = C.units(spark.createDataFrame([(1, text)], "doc_id INT, text STRING")).orderBy("unit").collect()
    assert [(r.unit, r.chapter, r.paragraph, r.page, r.sentence_index) for r in got] == [
        (0, 1, 1, 1, 0), (1, 1, 1, 1, 1), (2, 1, 2, 1, 0), (3, 2, 1, 1, 0), (4, 2, 2, 1, 0)]
    assert got[0].words == ["first", "sentence", "here"]
    many = " ".join(f"This is sentence number {i}." for i in range(120))
    pages = C.units(spark.createDataFrame([(1, many)], "doc_id INT, text STRING")).groupBy("page").count().collect()
    assert {r.page: r["count"] for r in pages} == {1: 50, 2: 50, 3: 20}


def test_phrase_positions_overlap(spark):
    rows = [("aaaa", "aa", [1, 2, 3]), ("abcabc", "abc", [1, 4]), ("xabcx", "abc", [2]), ("xyz", "q", []), ("é é é", "é é", [1, 3])]
    got = spark.createDataFrame([(t, p) for t, p, _ in rows], "t STRING, p STRING").select(
        X.phrase_positions(F.col("t"), F.col("p")).alias("r")).collect()
    assert [list(r.r) for r in got] == [w for *_, w in rows]


def test_locate_matches_brute_force(spark):
    rng = random.Random(3)
    words = ["an", "ban", "band", "and", "a", "nd", "bandana"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(60)]
    phrases = [(0, "an"), (1, "and a"), (2, "n band a"), (3, "a nd and ban"), (4, "nothing at all"), (5, "d")]
    want = sorted((q, d, i + 1) for q, p in phrases for d, t in docs for i in range(len(t)) if t.startswith(p, i))
    got = C.locate_phrases(spark.createDataFrame(docs, "doc_id INT, text STRING"),
                           spark.createDataFrame(phrases, "query_id INT, phrase STRING")).collect()
    assert sorted((r.query_id, r.doc_id, r.position) for r in got) == want


def test_overlap_matches_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(25)] + ["the"] * 10
    units = [(i, 0, rng.choices(vocab, k=rng.randint(1, 15))) for i in range(200)]
    qs = [(i, rng.choices(vocab, k=rng.randint(1, 10))) for i in range(15)]
    u = spark.createDataFrame(units, "doc_id INT, unit INT, words ARRAY<STRING>")
    q = spark.createDataFrame(qs, "query_id INT, words ARRAY<STRING>")
    for t in (0.3, 0.5, 1.0):
        want = sorted((i, f"{d}-0") for i, w in qs for d, _, x in units if len(set(w) & set(x)) / len(set(w)) >= t)
        got = sorted((r.query_id, r.unit_id) for r in C.overlap_matches(u, q, t).collect())
        assert got == want


def test_text_words(spark):
    r = spark.createDataFrame([("Hello, World!  It's  naïve_x 42",)], "t STRING").select(X.words(F.col("t")).alias("w")).first()
    assert r.w == ["hello", "world", "it", "s", "naïve_x", "42"]


GRAPHS = {
    "star": [("c", x) for x in "abde"], "cycle": [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")],
    "complete": [(a, b) for a in "abcd" for b in "abcd" if a < b],
    "tree": [("r", "x"), ("r", "y"), ("x", "p"), ("x", "q"), ("y", "s"), ("y", "t")], "chain": [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")],
}


@pytest.fixture(scope="module")
def graphs(spark):
    e = spark.createDataFrame([(g, a, b, "connects") for g, es in GRAPHS.items() for a, b in es], "graph_id STRING, src STRING, dst STRING, label STRING")
    nodes = sorted({(g, x) for g, es in GRAPHS.items() for ab in es for x in ab} | {("lonely", "z"), ("lonely", "y")})
    n = spark.createDataFrame(nodes, "graph_id STRING, node STRING")
    g = spark.createDataFrame([(x, "undirected") for x in [*GRAPHS, "lonely"]], "graph_id STRING, type STRING")
    return n, e, g


def test_graph_features(graphs):
    f = {r.graph_id: r for r in G.features(*graphs).collect()}
    assert {k: v.topology_type for k, v in f.items()} == {
        "star": "star", "cycle": "cycle", "complete": "complete", "tree": "tree", "chain": "tree", "lonely": "complex"}
    assert f["complete"].density == 1.0 and f["complete"].is_regular == 1 and f["chain"].is_tree == 1 and f["cycle"].is_cyclic == 1
    tri = {}
    for r in G.triangles(graphs[1]).collect():
        tri.setdefault(r.graph_id, set()).add((r.a, r.b, r.c))
    assert tri == {"complete": {("a", "b", "c"), ("a", "b", "d"), ("a", "c", "d"), ("b", "c", "d")}}
    assert {r.node: r.degree for r in G.degrees(*graphs[:2]).where("graph_id = 'lonely'").collect()} == {"y": 0, "z": 0}


def test_graph_vectors_and_similarity(graphs):
    v = {r.graph_id: np.frombuffer(r.vec, np.int8).astype(int) for r in G.graph_vectors(*graphs, 1024).collect()}
    assert set(v) == set(GRAPHS) | {"lonely"}
    f = G.features(*graphs)
    hits = G.similar_by_features(f, f.where("graph_id = 'tree'"), 2).orderBy("rank").collect()
    assert [r.graph_id for r in hits][0] == "tree" and hits[0].score == 1.0


def test_groups_and_greedy_clusters(spark):
    rng = random.Random(7)
    n = 120
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
    ids = sorted(set(range(n)) | {x for e in edges for x in e})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    v = spark.createDataFrame([(i,) for i in ids], "doc_id INT")
    e = spark.createDataFrame(edges, "doc_id INT, other_id INT")
    got = {r.doc_id: r.group for r in Dup.connected_groups(v, e).collect()}
    assert got == {i: find(i) for i in ids}

    hits = {}
    for a, b in edges:
        hits.setdefault(a, []).append(b)
    done, want = set(), {}
    for i in ids:
        if i in done:
            continue
        done.add(i)
        members = [b for b in hits.get(i, []) if b not in done and b != i]
        for b in members:
            if b not in done:
                done.add(b)
                want[b] = i
        if any(want.get(b) == i for b in members):
            want[i] = i
    got = {r.doc_id: r.leader for r in Dup.greedy_clusters(v, e).collect()}
    assert got == want


def test_copies_pair_with_their_leader(spark):
    base = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(60)], "doc_id INT, t STRING")
    c = base.withColumn("vec", encode_row("t", dims=256))
    same = [i for i in range(3, 60, 3)]
    pairs = {(r.doc_id, r.other_id) for r in Dup.similar_pairs(c, 256, None, 0.4).collect()}
    assert {p for p in pairs if p[0] % 3 == 0 and p[1] % 3 == 0} == {(0, i) for i in same} | {(i, 0) for i in same}
    g = Dup.duplicate_groups(c, 256, 0.4).collect()
    assert {r.doc_id for r in g} == {i for i in range(60) if i % 3 == 0} and {r.group for r in g} == {0}
    greedy = {r.doc_id: r.leader for r in Dup.greedy_duplicates(c, 256, 0.4).collect()}
    assert greedy == {i: 0 for i in range(0, 60, 3)}


def test_links_are_not_cut(spark):
    """Forty documents that all resemble each other: every pair is there."""
    c = spark.createDataFrame([(i, [f"w{j}" for j in range(30)] + [f"own{i}"]) for i in range(40)], "doc_id INT, t ARRAY<STRING>")
    c = c.withColumn("vec", encode_row("t", dims=1024))
    pairs = Dup.similar_pairs(c, 1024, None, 0.2).collect()
    assert len({(r.doc_id, r.other_id) for r in pairs}) == 40 * 39


def test_rules(spark):
    rows, cols = {1: {"circle"}, 2: {"square"}, 3: {"triangle"}}, {1: {"star"}, 2: {"diamond"}, 3: {"circle"}}
    panels = [("u", r, c, sorted(rows[r] | cols[c]), 2, "black") for r in rows for c in cols if (r, c) != (2, 2)]
    panels += [("i", 1, 2, ["circle", "star"], 2, "red"), ("i", 2, 1, ["star", "square"], 2, "red")]
    p = spark.createDataFrame(panels, "matrix_id STRING, row INT, col INT, shapes ARRAY<STRING>, count INT, color STRING")
    m = spark.createDataFrame([("u", "union", 2, 2), ("i", "intersection", 2, 2), ("p", "progression", 3, 3), ("x", "xor", 3, 1)],
                              "matrix_id STRING, rule STRING, missing_row INT, missing_col INT")
    got = {r.matrix_id: (list(r.shapes), r["count"], r.color) for r in R.complete(p, m).collect()}
    assert got["p"] == (["circle", "diamond", "square", "star", "triangle"], 5, "red")
    assert got["x"] == (["square"], 1, "black")
    assert got["i"] == (["star"], 1, "red")
    assert got["u"] == (["diamond", "square"], 2, "red")


def test_forward_chaining_reaches_the_fixpoint(spark):
    facts = spark.createDataFrame([(f"n{i}", "in", f"n{i + 1}") for i in range(12)], "subject STRING, relation STRING, object STRING")
    out = R.forward_chain(facts, [R.transitive("in")])
    assert out.count() == 12 * 13 // 2 and out.where("is_input").count() == 12
    with pytest.raises(RuntimeError, match="still follow"):
        R.forward_chain(facts, [R.transitive("in")], max_rounds=1)


def test_forward_chaining(spark):
    facts = spark.createDataFrame([("alice", "parent_of", "bob"), ("bob", "parent_of", "charlie")], "subject STRING, relation STRING, object STRING")
    rules = [R.implies("parent_of", "has_children")]
    out = R.forward_chain(facts, rules)
    assert sorted((r.subject, r.relation) for r in out.where("NOT is_input").collect()) == [("alice", "has_children"), ("bob", "has_children")]
    assert R.replay(out, rules).count() == out.count() == 4


def test_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "b")], "p STRING, t STRING")
    s = Sc.label_scores(df, "p", "t").first()
    assert (s.tp, s.fp, s.fn, s.accuracy) == (2, 2, 2, 0.5)
    t = spark.createDataFrame([(1, 1), (1, 2)], "query_id INT, doc_id INT")
    g = spark.createDataFrame([(1, 2), (1, 3), (2, 9)], "query_id INT, doc_id INT")
    r = {x.query_id: x for x in Sc.retrieval_scores(t, g).collect()}
    assert (r[1].precision, r[1].recall, r[2].recall) == (0.5, 0.5, 0.0)
    ci = Sc.confidence_interval(spark.createDataFrame([(1.0,), (0.0,)], "v DOUBLE"), "v").first()
    assert ci.mean == 0.5 and abs(ci.half_width - 1.96 * 0.5 / 2 ** 0.5) < 1e-12
    assert Se.latest(spark.createDataFrame([(1, 1, "x"), (1, 5, "y")], "k INT, t INT, v STRING"), "k", "t").first().v == "y"


def test_bands_at_limits(spark):
    cases = [("convergence_rate", 0.2, "slow_convergence"), ("convergence_rate", 0.95, "divergent"), ("iteration_complexity", 10.0, "moderate_complexity"),
             ("topological_distance", 10.0, "moderate_distance"), ("topological_distance", 2.0, "minimal_distance"),
             ("self_similarity", 0.8, "self_similarity_level_3"), ("self_similarity", 2.0, "self_similarity_level_7"),
             ("frequency_domain", float("nan"), "ultrasonic_frequency"), ("amplitude_scale", -1.0, "micro_scale")]
    for name, x, want in cases:
        r = spark.createDataFrame([(x,)], "x DOUBLE").select(B.primitive_label(name, F.col("x")).alias("l")).first()
        assert r.l == want, name
    with pytest.raises(ValueError):
        B.primitive_label("addition", F.lit(1))


def test_measures(spark):
    df = spark.createDataFrame([([1.0, -1.0, 1.0, -1.0, 0.0], [1.0, -1.0, 1.0, -1.0, 0.0]), ([1.0, 0.0], [0.0, 0.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    a, b = F.col("a"), F.col("b")
    r = df.select(M.cosine(a, b).alias("c"), M.cosine01(a, b).alias("d"), M.euclidean(a, b).alias("e")).collect()
    assert abs(r[0].c - 1) < 1e-12 and abs(r[0].d - 1) < 1e-12 and r[0].e == 1.0 and r[1].c == 0.0 and r[1].d == 0.0
    with pytest.raises(ValueError):
        M.multi_metric(a, b, {"cosine": 0.9})
    with pytest.raises(Exception, match="dimensions"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>").select(M.cosine(a, b)).collect()


def test_edn():
    d = Docs.edn_to_tagged('{:user "al\\"ice" :tags #{:b :a} :n [1 2.5 nil true] ; note\n #_ {:x 1} :c \\newline :t #inst "2020"}')
    assert d == {":user": 'al"ice', ":tags": {"#set": [":a", ":b"]}, ":n": [1, 2.5, None, True], ":c": "\n", ":t": "2020"}
    for bad in ("{:a", "{:a}", "[1 2", "]", "1 2", ""):
        with pytest.raises(ValueError):
            Docs.edn_to_tagged(bad)
    with pytest.raises(ValueError):
        Docs.check_data_type("xml")


def test_store_round_trip(spark, tmp_path):
    s = DocumentStore(spark, str(tmp_path / "s"), 128, buckets=4)
    assert s.table().count() == 0
    df = spark.createDataFrame([(str(i), i, f'{{"a": {i}}}') for i in range(20)] + [("bad", 99, "{oops")], "doc_id STRING, ordinal BIGINT, doc STRING")
    assert s.insert(df).count() == 20 and s.quarantined().count() == 1
    assert s.get("3").first().doc == '{"a": 3}' and s.get("none").count() == 0
    ids = spark.createDataFrame([("1",), ("2",), ("none",)], "doc_id STRING")
    assert s.get(ids).count() == 2 and s.delete(ids) == 2 and s.table().count() == 18
    assert s.upsert(spark.createDataFrame([("3", '{"a": "new"}'), ("x", "{}")], "doc_id STRING, doc STRING")) == 1
    assert s.get("3").first().doc == '{"a": "new"}' and s.table().count() == 19
    h = s.health().first()
    assert (h["items"], h.vectors, h.min_dims, h.max_dims) == (19, 19, 128, 128)
    other = DocumentStore(spark, str(tmp_path / "s"), 128, collection="other", buckets=4)
    other.insert(spark.createDataFrame([('{"q": 1}',)], "doc STRING"))
    assert other.table().count() == 1 and s.table().count() == 19
    assert s.clear() == 19 and s.table().count() == 0 and other.table().count() == 1
    everything = other.documents().select("doc_id")
    assert other.delete(everything) == 1 and other.table().count() == 0


def test_streams_across_batches(spark, tmp_path):
    src, t0 = str(tmp_path / "in"), datetime.datetime(2024, 1, 1)
    rows = [(i, i % 3, "ab"[i % 2], t0 + datetime.timedelta(hours=i)) for i in range(60)]
    schema = "id INT, k INT, a STRING, ts TIMESTAMP"
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(src)
    batch = spark.createDataFrame(rows, schema).withColumn("vec", encode_row("a", "k", dims=64))
    stream = J.stream_table(spark, src, "*.parquet", batch.drop("vec").schema, files_per_batch=1).withColumn("vec", encode_row("a", "k", dims=64))
    J.write_append(stream.select("id", "vec"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert {(r.id, bytes(r.vec)) for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {(r.id, bytes(r.vec)) for r in batch.collect()}
    from ternweave.operators.algebra import bundle_by
    J.write_updates(J.running_sums(stream, ["k"], "vec", 64), str(tmp_path / "u"), str(tmp_path / "cu")).awaitTermination()
    last = J.profiles_from_sums(J.latest_sums(spark.read.parquet(str(tmp_path / "u")), ["k"]), ["k"])
    want = {r.k: bytes(r.vec) for r in bundle_by(batch, "k", "vec", 64).collect()}
    assert {r.k: bytes(r.vec) for r in last.collect()} == want
