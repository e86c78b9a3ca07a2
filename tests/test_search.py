import numpy as np
import pytest
from pyspark.sql import functions as F

from ternweave.functions.predicates import check_request, guard_predicate, negation_predicate
from ternweave.operators import encode as Enc
from ternweave.operators import search as S

D = 256

ROWS = [("task1", "high", "work", ["a", "b", "c"]), ("task2", "medium", "work", ["a", "b"]), ("task3", "low", "personal", [])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "name STRING, priority STRING, category STRING, tags ARRAY<STRING>")


@pytest.fixture(scope="module")
def variants(spark, docs):
    return docs.select("name", F.parse_json(F.to_json(F.struct("*"))).alias("doc"))


GUARDS = [
    ({"priority": "high"}, {"task1"}), ({"priority": ["high", "medium"]}, {"task1", "task2"}),
    ({"category": "work", "priority": ["high", "low"]}, {"task1"}), ({}, {"task1", "task2", "task3"}),
    ({"missing": "x"}, set()), ({"missing": None}, set()), ({"priority": []}, set()), ({"priority": None}, {"task1", "task2", "task3"}),
    ({"priority": {"$any": True}}, {"task1", "task2", "task3"}),
    ({"$or": [{"priority": "high"}, {"category": "personal"}]}, {"task1", "task3"}),
    ({"$or": [{"priority": "high"}, {"category": "personal"}], "category": "work"}, {"task1"}),
    ({"priority": {"$or": ["low", "medium"]}}, {"task2", "task3"}),
    ({"tags": ["a", {"$any": True}, "c"]}, {"task1"}), ({"tags": ["a", "b"]}, {"task2"}), ({"tags": []}, {"task3"}),
    ({"tags": {"$contains": "c"}}, {"task1"}), ({"tags": {"$not_contains": "c"}}, {"task2", "task3"}),
    ({"priority": {"$not": ["low", "high"]}}, {"task2"}),
]


@pytest.mark.parametrize("guard,want", GUARDS)
def test_guards_on_columns_and_documents(docs, variants, guard, want):
    assert {r.name for r in docs.where(guard_predicate(docs.schema, guard)).collect()} == want
    assert {r.name for r in variants.where(guard_predicate("doc", guard)).collect()} == want


def test_guard_variants_of_types(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "n": null, "m": {"x": 2, "y": 3}}'), (2, '{"a": "1", "m": 5}'), (3, '{"a": true}')], "id INT, t STRING")
    v = df.select("id", F.parse_json("t").alias("doc"))

    def ids(g, **kw):
        return {r.id for r in v.where(guard_predicate("doc", g, **kw)).collect()}
    assert ids({"a": 1}) == {1} and ids({"a": "1"}) == {2} and ids({"a": True}) == {3}
    assert ids({"n": None}) == {1} and ids({"m": {"x": 2}}) == {1} and ids({"m": {"x": 9}}) == set()
    assert ids({"$or": [{"a": 1}, {"a": "1"}], "m": 5}, compat=True) == {1, 2}
    assert ids({"a": {"$gt": 0}}) == {1}


def test_negations(docs, variants):
    for source, df in ((docs.schema, docs), ("doc", variants)):
        def names(n):
            return {r.name for r in df.where(negation_predicate(source, n)).collect()}
        assert names({"priority": {"$not": "high"}}) == {"task2", "task3"}
        assert names({"priority": {"$not": ["high", "low"]}}) == {"task2"}
        assert names({"missing": {"$not": "x"}}) == {"task1", "task2", "task3"}
        assert names({"priority": "high"}) == {"task1", "task2", "task3"}
        assert names({"tags": {"$not_contains": "c"}}) == {"task2", "task3"}


def test_request_limits():
    for k, t in ((0, 0.0), (101, 0.0), (5, -0.1), (5, 1.1)):
        with pytest.raises(ValueError):
            check_request(k, t)


def brute(corpus, probes, k, floor=-np.inf):
    out = []
    for q, p in probes:
        scored = sorted(((-(p.astype(int) @ v) / len(p), i) for i, v in corpus if (p.astype(int) @ v) / len(p) >= floor))
        out += [(q, i, round(-s, 9), r + 1) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-1, 2, (40, 64)).astype(np.int8)
    corpus = [(i, base[i % 40]) for i in range(300)]          # many exact ties
    corpus += [(300 + i, base[0]) for i in range(150)]        # a third are copies of one vector
    probes = [(q, rng.integers(-1, 2, 64).astype(np.int8)) for q in range(12)] + [(99, base[0])]
    to = lambda rows, n: spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in rows], f"{n} INT, vec BINARY")
    return corpus, probes, to(corpus, "doc_id").repartition(5).cache(), to(probes, "query_id").cache()


@pytest.mark.parametrize("how", ["broadcast", "grid", "small_corpus"])
def test_all_plans_match_brute_force(vectors, how):
    corpus, probes, c, p = vectors
    for k, floor in ((3, None), (7, 0.0), (400, 0.05)):
        kw = {"broadcast": {}, "grid": {"cells": (3, 4)}, "small_corpus": {"broadcast_bytes": 64 * 450}}[how]
        if how == "small_corpus":
            big = p.unionByName(p.select((F.col("query_id") + 1000).alias("query_id"), "vec"))
            for _ in range(5):
                big = big.unionByName(big.select((F.col("query_id") + 10000 * (_ + 1)).alias("query_id"), "vec"))
            got = S.search_table(c, big, 64, k, floor, **kw).where("query_id < 1000")
        else:
            got = S.search_table(c, p, 64, k, floor, **kw)
        rows = sorted((r.query_id, r.doc_id, round(r.score, 9), r.rank) for r in got.collect())
        assert rows == brute(corpus, probes, k, -np.inf if floor is None else floor)


def test_exclude_self(vectors):
    _, _, c, _ = vectors
    got = S.search_table(c, c.select(F.col("doc_id").alias("query_id"), "vec"), 64, 2, None, exclude_self=True).collect()
    assert len(got) == 900 and all(r.query_id != r.doc_id for r in got)


def test_string_ids_and_empty_sides(spark, vectors):
    _, _, c, p = vectors
    s = c.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "vec")
    a = S.search_table(s, p, 64, 5).collect()
    assert a and all(r.doc_id.startswith("d") for r in a)
    assert S.search_table(c, p.where("false"), 64, 5).count() == 0
    assert S.search_table(c.where("false"), p, 64, 5).count() == 0


def test_or_order_and_dedup(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "y")], "doc_id INT, p STRING, q STRING")
    corpus = df.withColumn("vec", Enc.encode_row("p", "q", dims=D))
    alts = {"$or": [{"p": "b"}, {"p": "a", "q": "x"}]}
    first = S.search(corpus, alts, D, 3, 0.1).orderBy("rank").collect()
    assert first[0].doc_id == 2 and len({r.doc_id for r in first}) == len(first)
    best = S.search(corpus, alts, D, 3, 0.1, or_order="score").orderBy("rank").collect()
    assert best[0].doc_id == 1
    assert S.search(corpus, {"$or": []}, D, 3).count() == 0


def test_wildcard_negation_and_filter_modes(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], i % 4) for i in range(24)], "doc_id INT, p STRING, n INT")
    corpus = df.withColumn("vec", Enc.encode_row("p", "n", dims=D))
    free = S.search(corpus, {"p": "a", "n": {"$any": True}}, D, 24).collect()
    same = S.search(corpus, {"p": "a"}, D, 24).collect()
    assert [(r.doc_id, r.score) for r in free] == [(r.doc_id, r.score) for r in same]
    pre = S.search(corpus, {"p": "a"}, D, 5, guard={"n": 3}).collect()
    post = S.search(corpus, {"p": "a"}, D, 5, guard={"n": 3}, filter_mode="post").collect()
    assert len(pre) >= len(post)
    no = S.search(corpus, {"p": "a"}, D, 24, negations={"n": {"$not": [0, 1]}}).join(df, "doc_id").collect()
    assert no and all(r.n in (2, 3) for r in no)
    assert S.search_by_vector(corpus, Enc.encode_document({"p": "a"}, D), D, 5).count() == 5
    with pytest.raises(ValueError):
        S.search_by_vector(corpus, b"123", D)


def test_threshold_is_monotone(vectors):
    _, _, c, p = vectors
    sizes = [S.search_table(c, p, 64, 1000, t).count() for t in (0.0, 0.1, 0.3, 0.6)]
    assert sizes == sorted(sizes, reverse=True)


def test_approximate_results_are_exact_scores(vectors):
    _, _, c, p = vectors
    near = S.approximate_search(c, p, 64, 5, bands=16, width=4).select("query_id", "doc_id", F.col("score").alias("s"))
    exact = S.search_table(c, p, 64, 1000, None)
    j = near.join(exact, ["query_id", "doc_id"]).where("abs(s - score) < 1e-9")
    assert j.count() == near.count()
    copy = near.where("query_id = 99").count()
    assert copy == 5


def test_guard_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, i % 5, "x") for i in range(50)], "doc_id INT, n INT, p STRING").write.parquet(path)
    t = spark.read.parquet(path)
    plan = t.where(guard_predicate(t.schema, {"n": {"$gte": 3}}))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(n,3)" in plan


def test_batch_search_filters_at_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, i % 5, "x") for i in range(50)], "doc_id INT, n INT, p STRING").write.parquet(path)
    corpus = spark.read.parquet(path).withColumn("vec", Enc.encode_row("p", "n", dims=D))
    plan = S.search(corpus, {"p": "x"}, D, 3, guard={"n": 3})._jdf.queryExecution().toString()
    assert "EqualTo(n,3)" in plan
