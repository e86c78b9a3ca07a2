"""Nothing is cut, dropped or saturated, and texts of atoms agree."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ternweave.functions.codebook import atom_text, canon_atom
from ternweave.operators import algebra as A
from ternweave.operators import encode as E
from ternweave.operators import search as S
from ternweave.sources.documents import edn_to_tagged
from ternweave.sources.store import DocumentStore
from ternweave.streaming import jobs as J


def test_atom_texts_agree(spark):
    rng = random.Random(1)
    doubles = [0.0, -0.0, 1e7, 1e15, 1e16, 1.5e-7, 0.00012, 9.999e-5, 0.1, 1 / 3, -2.5e21, 123456789.125, float("nan"), float("inf"), float("-inf"), 5e-5]
    doubles += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 20) for _ in range(200)]
    rows = [(i, d, struct.unpack("f", struct.pack("f", d))[0] if abs(d) < 1e6 else 1.5, bool(i % 2)) for i, d in enumerate(doubles)]
    df = spark.createDataFrame(rows, "i INT, d DOUBLE, f FLOAT, b BOOLEAN")
    got = df.select("i", canon_atom("d").alias("d"), canon_atom("b").alias("b"), canon_atom("f").alias("f"),
                    E.atoms_of_row("b").alias("row")).collect()
    for r in got:
        assert float(r.d) == doubles[r.i] or doubles[r.i] != doubles[r.i]
        if r.i < 16:
            assert r.d == atom_text(doubles[r.i])
        assert r.b == str(bool(r.i % 2)) and r.row == sorted(["b", r.b])
    flat = df.where("i < 16 and not isnan(d)")
    one = flat.select("i", E.encode_row("d", "f", "b", dims=64).alias("v"))
    two = flat.select("i", canon_atom("d").alias("d"), canon_atom("f").alias("f"), canon_atom("b").alias("b")).select(
        "i", E.encode_row("d", "f", "b", dims=64).alias("v"))
    assert {r.i: bytes(r.v) for r in one.collect()} == {r.i: bytes(r.v) for r in two.collect()}


def test_vectors_do_not_wrap_or_saturate(spark):
    v = spark.createDataFrame([(bytearray(np.full(64, 100, np.int8).tobytes()),)], "v BINARY")
    for bad in (A.add("v", "v", 64), A.scale("v", 3, 64), A.bind("v", "v", 64), A.subtract("v", A.scale("v", -1, 64), 64)):
        with pytest.raises(Exception, match="range of int8"):
            v.select(bad).collect()
    assert bytes(v.select(A.scale("v", -1, 64).alias("r")).first().r) == np.full(64, -100, np.int8).tobytes()


def test_units_without_words_keep_their_row(spark):
    units = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None)], "unit_id INT, words ARRAY<STRING>")
    got = {r.unit_id: bytes(r.vec) for r in E.encode_idf_ngrams(units, "unit_id", "words", 64).collect()}
    assert set(got) == {1, 2, 3} and got[2] == got[3] == bytes(64) and any(got[1])


def test_edn_characters():
    assert edn_to_tagged(r"[A \formfeed \backspace \o101 \newline \a \u]") == ["A", "\f", "\b", "A", "\n", "a", "u"]


def test_requests_have_their_own_limits(spark):
    corpus = spark.createDataFrame([(i, "ab"[i % 2], i) for i in range(300)], "doc_id INT, p STRING, n INT").withColumn("vec", E.encode_row("p", dims=64))
    asks = spark.createDataFrame([(1, "a", 200, None, None), (2, "a", 3, 0.5, "low"), (3, "b", 500, 0.9, "none")],
                                 "query_id INT, p STRING, k INT, threshold DOUBLE, guard STRING").withColumn("vec", E.encode_row("p", dims=64))
    guards = {"low": F.col("n") < 10, "none": F.lit(False)}
    got = S.search_requests(corpus, asks, 64, guards).groupBy("query_id").agg(F.collect_list("doc_id").alias("d")).collect()
    by = {r.query_id: sorted(r.d) for r in got}
    assert len(by[1]) == 200 and by[2] == [0, 2, 4] and 3 not in by
    with pytest.raises(ValueError, match="unknown guards"):
        S.search_requests(corpus, asks, 64, {})
    assert S.search(corpus, {"p": "a"}, 64, k=250, threshold=0.0).count() == 150
    with pytest.raises(ValueError, match="between 1 and 100"):
        S.search(corpus, {"p": "a"}, 64, k=250, max_k=100)


def test_probe_slices_and_unranked_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, bytearray(rng.integers(-1, 2, 64).astype(np.int8).tobytes())) for i in range(120)]
    corpus = spark.createDataFrame(rows, "doc_id INT, vec BINARY")
    probes = corpus.select(F.col("doc_id").alias("query_id"), "vec")
    whole = S.score_table(corpus, probes, 64, 0.05)
    sliced = S.score_table(corpus, probes, 64, 0.05, broadcast_bytes=64 * 5 * 30)
    key = lambda df: sorted((r.query_id, r.doc_id, r.score) for r in df.collect())
    m = np.stack([np.frombuffer(v, np.int8) for _, v in rows]).astype(int)
    dots = m @ m.T / 64
    assert key(whole) == key(sliced) == sorted((i, j, dots[i, j]) for i in range(120) for j in range(120) if dots[i, j] >= 0.05)
    top = S.search_table(corpus, probes, 64, 5, broadcast_bytes=64 * 5 * 30)
    assert key(top) == key(S.search_table(corpus, probes, 64, 5))


def test_store_is_keyed_by_id(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", json.dumps({"n": i})) for i in range(10)], "doc_id STRING, doc STRING")
    s = DocumentStore(spark, str(tmp_path / "s"), 64, buckets=4)
    s.insert(docs)
    s.insert(docs)
    assert s.documents().count() == 10
    again = DocumentStore(spark, str(tmp_path / "s"), 64, buckets=7)
    assert again.buckets == 4 and again.upsert(docs.where("doc_id < 'd5'").withColumn("doc", F.lit('{"n": 99}'))) == 5
    again.upsert(spark.createDataFrame([("x", '{"n": 1}', 2), ("x", '{"n": 2}', 1), ("y", "{", 1)], "doc_id STRING, doc STRING, ordinal INT"))
    assert {r.doc_id: r.doc for r in again.get(["x", "y"]).collect()} == {"x": '{"n": 1}'}
    assert [(r.doc_id, r.text) for r in again.quarantined().collect()] == [("y", "{")]
    again.rebucket(16)
    last = DocumentStore(spark, str(tmp_path / "s"), 64)
    assert last.buckets == 16 and last.delete(docs.select("doc_id")) == 10 and last.documents().count() == 1
    with pytest.raises(ValueError, match="64 dimensions"):
        DocumentStore(spark, str(tmp_path / "s"), 128)


def test_late_changes_do_not_win(spark, tmp_path):
    schema = "doc_id STRING, op STRING, doc STRING, ts INT"
    batches = [[("a", "upsert", '{"n": 2}', 20), ("b", "delete", None, 20), ("c", "upsert", '{"n": 1}', 1)],
               [("a", "upsert", '{"n": 1}', 10), ("b", "upsert", '{"n": 1}', 10), ("c", "upsert", '{"n": 2}', 2)]]
    store = DocumentStore(spark, str(tmp_path / "s"), 64, buckets=2)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        J.apply_changes(spark.readStream.schema(schema).json(str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    assert {r.doc_id: json.loads(r.doc)["n"] for r in store.documents().collect()} == {"a": 2, "c": 2}
