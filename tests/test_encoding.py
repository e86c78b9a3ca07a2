import numpy as np
import pytest
from pyspark.sql import functions as F

from ternweave.functions import encoding as E
from ternweave.functions.codebook import atom_trits, atom_vector, check_dims
from ternweave.operators import algebra as A
from ternweave.operators import encode as Enc

D = 1024


def vec(doc, dims=D, **kw):
    return E.encode_value(doc, dims, **kw).astype(np.int64)


def col(row):
    return np.frombuffer(row, np.int8).astype(np.int64)


def test_codebook_is_uniform_and_independent():
    m = np.stack([atom_vector(f"atom{i}", 16000) for i in range(50)]).astype(np.int64)
    for value in (-1, 0, 1):
        assert abs((m == value).mean() - 1 / 3) < 0.005
    g = m @ m.T / 16000
    np.fill_diagonal(g, 0)
    assert np.abs(g).max() < 5 * (2 / 3) / np.sqrt(16000)


def test_builtin_codebook_equals_numpy(spark):
    r = spark.createDataFrame([("a",), ("é\u0001x",), ("",)], "a STRING").select("a", atom_trits(F.col("a"), 256).alias("t")).collect()
    for row in r:
        assert list(row.t) == atom_vector(row.a, 256).tolist()
    with pytest.raises(ValueError):
        check_dims(100)


def test_empty_containers_are_zero():
    assert not vec({}).any() and not vec([]).any() and not vec({"#set": []}).any()


def test_scalar_texts():
    for value, text in ((True, "True"), (None, "nil"), (42, "42"), (1.0, "1.0"), ("1", "1"), (":kw", ":kw")):
        assert (vec(value) == atom_vector(text, D)).all()
    assert (vec(1) == vec("1")).all() and not (vec(1) == vec(1.0)).all()


# Closed forms for flat maps: self score and score of one matching field.
@pytest.mark.parametrize("k,self_score,one", [(1, .4444, .4444), (2, .5926, .3457), (3, .6639, .2908), (5, .7371, .2304), (10, .8125, .1656)])
def test_map_scores_follow_closed_form(k, self_score, one):
    dims, got, part = 16000, [], []
    for t in range(4):
        doc = {f"k{t}-{i}": f"v{t}-{i}" for i in range(k)}
        v = vec(doc, dims)
        got.append(v @ v / dims)
        part.append(v @ vec({f"k{t}-0": f"v{t}-0"}, dims) / dims)
    assert abs(np.mean(got) - self_score) < 0.01
    assert abs(np.mean(part) - one) < 0.01


def test_list_modes_and_order():
    a, b = [1, 2, 3, 4], [4, 3, 2, 1]
    assert not (vec(a) == vec(b)).all()
    for mode in ("bundle", "chained"):
        assert (vec(a, mode=mode) == vec(b, mode=mode)).all()
    pair = vec(["x", "y"], mode="ngram")
    assert (pair == vec(["y", "x"], mode="ngram")).all()


def test_hints_are_removed_and_apply_below():
    hinted = {"words": {"_encode_mode": "bundle", "sequence": ["b", "a"]}}
    plain = {"words": {"sequence": ["a", "b"]}}
    assert (vec(hinted) == vec(plain, mode="bundle")).all()
    unknown = {"words": {"_encode_mode": "no_such_mode", "sequence": ["a", "b"]}}
    assert (vec(unknown) == vec(plain)).all()
    weighted = {"w": {"_encode_mode": "ngram", "_encode_config": {"n_sizes": [1]}, "s": ["a", "b"]}}
    assert (vec(weighted) == vec({"w": {"s": ["a", "b"]}}, mode="bundle")).all()


def test_typed_columns_equal_documents(spark):
    rows = [(1, "x", ["p", "q"], {"m": 1.5}, True), (2, None, [], {}, False), (3, "y", ["q"], {"m": 2.0, "n": -1.0}, None)]
    df = spark.createDataFrame(rows, "id INT, s STRING, l ARRAY<STRING>, m MAP<STRING,DOUBLE>, b BOOLEAN")
    got = df.select("id", Enc.encode_row("s", "l", "m", "b", dims=D).alias("v"), Enc.encode_json(
        F.lit('{"s": "x", "l": ["p", "q"], "m": {"m": 1.5}, "b": true}'), D).alias("j")).orderBy("id").collect()
    for row, (_, s, items, m, b) in zip(got, rows):
        assert (col(row.v) == vec({"s": s, "l": items, "m": m, "b": b})).all()
    assert (col(got[0].j) == col(got[0].v)).all()


def test_long_list_is_chunked_exactly(spark, monkeypatch):
    words = [f"w{i % 700}" for i in range(5000)]
    for mode in ("positional", "bundle", "ngram", "chained", "ngram_weighted"):
        whole = vec(words, 256, mode=mode)
        monkeypatch.setattr(E, "rows_per_block", lambda dims, b=4: 37)
        small = vec(words, 256, mode=mode)
        monkeypatch.undo()
        assert (whole == small).all(), mode


def test_ngram_against_brute_force():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 9, 30)]
    acc = np.zeros(D, np.int64)
    for i, w in enumerate(words):
        acc += 500_000 * atom_vector(w, D).astype(np.int64)
        if i + 2 < len(words):
            acc += 2_000_000 * np.prod([atom_vector(x, D).astype(np.int64) for x in words[i:i + 3]], axis=0)
    assert (np.sign(acc) == vec(words, mode="ngram", config={"n_sizes": [1, 3], "weights": [0.5, 2.0]})).all()


def test_mode_validation():
    with pytest.raises(ValueError):
        E.check_mode("no_such_mode", {})
    with pytest.raises(ValueError):
        E.check_mode("ngram_configurable", {"n_sizes": [1, 2], "weights": [1.0]})
    with pytest.raises(ValueError):
        E.check_mode("subsequence_aligned", {"alignment_mode": "none"})


def test_malformed_json_gives_null(spark):
    r = spark.createDataFrame([("{bad",), (None,), ('{"a": 1}',)], "d STRING").select(Enc.encode_json("d", D).alias("v")).collect()
    assert r[0].v is None and r[1].v is None and (col(r[2].v) == vec({"a": 1})).all()


def test_algebra_properties(spark):
    df = spark.createDataFrame([(i, f"a{i}", f"b{i % 3}") for i in range(20)], "id INT, a STRING, b STRING")
    df = df.select("id", Enc.encode_atom("a", D).alias("x"), Enc.encode_atom("b", D).alias("y"))
    r = df.select("*", A.bind("x", "y", D).alias("xy"), A.bind("y", "x", D).alias("yx"), A.dot("x", "y", D).alias("d"),
                  A.bind_columns([], D).alias("none"), A.bundle_columns(["x", "y"], D, [1.0, 3.0]).alias("w"),
                  A.permute(A.permute("x", 5, D), -5, D).alias("back")).collect()
    for q in r:
        x, y = col(q.x), col(q.y)
        assert (col(q.xy) == x * y).all() and q.xy == q.yx and q.d == x @ y and q.back == q.x
        assert not col(q.none).any() and (col(q.w) == np.sign(x + 3 * y)).all()
    with pytest.raises(ValueError):
        A.bundle_columns(["x", "y"], D, [1.0])
    with pytest.raises(ValueError):
        A.compose(df, "add", "id", "x", D)


def test_grouped_forms_with_a_hot_key(spark):
    df = spark.range(3000).select((F.col("id") % 10).alias("r"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"),
                                  F.concat(F.lit("t"), (F.col("id") % 13).cast("string")).alias("t"), (F.col("id") % 5 - 1).alias("w"))
    v = df.select("k", "w", "t", Enc.encode_atom("t", 128).alias("vec")).repartition(6)
    pdf = df.toPandas()
    mats = {k: np.stack([atom_vector(t, 128).astype(np.int64) for t in g.t]) for k, g in pdf.groupby("k")}
    for r in A.bundle_by(v, "k", "vec", 128).collect():
        assert (col(r.vec) == np.sign(mats[r.k].sum(0))).all()
    for r in A.bundle_by(v, "k", "vec", 128, weight="w").collect():
        w = pdf[pdf.k == r.k].w.to_numpy()
        assert (col(r.vec) == np.sign(w @ mats[r.k])).all()
    few = v.select("k", "t", "vec").distinct()
    for r in A.bind_by(few, "k", "vec", 128).collect():
        m = np.stack([atom_vector(t, 128).astype(np.int64) for t in pdf[pdf.k == r.k].t.unique()])
        assert (col(r.vec) == np.prod(m, axis=0)).all()


def test_vector_length_is_checked(spark):
    df = spark.createDataFrame([(bytearray(128), bytearray(64))], "a BINARY, b BINARY")
    with pytest.raises(Exception, match="length mismatch"):
        df.select(A.bind("a", "b", 128)).collect()


def test_the_cache_of_atoms_counts_what_an_entry_takes(monkeypatch):
    import tracemalloc
    from collections import OrderedDict

    from ternweave.functions import codebook
    monkeypatch.setattr(codebook, "_cache", OrderedDict())
    monkeypatch.setattr(codebook, "_cached_bytes", 0)
    monkeypatch.setattr(codebook, "_CACHE_BYTES", 4 << 20)
    tracemalloc.start()
    for i in range(40_000):
        codebook.atom_vector(f"w{i}", 64)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 6 << 20 and len(codebook._cache) > 1000


def test_atoms_of_a_batch_are_read_at_once_and_recurring_ones_are_kept(monkeypatch):
    import ternweave.functions.codebook as codebook
    words = [f"w{i}" for i in range(400)]
    want = np.stack([atom_vector(w, 128) for w in words])
    monkeypatch.setattr(codebook, "_CACHE_BYTES", 100 * 2 * (128 + 240))
    monkeypatch.setattr(codebook, "_books", {}, raising=False)
    monkeypatch.setattr(codebook, "atom_vector", None)
    derived, real = [], getattr(codebook, "_derived", None)
    monkeypatch.setattr(codebook, "_derived", lambda a, d: derived.extend(a) or real(a, d), raising=False)
    for s in range(0, 400, 40):
        some = [*words[:20], *words[s:s + 40], "w3"]
        assert (codebook.atom_matrix(some, 128) == np.concatenate([want[:20], want[s:s + 40], want[3:4]])).all()
    assert set(derived) == set(words) and derived.count("w7") <= 2 and len(codebook._books[128].new[0]) <= 100
    assert (codebook.atom_matrix(words, 128) == want).all() and codebook.atom_matrix([], 128).shape == (0, 128)
