"""Every stage of the pipeline against brute force, on the smallest tables and on odd rows."""

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from llm_brute import brute_classes, edit_distance_inside
from tokenizers import Tokenizer

import corpus_pipeline as P
from ternweave.llm import common, mixing, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before each stage and the result, each written and read again."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_names(stages):
    assert len(P.STAGES) == 5 and all(d.columns == stages[0].columns for d in stages[:5])
    assert stages[5].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_toxic_documents_go(spark, stages):
    before, after = rows_of(stages[0]), rows_of(stages[1])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    net = toxicity.fit(toxicity.labelled_sample(stages[0], spark.read.parquet(f"{SF}/labels.parquet"), F.pmod(common.crc_of("doc_id"), F.lit(5)) != 0))
    cache = common.Cache(toxicity.hashed)
    for i, r in before.items():
        score = net.score(*toxicity.word_ids([r.text or ""], cache))[0]
        limit = net.thresholds.get(r.lang, net.threshold)
        assert abs(score - limit) < 1e-5 or (i in after) == (score < limit)
    clean = [i for i, y in labels.items() if not y]
    assert sum(i in after for i in clean) >= 0.85 * len(clean)


def test_one_of_each_group_stays(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    assert set(after) == set(brute_classes([(i, r.text) for i, r in before.items()]).values())


def test_benchmark_passages_go(spark, stages):
    before, after = rows_of(stages[2]), rows_of(stages[3])
    items = [common.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks, near = set(), set()
    for i, r in before.items():
        w = common.words(r.text)
        vocabulary = set(w)
        for x in items:
            if sum(a in vocabulary for a in x) >= len(x) - int(0.2 * len(x)):
                edits = edit_distance_inside(x, w)
                leaks |= {i} if edits == 0 else set()
                near |= {i} if edits <= int(0.2 * len(x)) else set()
    assert leaks and not leaks & set(after) and set(before) - set(after) <= near


def test_mixture_orders_all_documents(stages):
    place = {r.doc_id: (r.slot, r.place) for r in mixing.mixed(stages[3]).collect()}
    files = sorted(stages[4].inputFiles())
    order = [r.doc_id for f in files for r in stages[4].sparkSession.read.parquet(f).collect()]
    assert sorted(order) == sorted(place) and [place[i] for i in order] == sorted(place.values())


def test_tokens_follow_the_stored_order(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    files = sorted(stages[4].inputFiles())
    docs = [r for f in files for r in stages[4].sparkSession.read.parquet(f).collect()]
    start, got = 0, rows_of(stages[5])
    assert len(got) == len(docs)
    for r in docs:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(got[r.doc_id]) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_run_equals_the_stages(spark, stages):
    got = P.run(spark, SF)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in stages[5].collect()}


def test_odd_rows_pass_every_stage(spark, tmp_path):
    schema = ("doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, _bucket STRING, _key STRING, _slot STRING, _maybe STRING, "
              "_toxicity STRING, _part STRING, _place STRING, _file STRING, id STRING, slot STRING")
    rows = [(1, "the cat sat on the mat today again", "en", "a", 5), (1, "the cat sat on the mat today again", "en", "a", 5), (2, None, None, None, None),
            (3, "", "", "", 0), (None, "some other words which nobody repeats here", None, "b", None), (None, None, None, None, None),
            (4, "und die Katze " * 30_000, "de", "b", 1), (5, "The cat, sat on the mat today again!", "en", "a", 5)]
    rows += [(1, "a text of its own under an id that others have", "en", "a", 5)]
    rows = [(*r, *[f"own {i} {r[0]}" for i in range(10)]) for r in rows]
    for k, own in enumerate((rows, [])):
        docs = spark.createDataFrame(own, schema)
        for i, (_name, stage) in enumerate(P.STAGES):
            path = str(tmp_path / f"{k}-{i}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            if i < 4:
                assert docs.columns == [c.split()[0] for c in schema.split(", ")]
            if i < 4:
                assert all(r[5 + j] == f"own {j} {r.doc_id}" for r in docs.collect() for j in range(10))
        ids = [r.doc_id for r in docs.collect()]
        assert (ids == []) if k else sorted(ids, key=str) == [1, 1, 2, 4, None]


def test_library_works_without_the_operators(tmp_path):
    """The entry point lists the other queries where the folder and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    root = Path(P.__file__).parent
    shutil.copytree(root / "ternweave", tmp_path / "ternweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    n, listed, known = said.stdout.split()
    assert int(n) > 150 and listed == "False" and known == "True"
