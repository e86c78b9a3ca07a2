import collections
import hashlib
import html.parser
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_brute import brute_classes, edit_distance_inside
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ternweave.llm import (common, decontaminate, exact_dedup, language_id, mixing, near_dedup, queries, token_binary, token_counts,
                           toxicity, url_filter, warc)

SF = "/root/testdata/sf0.001"
LONG = "und die Katze sitzt " * 20_000
SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, slot STRING, bucket LONG, score STRING"
#: Nulls everywhere, empty and very long texts, repeated rows, and columns whose names the operators use themselves.
ODD = [(1, "the cat sat on the mat today", "en", "a", "x", 1, None), (1, "the cat sat on the mat today", "en", "a", "x", 1, None),
       (2, None, "en", "a", None, None, None), (3, "", None, None, None, None, None), (None, "the cat sat on the mat today", None, "b", "", 0, "q"),
       (None, None, None, None, None, None, None), (4, LONG, "de", "b", "y", 7, "z"), (5, "the  cat\tsat on\nthe mat today", "en", "a", "x", 1, "z"),
       (6, "…!?", "fr", "c", "", 3, ""), (7, "le chat est sur la table avec nous", "fr", "c", "", 3, "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id LONG, text STRING")


def random_text(rng, n, vocabulary):
    return " ".join(rng.choices(vocabulary, k=n))


# ---- 1 ---------------------------------------------------------------------------------------

def brute_profile(text, dims=language_id.DIMS):
    own = language_id.Profiles(dims).letter
    v = np.zeros(dims)
    marks = re.sub(r"[^\w]|[\d_]", " ", text.lower())
    for w in marks.split():
        w = "\0" + w + "\0"
        for a, b, c in zip(w, w[1:], w[2:], strict=False):
            v += np.roll(own[ord(a)], 2).astype(int) * np.roll(own[ord(b)], 1) * own[ord(c)]
    return v


def test_language_profiles_match_brute_force():
    texts = ["Grüße an die Welt", "", "x", "a b", "Ночь, улица, фонарь", "don't stop — 12 times", "日本語の文章"]
    got = language_id.Profiles().bundle(texts)
    for t, v in zip(texts, got, strict=True):
        assert np.array_equal(v, brute_profile(t)), t


def test_language_id(spark, odd, none):
    langs, vectors = language_id.prototypes(odd)
    assert langs == ["de", "en", "fr"]
    rows = language_id.predict(odd, langs, vectors).collect()
    assert len(rows) == len(ODD)
    assert {(r.doc_id, r.lang_pred) for r in rows} == {(1, "en"), (2, "und"), (3, "und"), (None, "en"), (None, "und"), (4, "de"), (5, "en"),
                                                      (6, "und"), (7, "fr")}
    assert all(0 <= r.score <= 1 for r in rows) and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language_id.predict(none, langs, vectors).collect() == []
    assert language_id.prototypes(none)[0] == []
    assert {r.lang_pred for r in language_id.predict(odd, *language_id.prototypes(none)).collect()} == {"und"}


def test_language_accuracy_on_held_out(spark):
    got = queries.QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    held = got.where("held_out and lang is not null").selectExpr("avg(int(lang = lang_pred)) a").first().a
    assert held >= 0.97


# ---- 2 ---------------------------------------------------------------------------------------

def test_code_lengths_are_optimal_and_limited():
    import heapq
    rng = random.Random(4)
    for _ in range(60):
        counts = np.array([rng.choice([0, 1, 2, 3, 50, 900]) for _ in range(rng.randint(2, 40))])
        lengths = token_binary.code_lengths(counts)
        heap, cost = [int(c) for c in counts if c], 0
        if len(heap) < 2:
            continue
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert cost == int((lengths.astype(int) * counts).sum())
        short = token_binary.code_lengths(counts, 6)
        assert short.max() <= 6 and sum(2.0 ** -int(x) for x in short if x) <= 1


def test_block_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 255, 256, 257, 5000):
        ids = np.minimum(rng.geometric(0.01, n), 3000).astype(np.uint32)
        code = token_binary.Code(token_binary.code_lengths(np.bincount(ids, minlength=3001)))
        one, two = code.pack(ids, [n]), code.pack(ids[: n // 2 + 1], [n // 2, 1])
        out, sizes = code.unpack([one, two, one])
        assert np.array_equal(out, np.concatenate([ids, ids[: n // 2 + 1], ids])) and [len(s) for s in sizes] == [1, 2, 1]


def check_token_rows(rows, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    for r, (key, text) in zip(rows, texts, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids), zlib.crc32(ids.tobytes())), (key, text)
        start += len(ids)


def test_token_files(spark, odd, none):
    model = public_tokenizers.path("word_bpe_49k.json")
    texts = ["plain words, don't", "a <|endoftext|> b<|startoftext|>", None, "", "Ünï ﬁ ½ ² 日本語 é́ ΑΣ", "x" * 3000, "\x1c\x85 a", "| | |&&&", LONG]
    docs = docs_of(spark, [(9 - i, t) for i, t in enumerate(texts)]).repartition(4)
    rows = token_binary.token_files(docs, model).orderBy("start").collect()
    check_token_rows(rows, sorted([(9 - i, t) for i, t in enumerate(texts)]))
    rows = token_binary.token_files(odd, model).collect()
    assert len(rows) == len(ODD) and rows and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
    assert token_binary.token_files(none, model).collect() == []


def test_words_met_again_are_not_learned_again(monkeypatch):
    """A full memory keeps them; ids are the library's, whatever stands between the words."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder, learned = Tokenizer.from_file(path), token_binary.Encoder(path), []
    learn, forget = encoder._learn, encoder._forget
    monkeypatch.setattr(token_binary, "REMEMBERED", 100_000)
    monkeypatch.setattr(encoder, "_learn", lambda new: (learned.extend(new), learn(new)))
    monkeypatch.setattr(encoder, "_forget", lambda: (learned.append("forgot"), forget()))
    often = [f"often{i}" for i in range(50)]
    for k in range(20):
        once = [f"once{k}x{i}" for i in range(150)]
        texts = [" ".join(often + once[:70]), "  a\t b \n", "", " ", "\x1c 日本 語 a", "\n".join(once[70:]) + " İx ", "<|endoftext|> a"]
        assert [x.tolist() for x in encoder(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert learned.count("forgot") > 2
    assert all(learned.count(w) == 1 for w in often)


# ---- 3 ---------------------------------------------------------------------------------------

def test_exact_dedup(spark, odd, none):
    got = exact_dedup.exact_duplicates(odd).collect()
    assert len(got) == len(ODD)
    norm = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
    groups = collections.defaultdict(list)
    for d, t, *_ in ODD:
        groups[hashlib.sha256(norm(t).encode()).hexdigest()].append(d)
    for r in got:
        own = groups[r.text_sha256]
        assert r.group_size == len(own) and r.keep_id == min((d for d in own if d is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_duplicates(none).collect() == []


def test_exact_dedup_with_a_full_filter_and_a_large_group(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i % 700}") for i in range(3000)]
    docs = docs_of(spark, rows)
    want = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert want == {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs, max_bits=1).collect()}
    first, size = {}, collections.Counter(t for _, t in rows)
    for i, t in rows:
        first.setdefault(t, i)
    assert want == {(i, first[t], size[t], first[t] == i) for i, t in rows}


def test_exact_dedup_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {tuple(r) for r in con.sql(queries.ORACLES["op3_exact_dedup"]).fetchall()}
    assert {tuple(r) for r in queries.QUERIES["op3_exact_dedup"](spark, SF).collect()} == want


# ---- 4 ---------------------------------------------------------------------------------------

def test_pfair_deviates_by_less_than_a_block():
    rng = random.Random(2)
    for _ in range(30):
        weights = {f"s{i}": rng.choice([1, 2, 3, 7, 50, 0.5]) for i in range(rng.randint(1, 12))}
        slots = mixing.shares(weights, 200)
        table = mixing.pfair(slots)
        owner = {t: s for s, ts in table.items() for t in ts}
        assert sorted(owner) == list(range(200))
        had = dict.fromkeys(slots, 0)
        for t in range(200):
            had[owner[t]] += 1
            assert all(abs(had[s] - Fraction(slots[s] * (t + 1), 200)) < 1 for s in slots)


def test_mixing_places_every_row_once(spark, odd, none):
    rows = [(i, f"s{0 if i % 3 else i % 7}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id LONG, source STRING")
    weights = {f"s{i}": 1 + i for i in range(7)}
    got = mixing.mixed(docs, weights, block=8, period=100).collect()
    assert sorted(r.doc_id for r in got) == list(range(2000))
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.slot].append(r)
    assert sorted(slots) == list(range(len(slots)))
    assert all(len({(r.source, r.block) for r in s}) == 1 and sorted(r.place for r in s) == list(range(len(s))) for s in slots.values())
    share = mixing.shares({s: weights[s] for s in {r[1] for r in rows}}, 100)
    blocks = {s: -(-n // 8) for s, n in collections.Counter(s for _, s in rows).items()}
    had = dict.fromkeys(share, 0)
    for t in range(len(slots)):
        had[slots[t][0].source] += 1
        assert all(abs(had[s] - Fraction(share[s] * (t + 1), 100)) < 1 for s in share)
        if any(had[s] == blocks[s] for s in share):
            break                                                           # from here on the others share its weight
    assert len(mixing.mixed(odd).collect()) == len(ODD)
    assert mixing.mixed(none).collect() == []
    with pytest.raises(ValueError, match="without a weight"):
        mixing.mixed(docs, {"s0": 1})


def test_mixture_keeps_exact_weights_over_many_periods():
    square = mixing.target_weights({f"s{i}": n for i, n in enumerate([4_000_000, *[400_000 + 7_000 * i for i in range(19)]])})
    for weights, blocks in ((square, {s: 6_000 for s in square}), ({"a": 1, "b": 2, "c": 3, "d": 0.5}, dict.fromkeys("abcd", 5_000)),
                            ({"a": 10_000, "b": 1, "c": 3333}, {"a": 30_000, "b": 100, "c": 20_000})):
        owner, used = {}, len(set().union(*[{r[3]} for r in mixing.plan(blocks, weights)]))
        for s, first, last, start, share, slots, cycle in mixing.plan(blocks, weights):
            for k in range(last - first + 1):
                owner[start + k // share * cycle + slots[k % share]] = s
        assert sorted(owner) == list(range(sum(blocks.values()))) and used <= len(weights)
        total, had = sum(map(Fraction, weights.values())), dict.fromkeys(weights, 0)
        for t in range(len(owner)):
            had[owner[t]] += 1
            if t % 997 == 0 or t < 500:
                assert all(abs(had[s] - Fraction(weights[s]) * (t + 1) / total) < 1 for s in weights)
            if had[owner[t]] == blocks[owner[t]]:
                break


# ---- 5 ---------------------------------------------------------------------------------------

def test_token_counts(spark, odd, none):
    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(3)
    texts = ["", " ", "   A  b ", "▁▁ x", "<s></s> <0x0A>\x00", "ab" * 900, "a" * 5000 + " " * 3000, "日本語テキスト 🙂🙂 é́", "\n\n\t x\ny", LONG]
    texts += ["".join(rng.choice("ab e\nst▁ther.,éß日") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    texts += ["".join(rng.choice(["the", "re", "in", "g", "er", "e", " ", "    "]) for _ in range(rng.randint(1, 60))) for _ in range(800)]
    got = {r.doc_id: r for r in token_counts.token_counts(docs_of(spark, list(enumerate(texts))), model).collect()}
    for i, (t, ids) in enumerate(zip(texts, library.encode(texts), strict=True)):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), len(ids), len(ids) > 4096), t[:80]
    assert len(token_counts.token_counts(odd, model).collect()) == len(ODD)
    assert {(r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd, model).where("doc_id in (2, 3)").collect()} == {(0, 0)}
    assert token_counts.token_counts(none, model).collect() == []


def test_queue_and_rounds_agree():
    merger = token_counts.Merger(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(8)
    words = ["▁" + "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    queue = [merger._queue(merger.symbol[[ord(c) for c in w]].tolist()) for w in words]
    assert merger.counts(words).tolist() == queue


# ---- 6 ---------------------------------------------------------------------------------------

class Visible(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")
        self.out.append("\n" if tag != "b" else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_warc_derivatives(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    records = warc.derivatives(warc.responses_of_pages(pages))
    rows = records.collect()
    source = {r.page_id: r for r in pages.collect()}
    names = {r.key: r.record_id for r in warc.responses_of_pages(pages).collect()}
    assert len(rows) == 2 * len(source) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        page = source[r.key]
        assert r.refers_to == names[r.key] and r.target_uri == page.url and r.content_length == len(r.block.encode())
        assert r.block_digest == warc.digest(r.block.encode()) and r.source_payload_digest == warc.digest(page.html.encode())
        if r.warc_type == "conversion":
            seen = Visible()
            seen.feed(page.html)
            assert "".join(r.block.split()) == "".join("".join(seen.out).split())
        else:
            assert f"conversion: {warc.record_id('conversion', r.refers_to)}\r\n" in r.block
            assert r.block.count("outlink: ") == page.html.count("<a href")
            assert "source-header: Content-Type: text/html; charset=utf-8\r\n" in r.block
    path = str(tmp_path / "warc")
    warc.write_warc(records, path)
    back = warc.read_warc(spark, path).collect()
    drop = lambda r: tuple(r[c] for c in back[0].asDict())
    assert sorted(map(drop, back)) == sorted(map(drop, rows))


@pytest.mark.parametrize("piece", ["<a ", "<title>", "<head>", "<script ", "<!-- ", "<td", "<", "</", "&lt", "<a href=", "<style>", "<p>\n"])
def test_warc_time_is_in_proportion_to_the_page(piece):
    import time
    t = time.process_time()
    warc.derivatives_of("<urn:x>", "u", warc.DATE, "", "start " + piece * (1_000_000 // len(piece)))
    assert time.process_time() - t < 20


def test_warc_responses_are_read(spark, tmp_path):
    import gzip
    page = "<html lang='de'><head><title>T &amp; t</title></head><body><!-- <a href='no'> --><script>a<b</script>Gr\u00fc\u00dfe<a href='x?a=1'>l</a><td>z".encode()
    blocks = [b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n" + page, b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe<p>bytes", b"no header"]
    data = b""
    for i, (kind, block) in enumerate([("warcinfo", b"software: x"), *[("response", x) for x in blocks], ("request", b"GET /")]):
        name = warc.digest(block) if i % 2 else "sha256:unchecked"
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{i}>\r\nWARC-Target-URI: http://h/{i}\r\nWARC-Block-Digest: {name}\r\nContent-Length: {len(block)}"
        data += gzip.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
    (tmp_path / "own.warc.gz").write_bytes(data)
    rows = warc.responses_of_warc(spark, str(tmp_path)).collect()
    assert [(r.record_id, r.http[:8]) for r in rows] == [("<urn:1>", "HTTP/1.1"), ("<urn:2>", "HTTP/1.1"), ("<urn:3>", "")]
    made = {(r.refers_to, r.warc_type): r.block for r in warc.derivatives(warc.responses_of_warc(spark, str(tmp_path))).collect()}
    assert made["<urn:1>", "conversion"] == "Gr\u00fc\u00dfel z" and made["<urn:2>", "conversion"] == "\ufffd\ufffd\nbytes" and made["<urn:3>", "conversion"] == "no header"
    meta = made["<urn:1>", "metadata"]
    assert "title: T & t\r\n" in meta and "language: de\r\n" in meta and meta.count("outlink: ") == 1 and "outlink: x?a=1\r\n" in meta


def test_warc_odd_pages(spark):
    schema = "page_id LONG, url STRING, html STRING, block STRING, record_id STRING"
    rows = [(1, None, None, None, None), (None, "http://a", "", "b", "c"), (2, "u", "<p>a &lt; b<!-- x", "", ""), (2, "u", "<p>a &lt; b<!-- x", "", ""),
            (3, "u", "a\r\n\r\nWARC/1.1 <script>never", "", ""), (4, "u", "<p>x</p>" * 20_000, "", "")]
    pages = spark.createDataFrame(rows, schema)
    got = warc.derivatives(warc.responses_of_pages(pages)).where("warc_type = 'conversion'").collect()
    assert sorted(r.block[:20] for r in got) == sorted(["", "", "a < b", "a < b", "a WARC/1.1", ("x\n" * 20)[:20]])
    assert warc.derivatives(warc.responses_of_pages(pages.where("false"))).collect() == []


# ---- 7 ---------------------------------------------------------------------------------------

def edited(rng, item, edits, vocabulary):
    out = list(item)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(out))
        if kind == 0:
            out[at] = rng.choice(vocabulary)
        elif kind == 1:
            out.insert(at, rng.choice(vocabulary))
        else:
            del out[at]
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of"] * 60
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 60))] for _ in range(40)]
    benchmark = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in enumerate(items)], "item_id LONG, text STRING")
    docs, planted = [], {}
    for d in range(240):
        i = rng.randrange(len(items))
        middle = edited(rng, items[i], int(len(items[i]) * rng.choice([0, 0, 0.1, 0.2])), vocabulary) if d % 2 else []
        docs.append(rng.choices(vocabulary, k=60) + middle + rng.choices(vocabulary, k=60))
        planted[d] = i if d % 2 else None
    got = decontaminate.contaminated(docs_of(spark, [(d, ", ".join(w)) for d, w in enumerate(docs)]), benchmark).collect()
    found = {(r.doc_id, r.item_id): r.edits for r in got}
    true = {(d, i): e for d, w in enumerate(docs) for i, x in enumerate(items) if (e := edit_distance_inside(x, w)) <= int(0.2 * len(x))}
    assert all(true.get(k, 99) <= e for k, e in found.items()) and set(found) <= set(true)
    assert all(k in found and found[k] == 0 for k, e in true.items() if e == 0)
    assert len(set(found) & set(true)) >= 0.95 * len(true) and len(true) >= 100


def test_decontamination_of_long_items():
    rng = random.Random(7)
    items = [[f"w{rng.randrange(30_000)}" for _ in range(n)] for n in (121, 600, 600, 1200)]
    index, texts, true = decontaminate.Index(items), [], []
    for d in range(60):
        i = d % 4
        item = items[i]
        if d % 3:
            middle = edited(rng, item, int(0.2 * len(item)) - 1, [f"w{j}" for j in range(30_000)])
        else:                                                               # all edits are in the first words
            middle = [f"x{j}" for j in range(int(0.2 * len(item)))] + item[int(0.2 * len(item)):]
        texts.append(" ".join([f"w{rng.randrange(30_000)}" for _ in range(rng.randrange(40))] + middle + ["end"] * (d % 2)))
        true.append((d, i))
    got = index.matches([*texts, " ".join(items[3][:700] + ["x"] * 400), " ".join(items[1][:479])])       # 500 and 121 edits
    assert {(t, i) for t, i, *_ in got} <= set(true) and len(got) >= 0.95 * len(true)
    assert all(edits <= int(0.2 * len(items[i])) for _, i, edits, _ in got)
    assert all(edits == edit_distance_inside(items[i], texts[t].split()) for t, i, edits, _ in got[:12] if i < 3)
    assert index.matches([" ".join(items[3][60:])]) == [(0, 3, 60, 1140)]
    with pytest.raises(ValueError, match="recall"):
        decontaminate.Index([["a", "b", "c"]], recall=1.1)


def test_decontamination_odd(spark, odd, none):
    benchmark = spark.createDataFrame([(1, "the cat sat on the mat today"), (2, None), (3, ""), (None, "the cat"), (4, "le chat")],
                                      "item_id LONG, text STRING")
    got = decontaminate.contaminated(odd, benchmark).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 0), (1, 1), (1, 1), (5, 0), (5, 1), (7, 4)]
    assert decontaminate.contaminated(none, benchmark).collect() == []
    assert decontaminate.contaminated(odd, benchmark.where("false")).collect() == []


@pytest.mark.parametrize("length", [1, 2, 4, 5, 6, 7, 8, 9, 14])
def test_short_items_are_found(length):
    rng = random.Random(length)
    items = [[f"i{k}w{j}" for j in range(length)] for k in range(40)]
    index = decontaminate.Index(items)
    texts = []
    for item in items:
        copy = list(item)
        for at in rng.sample(range(length), int(0.2 * length)):
            copy[at] = "other"
        texts.append(" ".join(["x", "y", *copy, "z"]))
    found = {(t, i) for t, i, *_ in index.matches(texts)}
    assert found <= {(k, k) for k in range(40)} and len(found) >= (40 if length < 5 else 36)


# ---- 8 ---------------------------------------------------------------------------------------

def test_bag_minhash_is_unbiased():
    rng = random.Random(1)
    for _ in range(4):
        base = [rng.randrange(2 ** 48) for _ in range(60)]
        a = {x: rng.choice([1, 1, 2, 3, 5, 9, 40]) for x in base[:50]}
        b = {x: a[x] if x in a and rng.random() < 0.7 else rng.choice([1, 2, 7, 33]) for x in base[8:]}
        text = np.array([0] * len(a) + [1] * len(b))
        sig = near_dedup.bag_minhash(text, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 2, 20_000)
        ca, cb = collections.Counter(a), collections.Counter(b)
        assert abs((sig[0] == sig[1]).mean() - (ca & cb).total() / (ca | cb).total()) < 0.02
        alone = near_dedup.bag_minhash(text[: len(a)], np.array([*a], np.uint64), np.array([*a.values()]), 1, 20_000)
        assert np.array_equal(alone[0], sig[0])


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, base = [], [random_text(rng, 120, vocabulary).split() for _ in range(12)]
    for d in range(500):
        own = edited(rng, base[0 if d % 3 == 0 else d % 12], rng.choice([0, 1, 2, 3, 5, 8, 12]), vocabulary)
        rows.append((d, " ".join(own if d % 11 else own * 2)))
    rows += [(500 + i, random_text(rng, rng.choice([1, 3, 5, 40]), vocabulary)) for i in range(80)] + [(600, None), (601, ""), (602, "!"), (603, "?"), (604, "!")]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    want = brute_classes(rows)
    want[601] = 600                                                         # null and empty texts are copies
    assert {i: r.class_id for i, r in got.items()} == want
    assert {i for i, r in got.items() if r.kept} == set(want.values())


def test_near_duplicates_odd(odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in got) == [
        (0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 2, False), (4, 4, True), (5, 1, False), (6, 6, True), (7, 7, True)]
    assert near_dedup.near_duplicates(none).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 90)] + [(200, 201), (201, 200), (7, 7)]
    got = dict(map(tuple, common.components(spark.createDataFrame(chain, "a LONG, b LONG")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 0 for i in range(90)}, 200: 200, 201: 200}


@pytest.mark.parametrize("most", [3, 2 ** 18])
def test_components_are_joined_in_tasks_or_in_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(common, "LINKS", most)
    links = spark.createDataFrame([(f"n{i + 10}", f"n{i + 11}") for i in range(40)] + [("a", f"n{i}") for i in range(60, 90)], "a STRING, b STRING")
    out, small = common.sized_components(links)
    assert small == (most > 3)
    assert dict(map(tuple, out.collect())) == {**{f"n{i}": "n10" for i in range(10, 51)}, **{f"n{i}": "a" for i in range(60, 90)}, "a": "a"}


def test_packed_bags_are_what_they_were():
    rng = np.random.default_rng(1)
    for counts in (np.ones(50, np.int64), rng.integers(1, 9, 50), np.zeros(0, np.int64)):
        items = np.unique(rng.integers(0, 2 ** 48, len(counts)).astype(np.uint64))
        got = near_dedup.unpacked(*near_dedup.packed(items, counts[:len(items)]))
        assert got[0].tolist() == items.tolist() and got[1].tolist() == counts[:len(items)].tolist()


def test_join_skewed_keeps_every_row(spark):
    rows = spark.createDataFrame([(i, 0 if i % 2 else i) for i in range(4000)], "id LONG, k LONG")
    lookup = spark.createDataFrame([(k, k * 10) for k in range(0, 4000, 4)], "k LONG, v LONG")
    for how in ("inner", "left"):
        got = collections.Counter(map(tuple, common.join_skewed(rows, lookup, "k", "id", 4000, how).select("id", "k", "v").collect()))
        assert got == collections.Counter(map(tuple, rows.join(lookup, "k", how).select("id", "k", "v").collect()))


# ---- 9 ---------------------------------------------------------------------------------------

def test_url_rules(spark):
    urls = {"HTTP://A.Example.ORG/en/12?x": ("a.example.org", "/en/12", "example.org/en/1", "block"),
            "https://example.org/es/": ("example.org", "/es/", "example.org/es/", "block"), "http://x.org": ("x.org", "", None, None),
            "http://x.org?a://b.com/fr/": ("x.org", "", None, None), "http://m.x.com/fr/a#://": ("m.x.com", "/fr/a", "com/fr/", "allow"),
            "http://com/de/": ("com", "/de/", "com/de/", "block"), "http://notcom/de/": ("notcom", "/de/", None, None),
            "nothing": ("", "", None, None), "": ("", "", None, None), "x\ny://ÄB.org/\nq": ("Äb.org", "/\nq", "org/", "allow")}
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(99, None, None, None)], "page_id LONG, url STRING, host STRING, rule STRING")
    model = url_filter.fit(url_filter.labelled_by_rules(pages))
    got = {r.page_id: r for r in url_filter.url_verdicts(pages, model=model).collect()}
    for i, (host, path, rule, verdict) in enumerate(urls.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if got[i].block_score >= 0.5 else "allow"))
    assert (got[99].host, got[99].path, got[99].rule) == ("", "", None)
    none = pages.where("false")
    assert url_filter.fit(url_filter.labelled_by_rules(none)) is None
    assert url_filter.url_verdicts(none).collect() == []
    assert {r.verdict for r in url_filter.url_verdicts(pages).where("rule is null").collect()} == {"allow"}


def test_url_query_runs_in_a_used_session(spark):
    common.store_counted(spark.range(10), "seen")
    assert queries.QUERIES["op9_url_filter"](spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_url_model_learns_and_is_native(spark):
    rows = [(f"{'bad' if i % 2 else 'good'}{i}.example.net", f"/{'casino' if i % 2 else 'wiki'}/{i}", "block" if i % 2 else "allow") for i in range(300)]
    model = url_filter.fit(spark.createDataFrame(rows, "host STRING, path STRING, verdict STRING"))
    pages = spark.createDataFrame([(i, f"https://host{i}.example.net/{'casino' if i % 2 else 'wiki'}/x{i}") for i in range(100)], "page_id LONG, url STRING")
    got = url_filter.url_verdicts(pages, rules=(), model=model)
    assert all((r.verdict == "block") == bool(r.page_id % 2) for r in got.collect())
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()


# ---- 10 --------------------------------------------------------------------------------------

def test_toxicity(spark, odd, none):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(500)]
    rows = []
    for i in range(700):
        w = rng.choices(vocabulary, k=rng.randint(5, 60))
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["grumbl", "snarl", "growl"]) + rng.choice(["", "ing", "er"])
        rows.append((i, " ".join(w), "en" if i % 2 else "de", int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id LONG, text STRING, lang STRING")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(3, None), (None, 1)], "doc_id LONG, toxic INT")
    held = F.pmod(common.crc_of("doc_id"), F.lit(5)) == 0
    sample = toxicity.labelled_sample(docs, labels, ~held)
    assert all(zlib.crc32(str(d).encode()) % 5 for d, *_ in sample) and len(sample) > 400
    net = toxicity.fit(sample)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, net).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == y for i, _, _, y in test]) >= 0.95
    assert all(r.rejected == (r.score >= r.threshold) and r.threshold == net.thresholds.get("de" if i % 2 == 0 else "en", net.threshold) for i, r in got.items())
    rows = toxicity.toxicity(odd.drop("score"), net).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    wordless = [r.score for r in rows if r.doc_id in (2, 3, 6)]
    assert len(wordless) == 3 and max(wordless) - min(wordless) <= 2e-6
    assert toxicity.toxicity(none, net).collect() == []
    assert toxicity.fit(toxicity.labelled_sample(docs, labels.where("false"), ~held)) is None
    assert {r.score for r in toxicity.toxicity(odd, None).collect()} == {0.0}


def test_thresholds_cover_all_labelled_rows(spark):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(900):
        w = rng.choices(vocabulary, k=rng.randint(5, 40))
        toxic = int(i % 3 == 0)
        if toxic or i % 60 == 1:                                                # some long clean texts hold the word too
            w[rng.randrange(len(w))] = "snarl"
        rows.append((i, " ".join(w) + (" word1" * 3000 if i % 60 == 1 else ""), "fr" if i >= 870 else "en", toxic))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id LONG, text STRING, lang STRING")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id LONG, toxic INT")
    sample = toxicity.labelled_sample(docs, labels, F.lit(True), max_per_label=100)
    assert len(sample) <= 200
    net = toxicity.fit(sample)
    trained = [d for i, (d, *_) in enumerate(sample) if i % 5 != 4]
    lang, label, score, weight = toxicity.counted_scores(sample, net, trained)
    assert {x: round(weight[label == x].sum()) for x in (0, 1)} == {0: 600, 1: 300}
    cache = common.Cache(toxicity.hashed)
    seen = set(trained)
    brute = collections.Counter((r[2], r[3], net.score(*toxicity.word_ids([r[1]], cache))[0]) for r in rows if r[0] not in seen)
    assert {(a, b) for a, b, _ in brute} == set(zip(lang.tolist(), label.tolist(), strict=True)) and set(net.thresholds) == {"en", "fr"}
    got = toxicity.toxicity(docs, net).collect()
    clean = {r[0] for r in rows if not r[3]} - seen
    assert sum(r.rejected for r in got if r.doc_id in clean) <= 0.01 * 600      # 15 of the 600 clean texts are long and hold the word
    assert net.threshold > toxicity.fit(list(sample)).threshold                 # which has met no long text


def test_best_threshold():
    assert toxicity.best_threshold(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) == 0.5
    assert 0.6 < toxicity.best_threshold(np.array([0.1, 0.6, 0.8, 0.9]), np.array([0, 0, 1, 1])) < 0.8
