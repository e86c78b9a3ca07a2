"""Toxicity of texts: a small convolutional classifier trained in numpy."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternweave.llm.common import Cache, id_filter, kept_by, may_be_in, portions, slices, words

BUCKETS, DIMS, WIDTHS, FILTERS = 2 ** 15, 12, (1, 2, 3), 12
PREFIX = 5
#: The classifier is fitted on at most so many documents of each label, of at most so many characters.
MAX_PER_LABEL, MAX_CHARS = 4000, 12_000
#: Share of clean texts that a threshold may reject.
MAX_REJECTED = 0.01
EPOCHS, BATCH, RATE = 8, 32, 0.01
#: Steps of a score in the counts that thresholds are chosen from.
SCORES = 4096
CHARS = 1_000_000


def hashed(word: str) -> tuple[int, int]:
    """Buckets of a word and of its first letters."""
    return (xxhash.xxh3_64_intdigest(word) % BUCKETS, xxhash.xxh3_64_intdigest("^" + word[:PREFIX], seed=1) % BUCKETS)


def word_ids(texts: list[str], cache: Cache) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of the different words [n, 2], word at each place, number of words of each text).  A text without words
    has one empty word."""
    lists = [words(t) or [""] for t in texts]
    known: dict[str, int] = {}
    place = np.fromiter((known.setdefault(w, len(known)) for ws in lists for w in ws), np.int64)
    return (np.array([cache[w] for w in known], np.int64).reshape(-1, 2), place, np.array([len(w) for w in lists], np.int64))


@dataclass
class Network:
    """Embeddings of hashed words (the word's row plus its prefix's row), filters over one to three
    neighbouring words, the largest activation of each filter, and a logistic output."""

    embedding: np.ndarray
    kernels: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    thresholds: dict = field(default_factory=dict)
    threshold: float = 0.5

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32),
                   [r.normal(0, 0.5 / np.sqrt(w), (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS],
                   [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                   r.normal(0.3, 0.1, len(WIDTHS) * FILTERS).astype(np.float32))

    def pooled(self, ids: np.ndarray, place: np.ndarray, n: np.ndarray, positions: bool = False):
        """(largest activation of each filter in each text, and with ``positions`` the word where it begins)."""
        edge = np.concatenate([[0], np.cumsum(n)])
        x = self.embedding[ids[:, 0]] + self.embedding[ids[:, 1]]
        last = np.repeat(edge[1:] - 1, n)
        best = np.empty((len(n), len(WIDTHS) * FILTERS), np.float32)
        where = np.empty(best.shape, np.int64) if positions else None
        for i, w in enumerate(WIDTHS):
            act = (x @ self.kernels[i][0] + self.bias[i])[place]
            for j in range(1, w):
                part = (x @ self.kernels[i][j])[place[j:]]
                part[last[:-j] < np.arange(j, len(place))] = 0            # beyond the end of the text
                act[:-j] += part
            cut = slice(i * FILTERS, (i + 1) * FILTERS)
            for d in range(len(n)):
                own = act[edge[d]:edge[d + 1]]
                if positions:
                    at = own.argmax(0)
                    where[d, cut] = at + edge[d]
                    best[d, cut] = own[at, np.arange(FILTERS)]
                else:
                    best[d, cut] = own.max(0)
        return np.maximum(best, 0), where, last

    def score(self, ids: np.ndarray, place: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = self.pooled(ids, place, n)[0].astype(np.float64) @ self.out.astype(np.float64) + self.out_bias
        return np.round(1 / (1 + np.exp(-np.clip(z, -60, 60))), 6)        # equal texts score alike in batches of any shape


def train(samples: list[tuple[np.ndarray, int]], seed: int = 7) -> Network:
    """Fit a network to (buckets of a text, label) by Adam with weights that balance the labels."""
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    labels = np.array([y for _, y in samples], np.float64)
    share = max(labels.mean(), 1e-6), max(1 - labels.mean(), 1e-6)
    balance = np.where(labels == 1, 0.5 / share[0], 0.5 / share[1])
    params = [net.embedding, *net.kernels, *net.bias, net.out]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    bias_state, step = [0.0, 0.0], 0
    for _epoch in range(EPOCHS):
        order = r.permutation(len(samples))
        for a in range(0, len(order), BATCH):
            pick = order[a:a + BATCH]
            ids = np.concatenate([samples[i][0] for i in pick])
            n = np.array([len(samples[i][0]) for i in pick])
            _, seen, place = np.unique(ids[:, 0] * BUCKETS + ids[:, 1], return_index=True, return_inverse=True)
            pool, where, last = net.pooled(ids[seen], place, n, positions=True)
            p = 1 / (1 + np.exp(-np.clip(pool @ net.out + net.out_bias, -30, 30)))
            d = ((p - labels[pick]) * balance[pick] / len(pick)).astype(np.float32)
            grads = [np.zeros_like(q) for q in params[1:]]
            rows, values = [], []
            grads[-1][:] = pool.T @ d
            dpool = d[:, None] * net.out[None, :]
            for i, w in enumerate(WIDTHS):
                cut = slice(i * FILTERS, (i + 1) * FILTERS)
                g = np.where(pool[:, cut] > 0, dpool[:, cut], 0)
                grads[len(WIDTHS) + i][:] = g.sum(0)
                at = where[:, cut]
                for j in range(w):
                    ok = at + j <= last[at]
                    words_at = np.minimum(at + j, len(ids) - 1)
                    gj = np.where(ok, g, 0)
                    x = net.embedding[ids[words_at, 0]] + net.embedding[ids[words_at, 1]]      # [texts, filters, dims]
                    grads[i][j] = np.einsum("tfd,tf->df", x, gj)
                    back = (gj[:, :, None] * net.kernels[i][j].T[None]).reshape(-1, DIMS)
                    for h in (0, 1):
                        rows.append(ids[words_at, h].ravel())
                        values.append(back)
            step += 1
            rate = RATE * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for q, g, (m, v) in zip(params[1:], grads, state[1:], strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * m / (np.sqrt(v) + 1e-8)
            rows, values = np.concatenate(rows), np.concatenate(values)
            touched, inverse = np.unique(rows, return_inverse=True)
            g = np.zeros((len(touched), DIMS), np.float32)
            np.add.at(g, inverse, values)
            m, v = state[0]
            m[touched] += 0.1 * (g - m[touched])
            v[touched] += 0.001 * (g * g - v[touched])
            net.embedding[touched] -= rate * m[touched] / (np.sqrt(v[touched]) + 1e-8)
            gb = float(d.sum())
            bias_state[0] += 0.1 * (gb - bias_state[0])
            bias_state[1] += 0.001 * (gb * gb - bias_state[1])
            net.out_bias -= rate * bias_state[0] / (np.sqrt(bias_state[1]) + 1e-8)
    known = np.zeros(BUCKETS, bool)
    for ids, _y in samples:
        known[ids.ravel()] = True
    net.embedding[~known] = 0                                             # words never met say nothing
    return net


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Of the thresholds that reject at most MAX_REJECTED of the clean texts the one with the best F1, among
    equals the one nearest to 0.5; without toxic texts not below 0.5.  A score may stand for ``weights`` texts."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    w = np.ones(len(s)) if weights is None else weights[order]
    cuts = np.unique(np.concatenate([[0.5, 1.01], (s[1:] + s[:-1]) / 2]))
    below = np.searchsorted(s, cuts, side="left")
    hits, wrong = (np.concatenate([np.cumsum((w * (y == v))[::-1])[::-1], [0]])[below] for v in (1, 0))
    f1 = 2 * hits / np.maximum(hits + wrong + w[y == 1].sum(), 1e-9)
    fair = wrong <= MAX_REJECTED * w[y == 0].sum() + 1e-9
    fair &= (cuts >= 0.5) | bool(y.any())
    good = np.flatnonzero(fair & (f1 >= f1[fair].max() - 1e-12))
    return float(cuts[good[np.argmin(np.abs(cuts[good] - 0.5))]])


class Sample(list):
    """Rows to fit on; ``docs`` (doc_id, text, lang) and ``labels`` (doc_id, label) are all that may be learned from."""

    def __init__(self, rows, docs: DataFrame, labels: DataFrame):
        super().__init__(rows)
        self.docs, self.labels = docs, labels


def labelled_sample(docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang", label_col: str = "toxic", max_per_label: int = MAX_PER_LABEL) -> Sample:
    """[(doc_id, lang, label, buckets)] of a bounded sample: of each label the first ``max_per_label`` ids in the order
    of a hash, without texts of more than MAX_CHARS characters.  Texts never shuffle: the ids are broadcast.  The
    sample knows all labelled rows of ``train_rows``, for the thresholds."""
    one = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label")).where(train_rows))
    order = F.xxhash64("doc_id")
    ids = [r for y in (0, 1) for r in one.where(F.col("label") == y).orderBy(order, "doc_id").limit(max_per_label).collect()]
    picked = docs.sparkSession.createDataFrame(ids, one.schema)
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")

    def tokens(batches):
        cache = Cache(hashed)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for t in texts:
                ids, place, _n = word_ids([t], cache)
                rows.append(ids[place].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("label"), pa.array(rows, pa.binary())],
                                             names=["doc_id", "lang", "label", "ids"])
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang"))
    found = (own.where(F.length(F.coalesce("text", F.lit(""))) <= MAX_CHARS).join(F.broadcast(picked), "doc_id")
             .select("doc_id", "text", "lang", "label").mapInArrow(tokens, f"doc_id {kind}, lang string, label int, ids binary").collect())
    rows = {(r.doc_id, bytes(r.ids)): (r.doc_id, r.lang, r.label, np.frombuffer(r.ids, np.int32).reshape(-1, 2).astype(np.int64)) for r in found}
    return Sample([rows[k] for k in sorted(rows)], own, one)


def counted_scores(sample: Sample, net: Network, trained: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language, label, score, weight) of all labelled rows that the network has not seen: texts of any length, also
    those beyond the sample.

    Only the labelled documents are scored; texts don't shuffle, and the driver gets counts by score, in SCORES steps.  Short texts
    stand for those of their label that were trained on as well, so long ones keep their share."""
    spark = sample.docs.sparkSession
    filter_, bits = id_filter(sample.labels, "doc_id", sample.labels.count())
    scored = (with_score(may_be_in(sample.docs, "doc_id", filter_, bits), net, "score")
              .select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "score",
                      (F.length(F.coalesce("text", F.lit(""))) > MAX_CHARS).alias("long")))
    seen = spark.createDataFrame([(d,) for d in sorted(set(trained))], sample.labels.select("doc_id").schema).withColumn("seen", F.lit(True))
    rows = (scored.join(sample.labels, "doc_id").join(F.broadcast(seen), "doc_id", "left")
            .groupBy("lang", "label", "long", (F.coalesce("seen", F.lit(False)) & ~F.col("long")).alias("seen"),
                     (F.floor(F.col("score") * SCORES) / SCORES).alias("score"))
            .agg(F.count(F.lit(1)).alias("n")).toArrow())
    lang, label, long, seen, score, n = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "label", "long", "seen", "score", "n"))
    weight, new = n.astype(np.float64), ~seen.astype(bool)
    for y in (0, 1):
        short = (label == y) & ~long.astype(bool)
        if (short & new).any():
            weight[short] *= n[short].sum() / n[short & new].sum()
    return lang[new], label[new], score[new], weight[new]


def fit(sample) -> Network | None:
    """Network of a labelled sample, with a threshold for all and one for each language.

    Every fifth document of the sample is kept from the training.  All labelled rows but those trained on
    calibrate the thresholds (of a plain list, every fifth); a language without clean ones takes the threshold for
    all.  None if the sample lacks a label."""
    if len({y for _, _, y, _ in sample}) < 2:
        return None
    kept = [s for i, s in enumerate(sample) if i % 5 == 4]
    rest = [s for i, s in enumerate(sample) if i % 5 != 4]
    if len({y for _, _, y, _ in rest}) < 2:
        rest = sample
    net = train([(x, y) for _, _, y, x in rest])
    langs = np.array([])
    if isinstance(sample, Sample):
        langs, labels, scores, weights = counted_scores(sample, net, [d for d, *_ in rest])
    if not len(langs):
        kept = kept or sample
        scores = np.concatenate([net.score(x, np.arange(len(x)), np.array([len(x)])) for _, _, _, x in kept])
        langs, labels = np.array([lang or "" for _, lang, _, _ in kept]), np.array([y for _, _, y, _ in kept])
        weights = np.ones(len(kept))
    net.threshold = best_threshold(scores, labels, weights)
    for lang in sorted(set(langs.tolist()) - {""}):
        own = langs == lang
        if not labels[own].all():                                         # else no clean text would bound it
            net.thresholds[lang] = best_threshold(scores[own], labels[own], weights[own])
    return net


def with_score(docs: DataFrame, net: Network | None, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a further column ``name``, the score; the other columns pass through.  The score
    depends on the text alone; null is an empty text.  Without a network it is 0."""
    if name in docs.columns:
        raise ValueError(f"column {name} exists")
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net) if net is not None else b"")

    def score(batches):
        kept_by("toxicity")
        own = pickle.loads(blob.value) if blob.value else None
        cache = Cache(hashed)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            out = []
            for a, b in portions(map(len, texts), CHARS):
                out.append(own.score(*word_ids(texts[a:b], cache)) if own else np.zeros(b - a))
            value = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64())], names=[*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType
    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def threshold_of(net: Network | None, lang_col: str | None = None) -> Column:
    """The calibrated threshold of a row's language; that for all where it has none."""
    value = F.lit(net.threshold if net else 0.5)
    for lang, t in sorted((net.thresholds if net else {}).items()) if lang_col else ():
        value = F.when(F.col(lang_col) == lang, F.lit(t)).otherwise(value)
    return value


def toxicity(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, score, predicted, threshold, rejected) of every row.

    ``predicted`` is 1 from a score of 0.5; ``rejected`` holds the score against the calibrated threshold of
    the row's language, which the score itself never sees.  Null and empty texts get the score of a text
    without words.  Ids may repeat or be null; an empty table gives no rows; other columns are not read."""
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang"))
    limit = threshold_of(net, "lang")
    return with_score(own, net, "score").select(
        "doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), limit.alias("threshold"), (F.col("score") >= limit).alias("rejected"))
