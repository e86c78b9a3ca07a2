"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternweave.llm.common import Cache, portions

DIMS = 1024
UNKNOWN = "und"
#: Characters and documents counted at once, and n-gram types bundled at once.
CHARS, DOCS, TYPES = 400_000, 128, 16_384
#: More languages than this point to a wrong column.
MAX_LANGUAGES = 1000


class Profiles:
    """n-gram vectors of texts.

    Every letter has a random vector of +-1 drawn from its code point.  The vector of three
    neighbouring symbols a b c is ``rotate(a, 2) * rotate(b, 1) * c``; non-letters between words are
    one border symbol, and the middle of an n-gram is always a letter.  A text's vector is
    the sum over its n-grams."""

    def __init__(self, dims: int = DIMS):
        self.dims = dims
        self.letter = Cache(lambda c: (np.random.Generator(np.random.Philox(key=c)).integers(0, 2, dims) * 2 - 1).astype(np.int8))
        self.is_letter = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=bool)

    def ngrams(self, texts: list[str]):
        """(code points of the types [n, 3], type of each n-gram, text of each n-gram)."""
        low = [t.lower() for t in texts]
        flat = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "replace"), dtype=np.uint32)
        text = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
        letter = self.is_letter[flat]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] = True
        where = np.flatnonzero(keep)
        symbol = np.where(letter, flat, 0)[where]
        alphabet, small = np.unique(symbol, return_inverse=True)
        middle = np.flatnonzero(symbol != 0)
        if not len(middle):
            return np.zeros((0, 3), np.int64), middle, middle
        owner = text[where[middle] - 1]
        n = len(alphabet)
        code = (small[middle - 1] * n + small[middle]) * n + small[middle + 1]
        if n <= 128:
            seen = np.zeros(n ** 3, bool)
            seen[code] = True
            types = np.flatnonzero(seen)
            index = np.empty(n ** 3, np.int32)
            index[types] = np.arange(len(types))
            kind = index[code]
        else:
            types, kind = np.unique(code, return_inverse=True)
        return alphabet[np.stack([types // (n * n), types // n % n, types % n], 1)], kind, owner

    def bind(self, types: np.ndarray) -> np.ndarray:
        """Vectors of n-gram types."""
        letters, index = np.unique(types, return_inverse=True)
        v = np.stack([self.letter[int(c)] for c in letters])
        i = index.reshape(types.shape)
        return np.roll(v, 2, 1)[i[:, 0]] * np.roll(v, 1, 1)[i[:, 1]] * v[i[:, 2]]

    def bundle(self, texts: list[str], group: np.ndarray | None = None, groups: int = 0) -> np.ndarray:
        """Summed n-gram vectors of each text, or of each group of texts."""
        types, kind, owner = self.ngrams(texts)
        rows = groups if group is not None else len(texts)
        if group is not None:
            owner = group[owner]
        out = np.zeros((rows, self.dims), np.float64 if group is not None else np.float32)
        for a in range(0, len(types), TYPES):
            m = min(TYPES, len(types) - a)
            own, k = (owner, kind) if len(types) <= TYPES else (owner[s := (kind >= a) & (kind < a + m)], kind[s] - a)
            counts = np.bincount(own.astype(np.int64) * m + k, minlength=rows * m).reshape(rows, m)
            out += counts.astype(np.float32) @ self.bind(types[a:a + m]).astype(np.float32)
        return out


def _chunks(batch, column: str):
    texts = [t or "" for t in batch.column(column).to_pylist()]
    for a, b in portions(map(len, texts), CHARS):
        for i in range(a, b, DOCS):
            yield i, min(i + DOCS, b), texts[i:min(i + DOCS, b)]


def prototypes(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = DIMS):
    """(languages, vectors): the bundle of all n-grams of each language, over every row whose
    language is not null.

    Each task adds up a vector per language; Spark sums them by language and dimension.  What
    reaches the driver is languages x ``dims`` numbers."""
    def sums(batches):
        profiles, total = Profiles(dims), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, b, texts in _chunks(batch, "text"):
                names = sorted(set(langs[a:b]))
                group = np.array([names.index(x) for x in langs[a:b]])
                for name, v in zip(names, profiles.bundle(texts, group, len(names)), strict=True):
                    total[name] = total.get(name, 0) + v
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "vec": [v.tolist() for v in total.values()]},
                                             schema=pa.schema([("lang", pa.string()), ("vec", pa.list_(pa.float64()))]))

    part = (labelled.where(F.col(lang_col).isNotNull())
            .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
            .mapInArrow(sums, "lang string, vec array<double>"))
    rows = (part.select("lang", F.posexplode("vec").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("vec"))
            .orderBy("lang").limit(MAX_LANGUAGES + 1).collect())
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return [r.lang for r in rows], np.array([[e.x for e in r.vec] for r in rows]).reshape(len(rows), dims)


def predict(docs: DataFrame, languages: list[str], vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
            dims: int = DIMS) -> DataFrame:
    """(doc_id, lang_pred, score) of every row: the language whose prototype has the largest cosine
    with the text's vector, and that cosine (0 if negative).

    Null, empty and letterless texts are ``und`` with score 0, and so is all if no language was
    learned.  Of equal cosines the first language in alphabetical order wins.  Ids may repeat or be
    null; an empty table gives no rows.  Other columns are not read."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    kind = docs.schema[id_col].dataType.simpleString()

    def judge(batches):
        profiles = Profiles(dims)
        for batch in batches:
            pred, score = [], []
            for _a, _b, texts in _chunks(batch, "text"):
                v = profiles.bundle(texts).astype(np.float64)
                norm = np.linalg.norm(v, axis=1)
                if not languages:
                    pred += [UNKNOWN] * len(texts)
                    score += [0.0] * len(texts)
                    continue
                cos = (v @ unit.T) / np.maximum(norm, 1e-12)[:, None]
                best = cos.argmax(1)
                pred += [languages[i] if n > 0 else UNKNOWN for i, n in zip(best, norm, strict=True)]
                score += np.where(norm > 0, np.clip(cos[np.arange(len(best)), best], 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        judge, f"doc_id {kind}, lang_pred string, score double")
