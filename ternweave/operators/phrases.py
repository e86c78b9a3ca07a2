"""Many phrases in every text: exact locations by an automaton, and word overlap by rare words, in one pass over the texts.

The phrases are the query set.  They are read in slices of bounded size; of each slice a task builds its own look-up tables, and the texts
pass by them where they lie, without a shuffle."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Characters and words of the phrases of a slice.
SLICE_CHARS, SLICE_WORDS = 1 << 20, 1 << 20
#: Rows of a batch of results, and units that are compared at a time.
EMIT, UNITS = 20_000, 2000


def slices(table: DataFrame, size, most: int):
    """Lists of rows of a table whose sizes add up to ``most`` at most, or of a single larger row; one list is held at a time."""
    rows, total = [], 0
    for r in table.toLocalIterator():
        n = size(r)
        if rows and total + n > most:
            yield rows
            rows, total = [], 0
        rows.append(r)
        total += n
    if rows:
        yield rows


def _in_slices(found, table: DataFrame, size, most: int, schema: T.StructType) -> DataFrame:
    out = None
    for rows in slices(table, size, most):
        part = found(rows)
        out = part if out is None else out.unionByName(part)
    return table.sparkSession.createDataFrame([], schema) if out is None else out


def occurrences(texts: DataFrame, phrases: DataFrame, margin: int) -> DataFrame:
    """All occurrences, overlapping ones too, of phrases (query_id, phrase) in texts (doc_id, text):
    (query_id, doc_id, position, context), position 1-based.

    An Aho-Corasick automaton finds the phrases of a slice in one run over each text; texts neither shuffle nor repeat."""
    kind = T.StructType([T.StructField("query_id", phrases.schema["query_id"].dataType), T.StructField("doc_id", texts.schema["doc_id"].dataType),
                         T.StructField("position", T.IntegerType()), T.StructField("context", T.StringType())])
    id_type = to_arrow_type(kind["query_id"].dataType)

    def found(rows):
        ids: dict[str, list] = {}
        for r in rows:
            ids.setdefault(r["phrase"], []).append(r["query_id"])
        shared = texts.sparkSession.sparkContext.broadcast(ids)

        def run(batches):
            import ahocorasick
            machine = ahocorasick.Automaton()
            for phrase, own in shared.value.items():
                machine.add_word(phrase, (len(phrase), own))
            machine.make_automaton()
            for batch in batches:
                at, who, position, context = [], [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    for end, (n, own) in machine.iter(text) if text else ():
                        begin = max(end + 1 - n - margin, 0)
                        piece = text[begin:end + 1 + margin]
                        for q in own:
                            at.append(i)
                            who.append(q)
                            position.append(end + 2 - n)
                            context.append(piece)
                        if len(at) >= EMIT:
                            yield _found(batch, at, who, position, context)
                            at, who, position, context = [], [], [], []
                if at:
                    yield _found(batch, at, who, position, context)

        return texts.select("doc_id", "text").mapInArrow(run, kind)

    def _found(batch, at, who, position, context):
        return pa.RecordBatch.from_arrays([pa.array(who, id_type), batch.column("doc_id").take(pa.array(at, pa.int64())),
                                           pa.array(position, pa.int32()), pa.array(context, pa.string())], names=kind.names)

    return _in_slices(found, phrases.where("length(phrase) > 0").select("query_id", "phrase"), lambda r: len(r["phrase"]), SLICE_CHARS, kind)


class Wanted:
    """The distinct words of the queries of a slice.  A unit with ``need`` of a query's m words has one at least of any m - need + 1 of
    them: those that the fewest queries hold are looked up, and what they bring is counted in full."""

    def __init__(self, lists: list[list[str]], min_overlap: float):
        held = Counter(w for ws in lists for w in ws)
        self.vocabulary = {w: i for i, w in enumerate(sorted(held))}
        self.size = np.array([len(ws) for ws in lists], np.int64)
        self.need = np.maximum([math.ceil(min_overlap * len(ws) - 1e-9) for ws in lists], 1)
        pairs = [(self.vocabulary[w], q) for q, ws in enumerate(lists)
                 for w in sorted(ws, key=lambda w: (held[w], w))[:len(ws) - int(self.need[q]) + 1]]
        rare = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.query = rare[:, 1]
        self.start = np.searchsorted(rare[:, 0], np.arange(len(self.vocabulary) + 1))
        self.every = np.sort(np.array([q * len(self.vocabulary) + self.vocabulary[w] for q, ws in enumerate(lists) for w in ws], np.int64))

    def compare(self, units: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, query, common words) of all pairs with enough of them."""
        known = [sorted({v for w in ws or () if (v := self.vocabulary.get(w)) is not None}) for ws in units]
        n = np.array([len(k) for k in known], np.int64)
        word, unit = np.array([v for k in known for v in k], np.int64), np.repeat(np.arange(len(units)), n)
        times = self.start[word + 1] - self.start[word]
        place = np.repeat(self.start[word] - np.cumsum(times) + times, times) + np.arange(times.sum())
        pair = np.unique(np.repeat(unit, times) * len(self.size) + self.query[place])
        unit, query = pair // len(self.size), pair % len(self.size)
        first = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(pair)), n[unit])
        each = np.arange(len(owner)) - np.repeat(np.cumsum(n[unit]) - n[unit], n[unit]) + first[unit][owner]
        key = query[owner] * len(self.vocabulary) + word[each]
        hit = self.every[np.minimum(np.searchsorted(self.every, key), len(self.every) - 1)] == key
        common = np.bincount(owner[hit], minlength=len(pair))
        enough = common >= self.need[query]
        return unit[enough], query[enough], common[enough]


def overlaps(units: DataFrame, phrases: DataFrame, min_overlap: float) -> DataFrame:
    """Pairs of phrases (query_id, words) and units (unit_id, words) with at least ``min_overlap`` of the phrase's distinct words, and
    one at least: (query_id, unit_id, overlap)."""
    kind = T.StructType([T.StructField("query_id", phrases.schema["query_id"].dataType), T.StructField("unit_id", units.schema["unit_id"].dataType),
                         T.StructField("overlap", T.DoubleType())])
    id_type = to_arrow_type(kind["query_id"].dataType)

    def found(rows):
        shared = units.sparkSession.sparkContext.broadcast([(r["query_id"], sorted(set(r["words"]))) for r in rows])

        def run(batches):
            ids, lists = zip(*shared.value, strict=True)
            wanted = Wanted(list(lists), min_overlap)
            for whole in batches:
                for a in range(0, whole.num_rows, UNITS):
                    batch = whole.slice(a, UNITS)
                    unit, query, common = wanted.compare(batch.column("words").to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in query.tolist()], id_type), batch.column("unit_id").take(pa.array(unit)),
                                                      pa.array(common / wanted.size[query])], names=kind.names)

        return units.select("unit_id", "words").mapInArrow(run, kind)

    asked = phrases.where("size(array_distinct(words)) > 0").select("query_id", "words")
    return _in_slices(found, asked, lambda r: len(r["words"]), SLICE_WORDS, kind)
