"""Benchmark passages in documents: CGK embedding, bit-sampling LSH over item-sized windows, exact edit distance."""

from __future__ import annotations

import itertools
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternweave.llm.common import kept_by, mix64, portions, slices, words

#: A passage is a window within so many word edits of an item, as a share of the item's words.
EDITS = 0.2
#: Sampled symbols of a hash; wanted recall of a window at the largest distance; repetitions after which it is an error.
SAMPLES, RECALL, GIVE_UP = 3, 0.95, 1000
#: Items of more than WHOLE words are looked for by pieces of PIECE words or a little more: samples late in a long walk hardly ever agree.
WHOLE, PIECE = 120, 60
#: Item lengths of a class differ by this factor at most.
SPREAD = 1.4
#: Items are indexed in blocks of so many words, and so many blocks are searched in one scan, so that what a task holds is bounded.
BLOCK_WORDS, GROUP = 200_000, 4
CHARS = 1_000_000
PAD = 1


def walk_bit(step: int, symbols: np.ndarray, seed: int) -> np.ndarray:
    """The random bit of a symbol at a step of the walk: whether the walk goes on to the next symbol."""
    return (mix64(symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1_000_003 * seed + step)) >> np.uint64(63)).astype(np.int64)


def pieces(length: int) -> list[tuple[int, int]]:
    """(first word, end) of the pieces of an item.  Of the pieces of a passage within EDITS of an item one at least is within EDITS of its own."""
    n = length // PIECE if length > WHOLE else 1
    return [(length * j // n, length * (j + 1) // n) for j in range(n)]


@dataclass
class LengthClass:
    """Pieces of similar length and the hash functions for their windows."""

    shortest: int
    longest: int
    items: list[tuple[int, int]]            # (item, first word) of each piece
    seeds: list[int]
    steps: list[tuple[int, ...]]
    tables: list[list[np.ndarray]]          # of each repetition: bits by step and symbol
    prefixes: list[list[np.ndarray]]        # of each repetition: sorted hashes after 1, 2, ... samples
    owners: list[dict[int, list[tuple[int, int]]]]      # of each repetition: pieces by full hash
    mask: np.ndarray                        # symbols that some piece of the class holds
    rare: np.ndarray                        # those of them that few items hold
    needs: list[tuple[int, int, int]]       # (least number of such symbols, of the rare ones, words in which they stand)


def _sampled(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, bits: list[np.ndarray], steps, keep=None):
    """Hashes of the sampled symbols of walks that begin at ``start``: (hash, index of the walk).

    A walk emits the symbol it stands at and goes on if that symbol's bit at this step is set; at ``end`` it
    emits padding.  With ``keep``, sorted hashes by number of samples, walks that can't match are left."""
    alive, at = np.arange(len(start)), start.copy()
    value = np.zeros(len(start), np.uint64)
    taken = 0
    for j in range(steps[-1] + 1):
        now = np.where(at < end, symbols[np.minimum(at, len(symbols) - 1)], PAD)
        if j == steps[taken]:
            value = mix64(value * np.uint64(31) + now.astype(np.uint64) + np.uint64(7))
            taken += 1
            if keep is not None:
                known = keep[taken - 1]
                place = np.minimum(np.searchsorted(known, value), len(known) - 1)
                on = known[place] == value
                alive, at, value, now, end = alive[on], at[on], value[on], now[on], end[on]
            if taken == len(steps) or not len(alive):
                break
        at = at + bits[j][now]
    return value, alive


def _reach(flat, start, size, ids, seed: int, most: int) -> int:
    """Steps for which the walks of all items stay within them, ``most`` at most: a sample beyond an item's end would
    see what follows a passage in a text."""
    at = start.copy()
    for j in range(most):
        if (at >= start + size).any():
            return j
        at = at + walk_bit(j, ids, seed)[flat[at]]
    return most


class Trials:
    """Random items of the given lengths, each with a copy at the largest distance in front of other words."""

    def __init__(self, rng, lengths: tuple[int, ...], trials: int = 200):
        texts = []
        for t in range(trials):
            length = lengths[t % len(lengths)]
            item = rng.integers(2, 2_000_000, length).tolist()
            copy = list(item)
            for _e in range(int(EDITS * length)):
                kind, at = rng.integers(3), int(rng.integers(len(copy)))
                if kind == 0:
                    copy[at] = int(rng.integers(2, 2_000_000))
                elif kind == 1:
                    copy.insert(at, int(rng.integers(2, 2_000_000)))
                elif len(copy) > 1:
                    del copy[at]
            texts += [item, copy + rng.integers(2, 2_000_000, length).tolist()]
        size = np.array([len(x) for x in texts])
        self.names, self.flat = np.unique(np.concatenate([[PAD], *texts]), return_inverse=True)
        self.flat = self.flat[1:]
        self.pad = int(np.searchsorted(self.names, PAD))
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.found = np.zeros(trials, bool)

    def add(self, steps, seed: int) -> float:
        """Share of the copies that collide with their item in this repetition or an earlier one."""
        at, out = self.start.copy(), []
        for j in range(steps[-1] + 1):
            now = np.where(at < self.end, self.flat[np.minimum(at, len(self.flat) - 1)], self.pad)
            if j in steps:
                out.append(now)
            at = at + walk_bit(j, self.names, seed)[now]
        sig = np.stack(out, 1)
        self.found |= (sig[::2] == sig[1::2]).all(1)
        return float(self.found.mean())


def needs(lengths: list[int], rare: list[int]) -> list[tuple[int, int, int]]:
    """(words of an item that its windows hold at least, rare words likewise, words of such a window at most), for
    runs of items of similar lengths.  An edit takes one word of the item away at most."""
    out, left = [], sorted(zip(lengths, rare, strict=True))
    while left:
        run = [x for x in left if x[0] <= left[0][0] * 1.1]
        left = left[len(run):]
        out.append((run[0][0] - int(EDITS * run[0][0]), min(r - int(EDITS * n) for n, r in run), run[-1][0] + int(EDITS * run[-1][0])))
    return out


class Index:
    """Hash tables of benchmark items, long ones in pieces, for windows of their own size.

    Symbols are words: 0 is any word that no item has, 1 is padding.  The number of repetitions of a
    length class follows from the recall measured on random items and copies at the largest distance."""

    def __init__(self, items: list[list[str]], recall: float = RECALL, samples: int = SAMPLES, seed: int = 11):
        self.vocabulary = {w: i + 2 for i, w in enumerate(sorted({w for x in items for w in x}))}
        self.items = [np.array([self.vocabulary[w] for w in x], np.int64) for x in items]
        self.words = items
        self.classes: list[LengthClass] = []
        rng = np.random.default_rng(seed)
        order = sorted((b - a, i, a) for i, x in enumerate(items) if x for a, b in pieces(len(x)))
        ids = np.arange(len(self.vocabulary) + 2)
        held = np.bincount(np.concatenate([np.unique(x) for x in self.items] or [ids[:0]]), minlength=len(ids))
        common = held > max(2, len(items) // 50)
        while order:
            short = order[0][0]
            own = [p for p in order if p[0] <= max(short * SPREAD, short + 1)]
            order = order[len(own):]
            long = own[-1][0]
            k, parts = samples, [self.items[i][a:a + n] for n, i, a in own]
            flat, size = np.concatenate(parts), np.array([n for n, _i, _a in own])
            start = np.cumsum(size) - size
            trials, reached, seeds, steps = Trials(rng, (short, long)), 0.0, [], []
            while reached < recall:
                if len(seeds) == GIVE_UP:
                    raise ValueError(f"items of {short} to {long} words: a recall of {reached} instead of {recall} after {GIVE_UP} repetitions")
                s = int(rng.integers(1, 2 ** 31))
                early = int(rng.integers(max(min(short, 3), short // 3)))       # most windows end at the first sample: take that early
                reach = _reach(flat, start, size, ids, s, 2 * short)
                rest = np.arange(early + 1, max(reach, early + 1))
                picked = (early, *sorted(rng.choice(rest, min(k - 1, len(rest)), replace=False).tolist()))
                reached = trials.add(picked, s)
                seeds.append(s)
                steps.append(picked)
            mask = np.zeros(len(ids), bool)
            mask[flat] = True
            c = LengthClass(short, long, [(i, a) for _n, i, a in own], seeds, steps, [], [], [], mask, mask & ~common,
                            needs([n for n, _i, _a in own], [int((~common[x]).sum()) for x in parts]))
            for s, picked in zip(seeds, steps, strict=True):
                bits = [walk_bit(j, ids, s).astype(np.int8) for j in range(picked[-1] + 1)]
                c.tables.append(bits)
                c.prefixes.append([np.unique(_sampled(flat, start, start + size, bits, picked[:n])[0]) for n in range(1, len(picked) + 1)])
                owner: dict[int, list[tuple[int, int]]] = {}
                for i, h in zip(c.items, _sampled(flat, start, start + size, bits, picked)[0].tolist(), strict=True):
                    owner.setdefault(h, []).append(i)
                c.owners.append(owner)
            self.classes.append(c)
        self.masks: dict[int, dict[int, int]] = {}
        self.counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [words(t) for t in texts]
        flat = itertools.chain.from_iterable(lists)
        return np.fromiter(map(self.vocabulary.get, flat, itertools.repeat(0)), np.int64), np.array([len(w) for w in lists], np.int64)

    def candidates(self, symbols: np.ndarray, n: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, start) of windows that share a hash with a piece of an item; start, where the item would begin,
        may lie before the text.

        A window within the edits of a piece holds at least the piece's words less the edits; only windows with
        that many words of the class's pieces are walked, which loses none."""
        found: set[tuple[int, int, int]] = set()
        if not len(symbols):
            return found
        stop = np.cumsum(n)
        end = np.repeat(stop, n)
        text = np.repeat(np.arange(len(n)), n)
        for c in self.classes:
            known, rare = (np.append(0, np.cumsum(m[symbols], dtype=np.int32)) for m in (c.mask, c.rare))
            dense = np.zeros(len(symbols), bool)
            for need, least, reach in c.needs:               # may count on into the next text, which only lets more through
                m = max(len(symbols) - reach, 0)
                dense[:m] |= (known[reach:reach + m] - known[:m] >= need) & (rare[reach:reach + m] - rare[:m] >= least)
                dense[m:] |= (known[-1] - known[m:-1] >= need) & (rare[-1] - rare[m:-1] >= least)
            start = np.flatnonzero(dense)
            if not len(start):
                continue
            last = end[start]
            for bits, steps, keep, owner in zip(c.tables, c.steps, c.prefixes, c.owners, strict=True):
                value, alive = _sampled(symbols, start, last, bits, steps, keep)
                for v, i in zip(value.tolist(), alive.tolist(), strict=True):
                    for item, first in owner.get(v, ()):
                        found.add((int(text[start[i]]), item, int(start[i]) - first))
        return found

    def overlap(self, item: int, window: np.ndarray) -> int:
        """Words that the item and the window have in common, with multiplicity: the item's words less the edits at
        least, where the window holds a passage."""
        if item not in self.counts:
            self.counts[item] = np.unique(self.items[item], return_counts=True)
        names, held = self.counts[item]
        place = np.minimum(np.searchsorted(names, window), len(names) - 1)
        return int(np.minimum(np.bincount(place[names[place] == window], minlength=len(names)), held).sum())

    def distance(self, item: int, window: np.ndarray) -> tuple[int, int]:
        """(least number of word edits between the item and any part of the window, end of that part): the
        bit-parallel form of the edit-distance table, a column per word of the window."""
        masks = self.masks.get(item)
        if masks is None:
            masks = self.masks[item] = {}
            for i, s in enumerate(self.items[item].tolist()):
                masks[s] = masks.get(s, 0) | 1 << i
        m = len(self.items[item])
        top, full = 1 << (m - 1), (1 << m) - 1
        up, down, score, best, where = full, 0, m, m, 0
        for j, s in enumerate(window.tolist()):
            eq = masks.get(s, 0)
            x = eq | down
            d = ((((x & up) + up) ^ up) | x) & full
            plus = (down | ~(d | up)) & full
            minus = up & d
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = plus << 1 & full, minus << 1 & full
            up = (minus | ~(d | plus)) & full
            down = plus & d
            if score < best:
                best, where = score, j + 1
        return best, where

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, end of the passage in words) of the best passage of each item in each text."""
        symbols, n = self.encode(texts)
        stop = np.cumsum(n)
        begin = stop - n
        best: dict[tuple[int, int], tuple[int, int]] = {}
        looked: dict[tuple[int, int], int] = {}
        for t, item, start in sorted(self.candidates(symbols, n)):
            now = best.get((t, item))
            if now is not None and now[0] == 0:
                continue
            most = int(EDITS * len(self.items[item]))
            if start < looked.get((t, item), start):
                continue
            a, b = max(start - most, int(begin[t])), min(start + len(self.items[item]) + 2 * most, int(stop[t]))
            if len(self.items[item]) > WHOLE:                # each of its pieces may lead to the same window: once is enough
                looked[t, item] = start + most
                if self.overlap(item, symbols[a:b]) < len(self.items[item]) - most:
                    continue
            edits, where = self.distance(item, symbols[a:b])
            if edits <= most:
                if now is None or edits < now[0]:
                    best[t, item] = (edits, a + where - int(begin[t]))
                looked[t, item] = start + most
        return [(t, i, e, w) for (t, i), (e, w) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Blocks of (item ids, word lists) of at most BLOCK_WORDS words, read one by one; an item without an
    id is an item like others, and one without words is left out."""
    ids, lists, total = [], [], 0
    for r in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).orderBy("i", "t").toLocalIterator():
        w = words(r.t)
        if not w:
            continue
        if total and total + len(w) > BLOCK_WORDS:
            yield ids, lists
            ids, lists, total = [], [], 0
        ids.append(r.i)
        lists.append(w)
        total += len(w)
    if ids:
        yield ids, lists


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, edits, end_word) of every document that holds a passage within EDITS of an item's words: one
    row per document and item, with its least number of edits and the word at which that passage ends.

    Words are lower-case runs of letters, digits and underscores.  The benchmark is the query set: its blocks
    are of bounded size, and GROUP of them at a time are searched in all documents by a narrow job, without a shuffle; a
    document's windows are compared with hash tables, never with every item.  Verbatim passages are always
    found; those at the largest distance with ``recall``, as measured when the tables are built (an error if it can't be
    reached).  Items of more than WHOLE words are looked for by their pieces and compared as a whole.

    Null and empty texts and items match nothing.  An item or a document without an id gives rows with a null in its place.
    Repeated rows give repeated results, empty tables give no rows, and other columns are not read, whatever their names."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    from pyspark.sql.pandas.types import to_arrow_type
    arrow = to_arrow_type(item_kind)

    def search(blobs):
        def run(batches):
            kept_by("decontaminate")
            indexes = [pickle.loads(b.value) for b in blobs]
            for batch in slices(batches):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                rows = []
                for a, b in portions(map(len, texts), CHARS):
                    for names, index in indexes:
                        rows += [(t + a, names[i], e, w) for t, i, e, w in index.matches(texts[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], arrow),
                     pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())],
                    names=["doc_id", "item_id", "edits", "end_word"])
        return run

    def searched(blobs):
        return own.mapInArrow(search(blobs), f"doc_id {kind}, item_id {item_kind.simpleString()}, edits int, end_word int")

    group = []
    for ids, lists in item_blocks(benchmark, item_col, item_text_col):
        group.append(docs.sparkSession.sparkContext.broadcast(pickle.dumps((ids, Index(lists, recall)))))
        if len(group) == GROUP:
            out, group = searched(group) if out is None else out.unionByName(searched(group)), []
    if group:
        out = searched(group) if out is None else out.unionByName(searched(group))
    if out is None:
        return own.where("false").select("doc_id", F.lit(None).cast(item_kind).alias("item_id"), F.lit(0).alias("edits"), F.lit(0).alias("end_word"))
    return out
