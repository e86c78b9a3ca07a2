"""Token counts of a byte-fallback piece model, by merging ragged arrays in step with the ranks."""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternweave.llm.common import portions

SPACE = "▁"
NONE = np.int64(2) ** 62
#: Pre-tokens of more symbols are merged with a queue: their rounds would rescan them too often.
LONG = 2000
CHARS = 4_000_000
CACHE = 300_000


class Merger:
    """Merge rules of a model file.

    The rank of a pair is the place of the merged piece's score.  Pre-tokens begin at runs of the
    space mark, and are cut where no piece goes on: around line ends that are no piece, and before
    those ASCII marks that no piece holds behind a letter or digit.  So they merge independently of
    each other."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i): i for i in range(sp.vocab_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece goes on over a space")
        score = np.array([sp.get_score(i) for i in range(sp.vocab_size())])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        self.size = sp.vocab_size() + 8
        self.char = {p: i for p, i in pieces.items() if len(p) == 1}
        self.symbol = self.size - 8 + np.array([1, 2, 3, 4])[np.searchsorted([0x80, 0x800, 0x10000], np.arange(0x110000), side="right")]
        self.symbol[[ord(c) for c in self.char]] = list(self.char.values())
        self.rule = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = pieces.get(p[:k]), pieces.get(p[k:])
                if a is not None and b is not None:
                    self.rule[a * self.size + b] = i
        self._table()
        marks = {chr(c) for c in range(33, 127) if not chr(c).isalnum()}
        while late := {b for p in pieces for a, b in zip(p, p[1:], strict=False) if b in marks and a not in marks and a != SPACE}:
            marks -= late
        mark, gap = (re.escape("".join(sorted(c))) for c in (marks, {c for c in "\n\r\t" if c not in self.char}))
        other = f"[^{SPACE}{mark}{gap}]"
        lead = f"[{mark}]*" if mark else ""
        self.split = re.compile("|".join([f"{SPACE}+{lead}{other}*", f"{other}+"] + ([f"[{mark}]+{other}*"] if mark else [])
                                         + ([f"[{gap}]"] if gap else [])))

    def _table(self):
        """The rules as an open-addressed table that looks up whole arrays."""
        self.bits = max(10, int(np.ceil(np.log2(8 * len(self.rule) + 8))))
        self.slot_key, self.slot_piece = np.full(2 ** self.bits, -1, np.int64), np.zeros(2 ** self.bits, np.int64)
        keys, pieces = np.array(list(self.rule), np.int64), np.array(list(self.rule.values()), np.int64)
        at = self._place(keys)
        while len(keys):
            free = self.slot_key[at] < 0
            _, first = np.unique(at, return_index=True)
            put = first[free[first]]
            self.slot_key[at[put]], self.slot_piece[at[put]] = keys[put], pieces[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, pieces, at = keys[rest], pieces[rest], (at[rest] + 1) % 2 ** self.bits

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pretokens(self, text: str) -> list[str]:
        return self.split.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def weight(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens of each surviving symbol."""
        return np.where(symbols > self.size - 8, symbols - (self.size - 8), 1)

    def pairs(self, left: np.ndarray, right: np.ndarray):
        """(rank, merged piece) of neighbours; rank NONE if they don't merge."""
        key = left * self.size + right
        at = self._place(key)
        there = self.slot_key[at]
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % 2 ** self.bits
            there[open_] = self.slot_key[at[open_]]
            open_ = open_[(there[open_] != key[open_]) & (there[open_] >= 0)]
        piece = self.slot_piece[at]
        return np.where(there == key, self.rank[piece], NONE), piece

    def counts(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        out = np.zeros(len(words), np.int64)
        length = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(length > LONG):
            out[i] = self._queue(self.symbol[np.frombuffer(words[i].encode("utf-32-le", "replace"), np.uint32)].tolist())
        short = np.flatnonzero((length > 0) & (length <= LONG))
        flat = np.frombuffer("".join(words[i] for i in short).encode("utf-32-le", "replace"), np.uint32)
        sym, word = self.symbol[flat], np.repeat(short, length[short])
        while len(sym):
            same = np.append(word[1:] == word[:-1], False)
            rank, piece = self.pairs(sym, np.append(sym[1:], 0))
            rank = np.where(same, rank, NONE)
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(sym)))
            done = best == NONE
            if done.any():
                ended = np.repeat(done, length)
                out += np.bincount(word[ended], self.weight(sym[ended]), minlength=len(out)).astype(np.int64)
                on = ~ended
                sym, word, rank, piece, same = sym[on], word[on], rank[on], piece[on], same[on]
                best, length = best[~done], length[~done]
                if not len(sym):
                    break
            least = np.repeat(best, length)
            start = np.cumsum(length) - length
            chosen = rank == least
            first = np.zeros(len(sym), bool)
            first[self._first(chosen, start)] = True
            take = chosen & ~self._overlapped(chosen)
            after = self._apply(sym, word, piece, take)
            # a merge may open an earlier one, or another piece of the same rank: then the leftmost pair goes alone
            risky = self._opened(*after, sym, same, piece, take, least)
            other = chosen & (piece != np.repeat(piece[first], length))
            alone = np.unique(np.append(risky, word[other]))
            if len(alone):
                hold = np.isin(word, alone)
                take = np.where(hold, first, take)
                after = self._apply(sym, word, piece, take)
            sym, word = after[0], after[1]
        return out

    @staticmethod
    def _first(chosen: np.ndarray, start: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(chosen)
        return at[np.searchsorted(at, start)]

    @staticmethod
    def _overlapped(chosen: np.ndarray) -> np.ndarray:
        """Every second one of a run of chosen neighbours: its left symbol is taken already."""
        i = np.arange(len(chosen))
        run = np.maximum.accumulate(np.where(~chosen, i, -1))
        return chosen & ((i - run) % 2 == 0)

    @staticmethod
    def _apply(sym, word, piece, take):
        new = np.where(take, piece, sym)
        keep = np.append(True, ~take[:-1])
        return new[keep], word[keep], take[keep], np.flatnonzero(keep)

    def _opened(self, new, word, took, origin, sym, same, piece, take, least):
        """Words in which a merged symbol makes a pair with a neighbour that is due before the rest."""
        at = np.flatnonzero(took)
        bound = least[origin[at]]
        bad = []
        left = at[(at > 0)]
        left = left[word[left] == word[left - 1]]
        if len(left):
            r, _ = self.pairs(new[left - 1], new[left])
            bad.append(word[left][r <= least[origin[left]]])
        # the right neighbour as it stands before it is merged itself
        nxt = origin[at] + 2
        ok = (nxt < len(sym))
        ok[ok] &= same[origin[at][ok] + 1]
        if ok.any():
            r, _ = self.pairs(new[at[ok]], sym[nxt[ok]])
            bad.append(word[at[ok]][r <= bound[ok]])
        return np.concatenate(bad) if bad else np.zeros(0, np.int64)

    def _queue(self, symbols: list[int]) -> int:
        """Tokens of one very long pre-token, merged pair by pair from a priority queue."""
        n = len(symbols)
        nxt, prv, sym, heap = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols), []

        def offer(i):
            j = nxt[i]
            m = self.rule.get(sym[i] * self.size + sym[j]) if j < n else None
            if m is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, sym[i], sym[j], m))

        for i in range(n - 1):
            offer(i)
        while heap:
            _r, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j], nxt[i] = m, -1, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return int(self.weight(np.array([s for s in sym if s >= 0])).sum())


class Counter:
    """Tokens of texts; counts of pre-tokens are remembered, new ones are merged together."""

    def __init__(self, path: str):
        self.merger, self.known = Merger(path), {}

    def __call__(self, texts: list[str]) -> list[int]:
        split = [self.merger.pretokens(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(set().union(*split).difference(self.known)) if split else []
        self.known.update(zip(new, self.merger.counts(new).tolist(), strict=True))
        return [sum(map(self.known.__getitem__, s)) for s in split]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, with the tokens that the model's own
    library gives, without begin or end tokens.

    A narrow job: no shuffle, and a task holds one batch and a bounded memory of pre-tokens.  Null
    is an empty text, of 0 bytes and tokens.  Ids may repeat or be null; an empty table gives no
    rows; other columns are not read.  ``model`` is a path that every executor can open."""
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        counter = Counter(model)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            size = [len(t.encode()) for t in texts]
            tokens = []
            for a, b in portions(map(len, texts), CHARS):
                tokens += counter(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
