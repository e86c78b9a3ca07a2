"""Atom text and the hash-derived codebook.

Dimension ``i`` of atom ``a`` belongs to block ``i // 64``.  ``md5(a || '#' || block)`` holds
eight 16-bit words, and word ``w`` gives the eight trits ``(w // 3**j) % 3 - 1`` for j = 0..7
(3**8 divides the range of a word almost evenly, so each trit is uniform).  Every executor can
derive every vector on its own, so no codebook table is shared, broadcast or kept in insertion
order.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
WORD_TRITS = 8
RESERVED = "\u0001"
SET_ATOM = RESERVED + "set"
POSITION_PREFIX = RESERVED + "pos:"

_TRITS_OF_WORD = (np.arange(1 << 16)[:, None] // 3 ** np.arange(WORD_TRITS) % 3 - 1).astype(np.int8)
_EIGHT_TRITS = _TRITS_OF_WORD.view(np.int64).ravel()
#: Bytes of the cache of a process, and of an entry besides its vector and text: array, key and links, which outweigh a short vector.
_CACHE_BYTES, _ENTRY_BYTES = 64 << 20, 560
#: Bytes of an atom's text and its place in the table of a book.
_SLOT_BYTES = 240
_cache: OrderedDict[tuple[str, int], np.ndarray] = OrderedDict()
_cached_bytes = 0


def check_dims(dims: int) -> int:
    if dims < BLOCK or dims % BLOCK:
        raise ValueError(f"dims must be a positive multiple of {BLOCK}, got {dims}")
    return dims


def position_atom(i: int) -> str:
    return f"{POSITION_PREFIX}{i}"


def atom_vector(atom: str, dims: int) -> np.ndarray:
    """int8[dims] for one atom, kept in a bounded per-process cache."""
    global _cached_bytes
    key = (atom, dims)
    hit = _cache.get(key)
    if hit is not None:
        _cache.move_to_end(key)
        return hit
    head = (atom + "#").encode()
    digests = b"".join([hashlib.md5(head + b"%d" % b).digest() for b in range(dims // BLOCK)])
    vec = _TRITS_OF_WORD[np.frombuffer(digests, ">u2")].reshape(dims)
    _cache[key] = vec
    _cached_bytes += dims + len(atom) + _ENTRY_BYTES
    while _cached_bytes > _CACHE_BYTES and len(_cache) > 1:
        (old, old_dims), _v = _cache.popitem(last=False)
        _cached_bytes -= old_dims + len(old) + _ENTRY_BYTES
    return vec


def _derived(atoms: list[str], dims: int) -> np.ndarray:
    """int8[len(atoms), dims], from the digests of all of them at once."""
    ends = [b"#%d" % b for b in range(dims // BLOCK)]
    digests = b"".join([hashlib.md5(head + end).digest() for head in [a.encode() for a in atoms] for end in ends])
    return _EIGHT_TRITS[np.frombuffer(digests, ">u2")].view(np.int8).reshape(len(atoms), dims)


class _Book:
    """Vectors of the atoms met last, in two generations: a full one becomes the old one, and of the old one those that are met again are
    kept.  So words that recur are derived once, however many others pass by."""

    def __init__(self, dims: int):
        self.size = max(1, _CACHE_BYTES // 2 // (dims + _SLOT_BYTES))
        self.dims, self.old, self.new = dims, ({}, None), ({}, np.empty((self.size, dims), np.int8))

    def read(self, atoms: list[str], out: np.ndarray) -> None:
        slots, rows = self.new
        at = np.fromiter((slots.get(a, -1) for a in atoms), np.int64, len(atoms))
        known = at >= 0
        if known.all():
            np.take(rows, at, axis=0, out=out, mode="clip")
            return
        out[known] = rows[at[known]]
        rest = np.flatnonzero(~known)
        names = [atoms[i] for i in rest]
        before = np.fromiter((self.old[0].get(a, -1) for a in names), np.int64, len(names))
        met = before >= 0
        if met.any():
            out[rest[met]] = self.old[1][before[met]]
        if not met.all():
            out[rest[~met]] = _derived([a for a, m in zip(names, met) if not m], self.dims)
        if len(slots) + len(names) > self.size:
            self.old, self.new = self.new, ({}, np.empty((self.size, self.dims), np.int8))
            slots, rows = self.new
        first = len(slots)
        for a in names:
            slots.setdefault(a, len(slots))
        places = np.fromiter((slots[a] for a in names), np.int64, len(names))
        rows[places[places >= first]] = out[rest[places >= first]]


_books: dict[int, _Book] = {}


def atom_matrix(atoms, dims: int) -> np.ndarray:
    """int8[len(atoms), dims]."""
    out = np.empty((len(atoms), dims), np.int8)
    if dims not in _books:
        _books.clear()                                                             # a process works on one width at a time
        _books[dims] = _Book(dims)
    book = _books[dims]
    for s in range(0, len(atoms), book.size):
        book.read(list(atoms[s:s + book.size]), out[s:s + book.size])
    return out


def atom_text(value) -> str:
    """Text of a scalar: ``True``/``False`` for booleans, ``nil`` for null, else ``str``."""
    if value is None:
        return "nil"
    return value if isinstance(value, str) else str(value)


def _float_text(text: Column) -> Column:
    """The text that Python gives the double whose SQL text is ``text``: plain between 1e-4 and 1e16."""
    size = F.abs(text.try_cast("double"))
    plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    scientific = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(
        F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    return (F.when(F.isnan(text.try_cast("double")), "nan").when(text == "Infinity", "inf").when(text == "-Infinity", "-inf")
            .when((size >= 1e-3) & (size < 1e7) | (size == 0), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(scientific))


def canon_atom(col, data_type: str | None = None) -> Column:
    """The same text as :func:`atom_text`, as a JVM expression.  Booleans, floats and doubles are known by the
    column's type; a FLOAT has the text of its shortest decimal form.  (Before version 19 Java itself gives a digit more
    than needed for a few numbers, such as 2.5e22; those alone differ.)"""
    c = F.col(col) if isinstance(col, str) else col
    text, kind = c.cast("string"), F.typeof(c)
    text = (F.when(F.lit(data_type == "boolean") | (kind == "boolean"), F.initcap(text))
            .when(kind.isin("double", "float"), _float_text(text)).otherwise(text))
    return F.coalesce(text, F.lit("nil"))


def atom_trits(atom: Column, dims: int) -> Column:
    """Codebook lookup as a built-in expression giving ``ARRAY<TINYINT>``."""
    check_dims(dims)

    def block(b):
        h = F.md5(F.concat(atom, F.lit("#"), b.cast("string")).cast("binary"))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BLOCK // WORD_TRITS - 1)), lambda i: trits(
            F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))))

    def trits(word):
        return F.array(*[(F.floor(word / F.lit(3**j)) % 3 - 1).cast("tinyint") for j in range(WORD_TRITS)])

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(dims // BLOCK - 1)), block))


def position_trits(i: Column, dims: int) -> Column:
    return atom_trits(F.concat(F.lit(POSITION_PREFIX), i.cast("string")), dims)
