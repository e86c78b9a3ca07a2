"""Structure to vector, evaluated inside tasks on whole Arrow batches.

A map is ``sign(sum(key * value))``, a set ``SET * sign(sum(items))``, and a list is
reduced by one of the list modes.  The sign is taken at every level of nesting.  Weighted
sums use integer weights (``floor(w * 10**6 + 0.5)``) so a sign never depends on the order
in which floats were added.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ternweave.functions.codebook import SET_ATOM, atom_matrix, atom_text, atom_vector, position_atom
from ternweave.functions.kernels import rows_per_block, segment_starts, segment_sums, sign

SCALE = 1_000_000

BASE_MODES = ("positional", "chained", "ngram", "bundle")
LIST_MODES = BASE_MODES + ("ngram_configurable", "ngram_weighted", "subsequence_aligned", "best_match",
                           "semantic_field", "context_window")

# The default term groups of the semantic_field mode.
SEMANTIC_GROUPS = {
    "mathematical": ["calculus", "differential", "integral", "derivative", "function"],
    "logical": ["therefore", "hence", "thus", "consequently", "follows"],
    "temporal": ["before", "after", "then", "now", "when", "time"],
    "spatial": ["above", "below", "beside", "between", "around"],
}

# Named n-gram settings per domain.
NGRAM_PRESETS = {
    "text": {"n_sizes": [2]},
    "phrases": {"n_sizes": [2, 3]},
    "dna": {"n_sizes": [3, 6, 9]},
    "code": {"n_sizes": [2, 3, 4]},
    "time_series": {"n_sizes": [3, 5, 7]},
}


def int_weight(w):
    return np.floor(np.asarray(w, np.float64) * SCALE + 0.5).astype(np.int64)


def check_mode(mode: str, config: dict) -> None:
    """Driver-side validation of a list mode and its settings."""
    if mode not in LIST_MODES:
        raise ValueError(f"unknown list mode {mode!r}; expected one of {LIST_MODES}")
    sizes, weights = config.get("n_sizes"), config.get("weights")
    if mode == "ngram_configurable" and weights is not None and len(weights) != len(sizes or [2]):
        raise ValueError("give one weight for each of n_sizes")
    if any(n < 1 for n in sizes or []):
        raise ValueError("n_sizes must be positive")
    if mode == "subsequence_aligned" and config.get("alignment_mode", "sliding_window") not in (
            "sliding_window", "best_match"):
        raise ValueError(f"unknown alignment_mode {config['alignment_mode']!r}")


def pattern_plan(mode: str, config: dict):
    """(sizes and weights, stride, length under which a list is only bundled, weight rules)."""
    rules = {k: config.get(k) for k in
             ("length_penalty", "term_weighting", "positional_weighting", "discrimination_boost")}
    window = config.get("window_size", 3)
    if mode == "subsequence_aligned" and config.get("alignment_mode") == "best_match":
        mode = "best_match"
    if mode in ("bundle", "semantic_field"):
        return [(1, 1.0)], 1, 0, {}
    if mode == "ngram":
        sizes = config.get("n_sizes") or [1, 2]
        weights = config.get("weights") or [1.0] * len(sizes)
        if config.get("idf_weighting") and config.get("corpus_stats"):
            rules["idf"] = ("ngram_{n}_{i}", config["corpus_stats"], 2.0, 0.8)
        return list(zip(sizes, weights)), 1, 2, rules
    if mode == "ngram_configurable":
        sizes = config.get("n_sizes") or [2]
        weights = config.get("weights") or [1.0] * len(sizes)
        return list(zip(sizes, weights)), 1, 0, {}
    if mode == "ngram_weighted":
        if config.get("corpus_stats"):
            return [(2, 1.0), (1, 0.5)], 1, 2, {"idf": ("{i}:{j}", config["corpus_stats"], 3.0, 1.0)}
        return [(2, 1.0), (1, 0.5)], 1, 2, {}
    if mode == "subsequence_aligned":
        return [(window, 1.0)], 1, window, {"positional_weighting": True}
    if mode == "best_match":
        return [(3, 1.0), (2, 1.0)], 1, max(2, window), {"first_only": True}
    if mode == "context_window":
        return [(window, 1.0)], config.get("stride", 1), window, {}
    raise ValueError(f"unknown list mode {mode!r}")


def _pattern_weights(n, base, pos, length, ordinal, product, rules):
    """float64 weight of every pattern row."""
    w = np.full(len(pos), float(base))
    dims = product.shape[1]
    if rules.get("term_weighting") and n == 1:
        nnz = np.count_nonzero(product, axis=1).astype(np.float64)
        w *= np.minimum(np.maximum(np.sqrt(nnz) * (nnz / dims) / 1000.0, 0.5), 2.0)
    if rules.get("positional_weighting") and n > 1:
        w *= 1.0 / (pos + 1)
    if rules.get("idf"):
        key, stats, cap, single = rules["idf"]
        if n == 1:
            w *= single
        else:
            w *= np.minimum([stats.get(key.format(n=n, i=i, j=i + 1), 1.0) for i in pos], cap)
    if rules.get("length_penalty"):
        if rules.get("discrimination_boost"):
            w *= 1.0 / np.sqrt(length)
        w *= np.where(ordinal < length, 1.2, 0.8)
    if rules.get("discrimination_boost"):
        total = product.sum(axis=1, dtype=np.int64) / dims
        nnz = np.count_nonzero(product, axis=1) / dims
        w *= np.minimum(w * w * (nnz - total * total) / 0.1, 1.5)
    return w


def reduce_lists(fetch: Callable[[int, int], np.ndarray], offsets: np.ndarray, dims: int,
                 mode: str = "positional", config: dict | None = None) -> np.ndarray:
    """int8[n_lists, dims] from flattened items; ``fetch(s, e)`` gives item vectors ``s..e``.

    Items are visited in bounded chunks, so one very long list needs no more memory than
    many short ones.
    """
    config = config or {}
    n_lists = len(offsets) - 1
    lengths = np.diff(offsets)
    first, last = int(offsets[0]), int(offsets[-1])
    owner = np.repeat(np.arange(n_lists), lengths)
    place = np.arange(first, last) - np.repeat(offsets[:-1], lengths)
    step = rows_per_block(dims, 8)

    if mode == "chained":
        acc = np.ones((n_lists, dims), np.int8)
        acc[lengths == 0] = 0
        for s in range(first, last, step):
            e = min(s + step, last)
            own = owner[s - first:e - first]
            items, cut = fetch(s, e), segment_starts(own)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), e - s]):
                acc[own[a]] *= np.multiply.reduce(items[a:b], axis=0)
        return acc

    if mode == "positional":
        plan, stride, short, rules = [(1, 1.0)], 1, 0, {}
    else:
        plan, stride, short, rules = pattern_plan(mode, config)
    plain = not any(rules.values()) and all(w == 1.0 for _, w in plan)
    acc = np.zeros((n_lists, dims), np.int32 if plain else np.int64)
    widest = max([n for n, _ in plan] + [1])

    def add(rows, own, weights):
        if not len(own):
            return
        cut = segment_starts(own)
        acc[own[cut]] += segment_sums(rows, cut, None if plain else weights)

    for s in range(first, last, step):
        e = min(s + step, last)
        items = fetch(s, min(e + widest - 1, last))
        own, pos = owner[s - first:e - first], place[s - first:e - first]
        length = lengths[own]
        brief = length < short
        if mode == "positional":
            uniq, code = np.unique(pos, return_inverse=True)
            items = items * atom_matrix([position_atom(int(i)) for i in uniq], dims)[code]
        if brief.any():
            idx = np.flatnonzero(brief)
            add(items[idx], own[idx], int_weight(np.ones(len(idx))))
        before = np.zeros(len(own), np.int64)
        for n, base in plan:
            ok = ~brief & (pos + n <= length) & (pos % stride == 0)
            if rules.get("first_only"):
                ok &= (pos == 0) & (np.minimum(length, 3) == n)
            idx = np.flatnonzero(ok)
            if len(idx):
                whole = len(idx) == len(ok)
                rows = items[:len(ok)] if whole else items[idx]
                for k in range(1, n):
                    rows = rows * (items[k:k + len(ok)] if whole else items[idx + k])
                w = None
                if not plain:
                    w = int_weight(_pattern_weights(n, base, pos[idx], length[idx], before[idx] + pos[idx],
                                                    rows, rules))
                add(rows, own[idx], w)
            before = before + np.maximum(length - n + 1, 0)
    out = sign(acc)
    if mode == "semantic_field":
        out *= semantic_vector(config.get("semantic_groups") or SEMANTIC_GROUPS,
                               config.get("field_weights") or {}, dims)
    return out


def semantic_vector(groups: dict, weights: dict, dims: int) -> np.ndarray:
    total = np.zeros(dims, np.int64)
    for name, terms in groups.items():
        if terms:
            total += int_weight(weights.get(name, 1.0)) * sign(atom_matrix(terms, dims).sum(axis=0, dtype=np.int64))
    return sign(total)


def encode_array(arr: pa.Array, dims: int, hints: dict, sets: frozenset, path: str = "",
                 inherited: tuple[str, dict] = ("positional", {}), skip_nulls: bool = False) -> np.ndarray:
    """int8[len(arr), dims] for an Arrow column of any nesting."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    kind = arr.type
    inherited = hints.get(path, inherited)
    if pa.types.is_struct(kind):
        acc = np.zeros((len(arr), dims), np.int16)
        for i in range(kind.num_fields):
            name = kind.field(i).name
            child = arr.field(i)
            value = encode_array(child, dims, hints, sets, f"{path}.{name}" if path else name, inherited, skip_nulls)
            if skip_nulls and child.null_count:
                value = np.where(child.is_null().to_numpy(zero_copy_only=False)[:, None], np.int8(0), value)
            acc += value * atom_vector(name, dims)
        return _nil_rows(sign(acc), arr, dims)
    if pa.types.is_map(kind):
        offsets = arr.offsets.to_numpy()

        def pairs(s, e):
            return _scalars(arr.keys.slice(s, e - s), dims) * encode_array(
                arr.items.slice(s, e - s), dims, hints, sets, path + ".*", inherited, skip_nulls)

        return _nil_rows(reduce_lists(pairs, offsets, dims, "bundle"), arr, dims)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        offsets = arr.offsets.to_numpy().astype(np.int64)

        def items(s, e):
            return encode_array(arr.values.slice(s, e - s), dims, hints, sets, path + ".[]",
                                ("positional", {}), skip_nulls)

        if path in sets:
            return _nil_rows(reduce_lists(items, offsets, dims, "bundle") * atom_vector(SET_ATOM, dims), arr, dims)
        return _nil_rows(reduce_lists(items, offsets, dims, *inherited), arr, dims)
    return _scalars(arr, dims)


def _scalars(arr, dims: int) -> np.ndarray:
    d = arr.dictionary_encode(null_encoding="encode")
    values = d.dictionary
    values = values.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(values.type) else values.to_pylist()
    if pa.types.is_float32(d.dictionary.type):
        values = [v if v is None else float(str(np.float32(v))) for v in values]     # the shortest text, as SQL has it
    book = atom_matrix([atom_text(v) for v in values], dims)
    return book[d.indices.to_numpy(zero_copy_only=False)]


def _nil_rows(mat: np.ndarray, arr, dims: int) -> np.ndarray:
    if arr.null_count:
        mat[arr.is_null().to_numpy(zero_copy_only=False)] = atom_vector("nil", dims)
    return mat


def encode_value(value, dims: int, mode: str = "positional", config: dict | None = None) -> np.ndarray:
    """One parsed document (dict / list / scalar, ``{"#set": [...]}`` for sets)."""
    if isinstance(value, dict):
        if set(value) == {"#set"}:
            if not value["#set"]:
                return np.zeros(dims, np.int8)
            items = np.stack([encode_value(v, dims) for v in value["#set"]])
            return sign(items.sum(axis=0, dtype=np.int32)) * atom_vector(SET_ATOM, dims)
        acc = np.zeros(dims, np.int32)
        for key, child in value.items():
            child_mode, child_config = mode, config or {}
            if isinstance(child, dict):
                hinted = child.get("_encode_mode")
                child_mode = hinted if hinted in LIST_MODES else mode
                child_config = {**child_config, **(child.get("_encode_config") or {})}
                child = {k: v for k, v in child.items() if k not in ("_encode_mode", "_encode_config")}
            acc += atom_vector(atom_text(key), dims) * encode_value(child, dims, child_mode, child_config)
        return sign(acc)
    if isinstance(value, list):
        if not value:
            return np.zeros(dims, np.int8)
        if mode in ("bundle", "positional") and len(value) <= rows_per_block(dims):
            acc = np.zeros(dims, np.int32)
            for i, v in enumerate(value):
                item = encode_value(v, dims)
                acc += item * atom_vector(position_atom(i), dims) if mode == "positional" else item
            return sign(acc)
        return reduce_lists(lambda s, e: np.stack([encode_value(v, dims) for v in value[s:e]]),
                            np.array([0, len(value)]), dims, mode, config)[0]
    return atom_vector(atom_text(value), dims)


def encode_json_texts(texts, dims: int):
    """Bytes per JSON text; ``None`` for malformed or null input."""
    out = []
    for t in texts:
        try:
            out.append(None if t is None else encode_value(json.loads(t), dims).tobytes())
        except (ValueError, TypeError, AttributeError, RecursionError):
            out.append(None)
    return out


def list_atoms(value, found: set[str]) -> set[str]:
    """All keys and scalars below a parsed document, as atom texts."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k != "#set":
                found.add(atom_text(k))
            list_atoms(v, found)
    elif isinstance(value, list):
        for v in value:
            list_atoms(v, found)
    else:
        found.add(atom_text(value))
    return found
