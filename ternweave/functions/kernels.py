"""Block arithmetic on Arrow columns of vectors.  Small, stateless, used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 32 << 20


def rows_per_block(dims: int, item_bytes: int = 4) -> int:
    return max(1, BLOCK_BYTES // (dims * item_bytes))


def sign(x: np.ndarray) -> np.ndarray:
    return np.sign(x).astype(np.int8)


def segment_starts(owner: np.ndarray) -> np.ndarray:
    """First row of every run of equal owners."""
    return np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])


def segment_sums(rows: np.ndarray, starts: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Exact (weighted) sums of runs of small-integer rows.

    A contiguous slice sum is far faster than ``reduceat`` along the first axis.  Weighted sums
    go through float64, which is exact below 2**53.
    """
    ends = np.r_[starts[1:], len(rows)]
    if weights is not None:
        out = np.empty((len(starts), rows.shape[1]), np.int64)
        w = weights.astype(np.float64)
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            out[i] = w[a:b] @ rows[a:b].astype(np.float64)
        return out
    narrow = rows.dtype == np.int8 and (ends - starts).max(initial=0) < (1 << 15)
    out = np.empty((len(starts), rows.shape[1]), np.int16 if narrow else np.int64)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        rows[a:b].sum(axis=0, dtype=out.dtype, out=out[i])
    return out


def to_matrix(col, dims: int) -> np.ndarray:
    """``BINARY`` column (one byte per dimension) to int8[n, dims]; nulls become zero vectors."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, dims), np.int8)
    if col.null_count == 0:
        kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
        offsets = np.frombuffer(col.buffers()[1], kind, count=n + 1, offset=col.offset * np.dtype(kind).itemsize)
        lengths = np.diff(offsets)
        if not (lengths == dims).all():
            raise ValueError(f"vector length mismatch: expected {dims}, found {sorted(set(lengths.tolist()))[:3]}")
        return np.frombuffer(col.buffers()[2], np.int8, count=n * dims, offset=int(offsets[0])).reshape(n, dims)
    out = np.zeros((n, dims), np.int8)
    for i, v in enumerate(col.to_pylist()):
        if v is not None:
            if len(v) != dims:
                raise ValueError(f"vector length mismatch: expected {dims}, found {len(v)}")
            out[i] = np.frombuffer(v, np.int8)
    return out


def to_binary(mat: np.ndarray) -> pa.Array:
    n, dims = mat.shape
    data = np.ascontiguousarray(mat, dtype=np.int8)
    offsets = (np.arange(n + 1, dtype=np.int64) * dims)
    if offsets[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def float_matrix(col) -> np.ndarray:
    """``ARRAY<numeric>`` column of one common length to float64[n, d]."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, 0))
    lengths = np.diff(col.offsets.to_numpy())
    if col.null_count or not (lengths == lengths[0]).all():
        raise ValueError("vectors must be non-null and of one length")
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def cosine_from(dots, na2, nb2):
    """cos from dot products and squared norms; 0 where a norm is 0."""
    den = np.sqrt(np.multiply.outer(na2, nb2)) if np.ndim(dots) == 2 else np.sqrt(na2 * nb2)
    return np.divide(dots, den, out=np.zeros_like(den, dtype=np.float64), where=den > 0)


def widened(probes: np.ndarray, binary: bool) -> np.ndarray:
    """Probes in the type of the product with binary or float vectors; to be done once per task."""
    return np.ascontiguousarray(probes, np.float32 if binary else np.float64)


def score_block(metric: str, docs: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """float64[docs, probes]; larger is always better.  Probes of :func:`widened` are not copied again."""
    wide = np.float64 if docs.dtype.kind == "f" else np.float32
    a, b = docs.astype(wide), probes.astype(wide, copy=False)
    dots = (a @ b.T).astype(np.float64)
    if metric == "raw_dot":
        return dots
    if metric == "dot":
        return dots / docs.shape[1]
    na2 = np.einsum("ij,ij->i", a, a).astype(np.float64)
    nb2 = np.einsum("ij,ij->i", b, b).astype(np.float64)
    cos = cosine_from(dots, na2, nb2)
    if metric == "cosine":
        return cos
    if metric == "cosine01":
        zero = (np.multiply.outer(na2, nb2) == 0)
        return np.where(zero, 0.0, (cos + 1) / 2)
    if metric == "euclidean":
        d2 = np.maximum(na2[:, None] + nb2[None, :] - 2 * dots, 0)
        return np.exp(-np.sqrt(d2) / 10)
    if metric == "manhattan":
        out = np.empty_like(dots)
        for j in range(b.shape[0]):
            out[:, j] = np.abs(a - b[j]).sum(axis=1)
        return np.exp(-out / (10 * docs.shape[1]))
    if metric == "length_normalized":
        lo = np.sqrt(np.minimum.outer(na2, nb2))
        hi = np.sqrt(np.maximum.outer(na2, nb2))
        return cos * np.divide(lo, hi, out=np.zeros_like(lo), where=hi > 0)
    if metric == "contiguous_bonus":
        return np.minimum(cos + 0.1 * 0.5, 1.0)
    if metric == "multi":
        c01 = score_block("cosine01", docs, probes)
        return (0.4 * c01 + 0.3 * (c01 + 100) / 200 + 0.2 * score_block("euclidean", docs, probes)
                + 0.1 * score_block("manhattan", docs, probes))
    if metric == "contextual":
        return score_block("cosine01", docs, probes)
    if metric == "hierarchical":
        size = docs.shape[1] // 8
        return sum(w * score_block("cosine01", docs[:, s * size:(s + 1) * size], probes[:, s * size:(s + 1) * size])
                   for s, w in enumerate((0.5, 0.3, 0.2)) if size)
    if metric == "ensemble":
        c01 = score_block("cosine01", docs, probes)
        length = docs.shape[1] // 100
        boost = 0.8 if length < 3 and abs(length - 1) > 1 else 1.0
        return np.minimum(0.5 * c01 + 0.3 * score_block("hierarchical", docs, probes)
                          + 0.2 * np.minimum(c01 * boost, 1.0), 1.0)
    raise ValueError(f"unknown metric {metric!r}")


METRICS = ("raw_dot", "dot", "cosine", "cosine01", "euclidean", "manhattan", "length_normalized",
           "contiguous_bonus", "multi", "contextual", "hierarchical", "ensemble")
