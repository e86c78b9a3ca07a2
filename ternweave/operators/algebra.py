"""Vector algebra: element-wise forms on columns, grouped forms as two-step aggregates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ternweave.functions import kernels as K
from ternweave.functions.encoding import int_weight

SLOTS = 64


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _pairwise(fn, dims):
    @arrow_udf("binary")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return K.to_binary(fn(K.to_matrix(a, dims), K.to_matrix(b, dims)))
    return run


def _single(fn, dims):
    @arrow_udf("binary")
    def run(a: pa.Array) -> pa.Array:
        return K.to_binary(fn(K.to_matrix(a, dims)))
    return run


def _exact(wide: np.ndarray) -> np.ndarray:
    """Elements as int8; beyond its range an error rather than another number."""
    if wide.size and (wide.max() > 127 or wide.min() < -128):
        raise ValueError("vector elements leave the range of int8: sign or normalise before")
    return wide.astype(np.int8)


def bind(a, b, dims: int) -> Column:
    """Element-wise product; also unbinds (exactly only where the key is not 0)."""
    return _pairwise(lambda x, y: _exact(x.astype(np.int16) * y), dims)(_c(a), _c(b))


unbind = bind


def subtract(a, b, dims: int) -> Column:
    """Element-wise difference, not signed: values in [-2, 2] of signed vectors."""
    return _pairwise(lambda x, y: _exact(x.astype(np.int16) - y), dims)(_c(a), _c(b))


def add(a, b, dims: int) -> Column:
    """Element-wise sum, not signed."""
    return _pairwise(lambda x, y: _exact(x.astype(np.int16) + y), dims)(_c(a), _c(b))


def scale(a, factor: int, dims: int) -> Column:
    """Elements times a whole number."""
    return _single(lambda x: _exact(x.astype(np.int64) * factor), dims)(_c(a))


def threshold(a, dims: int) -> Column:
    """Sign of every element."""
    return _single(K.sign, dims)(_c(a))


def permute(a, n: int, dims: int) -> Column:
    """Rotation right by n places."""
    return _single(lambda x: np.roll(x, n, axis=1), dims)(_c(a))


def normalize(a, dims: int) -> Column:
    """Unit-length ``ARRAY<DOUBLE>``; a zero vector stays zero."""
    @arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        m = K.to_matrix(v, dims).astype(np.float64)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * dims)
        return pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))
    return run(_c(a))


def dot(a, b, dims: int) -> Column:
    """Exact integer dot product."""
    @arrow_udf("bigint")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(np.einsum("ij,ij->i", K.to_matrix(x, dims), K.to_matrix(y, dims), dtype=np.int64))
    return run(_c(a), _c(b))


def bundle_columns(vectors, dims: int, weights=None) -> Column:
    """Sign of the (weighted) sum of several vector columns of one row."""
    if weights is not None and len(weights) != len(vectors):
        raise ValueError(f"{len(vectors)} vectors need as many weights, got {len(weights)}")
    w = int_weight(weights if weights is not None else [1.0] * len(vectors))

    @arrow_udf("binary")
    def run(row: pa.Array) -> pa.Array:
        acc = np.zeros((len(row), dims), np.int64)
        for i in range(row.type.num_fields):
            acc += w[i] * K.to_matrix(row.field(i), dims)
        return K.to_binary(K.sign(acc))

    if not vectors:
        return F.unhex(F.lit("00" * dims))
    return run(F.struct(*[_c(v).alias(f"v{i}") for i, v in enumerate(vectors)]))


def bind_columns(vectors, dims: int) -> Column:
    """Sign of the product of several vector columns; none gives the zero vector."""
    if not vectors:
        return F.unhex(F.lit("00" * dims))
    return reduce(lambda a, b: bind(a, b, dims), [_c(v) for v in vectors])


# ---- grouped forms ---------------------------------------------------------------------------

def _partial_sums(df: DataFrame, keys: list[str], vec: str, dims: int, weight: str | None, prepare) -> DataFrame:
    """Per task, sums of each key's vectors in blocks of ``SLOTS`` dimensions."""
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("block", T.IntegerType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    blocks = dims // SLOTS
    step = K.rows_per_block(dims, 8)

    def run(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, step):
                batch = whole.slice(s, step)
                pdf = batch.select(keys).to_pandas() if keys else pd.DataFrame(index=range(batch.num_rows))
                codes = (pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys
                         else np.zeros(batch.num_rows, np.int64))
                if not len(codes):
                    continue
                order = np.argsort(codes, kind="stable")
                cut = K.segment_starts(codes[order])
                rows = prepare(K.to_matrix(batch.column("vec"), dims)[order])
                weights = batch.column("weight").to_numpy(zero_copy_only=False)[order] if weight else None
                sums = K.segment_sums(rows, cut, weights).astype(np.int64)
                lead = pa.array(np.repeat(order[cut], blocks))
                columns = [batch.column(k).take(lead) for k in keys]
                columns.append(pa.array(np.tile(np.arange(blocks, dtype=np.int32), len(cut))))
                offsets = pa.array(np.arange(len(cut) * blocks + 1, dtype=np.int32) * SLOTS)
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(sums.ravel())))
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "block", "sums"])

    cols = [*keys, F.col(vec).alias("vec")] + ([F.col(weight).alias("weight")] if weight else [])
    return df.select(*cols).mapInArrow(run, schema)


def _merge(partial: DataFrame, keys: list[str], byte_of) -> DataFrame:
    """Sum the blocks with the built-in aggregate (map-side combine), then rejoin the blocks.

    A hot key costs one row per block and map task and is folded as it streams, never
    gathered; its blocks go to different reducers.
    """
    sums = partial.groupBy(*keys, "block").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(SLOTS)])
    texts = sums.select(*keys, "block", F.concat(*[byte_of(F.col(f"s{i}")) for i in range(SLOTS)]).alias("digits"))
    joined = texts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "digits"))).alias("parts"))
    return joined.select(*keys, F.unhex(F.array_join(F.transform("parts", lambda p: p["digits"]), "")).alias("vec"))


def _sign_hex(s: Column) -> Column:
    return F.when(s > 0, "01").when(s < 0, "ff").otherwise("00")


def bundle_by(df: DataFrame, keys, vec: str, dims: int, weight: str | None = None) -> DataFrame:
    """``sign(sum(weight * vec))`` per key.  ``weight`` is a BIGINT column (see ``scaled_weight``)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return _merge(_partial_sums(df, keys, vec, dims, weight, lambda m: m), keys, _sign_hex)


def scaled_weight(w: Column) -> Column:
    """Integer weight used in weighted sums: ``floor(w * 10**6 + 0.5)``."""
    return F.floor(w * F.lit(1_000_000) + F.lit(0.5)).cast("bigint")


def bind_by(df: DataFrame, keys, vec: str, dims: int) -> DataFrame:
    """Element-wise product per key.  A product of trits is 0 if any factor is 0, otherwise the
    parity of the minus signs, and both counts add up, so the same block sums serve."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    zero = 1 << 32

    def counts(m):
        return np.where(m == 0, zero, (m < 0).astype(np.int64))

    def digit(s):
        return F.when(s >= F.lit(zero), "00").when(F.pmod(s, F.lit(2)) == 1, "ff").otherwise("01")

    return _merge(_partial_sums(df, keys, vec, dims, None, counts), keys, digit)


def compose(df: DataFrame, op: str, group: str, vec: str, dims: int) -> DataFrame:
    """Per-group ``bind`` or ``bundle`` of a vector table."""
    if op == "bind":
        return bind_by(df, group, vec, dims)
    if op == "bundle":
        return bundle_by(df, group, vec, dims)
    raise ValueError(f"unknown operation {op!r}; expected 'bind' or 'bundle'")


# ---- conversions -----------------------------------------------------------------------------

def to_array(vec, dims: int) -> Column:
    """``BINARY`` to ``ARRAY<TINYINT>``."""
    @arrow_udf("array<tinyint>")
    def run(v: pa.Array) -> pa.Array:
        m = K.to_matrix(v, dims)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * dims), pa.array(m.ravel()))
    return run(_c(vec))


def from_array(values, dims: int) -> Column:
    """``ARRAY<numeric>`` of signed bytes to ``BINARY``; a wrong length is an error."""
    @arrow_udf("binary")
    def run(v: pa.Array) -> pa.Array:
        m = K.float_matrix(v)
        if len(m) and m.shape[1] != dims:
            raise ValueError(f"vector length mismatch: expected {dims}, found {m.shape[1]}")
        return K.to_binary(m.reshape(len(v), dims).astype(np.int8))
    return run(_c(values))


def to_long(df: DataFrame, key: str, vec: str, dims: int) -> DataFrame:
    """(key, dim, x) rows, for small dims and plain SQL work."""
    return df.select(key, F.posexplode(to_array(vec, dims)).alias("dim", "x"))
