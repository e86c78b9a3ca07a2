"""Encoders: columns in, a ``BINARY`` vector column out.

Every encoder is one Arrow UDF over the referenced columns only, so an encode job is a
narrow stage: scan, encode, write.  Filters on other columns still reach the scan.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ternweave.functions import encoding as E
from ternweave.functions.codebook import canon_atom, check_dims
from ternweave.functions.kernels import rows_per_block, to_binary
from ternweave.functions.rows import explode_into

DEFAULT_DIMS = 1024


def encode(col: Column | str, dims: int = DEFAULT_DIMS, modes: dict | None = None, sets=(),
           skip_nulls: bool = False) -> Column:
    """Vector of a typed column of any nesting (scalar, array, map, struct).

    ``modes`` gives list settings per dotted path (``""`` is the column itself):
    ``{"words": "ngram"}`` or ``{"words": ("ngram", {"n_sizes": [2, 3]})}``.  A setting holds
    for the lists below its path, though not for lists inside list items.  ``sets`` names the
    paths whose arrays are sets.  With ``skip_nulls`` a null field counts as absent.
    """
    check_dims(dims)
    hints = {}
    for path, spec in (modes or {}).items():
        mode, config = (spec, {}) if isinstance(spec, str) else spec
        E.check_mode(mode, config)
        hints[path] = (mode, dict(config))
    chosen = frozenset(sets)

    @arrow_udf("binary")
    def encode_block(values: pa.Array) -> pa.Array:
        out = np.empty((len(values), dims), np.int8)
        step = rows_per_block(dims, 8)
        for s in range(0, len(values), step):
            out[s:s + step] = E.encode_array(values.slice(s, step), dims, hints, chosen, skip_nulls=skip_nulls)
        return to_binary(out)

    return encode_block(F.col(col) if isinstance(col, str) else col)


def encode_row(*columns: str, dims: int = DEFAULT_DIMS, **options) -> Column:
    """Vector of a flat or nested row: the column names are the map keys."""
    return encode(F.struct(*columns), dims, **options)


def encode_json(col: Column | str, dims: int = DEFAULT_DIMS) -> Column:
    """Vector of a JSON text of unknown shape; hints inside the document are honoured.

    Malformed text gives null (see ``sources.documents.parse_documents`` for the quarantine).
    """
    check_dims(dims)

    @arrow_udf("binary")
    def encode_texts(texts: pa.Array) -> pa.Array:
        return pa.array(E.encode_json_texts(texts.to_pylist(), dims), pa.binary())

    return encode_texts(F.col(col) if isinstance(col, str) else col)


def encode_atom(col: Column | str, dims: int = DEFAULT_DIMS) -> Column:
    """Codebook vector of a scalar column."""
    return encode(col, dims)


def encode_document(doc, dims: int = DEFAULT_DIMS) -> bytes:
    """Vector of one probe document on the driver, by the same rules."""
    return E.encode_value(doc, check_dims(dims)).tobytes()


def encode_ngrams(words: Column | str, dims: int = DEFAULT_DIMS, preset: str | None = None, **config) -> Column:
    """Sequence encoder over an array of words; see ``NGRAM_PRESETS`` for named settings."""
    if preset is not None:
        config = {**E.NGRAM_PRESETS[preset], **config}
    return encode(words, dims, modes={"": ("ngram", config)})


def encode_weighted_patterns(patterns: Column | str, dims: int = DEFAULT_DIMS) -> Column:
    """Vector of ``ARRAY<STRUCT<gram ARRAY<STRING>, weight BIGINT>>``: sign of the weighted
    sum of each gram's product.  Used where weights come from a join (document frequencies)."""
    check_dims(dims)

    @arrow_udf("binary")
    def encode_patterns(values: pa.Array) -> pa.Array:
        out = np.empty((len(values), dims), np.int8)
        flat = values.values
        grams, weights = flat.field("gram"), flat.field("weight").to_numpy(zero_copy_only=False)
        offsets = values.offsets.to_numpy().astype(np.int64)
        step = rows_per_block(dims, 8)
        for i in range(len(values)):
            acc = np.zeros(dims, np.int64)
            for s in range(int(offsets[i]), int(offsets[i + 1]), step):
                e = min(s + step, int(offsets[i + 1]))
                rows = E.encode_array(grams.slice(s, e - s), dims, {"": ("chained", {})}, frozenset())
                acc += weights[s:e].astype(np.int64) @ rows.astype(np.int64)
            out[i] = np.sign(acc)
        return to_binary(out)

    return encode_patterns(F.col(patterns) if isinstance(patterns, str) else patterns)


def ngrams(words: Column, n: int) -> Column:
    """``ARRAY<ARRAY<STRING>>`` of the adjacent n-grams (empty when the list is shorter)."""
    count = F.size(words) - F.lit(n - 1)
    return F.when(
        count > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(words, i, n)),
    ).otherwise(F.array().cast("array<array<string>>"))


def idf_table(units: DataFrame, doc_id: str, words: str, n: int) -> DataFrame:
    """Inverse document frequency per n-gram: ``ln(N / documents containing it)``.

    Word lists are cut to distinct grams per unit before the shuffle, and the count is a
    two-step aggregate, so a gram that occurs everywhere only costs one row per map task.
    """
    grams = explode_into(units, ngrams(F.col(words), n), "gram", doc_id).distinct()
    total = units.agg(F.countDistinct(doc_id)).scalar()
    return (grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
            .select("gram", "df", F.log(total / F.col("df")).alias("idf")))


def encode_idf_ngrams(units: DataFrame, unit_id: str, words: str, dims: int = DEFAULT_DIMS,
                      n: int = 2, cap: float = 2.0, single: float = 0.8) -> DataFrame:
    """Content-keyed IDF weighting: unigrams weigh ``single``, n-grams ``min(idf, cap)``.

    Weights travel as short gram rows; no vector is shuffled.  A unit without words has the zero vector.
    """
    scale = F.lit(E.SCALE)
    idf = idf_table(units, unit_id, words, n)
    weighted = (explode_into(units, ngrams(F.col(words), n), "gram", unit_id)
                .groupBy(unit_id, "gram").agg(F.count(F.lit(1)).alias("times"))
                .join(idf, "gram")
                .select(unit_id, "gram", (F.col("times") * F.floor(
                    F.least(F.col("idf"), F.lit(cap)) * scale + 0.5)).cast("bigint").alias("weight")))
    singles = (units.select(unit_id, F.explode(words).alias("w"))
               .groupBy(unit_id, "w").agg(F.count(F.lit(1)).alias("times"))
               .select(unit_id, F.array("w").alias("gram"),
                       (F.col("times") * F.floor(F.lit(single) * scale + 0.5)).cast("bigint").alias("weight")))
    patterns = (weighted.unionByName(singles).groupBy(unit_id)
                .agg(F.collect_list(F.struct("gram", "weight")).alias("patterns")))
    vectors = patterns.select(unit_id, encode_weighted_patterns("patterns", dims).alias("vec"))
    zero = F.coalesce("vec", F.lit(bytearray(dims))).alias("vec")
    return units.select(unit_id).distinct().join(vectors, unit_id, "left").select(unit_id, zero)


def atoms_of_json(col: Column | str) -> Column:
    """Distinct keys and scalars of a JSON text, sorted."""

    @arrow_udf("array<string>")
    def atoms(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(None if t is None else sorted(E.list_atoms(json.loads(t), set())))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.list_(pa.string()))

    return atoms(F.col(col) if isinstance(col, str) else col)


def atoms_of_row(*columns: str) -> Column:
    """Distinct keys and scalar texts of a flat row, as a built-in expression."""
    values = [canon_atom(c) for c in columns]
    return F.array_sort(F.array_distinct(F.array(*[F.lit(c) for c in columns], *values)))


def vec_hex(col: Column | str) -> Column:
    """Lower-case hex text of a vector, two digits per dimension (00, 01 or ff)."""
    return F.lower(F.hex(col))


