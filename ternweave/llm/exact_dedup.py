"""Exact duplicates of texts: a two-pass Bloom filter in front of the shuffle, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternweave.llm.common import attach, store

#: Bits of the filter per row, and the most it may have: the broadcast is 16 MB at most.
BITS_PER_ROW = 16
MAX_BITS = 2 ** 27
BUCKET = 2 ** 15


def normalised(text: Column | str) -> Column:
    """Text with every run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _cells(digest: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(digest), F.lit(i)), F.lit(bits)) for i in (1, 2)]


def repeated_cells(rows: DataFrame, digest: str, bits: int) -> DataFrame:
    """First pass: (bucket, bitmap) of the cells that at least two insertions have hit.

    Every digest is inserted in two cells.  The insertions of a cell are counted with a partial
    sum in each task, so a digest of a third of all rows is one row per task and cell."""
    cell = rows.select(F.explode(F.array(*_cells(digest, bits))).alias("cell")).groupBy("cell").count().where("count > 1")
    return (cell.groupBy(F.shiftright("cell", 15).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.col("cell").bitwiseAND(BUCKET - 1)).alias("bitmap")))


def _has(bitmap: str, cell: Column) -> Column:
    place = cell.bitwiseAND(BUCKET - 1).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte.cast("long"), place.bitwiseAND(7)) == 1, F.lit(False))


def possibly_repeated(rows: DataFrame, digest: str, filter_: DataFrame, bits: int) -> DataFrame:
    """Second pass: rows with a flag ``possible``; a repeated digest always has it."""
    for i, cell in enumerate(_cells(digest, bits)):
        part = F.broadcast(filter_.select(F.col("bucket").alias(f"bucket{i}"), F.col("bitmap").alias(f"bitmap{i}")))
        rows = rows.withColumn(f"bucket{i}", F.shiftright(cell, 15)).join(part, f"bucket{i}", "left")
    both = [_has(f"bitmap{i}", c) for i, c in enumerate(_cells(digest, bits))]
    return rows.withColumn("possible", both[0] & both[1]).drop("bucket0", "bucket1", "bitmap0", "bitmap1")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal if their normalised forms are; of equal texts the row with the smallest id
    stays.  Only digests are stored, counted and shuffled, never texts.  Rows whose cells are not
    hit twice are certainly unique and pass straight through; the others are grouped by digest
    with partial aggregation, and large groups are joined back by a bounded broadcast.  With more
    than ``max_bits / 16`` rows the filter lets more unique rows through to the shuffle, which
    costs about 48 bytes each; results do not change.

    Null and empty texts are equal.  A null id counts as larger than every other.  Of rows with
    one id and one text a single one stays.  An empty table gives no rows; other columns are ignored.
    """
    rows = store(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(normalised(text_col), 256)).alias("digest")), "exact-digests")
    total = rows.count()
    bits = BUCKET
    while bits < min(max_bits, BITS_PER_ROW * total):
        bits *= 2
    marked = possibly_repeated(rows, "digest", repeated_cells(rows, "digest", bits), bits)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = store(marked.where("possible").groupBy("digest")
                   .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    shared = attach(marked.where("possible"), groups, "digest", "group_size", total).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest")
    alone = marked.where("not possible").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return (alone.unionByName(shared)
            .select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")))
