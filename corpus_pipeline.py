"""A training corpus from documents: toxic documents go, one of each group of near duplicates stays, benchmark passages
go, sources are mixed, and token ids are written."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternweave.functions.session import ship
from ternweave.llm import common, decontaminate, mixing, near_dedup, token_binary, toxicity

#: The stages have no form in SQL; tests hold them against brute force.
ORACLE_SQL = None
#: Places of the mixture are broadcast up to this size, and joined by a shuffle beyond it.
PLACE_BYTES, BROADCAST_BYTES = 64, 64 * 2 ** 20


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows of a stage with a key of their own, and the name of its column.

    The key is the id, of rows that share one for a single row, and else a number of at least 2^62 from the row's file and place: rows
    with a null id, or with one that others have, are rows like all others."""
    try:
        rows = docs.select("*", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    except AnalysisException:                                     # not the rows of files
        docs = common.store(docs, "pipeline-rows")
        rows = docs.select("*", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    key, again = (common.fresh(docs, c) for c in ("_key", "_again"))
    rows = rows.toDF(*docs.columns, "_file_" + key, "_row_" + key)
    place = F.xxhash64("_file_" + key, "_row_" + key).bitwiseAND(2 ** 62 - 1).bitwiseOR(2 ** 62)
    alone = F.col("doc_id") < 2 ** 62
    repeated = common.store(rows.where(alone).groupBy(F.col("doc_id").alias(again)).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
                            .where("n > 1").select(again, "first"), "pipeline-repeated")
    if repeated.isEmpty():
        own = F.when(alone, F.col("doc_id")).otherwise(place)
        return rows.withColumn(key, own).select(*docs.columns, key), key
    filter_, bits = common.id_filter(repeated, again, repeated.count())
    maybe, flag = common.marked(rows, "doc_id", filter_, bits)          # only rows that may share their id are shuffled
    clear = maybe.where(~F.col(flag)).withColumn(key, F.when(alone, F.col("doc_id")).otherwise(place))
    unsure = maybe.where(F.col(flag)).select(*rows.columns).withColumn(key, place)
    own, last = F.col(f"c{docs.columns.index('doc_id')}"), f"c{len(unsure.columns) - 1}"
    held = common.join_skewed(unsure.toDF(*[f"c{i}" for i in range(len(unsure.columns))]).withColumn("id", own), repeated.toDF("id", "first"), "id", last,
                              docs.count(), "left")
    first = F.col("first").isNull() | (F.col("first") == F.col(last))
    shared = held.withColumn("key", F.when((F.col("id") < 2 ** 62) & first, F.col("id")).otherwise(F.col(last)))
    shared = shared.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("key").alias(key))
    return clear.select(*docs.columns, key).unionByName(shared), key


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold of their language; the classifier learns from the table labels.

    Every row is judged by its own text: null and empty texts are clean, repeated rows go or stay together, ids may repeat or be
    null, and further columns of any name pass through.  An empty table gives no rows."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    net = toxicity.fit(toxicity.labelled_sample(docs, labels, F.pmod(common.crc_of("doc_id"), F.lit(5)) != 0))
    score = common.fresh(docs, "_toxicity")
    scored = toxicity.with_score(docs, net, score)
    return scored.where(F.col(score) < toxicity.threshold_of(net, "lang")).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, that of the smallest id.

    Of repeated rows, and of rows that share an id or have none, one of each group stays; a row without an id only where its group has none
    with one.  Null and empty texts are copies of each other.  Further columns of any name pass through; an empty table gives no rows."""
    ship(spark)
    rows, key = keyed(docs)
    groups = near_dedup.near_duplicates(rows, key)
    return common.without_ids(rows, groups.where("not kept").select("doc_id"), key).drop(key)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the table benchmark.

    Every row is judged by its own text, whatever its id.  Null and empty texts stay; further columns of any name pass through; an empty table
    of documents gives no rows, and an empty benchmark leaves all."""
    benchmark = ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, key = keyed(docs)
    hits = decontaminate.contaminated(rows, benchmark, key)
    return common.without_ids(rows, hits.select("doc_id"), key).drop(key)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, stored in the order of the mixture; the order of a source's rows is that of a hash of their keys.

    A null source is one of its own, and rows with repeated or null ids have places of their own.  Texts are shuffled
    once, straight to the range of their slots.  Further columns of any name pass through; an empty table gives no rows."""
    ship(spark)
    rows, key = keyed(docs)
    places = common.store(mixing.mixed(rows, id_col=key), "pipeline-places")
    seen = places.agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last")).first()
    if not seen["n"]:
        return docs
    at, slot, place, part = (common.fresh(rows, c) for c in ("_at", "_slot", "_place", "_part"))
    found = places.select(F.col("doc_id").alias(at), F.col("slot").alias(slot), F.col("place").alias(place))
    if PLACE_BYTES * seen["n"] <= BROADCAST_BYTES:
        found = F.broadcast(found)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (rows.join(found, F.col(key) == F.col(at)).withColumn(part, F.floor(F.col(slot) * n / (seen["last"] + 1)).cast("int"))
            .repartitionById(n, F.col(part)).sortWithinPartitions(slot, place).select(*docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, in the stored order of the documents (by id where they don't come from files): a row per document.

    Null and empty texts have the end id alone; repeated rows and null ids are rows of their own; an empty table gives no rows."""
    ship(spark)
    try:
        docs = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        order = ["_file", "_row"]
    except AnalysisException:                                     # not the rows of files
        order = ["doc_id"]
    return token_binary.token_files(docs, public_tokenizers.path("word_bpe_49k.json"), order)


STAGES = [("toxicity", clean), ("near_dedup", distinct), ("decontamination", decontaminated), ("mixing", mixture), ("token_files", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.store(docs, f"pipeline-{name}")
    return docs
