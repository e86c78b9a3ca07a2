"""A document store on Parquet: documents and vectors side by side, partitioned by bucket.

Column pruning keeps vector reads and document reads apart, and a delete or upsert rewrites
only the buckets it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ternweave.operators.encode import encode_json
from ternweave.sources.documents import content_id, parse_documents

SCHEMA = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("ordinal", T.LongType()),
                       T.StructField("doc", T.StringType()), T.StructField("vec", T.BinaryType()),
                       T.StructField("collection", T.StringType()), T.StructField("bucket", T.IntegerType())])


class DocumentStore:
    """``collection`` separates uses of one table; each store object works on one collection.

    Dimensions and number of buckets are recorded with the collection at its first write.  Later
    objects take the recorded buckets, and other dimensions are an error.  :meth:`rebucket` changes
    the number as the collection grows."""

    def __init__(self, spark: SparkSession, path: str, dims: int, collection: str = "default", buckets: int = 64):
        self.spark, self.path, self.dims = spark, path.rstrip("/"), dims
        self.collection, self.buckets = collection, buckets
        self._meta = f"{self.path}/meta/{collection}"
        if self._exists(self._meta):
            known = spark.read.parquet(self._meta).first()
            if known["dims"] != dims:
                raise ValueError(f"collection {collection!r} has {known['dims']} dimensions, not {dims}")
            self.buckets = known["buckets"]

    def _record(self) -> None:
        if not self._exists(self._meta):
            self._describe(self._meta)

    def _describe(self, folder: str) -> None:
        self.spark.createDataFrame([(self.dims, self.buckets)], "dims INT, buckets INT").coalesce(1).write.mode("overwrite").parquet(folder)

    def rebucket(self, buckets: int) -> None:
        """Rewrite the collection with another number of buckets."""
        kept = f"{self.path}/rebucket/{self.collection}"
        self.table().drop("bucket").write.mode("overwrite").parquet(kept)
        self._drop(f"{self.path}/documents/collection={self.collection}")
        self.buckets = buckets
        self._describe(self._meta)
        self._write(self.spark.read.schema(T.StructType([f for f in SCHEMA if f.name not in ("collection", "bucket")])).parquet(kept), "append")
        self._drop(kept)

    def _exists(self, folder: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return (df.withColumn("collection", F.lit(self.collection))
                .withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int"))
                .hint("rebalance", "collection", "bucket"))

    def _write(self, df: DataFrame, mode: str) -> None:
        self._record()
        writer = self._bucketed(df.select("doc_id", "ordinal", "doc", "vec")).write.mode(mode)
        if mode == "overwrite":
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("collection", "bucket").parquet(f"{self.path}/documents")

    def table(self) -> DataFrame:
        """doc_id, ordinal, doc (JSON text), vec."""
        if not self._exists(f"{self.path}/documents"):
            return self.spark.createDataFrame([], SCHEMA).drop("collection")
        return (self.spark.read.schema(SCHEMA).parquet(f"{self.path}/documents")
                .where(F.col("collection") == self.collection).drop("collection"))

    def documents(self) -> DataFrame:
        return self.table().select("doc_id", "doc")

    def vectors(self) -> DataFrame:
        return self.table().select("doc_id", "vec")

    def insert(self, df: DataFrame, text: str = "doc", data_type: str = "json") -> DataFrame:
        """Encode and append a table of documents; returns the ids with their input ordinal.

        ``doc_id`` and ``ordinal`` columns are used where present, otherwise the id is the content
        hash.  Writes are keyed by id: an id that is stored already keeps its document, and of
        several rows of one id the first in order of ordinal and text is stored, so the same insert again
        changes nothing.  Malformed rows go to ``<path>/quarantine``, each once.  The append is one atomic commit, so a
        failing job stores nothing."""
        if "doc_id" not in df.columns:
            df = df.withColumn("doc_id", content_id(text))
        if "ordinal" not in df.columns:
            df = df.withColumn("ordinal", F.lit(None).cast("bigint"))
        source = df.select(F.col("doc_id").cast("string").alias("doc_id"), "ordinal", F.col(text).alias("text"))
        good, bad = parse_documents(source, "text", data_type)
        first = F.min(F.struct(F.col("ordinal").isNull(), "ordinal", "doc")).alias("first")
        unique = good.groupBy("doc_id").agg(first).select("doc_id", "first.ordinal", "first.doc")
        fresh = unique.join(self.table().select("doc_id"), "doc_id", "left_anti")
        self._write(fresh.withColumn("vec", encode_json("doc", self.dims)), "append")
        self._quarantine(bad)
        return good.select("doc_id", "ordinal")

    def _quarantine(self, bad: DataFrame) -> None:
        folder = f"{self.path}/quarantine"
        bad = bad.select("doc_id", "text").distinct()
        if self._exists(folder):
            known = self.quarantined()
            bad = bad.join(known, bad["doc_id"].eqNullSafe(known["doc_id"]) & bad["text"].eqNullSafe(known["text"]), "left_anti")
        bad.write.mode("append").parquet(folder)

    def quarantined(self) -> DataFrame:
        return self.spark.read.schema("doc_id STRING, text STRING").parquet(f"{self.path}/quarantine")

    def get(self, ids) -> DataFrame:
        """Documents by id: one id, a list, or a table with ``doc_id`` (missing ids are absent)."""
        t = self.table()
        if isinstance(ids, DataFrame):
            return t.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "doc")
        wanted = [ids] if isinstance(ids, str) else list(ids)
        return t.where(F.col("doc_id").isin(wanted)).select("doc_id", "doc")

    def _touched(self, ids: DataFrame) -> list[int]:
        rows = (ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect())
        return [r["b"] for r in rows]

    def _rewrite(self, ids: DataFrame, extra: DataFrame | None = None) -> int:
        ids = ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        touched = self._touched(ids)
        here = self.table().where(F.col("bucket").isin(touched))
        found = here.join(ids, "doc_id", "left_semi").count()
        kept = here.join(ids, "doc_id", "left_anti").drop("bucket")
        emptied = set(touched)
        if extra is None:
            emptied -= {r["bucket"] for r in here.join(ids, "doc_id", "left_anti").select("bucket").distinct().collect()}
            self._write(kept, "overwrite")
            for b in emptied:
                self._drop(f"{self.path}/documents/collection={self.collection}/bucket={b}")
        else:
            self._write(kept.unionByName(extra.select("doc_id", "ordinal", "doc", "vec")), "overwrite")
        return found

    def _drop(self, folder: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def delete(self, ids: DataFrame) -> int:
        """Drop documents and vectors; returns how many existed.  Only their buckets are rewritten."""
        return self._rewrite(ids)

    def upsert(self, df: DataFrame, text: str = "doc") -> int:
        """Replace or add documents by ``doc_id``; returns how many were replaced.  Of several rows of one id the last
        in order of ``ordinal`` (where there is such a column) and text is stored; malformed rows go to quarantine."""
        ordinal = F.col("ordinal").cast("bigint") if "ordinal" in df.columns else F.lit(None).cast("bigint")
        rows = df.select(F.col("doc_id").cast("string").alias("doc_id"), ordinal.alias("ordinal"), F.col(text).alias("text"))
        good, bad = parse_documents(rows, "text")
        good = (good.groupBy("doc_id").agg(F.max(F.struct("ordinal", "doc")).alias("last")).select("doc_id", "last.ordinal", "last.doc")
                .withColumn("vec", encode_json("doc", self.dims)))
        self._quarantine(bad)
        return self._rewrite(good, good)

    def clear(self) -> int:
        """Drop everything in the collection; returns the number of documents removed."""
        n = self.table().count()
        self._drop(f"{self.path}/documents/collection={self.collection}")
        self._drop(self._meta)
        return n

    def health(self) -> DataFrame:
        """One row: documents, vectors and the range of vector lengths."""
        return self.table().agg(
            F.count(F.lit(1)).alias("items"), F.count("vec").alias("vectors"),
            F.min(F.octet_length("vec")).alias("min_dims"), F.max(F.octet_length("vec")).alias("max_dims"))
