"""Parsing, ingest and the document store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ternweave.functions.predicates import clamp_k
from ternweave.operators import corpus as C
from ternweave.operators import search as S
from ternweave.operators.encode import encode_json, encode_row
from ternweave.plans.common import HEX, codebook_sql, flat_map_sql, hex_text, map_sql, pairs_sql, query, scratch, spread_table, table
from ternweave.plans.corpus import UNITS
from ternweave.sources import documents as Docs
from ternweave.sources.store import DocumentStore

D = 64
PART = ("p_brand", "p_type", "p_size")


def part_docs(spark, sf):
    p = spread_table(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("string").alias("doc_id"), F.col("p_partkey").alias("ordinal"),
                    F.to_json(F.struct(*PART)).alias("doc"))


def _filled(spark, sf):
    store = DocumentStore(spark, scratch(spark, "store"), D, buckets=8)
    store.insert(part_docs(spark, sf))
    return store


_MAP = flat_map_sql("part", "p_partkey", PART, D)


@query("SELECT event_id, json_valid(t) AS ok, CASE WHEN json_valid(t) THEN CAST(json_extract(t, '$.k') AS BIGINT) ELSE -1 END AS k FROM "
       "(SELECT event_id, CASE WHEN event_type = 'error' THEN substr(props, 1, 4) ELSE props END AS t FROM events)")
def parse_json_quarantine(spark, sf):
    """JSON parsing with malformed rows set aside."""
    e = spread_table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.substring("props", 1, 4)).otherwise(F.col("props")).alias("t"))
    good, bad = Docs.parse_documents(e, "t")
    return (good.select("event_id", F.lit(True).alias("ok"), F.variant_get(F.parse_json("doc"), "$.k", "bigint").alias("k"))
            .unionByName(bad.select("event_id", F.lit(False).alias("ok"), F.lit(-1).cast("bigint").alias("k"))))


@query(f"""WITH kv AS (SELECT p_partkey AS id, ':brand' AS k, ':' || p_brand AS v FROM part UNION ALL SELECT p_partkey, ':size', CAST(p_size AS VARCHAR) FROM part),
{codebook_sql("SELECT k AS a FROM kv UNION SELECT v FROM kv", D)}, {map_sql()} SELECT id AS p_partkey, {HEX} AS vec FROM dv GROUP BY id""")
def parse_edn_encode(spark, sf):
    """EDN documents with keywords, rewritten to the JSON path and encoded."""
    p = spread_table(spark, sf, "part")
    edn = F.concat(F.lit("{:brand :"), F.col("p_brand"), F.lit(", :size "), F.col("p_size").cast("string"), F.lit("}"))
    return p.select("p_partkey", hex_text(encode_json(Docs.edn_json(edn), D)).alias("vec"))


@query(f"WITH {_MAP} SELECT CAST(id AS VARCHAR) AS doc_id, {HEX} AS vec FROM dv GROUP BY id")
def store_insert_vectors(spark, sf):
    """Vectors read back after one batch insert."""
    return _filled(spark, sf).vectors().select("doc_id", hex_text("vec").alias("vec"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_partkey AS ordinal FROM part")
def store_insert_ids(spark, sf):
    """Ids of a batch insert with their input order."""
    store = DocumentStore(spark, scratch(spark, "store"), D, buckets=8)
    return store.insert(part_docs(spark, sf))


@query("SELECT sha256(CAST(p_partkey AS VARCHAR)) AS doc_id FROM part")
def content_ids(spark, sf):
    """Ids derived from content."""
    return table(spark, sf, "part").select(Docs.content_id(F.col("p_partkey").cast("string")).alias("doc_id"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def store_get_many(spark, sf):
    """Documents fetched by an id table."""
    ids = table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").cast("string").alias("doc_id"))
    return _filled(spark, sf).get(ids).select("doc_id", F.get_json_object("doc", "$.p_brand").alias("p_brand"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id FROM part WHERE p_type <> 'SMALL'")
def store_delete(spark, sf):
    """Documents left after deleting by an id table."""
    store = _filled(spark, sf)
    store.delete(table(spark, sf, "part").where("p_type = 'SMALL'").select(F.col("p_partkey").alias("doc_id")))
    return store.documents().select("doc_id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE WHEN p_type = 'SMALL' THEN 'replaced' ELSE p_brand END AS brand FROM part")
def store_upsert(spark, sf):
    """Documents after replacing some of them."""
    store = _filled(spark, sf)
    new = table(spark, sf, "part").where("p_type = 'SMALL'").select(
        F.col("p_partkey").alias("doc_id"), F.to_json(F.struct(F.lit("replaced").alias("p_brand"))).alias("doc"))
    store.upsert(new)
    return store.documents().select("doc_id", F.get_json_object("doc", "$.p_brand").alias("brand"))


@query("SELECT count(*) AS removed, CAST(0 AS BIGINT) AS left_over FROM part")
def store_clear(spark, sf):
    """Number of documents removed by a clear, and what is left."""
    store = _filled(spark, sf)
    n = store.table().agg(F.count(F.lit(1)).alias("removed")).checkpoint()
    store.clear()
    return n.withColumn("left_over", F.lit(store.table().count()).cast("bigint"))


@query(f"SELECT count(*) AS items, count(*) AS vectors, CAST({D} AS INT) AS min_dims, CAST({D} AS INT) AS max_dims FROM part")
def store_health(spark, sf):
    """Counts and vector lengths of a store."""
    return _filled(spark, sf).health()


@query("SELECT k, least(greatest(k, 1), 100) AS allowed FROM (SELECT DISTINCT CAST(p_size * 5 - 20 AS INT) AS k FROM part)")
def request_clamp(spark, sf):
    """Requested result counts clamped to the allowed range."""
    return table(spark, sf, "part").select((F.col("p_size") * 5 - 20).cast("int").alias("k")).distinct().withColumn(
        "allowed", clamp_k(F.col("k")))


@query("SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles FROM conversations GROUP BY conv_id")
def set_normalisation(spark, sf):
    """Sets as sorted lists."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return c.select("conv_id", F.array_join(Docs.sets_to_lists("roles"), ",").alias("roles"))


@query(f"WITH {UNITS} SELECT lang, count(*) AS units, CAST(sum(len(ws)) AS BIGINT) AS words FROM un JOIN documents USING (doc_id) GROUP BY lang")
def corpus_ingest(spark, sf):
    """Text corpus to units with vectors, written and read back."""
    docs, path = spread_table(spark, sf, "documents"), scratch(spark, "units")
    C.unit_vectors(C.units(docs), D).write.parquet(path)
    back = spark.read.parquet(path).where(F.octet_length("vec") == D)
    return (back.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang")
            .agg(F.count(F.lit(1)).alias("units"), F.sum(F.size("words").cast("bigint")).alias("words")))


@query("""WITH t AS (SELECT 'brand' AS collection, count(DISTINCT p_brand) AS items FROM part UNION ALL SELECT 'type', count(DISTINCT p_type) FROM part)
SELECT * FROM t""")
def store_collections(spark, sf):
    """Two collections in one store."""
    path, p = scratch(spark, "store"), table(spark, sf, "part")
    out = None
    for name in ("brand", "type"):
        store = DocumentStore(spark, path, D, collection=name, buckets=4)
        col = f"p_{name}"
        store.insert(p.select(F.col(col).alias("doc_id")).distinct().withColumn("doc", F.to_json(F.struct(F.col("doc_id").alias(col)))))
        part = store.health().select(F.lit(name).alias("collection"), "items")
        out = part if out is None else out.unionByName(part)
    return out


# ---- writes keyed by id ----------------------------------------------------------------------

@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_brand FROM part")
def store_insert_twice(spark, sf):
    """The same insert again, and new texts under known ids, change nothing."""
    store = _filled(spark, sf)
    store.insert(part_docs(spark, sf))
    store.insert(part_docs(spark, sf).withColumn("doc", F.lit('{"p_brand": "other"}')))
    return store.documents().select("doc_id", F.get_json_object("doc", "$.p_brand").alias("p_brand"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE WHEN p_size < 10 THEN 'small' ELSE p_brand END AS brand FROM part WHERE p_type <> 'SMALL'")
def store_reopen(spark, sf):
    """A store reopened with another number of buckets finds, replaces and deletes the rows it has; it is rebucketed in between."""
    path = _filled(spark, sf).path
    p = spread_table(spark, sf, "part")
    again = DocumentStore(spark, path, D, buckets=3)
    again.upsert(p.where("p_size < 10").select(F.col("p_partkey").alias("doc_id"), F.lit('{"p_brand": "small"}').alias("doc")))
    again.rebucket(16)
    third = DocumentStore(spark, path, D, buckets=5)
    third.delete(p.where("p_type = 'SMALL'").select(F.col("p_partkey").alias("doc_id")))
    return third.documents().select("doc_id", F.get_json_object("doc", "$.p_brand").alias("brand"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE WHEN p_size % 5 = 0 THEN 'second' ELSE p_brand END AS brand, FALSE AS bad FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'broken', TRUE FROM part WHERE p_size % 7 = 0""")
def store_upsert_repeated(spark, sf):
    """An upsert with two rows of one id, of which the later stays, and malformed rows, which go to quarantine."""
    store, p = _filled(spark, sf), table(spark, sf, "part")
    rows = p.where("p_size % 5 = 0").select(F.col("p_partkey").alias("doc_id"), F.explode(F.array(
        F.struct(F.lit(1).alias("ordinal"), F.lit('{"p_brand": "first"}').alias("doc")),
        F.struct(F.lit(2).alias("ordinal"), F.lit('{"p_brand": "second"}').alias("doc")))).alias("r")).select("doc_id", "r.*")
    store.upsert(rows.unionByName(p.where("p_size % 7 = 0").select(F.col("p_partkey").alias("doc_id"), F.lit(3).alias("ordinal"), F.lit("broken").alias("doc"))))
    good = store.documents().select("doc_id", F.get_json_object("doc", "$.p_brand").alias("brand"), F.lit(False).alias("bad"))
    return good.unionByName(store.quarantined().select("doc_id", F.col("text").alias("brand"), F.lit(True).alias("bad")))


_STORED = f"""WITH {pairs_sql("part", "p_partkey", PART)}, bkv AS (SELECT DISTINCT p_brand AS id, 'p_brand' AS k, p_brand AS v FROM part),
{codebook_sql("SELECT k AS a FROM kv UNION SELECT v FROM kv", D)}, {map_sql("dv")}, {map_sql("qv", "bkv")},
sc AS (SELECT qv.id AS q, CAST(dv.id AS VARCHAR) AS doc_id, CAST(sum(dv.x * qv.x) AS BIGINT) AS s FROM dv JOIN qv USING (d) GROUP BY qv.id, dv.id),
hit AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, doc_id) AS rn FROM sc WHERE s >= 0)"""


@query(_STORED + f" SELECT q AS query_id, doc_id, round(s / {D}.0, 6) AS score, CAST(rn AS INT) AS rank FROM hit WHERE rn <= 10")
def search_stored(spark, sf):
    """One probe per brand over the vectors of a store; nothing is encoded again."""
    probes = table(spark, sf, "part").select("p_brand").distinct().select(
        F.col("p_brand").alias("query_id"), encode_row("p_brand", dims=D).alias("vec"))
    return S.search_table(_filled(spark, sf).vectors(), probes, D, 10).withColumn("score", F.round("score", 6))


@query(_STORED + """ SELECT q AS query_id, count(*) AS hits_a, count(*) AS hits_b, count(*) AS shared, CAST(0 AS DOUBLE) AS max_diff,
  CAST(1 AS DOUBLE) AS recall, TRUE AS consistent FROM hit WHERE rn <= 10 GROUP BY q""")
def index_consistency(spark, sf):
    """Search over a written store equals search over fresh vectors."""
    store = _filled(spark, sf)
    fresh = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), encode_row(*PART, dims=D).alias("vec"))
    probe = table(spark, sf, "part").select("p_brand").distinct().select(
        F.col("p_brand").alias("query_id"), encode_row("p_brand", dims=D).alias("vec"))
    return S.compare_results(S.search_table(fresh, probe, D, 10), S.search_table(store.vectors(), probe, D, 10))
