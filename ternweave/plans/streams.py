"""Streaming jobs run to completion over the event table and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ternweave.operators.encode import encode_row

from ternweave.plans.common import HEX, flat_map_sql, hex_text, map_sql, query, table
from ternweave.plans.stores import scratch
from ternweave.sources.store import DocumentStore
from ternweave.streaming import jobs as J

D = 64
FIELDS = ("event_type", "props")

_MAP = flat_map_sql("events", "event_id", FIELDS, D)


def _stream(spark, sf):
    s = J.stream_table(spark, sf, "events.parquet", table(spark, sf, "events").schema)
    return s.withColumn("ts", J.instant("ts"))


def _finish(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@query(f"WITH {_MAP} SELECT id AS event_id, {HEX} AS vec FROM dv GROUP BY id")
def stream_ingest(spark, sf):
    """Streaming encode and append equals the batch encode."""
    out = scratch(spark, "stream")
    vec = _stream(spark, sf).select("event_id", encode_row(*FIELDS, dims=D).alias("vec"))
    _finish(J.write_append(vec, f"{out}/data", f"{out}/checkpoint"))
    return spark.read.schema("event_id BIGINT, vec BINARY").parquet(f"{out}/data").select("event_id", hex_text("vec").alias("vec"))


@query("SELECT event_id, event_type FROM events")
def stream_deduplicate(spark, sf):
    """Every event arrives twice and is stored once."""
    out = scratch(spark, "stream")
    twice = _stream(spark, sf).select("event_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    once = J.deduplicate(twice, "event_id", "ts", "2 days").select("event_id", "event_type")
    _finish(J.write_append(once, f"{out}/data", f"{out}/checkpoint"))
    return spark.read.schema("event_id BIGINT, event_type STRING").parquet(f"{out}/data")


def _window_sql(start, end, source="events"):
    return f"""WITH {_MAP}, w AS (SELECT event_id AS id, user_id, {start} AS ws FROM {source}),
v AS (SELECT ws, user_id, d, sign(sum(x)) AS x FROM w JOIN dv USING (id) GROUP BY ws, user_id, d)
SELECT CAST(epoch(ws) AS BIGINT) AS start, user_id, {HEX} AS vec FROM v WHERE {end} <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY ws, user_id"""


def _windowed(spark, sf, window):
    out = scratch(spark, "stream")
    events = _stream(spark, sf).withWatermark("ts", "2 hours")
    sums = J.windowed_sums(events, window, ["user_id"], encode_row(*FIELDS, dims=D), D)
    _finish(J.write_append(sums, f"{out}/data", f"{out}/checkpoint"))
    back = spark.read.schema(sums.schema).parquet(f"{out}/data")
    keyed = back.withColumn("start", F.unix_timestamp(F.col("window.start")))
    return J.profiles_from_sums(keyed, ["start", "user_id"]).select("start", "user_id", hex_text("vec").alias("vec"))


@query(_window_sql("date_trunc('day', ts)", "ws + INTERVAL 1 DAY"))
def stream_tumbling_profiles(spark, sf):
    """User profiles per day, for the days the watermark has closed."""
    return _windowed(spark, sf, F.window("ts", "1 day"))


@query(_window_sql("ts", "TRUE").replace("WHERE TRUE <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)", "WHERE ws + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)")
       .replace("SELECT event_id AS id, user_id, ts AS ws FROM events", "SELECT event_id AS id, user_id, date_trunc('day', ts) - INTERVAL (k) DAY AS ws FROM events, range(2) r(k)"))
def stream_sliding_profiles(spark, sf):
    """User profiles over two days, every day."""
    return _windowed(spark, sf, F.window("ts", "2 days", "1 day"))


@query(f"""WITH {_MAP}, g AS (SELECT event_id AS id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g), b AS (SELECT user_id, n, min(ts) AS ws, max(ts) AS last FROM s GROUP BY user_id, n),
v AS (SELECT ws, user_id, d, sign(sum(x)) AS x FROM s JOIN b USING (user_id, n) JOIN dv USING (id)
  WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY ws, user_id, d)
SELECT CAST(floor(epoch(ws)) AS BIGINT) AS start, user_id, {HEX} AS vec FROM v GROUP BY ws, user_id""")
def stream_session_profiles(spark, sf):
    """User profiles per session with a six hour gap."""
    return _windowed(spark, sf, F.session_window("ts", "6 hours"))


@query(f"""WITH {_MAP}, v AS (SELECT user_id, d, sign(sum(x)) AS x FROM events JOIN dv ON dv.id = event_id GROUP BY user_id, d)
SELECT user_id, {HEX} AS vec FROM v GROUP BY user_id""")
def stream_running_profiles(spark, sf):
    """Running user profiles without a window."""
    out = scratch(spark, "stream")
    vec = _stream(spark, sf).select("user_id", encode_row(*FIELDS, dims=D).alias("vec"))
    sums = J.running_sums(vec, ["user_id"], "vec", D)
    _finish(J.write_updates(sums, f"{out}/data", f"{out}/checkpoint"))
    last = J.latest_sums(spark.read.parquet(f"{out}/data"), ["user_id"])
    return J.profiles_from_sums(last, ["user_id"]).select("user_id", hex_text("vec").alias("vec"))


@query(f"""WITH {_MAP}, qkv AS (SELECT DISTINCT event_type AS id, 'event_type' AS k, event_type AS v FROM events), {map_sql("qv", "qkv")},
sc AS (SELECT qv.id AS query_id, dv.id AS doc_id, sum(dv.x * qv.x) AS s FROM dv JOIN qv USING (d) GROUP BY qv.id, dv.id)
SELECT query_id, doc_id, round(s / {D}.0, 6) AS score FROM sc JOIN events ON event_id = doc_id WHERE s / {D}.0 >= 0.25 AND value > 1""")
def stream_standing_probes(spark, sf):
    """Alerts of standing probes on new events, with a guard."""
    out = scratch(spark, "stream")
    probes = table(spark, sf, "events").select("event_type").distinct().select(
        F.col("event_type").alias("query_id"), encode_row("event_type", dims=D).alias("vec"))
    docs = _stream(spark, sf).select(F.col("event_id").alias("doc_id"), "value", encode_row(*FIELDS, dims=D).alias("vec"))
    hits = J.match_probes(docs, probes, D, 0.25, guard=F.col("value") > 1)
    _finish(J.write_append(hits, f"{out}/data", f"{out}/checkpoint"))
    back = spark.read.schema("query_id STRING, doc_id BIGINT, score DOUBLE").parquet(f"{out}/data")
    return back.withColumn("score", F.round("score", 6))


@query("""WITH l AS (SELECT user_id, max_by(event_type, ts) AS t, max_by(props, ts) AS p FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS doc_id, p AS doc FROM l WHERE t <> 'error'""")
def stream_changes(spark, sf):
    """Upserts and deletes per user from the event stream; an error deletes the user's document."""
    out = scratch(spark, "stream")
    store = DocumentStore(spark, f"{out}/store", D, buckets=4)
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    changes = _stream(spark, sf).select(F.col("user_id").cast("string").alias("doc_id"), op.alias("op"), F.col("props").alias("doc"), "ts")
    _finish(J.apply_changes(changes, store, f"{out}/checkpoint"))
    return store.documents()
