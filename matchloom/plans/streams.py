"""Queries that drain a stream over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.plans import ingest as pg
from matchloom.plans.registry import query
from matchloom.session import shared_dir
from matchloom.sources.store import KeyedStore
from matchloom.streaming import jobs as sj


def events(i):
    schema = i.base("events").schema
    e = i.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(i.dir)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def log(e):
    return e.select("ts", F.concat(F.lit("/api/"), "event_type").alias("path"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), F.col("value").alias("duration_ms"))


@query("t01_incremental_ingestion", """
SELECT * FROM (SELECT 'first' AS run, count(*) AS seen, count(*) AS upserted, 0 AS skipped, count(*) AS embedded FROM customer UNION ALL SELECT 'second', count(*), 0, count(*), 0 FROM customer
UNION ALL SELECT 'changed', count(*), count(*) FILTER (c_custkey % 2 = 0), count(*) FILTER (c_custkey % 2 = 1), count(*) FILTER (c_custkey % 2 = 0) FROM customer)""")
def _(i):
    """The same rows twice, then with every other row changed: the second run writes nothing."""
    out = None
    store = KeyedStore(i.spark, shared_dir(i.spark, "ingested"), ["source_dataset", "candidate_id"])
    for n, name in enumerate(("first", "second", "changed")):
        src, tally = shared_dir(i.spark, "arrivals"), shared_dir(i.spark, "tally")
        salt = F.when(F.lit(name == "changed") & (F.col("c_custkey") % 2 == 0), F.lit("v2")).otherwise(F.lit("v1"))
        rows = i.base("customer").select(F.lit("people").alias("source_dataset"), F.concat(F.lit("cust-"), "c_custkey").alias("candidate_id"),
                                         F.sha2(F.concat("c_name", salt), 256).alias("normalization_hash"), F.sha2(F.concat(salt, "c_name"), 256).alias("embedding_hash"))
        rows.repartition(3, "candidate_id").write.parquet(src)
        arriving = i.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
        sj.ingest(arriving, store, tally, first_batch=n * 1000)
        total = i.spark.read.option("recursiveFileLookup", True).parquet(tally).agg(*[F.sum(c).alias(c) for c in ("seen", "upserted", "skipped", "embedded")])
        total = total.select(F.lit(name).alias("run"), "*")
        out = total if out is None else out.unionByName(total)
    return out


_CLOSED = "time_bucket(INTERVAL '{w}', ts) + INTERVAL '{w}' <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"
_RATE = """SELECT w AS window_start, user_id AS key, count(*) AS n, count(*) > 2 AS over_limit FROM (
 SELECT user_id, unnest([time_bucket(INTERVAL '6 hours', ts) - to_hours(6 * s) FOR s IN range(4)]) AS w FROM events) GROUP BY 1, 2"""
_TTL = """SELECT time_bucket(INTERVAL '36 hours', ts, TIMESTAMP '1970-01-01') AS window_start, user_id || '-' || event_type AS key, arg_min(event_id, (ts, event_id)) AS computed, count(*) - 1 AS repeats
 FROM events GROUP BY 1, 2"""
_LAST_TS = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def plain_time(df):
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def timed(i):
    return i.base("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("t02_rate_limit_batch", _RATE)
def _(i):
    return plain_time(sj.rate_windows(timed(i), "user_id", "ts", 2, "24 hours", "6 hours"))


@query("t02b_rate_limit_stream", f"SELECT * FROM ({_RATE}) WHERE window_start + INTERVAL 24 HOUR <= {_LAST_TS}")
def _(i):
    return plain_time(sj.to_table(sj.rate_windows(events(i), "user_id", "ts", 2, "24 hours", "6 hours"), "rate"))


def request_key(e):
    return e.withColumn("request", F.concat(F.col("user_id"), F.lit("-"), "event_type"))


@query("t03_ttl_dedupe_batch", _TTL)
def _(i):
    return plain_time(sj.repeated_requests(request_key(timed(i)), "request", "ts", "36 hours"))


@query("t03b_ttl_dedupe_stream", f"SELECT * FROM ({_TTL}) WHERE window_start + INTERVAL 36 HOUR <= {_LAST_TS}")
def _(i):
    return plain_time(sj.to_table(sj.repeated_requests(request_key(events(i)), "request", "ts", "36 hours"), "ttl"))


@query("t04_latest_feedback", pg._LAST.replace("notes, created_at, ", ""))
def _(i):
    src = shared_dir(i.spark, "feedback-in")
    i.feedback().repartition(3, "event_id").write.parquet(src)
    arriving = i.spark.readStream.schema(i.feedback().schema).option("maxFilesPerTrigger", 1).parquet(src)
    store = KeyedStore(i.spark, shared_dir(i.spark, "feedback"), ["session_id", "candidate_id"], ["created_at", "event_id"])
    sj.feedback_stream(arriving, store)
    return store.read().select("session_id", "candidate_id", "rating", "event_id")


@query("t05_session_feedback_join", """
SELECT s.event_id AS opened, f.event_id AS feedback FROM events s JOIN events f ON f.user_id = s.user_id AND f.ts BETWEEN s.ts AND s.ts + INTERVAL 1 HOUR WHERE s.event_type = 'signup' AND f.event_type IN ('purchase', 'error')""")
def _(i):
    s = events(i).where("event_type = 'signup'").select(F.col("user_id").alias("session_id"), F.col("ts").alias("started"), F.col("event_id").alias("opened"))
    f = events(i).where("event_type in ('purchase', 'error')").select(F.col("user_id").alias("fb_session"), F.col("ts").alias("created_at"), F.col("event_id").alias("feedback"))
    return sj.to_table(sj.session_feedback(s, f), "sessions").select("opened", "feedback")


@query("t06_latency_windows", f"""
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, path, count(*) AS n, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95, quantile_disc(duration_ms, 0.99) AS p99, round(count(*) FILTER (status_code >= 500) / count(*), 4) AS error_rate
FROM request_log WHERE {_CLOSED.format(w='1 hour')} GROUP BY 1, 2""")
def _(i):
    return sj.to_table(sj.latency_windows(log(events(i))), "latency").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("t06b_latency_spans")
def _(i):
    """Days from stored hourly sketches; the percentiles are within the sketches' rank error, so they have no SQL."""
    hours = sj.to_table(sj.latency_sketches(log(events(i))), "latency-sketches")
    return plain_time(sj.latency_spans(hours, "1 day"))


@query("t07_reliability_windows", f"""
SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, path AS stage, count(*) AS n, count(*) FILTER (status_code >= 500) AS errors, count(*) FILTER (duration_ms > 100) AS fallbacks FROM request_log WHERE {_CLOSED.format(w='1 day')} GROUP BY 1, 2""")
def _(i):
    return sj.to_table(sj.reliability_windows(log(events(i))), "reliability").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
