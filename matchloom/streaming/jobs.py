"""Structured Streaming jobs, each with its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import ingestion as ig
from matchloom.operators.ranking import latest
from matchloom.session import materialize, shared_dir
from matchloom.sources.store import KeyedStore


def drain(writer, spark: SparkSession, name: str) -> None:
    """Run a stream over everything available now, with its checkpoint in the shared folder."""
    writer.option("checkpointLocation", shared_dir(spark, f"{name}-checkpoint")).trigger(availableNow=True).start().awaitTermination()


def to_table(stream: DataFrame, name: str) -> DataFrame:
    """Drain an append-mode stream into parquet and read it back."""
    spark, path = stream.sparkSession, shared_dir(stream.sparkSession, name)
    drain(stream.writeStream.outputMode("append").format("parquet").option("path", path), spark, name)
    return spark.read.schema(stream.schema).parquet(path)


# -- T01: hash-gated ingestion ---------------------------------------------
def ingest_batch(batch: DataFrame, n: int, store: KeyedStore, counters_path: str) -> None:
    """Writes the changed rows of batch ``n`` and its counters.

    The counters replace a folder named after the batch, the store commits it last: a replay after that changes nothing,
    one before it finds the same state and writes the same again. Only the buckets of the batch's keys are read.
    The change plan is made once, in a table that counters and store both read; metrics observed in the writing job would
    count the rows of a task twice that runs again after an executor is lost.
    """
    if store.has(n):
        return
    state = store.read_or_empty(batch.schema, batch).select(*ig.KEY, "normalization_hash", "embedding_hash")
    plan = materialize(ig.plan_changes(batch, state), "ingest-plan")
    ig.counters(plan).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{counters_path}/b{n}")
    store.upsert(plan.where("needs_upsert or needs_embedding").select(*batch.columns), n)


def ingest(stream: DataFrame, store: KeyedStore, counters_path: str, first_batch: int = 0) -> None:
    """Runs ``ingest_batch`` on every micro-batch."""
    drain(stream.writeStream.foreachBatch(lambda batch, k: ingest_batch(batch, first_batch + k, store, counters_path)), stream.sparkSession, "ingest")


# -- T02: request rate ------------------------------------------------------
def rate_windows(events: DataFrame, key: str, ts: str, limit: int, width: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """Per key and sliding window: requests, and whether they exceed ``limit``. The same plan runs on a table or a stream."""
    src = events.withWatermark(ts, late) if events.isStreaming else events
    return src.groupBy(F.window(ts, width, slide).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "key", "n", (F.col("n") > limit).alias("over_limit"))


# -- T03: repeated requests ---------------------------------------------------
def repeated_requests(events: DataFrame, key: str, ts: str, ttl: str, late: str = "10 minutes") -> DataFrame:
    """Per key and time-to-live period: the request that is computed (the first) and how many repeat it."""
    src = events.withWatermark(ts, late) if events.isStreaming else events
    return src.groupBy(F.window(ts, ttl).alias("w"), F.col(key).alias("key")).agg(
        F.min_by("event_id", F.struct(ts, "event_id")).alias("computed"), (F.count("*") - 1).alias("repeats")).select(
        F.col("w.start").alias("window_start"), "key", "computed", "repeats")


# -- T04: latest feedback per key --------------------------------------------
def feedback_stream(stream: DataFrame, store: KeyedStore) -> None:
    """Micro-batches keep their newest row per key; the store picks the newest over all by creation time."""
    def step(batch: DataFrame, batch_id: int) -> None:
        store.upsert(latest(batch, store.keys, store.by), batch_id)

    drain(stream.writeStream.foreachBatch(step), stream.sparkSession, "feedback")


# -- T05: session-feedback join ----------------------------------------------
def session_feedback(sessions: DataFrame, feedback: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Feedback within ``within`` of its session's creation; both sides carry watermarks so state stays bounded.

    sessions: session_id, started; feedback: fb_session, created_at and more.
    """
    s, f = sessions, feedback
    if s.isStreaming:
        s, f = s.withWatermark("started", late), f.withWatermark("created_at", late)
    on = (F.col("session_id") == F.col("fb_session")) & (F.col("created_at") >= F.col("started")) & (F.col("created_at") <= F.col("started") + F.expr(f"interval {within}"))
    return s.join(f, on)


# -- T06 / T07: windows --------------------------------------------------------
def latency_windows(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window and path: requests, p50, p95, p99, error rate."""
    src = log.withWatermark("ts", late) if log.isStreaming else log
    return src.groupBy(F.window("ts", width).alias("w"), "path").agg(
        F.count("*").alias("n"), *[F.percentile_approx("duration_ms", p / 100, 10000).alias(f"p{p}") for p in (50, 95, 99)],
        F.round(F.count_if(F.col("status_code") >= 500) / F.count("*"), 4).alias("error_rate")).select(
        F.col("w.start").alias("window_start"), "path", "n", "p50", "p95", "p99", "error_rate")


SKETCH = 800  # size of a quantile sketch: ranks are off by about 0.4 per cent of the rows


def latency_sketches(log: DataFrame, width: str = "1 hour", late: str = "10 minutes", size: int = SKETCH) -> DataFrame:
    """Per window and path: requests, errors and a quantile sketch of the durations, to be stored.

    A sketch is a few kilobytes whatever the number of requests, and sketches of windows merge into that of any longer
    span, so the log itself need not be kept or read again."""
    src = log.withWatermark("ts", late) if log.isStreaming else log
    return src.groupBy(F.window("ts", width).alias("w"), "path").agg(
        F.count("*").alias("n"), F.count_if(F.col("status_code") >= 500).alias("errors"), F.kll_sketch_agg_double(F.col("duration_ms").cast("double"), F.lit(size)).alias("sketch")).select(
        F.col("w.start").alias("window_start"), "path", "n", "errors", "sketch")


def latency_spans(stored: DataFrame, span: str) -> DataFrame:
    """Per longer span and path, from stored windows alone: requests, p50, p95, p99, error rate."""
    merged = stored.groupBy(F.window("window_start", span).alias("w"), "path").agg(
        F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(
        F.col("w.start").alias("window_start"), "path", "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100)).alias(f"p{p}") for p in (50, 95, 99)],
        F.round(F.col("errors") / F.col("n"), 4).alias("error_rate"))


def reliability_windows(log: DataFrame, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    src = log.withWatermark("ts", late) if log.isStreaming else log
    return src.groupBy(F.window("ts", width).alias("w"), F.col("path").alias("stage")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status_code") >= 500).alias("errors"), F.count_if(F.col("duration_ms") > 100).alias("fallbacks")).select(
        F.col("w.start").alias("window_start"), "stage", "n", "errors", "fallbacks")
