"""Percentiles from stored sketches against exact ranks."""

import random

from pyspark.sql import functions as F

from matchloom.streaming import jobs as sj


def test_merged_windows_are_within_the_rank_error(spark, tmp_path):
    r = random.Random(4)
    rows = [(1_700_000_000 + r.randrange(40 * 3600), "hot" if r.random() < 0.7 else "cold", 500 if r.random() < 0.1 else 200, r.lognormvariate(3, 1.5)) for _ in range(30_000)]
    log = spark.createDataFrame(rows, "s long, path string, status_code int, duration_ms double").select(F.timestamp_seconds("s").alias("ts"), "path", "status_code", "duration_ms")
    sj.latency_sketches(log).write.parquet(str(tmp_path / "hours"))
    stored = spark.read.parquet(str(tmp_path / "hours"))
    assert stored.count() > 70 and stored.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    for x in sj.latency_spans(stored, "1 day").withColumn("day", F.unix_seconds("window_start")).collect():
        mine = sorted(d for s, p, c, d in rows if s // 86400 * 86400 == x.day and p == x.path)
        errors = sum(c == 500 for s, p, c, d in rows if s // 86400 * 86400 == x.day and p == x.path)
        assert x.n == len(mine) and x.error_rate == round(errors / len(mine), 4)
        for q, got in ((0.5, x.p50), (0.95, x.p95), (0.99, x.p99)):
            rank = sum(d <= got for d in mine) / len(mine)
            assert abs(rank - q) < 0.01


def test_few_values_are_exact_and_nulls_are_left_out(spark):
    rows = [(1_700_000_000 + i, "p", 200, float(i) if i % 10 else None) for i in range(1, 101)]
    log = spark.createDataFrame(rows, "s long, path string, status_code int, duration_ms double").withColumn("ts", F.timestamp_seconds("s"))
    x = sj.latency_spans(sj.latency_sketches(log), "1 day").first()
    values = sorted(d for *_, d in rows if d is not None)
    assert x.n == 100 and abs(values.index(x.p50) - 45) <= 1 and values.index(x.p99) >= 88
    assert sj.latency_spans(sj.latency_sketches(log.limit(0)), "1 day").collect() == []
