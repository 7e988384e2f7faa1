"""The stored keyword index against the search over all documents."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators.keyword_index import keyword_index
from matchloom.operators.search import keyword_top_k

ITEMS = "candidate_id string, category string, experience_years double, seniority_level string, pool array<string>, summary string, level_no int, places string"
JOBS = "job_id string, category string, industry string, min_years double, preferred_seniority string, terms array<string>, need_level int, place string"
WORDS = [f"skill{i}" for i in range(60)] + ["go", "c", "deep learning", "ml"]


def data(spark, n_items=1500, n_jobs=120):
    r = random.Random(11)
    items = []
    for i in range(n_items):
        pool = sorted({r.choice(WORDS[:8]) if r.random() < 0.5 else r.choice(WORDS) for _ in range(r.randrange(0, 9))})
        cat = r.choice(["software engineering", "software engineering", "manufacturing", "retail sales", None])
        items.append((f"c{i:05d}", cat, r.choice([None, 0.0, 2.5, 6.0, 11.0, r.random() * 20]), r.choice(["junior", "Senior", None]), pool,
                      r.choice([f"Builds {r.choice(WORDS)} and {r.choice(WORDS)} at work.", "", None]), r.randrange(4), r.choice(["oslo", "remote", "paris|oslo"])))
    jobs = []
    for j in range(n_jobs):
        terms = [r.choice(WORDS) for _ in range(r.randrange(0 if j % 10 == 0 else 1, 7))]
        jobs.append((f"j{j:04d}", r.choice([None, None, "Software Engineering", "manufacturing", "unknown"]), r.choice([None, "technology", "industrial", "odd"]),
                     r.choice([None, 0.0, 3.0, 8.0]), r.choice([None, "senior", "junior"]), terms, r.choice([None, None, 2]), r.choice([None, "", "oslo", "remote"])))
    return spark.createDataFrame(items, ITEMS).repartition(5), spark.createDataFrame(jobs, JOBS).repartition(3)


def told(df):
    return sorted((r.job_id, r["rank"], r.candidate_id, r.keyword_score, r.metadata_score, r.fusion_score) for r in df.collect())


@pytest.mark.parametrize("k", [3, 40])
def test_index_equals_the_search_over_all(spark, k):
    items, jobs = data(spark)
    for drop in ((), ("need_level", "place")):
        q = jobs.drop(*drop)
        i = items.drop("level_no", "places") if drop else items
        got = told(keyword_index(i, block_rows=50).search(q, k))
        assert got == told(keyword_top_k(q, i, k)) and len(got) > 200


def test_leading_terms_alone_are_looked_for_in_summaries(spark):
    items, jobs = data(spark, 400, 60)
    assert told(keyword_index(items, block_rows=40).search(jobs, 10, heads=1)) == told(keyword_top_k(jobs, items, 10, heads=1))


def test_blocks_that_cannot_matter_are_skipped(spark):
    """Skills come in roles, as in real profiles; a few documents of each role know something of another."""
    r = random.Random(3)
    roles = [[f"r{k}s{i}" for i in range(8)] for k in range(20)]
    items = []
    for i in range(1600):
        pool = r.sample(roles[i % 20], 5) + (r.sample(r.choice(roles), 1) if i % 6 == 0 else [])
        items.append((f"c{i:05d}", "one", 5.0 + i % 7, "senior", sorted(set(pool)), "", 1, "oslo"))
    jobs = [(f"j{j:03d}", None, None, 3.0, None, r.sample(roles[j % 20], 4), None, None) for j in range(40)]
    items, jobs = spark.createDataFrame(items, ITEMS), spark.createDataFrame(jobs, JOBS)
    hits, stages = keyword_index(items, block_rows=20).search_counted(jobs, 5, lead=2)
    n = {x.stage: x["count"] for x in stages.groupBy("stage").count().collect()}
    print("blocks by stage:", n)
    assert n["skipped"] > 0.3 * sum(n.values()) and told(hits) == told(keyword_top_k(jobs, items, 5))


def test_blocks_are_bounded_and_empty_tables_give_nothing(spark):
    items, jobs = data(spark, 600, 10)
    index = keyword_index(items.withColumn("category", F.lit("one")).withColumn("seniority_level", F.lit("mid")), block_rows=50)
    assert spark.read.parquet(f"{index.path}/blocks").agg(F.max("n")).first()[0] < 100
    assert index.search(jobs.limit(0), 5).collect() == []
    assert keyword_index(items.limit(0)).search(jobs, 5).collect() == []
