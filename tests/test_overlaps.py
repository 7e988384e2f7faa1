"""Skill overlaps of whole batches against those of single rows."""

import random

from pyspark.sql import functions as F

from matchloom.functions import scoring as sc
from matchloom.operators import matching as ma
from matchloom import plans  # noqa: F401  (registers the queries)
from matchloom.plans.registry import QUERIES


def test_batches_equal_single_rows(spark, monkeypatch):
    r = random.Random(8)
    words = ["red", "bolt", "bolts", "the", "c++", "c", "of", "data", "data-lake", ".net", "Ünit", "x y"]
    names = [" ".join(r.sample(words, n)) for n in (1, 1, 2, 2, 3) for _ in range(8)] + ["the of", "", "Red  Bolt", "a&b"]
    rows = [(f"j{i}", f"c{i}", *[r.sample(names, r.choice([0, 1, 4, 9])) for _ in range(5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "job_id string, candidate_id string, req array<string>, rel array<string>, core array<string>, exp array<string>, skills array<string>")
    c = F.col
    plain = df.select("job_id", sc.skill_overlap(c("core"), c("exp"), c("skills"), c("req"), c("rel")).alias("o")).select("job_id", "o.*")
    want = {x[0]: tuple(round(v, 9) for v in x[1:]) for x in plain.collect()}
    pairs = df.select("job_id", "candidate_id", sc.job_skills(c("req"), c("rel")).alias("job_skills"), sc.candidate_skills(c("core"), c("exp"), c("skills")).alias("candidate_skills"))
    assert {x[0]: tuple(round(v, 9) for v in x[2:]) for x in ma.overlaps(pairs).collect()} == want
    batches = []
    monkeypatch.setattr(ma, "_CELLS", 100)  # halved down to small tables
    for b in pairs.coalesce(1)._collect_as_arrow():
        batches += list(ma._overlaps(b))
    assert {x["job_id"]: tuple(round(x[n], 9) for n in ma.OVERLAPS) for b in batches for x in b.to_pylist()} == want


def test_pairs_travel_without_words(spark):
    """Before, each pair was shuffled with the words of all its terms and compared them term by term in the plan."""
    plan = QUERIES["k03_skill_overlap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan


def test_matches_find_their_overlaps_by_the_batch(spark):
    r = random.Random(9)
    names = ["red bolt", "bolt", "hot plate", "plate", "old ring", "c++", "Ring "]
    rows = [(f"j{i}", f"c{i}", r.random(), *[r.sample(names, r.choice([0, 1, 4])) for _ in range(5)], r.choice([None, 3.0]), r.choice([None, 2.0]), "mid", "senior", "a", "a", 0.5)
            for i in range(60)]
    df = spark.createDataFrame(rows, "job_id string, candidate_id string, raw_score double, required_skills array<string>, related_skills array<string>, core_skills array<string>, "
                               "expanded_skills array<string>, skills array<string>, experience_years double, min_years double, seniority_level string, preferred_seniority string, "
                               "job_category string, category string, adjacent_score double")
    c = F.col
    batched = df.withColumn("job_skills", sc.job_skills(c("required_skills"), c("related_skills"))).withColumn(
        "candidate_skills", sc.candidate_skills(c("core_skills"), c("expanded_skills"), c("skills")))
    one, two = ma.match_scores(df), ma.match_scores(batched)
    assert one.columns == two.columns

    def rounded(found):
        return sorted([round(v, 9) if isinstance(v, float) else str(v) for v in x] for x in found.collect())

    assert rounded(one) == rounded(two)


def test_metadata_of_a_candidate_without_document(spark):
    rows = [("plate", "technology", 2.0, "mid", None, None, None), ("one", None, None, None, "One", 1.0, " Mid"), (None, "industrial", 0.0, "", "hot plate", None, "mid")]
    df = spark.createDataFrame(rows, "a string, b string, c double, d string, e string, f double, g string")
    job, own = sc.job_facts(*[F.col(n) for n in "abcd"]), sc.candidate_facts(*[F.col(n) for n in "efg"])
    made = df.select(job.alias("j"), own.alias("c")).select(sc.prepared_metadata(F.col("j"), F.col("c")))
    assert [round(x[0], 6) for x in made.collect()] == [0.03, 0.75, 0.275]
