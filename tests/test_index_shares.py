"""The stored keyword index meets its blocks once for all jobs that ask the same."""

from matchloom.operators.keyword_index import keyword_index


def test_alike_jobs_meet_a_block_once(spark):
    items = spark.createDataFrame([(f"c{i:03d}", "one", float(i % 9), "mid", [f"w{i % 5}"], "") for i in range(60)],
                                  "candidate_id string, category string, experience_years double, seniority_level string, pool array<string>, summary string")
    jobs = spark.createDataFrame([(f"j{i}", "one", None, None, None, ["w1", "w2"]) for i in range(9)],
                                 "job_id string, category string, industry string, min_years double, preferred_seniority string, terms array<string>")
    hits, stages = keyword_index(items, block_rows=20).search_counted(jobs, 4)
    assert {r.job_id for r in stages.collect()} == {"j0"}
    found = {}
    for r in hits.orderBy("rank").collect():
        found.setdefault(r.job_id, []).append(r.candidate_id)
    assert found == {f"j{i}": ["c001", "c002", "c006", "c007"] for i in range(9)}
