"""Brute-force and skew checks: tiny chunks, one hot key, shuffled input."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions import scoring as sc
from matchloom.operators import experience as ex
from matchloom.operators import ontology as on
from matchloom.operators import search as se
from matchloom.operators.ranking import exact_percentiles, latest, places
from matchloom.sources import csv as cs
from matchloom.sources import jsonl as js
from matchloom.sources import store as st
from matchloom.streaming import jobs as sj


def test_exact_percentiles_with_a_hot_key(spark):
    rnd = random.Random(1)
    data = [("hot", rnd.choice([rnd.random(), 0.5])) for _ in range(5000)] + [(f"k{i % 7}", rnd.random()) for i in range(300)] + [("single", 3.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    ps = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    groups = collections.defaultdict(list)
    for k, v in data:
        groups[k].append(v)
    for r in exact_percentiles(df, ["k"], "v", ps, buckets=16).collect():
        for name, p in ps.items():
            assert r[name] == pytest.approx(np.percentile(groups[r.k], p * 100), abs=1e-4)


def vectors(spark, n, prefix, dim=8, seed=0):
    g = np.random.default_rng(seed)
    rows = [(f"{prefix}{i}", ["x", "y", None][i % 3], float(i % 5) if i % 4 else None, g.normal(size=dim).tolist()) for i in range(n)]
    return rows


def test_blocked_vector_search_equals_brute_force(spark):
    qs, its = vectors(spark, 40, "j", seed=1), vectors(spark, 300, "c", seed=2)
    q = spark.createDataFrame(qs, "job_id string, category string, min_years double, embedding array<double>")
    i = spark.createDataFrame(its, "candidate_id string, category string, experience_years double, embedding array<double>")
    got = collections.defaultdict(list)
    for r in se.vector_top_k(q, i, 7, item_rows=13, query_rows=5).orderBy("job_id", "rank").collect():
        got[r.job_id].append((r.candidate_id, r.score))
    for job, cat, need, e in qs:
        all_ = [(c, round(float(np.dot(e, v)), 6)) for c, ccat, y, v in its if (cat is None or ccat == cat) and (need is None or (y or 0.0) >= need)]
        want = sorted(all_, key=lambda t: (-t[1], t[0]))[:7]
        assert [c for c, _ in got[job]] == [c for c, _ in want]


def test_chunk_size_does_not_change_keyword_search(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    jobs = [(f"j{i}", rnd.choice(["a", None]), rnd.choice(["technology", None]), rnd.choice([2.0, None]), rnd.choice(["mid", None]), rnd.sample(words, 4)) for i in range(15)]
    docs = [(f"c{i}", rnd.choice(["a", "software b"]), rnd.choice([1.0, 5.0, None]), rnd.choice(["mid", None]), rnd.sample(words, 3), rnd.choice(words) + " text") for i in range(120)]
    q = spark.createDataFrame(jobs, "job_id string, category string, industry string, min_years double, preferred_seniority string, terms array<string>")
    d = spark.createDataFrame(docs, "candidate_id string, category string, experience_years double, seniority_level string, pool array<string>, summary string")
    runs = [sorted(map(tuple, se.keyword_top_k(q, d.repartition(n), 5, rows, rows).collect())) for n, rows in ((1, 10_000), (4, 7))]
    assert runs[0] == runs[1]
    # the block formula equals the column formula
    pairs = q.crossJoin(d.select("candidate_id", F.col("category").alias("cc"), "experience_years", "seniority_level", "pool", "summary"))
    kw = sc.keyword_score(F.col("pool"), F.col("terms"))
    meta = sc.r4(sc.metadata_score(F.col("category"), F.col("industry"), F.col("min_years"), F.col("preferred_seniority"), F.col("cc"), F.col("experience_years"), F.col("seniority_level")))
    ok = sc.keyword_predicate(F.col("terms"), F.col("category"), F.col("industry"), F.col("min_years"), F.col("cc"), F.col("experience_years"), F.col("pool"), F.col("summary"))
    full = {(r.job_id, r.candidate_id): r.f for r in pairs.where(ok).select("job_id", "candidate_id", sc.r4(sc.fusion(F.lit(0.0), kw, meta)).alias("f")).collect()}
    best = collections.defaultdict(list)
    for (j, c), f in full.items():
        best[j].append((-f, c))
    got = collections.defaultdict(list)
    for r in se.keyword_top_k(q, d, 5).orderBy("job_id", "rank").collect():
        got[r.job_id].append((-r.fusion_score, r.candidate_id))
    assert {j: sorted(v)[:5] for j, v in best.items()} == dict(got)


def test_interval_union_against_sets(spark):
    rnd = random.Random(5)
    rows = [(f"c{rnd.randrange(4) if rnd.random() < .5 else 0}", rnd.randrange(300), None) for _ in range(800)]
    rows = [(c, s, rnd.choice([None, s + rnd.randrange(-3, 12)])) for c, s, _ in rows]
    months = collections.defaultdict(set)
    for c, s, e in rows:
        e = 320 if e is None else e
        if e >= s:
            months[c].update(range(s, e + 1))
    got = {r.candidate_id: r.months for r in ex.experience_years(spark.createDataFrame(rows, "candidate_id string, start_idx long, end_idx long"), 320).collect()}
    assert got == {c: len(m) for c, m in months.items()}


def test_trajectory_against_a_sorted_walk(spark):
    rnd = random.Random(6)
    rows = [("hot" if rnd.random() < .6 else f"c{rnd.randrange(5)}", i, rnd.choice("TU"), rnd.choice("XY"), rnd.choice([None, rnd.randrange(40)])) for i in range(400)]
    df = spark.createDataFrame(rows, "candidate_id string, seq long, title string, company string, start_idx long")
    got = {r.candidate_id: r for r in ex.career_trajectory(df).collect()}
    people = collections.defaultdict(list)
    for c, s, t, f, st_ in rows:
        people[c].append((-1 if st_ is None else st_, s, t, f))
    for c, items in people.items():
        items.sort()
        moves = [(a, b) for a, b in zip(items, items[1:]) if a[2:] != b[2:]]
        kind = "transition" if any(a[3] != b[3] for a, b in moves) else "growth" if len(moves) >= 2 else "stable"
        assert (got[c].progression, got[c].n_moves) == (kind, len(moves))
        assert got[c].moves == "|".join(f"{a[2]} at {a[3]} > {b[2]} at {b[3]}" for a, b in moves[:6])


def test_grouped_keeps_every_child(spark):
    child = spark.createDataFrame([(1 if i % 3 else i % 5, i, f"v{i}") for i in range(500)] + [(9, i, f"p{i}") for i in range(200, 230)], "k long, seq long, v string")
    parents = child.select("k").distinct().where("k <> 4")
    want = sorted((k, s, v) for k, s, v in map(tuple, child.collect()) if k != 4)
    assert sorted(map(tuple, cs.grouped(child, parents, "k", "seq", ["v"]).collect())) == want
    lists = {r.k: r["items"] for r in cs.listed(cs.grouped(child, parents, "k", "seq", ["v"]), "k", ["v"], most=400).collect()}
    assert lists == {k: [v for kk, _, v in want if kk == k] for k in {w[0] for w in want}} and len(lists[9]) == 30
    with pytest.raises(Exception, match="more than 30 rows of one key"):
        cs.listed(cs.grouped(child, parents, "k", "seq", ["v"]), "k", ["v"], most=30).collect()


def test_places_of_a_hot_key(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < .6 else f"k{rnd.randrange(5)}", rnd.randrange(50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(5)
    got = {r.i: r.position for r in places(df, "k", [F.desc("v"), F.asc("i")]).collect()}
    for k in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))


def test_a_replayed_batch_writes_the_same_again(spark, tmp_path):
    s, tally = st.KeyedStore(spark, str(tmp_path / "s"), ["source_dataset", "candidate_id"]), str(tmp_path / "tally")
    schema = "source_dataset string, candidate_id string, normalization_hash string, embedding_hash string"
    first = spark.createDataFrame([("d", "1", "a", "a"), ("d", "2", "a", "a")], schema)
    second = spark.createDataFrame([("d", "2", "b", "b"), ("d", "3", "a", "a")], schema)

    def seen():
        counters = spark.read.option("recursiveFileLookup", True).parquet(tally)
        return sorted(map(str, s.read().collect())), sorted(map(str, counters.collect()))
    sj.ingest_batch(first, 0, s, tally)
    sj.ingest_batch(second, 1, s, tally)
    once = seen()
    assert len(once[0]) == 3
    sj.ingest_batch(second, 1, s, tally)
    assert seen() == once
    sj.ingest_batch(second, 2, s, tally)  # the same rows in a later batch change nothing
    assert seen()[0] == once[0]


def test_the_change_plan_of_a_batch_is_made_once(spark, tmp_path):
    s, tally = st.KeyedStore(spark, str(tmp_path / "s"), ["source_dataset", "candidate_id"]), str(tmp_path / "tally")
    runs = spark.sparkContext.accumulator(0)

    def hashed(v):
        runs.add(1)
        return f"h{v}"
    rows = spark.range(100).select(F.lit("d").alias("source_dataset"), F.col("id").cast("string").alias("candidate_id"))
    udf = F.udf(hashed, "string").asNondeterministic()
    batch = rows.withColumn("normalization_hash", udf("candidate_id")).withColumn("embedding_hash", F.lit("e"))
    sj.ingest_batch(batch, 0, s, tally)
    assert runs.value == 100
    assert [tuple(r) for r in spark.read.parquet(f"{tally}/b0").select("seen", "upserted", "skipped", "embedded").collect()] == [(100, 100, 0, 100)]
    sj.ingest_batch(batch, 1, s, tally)
    assert [tuple(r) for r in spark.read.parquet(f"{tally}/b1").select("seen", "upserted", "skipped", "embedded").collect()] == [(100, 0, 100, 0)]


def test_rates_and_repeats_against_a_loop(spark):
    rnd = random.Random(8)
    base, rows, t = 1_700_000_000, [], 0
    for i in range(600):
        t += rnd.choice([1, 3, 20, 90])
        rows.append((i, "hot" if rnd.random() < .5 else f"k{rnd.randrange(6)}", base + t))
    df = spark.createDataFrame(rows, "event_id long, key string, s long").select("event_id", "key", F.timestamp_seconds("s").alias("ts"))
    rate, first, again = collections.Counter(), {}, collections.Counter()
    for i, k, s in rows:
        for j in range(3):
            rate[s // 20 * 20 - 20 * j, k] += 1
        first.setdefault((s // 60 * 60, k), i)
        again[s // 60 * 60, k] += 1
    got = {(r.w, r.key): (r.n, r.over_limit) for r in sj.rate_windows(df, "key", "ts", 3, "60 seconds", "20 seconds").withColumn("w", F.unix_seconds("window_start")).collect()}
    assert got == {k: (n, n > 3) for k, n in rate.items()}
    got = {(r.w, r.key): (r.computed, r.repeats) for r in sj.repeated_requests(df, "key", "ts", "60 seconds").withColumn("w", F.unix_seconds("window_start")).collect()}
    assert got == {k: (i, again[k] - 1) for k, i in first.items()}


def test_store_replay_and_latest(spark, tmp_path):
    s = st.KeyedStore(spark, str(tmp_path / "s"), ["id"])
    a = spark.createDataFrame([(1, "a"), (2, "a")], "id long, v string")
    s.upsert(a, 0)
    for _ in range(2):  # a replayed batch changes nothing
        s.upsert(spark.createDataFrame([(2, "b"), (3, "b")], "id long, v string"), 1)
    want = [(1, "a"), (2, "b"), (3, "b")]
    assert sorted(map(tuple, s.read().collect())) == want
    assert sorted(map(tuple, s.compact(str(tmp_path / "t")).read().collect())) == want
    assert sorted(map(tuple, s.read(a.where("id = 2")).collect())) == [(2, "b")]
    assert sorted(map(tuple, st.merge(a, spark.createDataFrame([(2, "z")], "id long, v string"), ["id"]).collect())) == [(1, "a"), (2, "z")]


def test_latest_takes_one_whole_row(spark):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 3, None), ("k", 2, "z")], "k string, t int, v string")
    assert [tuple(r) for r in latest(df, ["k"], ["t"]).collect()] == [("k", 3, None)]


ONT = {
    "skill_aliases.yml": "python:\n  aliases: [py, python3]\nc++:\n  aliases: [cpp]\n",
    "skill_taxonomy.yml": ("python: {domain: programming, family: scripting, parents: [software development]}\nc++: {domain: programming, family: systems, parents: []}\n"
                           "machine learning: {domain: data, family: ml, parents: [data science]}\nlearning: {domain: data, family: training, parents: []}\n"
                           "mining: {domain: heavy, family: ml, parents: [data science]}\n"),
    "skill_role_candidates.yml": "data scientist: {}\n", "skill_capability_phrases.yml": "team leadership: {}\n",
    "versioned_skills.yml": "java 8: {canonical: java, version: '8'}\n", "skill_review_required.yml": "ambiguous_skills:\n  - token: go\n",
}


@pytest.fixture()
def ontology(spark, tmp_path):
    for name, body in ONT.items():
        (tmp_path / name).write_text(body)
    return on.load_ontology(spark, str(tmp_path))


def test_ontology_normalize(spark, ontology):
    skills = ["Python3", "py", "deep machine learning", "C++", "Go", "Data Scientist", "team  leadership", "java 8", "MS SQL Server 2008 R2", "cobol"]
    df = spark.createDataFrame([("a", skills), ("b", [])], "id string, s array<string>")
    r = {x.id: x for x in on.normalize(df, "id", F.col("s"), ontology, order="ord").collect()}
    a = r["a"]
    assert a.canonical_skills == ["python", "deep machine learning", "c++", "go", "data scientist", "team leadership", "java 8", "ms sql server 2008 r2", "cobol"]
    assert a.core_skills == ["python", "machine learning", "c++"]
    assert a.expanded_skills == ["python", "software development", "machine learning", "data science", "c++"]
    assert (a.capability_phrases, a.role_candidates, a.review_required_skills) == (["team leadership"], ["data scientist"], ["go"])
    assert a.versioned_skills == ["java 8=java@8", "ms sql server 2008 r2=sql server@2008 r2"]
    assert a.alias_applied and a.taxonomy_applied and not r["b"].taxonomy_applied and r["b"].canonical_skills == []


def test_ontology_adjacency_order_and_reason(spark, ontology):
    seeds = spark.createDataFrame([("j", 0, "machine learning")], "job_id string, pos int, skill string")
    got = [(r.skill, r.evidence) for r in on.adjacent_skills(seeds, ontology.taxonomy, "job_id", order="ord").orderBy("n").collect()]
    assert got == [("learning", "learning is adjacent to machine learning via shared domain 'data'."), ("mining", "mining is adjacent to machine learning via shared family 'ml'.")]


def test_alias_hints_need_free_standing_words(spark, ontology):
    t = spark.createDataFrame([(1, "I like cpp, and C++!"), (2, "cppx pyx"), (3, "use python3.")], "id long, text string")
    got = {r.id: r.hints for r in on.alias_hints(t, "id", ontology.alias_map).collect()}
    assert got == {1: ["c++"], 3: ["python"]}


def test_golden_strict_mode_fails(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"query_id": "q1"}\n\n{"soft_golden": true}\n')
    rows = js.golden_rows(spark, str(tmp_path / "g.jsonl")).collect()
    assert len(rows) == 1 and rows[0].reason.startswith("missing ")
    with pytest.raises(Exception, match="golden set: missing"):
        js.read_golden(spark, str(tmp_path / "g.jsonl")).collect()


def test_top_k_is_limited_before_the_shuffle(spark):
    from matchloom.operators.ranking import top_k
    plan = top_k(spark.range(10).selectExpr("id % 2 as k", "id as v"), ["k"], [F.desc("v")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
