"""The containment join and adjacency against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import ontology as on
from matchloom.operators.containment import contained, listed


@pytest.mark.parametrize("longest", [2, 5])
def test_patterns_of_any_length_against_a_loop(spark, longest):
    r = random.Random(longest)
    texts = [(i, "".join(r.choice("abcdé 中") for _ in range(r.randrange(0, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, "abc" * 3000)]
    patterns = ["".join(r.choice("abcdé 中") for _ in range(r.randrange(1, 9))) for _ in range(400)] + ["", None, "abcabcabcabc", "zzzzzz", "a%b_", "abcab"]
    got = contained(spark.createDataFrame(texts, "id long, t string"), "id", F.col("t"), spark.createDataFrame([(p,) for p in patterns], "p string"), "p", longest)
    want = sorted((i, p) for i, t in texts for p in {p for p in patterns if p} if t is not None and p in t)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500


def test_a_large_dictionary_is_a_table_and_the_plan_does_not_grow(spark):
    texts = spark.createDataFrame([(i, f"needs skill{i * 37 % 1000:05d} and skill{i:05d}x") for i in range(300)], "id long, t string")

    def plan(n):
        words = spark.range(n).select(F.format_string("skill%05d", "id").alias("p"))
        hits = contained(texts, "id", F.col("t"), words, "p")
        return hits, len(hits._jdf.queryExecution().optimizedPlan().toString())
    large, small = plan(100_000), plan(10)
    assert abs(large[1] - small[1]) < 200
    got = {(r.id, r.p) for r in large[0].collect()}
    assert got == {(i, f"skill{k:05d}") for i in range(300) for k in (i * 37 % 1000, i)}
    first = {r.id: r.names for r in listed(large[0], texts, "id", "p", "names").collect()}
    assert first[2] == ["skill00002", "skill00074"] and len(first) == 300


def test_no_patterns_and_no_texts(spark):
    texts = spark.createDataFrame([(1, "a")], "id long, t string")
    none = spark.createDataFrame([], "p string")
    assert contained(texts, "id", F.col("t"), none, "p").collect() == []
    assert contained(texts.limit(0), "id", F.col("t"), spark.createDataFrame([("a",)], "p string"), "p").collect() == []
    assert listed(contained(texts, "id", F.col("t"), none, "p"), texts, "id", "p", "n").first().n == []


def adjacency_loop(seeds, taxonomy, limit):
    meta = {t[0]: t for t in taxonomy}
    out = []
    for seed in seeds:
        for skill, _, domain, family, parents in sorted(taxonomy, key=lambda t: t[1]):
            if skill in seeds:
                continue
            _, _, d, f, ps = meta[seed]
            common = sorted(set(ps) & set(parents))
            why = f"domain '{d}'" if d and d == domain else f"family '{f}'" if f and f == family else f"parent '{common[0]}'" if common else None
            if why:
                out.append((skill, f"{skill} is adjacent to {seed} via shared {why}."))
                if len(out) == limit:
                    return out
    return out


def test_adjacency_of_any_number_of_seeds(spark):
    """Five hundred seeds in one domain, domains that are all seeds, and few seeds."""
    r = random.Random(6)
    taxonomy = [(f"s{i:04d}", i, "big" if i < 620 else "full" if i < 660 else r.choice(["x", "y", None]), r.choice(["f1", "f2", None, ""]), r.sample(["p", "q", "r"], r.randrange(3)))
                for i in r.sample(range(900), 900)]
    table = spark.createDataFrame(taxonomy, "skill string, ord int, domain string, family string, parents array<string>")
    of = {"many": [f"s{i:04d}" for i in range(600, 100, -1)], "full": [f"s{i:04d}" for i in range(620, 660)], "few": ["s0700", "s0003"], "one": ["s0899"]}
    seeds = spark.createDataFrame([(k, n, s) for k, ss in of.items() for n, s in enumerate(ss)], "job_id string, pos int, skill string")
    for limit in (12, 40):
        got = on.adjacent_skills(seeds, table, "job_id", limit, "ord").collect()
        for k, ss in of.items():
            assert [(x.skill, x.evidence) for x in sorted((g for g in got if g.job_id == k), key=lambda g: g.n)] == adjacency_loop(ss, taxonomy, limit), k
