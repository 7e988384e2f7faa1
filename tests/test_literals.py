"""Literal cases: exact values that any implementation must give."""

import re

import pytest
from pyspark.sql import functions as F

from matchloom.functions import dates as dt
from matchloom.functions import jobtext as jt
from matchloom.functions import resume as rs
from matchloom.functions import scoring as sc
from matchloom.functions import text as tx
from matchloom.operators import evaluation as ev
from matchloom.operators import experience as ex
from matchloom.operators import facets as fa
from matchloom.operators import fairness as fr
from matchloom.operators import matching as ma
from matchloom.operators.ranking import exact_percentiles


def A(*xs):  # noqa: N802
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")



def test_normalize_token(one):
    assert one(tx.normalize_token(F.lit("  Data-Science__Lead "))) == "data science lead"


def test_clean_text_unicode_space_and_null_words(one):
    assert one(tx.clean_text(F.lit(" a  b\n"))) == "a b"
    assert one(tx.clean_text(F.lit(" N/A "))) is None


def test_identifier(one):
    assert one(tx.normalize_identifier(F.lit(7.0), "p", floating=True)) == "p-7"
    assert one(tx.normalize_identifier(F.lit(None).cast("string"), "p")) == "p-unknown"


@pytest.mark.parametrize("raw,want", [
    ("00/1999", "1999-01"), ("1999/7", "1999-07"), ("since Winter 2001", "2001-12"), ("(Sept 2010)", "2010-09"), ("Current", "present"), ("00/0000", None),
    ("13/1999", "1999-01"), ("1850", None), ("5/yy", None), ("about 2099 or so", "2099-01"), ("2005-3", "2005-03")])
def test_normalize_month(one, raw, want):
    assert one(dt.normalize_month(F.lit(raw))) == want


def test_region_alias_inside_words_is_replaced(one):
    assert one(tx.normalize_region(F.lit("Austin_US"))) == "aunited statestin united states"


def test_sanitize_drops_noise(one):
    got = one(tx.sanitize_skills(A("Python", "Machine Learning", "Company Name - City, State", "Professional Experience", "03/2001 - 04/2002",
                                   "Managed a dozen bakers and kept their ovens within budget all year")))
    assert got == ["python", "machine learning"]


def test_years_from_text_priority(one):
    assert one(tx.years_from_text(F.lit("3 years here, 5+ years there, over 99 years, over 7 yrs"))) == 7.0
    assert one(tx.years_from_text(F.lit("0 years"))) is None


def test_abilities(one):
    got = one(rs.abilities(F.lit("Baker who presented plans to every stakeholder and ran cross-functional groups."),
                           A("Trained apprentices at the oven."), F.lit("")))
    assert {"stakeholder communication", "cross-functional collaboration", "training and mentoring"} <= set(got)
    assert one(rs.abilities(F.lit(None).cast("string"), A(), F.lit("Ability to knead forty loaves before sunrise."))) != []


def parse(spark, text):
    return ex.parse_resumes(spark.createDataFrame([(text,)], "text string")).first()


def test_full_width_dash_range(spark):
    r = parse(spark, "Experience Head Baker , 03/2001 － 04/2002 Company Name － City , State Kneaded dough and fed the sourdough.")
    assert (r.experience[0].start_date, r.experience[0].end_date) == ("03/2001", "04/2002")


def test_single_date_experience(spark):
    r = parse(spark, "Summary Early riser. Experience 05/2011 Pastry Cook Company Name － City , State Glazed tarts. "
                     "05/2010 Miller Company Name － City , State Education and Training 2009 Milling and Grain Science.")
    assert any(e.start_date == "05/2011" for e in r.experience)


def test_institution_and_highlights(spark):
    r = parse(spark, "Education and Training Harbour Lane University － City , State Guild of Bakers. Skills milling, baking.")
    assert any("university" in (e.institution or "").lower() for e in r.education)
    r = parse(spark, "Professional Summary Bakes and codes. Highlights Python, SQL, baking, milling.")
    assert {"python", "sql"} & {s.lower() for s in r.skills}


def test_single_date_scan_equals_regex(spark):
    texts = ["Senior Analyst, Beta Group 2000 / Summer 2001 Planned roadmap. Education PhD 1993 at Delta", "A 1999", "x, May 2001 yy 03/2004 Skills Tester Skills"]
    d = rs.DATE
    single = re.compile(rf"({d})\s+([A-Za-z][A-Za-z0-9/&().,'\- ]{{2,80}}?)(?=\s+(?:Company Name|City|State|Education|Skills|Highlights|$))", re.I)
    before = re.compile(rf"([A-Za-z][A-Za-z0-9/&().,'\- ]{{2,80}}?)\s*,?\s*({d})(?!\s*(?:to|-|–|—|－))", re.I)
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", rs.experience_scan(F.col("text")).alias("r")).collect()
    for row in rows:
        want = [(m[2].strip(), m[1]) for m in single.finditer(row.text)]
        want += [(m[1].strip(), m[2]) for m in before.finditer(row.text) if not m[1].strip().lower().endswith(("education", "skills", "summary", "highlights"))]
        seen, out = set(), []
        for w in want:
            if (k := (w[0].lower(), w[1].lower())) not in seen:
                seen.add(k)
                out.append(w)
        assert [(e.title, e.start_date) for e in row.r] == out


def test_qualifications_header_means_skills(one):
    assert one(rs.header_of(F.lit("Qualifications:"))) == "skills"
    assert one(rs.header_of(F.lit("Education and Training"))) == "education"


def test_keyword_overlap_and_fusion(one):
    assert one(sc.keyword_score(A("python", "sql", "airflow"), A("python", "airflow", "spark"))) == 0.6667
    assert one(sc.fusion(F.lit(1.0), F.lit(0.0), F.lit(0.0), {"vector": 0.55, "keyword": 0.30, "metadata": 0.15})) == 0.55


def test_metadata_score(one):
    got = one(sc.metadata_score(F.lit("Data"), F.lit(None).cast("string"), F.lit(5.0), F.lit("senior"), F.lit("Data"), F.lit(6.0), F.lit("senior")))
    assert got == 1.0


def test_experience_fit(one):
    assert one(sc.experience_fit(F.lit(12.0), F.lit(4.0))) == 0.85
    assert one(sc.experience_fit(F.lit(None).cast("double"), F.lit(4.0))) == 0.0


def test_must_have_penalty(one):
    assert one(sc.must_have(A("communication"), A("stakeholder management"), F.lit(0.0))["penalty"]) == 0.12
    assert one(sc.must_have(A("communication"), A("stakeholder management"), F.lit(1.0))["penalty"]) == 0.06
    assert one(sc.must_have(A(), A("x"), F.lit(0.0))["rate"]) == 1.0


def test_soft_overlap_partial_credit(one):
    o = one(sc.skill_overlap(A("sales support"), A("sales support", "customer service"), A("sales", "customer service"), A("b2b sales support"), A("b2b sales support", "client management")))
    assert o["score"] > 0.25 and o["normalized_overlap"] > 0.3
    o = one(sc.skill_overlap(A("marketing"), A("marketing", "branding"), A("marketing"), A("b2b sales support"), A("client management")))
    assert o["score"] < 0.05 and o["normalized_overlap"] == 0.0


def test_two_digit_ties_follow_the_binary_value(one):
    for x in (0.125, 0.165, 0.145, 0.135, 0.375, 2.675, 1.005, 0.5, 0.8449999):
        assert one(F.format_string("%.2f", sc.two_digits(F.lit(x)))) == f"{x:.2f}"


def test_grades(one):
    assert [one(sc.grade_for(F.lit(o), F.lit(r))) for o, r in ((0.8, 0), (0.55, 2), (0.2, 1))] == [3, 2, 1]


def test_select_for_evaluation(spark):
    rows = spark.createDataFrame([("j", "a", 0.1), ("j", "b", 0.9), ("j", "c", 0.5)], "job_id string, candidate_id string, score double")
    assert [r.candidate_id for r in ma.select_for_evaluation(rows, 2).orderBy("eval_rank").collect()] == ["b", "c"]


@pytest.mark.parametrize("scores,confidence,unknown,coverage,want", [
    ((0.52, 0.51), 0.9, 0.0, 1.0, "strong_top_hit_without_query_ambiguity"), ((0.505, 0.5), 0.5, 0.7, 0.0, "tight_top_scores_and_ambiguous_query"),
    ((0.6, 0.5), 0.5, 0.7, 0.0, "top_gap_too_wide_for_safe_rerank"), ((0.3, 0.3), 0.9, 0.0, 1.0, "tight_top_scores_but_query_is_confident"),
    ((0.5, 0.5), 0.5, 0.7, 0.9, "ambiguous_query_but_top_hit_skill_overlap_is_strong"), ((0.5,), 0.5, 0.7, 0.9, "insufficient_candidates")])
def test_rerank_gate(spark, scores, confidence, unknown, coverage, want):
    hits = spark.createDataFrame([("j", f"c{i}", i + 1, s) for i, s in enumerate(scores)], "job_id string, candidate_id string, rank int, fusion_score double")
    q = spark.createDataFrame([("j", confidence, unknown)], "job_id string, confidence double, unknown_ratio double")
    cov = spark.createDataFrame([("j", "c0", coverage)], "job_id string, candidate_id string, coverage double")
    assert ma.rerank_gate(hits, q, cov).first()["reason"] == want


def test_interval_union(spark):
    items = spark.createDataFrame([("c", 0, 5), ("c", 3, 4), ("c", 6, 9), ("c", 20, 21), ("c", 30, 29)], "candidate_id string, start_idx long, end_idx long")
    r = ex.experience_years(items, 100).first()
    assert (r.months, r.years) == (12, 1.0)


def test_percentile(spark):
    v = spark.createDataFrame([("k", float(x)) for x in (1, 2, 4, 10)], "k string, v double")
    assert exact_percentiles(v, ["k"], "v", {"p": 0.95}).first()["p"] == 9.1


def test_seniority_concentration(spark):
    rows = [("j", f"c{i}", i + 1, "Senior" if i < 6 else None, None) for i in range(7)] + [("k", f"c{i}", i + 1, "senior", "lead") for i in range(7)]
    m = spark.createDataFrame(rows, "job_id string, candidate_id string, position int, seniority_level string, preferred_seniority string")
    got = fr.seniority_concentration(m, 10).collect()
    assert [(r.job_id, r.metrics) for r in got] == [("j", "senior,1.0,7")]


def test_filter_options():
    o = fa.filter_options()
    assert o["industries"] == ["E-commerce", "Finance", "Healthcare", "Manufacturing", "Technology"] and "Data Engineering" in o["job_families"]


def test_ndcg_by_hand(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, candidate_id string, rnk int")
    rel = spark.createDataFrame([("q", "b", 3), ("q", "z", 1)], "query_id string, candidate_id string, grade int")
    import math
    want = round((7 / math.log2(3)) / (7 + 1 / math.log2(3)), 4)
    r = ev.retrieval_metrics(ranked, rel).first()
    assert (r.recall, r.mrr, r.ndcg, r.first_rank) == (0.5, 0.5, want, 2)


# -- job descriptions -----------------------------------------------------
def profile(spark, text):
    return jt.profile(spark.createDataFrame([("j", text)], "job_id string, text string")).first()


def test_profile_compresses_long_lists(spark):
    names = [f"skill{i}" for i in range(1, 41)]
    p = profile(spark, "The bakery seeks a backend engineer. Must have " + ", ".join(names)
                + ". Responsibilities: weighing reliability, cost and flour.")
    assert len(p.required_skills) <= 18 and len(p.related_skills) <= 12
    assert not {"responsibilities", "cost", "nice"} & set(p.required_skills)
    assert sum(bool(re.search(rf"\b{n}\b", p.query_text)) for n in names) <= 20


def test_seniority_needs_a_whole_word(spark):
    assert profile(spark, "Backend work on the internal ordering of flour.").preferred_seniority is None


def test_junior_profile(spark):
    p = profile(spark, "A bakery wants a junior software engineer. Must have Python, Java and Git for the oven clock. Nice to have unit testing basics.")
    assert "junior software engineer" in p.roles
    assert {"python", "java", "git"} <= set(p.required_skills) and {"data structures", "unit testing"} <= set(p.related_skills)


def test_architect_profile(spark):
    p = profile(spark, "A mill wants a senior architect for its ovens. Must have distributed systems, cloud architecture, security by design.")
    assert "senior architect" in p.roles
    assert {"system architecture", "distributed systems", "cloud architecture", "technical leadership", "security by design"} & set(p.required_skills)
    names = [f"skill{i}" for i in range(1, 41)]
    p = profile(spark, "A mill wants a senior architect. Must have " + ", ".join(names))
    assert 20 < sum(bool(re.search(rf"\b{n}\b", p.query_text)) for n in names) <= 28


def test_analyst_profile(spark):
    p = profile(spark, "A mill wants a business analyst. The main focus is the client, support and change. "
                       "Must have stakeholder management, SQL, reporting. Nice to have process mapping.")
    assert "business analyst" in p.roles and {"stakeholder management", "sql"} <= set(p.required_skills)
    assert {"requirements gathering", "process mapping"} <= set(p.related_skills) and "reporting" in {*p.required_skills, *p.related_skills}
    assert not {"role", "main", "focus", "client", "change", "support", "consulting"} & set(p.required_skills)


def test_signals_keep_the_strongest_first(one):
    sig = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("strength"), F.lit("skill").alias("kind")) for n, s in
                    (("SQL", "familiarity"), ("go", "must have"), ("sql", "main focus"), ("Sql", "main focus"))])
    assert [(e.name, e.strength) for e in one(jt.dedupe_signals(sig))] == [("sql", "main focus"), ("go", "must have")]


def test_fallback_gate(one):
    assert one(jt.fallback_reason(F.lit(0.5), F.lit(0.9))) == "low_confidence"
    assert one(jt.fallback_reason(F.lit(0.7), F.lit(0.9))) == "high_unknown_ratio"
    assert one(jt.fallback_reason(F.lit(0.7), F.lit(0.1))) is None
