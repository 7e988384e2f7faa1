"""Queries over the fairness checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.operators import fairness as fr
from matchloom.plans import duck as d
from matchloom.plans.registry import query

_TERMS = f"regexp_extract_all(lower(x), {d.q(tx.SENSITIVE_RE)}, 1)"
CT = {
    "g_match": """SELECT p.job_id, p.candidate_id, raw_score * 2 AS score, summary, 'Handled ' || array_to_string(skills, ', ') || ' well' AS explanation, CASE WHEN right(p.job_id, 1) IN ('3', '5', '8') AND right(p.candidate_id, 1) <> '7' THEN 'senior' ELSE seniority_level END AS seniority_level, CASE WHEN right(p.job_id, 1) <> '3' THEN preferred_seniority END AS preferred_seniority,
 (n_applications * 7 + length(p.candidate_id)) % 10 / 20.0::DOUBLE AS culture_weight, experience_years / 10.0 AS culture_confidence, len(list_intersect(required_skills, skills)) / len(required_skills) AS must_have_rate FROM pair_doc p""",
    "g_rank": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, candidate_id) AS position FROM g_match) WHERE position <= 10",
    "g_q": f"SELECT job_id, CAST(NULL AS VARCHAR) AS candidate_id, 'sensitive_term_in_query' AS code, 'critical' AS severity, array_to_string(list_filter(h, lambda t, i: list_position(h, t) = i), ',') AS metrics FROM (SELECT job_id, {_TERMS.replace('x)', 'text)')} AS h FROM job_text) WHERE len(h) > 0",
    "g_c": f"SELECT job_id, candidate_id, 'sensitive_term_in_candidate_explanation' AS code, 'warning' AS severity, array_to_string(list_filter(h, lambda t, i: list_position(h, t) = i), ',') AS metrics FROM (SELECT job_id, candidate_id, {_TERMS} AS h FROM (SELECT job_id, candidate_id, concat_ws(' ', summary, explanation) AS x FROM g_rank)) WHERE len(h) > 0",
    "g_w": "SELECT job_id, candidate_id, 'culture_weight_over_cap' AS code, 'warning' AS severity, CAST(round(culture_weight, 4) AS VARCHAR) AS metrics FROM g_rank WHERE culture_weight > 0.2",
    "g_u": "SELECT job_id, candidate_id, 'must_have_underfit_high_culture' AS code, 'warning' AS severity, round(must_have_rate, 4) || ',' || round(culture_confidence, 4) || ',' || round(score, 4) AS metrics FROM g_rank WHERE must_have_rate < 0.5 AND culture_confidence > 0.7 AND score >= 0.7",
    "g_s": """SELECT job_id, CAST(NULL AS VARCHAR) AS candidate_id, 'seniority_concentration_topk' AS code, 'warning' AS severity, band || ',' || round(n / known, 4) || ',' || shown AS metrics FROM (
 SELECT *, sum(n) OVER (PARTITION BY job_id) AS shown, sum(CASE WHEN band <> 'unknown' THEN n END) OVER (PARTITION BY job_id) AS known, row_number() OVER (PARTITION BY job_id ORDER BY band = 'unknown', n DESC, f) AS rn FROM (
  SELECT job_id, coalesce(seniority_level, 'unknown') AS band, count(*) AS n, min(position) AS f FROM g_rank WHERE preferred_seniority IS NULL GROUP BY 1, 2)) WHERE rn = 1 AND band <> 'unknown' AND shown >= 5 AND n / known >= {limit}""",
}
CT["g_s"] = CT["g_s"].replace("{limit}", "0.85")
COLS = ["job_id", "candidate_id", "code", "severity", "metrics"]


def matches(i):
    m = i.pair_doc().select(
        "job_id", "candidate_id", (F.col("raw_score") * 2).alias("score"), "summary",
        F.concat(F.lit("Handled "), F.array_join("skills", ", "), F.lit(" well")).alias("explanation"),
        # jobs whose applicants are nearly all of one band, beside mixed ones
        F.when(F.right("job_id", F.lit(1)).isin("3", "5", "8") & (F.right("candidate_id", F.lit(1)) != "7"), "senior").otherwise(F.col("seniority_level")).alias("seniority_level"),
        F.when(F.right("job_id", F.lit(1)) != "3", F.col("preferred_seniority")).alias("preferred_seniority"),
        ((F.col("n_applications") * 7 + F.length("candidate_id")) % 10 / 20.0).alias("culture_weight"), (F.col("experience_years") / 10.0).alias("culture_confidence"),
        (F.size(F.array_intersect("required_skills", "skills")) / F.size("required_skills")).alias("must_have_rate"))
    return fr.ranked(m, 10)


@query("g02_sensitive_query", f"SELECT {', '.join(COLS)} FROM g_q", CT)
def _(i):
    return fr.query_terms(i.job_text()).select(COLS)


@query("g03_sensitive_candidate", f"SELECT {', '.join(COLS)} FROM g_c", CT)
def _(i):
    return fr.candidate_terms(matches(i)).select(COLS)


@query("g04_culture_weight_cap", f"SELECT {', '.join(COLS)} FROM g_w", CT)
def _(i):
    return fr.culture_weight(matches(i)).select(COLS)


@query("g05_must_have_underfit", f"SELECT {', '.join(COLS)} FROM g_u", CT)
def _(i):
    return fr.must_have_underfit(matches(i)).select(COLS)


@query("g06_seniority_concentration", f"SELECT {', '.join(COLS)} FROM g_s", {**CT, "g_rank": CT["g_rank"].replace("<= 10", "<= 5")})
def _(i):
    return fr.seniority_concentration(matches(i), 5).select(COLS)


@query("g07_audit", " UNION ALL ".join(f"SELECT {', '.join(COLS)} FROM {t}" for t in ("g_q", "g_c", "g_w", "g_u", "g_s")), CT)
def _(i):
    return fr.audit(i.job_text(), matches(i)).select(COLS)


@query("g07b_messages_per_candidate", "SELECT job_id, candidate_id, string_agg(DISTINCT code, '|' ORDER BY code) AS codes FROM (SELECT * FROM g_c UNION ALL SELECT * FROM g_w UNION ALL SELECT * FROM g_u) GROUP BY 1, 2", CT)
def _(i):
    return fr.messages_per_candidate(fr.audit(i.job_text(), matches(i))).select("job_id", "candidate_id", F.array_join("codes", "|").alias("codes"))
