"""Fairness warnings over ranked matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.scoring import r4
from matchloom.functions.text import sensitive_terms, seniority_group
from matchloom.operators.ranking import top_k
from matchloom.session import materialize

# Fixed values -----------------------------------------------------------
LIMITS = {"culture_weight": 0.2, "must_have": 0.5, "culture_confidence": 0.7, "score_floor": 0.7, "min_results": 5, "concentration": 0.85}
# ------------------------------------------------------------------------
MESSAGES = {
    "sensitive_term_in_query": "The job text names a personal attribute; state what the work needs instead.",
    "sensitive_term_in_candidate_explanation": "The candidate's text names a personal attribute; check that the evidence is about the work.",
    "culture_weight_over_cap": "Culture weighs more than its limit; skills and technical evidence should lead.",
    "must_have_underfit_high_culture": "Ranked high on culture although must-haves are missing; check those first.",
    "seniority_concentration_topk": "The top results lean on one seniority band that the job did not ask for.",
}


def _warning(df: DataFrame, code: str, severity: str, candidate: Column, metrics: Column) -> DataFrame:
    return df.select("job_id", candidate.alias("candidate_id"), F.lit(code).alias("code"), F.lit(severity).alias("severity"),
                     F.lit(MESSAGES[code]).alias("message"), metrics.alias("metrics"))


def query_terms(jobs: DataFrame) -> DataFrame:
    """jobs: job_id, text."""
    hit = jobs.withColumn("_t", sensitive_terms(F.col("text"))).where(F.size("_t") > 0)
    return _warning(hit, "sensitive_term_in_query", "critical", F.lit(None).cast("string"), F.array_join("_t", ","))


def candidate_terms(matches: DataFrame) -> DataFrame:
    """matches: job_id, candidate_id, summary, explanation."""
    hit = matches.withColumn("_t", sensitive_terms(F.concat_ws(" ", "summary", "explanation"))).where(F.size("_t") > 0)
    return _warning(hit, "sensitive_term_in_candidate_explanation", "warning", F.col("candidate_id"), F.array_join("_t", ","))


def culture_weight(matches: DataFrame) -> DataFrame:
    hit = matches.where(F.col("culture_weight") > LIMITS["culture_weight"])
    return _warning(hit, "culture_weight_over_cap", "warning", F.col("candidate_id"), r4(F.col("culture_weight")).cast("string"))


def must_have_underfit(matches: DataFrame) -> DataFrame:
    hit = matches.where((F.col("must_have_rate") < LIMITS["must_have"]) & (F.col("culture_confidence") > LIMITS["culture_confidence"])
                        & (F.col("score") >= LIMITS["score_floor"]))
    return _warning(hit, "must_have_underfit_high_culture", "warning", F.col("candidate_id"), F.concat_ws(
        ",", r4(F.col("must_have_rate")).cast("string"), r4(F.col("culture_confidence")).cast("string"), r4(F.col("score")).cast("string")))


def row_codes(summary: Column, explanation: Column, culture_weight: Column, culture_confidence: Column, rate: Column, score: Column) -> Column:
    """Codes of all checks that look at one match alone, as an array in the order of the checks."""
    checks = {
        "sensitive_term_in_candidate_explanation": F.size(sensitive_terms(F.concat_ws(" ", summary, explanation))) > 0,
        "culture_weight_over_cap": culture_weight > LIMITS["culture_weight"],
        "must_have_underfit_high_culture": (rate < LIMITS["must_have"]) & (culture_confidence > LIMITS["culture_confidence"]) & (score >= LIMITS["score_floor"]),
    }
    return F.array_compact(F.array(*[F.when(hit, code) for code, hit in checks.items()]))


def seniority_concentration(matches: DataFrame, top: int = 10) -> DataFrame:
    """One row per job whose top results lean on one band; only without a stated seniority.

    matches: job_id, candidate_id, position, seniority_level, preferred_seniority.
    A job contributes at most ``top`` rows. Ties go to the band seen first.
    """
    head = matches.where((F.col("position") <= top) & F.col("preferred_seniority").isNull()).withColumn("band", seniority_group(F.col("seniority_level")))
    bands = head.groupBy("job_id", "band").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    per = bands.groupBy("job_id").agg(
        F.sum("n").alias("shown"), F.sum(F.when(F.col("band") != "unknown", F.col("n"))).alias("known"),
        F.max(F.when(F.col("band") != "unknown", F.struct("n", (-F.col("first")).alias("f"), "band"))).alias("d"))
    ratio = F.col("d.n") / F.nullif(F.col("known"), F.lit(0))
    hit = per.where((F.col("shown") >= max(2, LIMITS["min_results"])) & (ratio >= LIMITS["concentration"]))
    return _warning(hit, "seniority_concentration_topk", "warning", F.lit(None).cast("string"), F.concat_ws(
        ",", "d.band", r4(ratio).cast("string"), F.col("shown").cast("string")))


def row_warnings(matches: DataFrame) -> DataFrame:
    """The warnings of all checks that look at one match alone, from one pass over the matches."""
    terms = sensitive_terms(F.concat_ws(" ", "summary", "explanation"))
    c = F.col
    underfit = (c("must_have_rate") < LIMITS["must_have"]) & (c("culture_confidence") > LIMITS["culture_confidence"]) & (c("score") >= LIMITS["score_floor"])
    checks = {
        "sensitive_term_in_candidate_explanation": (F.size("_t") > 0, F.array_join("_t", ",")),
        "culture_weight_over_cap": (c("culture_weight") > LIMITS["culture_weight"], r4(c("culture_weight")).cast("string")),
        "must_have_underfit_high_culture": (underfit, F.concat_ws(",", *[r4(c(n)).cast("string") for n in ("must_have_rate", "culture_confidence", "score")])),
    }
    told = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(code).alias("code"), F.lit(MESSAGES[code]).alias("message"), metrics.alias("metrics")))
                                     for code, (hit, metrics) in checks.items()]))
    rows = matches.withColumn("_t", terms).select("job_id", "candidate_id", F.explode(told).alias("w"))
    return rows.select("job_id", "candidate_id", "w.code", F.lit("warning").alias("severity"), "w.message", "w.metrics")


def audit(jobs: DataFrame, matches: DataFrame, top: int = 10) -> DataFrame:
    """All warnings of a ranked run as rows. The matches are written once and read by both kinds of checks."""
    m = materialize(matches, "audit-matches")
    return query_terms(jobs).unionByName(row_warnings(m)).unionByName(seniority_concentration(m, top))


def messages_per_candidate(warnings: DataFrame) -> DataFrame:
    """Distinct messages of each (job, candidate); at most one per check."""
    return warnings.where("candidate_id is not null").groupBy("job_id", "candidate_id").agg(
        F.array_sort(F.collect_set("code")).alias("codes"))


def ranked(matches: DataFrame, k: int) -> DataFrame:
    return top_k(matches, ["job_id"], [F.desc("score"), F.asc("candidate_id")], k, "position")
