"""Offline evaluation of ranked runs against a golden set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.scoring import r4, rnd
from matchloom.operators.ranking import exact_percentiles, top_k


def mean4(c: Column) -> Column:
    """Mean of four-decimal values, summed as integers so that task order cannot change the last digit."""
    return F.round(F.sum(F.round(c * 10000).cast("long")) / F.count(c)) / 10000


def retrieval_metrics(ranked: DataFrame, relevance: DataFrame, k_recall: int = 10, k_ndcg: int = 5) -> DataFrame:
    """Per query: recall@k, MRR, NDCG@k, first relevant rank and top-1 hit.

    ranked: query_id, candidate_id, rnk (the top of the list only); relevance:
    query_id, candidate_id, grade. The join is on both keys; everything after
    it is a combinable sum or min per query.
    """
    hits = ranked.join(relevance, ["query_id", "candidate_id"])
    gain = (F.pow(F.lit(2.0), F.greatest("grade", F.lit(0))) - 1) / F.log2(F.col("rnk") + 1)
    got = hits.groupBy("query_id").agg(
        F.count(F.when(F.col("rnk") <= k_recall, 1)).alias("found"), F.min("rnk").alias("first_rank"),
        F.sum(F.when(F.col("rnk") <= k_ndcg, gain)).alias("dcg"))
    ideal = top_k(relevance, ["query_id"], [F.desc("grade"), F.asc("candidate_id")], k_ndcg, "rnk").groupBy("query_id").agg(F.sum(gain).alias("idcg"))
    expected = relevance.groupBy("query_id").agg(F.count("*").alias("n"))
    j = expected.join(ideal, "query_id").join(got, "query_id", "left")
    return j.select(
        "query_id", r4(F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"), r4(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr"),
        r4(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0)).alias("ndcg"),
        "first_rank", F.coalesce(F.col("first_rank") == 1, F.lit(False)).alias("top1"))


def top1_improvement(expected: DataFrame, baseline: DataFrame, reranked: DataFrame) -> DataFrame:
    def hit(run, name):
        first = run.where("rnk = 1").select("query_id", "candidate_id").join(expected.select("query_id", "candidate_id"), ["query_id", "candidate_id"], "left_semi")
        return first.select("query_id", F.lit(1).alias(name))

    q = expected.select("query_id").distinct()
    return q.join(hit(baseline, "b"), "query_id", "left").join(hit(reranked, "r"), "query_id", "left").select(
        "query_id", (F.coalesce("r", F.lit(0)) - F.coalesce("b", F.lit(0))).cast("long").alias("improvement"))


def must_have_coverage(expected: DataFrame, ranked: DataFrame, candidate_skills: DataFrame, k: int = 10, key: str = "query_id") -> DataFrame:
    """Share of expected skills any top-k candidate has. All inputs in long form."""
    shown = ranked.where(F.col("rnk") <= k).select(key, "candidate_id").join(candidate_skills, "candidate_id").select(key, "skill").distinct()
    e = expected.select(key, "skill").distinct()
    hit = e.join(shown.withColumn("_h", F.lit(1)), [key, "skill"], "left")
    return hit.groupBy(key).agg(r4(F.count("_h") / F.count("*")).alias("coverage"))


def understanding_alignment(rows: DataFrame) -> DataFrame:
    """rows: query_id, expected_role, expected_skills, roles, skills, unknown_ratio, fallback_used."""
    from matchloom.functions.scoring import lower_set, share
    exp = lower_set(F.col("expected_skills"))
    role = F.lower(F.trim(F.coalesce("expected_role", F.lit(""))))
    return rows.select(
        "query_id", F.when((role != "") & F.array_contains(lower_set(F.col("roles")), role), 1.0).otherwise(0.0).alias("role_accuracy"),
        r4(share(F.array_intersect(exp, lower_set(F.col("skills"))), exp)).alias("skill_accuracy"),
        r4(F.coalesce("unknown_ratio", F.lit(1.0))).alias("unknown_ratio"), F.when(F.col("fallback_used"), 1.0).otherwise(0.0).alias("fallback_rate"))


def latency_summary(rows: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """p50 / p95 / p99 / mean of max(0, ms) per key, exact."""
    v = rows.withColumn("_ms", F.greatest(F.col(ms), F.lit(0.0)))
    ps = exact_percentiles(v, keys, "_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    return ps.join(v.groupBy(*keys).agg(r4(F.avg("_ms")).alias("mean_ms")), keys)


def agreement(predicted: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Share of common keys with equal booleans; one row, null without common keys."""
    j = predicted.select(*keys, F.col("value").alias("_p")).join(reference.select(*keys, F.col("value").alias("_r")), keys)
    return j.agg(r4(F.avg((F.col("_p") == F.col("_r")).cast("double"))).alias("agreement"), F.count("*").alias("common"))


def reliability(rows: DataFrame) -> DataFrame:
    """rows: one per query with booleans fallback, timeout, error, degraded."""
    n = F.greatest(F.count("*"), F.lit(1))
    return rows.agg(*[r4(F.count_if(F.col(c)) / n).alias(f"{c}_rate") for c in ("fallback", "timeout", "error", "degraded")], F.count("*").alias("queries"))


def rerank_gate_state(runs: DataFrame) -> DataFrame:
    """Per config: whether re-ranking runs next time, from the newest run's MRR delta."""
    last = runs.groupBy("config").agg(F.max(F.struct("run_ts", "run_id", "mrr_delta", "enabled")).alias("l"))
    bypass = F.col("l.enabled") & F.coalesce(F.col("l.mrr_delta") < 0, F.lit(False))
    return last.select("config", (F.col("l.enabled") & ~bypass).alias("enabled_next"),
                       F.when(bypass, "auto_bypass_previous_negative_mrr_delta").when(F.col("l.enabled"), "enabled").otherwise("disabled_by_config").alias("reason"),
                       F.col("l.run_id").alias("last_run_id"), r4(F.col("l.mrr_delta")).alias("last_mrr_delta"))


def top2_gap(ranked: DataFrame) -> DataFrame:
    return ranked.where("rnk <= 2").groupBy("query_id").agg(
        rnd(F.max(F.when(F.col("rnk") == 1, F.col("score"))) - F.max(F.when(F.col("rnk") == 2, F.col("score"))), 6).alias("top2_gap"))


def capped_per_family(rows: DataFrame, order: list[Column], limit: int, cap: int) -> DataFrame:
    """First ``limit`` rows in order, at most ``cap`` per family."""
    inside = top_k(rows, ["family"], order, cap, "_in_family")
    return inside.orderBy(*order).limit(limit).drop("_in_family")


def select_hybrid(rows: DataFrame, limit: int, cap: int) -> DataFrame:
    hard = rows.where((F.col("recall") < 1.0) | (F.col("coverage") < 0.6) | (F.col("first_rank") > 3) | (F.col("stage") != "hybrid"))
    return capped_per_family(hard, [F.asc("recall"), F.asc("mrr"), F.coalesce("first_rank", F.lit(999)).asc(), F.asc("query_id")], limit, cap)


def select_rerank(rows: DataFrame, limit: int, cap: int) -> DataFrame:
    hard = rows.where((F.col("first_rank") <= 10) & (~F.col("top1") | (F.col("ndcg") < 1.0)) & (F.col("top2_gap").isNull() | (F.col("top2_gap") <= 0.03)))
    return capped_per_family(hard, [F.coalesce("top2_gap", F.lit(999.0)).asc(), F.asc("ndcg"), F.coalesce("first_rank", F.lit(999)).asc(), F.asc("query_id")], limit, cap)


def select_agent(rows: DataFrame, limit: int, cap: int) -> DataFrame:
    """Strict rows first, then relaxed ones, under one family cap.

    A strict row always outranks a relaxed one inside its family, so a single
    capped ranking with the pass number in front gives the two-pass answer.
    """
    enough = (F.col("recall") >= 0.6) & (F.col("coverage") >= 0.6)
    strict = F.col("top1") & (F.col("first_rank") == 1) & enough & (F.col("ndcg") >= 0.6)
    relaxed = (F.col("first_rank") <= 2) & enough
    tagged = rows.withColumn("pass", F.when(F.coalesce(strict, F.lit(False)), 0).when(F.coalesce(relaxed, F.lit(False)), 1)).where("pass is not null")
    order = [F.asc("pass"), F.desc("recall"), F.desc("ndcg"), F.coalesce("first_rank", F.lit(999)).asc(), F.asc("query_id")]
    return capped_per_family(tagged, order, limit, cap)


def candidate_evidence(pairs: DataFrame) -> DataFrame:
    """pairs: job_id, candidate_id, rank (0-based), fusion_score, required, optional, observed (arrays)."""
    from matchloom.functions.scoring import share
    req, opt = F.array_intersect("required", "observed"), F.array_intersect("optional", "observed")
    j = pairs.select("*", r4(share(req, F.col("required"))).alias("required_overlap"), r4(share(opt, F.col("optional"))).alias("optional_overlap"),
                     F.array_sort(req).alias("matched_required"), F.array_sort(opt).alias("matched_optional"))
    return j.withColumn("quality", r4(F.col("required_overlap") * 0.8 + F.col("optional_overlap") * 0.15 + F.coalesce("fusion_score", F.lit(0.0)) * 0.05))


def golden_selection(evidence: DataFrame, max_golden: int = 5, strong: float = 0.5, relaxed: float = 0.35, quality: float = 0.3) -> DataFrame:
    ok = (F.col("required_overlap") >= strong) | (
        (F.col("required_overlap") >= relaxed) & (F.col("quality") >= quality) & ((F.size("matched_required") >= 1) | (F.size("matched_optional") >= 1)))
    order = [F.desc("quality"), F.desc("required_overlap"), F.desc("optional_overlap"), F.desc("fusion_score"), F.asc("rank"), F.asc("candidate_id")]
    return top_k(evidence.where(ok), ["job_id"], order, max_golden, "place").withColumn("place", F.col("place") - 1)


def regenerate_golden(queries: DataFrame, selected: DataFrame, min_candidates: int) -> DataFrame:
    """Per query the chosen ids with grades, or a soft row when there are too few."""
    from matchloom.functions.scoring import grade_for
    item = F.struct("place", F.concat("candidate_id", F.lit(":"), grade_for(F.col("required_overlap"), F.col("place")).cast("string")).alias("v"))
    per = selected.groupBy("job_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))  # max_golden rows per query
    j = queries.join(per, "job_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    soft = F.col("n") < min_candidates
    return j.select("job_id", "n", soft.alias("soft_golden"), F.when(soft, "").otherwise(F.array_join(F.transform("items", lambda e: e["v"]), "|")).alias("relevant"))


def vocabulary_audit(expected: DataFrame, taxonomy: DataFrame, alias_map: DataFrame) -> DataFrame:
    """expected: one column token. Distinct terms, mapped and unmapped counts, ratio."""
    known = taxonomy.select(F.col("skill").alias("name")).unionByName(alias_map.select(F.col("alias").alias("name"))).unionByName(alias_map.select(F.col("canonical").alias("name"))).distinct()
    terms = expected.select("token").distinct().join(alias_map.withColumnRenamed("alias", "token"), "token", "left").select("token", F.coalesce("canonical", "token").alias("name"))
    j = terms.join(known.withColumn("_k", F.lit(1)), "name", "left")
    return j.agg(F.count("*").alias("unique_expected"), F.count("_k").alias("mapped"), F.count_distinct(F.when(F.col("_k") == 1, F.col("name"))).alias("mapped_canonical"),
                 F.count_if(F.col("_k").isNull()).alias("unmapped"), r4(F.count("_k") / F.greatest(F.count("*"), F.lit(1))).alias("mapped_ratio"))


def align_vocabulary(expected: DataFrame, taxonomy: DataFrame, alias_map: DataFrame, drop_unknown: bool) -> DataFrame:
    """(job_id, pos, skill, known): canonical names, unknown ones flagged or dropped."""
    known = taxonomy.select("skill").unionByName(alias_map.select(F.col("canonical").alias("skill"))).distinct().withColumn("known", F.lit(True))
    c = expected.join(alias_map.withColumnRenamed("alias", "token"), "token", "left").select("job_id", "pos", F.coalesce("canonical", "token").alias("skill"))
    first = c.groupBy("job_id", "skill").agg(F.min("pos").alias("pos"))
    out = first.join(known, "skill", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return out.where("known") if drop_unknown else out


def family_diversity(rows: DataFrame, family: str) -> DataFrame:
    """Counts, share and (normalised) entropy of a label column."""
    per = rows.groupBy(family).agg(F.count("*").alias("n"))
    tot = per.agg(F.sum("n").alias("total"), F.count("*").alias("families"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    h = F.log2("total") - F.col("nlogn") / F.col("total")
    return tot.select("total", "families", r4(h).alias("entropy"), r4(F.when(F.col("families") > 1, h / F.log2("families")).otherwise(0.0)).alias("normalized_entropy"))
