"""Queries over offline evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import scoring as sc
from matchloom.functions import text as tx
from matchloom.operators import evaluation as ev
from matchloom.operators.ranking import exact_percentiles, top_k
from matchloom.plans import duck as d
from matchloom.plans.inputs import query_id
from matchloom.plans.registry import query


def metric_sql(k: int = 10) -> str:
    gain = "(pow(2, grade) - 1) / log2(rnk + 1)"
    return f"""SELECT e.query_id, round(coalesce(found, 0) / n, 4) AS recall, round(coalesce(1.0 / first_rank, 0.0), 4)::DOUBLE AS mrr, round(CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END, 4) AS ndcg, first_rank, coalesce(first_rank = 1, false) AS top1
 FROM (SELECT query_id, count(*) AS n FROM relevance GROUP BY 1) e JOIN (SELECT query_id, sum({gain}) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, candidate_id) AS rnk FROM relevance) WHERE rnk <= 5 GROUP BY 1) i USING (query_id)
 LEFT JOIN (SELECT query_id, count(*) FILTER (rnk <= {k}) AS found, min(rnk) AS first_rank, sum(CASE WHEN rnk <= 5 THEN {gain} END) AS dcg FROM ranked JOIN relevance USING (query_id, candidate_id) GROUP BY 1) g USING (query_id)"""


CT = {
    "e_base": metric_sql(10), "e_20": metric_sql(20), "e_rr": metric_sql(10).replace("FROM ranked", "FROM reranked"),
    "e_cov": """SELECT query_id, round(count(h) / count(*), 4) AS coverage FROM (SELECT DISTINCT query_id, source AS skill FROM relevance r JOIN documents ON 'doc-' || doc_id = r.candidate_id) x
 LEFT JOIN (SELECT DISTINCT query_id, source AS skill, 1 AS h FROM ranked r JOIN documents ON 'doc-' || doc_id = r.candidate_id WHERE rnk <= 10) y USING (query_id, skill) GROUP BY 1""",
    "e_gap": "SELECT query_id, round(max(score) FILTER (rnk = 1) - max(score) FILTER (rnk = 2), 6) AS top2_gap FROM ranked WHERE rnk <= 2 GROUP BY 1",
    "e_diag": """SELECT b.*, coverage, top2_gap, 'fam-' || (CAST(substring(query_id, 3) AS BIGINT) % 6) AS family, CASE WHEN CAST(substring(query_id, 3) AS BIGINT) % 9 = 0 THEN 'keyword_only' ELSE 'hybrid' END AS stage
 FROM e_base b LEFT JOIN e_cov USING (query_id) LEFT JOIN e_gap USING (query_id)""",
}


def sources(i):
    return i.base("documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("candidate_id"), F.col("source").alias("skill"))


def diagnostics(i):
    m = ev.retrieval_metrics(i.ranked(), i.relevance())
    expected = i.relevance().join(sources(i), "candidate_id").select("query_id", "skill")
    cov = ev.must_have_coverage(expected, i.ranked(), sources(i))
    n = F.substring("query_id", 3, 20).cast("long")
    return m.join(cov, "query_id", "left").join(ev.top2_gap(i.ranked()), "query_id", "left").select(
        "*", F.concat(F.lit("fam-"), n % 6).alias("family"), F.when(n % 9 == 0, "keyword_only").otherwise("hybrid").alias("stage"))


@query("e01_recall_at_k", "SELECT query_id, a.recall AS recall_10, b.recall AS recall_20 FROM e_base a JOIN e_20 b USING (query_id)", CT)
def _(i):
    a, b = (ev.retrieval_metrics(i.ranked(), i.relevance(), k).select("query_id", F.col("recall").alias(f"recall_{k}")) for k in (10, 20))
    return a.join(b, "query_id")


@query("e02_mrr", "SELECT query_id, mrr, first_rank FROM e_base", CT)
def _(i):
    return ev.retrieval_metrics(i.ranked(), i.relevance()).select("query_id", "mrr", "first_rank")


@query("e03_must_have_coverage", """
SELECT job_id, round(count(h) / count(*), 4) AS coverage FROM job_skill s LEFT JOIN (SELECT DISTINCT job_id, skill, 1 AS h FROM (
 SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY raw_score DESC, candidate_id) AS rnk FROM pair) JOIN candidate_skill USING (candidate_id) WHERE rnk <= 10) USING (job_id, skill) GROUP BY 1""")
def _(i):
    run = top_k(i.pair(), ["job_id"], [F.desc("raw_score"), F.asc("candidate_id")], 10, "rnk")
    return ev.must_have_coverage(i.job_skill(), run, i.candidate_skill(), 10, "job_id")


@query("e04_ndcg_at_k", "SELECT query_id, ndcg FROM e_base", CT)
def _(i):
    return ev.retrieval_metrics(i.ranked(), i.relevance()).select("query_id", "ndcg")


CT["e_imp"] = """SELECT query_id, CAST(max(CASE WHEN run = 'r' AND hit THEN 1 ELSE 0 END) - max(CASE WHEN run = 'b' AND hit THEN 1 ELSE 0 END) AS BIGINT) AS improvement FROM (
 SELECT q.query_id, x.run, x.candidate_id IN (SELECT candidate_id FROM relevance z WHERE z.query_id = q.query_id) AS hit FROM (SELECT DISTINCT query_id FROM relevance) q
 JOIN (SELECT query_id, candidate_id, 'b' AS run FROM ranked WHERE rnk = 1 UNION ALL SELECT query_id, candidate_id, 'r' FROM reranked WHERE rnk = 1) x USING (query_id)) GROUP BY 1"""


@query("e05_top1_improvement", "SELECT * FROM e_imp", CT)
def _(i):
    return ev.top1_improvement(i.relevance(), i.ranked(), i.reranked())


@query("e06_understanding_alignment", """
SELECT job_id AS query_id, CASE WHEN list_contains([category, preferred_seniority], er) THEN 1.0 ELSE 0.0 END::DOUBLE AS role_accuracy, round(len(list_intersect(required_skills, terms[3:10])) / len(required_skills), 4) AS skill_accuracy,
 round(coalesce(min_years / 10, 1.0), 4) AS unknown_ratio, CASE WHEN category IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS fallback_rate FROM (SELECT *, CASE WHEN len(terms) % 2 = 0 THEN 'machinery' ELSE 'mid' END AS er FROM job_doc)""")
def _(i):
    rows = i.job_doc().select(
        F.col("job_id").alias("query_id"), F.when(F.size("terms") % 2 == 0, "Machinery ").otherwise("mid").alias("expected_role"), F.col("required_skills").alias("expected_skills"),
        F.array("category", "preferred_seniority").alias("roles"), F.slice("terms", 3, 8).alias("skills"), (F.col("min_years") / 10).alias("unknown_ratio"), F.col("category").isNull().alias("fallback_used"))
    return ev.understanding_alignment(rows.withColumn("roles", F.array_compact("roles")))


_GR = "CASE WHEN len(sp) = 0 THEN 0.5 ELSE round(least(1.0, len(list_filter(sp, lambda t: contains(lower(summary), t))) / len(sp) + CASE WHEN len(string_split(summary, ' ')) >= 12 THEN 0.1 ELSE 0 END), 4) END"
_SP = "(SELECT *, list_distinct(required_skills || skills) AS sp FROM pair_doc)"


@query("e07_groundedness", f"SELECT job_id, candidate_id, {_GR} AS score FROM {_SP}")
def _(i):
    return i.pair_doc().select("job_id", "candidate_id", sc.groundedness(F.col("summary"), F.col("required_skills"), F.col("skills")).alias("score"))


_CONS = "round(greatest(0.0, 1.0 - abs((least(1.0, raw_score * 2) + coalesce(experience_years / 10, 0) + 0.5) / (CASE WHEN experience_years IS NULL THEN 2 ELSE 3 END) - raw_score)), 4)"


def consistency():
    return sc.dimension_consistency({"skill": F.col("raw_score") * 2, "experience": F.col("experience_years") / 10, "technical": F.lit(0.5), "culture": None}, F.col("raw_score"))


@query("e08_dimension_consistency", f"SELECT job_id, candidate_id, {_CONS} AS score FROM pair_doc")
def _(i):
    return i.pair_doc().select("job_id", "candidate_id", consistency().alias("score"))


@query("e09_percentile", "SELECT path, round(quantile_cont(duration_ms, 0.5), 4) AS p50, round(quantile_cont(duration_ms, 0.95), 4) AS p95, round(quantile_cont(duration_ms, 1.0), 4) AS p100 FROM request_log GROUP BY 1")
def _(i):
    return exact_percentiles(i.request_log(), ["path"], "duration_ms", {"p50": 0.5, "p95": 0.95, "p100": 1.0})


@query("e10_latency_summary", """SELECT path, round(quantile_cont(v, 0.5), 4) AS p50_ms, round(quantile_cont(v, 0.95), 4) AS p95_ms, round(quantile_cont(v, 0.99), 4) AS p99_ms, round(avg(v), 4) AS mean_ms
FROM (SELECT path, greatest(0.0, duration_ms - 20) AS v FROM request_log) GROUP BY 1""")
def _(i):
    return ev.latency_summary(i.request_log().withColumn("ms", F.col("duration_ms") - 20), ["path"], "ms")


@query("e11_throughput", "SELECT request_id, CASE WHEN client_key > 0 AND duration_ms > 20 THEN round(client_key / ((duration_ms - 20) / 1000.0), 4) ELSE 0.0 END::DOUBLE AS per_second FROM request_log")
def _(i):
    return i.request_log().select("request_id", sc.per_second(F.col("client_key"), F.col("duration_ms") - 20).alias("per_second"))


@query("e12_cost", """SELECT conv_id, turn, CASE WHEN role = 'system' AND turn = 0 THEN NULL ELSE round(CASE WHEN role = 'user' THEN length(text) // 4 ELSE 0 END / 1000.0::DOUBLE * 0.4::DOUBLE + CASE WHEN role <> 'user' THEN length(text) // 4 ELSE 0 END / 1000.0::DOUBLE * 1.6::DOUBLE, 6) END AS usd
FROM conversations""")
def _(i):
    t = F.floor(F.length("text") / 4)
    first = (F.col("role") == "system") & (F.col("turn") == 0)
    return i.base("conversations").select("conv_id", "turn", sc.cost_usd(
        F.when(F.col("role") == "user", t), F.when((F.col("role") != "user") & ~first, t), 0.4, 1.6).alias("usd"))


def _judged(i, keys):
    doc = F.concat(F.lit("doc-"), F.col("doc_id"))
    cols = {"query_id": query_id(), "candidate_id": doc, "doc_id": F.col("doc_id")}
    pred = i.base("documents").select(*[cols[k].alias(k) for k in keys], (F.col("n_chars") % 3 > 0).alias("value"))
    ref = i.base("labels").select(*[cols[k].alias(k) for k in keys], (F.col("quality") == 1).alias("value"))
    return ev.agreement(pred, ref, keys)


@query("e13_binary_agreement", "SELECT round(avg(CASE WHEN (n_chars % 3 > 0) = (quality = 1) THEN 1.0 ELSE 0.0 END), 4) AS agreement, count(*) AS common FROM documents JOIN labels USING (doc_id)")
def _(i):
    return _judged(i, ["doc_id"])


@query("e14_candidate_agreement", "SELECT round(avg(CASE WHEN (n_chars % 3 > 0) = (quality = 1) THEN 1.0 ELSE 0.0 END), 4) AS agreement, count(*) AS common FROM documents JOIN labels USING (doc_id)")
def _(i):
    return _judged(i, ["query_id", "candidate_id"])


def _mean(c):
    return f"round(sum(CAST(round({c} * 10000) AS BIGINT)) / count({c})) / 10000"


@query("e15_overall_evaluation", f"""
SELECT coalesce(family, 'ALL') AS family, count(*) AS queries, {', '.join(_mean(c) + ' AS ' + c for c in ('recall', 'mrr', 'ndcg', 'coverage'))}, {_mean('(rr - mrr)')} AS mrr_delta, CAST(sum(improvement) AS BIGINT) AS top1_improvement, round(count(*) FILTER (improvement > 0) / count(*), 4) AS top1_improvement_rate
FROM e_diag JOIN (SELECT query_id, mrr AS rr FROM e_rr) USING (query_id) JOIN e_imp USING (query_id) GROUP BY ROLLUP (family)""", CT)
def _(i):
    rr = ev.retrieval_metrics(i.reranked(), i.relevance()).select("query_id", F.col("mrr").alias("rr"))
    imp = ev.top1_improvement(i.relevance(), i.ranked(), i.reranked())
    j = diagnostics(i).join(rr, "query_id").join(imp, "query_id")
    return j.rollup("family").agg(
        F.count("*").alias("queries"), *[ev.mean4(F.col(c)).alias(c) for c in ("recall", "mrr", "ndcg", "coverage")],
        ev.mean4(F.col("rr") - F.col("mrr")).alias("mrr_delta"), F.sum("improvement").alias("top1_improvement"),
        sc.r4(F.count_if(F.col("improvement") > 0) / F.count("*")).alias("top1_improvement_rate")).withColumn("family", F.coalesce("family", F.lit("ALL")))


@query("e16_reliability_rates", """
SELECT round(avg(CASE WHEN f THEN 1.0 ELSE 0 END), 4) AS fallback_rate, round(avg(CASE WHEN t THEN 1.0 ELSE 0 END), 4) AS timeout_rate, round(avg(CASE WHEN e THEN 1.0 ELSE 0 END), 4) AS error_rate, round(avg(CASE WHEN f AND NOT e THEN 1.0 ELSE 0 END), 4) AS degraded_rate, count(*) AS queries
FROM (SELECT user_id % 3 = 0 AS f, value > 100 AS t, event_type = 'error' AS e FROM events)""")
def _(i):
    f, e = F.col("user_id") % 3 == 0, F.col("event_type") == "error"
    return ev.reliability(i.base("events").select(f.alias("fallback"), (F.col("value") > 100).alias("timeout"), e.alias("error"), (f & ~e).alias("degraded")))


@query("e17_rerank_gate_state", """
SELECT config, en AND NOT coalesce(md < 0, false) AS enabled_next, CASE WHEN en AND md < 0 THEN 'auto_bypass_previous_negative_mrr_delta' WHEN en THEN 'enabled' ELSE 'disabled_by_config' END AS reason, run_id AS last_run_id, round(md, 4) AS last_mrr_delta
FROM (SELECT 'cfg-' || user_id AS config, event_id AS run_id, (value - 50) / 1000 AS md, event_type <> 'signup' AS en, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(i):
    return ev.rerank_gate_state(i.base("events").select(
        F.concat(F.lit("cfg-"), F.col("user_id")).alias("config"), F.col("ts").alias("run_ts"), F.col("event_id").alias("run_id"),
        ((F.col("value") - 50) / 1000).alias("mrr_delta"), (F.col("event_type") != "signup").alias("enabled")))


@query("e18_diagnostics", "SELECT * FROM e_diag", CT)
def _(i):
    return diagnostics(i)


_CAP = "SELECT query_id, family FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {o}) AS fr FROM {src}) WHERE fr <= {cap} ORDER BY {o} LIMIT {n}"
_H = _CAP.format(o="recall, mrr, coalesce(first_rank, 999), query_id", cap=3, n=16, src="(SELECT * FROM e_diag WHERE recall < 1.0 OR coverage < 0.6 OR coalesce(first_rank > 3, false) OR stage <> 'hybrid')")
_R = _CAP.format(o="coalesce(top2_gap, 999.0), ndcg, first_rank, query_id", cap=4, n=16, src="(SELECT * FROM e_diag WHERE first_rank <= 10 AND (NOT top1 OR ndcg < 1.0) AND (top2_gap IS NULL OR top2_gap <= 0.03))")
_A = _CAP.format(o="pass, recall DESC, ndcg DESC, coalesce(first_rank, 999), query_id", cap=2, n=6, src="""(SELECT *, CASE WHEN top1 AND recall >= 0.6 AND coverage >= 0.6 AND ndcg >= 0.6 THEN 0 ELSE 1 END AS pass FROM e_diag WHERE first_rank <= 2 AND recall >= 0.6 AND coverage >= 0.6)""")


@query("e19_hard_subset_hybrid", _H, CT)
def _(i):
    return ev.select_hybrid(diagnostics(i), 16, 3).select("query_id", "family")


@query("e19b_hard_subset_rerank", _R, CT)
def _(i):
    return ev.select_rerank(diagnostics(i), 16, 4).select("query_id", "family")


@query("e20_per_family_cap", "SELECT query_id, family, rn AS place FROM (SELECT query_id, family, row_number() OVER (PARTITION BY family ORDER BY mrr DESC, query_id) AS rn FROM e_diag) WHERE rn <= 2", CT)
def _(i):
    return top_k(diagnostics(i), ["family"], [F.desc("mrr"), F.asc("query_id")], 2, "place").select("query_id", "family", "place")


@query("e21_agent_subset", _A, CT)
def _(i):
    return ev.select_agent(diagnostics(i), 6, 2).select("query_id", "family")


CT["e_ev"] = """SELECT job_id, candidate_id, rank, fusion_score, ro AS required_overlap, oo AS optional_overlap, nr, no, round(ro * 0.8 + oo * 0.15 + fusion_score * 0.05, 4) AS quality FROM (
 SELECT job_id, candidate_id, rn - 1 AS rank, raw_score AS fusion_score, len(list_intersect(required_skills, skills)) AS nr, len(list_intersect(related_skills, skills)) AS no,
  round(len(list_intersect(required_skills, skills)) / len(required_skills), 4) AS ro, CASE WHEN len(related_skills) = 0 THEN 0.0 ELSE round(len(list_intersect(related_skills, skills)) / len(related_skills), 4) END AS oo
 FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY raw_score DESC, candidate_id) AS rn FROM pair_doc) WHERE rn <= 20)"""
CT["e_sel"] = """SELECT *, place_1 - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY quality DESC, required_overlap DESC, optional_overlap DESC, fusion_score DESC, rank, candidate_id) AS place_1 FROM e_ev
 WHERE required_overlap >= 0.5 OR (required_overlap >= 0.35 AND quality >= 0.3 AND (nr >= 1 OR no >= 1))) WHERE place_1 <= 5"""


def evidence(i):
    run = top_k(i.pair_doc(), ["job_id"], [F.desc("raw_score"), F.asc("candidate_id")], 20).withColumn("rank", F.col("rank") - 1)
    return ev.candidate_evidence(run.select("job_id", "candidate_id", "rank", F.col("raw_score").alias("fusion_score"), F.col("required_skills").alias("required"),
                                            F.col("related_skills").alias("optional"), F.col("skills").alias("observed")))


@query("e22_candidate_evidence", "SELECT job_id, candidate_id, rank, required_overlap, optional_overlap, quality FROM e_ev", CT)
def _(i):
    return evidence(i).select("job_id", "candidate_id", "rank", "required_overlap", "optional_overlap", "quality")


@query("e23_golden_selection", "SELECT job_id, candidate_id, place, quality FROM e_sel", CT)
def _(i):
    return ev.golden_selection(evidence(i)).select("job_id", "candidate_id", "place", "quality")


_GRADE = "CASE WHEN required_overlap >= 0.75 AND {p} = 0 THEN 3 WHEN required_overlap >= 0.5 THEN CASE WHEN {p} <= 1 THEN 3 ELSE 2 END WHEN required_overlap >= 0.35 THEN 2 ELSE 1 END"


@query("e24_grade", f"SELECT job_id, candidate_id, CAST({_GRADE.format(p='rank')} AS BIGINT) AS grade FROM e_ev", CT)
def _(i):
    return evidence(i).select("job_id", "candidate_id", sc.grade_for(F.col("required_overlap"), F.col("rank")).alias("grade"))


@query("e25_regenerate_golden", f"""
SELECT job_id, coalesce(n, 0) AS n, coalesce(n, 0) < 4 AS soft_golden, CASE WHEN coalesce(n, 0) < 4 THEN '' ELSE rel END AS relevant FROM job LEFT JOIN (
 SELECT job_id, count(*) AS n, string_agg(candidate_id || ':' || {_GRADE.format(p='place')}, '|' ORDER BY place) AS rel FROM e_sel GROUP BY 1) USING (job_id)""", CT)
def _(i):
    return ev.regenerate_golden(i.job().select("job_id"), ev.golden_selection(evidence(i)), 4)


_VOC = "(SELECT skill AS name FROM taxonomy UNION SELECT alias FROM alias_map UNION SELECT canonical FROM alias_map)"
CT["e_exp"] = "SELECT DISTINCT s.skill AS token, coalesce(a.canonical, s.skill) AS name FROM candidate_skill s LEFT JOIN alias_map a ON a.alias = s.skill"


@query("e26_vocabulary_audit", f"""
SELECT count(*) AS unique_expected, count(*) FILTER (k) AS mapped, count(DISTINCT CASE WHEN k THEN name END) AS mapped_canonical, count(*) FILTER (NOT k) AS unmapped, round(count(*) FILTER (k) / count(*), 4) AS mapped_ratio
FROM (SELECT *, name IN (SELECT name FROM {_VOC}) AS k FROM e_exp)""", CT)
def _(i):
    return ev.vocabulary_audit(i.candidate_skill().select(F.col("skill").alias("token")), i.taxonomy(), i.alias_map())


@query("e27_vocabulary_alignment", """
SELECT job_id, skill, min(ord) AS pos, skill IN (SELECT skill FROM taxonomy) OR skill IN (SELECT canonical FROM alias_map) AS known FROM (SELECT job_id, ord, coalesce(a.canonical, s.skill) AS skill FROM job_skill s LEFT JOIN alias_map a ON a.alias = s.skill) GROUP BY 1, 2""")
def _(i):
    e = i.job_skill().select("job_id", F.col("ord").alias("pos"), F.col("skill").alias("token"))
    return ev.align_vocabulary(e, i.taxonomy(), i.alias_map(), drop_unknown=False)


def _cov(a):
    return f"round(len(list_filter({a}, lambda t: contains(lower(summary), t))) / len({a}), 4)"


@query("e28_explanation_judge", f"""
SELECT job_id, candidate_id, overall, g AS groundedness, c AS coverage, s AS specificity, overall >= 0.6 AS passed FROM (SELECT *, round(least(1.0, 0.4::DOUBLE * g + 0.2::DOUBLE * c + 0.2::DOUBLE * s + 0.2::DOUBLE * k), 4) AS overall FROM (
 SELECT job_id, candidate_id, {_GR} AS g, {_cov('required_skills')} AS c, {_cov('skills')} AS s, {_CONS} AS k FROM {_SP}))""")
def _(i):
    q = sc.explanation_quality(F.col("required_skills"), F.col("skills"), F.col("summary"), consistency())
    return i.pair_doc().select("job_id", "candidate_id", q.alias("q")).select("job_id", "candidate_id", *[f"q.{c}" for c in ("overall", "groundedness", "coverage", "specificity", "passed")])


@query("e29_family_diversity", """
SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS families, round(-sum(p * log2(p)), 4) AS entropy, round(-sum(p * log2(p)) / log2(count(*)), 4) AS normalized_entropy FROM (SELECT source, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM documents GROUP BY 1)""")
def _(i):
    return ev.family_diversity(i.base("documents"), "source")
