"""Queries over retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import scoring as sc
from matchloom.functions import text as tx
from matchloom.operators import search as se
from matchloom.operators.facets import FILTERS, normalize_label, spaced
from matchloom.operators.keyword_index import keyword_index
from matchloom.operators.vector_index import VectorIndex, recall
from matchloom.plans import duck as d
from matchloom.plans.registry import query
from matchloom.session import materialize, shared_dir

IND = {"technology": "technology", "industrial": "manufacturing"}  # labels used by the job table


def industry_hit_sql(cat: str, ind: str) -> str:
    cases = []
    for label, key in IND.items():
        terms = dict.fromkeys(spaced(t) for t in FILTERS["industries"][key]["category_terms"])
        cases.append(f"WHEN {ind} = {d.q(label)} THEN CASE WHEN " + " OR ".join(f"contains({cat}, {d.q(t)})" for t in terms) + " THEN 1.0 ELSE 0.0 END")
    return "CASE " + " ".join(cases) + " ELSE 0.5 END"


def meta_sql(cat, ind, years, sen, ccat, cyears, csen) -> str:
    c = f"CASE WHEN {cat} IS NULL THEN 0.5 WHEN {ccat} = {cat} THEN 1.0 ELSE 0.0 END"
    e = f"CASE WHEN {years} IS NULL THEN 0.5 WHEN {cyears} IS NULL THEN 0.0 WHEN {years} <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, {cyears} / nullif({years}, 0))) END"
    s = f"CASE WHEN {sen} IS NULL THEN 0.5 WHEN {csen} IS NULL THEN 0.2 WHEN {csen} = {sen} THEN 1.0 ELSE 0.4 END"
    return (f"(CASE WHEN {ind} IS NOT NULL THEN ({c})::DOUBLE * 0.4 + ({industry_hit_sql(ccat, ind)})::DOUBLE * 0.15 + ({e})::DOUBLE * 0.3 + ({s})::DOUBLE * 0.15 "
            f"ELSE ({c})::DOUBLE * 0.5 + ({e})::DOUBLE * 0.35 + ({s})::DOUBLE * 0.15 END)")


POOL = "list_distinct(skills || core_skills || expanded_skills)"
KW = "round(len(list_intersect(terms, pool)) / len(terms), 4)"
_IND_OK = "CASE " + " ".join(
    f"WHEN j.industry = {d.q(lb)} THEN " + "(" + " OR ".join(f"contains(c.category, {d.q(t.lower())})" for t in FILTERS["industries"][k]["category_terms"]) + ")" for lb, k in IND.items()) + " ELSE true END"
PRED = f"""(CASE WHEN j.category IS NOT NULL THEN c.category = j.category ELSE {_IND_OK} END)
 AND (j.min_years IS NULL OR coalesce(c.experience_years >= j.min_years, false))
 AND (len(list_intersect(c.pool, j.terms)) > 0 OR len(list_filter(j.terms, lambda t: contains(lower(c.summary), t))) > 0)"""
CT = {
    "doc_pool": f"SELECT *, {POOL} AS pool FROM candidate_doc",
    "vec_hit": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, candidate_id) AS rank FROM (
 SELECT j.job_id, c.candidate_id, round(list_inner_product(j.embedding, c.embedding), 6) AS score FROM job_vector j JOIN candidate_vector c
 ON (j.category IS NULL OR c.category = j.category) AND (j.min_years IS NULL OR coalesce(c.experience_years, 0.0) >= j.min_years))) WHERE rank <= 30""",
    "kw_scored": f"""SELECT *, round(greatest(0.0, least(1.0, (keyword_score * 0.37 + metadata_score * 0.15) / (0.48 + 0.37 + 0.15))), 4) AS fusion_score FROM (
 SELECT j.job_id, c.candidate_id, round(len(list_intersect(j.terms, c.pool)) / len(j.terms), 4) AS keyword_score,
  round({meta_sql('j.category', 'j.industry', 'j.min_years', 'j.preferred_seniority', 'c.category', 'c.experience_years', 'c.seniority_level')}, 4) AS metadata_score
 FROM job_doc j JOIN doc_pool c ON {PRED})""",
    "kw_hit": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY fusion_score DESC, candidate_id) AS rank FROM kw_scored) WHERE rank <= 30",
    "vec_scored": f"""SELECT v.job_id, v.candidate_id, v.score AS raw, v.rank AS v_rank, round(greatest(0.0, least(1.0, (v.score + 1.0) / 2.0)), 4) AS vector_score,
  round(len(list_intersect(j.terms, c.pool)) / len(j.terms), 4) AS v_kw,
  round({meta_sql('j.category', 'j.industry', 'j.min_years', 'j.preferred_seniority', 'c.category', 'c.experience_years', 'c.seniority_level')}, 4) AS v_meta
 FROM vec_hit v JOIN job_doc j USING (job_id) JOIN doc_pool c USING (candidate_id)""",
    "hit": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY fusion_score DESC, seen, candidate_id) AS rank FROM (
 SELECT *, round(greatest(0.0, least(1.0, (vector_score * 0.48 + keyword_score * 0.37 + metadata_score * 0.15) / (0.48 + 0.37 + 0.15))), 4) AS fusion_score FROM (
 SELECT coalesce(v.job_id, k.job_id) AS job_id, coalesce(v.candidate_id, k.candidate_id) AS candidate_id, coalesce(raw, round(keyword_score * 2.0 - 1.0, 4)) AS score,
  coalesce(vector_score, 0.0) AS vector_score, greatest(v_kw, keyword_score) AS keyword_score, greatest(v_meta, metadata_score) AS metadata_score, coalesce(v_rank, k.rank + 1000000) AS seen
 FROM vec_scored v FULL OUTER JOIN kw_hit k ON k.job_id = v.job_id AND k.candidate_id = v.candidate_id))) WHERE rank <= 10""",
}


def hits(i, k=10):
    """The hybrid hits, written first, as the queries read them in several steps."""
    return materialize(se.hybrid_search(i.written("job_doc"), i.job_vector(), i.written("candidate_doc"), i.candidate_vector(), k), "hits")


@query("r01_vector_top_k", "SELECT job_id, candidate_id, score, rank FROM vec_hit", {
    **CT, "vec_hit": CT["vec_hit"].replace("ON (j.category IS NULL OR c.category = j.category) AND (j.min_years IS NULL OR coalesce(c.experience_years, 0.0) >= j.min_years)", "ON true")})
def _(i):
    none = F.lit(None)
    q = i.job_vector().withColumn("category", none.cast("string")).withColumn("min_years", none.cast("double"))
    return se.vector_top_k(q, i.candidate_vector(), 30)


CELLS, PROBE = 32, 26  # the given vectors fill their space evenly, the worst case: most cells for nine tenths of 30 hits


def vector_index(i):
    return VectorIndex.build(i.candidate_vector(), shared_dir(i.spark, "vector-index"), CELLS)


@query("r01b_vector_index_all_cells", "SELECT job_id, candidate_id, score, rank FROM vec_hit WHERE rank <= 20", CT)
def _(i):
    """Through the index, reading every cell: the exact answer, with the search's filters."""
    return vector_index(i).search(i.job_vector(), 20, CELLS)


@query("r01c_vector_index_recall")
def _(i):
    """Share of the exact hits that the index finds in ``PROBE`` of ``CELLS`` cells, per k."""
    jobs = i.job_vector()
    return recall(vector_index(i).search(jobs, 30, PROBE), se.vector_top_k(jobs, i.candidate_vector(), 30), [1, 10, 30])


@query("r02_vector_prefilter", "SELECT job_id, candidate_id, score, rank FROM vec_hit WHERE rank <= 20", CT)
def _(i):
    return se.vector_top_k(i.job_vector(), i.candidate_vector(), 20)


@query("r03_query_to_vector_search", """
SELECT * FROM (SELECT item_id, candidate_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, candidate_id) AS rank FROM (
 SELECT b.item_id, c.candidate_id, round(list_inner_product(CAST(e.embedding AS DOUBLE[]), c.embedding), 6) AS score FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id CROSS JOIN candidate_vector c)) WHERE rank <= 10""")
def _(i):
    texts = i.base("benchmark").join(i.base("embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    q = texts.select(F.col("item_id").cast("string").alias("job_id"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("double").alias("min_years"), "embedding")
    return se.vector_top_k(q, i.candidate_vector(), 10).select(F.col("job_id").cast("long").alias("item_id"), "candidate_id", "score", "rank")


@query("r04_vector_unit_range", "SELECT job_id, candidate_id, greatest(0.0, least(1.0, (raw_score * 3 - 1 + 1.0) / 2.0)) AS vector_score FROM pair")
def _(i):
    return i.pair().select("job_id", "candidate_id", sc.vector_unit(F.col("raw_score") * 3 - 1).alias("vector_score"))


def pairs(i):
    return se.pooled(i.pair_doc())


_PP = f"(SELECT *, {POOL} AS pool FROM pair_doc)"


@query("r05_keyword_predicate", f"SELECT job_id, candidate_id, {PRED} AS matches FROM {_PP} z".replace("j.category", "job_category").replace("c.category", "z.category").replace("j.", "z.").replace("c.", "z."))
def _(i):
    return pairs(i).select("job_id", "candidate_id", sc.keyword_predicate(
        F.col("terms"), F.col("job_category"), F.col("industry"), F.col("min_years"), F.col("category"), F.col("experience_years"),
        F.col("pool"), F.col("summary")).alias("matches"))


@query("r06_keyword_search", "SELECT job_id, candidate_id, keyword_score, metadata_score, fusion_score, rank FROM kw_hit", CT)
def _(i):
    return se.keyword_top_k(i.job_doc(), se.pooled(i.candidate_doc()), 30)


@query("r06b_keyword_index", "SELECT job_id, candidate_id, keyword_score, metadata_score, fusion_score, rank FROM kw_hit", CT)
def _(i):
    """The same hits from the stored index, which leaves out blocks whose best possible score is too low."""
    return keyword_index(se.pooled(i.candidate_doc())).search(i.job_doc(), 30)


@query("r07_keyword_overlap", f"SELECT job_id, candidate_id, {KW} AS keyword_score FROM {_PP}")
def _(i):
    return pairs(i).select("job_id", "candidate_id", sc.keyword_score(F.col("pool"), F.col("terms")).alias("keyword_score"))


_META = meta_sql("job_category", "industry", "min_years", "preferred_seniority", "category", "experience_years", "seniority_level")


def meta(i=None):
    return sc.metadata_score(*[F.col(c) for c in ("job_category", "industry", "min_years", "preferred_seniority", "category", "experience_years", "seniority_level")])


@query("r08_metadata_score", f"SELECT job_id, candidate_id, round({_META}, 6) AS metadata_score FROM pair_doc")
def _(i):
    return i.pair_doc().select("job_id", "candidate_id", sc.rnd(meta(), 6).alias("metadata_score"))


@query("r09_fusion_score", f"""
SELECT job_id, candidate_id, round(greatest(0, least(1, (raw_score * 0.48 + kw * 0.37 + m * 0.15) / 1.0)), 6)::DOUBLE AS fusion_score,
 round(greatest(0, least(1, (raw_score * 2.0 + m * 1.0) / 3.0)), 6)::DOUBLE AS custom_score
FROM (SELECT job_id, candidate_id, raw_score, {KW} AS kw, {_META} AS m FROM {_PP})""")
def _(i):
    kw = sc.keyword_score(F.col("pool"), F.col("terms"))
    p = pairs(i).select("job_id", "candidate_id", "raw_score", kw.alias("kw"), meta().alias("m"))
    raw, k, m = F.col("raw_score"), F.col("kw"), F.col("m")
    return p.select("job_id", "candidate_id", sc.rnd(sc.fusion(raw, k, m), 6).alias("fusion_score"),
                    sc.rnd(sc.fusion(raw, k, m, {"vector": 2.0, "keyword": -1.0, "metadata": 1.0}), 6).alias("custom_score"))


@query("r10_hit_from_document", f"""
SELECT job_id, candidate_id, kw AS keyword_score, m AS metadata_score, round(kw * 2.0 - 1.0, 4) AS score, 0.0::DOUBLE AS vector_score,
 round(greatest(0, least(1, (kw * 0.37 + m * 0.15) / (0.48 + 0.37 + 0.15))), 4)::DOUBLE AS fusion_score FROM (SELECT job_id, candidate_id, {KW} AS kw, round({_META}, 4) AS m FROM {_PP})""")
def _(i):
    p = pairs(i).select("job_id", "candidate_id", sc.keyword_score(F.col("pool"), F.col("terms")).alias("keyword_score"), sc.r4(meta()).alias("metadata_score"))
    return p.select("*", sc.r4(F.col("keyword_score") * 2.0 - 1.0).alias("score"), F.lit(0.0).alias("vector_score"),
                    sc.r4(sc.fusion(F.lit(0.0), F.col("keyword_score"), F.col("metadata_score"))).alias("fusion_score"))


@query("r11_hybrid_search", "SELECT job_id, candidate_id, rank, score, vector_score, keyword_score, metadata_score, fusion_score FROM hit", CT)
def _(i):
    return se.hybrid_search(i.job_doc(), i.job_vector(), i.candidate_doc(), i.candidate_vector(), 10).drop("stage", "fallback")


@query("r12_degraded_mode", "SELECT job_id, candidate_id, rank, fusion_score, CASE WHEN has THEN 'hybrid' ELSE 'keyword_only' END AS stage, NOT has AS fallback FROM (SELECT *, job_id IN (SELECT job_id FROM job_vector) AS has FROM hit)", {
    **CT, "job_vector": d.CTES["job_vector"] + " WHERE category IS NOT NULL"})
def _(i):
    vectors = i.job_vector().where("category is not null")  # jobs without a category have no query vector here
    h = se.hybrid_search(i.job_doc(), vectors, i.candidate_doc(), i.candidate_vector(), 10)
    return h.select("job_id", "candidate_id", "rank", "fusion_score", "stage", "fallback")


_Q = "list_filter(list_transform(regexp_extract_all(qt, '\\w+'), lambda t: lower(t)), lambda t: length(t) > 2)"
_S = "list_filter(list_transform(string_split(regexp_replace({}, '([.!?\\n])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query("r14_search_within_candidate", f"""
SELECT job_id, candidate_id, CASE WHEN len(ev) = 0 THEN 'No evidence found in candidate''s resume for query: ''' || qt || '''.' ELSE array_to_string(ev, chr(10)) END AS evidence FROM (
 SELECT job_id, candidate_id, qt,
  CASE WHEN len(ph) > 0 THEN ['[Capabilities] Related capabilities / skills'] || list_transform(ph, lambda p: '- ' || p) ELSE [] END
  || CASE WHEN len(su) > 0 THEN [chr(10) || '[Summary]'] || list_transform(su, lambda p: '- ' || p) ELSE [] END
  || CASE WHEN role_hit OR len(de) > 0 THEN [chr(10) || '[Experience] ' || coalesce(seniority_level, 'Unknown Role') || ' at ' || location] || list_transform(de, lambda p: '- ' || p) ELSE [] END AS ev
 FROM (SELECT *, list_filter(skills, lambda p: len(list_filter(terms2, lambda t: contains(p, t))) > 0) AS ph,
   list_filter({_S.format('summary')}, lambda s: len(list_filter(terms2, lambda t: contains(lower(s), t))) > 0) AS su,
   list_filter({_S.format('descr')}, lambda s: len(list_filter(terms2, lambda t: contains(lower(s), t))) > 0) AS de,
   len(list_filter(terms2, lambda t: contains(lower(coalesce(seniority_level, 'Unknown Role')), t) OR contains(lower(location), t))) > 0 AS role_hit
  FROM (SELECT *, {_Q} AS terms2 FROM (SELECT *, required_skills[1] || ' or senior at client' AS qt, 'Built ' || degree || '. Led ' || category || '! Shipped.' AS descr FROM pair_doc))))""")
def _(i):
    from matchloom.functions.evidence import search_within
    item = F.struct(F.col("seniority_level").alias("title"), F.col("location").alias("company"),
                    F.concat(F.lit("Built "), "degree", F.lit(". Led "), "category", F.lit("! Shipped.")).alias("description"))
    q = F.concat(F.get("required_skills", F.lit(0)), F.lit(" or senior at client"))
    return i.pair_doc().select("job_id", "candidate_id", search_within(q, F.col("skills"), F.col("summary"), F.array(item)).alias("evidence"))


@query("r15_ranked_ids", """
SELECT h.job_id, string_agg(h.candidate_id, '|' ORDER BY h.rank) AS ranked_ids, string_agg(array_to_string(c.skills, ','), '|' ORDER BY h.rank) AS skills,
 CAST(max(greatest(1, length(t.text) // 4)) AS BIGINT) AS input_tokens, count(*) * 12 AS output_tokens
FROM hit h JOIN candidate_doc c USING (candidate_id) JOIN job_text t USING (job_id) GROUP BY 1""", CT)
def _(i):
    h = hits(i).join(i.written("candidate_doc").select("candidate_id", "skills", "core_skills"), "candidate_id")
    known = F.when(F.size("skills") > 0, F.col("skills")).otherwise(F.col("core_skills"))
    per = h.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_id", F.array_join(known, ",").alias("s")))).alias("r"))  # k rows per job
    return per.join(i.job_text(), "job_id").select(
        "job_id", F.array_join(F.transform("r", lambda e: e["candidate_id"]), "|").alias("ranked_ids"),
        F.array_join(F.transform("r", lambda e: e["s"]), "|").alias("skills"), tx.estimate_tokens(F.col("text")).alias("input_tokens"),
        (F.size("r") * 12).cast("long").alias("output_tokens"))
