"""Queries over filters, facets and scoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions import resume as rs
from matchloom.functions import scoring as sc
from matchloom.functions import text as tx
from matchloom.operators import facets as fa
from matchloom.operators import fairness as fr
from matchloom.operators import matching as ma
from matchloom.operators import ontology as on
from matchloom.operators.ranking import top_k
from matchloom.plans import duck as d
from matchloom.plans import fairness as pfair
from matchloom.plans import retrieval as rt
from matchloom.plans.registry import query
from matchloom.session import materialize

# ---- filters and facets -------------------------------------------------
_DEG = {n: "(" + " OR ".join(f"contains({d.normalize_token('degree')}, {d.q(w)})" for w in ws) + ")" for n, (_, ws) in fa.DEGREE_PATTERNS.items()}
LEVEL = f"CASE WHEN {_DEG['phd']} THEN 3 WHEN {_DEG['master']} THEN 2 WHEN {_DEG['bachelor']} THEN 1 ELSE 0 END"
EDU = "CASE s_suppkey % 4 WHEN 0 THEN 'Bachelor' WHEN 1 THEN 'master' WHEN 2 THEN 'PhD' ELSE 'any' END"
REG = "CASE s_suppkey % 5 WHEN 0 THEN 'Asia' WHEN 1 THEN 'remote' WHEN 2 THEN 'middle-east' WHEN 3 THEN NULL ELSE 'America' END"
CT = {
    **rt.CT,
    "pair_filter": f"SELECT p.*, {EDU} AS education, {REG} AS wanted_region FROM pair_doc p JOIN job j ON j.job_id = p.job_id".replace("s_suppkey", "j.s_suppkey"),
}
EDU_OK = f"({LEVEL} >= CASE lower(education) WHEN 'bachelor' THEN 1 WHEN 'master' THEN 2 WHEN 'phd' THEN 3 ELSE 0 END)"
_R, _L = d.normalize_region("wanted_region"), d.normalize_region("location")
REG_OK = f"(CASE WHEN {_R} = '' THEN true WHEN {_R} = 'remote' THEN contains({_L}, 'remote') OR contains({_L}, 'wfh') ELSE contains({_L}, {_R}) END)"


def job_filters(i):
    k = F.col("s_suppkey")
    return i.job().select(
        "job_id", F.when(k % 4 == 0, "Bachelor").when(k % 4 == 1, "master").when(k % 4 == 2, "PhD").otherwise("any").alias("education"),
        F.when(k % 5 == 0, "Asia").when(k % 5 == 1, "remote").when(k % 5 == 2, "middle-east").when(k % 5 == 4, "America").alias("region"))


@query("f02_education_level", f"SELECT candidate_id, CAST({LEVEL} AS BIGINT) AS level FROM candidate")
def _(i):
    return i.candidate().select("candidate_id", fa.education_level(F.array("degree")).alias("level"))


@query("f03_education_filter", f"SELECT job_id, candidate_id, {EDU_OK} AS passes FROM pair_filter", CT)
def _(i):
    j = i.pair().join(job_filters(i), "job_id").join(i.candidate().select("candidate_id", "degree"), "candidate_id")
    return j.select("job_id", "candidate_id", fa.matches_education(F.array("degree"), F.col("education")).alias("passes"))


@query("f04_region_filter", f"SELECT job_id, candidate_id, {REG_OK} AS passes FROM pair_filter", CT)
def _(i):
    j = i.pair().join(job_filters(i), "job_id").join(i.candidate().select("candidate_id", "location"), "candidate_id")
    return j.select("job_id", "candidate_id", fa.matches_region(fa.locations(F.array("location")), F.col("region")).alias("passes"))


@query("f05_locations", f"SELECT candidate_id, {d.normalize_region('location')} || '|' || {d.normalize_region('name')} AS places FROM candidate")
def _(i):
    return i.candidate().select("candidate_id", F.array_join(fa.locations(F.array("location"), F.array("name", F.lit(" "))), "|").alias("places"))


_SEEDS = {"technology": {"aliases": ["household"], "category_terms": ["plate"]}, "manufacturing": {"aliases": ["machinery"], "category_terms": ["hot"]}}
_SEED_SQL = ", ".join(f"({d.q(k)}, {d.q(t)})" for k, ts in fa.industry_seeds(_SEEDS).items() for t in ts)
CT["ind_term"] = f"""SELECT industry, tag FROM (VALUES {_SEED_SQL}) s(industry, tag)
 UNION SELECT industry, skill FROM taxonomy JOIN (VALUES {_SEED_SQL}) s(industry, tag) ON tag IN (skill, domain, family, parent)"""
CT["cand_tag"] = """SELECT candidate_id, category AS tag FROM candidate_doc UNION
 SELECT candidate_id, unnest([skill, domain, family, parent]) FROM (SELECT candidate_id, coalesce(a.canonical, token) AS skill FROM (
  SELECT candidate_id, unnest(skills || expanded_skills) AS token FROM candidate_doc) t LEFT JOIN alias_map a ON a.alias = t.token) LEFT JOIN taxonomy USING (skill)"""


@query("f06_industry_filter", """
SELECT job_id, candidate_id, i.key IS NULL OR EXISTS (SELECT 1 FROM cand_tag c JOIN ind_term t USING (tag) WHERE c.candidate_id = p.candidate_id AND t.industry = i.key) AS passes
FROM (SELECT p.job_id, p.candidate_id, j.industry FROM pair p JOIN job j USING (job_id)) p LEFT JOIN (VALUES ('technology', 'technology'), ('industrial', 'manufacturing')) i(label, key) ON i.label = p.industry""", CT)
def _(i):
    tax = i.taxonomy()
    terms = fa.industry_term_table(i.spark, tax, _SEEDS)
    tags = fa.candidate_tag_table(i.candidate_doc(), tax, i.alias_map())
    fits = tags.join(terms, "tag").select("candidate_id", "industry").distinct().withColumn("_fit", F.lit(True))
    p = i.pair().join(i.job().select("job_id", fa.normalize_label(F.col("industry"), fa.FILTERS["industries"]).alias("industry")), "job_id")
    return p.join(fits, ["candidate_id", "industry"], "left").select("job_id", "candidate_id", ((F.col("industry") == "") | F.col("_fit").isNotNull()).alias("passes"))


_FITS = """SELECT DISTINCT candidate_id, industry AS key FROM cand_tag JOIN ind_term USING (tag)"""


@query("f01_enrich_hits", f"""SELECT p.job_id, p.candidate_id, p.raw_score FROM pair_filter p LEFT JOIN (VALUES ('technology', 'technology'), ('industrial', 'manufacturing')) i(label, key) ON i.label = p.industry
 WHERE (min_years IS NULL OR coalesce(experience_years >= min_years, false)) AND {EDU_OK} AND {REG_OK} AND (i.key IS NULL OR (p.candidate_id, i.key) IN ({_FITS}))""", CT)
def _(i):
    jobs = i.job().select("job_id", "min_years", fa.normalize_label(F.col("industry"), fa.FILTERS["industries"]).alias("industry"))
    h = i.pair().join(jobs, "job_id").join(job_filters(i), "job_id").join(i.candidate().select("candidate_id", "experience_years"), "candidate_id")
    fits = fa.industry_fits(i.candidate_doc(), i.taxonomy(), i.alias_map(), _SEEDS)
    return fa.enrich_hits(h, i.candidate().select("candidate_id", "degree", "location"), fits).select("job_id", "candidate_id", "raw_score")


@query("f07_region_facet", f"SELECT DISTINCT {d.normalize_token('location')} AS region, source_dataset FROM candidate")
def _(i):
    return i.candidate().select(tx.normalize_token(F.col("location")).alias("region"), "source_dataset").where("region <> ''").distinct()


@query("f08_education_facet", " UNION ALL ".join(f"SELECT {d.q(n)} AS label, count(*) AS candidates FROM candidate WHERE {c}" for n, c in _DEG.items()))
def _(i):
    return i.candidate().select(F.explode(fa.education_labels(F.array("degree"))).alias("label")).groupBy("label").agg(F.count("*").alias("candidates"))


def _facet_sql(dictionary):
    parts = []
    for key, e in dictionary.items():
        terms = dict.fromkeys(fa.spaced(t) for t in [key, *e["aliases"], *e["category_terms"]])
        label = "E-commerce" if key == "e commerce" else key.title()
        parts.append("CASE WHEN " + " OR ".join(f"contains(joined, {d.q(t)})" for t in terms) + f" THEN {d.q(label)} END")
    return f"""SELECT candidate_id, {d.join(f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)")} AS labels FROM (
     SELECT candidate_id, array_to_string(list_sort(list_distinct([category] || skills || expanded_skills)), ' ') AS joined FROM candidate_doc)"""


def _facet(i, dictionary):
    return i.candidate_doc().select("candidate_id", F.array_join(fa.inferred_labels(
        F.col("category"), F.concat("skills", "core_skills", "expanded_skills"), dictionary), "|").alias("labels"))


_IND_D = {**fa.FILTERS["industries"], "retail trade": {"aliases": ["household", "widget"], "category_terms": ["furniture"]}}
_FAM_D = {**fa.FILTERS["job_families"], "metal work": {"aliases": ["anvil"], "category_terms": ["rod", "bolt"]}}


@query("f09_industry_facet", _facet_sql(_IND_D))
def _(i):
    return _facet(i, _IND_D)


@query("f10_job_family_facet", _facet_sql(_FAM_D))
def _(i):
    return _facet(i, _FAM_D)


@query("f11_filter_options", f"""
SELECT 'categories' AS dimension, array_to_string(list_sort(list(DISTINCT upper(category[1]) || category[2:])), '|') AS labels FROM candidate
UNION ALL SELECT 'locations', array_to_string(list_sort(list(DISTINCT {d.normalize_token('location')})), '|') FROM candidate
UNION ALL SELECT * FROM (VALUES {', '.join(f"({d.q(k)}, {d.q('|'.join(v))})" for k, v in fa.filter_options().items())}) x(a, b)""")
def _(i):
    c = i.candidate()
    data = c.select(F.lit("categories").alias("dimension"), tx.display_label(F.col("category")).alias("l")).unionByName(
        c.select(F.lit("locations").alias("dimension"), tx.normalize_token(F.col("location")).alias("l"))).distinct()
    found = data.groupBy("dimension").agg(F.array_join(F.array_sort(F.collect_set("l")), "|").alias("labels"))
    fixed = i.spark.createDataFrame([(k, "|".join(v)) for k, v in fa.filter_options().items()], "dimension string, labels string")
    return found.unionByName(fixed)


# ---- scoring ------------------------------------------------------------
def _w(x):
    return f"list_filter(string_split({x}, ' '), lambda w: NOT list_contains({d.lst(sc.TERM_STOPWORDS)}, w))"


def _o(t, c):
    return f"(len(list_intersect({_w(t)}, {_w(c)})) / len({_w(t)}))"


def match_sql(pool, t):
    o = _o(t, "c")
    return (f"CASE WHEN list_contains({pool}, {t}) THEN 1.0 ELSE coalesce(list_max(list_transform({pool}, lambda c: CASE WHEN {o} <= 0 THEN 0.0 "
            f"WHEN contains(c, {t}) OR contains({t}, c) THEN least(1.0, {o} + 0.2) ELSE {o} END)), 0.0) END")


def soft_sql(pool, targets):
    return f"(CASE WHEN len({targets}) = 0 THEN 0.0 ELSE list_sum(list_transform({targets}, lambda t: {match_sql(pool, 't')})) / len({targets}) END)"


CT["k_overlap"] = f"""SELECT *, CASE WHEN len(core_skills) > 0 THEN 0.45 * core_overlap + 0.35 * expanded_overlap + 0.2 * normalized_overlap ELSE 0.5 * normalized_overlap + 0.5 * expanded_overlap END AS skill_overlap FROM (
 SELECT *, {soft_sql('core_skills', 'required_skills')} AS core_overlap, {soft_sql('expanded_skills', 'terms')} AS expanded_overlap, {soft_sql('skills', 'required_skills')} AS normalized_overlap FROM pair_doc)"""
EXPFIT = "(CASE WHEN min_years IS NULL OR min_years <= 0 THEN 0.5 WHEN experience_years IS NULL THEN 0.0 WHEN experience_years / min_years <= 1 THEN experience_years / min_years ELSE 1.0 - least(0.15, (experience_years / min_years - 1.0) * 0.08) END)::DOUBLE"
_RANK = "MAP {" + ", ".join(f"{d.q(k)}: {v}" for k, v in sc.SENIORITY_RANKS.items()) + "}"
SENFIT = f"(CASE WHEN preferred_seniority IS NULL THEN 0.5 WHEN seniority_level IS NULL THEN 0.0 ELSE 1.0 - abs({_RANK}[seniority_level] - {_RANK}[preferred_seniority]) / 6.0 END)::DOUBLE"
CT["k_adj"] = f"""SELECT p.job_id, p.candidate_id, CASE WHEN r.n IS NULL THEN 0.0 ELSE least(1.0, round(least(coalesce(m.n, 0), 8) / r.n, 4)) END AS adjacent_score FROM pair p LEFT JOIN (SELECT job_id, count(*) AS n FROM j_rel GROUP BY 1) r USING (job_id)
 LEFT JOIN (SELECT job_id, candidate_id, count(*) AS n FROM (SELECT p.job_id, p.candidate_id, c.skill FROM pair p JOIN c_all c USING (candidate_id) LEFT JOIN taxonomy x ON x.skill = c.skill
  WHERE EXISTS (SELECT 1 FROM j_rel j LEFT JOIN taxonomy y ON y.skill = j.skill WHERE j.job_id = p.job_id AND (j.skill = c.skill OR x.domain = y.domain OR x.family = y.family OR x.parent = y.parent))) GROUP BY 1, 2) m USING (job_id, candidate_id)"""
CT["j_rel"] = "SELECT job_id, coalesce(a.canonical, skill) AS skill FROM job_skill LEFT JOIN alias_map a ON a.alias = skill WHERE ord > 6 GROUP BY ALL"
CT["c_all"] = "SELECT candidate_id, coalesce(a.canonical, token) AS skill FROM (SELECT candidate_id, unnest(skills || expanded_skills) AS token FROM candidate_doc) LEFT JOIN alias_map a ON a.alias = token GROUP BY ALL"
CT["k_match"] = f"""
SELECT *, greatest(0.0, least(1.0, 0.42 * semantic_similarity + 0.33 * skill_overlap + 0.18 * experience_fit + 0.07 * seniority_fit + category_fit)) AS deterministic_score,
 CASE WHEN n_req = 0 THEN 0.0 ELSE round(least(0.12, (1.0 - least(1.0, must_raw + (1.0 - must_raw) * adjacent_score * 0.5)) * 0.12), 4) END AS must_have_penalty, CASE WHEN n_req = 0 THEN 1.0 ELSE round(must_raw, 4) END AS must_have_rate FROM (
 SELECT o.*, a.adjacent_score, len(required_skills) AS n_req, greatest(0.0, least(1.0, (raw_score + 1.0) / 2.0)) AS semantic_similarity, {EXPFIT} AS experience_fit, {SENFIT} AS seniority_fit,
  CASE WHEN coalesce(job_category = category, false) THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END AS category_fit,
  len(list_filter(required_skills, lambda t: list_contains({rt.POOL}, t))) / len(required_skills) AS must_raw
 FROM k_overlap o JOIN k_adj a USING (job_id, candidate_id))"""


def relations(i, found=None, jobs=None):
    """What adjacent_score reads of jobs (by job_id) and of candidates (by candidate_id).

    ``found``: the candidate documents that occur, ``jobs`` their jobs, if these are not all."""
    def canonical(df, key):
        return on.canonicalize(df.select(key, F.col("skill").alias("token"), F.lit(0).alias("pos")), i.alias_map(), key).select(key, F.col("canonical").alias("skill"))
    tax = i.taxonomy()
    rel = canonical((i.job_doc() if jobs is None else jobs).select("job_id", F.explode(F.array_except("related_skills", "required_skills")).alias("skill")), "job_id")
    docs = (i.candidate_doc() if found is None else found).select("candidate_id", F.explode(sc.lower_set(F.col("skills"), F.col("core_skills"), F.col("expanded_skills"))).alias("skill"))
    return on.relation_profile(rel, tax, "job_id", "j_"), on.skill_facts(canonical(docs, "candidate_id"), tax, "candidate_id")


RELATED = ("j_skills", "j_domains", "j_families", "j_parents", "facts")


def with_adjacent(i, pairs, found=None, jobs=None):
    """Adds adjacent_score: related-but-not-required skills against the candidate's, capped at 8."""
    prof, facts = relations(i, found, jobs)
    return adjacent(pairs.join(prof, "job_id", "left").join(facts, "candidate_id", "left"))


def related_pairs(i):
    """The pairs with their documents and relations; these join their documents, so the pairs are shuffled once per side."""
    return i.pair_doc(*relations(i))


def adjacent(j):
    m = on.adjacent_matches(F.col("facts"), F.col("j_skills"), F.col("j_domains"), F.col("j_families"), F.col("j_parents"), 8)
    return j.select(*[c for c in j.columns if c not in RELATED], F.coalesce(on.adjacent_score(m, F.coalesce("j_skills", F.array().cast("array<string>"))), F.lit(0.0)).alias("adjacent_score"),
                    F.array_join(F.coalesce(m, F.array().cast("array<string>")), "|").alias("adjacent_matches"))


def matched(i):
    return ma.match_scores(adjacent(related_pairs(i)))


P = ("job_id", "candidate_id")


@query("k01_term_match", f"SELECT job_id, candidate_id, required_skills[1] AS term, round({match_sql('skills', 'required_skills[1]')}, 6) AS score FROM pair_doc")
def _(i):
    t = F.get("required_skills", F.lit(0))
    s = sc.let(sc.with_words(sc.skill_set(F.col("skills"))), lambda pool: sc.let(F.get(sc.with_words(F.array(t)), F.lit(0)), lambda x: sc.term_match(pool, x)))
    return i.pair_doc().select(*P, t.alias("term"), sc.rnd(s, 6).alias("score"))


@query("k02_soft_overlap", f"SELECT job_id, candidate_id, round({soft_sql('skills', 'terms')}, 6) AS score FROM pair_doc")
def _(i):
    s = sc.let(F.struct(sc.with_words(F.col("skills")).alias("p"), sc.with_words(F.col("terms")).alias("t")), lambda v: sc.soft_overlap(v["p"], v["t"]))
    return i.pair_doc().select(*P, sc.rnd(s, 6).alias("score"))


@query("k03_skill_overlap", "SELECT job_id, candidate_id, round(skill_overlap, 6) AS skill_overlap, round(core_overlap, 6) AS core_overlap, round(expanded_overlap, 6) AS expanded_overlap, round(normalized_overlap, 6) AS normalized_overlap FROM k_overlap", CT)
def _(i):
    jobs, docs = i.job_doc(), i.candidate_doc()
    terms = jobs.select("job_id", sc.job_skills(F.col("required_skills"), F.col("related_skills")).alias("job_skills"))
    pools = docs.select("candidate_id", sc.candidate_skills(F.col("core_skills"), F.col("expanded_skills"), F.col("skills")).alias("candidate_skills"))
    o = ma.overlaps(i.pair().select(*P).join(terms, "job_id").join(pools, "candidate_id"))
    return o.select(*P, *[sc.rnd(F.col(n), 6).alias(n) for n in ma.OVERLAPS])


@query("k04_experience_fit", f"SELECT job_id, candidate_id, round({EXPFIT}, 6) AS fit FROM pair_doc")
def _(i):
    return i.pair_doc().select(*P, sc.rnd(sc.experience_fit(F.col("experience_years"), F.col("min_years")), 6).alias("fit"))


@query("k05_seniority_fit", f"SELECT job_id, candidate_id, round({SENFIT}, 6) AS fit FROM pair_doc")
def _(i):
    return i.pair_doc().select(*P, sc.rnd(sc.seniority_fit(F.col("seniority_level"), F.col("preferred_seniority")), 6).alias("fit"))


@query("k06_deterministic_score", "SELECT job_id, candidate_id, round(deterministic_score, 6) AS score, category_fit FROM k_match", CT)
def _(i):
    return matched(i).select(*P, sc.rnd(F.col("deterministic_score"), 6).alias("score"), "category_fit")


@query("k07_final_rank_blend", "SELECT job_id, candidate_id, round(CASE WHEN n_applications = 1 THEN raw_score ELSE raw_score * 0.30 + 0.70 / n_applications END, 6)::DOUBLE AS score FROM pair")
def _(i):
    agent = F.when(F.col("n_applications") > 1, 1.0 / F.col("n_applications"))
    return i.pair().select(*P, sc.rnd(sc.final_rank(F.col("raw_score"), agent), 6).alias("score"))


@query("k08_adjacent_skill_score", "SELECT job_id, candidate_id, adjacent_score FROM k_adj", CT)
def _(i):
    return adjacent(related_pairs(i)).select(*P, "adjacent_score")


@query("k09_must_have_penalty", "SELECT job_id, candidate_id, must_have_rate, must_have_penalty FROM k_match", CT)
def _(i):
    return matched(i).select(*P, "must_have_rate", "must_have_penalty")


CT["k_final"] = "SELECT *, greatest(0.0, least(1.0, deterministic_score * (1.0 - must_have_penalty))) AS rank_score FROM k_match"


@query("k10_match_record", """
SELECT job_id, candidate_id, round(rank_score, 4) AS score, round(skill_overlap, 4) AS skill_overlap, round(semantic_similarity, 4) AS semantic_similarity, round(experience_fit, 4) AS experience_fit,
 round(seniority_fit, 4) AS seniority_fit, round(category_fit, 4) AS category_fit, must_have_rate, must_have_penalty, adjacent_score, 'deterministic-only(det_policy:v1,must-have-penalty:max0.12,adjacent-credit:0.50)' AS rank_policy FROM k_final""", CT)
def _(i):
    m = matched(i)
    return m.select(
        *P, sc.r4(ma.penalised(F.col("deterministic_score"), F.col("must_have_penalty"))).alias("score"),
        *[sc.r4(F.col(c)).alias(c) for c in ("skill_overlap", "semantic_similarity", "experience_fit", "seniority_fit", "category_fit")],
        "must_have_rate", "must_have_penalty", "adjacent_score",
        F.lit("deterministic-only(det_policy:v1,must-have-penalty:max0.12,adjacent-credit:0.50)").alias("rank_policy"))


def sentence_sql():
    return """'Matched required skills: ' || array_to_string(CASE WHEN len(mt) > 0 THEN mt WHEN len(req) > 0 THEN req[1:4] ELSE ['none explicit'] END, ', ') || '. Candidate evidence tokens: '
 || array_to_string(CASE WHEN len(sp) > 0 THEN sp[1:4] WHEN len(cand) > 0 THEN cand[1:4] ELSE ['none explicit'] END, ', ') || '; missing or weaker skills: ' || array_to_string(CASE WHEN len(ms) > 0 THEN ms ELSE ['none explicit'] END, ', ') || '. '"""


CT["k_sent"] = """SELECT *, list_filter(cand, lambda x: NOT list_contains(mt, x) AND NOT list_contains(ms, x)) AS sp FROM (
 SELECT *, list_filter(req, lambda x: list_contains(cand, x))[1:6] AS mt, list_filter(req, lambda x: NOT list_contains(cand, x))[1:4] AS ms FROM (SELECT *, required_skills[1:6] AS req, skills[1:10] AS cand FROM pair_doc))"""


@query("k11_deterministic_explanation", f"""SELECT job_id, candidate_id, {sentence_sql()} || format('Deterministic signals: semantic={{:.2f}}, skill={{:.2f}}, experience={{:.2f}}, seniority={{:.2f}}; must-have match={{:.2f}}.',
 a / 8.0, b / 8.0, a * b / 64.0, 0.5, len(mt) / 4.0) AS explanation FROM (SELECT *, len(skills) % 9 AS a, len(required_skills) AS b FROM k_sent)""", CT)
def _(i):
    a, b = F.size("skills") % 9, F.size("required_skills")
    mt = F.size(F.array_intersect(F.slice("required_skills", 1, 6), F.slice("skills", 1, 10)))
    return i.pair_doc().select(*P, sc.deterministic_explanation(F.col("required_skills"), F.col("skills"), a / 8.0, b / 8.0, a * b / 64.0, F.lit(0.5), mt / 4.0).alias("explanation"))


@query("k12_relevant_experience", """
SELECT candidate_id, coalesce(array_to_string(list(title || ' at ' || company ORDER BY seq) FILTER (rn <= 3), '|'), '') AS lines FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY seq) AS rn FROM experience_item) GROUP BY 1
UNION ALL SELECT candidate_id, round(experience_years, 1) || ' years of relevant experience' FROM candidate WHERE experience_years IS NOT NULL AND candidate_id NOT IN (SELECT candidate_id FROM experience_item)""")
def _(i):
    first3 = top_k(i.experience_item(), ["candidate_id"], [F.asc("seq")], 3).groupBy("candidate_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "title", "company"))).alias("items"))  # three rows per key
    c = i.candidate().select("candidate_id", "experience_years").join(first3, "candidate_id", "left")
    empty = F.array().cast("array<struct<rank:bigint,title:string,company:string>>")
    lines = sc.relevant_experience(F.coalesce("items", empty), F.col("experience_years"))
    return c.select("candidate_id", F.array_join(lines, "|").alias("lines")).where("lines <> ''")


def _norm(names):
    tot = " + ".join(names)
    return [f"round({n} / ({tot}), 4)" for n in names]


def _neg():
    rec = {k: f"({v}::DOUBLE" + {"experience": " + CASE WHEN s THEN 0.10 ELSE 0 END::DOUBLE", "technical": " - CASE WHEN s THEN 0.05 ELSE 0 END::DOUBLE", "culture": " - CASE WHEN s THEN 0.05 ELSE 0 END::DOUBLE"}.get(k, "") + ")" for k, v in sc.RECRUITER.items()}
    hm = {k: f"({v}::DOUBLE" + {"technical": " + CASE WHEN h THEN 0.10 ELSE 0 END::DOUBLE", "experience": " - CASE WHEN h THEN 0.05 ELSE 0 END::DOUBLE", "culture": " - CASE WHEN h THEN 0.05 ELSE 0 END::DOUBLE"}.get(k, "") + ")" for k, v in sc.HIRING_MANAGER.items()}
    r, m = _norm(list(rec.values())), _norm(list(hm.values()))
    cols = ", ".join([f"{e} AS r{j}" for j, e in enumerate(r)] + [f"{e} AS h{j}" for j, e in enumerate(m)])
    fin = _norm([f"((r{j} + h{j}) / 2.0)" for j in range(4)])
    return f"SELECT *, {', '.join(f'{e} AS f{j}' for j, e in enumerate(fin))} FROM (SELECT job_id, {cols} FROM (SELECT job_id, coalesce(min_years >= 5, false) AS s, len(required_skills) >= 6 AS h FROM job_doc))"


CT["k_weights"] = _neg()


@query("k13_weighting_summary", "SELECT job_id, format('Recruiter focus (S:{:.2f}, E:{:.2f}, T:{:.2f}, C:{:.2f}) | Hiring manager focus (S:{:.2f}, E:{:.2f}, T:{:.2f}, C:{:.2f}) | Final negotiated (S:{:.2f}, E:{:.2f}, T:{:.2f}, C:{:.2f})', r0, r1, r2, r3, h0, h1, h2, h3, f0, f1, f2, f3) AS summary FROM k_weights", CT)
def _(i):
    w = sc.negotiate_weights(F.col("min_years"), F.size("required_skills"))
    return i.job_doc().select("job_id", sc.weighting_summary(w).alias("summary"))


@query("k14_select_for_evaluation", "SELECT job_id, candidate_id, raw_score, eval_rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY raw_score DESC, candidate_id) AS eval_rank FROM pair) WHERE eval_rank <= 4")
def _(i):
    return ma.select_for_evaluation(i.pair().select(*P, "raw_score"), 4, "raw_score")


CT["k_scoped"] = """SELECT job_id, candidate_id, CASE WHEN use THEN agent_score ELSE raw_score END AS score, use AS evaluated,
  CASE WHEN rn > 4 THEN 'outside_agent_eval_scope' WHEN NOT use THEN 'agent_evaluation_failed(Timeout)' END AS reason FROM (SELECT *, rn <= 4 AND agent_score IS NOT NULL AS use FROM (
  SELECT *, CASE WHEN length(candidate_id) % 2 = 0 THEN raw_score / 2 + 0.25 END AS agent_score, row_number() OVER (PARTITION BY job_id ORDER BY raw_score DESC, candidate_id) AS rn FROM pair))"""


def scoped(i):
    p = i.pair().select(*P, "raw_score")
    ev = p.select(*P, F.when(F.length("candidate_id") % 2 == 0, F.col("raw_score") / 2 + 0.25).alias("agent_score"), F.lit("Timeout").alias("error"))
    return ma.scoped_evaluation(p, ev, 4, "raw_score")


@query("k15_scoped_evaluation", "SELECT * FROM k_scoped", CT)
def _(i):
    return scoped(i)


@query("k16_final_order", "SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY evaluated DESC, score DESC, candidate_id) AS position FROM k_scoped", CT)
def _(i):
    return ma.final_order(scoped(i))


@query("k19_rerank_gate", """
SELECT job_id, reason, reason = 'tight_top_scores_and_ambiguous_query' AS apply_rerank FROM (SELECT job_id, CASE WHEN n < 2 THEN 'insufficient_candidates' WHEN strong AND NOT amb THEN 'strong_top_hit_without_query_ambiguity' WHEN NOT tie THEN 'top_gap_too_wide_for_safe_rerank'
  WHEN NOT amb THEN 'tight_top_scores_but_query_is_confident' WHEN strong THEN 'ambiguous_query_but_top_hit_skill_overlap_is_strong' ELSE 'tight_top_scores_and_ambiguous_query' END AS reason FROM (
 SELECT g.*, b[1] - b[2] <= 0.015 AS tie, 0.5 + (s_suppkey % 5) * 0.1 < 0.65 OR (s_suppkey % 3) * 0.3 > 0.5 AS amb,
  top_f >= 0.45 AND len(list_intersect(d.required_skills, c.pool)) / len(d.required_skills) >= 0.6 AS strong
 FROM (SELECT job_id, count(*) AS n, list(fusion_score ORDER BY fusion_score DESC) AS b, arg_min(candidate_id, rank) AS cid, arg_min(fusion_score, rank) AS top_f FROM hit WHERE rank <= 8 GROUP BY 1) g
 JOIN job j USING (job_id) JOIN job_doc d USING (job_id) JOIN doc_pool c ON c.candidate_id = g.cid))""", CT)
def _(i):
    h = rt.hits(i)
    k = F.col("s_suppkey")
    q = i.job().select("job_id", (0.5 + (k % 5) * 0.1).alias("confidence"), ((k % 3) * 0.3).alias("unknown_ratio"))
    from matchloom.operators.search import pooled
    cov = h.where("rank = 1").select(*P).join(i.written("job_doc").select("job_id", "required_skills"), "job_id").join(i.written("candidate_doc"), "candidate_id")
    cov = pooled(cov)
    cov = cov.select(*P, sc.share(F.array_intersect(sc.lower_set(F.col("required_skills")), F.col("pool")), sc.lower_set(F.col("required_skills"))).alias("coverage"))
    return ma.rerank_gate(h, q, cov)


@query("k20_skill_coverage", f"SELECT job_id, candidate_id, round(len(list_intersect(required_skills, {rt.POOL})) / len(required_skills), 6) AS coverage FROM pair_doc")
def _(i):
    req = sc.lower_set(F.col("required_skills"))
    return rt.pairs(i).select(*P, sc.rnd(sc.share(F.array_intersect(req, F.col("pool")), req), 6).alias("coverage"))


_COS = "greatest(-1.0, least(1.0, list_inner_product(j.embedding, c.embedding) / (sqrt(list_inner_product(j.embedding, j.embedding)) * sqrt(list_inner_product(c.embedding, c.embedding)))))"
CT["k_rel"] = f"SELECT job_id, candidate_id, round(greatest(0.0, least(1.0, ({_COS} + 1.0) / 2.0)), 6) AS relevance FROM hit h JOIN job_vector j USING (job_id) JOIN candidate_vector c USING (candidate_id)"


def relevance(i, h):
    v = h.select(*P).join(i.job_vector().select("job_id", F.col("embedding").alias("q")), "job_id").join(i.candidate_vector().select("candidate_id", F.col("embedding").alias("v")), "candidate_id")
    return v.select(*P, sc.rnd(sc.vector_unit(sc.cosine(F.col("q"), F.col("v"))), 6).alias("relevance"))


@query("k21_rerank_blend", """
SELECT job_id, candidate_id, rank, rerank_score, blended, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY blended DESC, rank) AS new_rank FROM (
 SELECT h.job_id, h.candidate_id, h.rank, round(coalesce(relevance, fusion_score), 4) AS rerank_score, round(0.75::DOUBLE * coalesce(relevance, fusion_score) + 0.25::DOUBLE * fusion_score, 6) AS blended
 FROM hit h LEFT JOIN k_rel r USING (job_id, candidate_id))) WHERE new_rank <= 5""", CT)
def _(i):
    h = rt.hits(i)
    return ma.rerank_blend(h.select(*P, "rank", "fusion_score"), relevance(i, h), 5)


@query("k22_embedding_rerank", "SELECT * FROM k_rel", CT)
def _(i):
    return relevance(i, rt.hits(i))


@query("k23_cosine", f"SELECT job_id, candidate_id, round({_COS}, 6) AS cosine FROM pair p JOIN job_vector j USING (job_id) JOIN candidate_vector c USING (candidate_id)")
def _(i):
    v = i.pair().select(*P).join(i.job_vector().select("job_id", F.col("embedding").alias("q")), "job_id").join(i.candidate_vector().select("candidate_id", F.col("embedding").alias("v")), "candidate_id")
    return v.select(*P, sc.rnd(sc.cosine(F.col("q"), F.col("v")), 6).alias("cosine"))


@query("k24_rerank_text", "SELECT candidate_id, trim(concat_ws(' ', nullif(trim(summary), ''), nullif(array_to_string(skills, ' '), ''), category, seniority_level, CAST(experience_years AS VARCHAR))) AS text FROM candidate_doc", d.UNSIGNED_YEARS)
def _(i):
    return i.candidate_doc().select("candidate_id", sc.rerank_text(*[F.col(c) for c in ("summary", "skills", "category", "seniority_level", "experience_years")]).alias("text"))


_COV = "round(len(list_intersect(required_skills, skills)) / len(required_skills), 4)"
_SEN2 = "CASE WHEN preferred_seniority IS NULL THEN 0.5 WHEN seniority_level IS NULL THEN 0.0 WHEN preferred_seniority = seniority_level THEN 1.0 ELSE 0.4 END::DOUBLE"
CT["k_agent"] = f"""SELECT a.*, round(greatest(0, least(1, agent_skill * f0 + agent_experience * f1 + agent_technical * f2 + agent_culture * f3)), 4)::DOUBLE AS agent_weighted FROM (
 SELECT *, {_COV} AS agent_skill, round((round({EXPFIT}, 4) + {_SEN2}) / 2.0, 4) AS agent_experience, round(({_COV} + round(least(1.0, {_COV} * 0.8 + raw_score * 0.2), 4)) / 2.0, 4) AS agent_technical,
  CASE WHEN coalesce(job_category = category, false) THEN 0.75 ELSE 0.6 END::DOUBLE AS agent_culture FROM pair_doc) a JOIN k_weights w USING (job_id)"""


@query("k25_heuristic_scores", "SELECT job_id, candidate_id, agent_skill, agent_experience, agent_technical, agent_culture FROM k_agent", CT)
def _(i):
    return ma.agent_scores(i.pair_doc()).select(*P, *[f"agent_{k}" for k in sc.DIMENSIONS])


@query("k26_exact_skill_overlap", f"SELECT job_id, candidate_id, {_COV} AS score FROM pair_doc")
def _(i):
    return i.pair_doc().select(*P, sc.exact_overlap(F.col("required_skills"), F.col("skills")).alias("score"))


@query("k27_weight_negotiation", "SELECT job_id, r0 AS r_skill, r1 AS r_experience, r2 AS r_technical, r3 AS r_culture, h0 AS h_skill, h1 AS h_experience, h2 AS h_technical, h3 AS h_culture, f0 AS f_skill, f1 AS f_experience, f2 AS f_technical, f3 AS f_culture FROM k_weights", CT)
def _(i):
    w = sc.negotiate_weights(F.col("min_years"), F.size("required_skills"))
    return i.job_doc().select("job_id", *[w[who][k].alias(f"{who[0]}_{k}") for who in w for k in sc.DIMENSIONS])


@query("k28_normalize_weights", "SELECT o_orderkey, CASE WHEN t > 0 THEN round(a / t, 4) ELSE 0.35 END::DOUBLE AS skill, CASE WHEN t > 0 THEN round(b / t, 4) ELSE 0.3 END::DOUBLE AS experience, CASE WHEN t > 0 THEN round(c / t, 4) ELSE 0.2 END::DOUBLE AS technical, CASE WHEN t > 0 THEN round(e / t, 4) ELSE 0.15 END::DOUBLE AS culture FROM (SELECT *, a + b + c + e AS t FROM (SELECT o_orderkey, (o_orderkey % 3)::DOUBLE AS a, (o_orderkey % 6 // 3)::DOUBLE AS b, (o_custkey % 2)::DOUBLE AS c, (o_orderkey % 2)::DOUBLE AS e FROM orders))")
def _(i):
    k = F.col("o_orderkey")
    w = sc.normalize_weights({"skill": (k % 3).cast("double"), "experience": F.floor(k % 6 / 3).cast("double"), "technical": (F.col("o_custkey") % 2).cast("double"), "culture": (k % 2).cast("double")})
    return i.base("orders").select("o_orderkey", *[w[n].alias(n) for n in sc.DIMENSIONS])


@query("k29_weighted_score", "SELECT job_id, candidate_id, agent_weighted FROM k_agent", CT)
def _(i):
    return ma.agent_scores(i.pair_doc()).select(*P, "agent_weighted")


_S25 = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
_EV_TERMS = ["the", "of and", "es ", "le", "in", "un"]


@query("k30_evidence_sentences", f"""
SELECT doc_id, coalesce(string_agg(s, '|' ORDER BY rn), '') AS evidence FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS rn FROM (
  SELECT doc_id, s, max(n) AS n, arg_min(i, (-n, i)) AS i FROM (SELECT doc_id, s, i, {' + '.join(f'CAST(contains(lower(s), {d.q(t.strip())}) AS INT)' for t in _EV_TERMS)} AS n FROM (
    SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, {_S25} AS x FROM documents))) WHERE n > 0 AND length(s) >= 25 GROUP BY 1, 2)) WHERE rn <= 4 GROUP BY 1""")
def _(i):
    ev = sc.evidence_sentences(F.col("text"), F.array(*[F.lit(t) for t in _EV_TERMS]))
    return i.spread("documents", "doc_id").select("doc_id", F.array_join(ev, "|").alias("evidence")).where("evidence <> ''")


@query("k31_grounded_explanation", f"""SELECT job_id, candidate_id, {sentence_sql()} || format('Scores/weights: skill={{:.2f}}, experience={{:.2f}}, technical={{:.2f}}, culture={{:.2f}}; final weights skill={{:.2f}}, experience={{:.2f}}, technical={{:.2f}}, culture={{:.2f}}.',
 len(skills) / 64.0, 0.25, 0.5, 0.75, 0.35, 0.3, 0.25, 0.1) AS explanation FROM k_sent""", CT)
def _(i):
    s = {"skill": F.size("skills") / 64.0, "experience": F.lit(0.25), "technical": F.lit(0.5), "culture": F.lit(0.75)}
    w = {"skill": F.lit(0.35), "experience": F.lit(0.3), "technical": F.lit(0.25), "culture": F.lit(0.1)}
    return i.pair_doc().select(*P, sc.grounded_explanation(F.col("required_skills"), F.col("skills"), s, w).alias("explanation"))


@query("k34_evidence_lists", """
SELECT candidate_id, title || ' at ' || company AS line, 'Handled ' || title || ' orders for ' || company || repeat('.', 200) AS project FROM experience_item GROUP BY ALL""")
def _(i):
    x = i.experience_item().select("candidate_id", "title", "company", F.concat(
        F.lit("Handled "), "title", F.lit(" orders for "), "company", F.repeat(F.lit("."), F.lit(200))).alias("description"))
    rows = x.distinct().withColumn("items", F.array(F.struct("title", "company", "description")))
    return rows.select("candidate_id", F.get(sc.distinct_lines(F.col("items")), F.lit(0)).alias("line"), F.get(sc.project_evidence(F.col("items")), F.lit(0)).alias("project")).distinct()


# ---- the whole match over all jobs --------------------------------------
# Filters decide who may be found at all, then: hybrid search -> rerank gate and blend -> shortlist -> scores -> audit.
_NEED = "CASE lower(education) WHEN 'bachelor' THEN 1 WHEN 'master' THEN 2 WHEN 'phd' THEN 3 ELSE 0 END"
_HITPAIR = d.CTES["pair_doc"].replace("FROM pair p", "FROM (SELECT job_id, candidate_id, score AS raw_score, 1 AS n_applications, new_rank AS hit_rank FROM short) p")
WIDE, SHORT, JUDGED = 20, 10, 4
_GATE = """SELECT job_id, tie AND amb AND NOT strong AND n >= 2 AS apply_rerank FROM (
 SELECT g.*, b[1] - b[2] <= 0.015 AS tie, 0.5 + (s_suppkey % 5) * 0.1 < 0.65 OR (s_suppkey % 3) * 0.3 > 0.5 AS amb,
  top_f >= 0.45 AND len(list_intersect(d.required_skills, c.pool)) / len(d.required_skills) >= 0.6 AS strong
 FROM (SELECT job_id, count(*) AS n, list(fusion_score ORDER BY fusion_score DESC) AS b, arg_min(candidate_id, rank) AS cid, arg_min(fusion_score, rank) AS top_f FROM hit WHERE rank <= 8 GROUP BY 1) g
 JOIN job j USING (job_id) JOIN job_doc d USING (job_id) JOIN doc_pool c ON c.candidate_id = g.cid)"""
CT33 = {
    "eligible": f"SELECT job_id, candidate_id FROM (SELECT job_id, {EDU} AS education, {REG} AS wanted_region FROM job) CROSS JOIN candidate WHERE {EDU_OK} AND {REG_OK}",
    **CT, "vec_hit": CT["vec_hit"].replace("rank <= 30", f"rank <= {3 * WIDE}").replace(
        "FROM job_vector j JOIN candidate_vector c\n ON ", "FROM job_vector j JOIN eligible e USING (job_id) JOIN candidate_vector c\n ON c.candidate_id = e.candidate_id AND "),
    "kw_scored": CT["kw_scored"].replace("FROM job_doc j JOIN doc_pool c ON ", "FROM job_doc j JOIN eligible e USING (job_id) JOIN doc_pool c ON c.candidate_id = e.candidate_id AND "),
    "kw_hit": CT["kw_hit"].replace("rank <= 30", f"rank <= {3 * WIDE}"), "hit": CT["hit"].replace("rank <= 10", f"rank <= {WIDE}"),
    "gate": _GATE,
    "short": f"""SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY h.job_id ORDER BY CASE WHEN coalesce(apply_rerank, false)
  THEN round(0.75::DOUBLE * coalesce(relevance, fusion_score) + 0.25::DOUBLE * fusion_score, 6) ELSE -rank END DESC, rank) AS new_rank
  FROM hit h LEFT JOIN gate g USING (job_id) LEFT JOIN k_rel r USING (job_id, candidate_id)) WHERE new_rank <= {SHORT}""",
    "pair_doc": _HITPAIR, "k_adj": CT["k_adj"].replace("FROM pair p", "FROM (SELECT job_id, candidate_id FROM short) p"),
}


def constrained(i):
    """Jobs, job vectors, documents and vectors with the columns that the search filters on."""
    needs = job_filters(i).select("job_id", fa.education_need(F.col("education")).alias("need_level"), F.coalesce(tx.normalize_region(F.col("region")), F.lit("")).alias("place"))
    has = i.candidate().select("candidate_id", fa.education_level(F.array("degree")).alias("level_no"), F.array_join(fa.locations(F.array("location")), "|").alias("places"))
    return (i.written("job_doc").join(needs, "job_id"), i.job_vector().join(needs, "job_id"), i.written("candidate_doc").join(has, "candidate_id"),
            i.candidate_vector().join(has, "candidate_id"))


def explanation():
    """What a match says about itself: grounded in the agents' scores where they judged it, else in the deterministic ones."""
    c = F.col
    plain = sc.deterministic_explanation(
        c("required_skills"), c("skills"), *[c(n) for n in ("semantic_similarity", "skill_overlap", "experience_fit", "seniority_fit", "must_have_rate")])
    judged = sc.grounded_explanation(
        c("required_skills"), c("skills"), {k: c(f"agent_{k}") for k in sc.DIMENSIONS}, {k: c(f"weight_{k}") for k in sc.DIMENSIONS})
    return F.when(c("evaluated"), judged).otherwise(plain)


def match_rows(i, jobs):
    """Every job's shortlist with scores, place and explanation, for jobs given as profiles (columns of ``job_doc``)."""
    from matchloom.operators.search import hybrid_search, pooled
    _, vectors, docs, items = constrained(i)
    hits = materialize(hybrid_search(jobs, vectors, docs, items, WIDE), "match-hits")  # one search, read by three steps
    k = F.col("s_suppkey")
    query = i.job().select("job_id", (0.5 + (k % 5) * 0.1).alias("confidence"), ((k % 3) * 0.3).alias("unknown_ratio"))
    req = sc.lower_set(F.col("required_skills"))
    cover = hits.where("rank = 1").select(*P).join(jobs.select("job_id", "required_skills"), "job_id").join(i.written("candidate_doc"), "candidate_id")
    gate = ma.rerank_gate(hits, query, pooled(cover).select(*P, sc.share(F.array_intersect(req, F.col("pool")), req).alias("coverage")))
    short = materialize(ma.shortlist(hits, gate, relevance(i, hits), SHORT).select(*P, F.col("score").alias("raw_score")), "match-short")
    wanted = jobs.select("job_id", F.col("category").alias("job_category"), "min_years", "preferred_seniority", "industry", "required_skills", "related_skills", "terms",
                         sc.job_skills(F.col("required_skills"), F.col("related_skills")).alias("job_skills"))
    found = i.written("candidate_doc").join(short.select("candidate_id").distinct(), "candidate_id", "left_semi").withColumn(
        "candidate_skills", sc.candidate_skills(F.col("core_skills"), F.col("expanded_skills"), F.col("skills")))
    full = materialize(short.join(wanted, "job_id").join(found, "candidate_id"), "match-pairs")
    m = ma.agent_scores(ma.match_scores(with_adjacent(i, full, found, jobs)))
    det = sc.rnd(ma.penalised(F.col("deterministic_score"), F.col("must_have_penalty")), 6)
    blend = sc.rnd(ma.penalised(sc.final_rank(F.col("deterministic_score"), F.col("agent_weighted")), F.col("must_have_penalty")), 6)
    done = ma.judged(m.withColumn("rank_score", det).withColumn("blend_score", blend), JUDGED)
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("evaluated"), F.desc("score"), "candidate_id"))
    return done.withColumn("position", place.cast("long")).withColumn("explanation", explanation())


def match_all(i, jobs):
    """(job_id, candidate_id, score, evaluated, position, warnings)."""
    codes = fr.row_codes(F.col("summary"), F.col("explanation"), F.col("weight_culture"), F.col("agent_culture"), F.col("must_have_rate"), F.col("score"))
    return match_rows(i, jobs).select(*P, sc.r4(F.col("score")).alias("score"), "evaluated", "position", F.array_join(codes, "|").alias("warnings"))


@query("k33_match_all_jobs", f"""
SELECT job_id, candidate_id, round(score, 4) AS score, evaluated, row_number() OVER (PARTITION BY job_id ORDER BY evaluated DESC, score DESC, candidate_id) AS position,
 concat_ws('|', CASE WHEN len(regexp_extract_all(lower(said), {d.q(tx.SENSITIVE_RE)}, 1)) > 0 THEN 'sensitive_term_in_candidate_explanation' END,
  CASE WHEN culture > 0.2 THEN 'culture_weight_over_cap' END, CASE WHEN must_have_rate < 0.5 AND agent_culture > 0.7 AND score >= 0.7 THEN 'must_have_underfit_high_culture' END) AS warnings FROM (
 SELECT *, er <= {JUDGED} AS evaluated, round(CASE WHEN er <= {JUDGED} THEN greatest(0.0, least(1.0, (deterministic_score * 0.30 + agent_weighted * 0.70) * (1.0 - must_have_penalty))) ELSE rank_score END, 6) AS score FROM (
  SELECT f.*, agent_weighted, agent_culture, w.f3 AS culture, said, row_number() OVER (PARTITION BY job_id ORDER BY round(rank_score, 6) DESC, candidate_id) AS er FROM k_final f
  JOIN (SELECT job_id, candidate_id, agent_weighted, agent_culture FROM k_agent) g USING (job_id, candidate_id) JOIN k_weights w USING (job_id)
  JOIN (SELECT job_id, candidate_id, concat_ws(' ', summary, {sentence_sql()}) AS said FROM k_sent) t USING (job_id, candidate_id)))""", CT33)
def _(i):
    return match_all(i, constrained(i)[0])


CT33B = {**CT33, **pfair.CT, "g_rank": f"""
SELECT job_id, candidate_id, summary, explanation, culture AS culture_weight, agent_culture AS culture_confidence, must_have_rate, score, seniority_level, preferred_seniority,
 row_number() OVER (PARTITION BY job_id ORDER BY evaluated DESC, score DESC, candidate_id) AS position FROM (
 SELECT *, round(CASE WHEN evaluated THEN greatest(0.0, least(1.0, (deterministic_score * 0.30 + agent_weighted * 0.70) * (1.0 - must_have_penalty))) ELSE rank_score END, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY round(rank_score, 6) DESC, candidate_id) <= {JUDGED} AS evaluated FROM (
   SELECT f.* EXCLUDE (summary), agent_weighted, agent_culture, w.f3 AS culture, t.summary, t.explanation FROM k_final f
   JOIN (SELECT job_id, candidate_id, agent_weighted, agent_culture FROM k_agent) g USING (job_id, candidate_id) JOIN k_weights w USING (job_id)
   JOIN (SELECT job_id, candidate_id, summary, {sentence_sql()} AS explanation FROM k_sent) t USING (job_id, candidate_id))))"""}


@query("k33b_match_audit", " UNION ALL ".join(f"SELECT {', '.join(pfair.COLS)} FROM {t}" for t in ("g_q", "g_c", "g_w", "g_u", "g_s")), CT33B)
def _(i):
    """The warnings of the whole run: on the job texts, on every match, and on what a job's top results have in common."""
    m = match_rows(i, constrained(i)[0]).select(
        *P, "position", "summary", "explanation", F.col("weight_culture").alias("culture_weight"), F.col("agent_culture").alias("culture_confidence"), "must_have_rate", "score",
        "seniority_level", "preferred_seniority")
    return fr.audit(i.job_text(), m, SHORT).select(pfair.COLS)
