"""Queries over the skill ontology."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import ontology as on
from matchloom.plans import duck as d
from matchloom.plans.registry import query

# Raw skills of a candidate: parts bought, plus a versioned tool named after the order.
RAW = """SELECT candidate_id, skill AS token FROM candidate_skill
UNION SELECT 'cust-' || o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 'microsoft sql server 2008 r2' WHEN 1 THEN 'oracle 11g' WHEN 2 THEN 'windows 10'
 WHEN 3 THEN 'heavy ' || lower(split_part(o_orderpriority, '-', 2)) || ' bare gizmos' ELSE 'led ' || lower(split_part(o_orderpriority, '-', 2)) END FROM orders"""
CT = {
    "raw_token": RAW,
    "canon": "SELECT candidate_id, coalesce(a.canonical, t.token) AS canonical, bool_or(coalesce(a.canonical, t.token) <> t.token) AS aliased FROM raw_token t LEFT JOIN alias_map a ON a.alias = t.token GROUP BY 1, 2",
    "loose": """SELECT token, arg_min(skill, (1000 - length(skill), skill)) AS skill FROM (SELECT DISTINCT canonical AS token FROM canon WHERE canonical NOT IN (SELECT skill FROM taxonomy)) c
 JOIN taxonomy t ON length(t.skill) >= 5 AND contains(c.token, t.skill) GROUP BY 1""",
    "core": "SELECT DISTINCT candidate_id, skill FROM (SELECT candidate_id, CASE WHEN t.skill IS NOT NULL THEN c.canonical ELSE l.skill END AS skill FROM canon c LEFT JOIN taxonomy t ON t.skill = c.canonical LEFT JOIN loose l ON l.token = c.canonical) WHERE skill IS NOT NULL",
    "expanded": "SELECT candidate_id, skill FROM core UNION SELECT candidate_id, parent FROM core JOIN taxonomy USING (skill) WHERE parent IS NOT NULL",
    "tagset": "SELECT token, kind FROM (VALUES ('widget', 'role'), ('plate', 'role'), ('led urgent', 'capability'), ('led high', 'capability'), ('new gear', 'review'), ('hot rod', 'review')) x(token, kind)",
}


def raw_tokens(i):
    pri = F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)))
    k = F.col("o_orderkey") % 5
    tool = (F.when(k == 0, "microsoft sql server 2008 r2").when(k == 1, "oracle 11g").when(k == 2, "windows 10")
            .when(k == 3, F.concat(F.lit("heavy "), pri, F.lit(" bare gizmos"))).otherwise(F.concat(F.lit("led "), pri)))
    bought = i.candidate_skill().select("candidate_id", F.col("skill").alias("token"))
    return bought.unionByName(i.base("orders").select(F.concat(F.lit("cust-"), F.col("o_custkey")).alias("candidate_id"), tool.alias("token"))).distinct()


def tagset(i, kind):
    rows = [("widget", "role"), ("plate", "role"), ("led urgent", "capability"), ("led high", "capability"), ("new gear", "review"), ("hot rod", "review")]
    return i.spark.createDataFrame([(t,) for t, k in rows if k == kind], "token string")


def versions(i):
    return i.spark.createDataFrame([("windows 10", "windows desktop", "10")], "token string, canonical string, version string")


def canon(i):
    return on.canonicalize(raw_tokens(i).withColumn("pos", F.lit(0)), i.alias_map(), "candidate_id")


def ontology(i):
    return on.Ontology(i.alias_map(), i.taxonomy(), tagset(i, "role"), tagset(i, "capability"), tagset(i, "review"), versions(i))


@query("o01_ontology_dimensions", """
SELECT 'skill' AS kind, skill AS name, coalesce(domain, '') || '/' || coalesce(family, '') || '/' || coalesce(parent, '') AS detail FROM taxonomy
UNION ALL SELECT 'alias', alias, canonical FROM alias_map UNION ALL SELECT kind, token, '' FROM tagset""", CT)
def _(i):
    o = ontology(i)
    def named(df, col, kind):
        return df.select(F.lit(kind).alias("kind"), F.col(col).alias("name"), F.lit("").alias("detail"))
    return (
        o.taxonomy.select(F.lit("skill").alias("kind"), F.col("skill").alias("name"),
                          F.concat("domain", F.lit("/"), "family", F.lit("/"), F.array_join("parents", ",")).alias("detail"))
        .unionByName(o.alias_map.select(F.lit("alias").alias("kind"), F.col("alias").alias("name"), F.col("canonical").alias("detail")))
        .unionByName(named(o.roles, "token", "role")).unionByName(named(o.capabilities, "token", "capability")).unionByName(named(o.review, "token", "review")))


@query("o02_canonicalize", "SELECT candidate_id, canonical, aliased FROM canon", CT)
def _(i):
    return canon(i).select("candidate_id", "canonical", "aliased")


@query("o03_exact_core", "SELECT candidate_id, canonical AS skill FROM canon WHERE canonical IN (SELECT skill FROM taxonomy)", CT)
def _(i):
    return on.exact_core(canon(i), i.taxonomy()).select("candidate_id", F.col("canonical").alias("skill"))


@query("o04_longest_contained", "SELECT token, skill FROM loose", CT)
def _(i):
    unmatched = canon(i).join(i.taxonomy().select(F.col("skill").alias("canonical")), "canonical", "left_anti")
    return on.longest_contained(unmatched.select(F.col("canonical").alias("token")), i.taxonomy())


@query("o05_expand_parents", "SELECT candidate_id, skill FROM expanded", CT)
def _(i):
    core = on.core_skills(canon(i), i.taxonomy(), "candidate_id")
    return on.expand_parents(core, i.taxonomy(), "candidate_id").select("candidate_id", "skill")


@query("o06_tag_sets", "SELECT candidate_id, canonical AS token, kind FROM canon JOIN tagset ON token = canonical", CT)
def _(i):
    c = canon(i)
    parts = [on.tag_members(c, tagset(i, k)).select("candidate_id", F.col("canonical").alias("token"), F.lit(k).alias("kind")) for k in ("role", "capability", "review")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


CT["versioned"] = f"""SELECT candidate_id, token, CASE WHEN token = 'windows 10' THEN 'windows desktop' ELSE replace(replace(canonical, 'microsoft sql server', 'sql server'), 'ms sql server', 'sql server') END AS canonical, version FROM (
 SELECT candidate_id, canonical AS token, coalesce({', '.join(f"nullif(regexp_extract(canonical, {d.q(rx)}, 1), '')" for rx in on.VERSION_PATTERNS)}) AS canonical,
 coalesce({', '.join(f"nullif(regexp_extract(canonical, {d.q(rx)}, 2), '')" for rx in on.VERSION_PATTERNS)}) AS version FROM canon) WHERE version IS NOT NULL"""


@query("o07_versioned_skills", "SELECT candidate_id, token, canonical, version FROM versioned", CT)
def _(i):
    toks = canon(i).select("candidate_id", F.col("canonical").alias("token"))
    return on.versioned(toks, versions(i)).select("candidate_id", "token", "canonical", "version")


def _agg(table, col, where="true"):
    return f"SELECT candidate_id, string_agg({col}, '|' ORDER BY {col}) AS v FROM {table} WHERE {where} GROUP BY 1"


@query("o08_normalize", f"""
SELECT c.candidate_id, {', '.join(f"coalesce({t}.v, '') AS {n}" for t, n in [('a', 'canonical_skills'), ('b', 'core_skills'), ('e', 'expanded_skills'), ('p', 'capability_phrases'), ('r', 'role_candidates'), ('w', 'review_required_skills'), ('x', 'versioned_skills')])},
 f.f AS alias_applied FROM candidate c JOIN ({_agg('canon', 'canonical')}) a USING (candidate_id)
JOIN (SELECT candidate_id, bool_or(aliased) AS f FROM canon GROUP BY 1) f USING (candidate_id)
LEFT JOIN ({_agg('core', 'skill')}) b USING (candidate_id) LEFT JOIN ({_agg('expanded', 'skill')}) e USING (candidate_id)
LEFT JOIN ({_agg("canon JOIN tagset ON token = canonical", 'canonical', "kind = 'capability'")}) p USING (candidate_id)
LEFT JOIN ({_agg("canon JOIN tagset ON token = canonical", 'canonical', "kind = 'role'")}) r USING (candidate_id)
LEFT JOIN ({_agg("canon JOIN tagset ON token = canonical", 'canonical', "kind = 'review'")}) w USING (candidate_id)
LEFT JOIN ({_agg('(SELECT candidate_id, token || chr(61) || canonical || chr(64) || version AS z FROM versioned)', 'z')}) x USING (candidate_id)""", CT)
def _(i):
    lists = raw_tokens(i).groupBy("candidate_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    r = on.normalize(lists, "candidate_id", F.col("tokens"), ontology(i))
    names = ["canonical_skills", "core_skills", "expanded_skills", "capability_phrases", "role_candidates", "review_required_skills", "versioned_skills"]
    return r.select("candidate_id", *[F.array_join(F.array_sort(n), "|").alias(n) for n in names], "alias_applied")


CT["seed"] = "SELECT job_id, ord AS pos, coalesce(a.canonical, skill) AS skill FROM job_skill LEFT JOIN alias_map a ON a.alias = skill WHERE coalesce(a.canonical, skill) IN (SELECT skill FROM taxonomy) QUALIFY row_number() OVER (PARTITION BY job_id, coalesce(a.canonical, skill) ORDER BY ord) = 1"


def seeds(i):
    toks = i.job_skill().select("job_id", F.col("ord").alias("pos"), F.col("skill").alias("token"))
    c = on.canonicalize(toks, i.alias_map(), "job_id").withColumnRenamed("canonical", "skill")
    return c.join(i.taxonomy().select("skill"), "skill", "left_semi").select("job_id", "pos", "skill")


@query("o09_adjacent_skills", """
SELECT job_id, n, skill, skill || ' is adjacent to ' || seed || ' via shared ' || why || ' ''' || tag || '''.' AS evidence FROM (
 SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY pos, skill) AS n FROM (
 SELECT s.job_id, s.pos, s.skill AS seed, t.skill, CASE WHEN t.domain = m.domain THEN 'domain' WHEN t.family = m.family THEN 'family' ELSE 'parent' END AS why,
  CASE WHEN t.domain = m.domain THEN m.domain WHEN t.family = m.family THEN m.family ELSE m.parent END AS tag
 FROM seed s JOIN taxonomy m ON m.skill = s.skill JOIN taxonomy t ON (t.domain = m.domain OR t.family = m.family OR t.parent = m.parent)
 WHERE NOT EXISTS (SELECT 1 FROM seed z WHERE z.job_id = s.job_id AND z.skill = t.skill))) WHERE n <= 12""", CT)
def _(i):
    return on.adjacent_skills(seeds(i), i.taxonomy(), "job_id")


CT["jt"] = "SELECT job_id, coalesce(a.canonical, skill) AS skill FROM job_skill LEFT JOIN alias_map a ON a.alias = skill GROUP BY ALL"
CT["ctok"] = "SELECT candidate_id, coalesce(a.canonical, skill) AS skill FROM candidate_skill LEFT JOIN alias_map a ON a.alias = skill GROUP BY ALL"
ADJ_SQL = """SELECT p.job_id, p.candidate_id, c.skill FROM pair p JOIN ctok c USING (candidate_id) LEFT JOIN taxonomy x ON x.skill = c.skill
 WHERE EXISTS (SELECT 1 FROM {jt} j LEFT JOIN taxonomy y ON y.skill = j.skill WHERE j.job_id = p.job_id AND (j.skill = c.skill OR x.domain = y.domain OR x.family = y.family OR x.parent = y.parent))"""


@query("o10_adjacent_match_score", f"""
SELECT p.job_id, p.candidate_id, least(1.0, round(least(coalesce(m.n, 0), 10) / r.n, 4)) AS score FROM pair p JOIN (SELECT job_id, count(*) AS n FROM jt GROUP BY 1) r USING (job_id)
LEFT JOIN (SELECT job_id, candidate_id, count(*) AS n FROM ({ADJ_SQL.format(jt='jt')}) GROUP BY 1, 2) m USING (job_id, candidate_id)""", CT)
def _(i):
    def canonical(df, key):
        return on.canonicalize(df.select(key, F.col("skill").alias("token"), F.lit(0).alias("pos")), i.alias_map(), key).select(key, F.col("canonical").alias("skill"))
    prof = on.relation_profile(canonical(i.job_skill(), "job_id"), i.taxonomy(), "job_id", "j_")
    facts = on.skill_facts(canonical(i.candidate_skill(), "candidate_id"), i.taxonomy(), "candidate_id")
    j = i.pair().join(prof, "job_id").join(facts, "candidate_id", "left")
    m = on.adjacent_matches(F.col("facts"), F.col("j_skills"), F.col("j_domains"), F.col("j_families"), F.col("j_parents"), 10)
    return j.select("job_id", "candidate_id", on.adjacent_score(m, F.col("j_skills")).alias("score"))


@query("o11_text_ngrams", """
SELECT DISTINCT job_id, canonical FROM job_text t JOIN (SELECT alias, canonical FROM alias_map UNION ALL SELECT skill, skill FROM taxonomy) v
ON regexp_matches(' ' || array_to_string(regexp_extract_all(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ,;:/|'), '[a-zA-Z0-9+.#-]+', 0), '  ') || ' ', ' ' || replace(v.alias, ' ', '  ') || ' ')""")
def _(i):
    vocab = i.alias_map().unionByName(i.taxonomy().select(F.col("skill").alias("alias"), F.col("skill").alias("canonical")))
    return on.ngram_hits(i.job_text(), "job_id", vocab).select("job_id", "canonical")
