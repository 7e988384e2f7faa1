"""Queries over résumé structuring."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import resume as rs
from matchloom.functions import text as tx
from matchloom.functions.dates import LEAD_WORDS
from matchloom.operators import experience as ex
from matchloom.operators import ontology as on
from matchloom.plans import duck as d
from matchloom.plans.registry import query

_HEAD = "lower(trim(regexp_replace(line, '[^a-zA-Z ]+', '', 'g')))"


def _header_sql():
    taken, parts = set(), []
    for name, words in rs.SECTIONS.items():
        parts.append(f"WHEN {_HEAD} IN ({', '.join(d.q(w) for w in words if w not in taken)}) THEN {d.q(name)}")
        taken.update(words)
    return f"CASE WHEN length(line) <= 45 THEN CASE {' '.join(parts)} END END"


_LINES = f"""SELECT resume_id, pos, line, {_header_sql()} AS h FROM (
  SELECT resume_id, pos, {d.squash('raw')} AS line FROM (SELECT resume_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM resume))
  WHERE line <> ''"""
CT = {
    "res_line": _LINES,
    "res_tagged": "SELECT resume_id, pos, line, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY resume_id ORDER BY pos), 'root') AS sec, h FROM res_line",
    "res_body": "SELECT resume_id, sec, pos, line FROM res_tagged WHERE h IS NULL",
    "res_section": "SELECT resume_id, sec, string_agg(line, chr(10) ORDER BY pos) AS body FROM res_body GROUP BY 1, 2",
}


def tagged(i):
    return i.resume().withColumn("tagged", rs.tagged_lines(F.col("text")))


@query("p01_split_sections", "SELECT resume_id, sec AS section, body FROM res_section", CT)
def _(i):
    secs = F.explode(F.array_distinct(F.transform("tagged", lambda e: e["sec"])))
    return tagged(i).select("resume_id", "tagged", secs.alias("section")).select(
        "resume_id", "section", F.array_join(F.transform(F.filter("tagged", lambda e: e["sec"] == F.col("section")), lambda e: e["line"]), "\n").alias("body"))


@query("p02_header_recognition", "SELECT resume_id, line, h AS header FROM res_line", CT)
def _(i):
    return i.resume().select("resume_id", F.explode(rs.lines(F.col("text"))).alias("line")).select(
        "resume_id", "line", rs.header_of(F.col("line")).alias("header"))


_CONTACT = f"nullif(regexp_extract(text, {d.q(rs.EMAIL)}, 1), '') AS email, nullif({d.squash(f'regexp_extract(text, {d.q(rs.PHONE)}, 1)')}, '') AS phone"


@query("p03_contacts", f"SELECT 'r-' || resume_id AS id, {_CONTACT} FROM resume UNION ALL SELECT 'd-' || doc_id, {_CONTACT} FROM documents")
def _(i):
    both = i.resume().select(F.concat(F.lit("r-"), F.col("resume_id")).alias("id"), "text").unionByName(
        i.spread("documents", "doc_id").select(F.concat(F.lit("d-"), F.col("doc_id")).alias("id"), "text"))
    return both.select("id", rs.email(F.col("text")).alias("email"), rs.phone(F.col("text")).alias("phone"))


_TITLE = "array_to_string(list_transform(string_split(lower(n), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query("p04_person_name", f"""
SELECT r.resume_id, {_TITLE} AS name FROM resume r LEFT JOIN (
 SELECT resume_id, arg_min(line, rn) AS n FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY pos) AS rn FROM res_body WHERE sec = 'root')
 WHERE NOT regexp_matches(lower(line), {d.q(rs.NOT_A_NAME)}) AND len(string_split(line, ' ')) BETWEEN 2 AND 4
   AND NOT regexp_matches(line, {d.q(rs.NAME_SYMBOLS)})
   AND len(list_filter(string_split(line, ' '), lambda w: w = upper(w) AND w <> lower(w) AND length(w) > 5)) = 0 GROUP BY 1) x ON x.resume_id = r.resume_id""", CT)
def _(i):
    return tagged(i).select("resume_id", rs.person_name(rs.section_lines(F.col("tagged"), "root")).alias("name"))


def _valid(x):
    t = f"regexp_replace({x}, {d.q('^' + d.WS + '+|' + d.WS + '+$')}, '', 'g')"
    return (f"length({t}) BETWEEN 2 AND 50 AND NOT regexp_matches(lower({t}), {d.q(rs.SKILL_PREFIX_NOISE)}) "
            f"AND NOT regexp_matches(lower({t}), {d.q(rs.SKILL_INNER_NOISE)}) AND length(regexp_replace({t}, '\\P{{L}}', '', 'g')) >= 2")


_CI = "list_filter({0}, lambda x, i: x <> '' AND list_position(list_transform({0}, lambda y: lower(y)), lower(x)) = i)"
CT["res_skill"] = f"""
SELECT resume_id, coalesce({_CI.format('b')}, []) AS skills FROM (
 SELECT resume_id, list_transform(list_filter(string_split_regex(src, {d.q(rs.SKILL_SPLIT)}), lambda x: {_valid('x')}), lambda x: {d.squash('x')}) AS b
 FROM (SELECT r.resume_id, coalesce(s.body, nullif(regexp_extract(text, {d.q(rs.SKILL_HEADING)}, 1), '')) AS src
   FROM resume r LEFT JOIN res_section s ON s.resume_id = r.resume_id AND s.sec = 'skills'))"""


@query("p05_skill_list", f"SELECT resume_id, {d.join('skills')} AS skills FROM res_skill", CT)
def _(i):
    return tagged(i).select("resume_id", F.array_join(rs.skills(F.col("tagged"), F.col("text")), "|").alias("skills"))


@query("p06_valid_skill", f"""
SELECT doc_id, tok AS token, {_valid('tok')} AS valid FROM (SELECT doc_id, unnest(string_split_regex(text, {d.q(rs.SKILL_SPLIT)})) AS tok FROM documents)""")
def _(i):
    return i.spread("documents", "doc_id").select("doc_id", F.explode(F.split("text", rs.SKILL_SPLIT)).alias("token")).select(
        "doc_id", "token", rs.valid_skill(F.col("token")).alias("valid"))


@query("p07_fallback_skills", f"""
SELECT resume_id, {d.join('raw')} AS raw, {d.join(d.dedupe('n'))} AS normalized FROM (
 SELECT resume_id, raw, list_transform(raw, lambda x: {d.normalize_skill('x')}) AS n FROM (
 SELECT resume_id, list_filter(b, lambda x, i: list_position(b, x) = i) AS raw FROM (
 SELECT resume_id, list_filter(list_transform(CASE WHEN regexp_matches(text, '(?i)\\bskills\\b') THEN
   string_split_regex(regexp_extract(text, '(?is)\\bskills\\b(.*)', 1), '[,\\n;|]') ELSE [] END, lambda x: {d.clean_text('x')}), lambda x: x IS NOT NULL) AS b FROM resume)))""")
def _(i):
    t = F.col("text")
    return i.resume().select("resume_id", F.array_join(rs.fallback_skills(t), "|").alias("raw"),
                             F.array_join(rs.fallback_skills_normalized(t), "|").alias("normalized"))


@query("p08_alias_hints", f"""
SELECT resume_id, {d.join(d.dedupe('h'))} AS hints FROM (SELECT resume_id, list(canonical ORDER BY length(alias) DESC, alias) AS h FROM (
 SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY length(alias) DESC, alias) AS rn FROM (
 SELECT r.resume_id, a.alias, a.canonical FROM resume r JOIN vocab a ON length(a.alias) >= 3
  AND regexp_matches(' ' || regexp_replace(lower(r.text), {d.q(d.WS + '+')}, ' ', 'g') || ' ', '(^|[^a-z0-9])' || a.alias || '([^a-z0-9]|$)')))
 WHERE rn <= 30 GROUP BY 1)""", {"vocab": "SELECT alias, canonical FROM alias_map UNION ALL SELECT skill, skill FROM taxonomy"})
def _(i):
    vocab = i.alias_map().unionByName(i.taxonomy().select(F.col("skill").alias("alias"), F.col("skill").alias("canonical")))
    return on.alias_hints(i.resume().select("resume_id", "text"), "resume_id", vocab, 30).select(
        "resume_id", F.array_join("hints", "|").alias("hints"))


def _date1(c):
    return f"nullif(regexp_extract({c}, {d.q(rs.DATE_WORD)}, 1), '')"


@query("p09_education_lines", f"""
SELECT resume_id, line AS degree, {_date1('line')} AS start_date FROM res_body WHERE sec = 'education' AND regexp_matches(lower(line), {d.q(rs.DEGREE_WORDS)})""", CT)
def _(i):
    return tagged(i).select("resume_id", F.explode(rs.education_lines(F.col("tagged"))).alias("e")).select("resume_id", "e.degree", "e.start_date")


_FLAT = f"regexp_replace(text, {d.q(d.WS + '+')}, ' ', 'g')"
CT["all_text"] = "SELECT 'r-' || resume_id AS id, text FROM resume UNION ALL SELECT 'd-' || doc_id, text FROM documents"


@query("p10_education_scan", f"""
SELECT id, degree, institution, start_date FROM (SELECT *, row_number() OVER (PARTITION BY id, lower(coalesce(degree, '')), lower(coalesce(institution, '')) ORDER BY kind, pos) AS rn FROM (
 SELECT id, 1 AS kind, pos, c AS degree, NULL AS institution, {_date1('c')} AS start_date FROM (SELECT id, {d.squash('u')} AS c, pos FROM (
   SELECT id, unnest(x) AS u, generate_subscripts(x, 1) AS pos FROM (SELECT id, regexp_extract_all({_FLAT}, {d.q(rs.DEGREE_CHUNK)}, 1) AS x FROM all_text)))
 UNION ALL SELECT id, 2, pos, NULL, c, {_date1('c')} FROM (SELECT id, {d.squash('u')} AS c, pos FROM (
   SELECT id, unnest(x) AS u, generate_subscripts(x, 1) AS pos FROM (SELECT id, regexp_extract_all({_FLAT}, {d.q(rs.SCHOOL_CHUNK)}, 1) AS x FROM all_text))) WHERE length(c) >= 8)) WHERE rn = 1""", CT)
def _(i):
    both = i.resume().select(F.concat(F.lit("r-"), F.col("resume_id")).alias("id"), "text").unionByName(
        i.spread("documents", "doc_id").select(F.concat(F.lit("d-"), F.col("doc_id")).alias("id"), "text"))
    return both.select("id", F.explode(rs.education_scan(F.col("text"))).alias("e")).select("id", "e.degree", "e.institution", "e.start_date")


_T1 = "CASE WHEN contains(lower(t), ' at ') THEN string_split_regex(t, '(?i)\\s+at\\s+')[1] WHEN contains(t, ' - ') THEN split_part(t, ' - ', 1) WHEN contains(t, ',') THEN split_part(t, ',', 1) ELSE t END"
_T2 = """CASE WHEN contains(lower(t), ' at ') THEN regexp_replace(t, '(?i)^.*?\\s+at\\s+', '') WHEN contains(t, ' - ') THEN substring(t, strpos(t, ' - ') + 3)
 WHEN contains(t, ',') THEN substring(t, strpos(t, ',') + 1) END"""
CT["exp_line"] = f"""SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY pos) AS i, regexp_matches(line, {d.q(rs.DATE_RANGE)}) AS hit FROM res_body WHERE sec = 'experience'"""
CT["exp_block"] = f"""SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY resume_id ORDER BY i) AS block,
 lag(line) OVER (PARTITION BY resume_id ORDER BY i) AS prev, lag(hit) OVER (PARTITION BY resume_id ORDER BY i) AS prev_hit FROM exp_line"""
CT["exp_record"] = f"""
SELECT resume_id, block, {_T1} AS title, {_T2} AS company, start_date, end_date, description FROM (
 SELECT resume_id, block, nullif(trim(regexp_replace(CASE WHEN head = '' AND NOT prev_hit AND length(prev) < 80 THEN prev ELSE head END, {d.q(rs.TITLE_PREFIX)}, '')), '') AS t, start_date, end_date, description FROM (
 SELECT h.resume_id, h.block, trim(regexp_extract(h.line, {d.q('^(.*?)' + rs.DATE_RANGE)}, 1)) AS head, h.prev, h.prev_hit,
   regexp_extract(h.line, {d.q(rs.DATE_RANGE)}, 1) AS start_date, regexp_extract(h.line, {d.q(rs.DATE_RANGE)}, 2) AS end_date, b.description
 FROM exp_block h LEFT JOIN (SELECT resume_id, block, string_agg(line, ' ' ORDER BY i) AS description FROM exp_block WHERE NOT hit GROUP BY 1, 2) b
   ON b.resume_id = h.resume_id AND b.block = h.block WHERE h.hit))"""
EXP_COLS = ["title", "company", "start_date", "end_date", "description"]


@query("p11_experience_blocks", "SELECT resume_id, block, title, company, start_date, end_date, description FROM exp_record", CT)
def _(i):
    return tagged(i).select("resume_id", F.posexplode(rs.experience_blocks(F.col("tagged"))).alias("p", "e")).select(
        "resume_id", (F.col("p") + 1).cast("long").alias("block"), *[f"e.{c}" for c in EXP_COLS])


_RNG = d.q(rs.DATE_RANGE)


@query("p12_experience_scan", f"""
SELECT id, title, company, start_date, end_date, description FROM (
SELECT *, row_number() OVER (PARTITION BY id, lower({d.squash("coalesce(title,'')")}), lower({d.squash("coalesce(company,'')")}), lower(start_date), lower(end_date) ORDER BY i) AS rn FROM (
SELECT id, i, {_T1} AS title, {_T2} AS company, start_date, end_date, nullif(substring(right_ctx, 1, 200), '') AS description FROM (
SELECT id, i, {d.squash("trim(string_split(lft, '.')[-1])")} AS t, ss[i] AS start_date, es[i] AS end_date, right_ctx FROM (
SELECT *, trim(substring(flat, greatest(1, f - 139), least(f, 140))) AS lft, trim(substring(flat, f + length(whole[i]) + 1, 220)) AS right_ctx FROM (
SELECT *, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda g: length(g))), 0) AS BIGINT) AS f FROM (
SELECT *, unnest(generate_series(1, len(whole))) AS i FROM (
SELECT id, flat, regexp_extract_all(flat, {_RNG}, 0) AS whole, regexp_extract_all(flat, {_RNG}, 1) AS ss, regexp_extract_all(flat, {_RNG}, 2) AS es, string_split_regex(flat, {_RNG}) AS gaps
FROM (SELECT id, {_FLAT} AS flat FROM all_text WHERE regexp_matches(text, {_RNG}))))))))) WHERE rn = 1""", CT)
def _(i):
    both = i.resume().select(F.concat(F.lit("r-"), F.col("resume_id")).alias("id"), "text").unionByName(
        i.spread("documents", "doc_id").select(F.concat(F.lit("d-"), F.col("doc_id")).alias("id"), "text"))
    found = both.where(F.col("text").rlike(rs.FIND_RANGE))
    return found.select("id", F.explode(rs.experience_scan(F.col("text"))).alias("e")).select("id", *[f"e.{c}" for c in EXP_COLS])


@query("p12b_single_date_scan")
def _(i):
    t = F.regexp_replace("text", "(?i) to | - ", " / ")
    return i.resume().select("resume_id", F.explode(rs.experience_scan(t)).alias("e")).select("resume_id", *[f"e.{c}" for c in EXP_COLS])


@query("p13_split_title_company", f"SELECT resume_id, pos, {_T1} AS title, {_T2} AS company FROM (SELECT resume_id, pos, line AS t FROM res_line)", CT)
def _(i):
    raw = i.resume().select("resume_id", F.posexplode(F.split("text", "\n")).alias("p", "raw")).select(
        "resume_id", (F.col("p") + 1).cast("long").alias("pos"), tx.squash(F.col("raw")).alias("t")).where("t <> ''")
    title, company = rs.split_title(F.col("t"))
    return raw.select("resume_id", "pos", title.alias("title"), company.alias("company"))


@query("p14_dedupe_experience", """
SELECT candidate_id, lower(title) AS title, lower(company) AS company, min(seq) AS first_seq FROM experience_item GROUP BY 1, 2, 3""")
def _(i):
    return ex.dedupe_items(i.experience_item(), ["title", "company"], "seq").select("candidate_id", "title", "company", F.col("seq").alias("first_seq"))


@query("p15_weak_parse", f"""
SELECT r.resume_id, len(k.skills) = 0 OR (coalesce(x.n, 0) = 0 AND coalesce(e.n, 0) = 0) AS weak FROM resume r JOIN res_skill k ON k.resume_id = r.resume_id
LEFT JOIN (SELECT resume_id, count(*) AS n FROM exp_record GROUP BY 1) x ON x.resume_id = r.resume_id
LEFT JOIN (SELECT resume_id, count(*) AS n FROM res_body WHERE sec = 'education' AND regexp_matches(lower(line), {d.q(rs.DEGREE_WORDS)}) GROUP BY 1) e ON e.resume_id = r.resume_id""", CT)
def _(i):
    t, x = F.col("tagged"), F.col("text")
    return tagged(i).select("resume_id", rs.is_weak(
        rs.skills(t, x), rs.experience_blocks(t), rs.education_lines(t), rs.person_name(rs.section_lines(t, "root")), rs.email(x), rs.phone(x)).alias("weak"))


@query("p16_parse_resume")
def _(i):
    return ex.parse_resumes(i.resume().select("resume_id", "text")).select(
        "resume_id", "summary", "name", "email", "phone", F.array_join("skills", "|").alias("skills"),
        F.size("education").cast("long").alias("n_education"), F.size("experience").cast("long").alias("n_experience"), "weak")


_CORPUS = "lower(" + d.squash("concat_ws(' ', nullif(s, ''), nullif(dd, ''), text)") + ")"
_LABELS = ", ".join(f"CASE WHEN regexp_matches(c, {d.q(rx)}) THEN {d.q(lb)} END" for lb, rx in rs.ABILITIES)
_PHR = f"list_transform(regexp_extract_all(c, {d.q(rs.ABILITY_PHRASE)}, 1), lambda p: trim(regexp_replace(p, '\\b(?:the|a|an)\\b\\s+', '', 'g'), ' -'))"


@query("p17_abilities", f"""
SELECT id, {d.join("CASE WHEN len(labels) > 0 THEN labels ELSE list_filter(phr, lambda x, i: x <> '' AND list_position(phr, x) = i) END")} AS abilities FROM (
SELECT id, list_filter([{_LABELS}], lambda x: x IS NOT NULL) AS labels,
  list_filter({_PHR}, lambda p: len(list_filter(string_split_regex(p, ' +'), lambda w: w <> '')) BETWEEN 3 AND 8) AS phr
FROM (SELECT id, {_CORPUS} AS c FROM (SELECT id, text, '' AS s, '' AS dd FROM all_text)))""", CT)
def _(i):
    both = i.resume().select(F.concat(F.lit("r-"), F.col("resume_id")).alias("id"), "text").unionByName(
        i.spread("documents", "doc_id").select(F.concat(F.lit("d-"), F.col("doc_id")).alias("id"), "text"))
    none = F.lit(None).cast("string")
    return both.select("id", F.array_join(rs.abilities(none, F.array().cast("array<string>"), F.col("text")), "|").alias("abilities"))


def _cat_sql(t):
    scores = [" + ".join(f"CAST(regexp_matches({t}, {d.q(rx)}) AS INT)" for rx in rs._boundary(ws)) for ws in rs.CATEGORY_WORDS.values()]
    names = list(rs.CATEGORY_WORDS)
    best = f"greatest({', '.join(f's{j}' for j in range(len(names)))})"
    sel = ", ".join(f"{s} AS s{j}" for j, s in enumerate(scores))
    case = " ".join(f"WHEN s{j} = {best} THEN {d.q(n)}" for j, n in enumerate(names))
    return f"SELECT id, CASE WHEN {best} = 0 THEN 'SOFTWARE-ENGINEERING' {case} END AS category FROM (SELECT id, {sel} FROM (SELECT job_id AS id, lower(text) AS {t} FROM job_text UNION ALL SELECT 'r-' || resume_id, lower(text) FROM resume))"


@query("p18_impute_category", _cat_sql("t"))
def _(i):
    both = i.job_text().select(F.col("job_id").alias("id"), "text").unionByName(
        i.resume().select(F.concat(F.lit("r-"), F.col("resume_id")).alias("id"), "text"))
    return both.select("id", rs.impute_category(F.array("text"), F.array().cast("array<string>")).alias("category"))


@query("p19_experience_years", """
SELECT candidate_id, CAST(sum(e - s + 1) AS BIGINT) AS months, round(sum(e - s + 1) / 12.0, 1) AS years FROM (
 SELECT candidate_id, isl, min(start_idx) AS s, max(end_x) AS e FROM (
  SELECT *, sum(brk) OVER (PARTITION BY candidate_id ORDER BY start_idx, end_x, seq ROWS UNBOUNDED PRECEDING) AS isl FROM (
   SELECT *, CASE WHEN start_idx > coalesce(max(end_x) OVER (PARTITION BY candidate_id ORDER BY start_idx, end_x, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000) + 1 THEN 1 ELSE 0 END AS brk
   FROM (SELECT *, coalesce(end_idx, 2024 * 12 + 5) AS end_x FROM experience_item) WHERE end_x >= start_idx)) GROUP BY 1, 2) GROUP BY 1""")
def _(i):
    return ex.experience_years(i.experience_item(), as_of_idx=2024 * 12 + 5)


@query("p20_career_trajectory", """
SELECT candidate_id, CASE WHEN bool_or(mv AND company IS DISTINCT FROM pc) THEN 'transition' WHEN count(*) FILTER (mv) >= 2 THEN 'growth' ELSE 'stable' END AS progression,
 count(*) FILTER (mv) AS n_moves, arg_min(title || ' at ' || company, rn) AS first_role, arg_max(title || ' at ' || company, rn) AS latest_role,
 coalesce(array_to_string(list(pt || ' at ' || pc || ' > ' || title || ' at ' || company ORDER BY rn) FILTER (mv)[1:6], '|'), '') AS moves FROM (
 SELECT *, rn > 1 AND NOT (title IS NOT DISTINCT FROM pt AND company IS NOT DISTINCT FROM pc) AS mv FROM (
  SELECT *, row_number() OVER w AS rn, lag(title) OVER w AS pt, lag(company) OVER w AS pc FROM experience_item WINDOW w AS (PARTITION BY candidate_id ORDER BY start_idx NULLS FIRST, seq))) GROUP BY 1""")
def _(i):
    return ex.career_trajectory(i.experience_item())


@query("p21_typed_items", f"""
SELECT resume_id, block, {d.clean_text('title')} AS title, {d.clean_text('company')} AS company, {d.month_token('s')} AS start_date, {d.month_token('e')} AS end_date, {d.clean_text('description')} AS description
FROM (SELECT *, {d.strip_lead('start_date')} AS s, {d.strip_lead('end_date')} AS e FROM exp_record)""", CT)
def _(i):
    return tagged(i).select("resume_id", F.posexplode(rs.typed_experience(rs.experience_blocks(F.col("tagged")))).alias("p", "e")).select(
        "resume_id", (F.col("p") + 1).cast("long").alias("block"), *[f"e.{c}" for c in EXP_COLS])


_CATS = "CASE c_custkey % 3 WHEN 0 THEN 'Construction' WHEN 1 THEN upper(category) ELSE 'HR' END"
_INJ = f"MAP {{{', '.join(f'{d.q(k)}: {d.q(v)}' for k, v in rs.CATEGORY_SKILL.items())}}}"


@query("p22_inject_category", f"""
SELECT candidate_id, {d.join("CASE WHEN sk IS NULL OR list_contains(core_skills, sk) THEN core_skills ELSE [sk] || core_skills END")} AS core_skills,
 {d.join("CASE WHEN sk IS NULL OR list_contains(expanded_skills, sk) THEN expanded_skills ELSE [sk] || expanded_skills END")} AS expanded_skills
FROM (SELECT c.*, {_INJ}[upper({_CATS})] AS sk FROM candidate_doc c JOIN candidate b USING (candidate_id) )""".replace("upper(category)", "upper(c.category)"))
def _(i):
    k = F.substring("candidate_id", 6, 20).cast("long") % 3
    cat = F.when(k == 0, "Construction").when(k == 1, F.upper("category")).otherwise("HR")
    r = rs.inject_category(F.col("core_skills"), F.col("skills"), F.col("expanded_skills"), cat, F.array().cast("array<string>"))
    return i.candidate_doc().select("candidate_id", r.alias("r")).select(
        "candidate_id", F.array_join("r.core_skills", "|").alias("core_skills"), F.array_join("r.expanded_skills", "|").alias("expanded_skills"))


@query("p23_completeness", """
SELECT candidate_id, round(CASE WHEN coalesce(summary, '') <> '' THEN .25 ELSE 0 END + CASE WHEN len(skills) >= 3 THEN .25 ELSE 0 END + CASE WHEN experience_years IS NOT NULL THEN .2 ELSE 0 END
 + CASE WHEN len(core_skills) > 0 THEN .15 ELSE 0 END + CASE WHEN degree <> 'Diploma' THEN .15 ELSE 0 END, 4)::DOUBLE AS score FROM candidate_doc""")
def _(i):
    return i.candidate_doc().select("candidate_id", rs.completeness(
        F.col("summary"), F.col("skills"), F.col("experience_years"), F.size("core_skills"),
        F.when(F.col("degree") != "Diploma", 1).otherwise(0)).alias("score"))
