"""Queries over the text, date and array expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import dates as dt
from matchloom.functions import resume as rs
from matchloom.functions import text as tx
from matchloom.plans import duck as d
from matchloom.plans.registry import query

TOKENS_SQL = "SELECT doc_id, string_split_regex(text, '[,.\\n]') AS a FROM documents"


def tokens(i):
    return i.spread("documents", "doc_id").select("doc_id", F.split("text", r"[,.\n]").alias("a"))


@query("c01_clean_text", f"SELECT doc_id, {d.clean_text('text')} AS cleaned, {d.clean_text('lang')} AS lang FROM documents")
def _(i):
    return i.spread("documents", "doc_id").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"), tx.clean_text(F.col("lang")).alias("lang"))


@query("c02_normalize_identifier", f"""
SELECT event_id, 'user-' || CAST(user_id AS VARCHAR) AS user_key,
  'val-' || CASE WHEN value * 100 = floor(value * 100) AND floor(value) = value THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS value_key,
  'type-' || coalesce(nullif({d.squash("replace(event_type, 'view', '  ')")}, ''), 'unknown') AS type_key FROM events""")
def _(i):
    return i.base("events").select(
        "event_id", tx.normalize_identifier(F.col("user_id"), "user").alias("user_key"),
        tx.normalize_identifier(F.col("value"), "val", floating=True).alias("value_key"),
        tx.normalize_identifier(F.replace("event_type", F.lit("view"), F.lit("  ")), "type").alias("type_key"))


@query("c03_dedupe_preserve", f"""
SELECT doc_id, {d.join(d.dedupe('a'))} AS plain, {d.join('list_filter(a, lambda x, i: list_position(a, x) = i)')} AS keeps_empty,
  {d.join("list_filter(b, lambda x, i: x <> '' AND list_position(list_transform(b, lambda y: lower(y)), lower(x)) = i)")} AS ignores_case
FROM (SELECT doc_id, a, list_transform(a, lambda x: {d.squash('x')}) AS b FROM ({TOKENS_SQL}))""")
def _(i):
    a = F.col("a")
    return tokens(i).select(
        "doc_id", F.array_join(tx.dedupe(a), "|").alias("plain"), F.array_join(tx.dedupe_keep_empty(a), "|").alias("keeps_empty"),
        F.array_join(tx.dedupe_ignore_case(a), "|").alias("ignores_case"))


@query("c04_stable_sorted", f"""
SELECT doc_id, {d.join("list_sort(list_distinct(list_filter(a, lambda x: x <> '')))")} AS tokens FROM ({TOKENS_SQL})""")
def _(i):
    return tokens(i).select("doc_id", F.array_join(tx.sorted_unique(F.col("a")), "|").alias("tokens"))


@query("c05_normalize_skill", f"SELECT page_id, {d.normalize_skill('html')} AS skill FROM pages")
def _(i):
    return i.spread("pages", "page_id").select("page_id", tx.normalize_skill(F.col("html")).alias("skill"))


_RAW = f"""SELECT doc_id, list_filter(b, lambda x, i: list_position(b, x) = i) AS raw FROM (
  SELECT doc_id, list_filter(list_transform(a, lambda x: {d.clean_text('x')}), lambda x: x IS NOT NULL) AS b FROM ({TOKENS_SQL}))"""
_NORM = f"SELECT doc_id, raw, list_transform(raw, lambda x: {d.normalize_skill('x')}) AS n FROM ({_RAW})"


@query("c06_normalize_skill_list", f"SELECT doc_id, {d.join('raw')} AS raw, {d.join(d.dedupe('n'))} AS normalized FROM ({_NORM})")
def _(i):
    a = F.col("a")
    return tokens(i).select("doc_id", F.array_join(tx.skill_list_raw(a), "|").alias("raw"),
                            F.array_join(tx.skill_list_normalized(a), "|").alias("normalized"))


_WORDS = "len(string_split(x, ' '))"


@query("c07_sanitize_skills", f"""
SELECT doc_id, {d.join(d.dedupe('k'))} AS skills FROM (SELECT doc_id, list_filter(n, lambda x: x <> '' AND (list_contains({d.lst(tx.SKILL_ALLOWED)}, x)
  OR (length(x) <= 48 AND {_WORDS} <= 6 AND NOT regexp_matches(x, {d.q(tx.SKILL_NOISE)})
      AND NOT ({_WORDS} >= 4 AND regexp_matches(x, {d.q(tx.SKILL_DUTY)}))))) AS k FROM ({_NORM}))""")
def _(i):
    return tokens(i).select("doc_id", F.array_join(tx.sanitize_skills(F.col("a")), "|").alias("skills"))


_MONTHS_SQL = """SELECT o_orderkey, CASE o_orderkey % 11
  WHEN 0 THEN month(o_orderdate) || '/' || year(o_orderdate) WHEN 1 THEN year(o_orderdate) || '/' || month(o_orderdate)
  WHEN 2 THEN 'Since  Summer ' || year(o_orderdate) WHEN 3 THEN '(' || lower(monthname(o_orderdate)) || ' ' || year(o_orderdate) || ')'
  WHEN 4 THEN 'as of ' || year(o_orderdate) WHEN 5 THEN 'Current' WHEN 6 THEN '00/' || year(o_orderdate) WHEN 7 THEN '00/0000'
  WHEN 8 THEN 'q3 of ' || year(o_orderdate) || ' on' WHEN 9 THEN '13/' || year(o_orderdate)
  ELSE year(o_orderdate) || '-' || month(o_orderdate) END AS raw FROM orders"""


def month_tokens(i):
    k, y, m = F.col("o_orderkey") % 11, F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string")
    shapes = [
        F.concat(m, F.lit("/"), y), F.concat(y, F.lit("/"), m), F.concat(F.lit("Since  Summer "), y),
        F.concat(F.lit("("), F.lower(F.date_format("o_orderdate", "MMMM")), F.lit(" "), y, F.lit(")")),
        F.concat(F.lit("as of "), y), F.lit("Current"), F.concat(F.lit("00/"), y), F.lit("00/0000"),
        F.concat(F.lit("q3 of "), y, F.lit(" on")), F.concat(F.lit("13/"), y), F.concat(y, F.lit("-"), m)]
    return i.base("orders").select("o_orderkey", F.element_at(F.array(*shapes), (k + 1).cast("int")).alias("raw"))


_TOK_SQL = f"SELECT o_orderkey, {d.strip_lead('raw')} AS t FROM ({_MONTHS_SQL})"


@query("c08_normalize_month", f"SELECT o_orderkey, {d.month_token('t')} AS month FROM ({_TOK_SQL})")
def _(i):
    return month_tokens(i).select("o_orderkey", dt.normalize_month(F.col("raw")).alias("month"))


@query("c09_month_to_date", f"""
SELECT o_orderkey, CASE WHEN m = 'present' THEN NULL ELSE TRY_CAST(m || '-01' AS DATE) END AS start_date,
  CASE WHEN m = 'present' THEN DATE '2024-06-01' ELSE TRY_CAST(m || '-01' AS DATE) END AS end_date
FROM (SELECT o_orderkey, {d.month_token('t')} AS m FROM ({_TOK_SQL}))""")
def _(i):
    m = F.col("m")
    return month_tokens(i).select("o_orderkey", dt.normalize_month(F.col("raw")).alias("m")).select(
        "o_orderkey", dt.month_to_date(m).alias("start_date"),
        dt.month_to_date(m, F.lit("2024-06-01").cast("date")).alias("end_date"))


@query("c10_seniority_bucket", f"SELECT c_custkey, {d.bucket('(c_acctbal / 1000)')} AS level FROM customer")
def _(i):
    return i.base("customer").select("c_custkey", tx.seniority_bucket(F.col("c_acctbal") / 1000).alias("level"))


def _years_sql(t):
    def first(p):
        return f"list_filter(list_transform(regexp_extract_all({t}, {d.q(p)}, 2), lambda y: CAST(y AS DOUBLE)), lambda y: y > 0 AND y <= 60)[1]"
    return f"round(coalesce({', '.join(first(p) for p in tx.YEARS_PATTERNS)}), 1)"


@query("c11_years_from_text", f"""
SELECT resume_id, {_years_sql('t')} AS years FROM (SELECT resume_id, regexp_replace(lower(text), {d.q(d.WS + '+')}, ' ', 'g') AS t FROM resume)""")
def _(i):
    return i.resume().select("resume_id", tx.years_from_text(F.col("text")).alias("years"))


@query("c12_embedding_text", f"SELECT doc_id, substring(coalesce(nullif({d.squash('text')}, ''), 'empty resume'), 1, 4000) AS prepared FROM documents")
def _(i):
    return i.spread("documents", "doc_id").select("doc_id", tx.embedding_text(F.col("text")).alias("prepared"))


_JOIN = "array_to_string({}, '; ')"


@query("c13_build_embedding_text", f"""
SELECT candidate_id, substring(coalesce(nullif({d.squash('t')}, ''), 'empty resume'), 1, 4000) AS prepared FROM (
 SELECT candidate_id, concat_ws(chr(10), 'Name: ' || nullif(name, ''), 'Category: ' || nullif(category, ''), 'Summary: ' || nullif(summary, ''),
  CASE WHEN len(core_skills) > 0 THEN 'Core skills: ' || array_to_string(core_skills[1:30], '; ') END,
  CASE WHEN len(sp) > 0 THEN 'Specialized skills: ' || array_to_string(sp[1:20], '; ') END,
  CASE WHEN len(expanded_skills) > 0 THEN 'Expanded skills: ' || array_to_string(expanded_skills[1:30], '; ') END,
  CASE WHEN len(caps) > 0 THEN 'Capabilities: ' || array_to_string(caps[1:5], '; ') END,
  CASE WHEN category IS NOT NULL THEN 'Experience titles: ' || category END) AS t
 FROM (SELECT *, list_filter(skills, lambda x: NOT list_contains(core_skills, x) AND NOT list_contains(caps, x) AND len(string_split(x, ' ')) <= 3) AS sp
   FROM (SELECT *, list_filter(skills, lambda x: x LIKE 'new %') AS caps FROM candidate_doc)))""")
def _(i):
    caps = F.filter("skills", lambda x: x.startswith("new "))
    return i.candidate_doc().select("candidate_id", rs.build_embedding_text(
        name=F.col("name"), category=F.col("category"), summary=F.col("summary"), core=F.col("core_skills"),
        canonical=F.col("skills"), expanded=F.col("expanded_skills"), capabilities=caps,
        titles=F.array("category"), fallback=F.lit(None).cast("string")).alias("prepared"))


@query("c14_synthetic_resume_text", """
SELECT candidate_id, concat_ws(chr(10), 'Name: ' || name, 'Category: ' || category,
  CASE WHEN len(skills) > 0 THEN 'Skills: ' || array_to_string(skills, ', ') END,
  CASE WHEN len(core_skills) > 0 THEN 'Abilities:' END,
  CASE WHEN len(core_skills) > 0 THEN array_to_string(list_transform(core_skills, lambda a: ' - ' || a), chr(10)) END,
  'Experience:', ' - ' || coalesce(seniority_level, 'None') || ' at ' || location || CASE WHEN experience_years IS NULL THEN '' ELSE ' (2001-02 to present)' END,
  '   ' || summary, 'Education:', ' - ' || degree || ' at None') AS text FROM candidate_doc""")
def _(i):
    none = F.lit(None).cast("string")
    exp = F.array(F.struct(
        F.col("seniority_level").alias("title"), F.col("location").alias("company"),
        F.when(F.col("experience_years").isNotNull(), "2001-02").alias("start_date"), F.lit("present").alias("end_date"),
        none.alias("location"), F.col("summary").alias("description")))
    edu = F.array(F.struct(F.col("degree").alias("degree"), none.alias("institution"), none.alias("start_date")))
    return i.candidate_doc().select("candidate_id", rs.synthetic_text(
        name=F.col("name"), category=F.col("category"), skills=F.col("skills"), abilities=F.col("core_skills"),
        experience=exp, education=edu).alias("text"))


@query("c15_normalize_token", f"SELECT page_id, {d.normalize_token('url')} AS token, {d.normalize_token('html')} AS body FROM pages")
def _(i):
    return i.spread("pages", "page_id").select("page_id", tx.normalize_token(F.col("url")).alias("token"), tx.normalize_token(F.col("html")).alias("body"))


@query("c16_clean_token", f"""
SELECT o_orderkey, {d.clean_token('raw')} AS token FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' Mongo  DB;' WHEN 1 THEN 'MS Office'
  WHEN 2 THEN ' ,; ' ELSE o_orderpriority || ' & ' || o_orderstatus || '/' END AS raw FROM orders)""")
def _(i):
    k = F.col("o_orderkey") % 4
    raw = (F.when(k == 0, " Mongo  DB;").when(k == 1, "MS Office").when(k == 2, " ,; ")
           .otherwise(F.concat("o_orderpriority", F.lit(" & "), "o_orderstatus", F.lit("/"))))
    return i.base("orders").select("o_orderkey", tx.clean_token(raw).alias("token"))


_REGION_RAW = "CASE c_custkey % 5 WHEN 0 THEN 'USA' WHEN 1 THEN 'Austin_US' WHEN 2 THEN 'Leeds, England' WHEN 3 THEN 'WFH - U.K.' ELSE c_mktsegment END"


@query("c17_normalize_region", f"SELECT c_custkey, {d.normalize_region('raw')} AS region FROM (SELECT c_custkey, {_REGION_RAW} AS raw FROM customer)")
def _(i):
    k = F.col("c_custkey") % 5
    raw = (F.when(k == 0, "USA").when(k == 1, "Austin_US").when(k == 2, "Leeds, England").when(k == 3, "WFH - U.K.").otherwise(F.col("c_mktsegment")))
    return i.base("customer").select("c_custkey", tx.normalize_region(raw).alias("region"))


@query("c18_normalize_label", f"""
SELECT s_suppkey, coalesce(f.canonical, {d.normalize_token('raw')}) AS industry FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'FinTech'
  WHEN 1 THEN 'E-Commerce' WHEN 2 THEN 'healthcare' ELSE s_name END AS raw FROM supplier) s
LEFT JOIN (VALUES ('fintech', 'finance'), ('e commerce', 'e commerce'), ('healthcare', 'healthcare')) f(label, canonical) ON f.label = {d.normalize_token('raw')}""")
def _(i):
    from matchloom.operators.facets import FILTERS, normalize_label
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 0, "FinTech").when(k == 1, "E-Commerce").when(k == 2, "healthcare").otherwise(F.col("s_name"))
    return i.base("supplier").select("s_suppkey", normalize_label(raw, FILTERS["industries"]).alias("industry"))


_CAP = "array_to_string(list_transform(string_split(lower(t), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query("c19_display_label", f"""
SELECT c_custkey, CASE WHEN t = 'e commerce' THEN 'E-commerce' ELSE {_CAP} END AS label FROM (
  SELECT c_custkey, {d.normalize_token("CASE WHEN c_custkey % 3 = 0 THEN 'E-COMMERCE' ELSE c_mktsegment || '_' || c_name END")} AS t FROM customer)""")
def _(i):
    raw = F.when(F.col("c_custkey") % 3 == 0, "E-COMMERCE").otherwise(F.concat("c_mktsegment", F.lit("_"), "c_name"))
    return i.base("customer").select("c_custkey", tx.display_label(raw).alias("label"))


@query("c20_trim_description", f"SELECT doc_id, coalesce(substring({d.squash('text')}, 1, 8000), '') AS text FROM documents")
def _(i):
    return i.spread("documents", "doc_id").select("doc_id", tx.trim_description(F.col("text")).alias("text"))


@query("c22_estimate_tokens", "SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS tokens FROM documents")
def _(i):
    return i.spread("documents", "doc_id").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


_LEVELS = ["Staff Engineer", "Tech Lead", "SENIOR dev", "Entry level", "mid-level", "Director", "", "  Intern"]


@query("c23_seniority_group", f"""
SELECT o_orderkey, CASE WHEN t = '' THEN 'unknown' WHEN contains(t,'principal') OR contains(t,'staff') THEN 'principal' WHEN contains(t,'lead') THEN 'lead'
  WHEN contains(t,'senior') THEN 'senior' WHEN contains(t,'junior') OR contains(t,'entry') OR contains(t,'intern') THEN 'junior'
  WHEN contains(t,'mid') THEN 'mid' ELSE t END AS level
FROM (SELECT o_orderkey, lower(trim({d.lst(_LEVELS)}[o_orderkey % 8 + 1])) AS t FROM orders)""")
def _(i):
    raw = F.element_at(F.array(*[F.lit(x) for x in _LEVELS]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return i.base("orders").select("o_orderkey", tx.seniority_group(raw).alias("level"))


@query("c24_request_key", "SELECT event_id, substring(sha256('path=' || event_type || '|' || 'user=' || user_id), 1, 16) AS request_key FROM events")
def _(i):
    return i.base("events").select("event_id", tx.request_key(user=F.col("user_id"), path=F.col("event_type")).alias("request_key"))


@query("j27_prompt_injection", f"""
SELECT conv_id, turn, regexp_matches(text, {d.q(tx.INJECTION)}) AS flagged FROM conversations UNION ALL
SELECT CAST(substring(job_id, 5) AS BIGINT), -1, regexp_matches(text, {d.q(tx.INJECTION)}) FROM job_text""")
def _(i):
    a = i.base("conversations").select("conv_id", "turn", tx.has_injection(F.col("text")).alias("flagged"))
    b = i.job_text().select(F.substring("job_id", 5, 20).cast("long").alias("conv_id"), F.lit(-1).cast("long").alias("turn"),
                            tx.has_injection(F.col("text")).alias("flagged"))
    return a.unionByName(b)


_SENS = f"regexp_extract_all(lower(text), {d.q(tx.SENSITIVE_RE)}, 1)"


@query("g01_sensitive_terms", f"""
SELECT job_id, {d.join(d.dedupe('h'))} AS terms FROM (SELECT job_id, {_SENS} AS h FROM job_text
UNION ALL SELECT 'doc-' || doc_id, {_SENS} FROM documents)""")
def _(i):
    both = i.job_text().unionByName(i.spread("documents", "doc_id").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("job_id"), "text"))
    return both.select("job_id", F.array_join(tx.sensitive_terms(F.col("text")), "|").alias("terms"))
