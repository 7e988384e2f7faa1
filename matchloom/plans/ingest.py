"""Queries over sources, sinks and incremental writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.operators import ingestion as ig
from matchloom.operators.ranking import latest
from matchloom.plans import duck as d
from matchloom.plans import skills as sk
from matchloom.plans.registry import query
from matchloom.session import shared_dir
from matchloom.sources import csv as cs
from matchloom.sources import documents as dc
from matchloom.sources import jsonl as js
from matchloom.sources import store as st

AS_OF = 2024 * 12 + 5


def resume_csv(i) -> str:
    """The résumé table as a CSV file set in the shared folder."""
    path = shared_dir(i.spark, "resume-csv")
    i.resume().select(F.col("resume_id").alias("ID"), F.col("text").alias("Resume_str"), F.lit("<p></p>").alias("Resume_html"), F.col("priority").alias("Category")) \
        .write.option("header", True).option("escape", '"').csv(path)
    return path


@query("s01_resume_csv_source", f"SELECT 'resume-' || resume_id AS candidate_id, CAST(resume_id AS VARCHAR) AS raw_id, {d.clean_text('priority')} AS category, coalesce({d.clean_text('text')}, '') AS text, '<p></p>' AS html FROM resume")
def _(i):
    return cs.read_resumes(i.spark, resume_csv(i)).drop("source_dataset")


@query("s01b_build_candidates")
def _(i):
    r = i.resume().select(F.concat(F.lit("resume-"), "resume_id").alias("candidate_id"), F.lit("resumes").alias("source_dataset"), F.col("priority").alias("category"), "text")
    b = ig.build_candidates(r, sk.ontology(i), AS_OF)
    return b.select("candidate_id", "category", "name", "experience_years", "seniority_level", F.array_join("core_skills", "|").alias("core_skills"), "embedding_text")


def people(i):
    return i.base("customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("email"))


def child(i):
    return i.base("orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("skill"), F.col("o_orderstatus").alias("status"))


def child_files(i) -> dict[str, str]:
    """The four child tables of the structured source as CSV file sets in the shared folder."""
    o, blank = i.base("orders").select(F.col("o_custkey").alias("person_id"), "*"), F.lit(None).cast("string")
    year = F.year("o_orderdate")
    rows = {
        "abilities": o.where("o_orderkey % 2 = 0").select("person_id", F.concat(F.lit("handles "), F.lower("o_orderstatus")).alias("ability")),
        "skills": o.select("person_id", F.col("o_orderpriority").alias("skill")),
        "education": o.where("o_orderkey % 5 = 0").select(
            "person_id", F.concat(F.lit("Delta University "), F.col("o_orderkey") % 3).alias("institution"), F.lit("Trade, with honours").alias("program"),
            year.cast("string").alias("start_date"), blank.alias("location")),
        "experience": o.select("person_id", F.concat(F.lit("Clerk of "), "o_orderpriority").alias("title"), F.concat(F.lit("firm-"), F.col("o_orderkey") % 7).alias("firm"),
                               year.cast("string").alias("start_date"), (year + 1).cast("string").alias("end_date"), blank.alias("location")),
    }
    paths = {kind: shared_dir(i.spark, f"{kind}-csv") for kind in rows}
    for kind, df in rows.items():
        df.select(*[c.split(" ")[0] for c in cs.CHILDREN[kind].split(", ")]).write.option("header", True).option("escape", '"').csv(paths[kind])
    return paths


def people_file(i) -> str:
    path = shared_dir(i.spark, "people-csv")
    people(i).select("person_id", "name", "email", F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("linkedin")).write.option("header", True).csv(path)
    return path


_PEOPLE = "(SELECT c_custkey AS person_id, c_name AS name FROM customer ORDER BY c_custkey LIMIT {})"


@query("s02_people_with_children", """
SELECT p.c_custkey AS person_id, p.c_name AS name, kind, value FROM customer p LEFT JOIN (
 SELECT o_custkey, 'abilities' AS kind, 'handles ' || lower(o_orderstatus) AS value FROM orders WHERE o_orderkey % 2 = 0
 UNION ALL SELECT o_custkey, 'skills', o_orderpriority FROM orders
 UNION ALL SELECT o_custkey, 'education', 'Delta University ' || o_orderkey % 3 || '/Trade, with honours/' || year(o_orderdate) FROM orders WHERE o_orderkey % 5 = 0
 UNION ALL SELECT o_custkey, 'experience', 'Clerk of ' || o_orderpriority || '/firm-' || o_orderkey % 7 || '/' || year(o_orderdate) || '/' || year(o_orderdate) + 1 FROM orders) c ON o_custkey = p.c_custkey""")
def _(i):
    """Every person with every row of the four child files; people without children have one row."""
    kept, paths = cs.read_people(i.spark, people_file(i)), child_files(i)
    values = {"abilities": ["ability"], "skills": ["skill"], "education": ["institution", "program", "start_date"], "experience": ["title", "firm", "start_date", "end_date"]}
    rows = [cs.grouped(cs.read_child(i.spark, paths[kind], kind), kept, "person_id", "seq", cols)
            .select("person_id", F.lit(kind).alias("kind"), F.concat_ws("/", *cols).alias("value")) for kind, cols in values.items()]
    return kept.join(cs.union_sources(*rows), "person_id", "left").select("person_id", "name", "kind", "value")


@query("s02b_structured_lists", """
SELECT c_custkey AS person_id, c_name AS name, piece, coalesce(string_agg(o_orderpriority || '/' || o_orderstatus, '|' ORDER BY o_orderkey), '') AS items FROM customer LEFT JOIN (
 SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 10 AS piece FROM orders) ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def _(i):
    """Each person's list in order, ten rows to a piece; a list of any length is whole and no cell grows with it."""
    kept = cs.read_people(i.spark, people_file(i))
    lists = cs.listed_pieces(cs.grouped(child(i), kept, "person_id", "seq", ["skill", "status"]), "person_id", ["skill", "status"], 10)
    return kept.join(lists, "person_id", "left").select("person_id", "name", "piece", F.coalesce(F.array_join(F.transform(
        "items", lambda e: F.concat_ws("/", e["skill"], e["status"])), "|"), F.lit("")).alias("items"))


@query("s03_people_limit", f"SELECT person_id, name FROM {_PEOPLE.format(500)}")
def _(i):
    return cs.people(people(i), 500).select("person_id", "name")


@query("s04_grouped_values", "SELECT o_custkey AS person_id, o_orderkey AS pos, o_orderpriority AS skill FROM orders")
def _(i):
    return cs.grouped(child(i), people(i), "person_id", "seq", ["skill"])


@query("s05_grouped_records", "SELECT o_custkey AS person_id, o_orderkey AS pos, o_orderpriority AS skill, o_orderstatus AS status FROM orders")
def _(i):
    return cs.grouped(child(i), people(i), "person_id", "seq", ["skill", "status"])


@query("s06_union_sources", "SELECT 'people-' || c_custkey AS candidate_id, 'people' AS source_dataset, c_name AS name, NULL AS category FROM customer UNION ALL SELECT 'firm-' || s_suppkey, 'firms', NULL, 'firm' FROM supplier".replace("NULL AS category", "CAST(NULL AS VARCHAR) AS category"))
def _(i):
    a = i.base("customer").select(F.concat(F.lit("people-"), "c_custkey").alias("candidate_id"), F.lit("people").alias("source_dataset"), F.col("c_name").alias("name"))
    b = i.base("supplier").select(F.concat(F.lit("firm-"), "s_suppkey").alias("candidate_id"), F.lit("firms").alias("source_dataset"), F.lit("firm").alias("category"))
    return cs.union_sources(a, b)


def store(i, rows, keys=("source_dataset", "candidate_id")):
    s = st.KeyedStore(i.spark, shared_dir(i.spark, "store"), list(keys))
    s.upsert(rows, 0)
    return s


RAW = {"name": "string", "category": "string", "summary": "string", "location": "string", "abilities": "array<string>"}
PARSED = {"skills": "array<string>", "core_skills": "array<string>", "expanded_skills": "array<string>", "experience_years": "double", "seniority_level": "string"}


def stored(i, *names: str):
    """Candidates written as documents with the nested parts ``raw`` and ``parsed``, and the named values read back from them."""
    path = shared_dir(i.spark, "candidates")
    docs = i.candidate_doc().withColumn("abilities", F.array("degree")).select("candidate_id", "source_dataset", *RAW, *PARSED)
    dc.write_documents(docs, path, {"raw": list(RAW), "parsed": list(PARSED)}, by="source_dataset")
    where = {n: ("raw", n, k) for n, k in RAW.items()} | {n: ("parsed", n, k) for n, k in PARSED.items()}
    return dc.read_documents(i.spark, path, [("candidate_id", "string"), ("source_dataset", "string")], {n: where[n] for n in names})


@query("s07_reread_stored", "SELECT candidate_id, source_dataset, array_to_string(skills, '|') AS skills, sha256(candidate_id || chr(1) || array_to_string(skills, '|')) AS content_hash FROM candidate_doc WHERE source_dataset = 'set_a'")
def _(i):
    one = stored(i, "skills").where("source_dataset = 'set_a'")  # prunes to one folder
    j = F.array_join(tx.sanitize_skills(F.col("skills")), "|")
    return one.select("candidate_id", "source_dataset", j.alias("skills"), F.sha2(F.concat_ws("\x01", "candidate_id", j), 256).alias("content_hash"))


_LISTED = "CASE WHEN len({c}) > 0 THEN '{label}: ' || array_to_string({c}[1:{n}], '; ') END"
UP = {
    "u_canon": f"""SELECT candidate_id, coalesce(a.canonical, token) AS canonical, min(pos) AS pos, bool_or(coalesce(a.canonical, token) <> token) AS aliased FROM (
 SELECT candidate_id, unnest(skills) AS token, generate_subscripts(skills, 1) AS pos FROM candidate_doc UNION ALL SELECT candidate_id, {d.clean_token('degree')}, len(skills) + 1 FROM candidate_doc)
 LEFT JOIN alias_map a ON a.alias = token GROUP BY 1, 2""",
    "u_loose": """SELECT token, arg_min(skill, (1000 - length(skill), skill)) AS skill FROM (SELECT DISTINCT canonical AS token FROM u_canon WHERE canonical NOT IN (SELECT skill FROM taxonomy))
 JOIN taxonomy t ON length(t.skill) >= 5 AND contains(token, t.skill) GROUP BY 1""",
    "u_items": "SELECT candidate_id, pos, c.canonical, coalesce(t.skill, l.skill) AS skill FROM u_canon c LEFT JOIN taxonomy t ON t.skill = c.canonical LEFT JOIN u_loose l ON l.token = c.canonical",
    "u_core": "SELECT candidate_id, list(skill ORDER BY pos) AS core FROM (SELECT candidate_id, skill, min(pos) AS pos FROM u_items WHERE skill IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "u_expanded": """SELECT candidate_id, list(name ORDER BY spot) AS expanded FROM (SELECT candidate_id, name, min(spot) AS spot FROM (
 SELECT candidate_id, 2 * pos AS spot, skill AS name FROM u_items WHERE skill IS NOT NULL UNION ALL SELECT candidate_id, 2 * pos + 1, parent FROM u_items JOIN taxonomy USING (skill) WHERE parent IS NOT NULL) GROUP BY 1, 2) GROUP BY 1""",
    "u_all": """SELECT candidate_id, list(canonical ORDER BY pos) AS canon, coalesce(list(canonical ORDER BY pos) FILTER (canonical IN (SELECT token FROM tagset WHERE kind = 'capability')), []) AS caps, bool_or(aliased) AS aliased,
 bool_or(canonical IN (SELECT token FROM tagset)) AS tagged FROM u_canon GROUP BY 1""",
    "u_doc": """SELECT d.candidate_id, name, category, summary, coalesce(core, []) AS core, coalesce(expanded, []) AS expanded, caps, aliased, tagged,
 list_filter(canon, lambda x: NOT list_contains(coalesce(core, []), x) AND NOT list_contains(caps, x) AND len(string_split(x, ' ')) <= 3) AS special
 FROM candidate_doc d JOIN u_all USING (candidate_id) LEFT JOIN u_core USING (candidate_id) LEFT JOIN u_expanded USING (candidate_id)""",
}


@query("s08_upgrade_stored", f"""
SELECT candidate_id, array_to_string(core, '|') AS core_skills, substring(coalesce(nullif({d.squash('t')}, ''), 'empty resume'), 1, 4000) AS embedding_text,
 {', '.join(f"{d.q(v)} AS {n}" for n, v in ig.VERSIONS.items())}, aliased AS alias_applied, (len(core) > 0 OR tagged) AS taxonomy_applied FROM (
 SELECT *, concat_ws(chr(10), 'Name: ' || nullif(name, ''), 'Category: ' || nullif(category, ''), 'Summary: ' || nullif(summary, ''), {_LISTED.format(c='core', label='Core skills', n=30)},
 {_LISTED.format(c='special', label='Specialized skills', n=20)}, {_LISTED.format(c='expanded', label='Expanded skills', n=30)}, {_LISTED.format(c='caps', label='Capabilities', n=5)}) AS t FROM u_doc)""", sk.CT | UP)
def _(i):
    """Stored documents of an older version: their parts are read by path, normalised anew and given today's versions."""
    e = F.array().cast("array<struct<title:string,start_date:string,end_date:string>>")
    old = stored(i, "name", "category", "summary", "skills", "abilities", "experience_years", "seniority_level").select(
        "*", F.col("skills").alias("normalized_skills"), e.alias("experience"), *[F.lit(None).cast("string").alias(v) for v in ig.VERSIONS])
    u = ig.upgrade(old, sk.ontology(i), AS_OF)
    return u.select("candidate_id", F.array_join("core_skills", "|").alias("core_skills"), "embedding_text", *ig.VERSIONS, "alias_applied", "taxonomy_applied")


_STATUS = "CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'old-version' END"


def versions(i):
    k = F.col("o_orderkey") % 3
    v = F.when(k == 1, "").when(k == 2, "old-version")
    return i.base("orders").select("o_orderkey", *[v.alias(n) for n in ig.VERSIONS])


@query("s09_default_versions", f"SELECT o_orderkey, {', '.join(f'coalesce(nullif({_STATUS}, {d.q(str())}), {d.q(v)}) AS {n}' for n, v in ig.VERSIONS.items())} FROM orders")
def _(i):
    return ig.default_versions(versions(i))


SCALARS = ["candidate_id", "source_dataset", "category", "summary", "experience_years", "seniority_level", "name", "location"]
_JSON = "CAST(to_json({" + ", ".join(f"'{c}': {c}" for c in SCALARS) + ", 'skills': skills, 'core_skills': list_sort(core_skills), 'expanded_skills': list_sort(expanded_skills)}) AS VARCHAR)"
_VERS = "norm-1' || chr(1) || 'taxonomy-1"
CT = {
    "s_hash": f"SELECT candidate_id, source_dataset, summary, {_JSON} AS payload, CASE WHEN length(candidate_id) % 3 = 0 THEN 'stored-' || candidate_id ELSE sha256({_JSON}) END AS normalization_hash FROM candidate_doc",
    "s_batch": "SELECT *, sha256(candidate_id || chr(1) || source_dataset || chr(1) || summary || chr(1) || 'embedding-text-1' || chr(1) || 'norm-1' || chr(1) || 'taxonomy-1' || chr(1) || normalization_hash) AS embedding_hash FROM s_hash",
    "s_state": "SELECT candidate_id, source_dataset, CASE WHEN length(candidate_id) % 2 = 0 THEN normalization_hash ELSE 'changed' END AS pn, CASE WHEN source_dataset = 'set_a' THEN embedding_hash END AS pe FROM s_batch WHERE summary NOT LIKE '%anvil%'",
    "s_plan": "SELECT b.*, pn IS DISTINCT FROM normalization_hash AS needs_upsert, pe IS DISTINCT FROM embedding_hash AS needs_embedding, CASE WHEN pe = embedding_hash THEN embedding_hash END AS stored_embedding_hash FROM s_batch b LEFT JOIN s_state s USING (candidate_id, source_dataset)",
}


def hashed(i):
    """Candidates with content hashes; some keep a stored hash of the current versions."""
    doc = i.candidate_doc()
    stored = F.when(F.length("candidate_id") % 3 == 0, F.concat(F.lit("stored-"), "candidate_id"))
    v = {n: F.lit(x) for n, x in ig.VERSIONS.items()}
    p = doc.withColumn("payload", ig.payload(SCALARS, ["skills"], ["core_skills", "expanded_skills"])).withColumns(v)
    p = p.withColumn("normalization_hash", ig.normalization_hash(F.col("payload"), stored, *[F.col(n) for n in ("normalization_version", "taxonomy_version", "experience_years_method")]))
    return p.withColumn("embedding_hash", ig.embedding_hash(F.col("summary"), F.col("normalization_hash"))).select(
        "candidate_id", "source_dataset", "summary", "payload", "normalization_hash", "embedding_hash")


def state(i, batch):
    return batch.where(~F.col("summary").contains("anvil")).select(
        *ig.KEY, F.when(F.length("candidate_id") % 2 == 0, F.col("normalization_hash")).otherwise("changed").alias("normalization_hash"),
        F.when(F.col("source_dataset") == "set_a", F.col("embedding_hash")).alias("embedding_hash"))


@query("s10_existing_state", "SELECT b.candidate_id, b.source_dataset, pn AS normalization_hash, pe AS embedding_hash FROM s_batch b LEFT JOIN s_state s USING (candidate_id, source_dataset)", CT)
def _(i):
    b = hashed(i)
    return b.select(*ig.KEY).join(state(i, b), ig.KEY, "left").select("candidate_id", "source_dataset", "normalization_hash", "embedding_hash")


@query("s11_hash_payload", "SELECT candidate_id, payload FROM s_hash", {**CT, **d.UNSIGNED_YEARS})
def _(i):
    docs = stored(i, *[c for c in SCALARS if c not in ig.KEY], "skills", "core_skills", "expanded_skills")
    return docs.select("candidate_id", ig.payload(SCALARS, ["skills"], ["core_skills", "expanded_skills"]).alias("payload"))


@query("s12_normalization_hash", "SELECT candidate_id, normalization_hash FROM s_hash", {**CT, **d.UNSIGNED_YEARS})
def _(i):
    return hashed(i).select("candidate_id", "normalization_hash")


@query("s13_embedding_hash", "SELECT candidate_id, embedding_hash FROM s_batch", {**CT, **d.UNSIGNED_YEARS})
def _(i):
    return hashed(i).select("candidate_id", "embedding_hash")


def plan(i):
    b = hashed(i)
    return ig.plan_changes(b, state(i, b))


@query("s14_change_plan", "SELECT candidate_id, source_dataset, needs_upsert, needs_embedding, stored_embedding_hash, concat_ws('+', CASE WHEN needs_upsert THEN 'upsert' END, CASE WHEN needs_embedding THEN 'embed' END) AS action FROM s_plan", CT)
def _(i):
    return plan(i).select("candidate_id", "source_dataset", "needs_upsert", "needs_embedding", "stored_embedding_hash", "action")


@query("s15_upsert_documents", "SELECT 'cust-' || c_custkey AS candidate_id, CASE WHEN c_custkey % 2 = 0 THEN 'set_a' ELSE 'set_b' END AS source_dataset, CASE WHEN c_acctbal < 3000 THEN 'new' ELSE 'old' END AS v FROM customer WHERE c_acctbal < 3000 OR c_acctbal >= 1000")
def _(i):
    c = i.base("customer").select(F.concat(F.lit("cust-"), "c_custkey").alias("candidate_id"), F.when(F.col("c_custkey") % 2 == 0, "set_a").otherwise("set_b").alias("source_dataset"), "c_acctbal")
    s = store(i, c.where("c_acctbal >= 1000").select(*ig.KEY, F.lit("old").alias("v")))
    s.upsert(c.where("c_acctbal < 3000").select(*ig.KEY, F.lit("new").alias("v")), 1)
    return s.read().select("candidate_id", "source_dataset", "v")


@query("s16_mark_synced", "SELECT candidate_id, CASE WHEN source_dataset = 'set_b' THEN 'synced' ELSE pn END AS pn, CASE WHEN source_dataset = 'set_b' THEN 'h-' || candidate_id ELSE pe END AS pe FROM s_state", CT)
def _(i):
    b = hashed(i)
    new = b.where("source_dataset = 'set_b'").select(*ig.KEY, F.lit("synced").alias("normalization_hash"), F.concat(F.lit("h-"), "candidate_id").alias("embedding_hash"))
    r = st.update_only(state(i, b), new, ig.KEY, ["normalization_hash", "embedding_hash"])
    return r.select("candidate_id", F.col("normalization_hash").alias("pn"), F.col("embedding_hash").alias("pe"))


@query("s17_vector_upsert", "SELECT candidate_id, source_dataset, category, coalesce(experience_years, 0.0) AS experience_years, coalesce(seniority_level, '') AS seniority_level, round(CASE WHEN source_dataset = 'set_a' THEN -embedding[1] ELSE embedding[1] END, 6) AS first FROM candidate_vector")
def _(i):
    v = i.candidate_vector()
    s = store(i, st.vector_rows(v))
    s.upsert(st.vector_rows(v.where("source_dataset = 'set_a'").withColumn("embedding", F.transform("embedding", lambda x: -x))), 1)
    return s.read().select("candidate_id", "source_dataset", "category", "experience_years", "seniority_level", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("s18_ingestion_counters", "SELECT count(*) AS seen, count(*) FILTER (needs_upsert) AS upserted, count(*) FILTER (NOT needs_upsert) AS skipped, count(*) FILTER (needs_embedding) AS embedded, count(*) FILTER (NOT needs_embedding) AS embed_skipped FROM s_plan", CT)
def _(i):
    return ig.counters(plan(i))


def golden_file(i) -> str:
    """Golden lines from labelled documents: good, soft, broken, incomplete and empty ones."""
    doc = i.base("documents").join(i.base("labels"), "doc_id")
    k = F.col("doc_id") % 7
    row = F.struct(
        F.concat(F.lit("q-"), "doc_id").alias("query_id"), F.col("lang").alias("job_description"), F.lit("r").alias("expected_role"), F.array("source").alias("expected_skills"),
        F.array(F.lit("x")).alias("expected_optional_skills"), F.when(k != 4, "mid").alias("expected_seniority"), (k == 1).alias("soft_golden"),
        F.when(k == 5, F.array().cast("array<struct<candidate_id:string,grade:int,reason:string>>")).otherwise(F.array(F.struct(
            F.concat(F.lit("c-"), "doc_id").alias("candidate_id"), (F.col("quality") * 2 + 1).cast("int").alias("grade"), F.lit("seed").alias("reason")))).alias("relevant_candidates"))
    path = shared_dir(i.spark, "golden")
    doc.select(F.when(k == 2, "{\"query_id\": oops").when(k == 3, "   ").otherwise(F.to_json(row)).alias("value")).write.text(path)
    return path


@query("s19_golden_set", """
SELECT CASE k WHEN 2 THEN 'malformed' WHEN 4 THEN 'missing expected_seniority' WHEN 5 THEN 'invalid relevant_candidates' ELSE 'ok' END AS status, CASE WHEN k <> 2 THEN 'q-' || doc_id END AS query_id,
 CASE WHEN k NOT IN (2, 5) THEN CAST(quality * 2 + 1 AS BIGINT) END AS grade FROM (SELECT doc_id, doc_id % 7 AS k, quality FROM documents JOIN labels USING (doc_id)) WHERE k NOT IN (1, 3)""")
def _(i):
    g = js.golden_rows(i.spark, golden_file(i))
    return g.select(F.coalesce("reason", F.lit("ok")).alias("status"), F.when(F.coalesce("reason", F.lit("")) != "malformed", F.col("row.query_id")).alias("query_id"),
                    F.get("row.relevant_candidates", F.lit(0))["grade"].cast("long").alias("grade"))


@query("s20_reference_loaders", """
SELECT 'q-' || doc_id AS query_id, 'c-' || source AS candidate_id, CASE doc_id % 4 WHEN 0 THEN quality = 1 WHEN 1 THEN quality = 1 WHEN 2 THEN quality = 1 END AS value, round(n_chars / 1000.0::DOUBLE, 4) AS score
FROM documents JOIN labels USING (doc_id) WHERE doc_id % 4 <> 3""")
def _(i):
    doc = i.base("documents").join(i.base("labels"), "doc_id")
    k = F.col("doc_id") % 4
    v = F.when(k == 0, F.when(F.col("quality") == 1, "true").otherwise("false")).when(k == 1, F.col("quality").cast("string")).when(k == 2, F.when(F.col("quality") == 1, '"Yes"').otherwise('"no"')).otherwise("null")
    path = shared_dir(i.spark, "reference")
    doc.select(F.concat(F.lit('{"query_id": "q-'), "doc_id", F.lit('", "candidate_id": "c-'), "source", F.lit('", "ok": '), v, F.lit(', "q": {"score": '), (F.col("n_chars") / 1000).cast("string"), F.lit("}}"))
               .alias("value")).write.text(path)
    keys = ["query_id", "candidate_id"]
    b = js.read_binary_reference(i.spark, path, "ok", keys)
    return b.join(js.read_float_reference(i.spark, path, "q.score", keys).withColumnRenamed("value", "score"), keys)


@query("s21_jsonl_sink", "SELECT doc_id, text, lang FROM documents")
def _(i):
    path = shared_dir(i.spark, "jsonl")
    js.write_jsonl(i.base("documents").select("doc_id", "text", "lang"), path)
    return i.spark.read.schema("doc_id long, text string, lang string").json(path)


_LAST = "SELECT session_id, candidate_id, rating, notes, created_at, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, candidate_id ORDER BY created_at DESC, event_id DESC) AS rn FROM feedback) WHERE rn = 1"


@query("s23_feedback_upsert", _LAST)
def _(i):
    return latest(i.feedback(), ["session_id", "candidate_id"], ["created_at", "event_id"])


@query("s24_session_feedback", "SELECT session_id, candidate_id, rating, event_id FROM feedback WHERE session_id IN (SELECT session_id FROM feedback WHERE rating = 'pass')")
def _(i):
    f = i.feedback()
    return f.join(f.where("rating = 'pass'").select("session_id").distinct(), "session_id", "left_semi").select("session_id", "candidate_id", "rating", "event_id")


@query("s25_candidate_lookup", "SELECT candidate_id, name, category FROM candidate WHERE candidate_id IN (SELECT candidate_id FROM pair)")
def _(i):
    ids = i.pair().select(F.when(F.col("job_id") != "job-1", F.col("candidate_id")).otherwise("").alias("candidate_id")).unionByName(i.pair().select("candidate_id"))
    return st.lookup(i.candidate(), ids).select("candidate_id", "name", "category")
