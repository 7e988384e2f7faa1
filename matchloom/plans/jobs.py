"""Queries over job-description understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import jobtext as jt
from matchloom.functions import text as tx
from matchloom.operators import ontology as on
from matchloom.operators import profiles as pf
from matchloom.plans import duck as d
from matchloom.plans import skills as sk
from matchloom.plans.registry import query

STOP, GEN = d.lst(jt.STOPWORDS), d.lst(jt.GENERIC)
_WORDS = "list_filter(string_split({}, ' '), lambda w: w <> '')"


def words(x):
    return _WORDS.format(x)


def n_stop(x):
    return f"len(list_filter(string_split({x}, ' '), lambda w: w <> '' AND list_contains({STOP}, w)))"


def noise_ok(t):
    return (f"{t} <> '' AND NOT regexp_matches({t}, {d.q(jt.DATE_LIKE)}) AND NOT list_contains({STOP}, {t}) AND NOT list_contains({GEN}, {t}) AND len({words(t)}) <= 4 AND {n_stop(t)} <= 1 "
            f"AND (len({words(t)}) < 4 OR list_contains({d.lst(jt.HINTED)}, {t})) AND (len({words(t)}) <> 1 OR (length({t}) > 2 AND (length({t}) >= 4 OR list_contains({d.lst(jt.SINGLE_WORDS)}, {t}))))")


def noise_clean(t):
    inner = f"regexp_replace(lower({t}), '[^\\w\\s+#.-]', ' ', 'g')"
    return f"trim({d.squash(inner)}, ' .,-')"


def contains_any(x, ws):
    return "(" + " OR ".join(f"contains({x}, {d.q(w)})" for w in ws) + ")"


STRENGTH = "CASE " + " ".join(f"WHEN {contains_any('s', ws)} THEN {jt.PRIORITY[n]}" for n, ws in jt.CUES) + " ELSE 0 END"
NAME = "CASE {} WHEN 4 THEN 'must have' WHEN 3 THEN 'main focus' WHEN 2 THEN 'nice to have' WHEN 1 THEN 'familiarity' ELSE 'unknown' END"
CT = {
    "j_chunk": f"SELECT job_id, ci, t, {words('t')} AS ws FROM (SELECT job_id, ci, trim({d.squash('c')}, ' .:-') AS t FROM (SELECT job_id, unnest(x) AS c, generate_subscripts(x, 1) AS ci FROM (SELECT job_id, string_split_regex(lower(text), {d.q(jt.SPLIT)}) AS x FROM job_text)))",
    "j_lit_long": f"""SELECT job_id, ci, 0 AS ti, t AS term FROM j_chunk WHERE t <> '' AND length(t) <= 64 AND len(ws) <= 4 AND {n_stop('t')} <= 1
 UNION ALL SELECT * FROM (SELECT job_id, ci, generate_subscripts(k, 1) AS ti, unnest(k) AS term FROM (SELECT job_id, ci, regexp_extract_all(t, '[a-zA-Z0-9][a-zA-Z0-9+.#-]{{1,}}') AS k FROM j_chunk)) WHERE NOT list_contains({STOP}, term)""",
    "j_lit": "SELECT job_id, list(term ORDER BY ci, ti) AS terms FROM (SELECT job_id, term, min(ci * 1000 + ti) AS o, arg_min(ci, ci * 1000 + ti) AS ci, arg_min(ti, ci * 1000 + ti) AS ti FROM j_lit_long WHERE term <> '' GROUP BY 1, 2) GROUP BY 1",
    "j_hint": f"SELECT job_id, {d.dedupe('u')} AS terms FROM (SELECT l.job_id, l.terms || {' || '.join(f'CASE WHEN contains(lower(t.text), {d.q(p)}) THEN {d.lst(h)} ELSE [] END' for p, h in jt.SKILL_HINTS.items())} AS u FROM j_lit l JOIN job_text t USING (job_id))",
    "j_noise": f"SELECT job_id, list_filter(k, lambda x, i: list_position(k, x) = i) AS terms FROM (SELECT job_id, list_filter(c, lambda t: {noise_ok('t')}) AS k FROM (SELECT job_id, list_transform(terms, lambda t: {noise_clean('t')}) AS c FROM j_hint))",
    "j_litnoise": f"SELECT job_id, list_filter(k, lambda x, i: list_position(k, x) = i) AS terms FROM (SELECT job_id, list_filter(c, lambda t: {noise_ok('t')}) AS k FROM (SELECT job_id, list_transform(terms, lambda t: {noise_clean('t')}) AS c FROM j_lit))",
    "j_sent": f"SELECT job_id, s, {STRENGTH} AS p FROM (SELECT job_id, unnest(list_filter(list_transform(string_split_regex(lower(text), '[.!?]\\s+'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM job_text)",
    "j_strength": f"SELECT job_id, i, term, coalesce((SELECT max(p) FROM j_sent z WHERE z.job_id = n.job_id AND len(list_filter({words('term')}, lambda w: NOT contains(s, w))) = 0), 0) AS p FROM (SELECT job_id, generate_subscripts(terms, 1) AS i, unnest(terms) AS term FROM j_noise) n",
    "j_onto": "SELECT DISTINCT job_id, canonical FROM job_text t JOIN (SELECT alias, canonical FROM alias_map UNION ALL SELECT skill, skill FROM taxonomy) v ON regexp_matches(' ' || array_to_string(regexp_extract_all(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ,;:/|'), '[a-zA-Z0-9+.#-]+', 0), '  ') || ' ', ' ' || replace(v.alias, ' ', '  ') || ' ')",
    "j_req": f"""SELECT s.job_id, list(term ORDER BY i) AS terms FROM j_strength s JOIN j_litnoise l USING (job_id) WHERE EXISTS (SELECT 1 FROM j_onto o WHERE o.job_id = s.job_id AND o.canonical = s.term)
  OR p >= 3 OR (list_contains(l.terms, term) AND (len({words('term')}) >= 2 OR list_contains({d.lst(jt.SINGLE_WORDS)}, term))) GROUP BY 1""",
}


def prio(t):
    n = f"len({words(t)})"
    h = f"list_contains({d.lst(jt.HINTED)}, {t})"
    return (f"(CASE WHEN {h} THEN 4 ELSE 0 END + CASE WHEN {n} <= 2 THEN 1 ELSE 0 END + CASE WHEN regexp_matches({t}, '[+#.]|\\d') THEN 2 ELSE 0 END + CASE WHEN {t} IN (SELECT skill FROM taxonomy) THEN 5 ELSE 0 END "
            f"- CASE WHEN list_contains({GEN}, {t}) THEN 6 ELSE 0 END - CASE WHEN list_contains({d.lst(jt.SENIORITY)}, {t}) THEN 6 ELSE 0 END - CASE WHEN {n} >= 3 AND NOT {h} THEN 2 ELSE 0 END)")


CT["j_prio"] = f"SELECT job_id, i, term, {prio('term')} AS p FROM (SELECT job_id, generate_subscripts(terms, 1) AS i, unnest(terms) AS term FROM j_noise)"
CT["j_sorted"] = """SELECT job_id, term, row_number() OVER (PARTITION BY job_id ORDER BY p DESC, least(len(string_split(term, ' ')), 4) DESC, length(term) DESC, i) AS o FROM (SELECT *, max(p) OVER (PARTITION BY job_id) AS mp FROM j_prio) WHERE p > 0 OR mp <= 0"""
_FRAG = f"""SELECT s.job_id, term, o FROM {{src}} s WHERE NOT (len(string_split(term, ' ')) = 1 AND (list_contains({d.lst(jt.SENIORITY)}, term) OR (NOT list_contains({d.lst(jt.SINGLE_WORDS)}, term)
 AND EXISTS (SELECT 1 FROM {{src}} z WHERE z.job_id = s.job_id AND len(string_split(z.term, ' ')) >= 2 AND length(s.term) >= 4 AND list_contains(string_split(z.term, ' '), s.term)))))"""
CT["j_frag"] = _FRAG.replace("{src}", "j_sorted")
CT["j_comp"] = "SELECT job_id, list(term ORDER BY o)[1:18] AS terms FROM j_frag GROUP BY 1"


def texts(i):
    return jt.prepare(i.job_text())


def joined(df, col, name="terms"):
    return df.select("job_id", F.array_join(col, "|").alias(name))


def known(i):
    """Taxonomy names as one literal-free array per job: only the names among the job's own terms."""
    t = texts(i).select("job_id", "_filtered", F.explode("_filtered").alias("skill"))
    k = t.join(i.taxonomy().select("skill"), "skill", "left_semi").groupBy("job_id").agg(F.collect_set("skill").alias("core_terms"))
    empty = F.array().cast("array<string>")
    return texts(i).join(k, "job_id", "left").withColumn("core_terms", F.coalesce("core_terms", empty))


@query("j01_literal_candidates", f"SELECT job_id, {d.join('terms')} AS terms FROM j_lit", CT)
def _(i):
    return joined(texts(i), "_literal")


@query("j02_phrase_hints", f"SELECT job_id, {d.join('terms')} AS terms FROM j_hint", CT)
def _(i):
    return joined(texts(i), "_raw")


@query("j03_noise_filter", f"SELECT job_id, {d.join('terms')} AS terms FROM j_noise", CT)
def _(i):
    return joined(texts(i), "_filtered")


def with_ontology_terms(i):
    vocab = i.alias_map().unionByName(i.taxonomy().select(F.col("skill").alias("alias"), F.col("skill").alias("canonical")))
    hits = on.ngram_hits(i.job_text(), "job_id", vocab).groupBy("job_id").agg(F.collect_set("canonical").alias("ontology_terms"))
    return texts(i).join(hits, "job_id", "left").withColumn("ontology_terms", F.coalesce("ontology_terms", F.array().cast("array<string>")))


@query("j04_required_candidates", f"SELECT job_id, {d.join('terms')} AS terms FROM j_req", CT)
def _(i):
    return joined(jt.required_candidates(with_ontology_terms(i)), "_req0").where("terms <> ''")


@query("j05_term_priority", "SELECT job_id, term, CAST(p AS BIGINT) AS priority FROM j_prio", CT)
def _(i):
    k = known(i).select("job_id", "core_terms", F.explode("_filtered").alias("term"))
    return k.select("job_id", "term", jt.term_priority(F.col("term"), F.col("core_terms"), F.array().cast("array<string>")).cast("long").alias("priority"))


@query("j06_drop_fragments", f"SELECT job_id, string_agg(term, '|' ORDER BY o) AS terms FROM ({_FRAG.replace('{src}', 'j_flat')}) GROUP BY 1", {**CT, "j_flat": "SELECT job_id, generate_subscripts(terms, 1) AS o, unnest(terms) AS term FROM j_noise"})
def _(i):
    return joined(texts(i).withColumn("k", jt.drop_fragments(F.col("_filtered"))), "k")


@query("j07_compress_terms", f"SELECT job_id, {d.join('terms')} AS terms FROM j_comp", CT)
def _(i):
    return joined(known(i).withColumn("k", jt.compress(F.col("_filtered"), F.col("core_terms"), F.array().cast("array<string>"), 18)), "k")


_ALL = "SELECT job_id AS id, text FROM job_text UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations"


def all_texts(i):
    c = i.base("conversations").select(F.concat(F.lit("c-"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return i.job_text().withColumnRenamed("job_id", "id").unionByName(c)


@query("j08_required_years", f"SELECT id, list_max(list_transform(regexp_extract_all(text, '(?i)(\\d+(?:\\.\\d+)?)\\s*\\+?\\s*(?:years?|yrs?)', 1), lambda y: CAST(y AS DOUBLE))) AS years FROM ({_ALL})")
def _(i):
    return all_texts(i).select("id", jt.required_years(F.col("text")).alias("years"))


@query("j09_preferred_seniority", f"SELECT id, CASE {' '.join(f'WHEN regexp_matches(lower(text), {d.q(chr(92) + chr(98) + k + chr(92) + chr(98))}) THEN {d.q(k)}' for k in jt.SENIORITY)} END AS level FROM ({_ALL})")
def _(i):
    return all_texts(i).select("id", jt.preferred_seniority(F.col("text")).alias("level"))


@query("j10_sentences", "SELECT job_id, s AS sentence FROM j_sent", CT)
def _(i):
    return i.job_text().select("job_id", F.explode(jt.sentences(F.col("text"))).alias("sentence"))


@query("j11_term_strength", f"SELECT job_id, term, {NAME.format('p')} AS strength, {NAME.format('greatest(p, 1)')} AS at_least_familiar FROM j_strength", CT)
def _(i):
    t = texts(i).select("job_id", "_graded", F.explode("_filtered").alias("term"))
    return t.select("job_id", "term", jt.term_strength(F.col("term"), F.col("_graded"), "unknown").alias("strength"),
                    jt.term_strength(F.col("term"), F.col("_graded"), "familiarity").alias("at_least_familiar"))


_PHRASE = "CASE " + " ".join(f"WHEN contains(lower(text), {d.q(r)}) THEN {d.q(r)}" for r in jt.ROLES) + " END"
_XROLES = ["talent", "team player"]
_ROLES = f"""list_filter([{_PHRASE}, {', '.join(f"CASE WHEN contains(lower(text), {d.q(r)}) THEN {d.q(r)} END" for r in sorted(_XROLES, key=len, reverse=True))}, CASE WHEN contains(lower(text), 'backend') THEN 'backend engineer' END,
 CASE WHEN contains(lower(text), 'backend') AND contains(lower(text), 'web application') THEN 'backend web application developer' END, CASE WHEN {contains_any('lower(text)', ['integration', 'connect multiple systems', 'services that connect'])} THEN 'integration/service engineer' END,
 CASE WHEN {contains_any('lower(text)', ['junior software engineer', 'graduate software engineer', 'entry-level software engineering', 'associate engineer'])} THEN 'junior software engineer' END,
 CASE WHEN {contains_any('lower(text)', ['senior architect', 'architecture leadership'])} THEN 'senior architect' END], lambda x: x IS NOT NULL)"""
CT["j_role"] = f"SELECT job_id, text, {_PHRASE} AS phrase, {_ROLES} AS r FROM job_text"
CT["j_roles"] = f"SELECT job_id, text, phrase, {d.dedupe('r')} AS roles FROM j_role"


def tokens(i, names):
    """An ontology's names as the table they are kept in."""
    return i.spark.createDataFrame([(n,) for n in names], "token string")


def roled(i):
    t = texts(i).withColumn("phrase", jt.role_phrase(F.col("text")))
    t = pf.with_known(t, tokens(i, _XROLES), "known_roles")
    return t.withColumn("roles", jt.roles(F.col("text"), F.col("phrase"), F.col("known_roles")))


@query("j12_roles", f"SELECT job_id, phrase, {d.join('roles')} AS roles FROM j_roles", CT)
def _(i):
    return roled(i).select("job_id", "phrase", F.array_join("roles", "|").alias("roles"))


_CATW = " ".join(f"WHEN {contains_any('b', ws)} THEN {d.q(n)}" for n, ws in jt.CATEGORY_WORDS)


@query("j13_job_category", f"SELECT id, CASE {_CATW} END AS category FROM (SELECT job_id AS id, lower(text) || ' reporting' AS b FROM job_text UNION ALL SELECT 'd-' || doc_id, lower(text) || ' reporting' FROM documents)")
def _(i):
    both = i.job_text().select(F.col("job_id").alias("id"), "text").unionByName(i.spread("documents", "doc_id").select(F.concat(F.lit("d-"), F.col("doc_id")).alias("id"), "text"))
    none = F.lit(None).cast("string")
    return both.select("id", jt.job_category(F.col("text"), none, F.array(F.lit("reporting")), none).alias("category"))


_CAPS = ["team player", "retail"]
CT["j_cap"] = f"""SELECT job_id, i, name, coalesce((SELECT max(p) FROM j_sent z WHERE z.job_id = n.job_id AND len(list_filter({words('name')}, lambda w: NOT contains(s, w))) = 0), 0) AS p FROM (
 SELECT job_id, min(i) AS i, name FROM (SELECT job_id, generate_subscripts(c, 1) AS i, unnest(c) AS name FROM (SELECT job_id, list_filter([{', '.join(f'CASE WHEN contains(lower(text), {d.q(p)}) THEN {d.q(c)} END' for p, c in jt.CAPABILITY_HINTS.items())},
 {', '.join(f'CASE WHEN contains(lower(text), {d.q(c)}) THEN {d.q(c)} END' for c in sorted(_CAPS, key=len, reverse=True))}], lambda x: x IS NOT NULL) AS c FROM job_text)) GROUP BY 1, 3) n"""


def signals(i):
    t = known(i).withColumn("req", jt.compress(F.col("_filtered"), F.col("core_terms"), F.array().cast("array<string>"), 18))
    t = pf.with_known(pf.with_known(t, tokens(i, _XROLES), "known_roles"), tokens(i, _CAPS), "known_capabilities")
    t = t.withColumn("phrase", jt.role_phrase(F.col("text"))).withColumn("roles", jt.roles(F.col("text"), F.col("phrase"), F.col("known_roles")))
    return t.withColumn("skills", jt.skill_signals(F.col("req"))).withColumn("caps", jt.capability_signals(F.col("text"), F.col("_graded"), F.col("known_capabilities")))


@query("j14_capability_signals", f"SELECT job_id, name, {NAME.format('greatest(p, 1)')} AS strength FROM j_cap", CT)
def _(i):
    return signals(i).select("job_id", F.explode("caps").alias("s")).select("job_id", "s.name", "s.strength")


_STRENGTHS = list(jt.PRIORITY)
CT["j_sig"] = f"SELECT conv_id, turn AS i, {d.lst(_STRENGTHS)}[(length(text) % 5) + 1] AS strength, CASE WHEN turn % 2 = 0 THEN upper(role) ELSE role END || '-' || (length(text) % 2) AS name FROM conversations"
CT["j_sig_best"] = "SELECT conv_id, lower(name) AS k, arg_min(name, (5 - CASE strength WHEN 'must have' THEN 4 WHEN 'main focus' THEN 3 WHEN 'nice to have' THEN 2 WHEN 'familiarity' THEN 1 ELSE 0 END) * 100000 + i) AS name, arg_min(strength, (5 - CASE strength WHEN 'must have' THEN 4 WHEN 'main focus' THEN 3 WHEN 'nice to have' THEN 2 WHEN 'familiarity' THEN 1 ELSE 0 END) * 100000 + i) AS strength FROM j_sig GROUP BY 1, 2"


def hand_signals(i):
    """Signals of mixed strength, one per conversation turn, kept in long form."""
    n = F.length("text")
    return i.base("conversations").select(
        "conv_id", F.col("turn").alias("i"), F.element_at(F.array(*[F.lit(s) for s in _STRENGTHS]), (n % 5 + 1).cast("int")).alias("strength"),
        F.concat(F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.col("role")), F.lit("-"), n % 2).alias("name"))


def best_signals(i):
    ranks = F.create_map(*[F.lit(x) for kv in jt.PRIORITY.items() for x in kv])
    s = hand_signals(i).withColumn("p", -F.element_at(ranks, F.col("strength")))
    return s.groupBy("conv_id", F.lower(F.trim("name")).alias("k")).agg(F.min(F.struct("p", "i", "name", "strength")).alias("b")).select("conv_id", "k", "b.name", "b.strength")


@query("j15_dedupe_signals", "SELECT conv_id, name, strength FROM j_sig_best", CT)
def _(i):
    return best_signals(i).select("conv_id", "name", "strength")


@query("j16_signal_quality", "SELECT conv_id, count(*) AS total, count(*) FILTER (strength = 'unknown') AS unknown, count(*) FILTER (strength = 'must have') AS must_have, count(*) FILTER (strength = 'familiarity') AS familiarity, round(count(*) FILTER (strength = 'unknown') / count(*), 4) AS unknown_ratio FROM j_sig_best GROUP BY 1", CT)
def _(i):
    n = {k: F.count_if(F.col("strength") == v) for k, v in (("unknown", "unknown"), ("must_have", "must have"), ("familiarity", "familiarity"))}
    return best_signals(i).groupBy("conv_id").agg(F.count("*").alias("total"), *[c.alias(k) for k, c in n.items()], F.round(n["unknown"] / F.count("*"), 4).alias("unknown_ratio"))


CT["j_capl"] = "SELECT job_id, list(name ORDER BY i) AS caps, list(name ORDER BY greatest(p, 1) DESC, i) AS caps_s, list(greatest(p, 1) ORDER BY i) AS ps FROM j_cap GROUP BY 1"
CT["j_sigs"] = "SELECT r.job_id, r.text, r.phrase, r.roles, c.terms AS req, coalesce(k.caps, []) AS caps, coalesce(k.caps_s, []) AS caps_s, coalesce(k.ps, []) AS ps FROM j_roles r JOIN j_comp c USING (job_id) LEFT JOIN j_capl k USING (job_id)"


@query("j17_lexical_query", f"SELECT job_id, array_to_string({d.dedupe('u')}, ' ') AS q FROM (SELECT job_id, roles || req || caps_s AS u FROM j_sigs)", CT)
def _(i):
    return signals(i).select("job_id", jt.lexical_query(F.col("roles"), F.col("skills"), F.col("caps")).alias("q"))


@query("j18_query_expansion", f"SELECT job_id, {d.join(d.dedupe('u'))} AS terms FROM (SELECT job_id, roles || req || ['extra', 'sql'] || caps AS u FROM j_sigs)", CT)
def _(i):
    x = F.array(F.lit("extra"), F.lit("sql"))
    return signals(i).select("job_id", F.array_join(jt.query_expansion(F.col("roles"), F.col("req"), x, F.col("caps")), "|").alias("terms"))


@query("j19_embedding_query", f"""SELECT job_id, array_to_string({d.dedupe('u')}, ' ') AS q FROM (SELECT job_id, [coalesce(phrase, ''), 'it'] || r || list_filter(x, lambda t: NOT list_contains(r, t))[1:CASE WHEN wide THEN 12 ELSE 8 END] || ['senior'] AS u FROM (
 SELECT job_id, phrase, wide, req[1:CASE WHEN wide THEN 16 ELSE 12 END] AS r, x FROM (SELECT *, list_contains(roles, 'junior software engineer') OR list_contains(roles, 'senior architect') AS wide, (SELECT n.terms FROM j_noise n WHERE n.job_id = s.job_id) AS x FROM j_sigs s)))""", CT)
def _(i):
    return signals(i).select("job_id", jt.embedding_query(F.col("phrase"), F.lit("it"), F.col("req"), F.col("_filtered"), F.lit("senior"), F.col("roles")).alias("q"))


@query("j20_transferable_score", """SELECT job_id, round(least(1.0, coalesce(list_sum(list_transform(ps, lambda p: CASE p WHEN 4 THEN 1.0 WHEN 3 THEN 0.85 WHEN 2 THEN 0.65 ELSE 0.45 END)) / nullif(len(ps), 0), 0)::DOUBLE * 0.5::DOUBLE
 + least(1.0, len(req) % 8 / 6.0::DOUBLE) * 0.35::DOUBLE + least(1.0, len(req) / 8.0::DOUBLE) * 0.15::DOUBLE), 3) AS score FROM j_sigs""", CT)
def _(i):
    return signals(i).select("job_id", jt.transferable_score(F.col("caps"), F.size("req") % 8, F.col("req")).alias("score"))


CT["j_conf"] = f"SELECT job_id, round(0.35::DOUBLE + CASE WHEN len(req) >= 2 THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN phrase IS NOT NULL THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN regexp_matches(lower(text), '\\b({'|'.join(jt.SENIORITY)})\\b') THEN 0.1 ELSE 0 END::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE, 3) AS confidence FROM j_sigs"


def confidences(i):
    s, x = signals(i), F.col("text")
    return s.select("job_id", jt.query_confidence(F.col("req"), F.col("phrase"), jt.preferred_seniority(x), jt.required_years(x), x).alias("confidence"))


@query("j21_query_confidence", "SELECT * FROM j_conf", CT)
def _(i):
    return confidences(i)


@query("j22_related_fallback", f"""SELECT id, {d.join("list_filter(k, lambda x, i: list_position(k, x) = i)")} AS terms FROM (SELECT id, list_filter(list_transform(list_filter(c, lambda t: len({words('t')}) BETWEEN 2 AND 4 AND t <> 'team player' AND {n_stop('t')} <= 1), lambda t: {noise_clean('t')}), lambda t: {noise_ok('t')} AND t <> 'team player') AS k FROM (
 SELECT id, list_transform(string_split_regex(lower(text), {d.q(jt.SPLIT)}), lambda t: {noise_clean('t')}) AS c FROM (SELECT job_id AS id, text FROM job_text UNION ALL SELECT 'd-' || doc_id, text FROM documents)))""")
def _(i):
    both = i.job_text().select(F.col("job_id").alias("id"), "text").unionByName(i.spread("documents", "doc_id").select(F.concat(F.lit("d-"), F.col("doc_id")).alias("id"), "text"))
    return both.select("id", F.array_join(jt.related_fallback(F.col("text"), F.array(F.lit("team player"))), "|").alias("terms"))


def _flat(p):
    return p.select(
        "job_id", *[F.array_join(c, "|").alias(c) for c in ("required_skills", "related_skills", "roles", "query_expansion")], "preferred_seniority", "job_category", "required_years",
        "transferable_score", "lexical_query", "query_text", "confidence", F.col("signal_quality.total").alias("signals"))


@query("j23_full_profile")
def _(i):
    return _flat(jt.profile(i.job_text()))


@query("j23b_ontology_profile")
def _(i):
    return _flat(pf.ontology_profile(i.job_text(), sk.ontology(i), tokens(i, _XROLES), tokens(i, _CAPS)))


@query("j24_fallback_gate", "SELECT job_id, CASE WHEN confidence < 0.62 THEN 'low_confidence' WHEN u > 0.55 THEN 'high_unknown_ratio' END AS reason FROM (SELECT job_id, confidence - (s_suppkey % 4) * 0.1 AS confidence, (s_suppkey % 3) * 0.3 AS u FROM j_conf JOIN job USING (job_id))", CT)
def _(i):
    k = F.col("s_suppkey")
    c = confidences(i).join(i.job().select("job_id", "s_suppkey"), "job_id")
    return c.select("job_id", jt.fallback_reason(F.col("confidence") - (k % 4) * 0.1, (k % 3) * 0.3).alias("reason"))


_M = f"""SELECT job_id, {d.join('req2')} AS required_skills, {d.join('list_filter(rel2, lambda x: NOT list_contains(req2, x))')} AS related_skills, confidence, preferred_seniority, required_years FROM (
 SELECT job_id, {d.dedupe('rq')} AS req2, {d.dedupe('rl')} AS rel2, confidence, preferred_seniority, required_years FROM (SELECT job_id, related_skills || ['sql'] || required_skills AS rq, ['python', 'sql'] || related_skills AS rl, greatest(0.8::DOUBLE, min_years / 5) AS confidence,
 coalesce(CASE WHEN category IS NOT NULL THEN 'lead' END, preferred_seniority) AS preferred_seniority, coalesce(CASE WHEN min_years <> 0 THEN min_years END, 7.0)::DOUBLE AS required_years FROM job_doc))"""


@query("j25_merge_profiles", _M)
def _(i):
    j = i.job_doc()
    none, sig = F.lit(None).cast("string"), F.array().cast(jt.SIGNAL)
    def prof(req, rel, sen, years, conf):
        return j.select("job_id", req.alias("required_skills"), rel.alias("related_skills"), F.array().cast("array<string>").alias("roles"), sig.alias("skill_signals"), sig.alias("capability_signals"),
                        years.alias("required_years"), sen.alias("preferred_seniority"), none.alias("job_category"), none.alias("query_text"), conf.alias("confidence"))
    p = prof(F.col("required_skills"), F.col("related_skills"), F.col("preferred_seniority"), F.col("min_years"), F.col("min_years") / 5)
    f = prof(F.concat("related_skills", F.array(F.lit("sql"))), F.array(F.lit("python"), F.lit("sql")), F.when(F.col("category").isNotNull(), "lead"), F.lit(7.0), F.lit(0.8))
    return jt.merge_profiles(p, f).select("job_id", F.array_join("required_skills", "|").alias("required_skills"), F.array_join("related_skills", "|").alias("related_skills"),
                                          "confidence", "preferred_seniority", "required_years")


@query("j26_draft_text", f"""SELECT job_id, concat_ws('. ', 'role: ' || phrase, CASE WHEN len(roles) > 0 THEN 'roles: ' || array_to_string(roles, ', ') END, 'must have: ' || array_to_string(req, ', '),
 CASE WHEN len(caps) > 0 THEN 'capabilities: ' || array_to_string(list_transform(caps, lambda c, i: {NAME.format('ps[i]')} || ': ' || c), ', ') END, 'related skills: ' || req[1], 'seniority: mid') AS draft FROM j_sigs""", CT)
def _(i):
    return signals(i).select("job_id", jt.draft_text(F.col("phrase"), F.col("roles"), F.col("skills"), F.col("caps"), F.slice("req", 1, 1), F.lit("mid")).alias("draft"))


CT["j_seed"] = f"""SELECT job_id, min(pos) AS pos, token FROM (SELECT job_id, generate_subscripts(s, 1) AS pos, {d.clean_token('unnest(s)')} AS token FROM (
 SELECT job_id, roles || req || caps || req || coalesce((SELECT list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z0-9][a-zA-Z0-9+.#-]{{1,}}'), lambda t: lower(t)), lambda t: NOT list_contains({d.lst(jt.QUERY_STOPWORDS)}, t))), []) AS s FROM j_sigs)) GROUP BY 1, 3"""
_TOK = f"list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z0-9][a-zA-Z0-9+.#-]{{1,}}'), lambda t: lower(t)), lambda t: NOT list_contains({d.lst(jt.QUERY_STOPWORDS)}, t))"
CT["j_seed"] = f"""SELECT job_id, min(pos) AS pos, token FROM (SELECT job_id, pos, {d.clean_token('u')} AS token FROM (SELECT job_id, generate_subscripts(s, 1) AS pos, unnest(s) AS u FROM (
 SELECT job_id, roles || req || caps || req || list_filter(k, lambda x, i: list_position(k, x) = i) AS s FROM (SELECT *, {_TOK} AS k FROM j_sigs)))) WHERE token IS NOT NULL GROUP BY 1, 3"""
CT["j_qcanon"] = "SELECT job_id, coalesce(a.canonical, token) AS term, min(pos) AS pos FROM j_seed LEFT JOIN alias_map a ON a.alias = token GROUP BY 1, 2"
CT["j_qback"] = "SELECT job_id, term, 1000000 + row_number() OVER (PARTITION BY job_id ORDER BY term) AS pos FROM (SELECT DISTINCT c.job_id, a.alias AS term FROM j_qcanon c JOIN alias_map a ON a.canonical = c.term) b WHERE NOT EXISTS (SELECT 1 FROM j_qcanon z WHERE z.job_id = b.job_id AND z.term = b.term)"


def seeds(i):
    s = signals(i)
    e = F.array().cast("array<string>")
    arr = jt.query_seeds(F.col("roles"), F.col("skills"), F.col("caps"), F.col("req"), e, e, F.col("text"))
    return s.select("job_id", F.posexplode(arr).alias("pos", "token"))


@query("j28_query_terms", "SELECT job_id, place, term FROM (SELECT job_id, term, row_number() OVER (PARTITION BY job_id ORDER BY pos, term) AS place FROM (SELECT job_id, term, pos FROM j_qcanon UNION ALL SELECT job_id, term, pos FROM j_qback WHERE pos <= 1000012)) WHERE place <= 32", CT)
def _(i):
    return pf.query_terms(seeds(i), i.alias_map())


@query("j29_query_tokens", f"SELECT id, {d.join('list_filter(k, lambda x, i: list_position(k, x) = i)')} AS tokens FROM (SELECT id, {_TOK} AS k FROM (SELECT job_id AS id, text FROM job_text UNION ALL SELECT 'b-' || item_id, text FROM benchmark))")
def _(i):
    both = i.job_text().select(F.col("job_id").alias("id"), "text").unionByName(i.base("benchmark").select(F.concat(F.lit("b-"), F.col("item_id")).alias("id"), "text"))
    return both.select("id", F.array_join(jt.query_tokens(F.col("text")), "|").alias("tokens"))


@query("j30_skill_signals", "SELECT job_id, skill AS name, 'must have' AS strength FROM job_skill WHERE ord <= 6")
def _(i):
    return i.job_doc().select("job_id", F.explode(jt.skill_signals(F.col("required_skills"))).alias("s")).select("job_id", "s.name", "s.strength")
