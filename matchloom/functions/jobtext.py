"""Job-description understanding as row-local expressions.

The cue lists and hint tables are fixed and small, so they are literals in the
plan: no join, no shuffle. ``profile`` chains the steps as successive columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.scoring import clip01
from matchloom.functions.text import blank_to_null, clean_token, dedupe, first_items, let, squash

# Fixed values -----------------------------------------------------------
STOPWORDS = [
    "and", "or", "the", "with", "for", "from", "into", "years", "year", "experience", "required", "preferred", "plus", "need", "needs", "someone",
    "somebody", "their", "them", "who", "that", "this", "these", "those", "can", "could", "should", "must", "work", "works", "working", "used",
    "using", "tool", "tools", "career", "early", "entry", "level", "interpret", "interpreting", "dataset", "datasets", "we", "are", "is", "am",
    "was", "were", "be", "been", "being", "it", "its", "mainly", "mostly", "only", "just", "on", "at", "to", "of", "in", "by", "as", "would",
    "helpful", "familiarity", "multiple", "connect", "building", "has", "have", "had", "looking", "nice",
]
GENERIC = [
    "opportunities", "requirements", "requirement", "responsibilities", "responsibility", "role", "roles", "main", "focus", "focused", "field",
    "domain", "related", "internal", "external", "across", "define", "target", "targets", "evolution", "platform", "platforms", "talent",
    "intelligence", "team", "teams", "engineering", "support", "supports", "supporting", "process", "processes", "hiring", "hire", "client",
    "clients", "guide", "guides", "guiding", "program", "programs", "solution", "solutions", "mentor", "mentoring", "decision", "decisions",
    "balancing", "reliability", "scalability", "cost", "costs", "standards", "governance", "strong", "excellent", "communication", "regulated",
    "enterprise", "equivalent", "deep", "expertise", "include", "includes", "code", "task", "tasks", "write", "under", "learn", "proven", "drive",
    "review", "layers", "matching", "analyst", "consultant", "consulting", "business", "operational", "improvement", "stakeholder", "management",
    "programming", "software", "engineer", "foundational", "understanding", "basics", "change", "changes", "culture", "mission", "operate",
    "operating", "measure", "measuring", "beyond", "become", "mere", "literacy", "understandable", "qualifications", "user-centric", "usability",
    "interfaces", "responsive", "frameworks", "performance", "integration", "ai-driven", "visualization",
]
SENIORITY = ["intern", "junior", "mid", "senior", "lead", "staff", "principal"]
SINGLE_WORDS = [
    "api", "sql", "aws", "gcp", "azure", "java", "python", "scala", "spark", "docker", "kafka", "redis", "linux", "react", "node", "git", "go",
    "rust", "ruby", "php", "swift", "kotlin", "c", "c++", "c#", "r",
]
MAX_WORDS, MAX_REQUIRED, MAX_RELATED = 4, 18, 12
EMBED_CAPS, WIDE_CAPS = (12, 8), (16, 12)
WIDE_ROLES = ["junior software engineer", "senior architect"]
ROLES = [
    "backend engineer", "backend developer", "junior software engineer", "graduate software engineer", "associate engineer", "software engineer",
    "data engineer", "data scientist", "machine learning engineer", "ml engineer", "devops engineer", "platform engineer", "frontend engineer",
    "full stack engineer", "fullstack engineer", "qa engineer", "qa automation engineer", "test automation engineer", "business analyst", "hr manager",
    "hr coordinator", "recruiter", "project manager", "product manager", "database administrator", "senior architect", "solutions architect", "consultant",
]
CUES = [
    ("must have", ["must", "required", "essential", "need to", "needs to"]), ("main focus", ["main focus", "primarily", "mainly", "core focus"]),
    ("nice to have", ["nice to have", "preferred", "plus", "good to have"]), ("familiarity", ["familiarity", "exposure", "understanding", "awareness"]),
]
PRIORITY = {"must have": 4, "main focus": 3, "nice to have": 2, "familiarity": 1, "unknown": 0}
STRENGTH_VALUE = {"must have": 1.0, "main focus": 0.85, "nice to have": 0.65, "familiarity": 0.45, "unknown": 0.35}
SKILL_HINTS = {
    "analyze business data": ["data analysis", "business analysis"], "interpreting datasets": ["data analysis"], "generate reports": ["reporting"],
    "build dashboards": ["reporting", "data visualization"], "business data": ["data analysis"], "backend of web applications": ["backend", "web", "api"],
    "connect multiple systems": ["api", "integration", "microservices"], "deployment environments": ["deployment", "devops", "cloud"],
    "modern deployment environments": ["deployment", "devops", "cloud"], "fullstack engineer": ["java", "spring boot", "react", "rest api", "postgresql"],
    "full stack engineer": ["java", "spring boot", "react", "rest api", "postgresql"], "fullstack features": ["java", "spring boot", "react", "rest api"], "test automation": ["test automation", "selenium", "pytest", "api testing", "ci/cd"], "qa automation": ["test automation", "selenium", "pytest", "api testing", "ci/cd"],
    "automated quality gates": ["test automation", "api testing"],
    "machine learning engineer": ["machine learning", "python", "pytorch", "feature engineering", "model deployment"],
    "production ml pipelines": ["machine learning", "python", "pytorch", "model deployment"], "nlp-powered": ["machine learning", "python"],
    "business analyst": ["requirements gathering", "stakeholder management", "sql", "reporting", "process mapping"],
    "requirements management": ["requirements gathering", "stakeholder management"], "operational improvement": ["process mapping", "reporting"],
    "senior architect": ["system architecture", "cloud architecture", "distributed systems", "security by design", "technical leadership"],
    "enterprise-scale architecture": ["system architecture", "cloud architecture", "distributed systems"],
    "modernization programs": ["system architecture", "cloud architecture"],
    "cross-domain architecture strategy": ["system architecture", "distributed systems", "technical leadership"],
    "architecture standards and governance": ["system architecture", "technical leadership", "solution governance"],
    "architecture review practices": ["system architecture", "technical leadership", "security by design"],
    "junior software engineer": ["python", "java", "git", "data structures", "unit testing"], "entry-level software engineering": ["python", "java", "git", "data structures", "unit testing"], "graduate software engineer": ["python", "java", "git", "data structures", "unit testing"],
    "associate engineer": ["python", "java", "git", "unit testing"], "version control": ["git"], "cs fundamentals": ["data structures"],
    "unit testing basics": ["unit testing"],
}
CAPABILITY_HINTS = {
    "backend of web applications": "backend development", "web applications": "web application development",
    "connect multiple systems": "system integration", "connect systems": "system integration", "services that connect": "api/service connectivity",
    "deployment environments": "deployment environment understanding", "modern deployment environments": "deployment environment understanding",
    "container": "devops / cloud / container familiarity", "cloud": "devops / cloud / container familiarity", "devops": "devops / cloud / container familiarity",
    "junior software engineer": "software engineering fundamentals", "entry-level software engineering": "software engineering fundamentals",
    "senior architect": "architecture leadership", "architecture governance": "architecture leadership", "architecture review practices": "architecture leadership",
}
ROLE_RULES = [  # a role is meant if every group has a word in the text
    ("backend engineer", [["backend"]]), ("backend web application developer", [["backend"], ["web application"]]),
    ("integration/service engineer", [["integration", "connect multiple systems", "services that connect"]]),
    ("junior software engineer", [["junior software engineer", "graduate software engineer", "entry-level software engineering", "associate engineer"]]),
    ("senior architect", [["senior architect", "architecture leadership"]]),
]
CATEGORY_WORDS = [
    ("human resources", ["hr", "human resources", "recruit", "talent acquisition", "people operations"]),
    ("data science", ["data scientist", "machine learning", "analytics", "data science"]),
    ("information technology", ["backend engineer", "software engineer", "developer", "devops", "platform engineer"]),
    ("database", ["database administrator", "sql developer", "database"]),
]
QUERY_STOPWORDS = [
    "and", "or", "the", "with", "for", "from", "into", "years", "year", "experience", "required", "preferred", "plus", "role", "looking", "senior",
    "junior",
]
DATE_LIKE = r"\b(?:\d{1,2}/\d{2,4}|19\d{2}|20\d{2})\b"
FALLBACK = {"confidence": 0.62, "unknown_ratio": 0.55}
# ------------------------------------------------------------------------
HINTED = sorted({h for hs in SKILL_HINTS.values() for h in hs})
SPLIT = r"[,\n;/|]+"
SIGNAL = "array<struct<name:string,strength:string,kind:string>>"


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _empty() -> Column:
    return F.array().cast("array<string>")


def _words(t: Column) -> Column:
    return F.filter(F.split(t, " "), lambda w: w != "")


def _any(c: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def literal_candidates(text: Column) -> Column:
    """Per chunk: the chunk itself when it reads like a phrase, then its non-stop tokens."""
    def of_chunk(chunk):
        def build(t):
            words = _words(t)
            stops = F.size(F.filter(words, lambda w: w.isin(STOPWORDS)))
            phrase = (t != "") & (F.length(t) <= 64) & (F.size(words) <= MAX_WORDS) & (stops <= 1)
            tokens = F.filter(F.regexp_extract_all(t, F.lit("[a-zA-Z0-9][a-zA-Z0-9+.#-]{1,}"), F.lit(0)), lambda w: ~w.isin(STOPWORDS))
            return F.concat(F.when(phrase, F.array(t)).otherwise(_empty()), tokens)

        return let(F.btrim(squash(chunk), F.lit(" .:-")), build)

    return dedupe(F.flatten(F.transform(F.split(F.lower(text), SPLIT), of_chunk)))


def with_hints(text: Column, candidates: Column) -> Column:
    found = let(F.lower(text), lambda t: F.flatten(F.array(*[F.when(t.contains(p), _lits(h)).otherwise(_empty()) for p, h in SKILL_HINTS.items()])))
    return dedupe(F.concat(candidates, found))


def filter_noise(terms: Column) -> Column:
    def token(t):
        return F.btrim(squash(F.regexp_replace(F.lower(t), r"[^\w\s+#.-]", " ")), F.lit(" .,-"))

    def keep(t):
        words = _words(t)
        n = F.size(words)
        stops = F.size(F.filter(words, lambda w: w.isin(STOPWORDS)))
        single = (F.length(t) > 2) & ((F.length(t) >= 4) | t.isin(SINGLE_WORDS))
        return (
            (t != "") & ~t.rlike(DATE_LIKE) & ~t.isin(STOPWORDS) & ~t.isin(GENERIC) & (n <= MAX_WORDS) & (stops <= 1)
            & ((n < 4) | t.isin(HINTED)) & ((n != 1) | single))

    return F.array_distinct(F.filter(F.transform(terms, token), keep))


def sentences(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.lower(text), r"[.!?]\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lower(text)))


def sentence_strength(s: Column) -> Column:
    out = F.lit("unknown")
    for name, cues in reversed(CUES):
        out = F.when(_any(s, cues), F.lit(name)).otherwise(out)
    return out


def graded_sentences(text: Column) -> Column:
    """array<struct<s, p>>: sentences with the priority of their cue."""
    ranks = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return F.transform(sentences(text), lambda s: F.struct(s.alias("s"), F.element_at(ranks, sentence_strength(s)).alias("p")))


def term_strength(term: Column, graded: Column, default: str) -> Column:
    """Best cue over sentences holding all of the term's words; never below the default."""
    words = _words(F.lower(term))
    best = F.array_max(F.transform(F.filter(graded, lambda e: F.forall(words, lambda w: e["s"].contains(w))), lambda e: e["p"]))
    p = F.greatest(F.coalesce(best, F.lit(0)), F.lit(PRIORITY[default]))
    names = F.create_map(*[F.lit(x) for k, v in PRIORITY.items() for x in (v, k)])
    return F.element_at(names, p)


def select_required(terms: Column, literal: Column, ontology: Column, graded: Column) -> Column:
    def keep(t):
        in_literal = F.array_contains(literal, t)
        solid = in_literal & ((F.size(_words(t)) >= 2) | t.isin(SINGLE_WORDS))
        return F.array_contains(ontology, t) | solid | term_strength(t, graded, "unknown").isin("must have", "main focus")

    return F.filter(F.array_distinct(terms), keep)


def term_priority(t: Column, core: Column, canonical: Column) -> Column:
    """core / canonical: arrays of ontology names of this row (empty without an ontology)."""
    n = F.size(_words(t))
    hinted = t.isin(HINTED)

    def pts(cond, v):
        return F.when(cond, F.lit(v)).otherwise(F.lit(0))

    known = F.when(F.array_contains(core, t), 5).when(F.array_contains(canonical, t), 3).otherwise(0)
    return (pts(hinted, 4) + pts(n <= 2, 1) + pts(t.rlike(r"[+#.]|\d"), 2) + known + pts(t.isin(GENERIC), -6)
            + pts(t.isin(SENIORITY), -6) + pts((n >= 3) & ~hinted, -2))


def drop_fragments(terms: Column) -> Column:
    def run(ts):
        inside = F.filter(F.flatten(F.transform(F.filter(ts, lambda t: F.size(_words(t)) >= 2), _words)), lambda w: F.length(w) >= 4)
        return let(inside, lambda ws: F.array_distinct(F.filter(ts, lambda t: (F.size(_words(t)) != 1) | ~(
            t.isin(SENIORITY) | (F.array_contains(ws, t) & ~t.isin(SINGLE_WORDS))))))

    return let(terms, run)


def compress(terms: Column, core: Column, canonical: Column, limit: int) -> Column:
    """Noise filter, stable sort by (priority, words, length) descending, positive ones first choice, no fragments, cut."""
    def run(ts):
        keyed = F.array_sort(F.transform(ts, lambda t, i: F.struct(
            (-term_priority(t, core, canonical)).alias("p"), (-F.least(F.size(F.split(t, " ")), F.lit(MAX_WORDS))).alias("w"), (-F.length(t)).alias("l"), i.alias("i"), t.alias("t"))))
        return let(keyed, pick)

    def pick(ks):
        good = F.filter(ks, lambda e: e["p"] < 0)
        chosen = F.transform(F.when(F.size(good) > 0, good).otherwise(ks), lambda e: e["t"])
        return let(chosen, lambda c: let(drop_fragments(c), lambda d: F.slice(F.when(F.size(d) > 0, d).otherwise(c), 1, limit)))

    return let(filter_noise(dedupe(terms)), run)


def required_years(text: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(\d+(?:\.\d+)?)\s*\+?\s*(?:years?|yrs?)"), F.lit(1)), lambda y: y.cast("double")))


def preferred_seniority(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(rf"\b{k}\b"), k) for k in SENIORITY])


def role_phrase(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(r), r) for r in ROLES])


def roles(text: Column, phrase: Column, known: Column | None = None) -> Column:
    """``known``: array of the ontology's role names that the text contains (``operators.containment``)."""
    def build(t):
        found = []
        for role, groups in ROLE_RULES:
            hit = F.lit(True)
            for words in groups:
                hit = hit & _any(t, words)
            found.append(F.when(hit, role))
        return F.array_distinct(F.array_compact(F.concat(F.array(phrase), _empty() if known is None else known, F.array(*found))))

    return let(F.lower(text), build)


def job_category(text: Column, phrase: Column, required: Column, override: Column) -> Column:
    blob = F.concat_ws(" ", F.lower(text), F.array_join(required, " "))
    guess = let(blob, lambda b: F.coalesce(*[F.when(_any(b, ws), n) for n, ws in CATEGORY_WORDS]))
    return F.coalesce(blank_to_null(override), phrase, guess)


def dedupe_signals(signals: Column) -> Column:
    """Per lower-case name the strongest signal; first position kept, an equal one does not replace."""
    ranks = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])

    def run(sig):
        names = F.array_distinct(F.filter(F.transform(sig, lambda e: F.lower(F.trim(e["name"]))), lambda n: n != ""))
        def best(n):
            same = F.filter(F.transform(sig, lambda e, i: F.struct(
                (-F.coalesce(F.try_element_at(ranks, e["strength"]), F.lit(0))).alias("p"), i.alias("i"), e.alias("e"))), lambda x: F.lower(F.trim(x["e"]["name"])) == n)
            return F.array_min(same)["e"]
        return F.transform(names, best)

    return let(signals, run)


def _signal(name: Column, strength: Column, kind: str) -> Column:
    return F.struct(name.alias("name"), strength.alias("strength"), F.lit(kind).alias("kind"))


def skill_signals(required: Column) -> Column:
    """Always 'must have': the default is already the strongest cue."""
    return dedupe_signals(F.transform(required, lambda t: _signal(t, F.lit("must have"), "skill")))


def capability_signals(text: Column, graded: Column, known: Column | None = None) -> Column:
    """``known``: array of the ontology's capability phrases that the text contains (``operators.containment``)."""
    def build(t):
        names = F.array(*[F.when(t.contains(p), c) for p, c in CAPABILITY_HINTS.items()])
        found = F.array_compact(F.concat(names, _empty() if known is None else known))
        return F.transform(found, lambda n: _signal(n, term_strength(n, graded, "familiarity"), "capability"))

    return dedupe_signals(let(F.lower(text), build))


def signal_quality(skills: Column, capabilities: Column) -> Column:
    def build(a):
        def n(s):
            return F.size(F.filter(a, lambda e: e["strength"] == s)).cast("long")
        total = F.size(a)
        return F.struct(
            total.cast("long").alias("total"), n("unknown").alias("unknown"), n("must have").alias("must_have"), n("familiarity").alias("familiarity"),
            F.when(total > 0, F.round(n("unknown") / total, 4)).otherwise(F.lit(0.0)).alias("unknown_ratio"))

    return let(F.concat(skills, capabilities), build)


def _by_strength(signals: Column) -> Column:
    """Names by strength, stable."""
    ranks = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    keyed = F.array_sort(F.transform(signals, lambda e, i: F.struct((-F.coalesce(F.try_element_at(ranks, e["strength"]), F.lit(0))).alias("p"), i.alias("i"), e["name"].alias("n"))))
    return F.transform(keyed, lambda e: e["n"])


def names_of(signals: Column) -> Column:
    return F.transform(signals, lambda e: e["name"])


def lexical_query(role_names: Column, skills: Column, capabilities: Column) -> Column:
    return F.array_join(dedupe(F.concat(role_names, _by_strength(skills), _by_strength(capabilities))), " ")


def query_expansion(role_names: Column, required: Column, related: Column, capabilities: Column) -> Column:
    return dedupe(F.concat(role_names, required, related, names_of(capabilities)))


def embedding_query(phrase: Column, category: Column, required: Column, related: Column, seniority: Column, role_names: Column) -> Column:
    wide = F.exists(role_names, lambda r: r.isin(WIDE_ROLES)) | F.coalesce(phrase.isin(WIDE_ROLES), F.lit(False))
    req = F.slice(dedupe(required), F.lit(1), F.when(wide, WIDE_CAPS[0]).otherwise(EMBED_CAPS[0]))
    rel = F.slice(F.array_except(related, req), F.lit(1), F.when(wide, WIDE_CAPS[1]).otherwise(EMBED_CAPS[1]))
    ends = [F.array(F.coalesce(c, F.lit(""))) for c in (phrase, category, seniority)]
    return F.array_join(dedupe(F.concat(ends[0], ends[1], req, rel, ends[2])), " ")


def transferable_score(capabilities: Column, n_adjacent: Column, related: Column) -> Column:
    values = F.create_map(*[F.lit(x) for kv in STRENGTH_VALUE.items() for x in kv])
    total = F.aggregate(capabilities, F.lit(0.0), lambda s, e: s + F.coalesce(F.try_element_at(values, e["strength"]), F.lit(0.35)))
    cap = F.when(F.size(capabilities) > 0, total / F.size(capabilities)).otherwise(F.lit(0.0))
    near = F.least(F.lit(1.0), F.coalesce(n_adjacent, F.lit(0)) / 6.0)
    rel = F.least(F.lit(1.0), F.size(F.array_distinct(related)) / 8.0)
    return F.round(clip01(cap * 0.5 + near * 0.35 + rel * 0.15) * 1000) / 1000


def query_confidence(required: Column, category: Column, seniority: Column, years: Column, query_text: Column) -> Column:
    n = F.size(required)

    def pts(cond, v):
        return F.when(cond, F.lit(v)).otherwise(F.lit(0.0))

    s = (pts(n > 0, 0.35) + pts(n >= 2, 0.15) + pts(F.coalesce(category, F.lit("")) != "", 0.2) + pts(F.coalesce(seniority, F.lit("")) != "", 0.1)
         + pts(years.isNotNull(), 0.1) + pts(F.trim(query_text) != "", 0.1) - F.when(n > 25, 0.2).when(n > 18, 0.1).otherwise(0.0))
    return F.round(clip01(s) * 1000) / 1000


def related_fallback(text: Column, required: Column, limit: int | None = None) -> Column:
    """2-4 word chunks of the text that are not required; the first ``limit`` of them if given."""
    def clean(c):
        return F.btrim(squash(F.regexp_replace(c, r"[^\w\s+#.-]", " ")), F.lit(" .,-"))

    def keep(t):
        ws = _words(t)
        return F.size(ws).between(2, MAX_WORDS) & ~F.array_contains(required, t) & (F.size(F.filter(ws, lambda w: w.isin(STOPWORDS))) <= 1)

    chunks = F.filter(F.transform(F.split(F.lower(text), SPLIT), clean), keep)
    return first_items(F.filter(filter_noise(F.array_distinct(chunks)), lambda t: ~F.array_contains(required, t)), limit)


def fallback_reason(confidence: Column, unknown_ratio: Column) -> Column:
    return F.when(confidence < FALLBACK["confidence"], "low_confidence").when(unknown_ratio > FALLBACK["unknown_ratio"], "high_unknown_ratio")


def query_tokens(text: Column, limit: int | None = None) -> Column:
    """Distinct words of a text that are no stop words, the first ``limit`` if given."""
    toks = F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z0-9][a-zA-Z0-9+.#-]{1,}"), F.lit(0)), lambda t: F.lower(t))
    return first_items(F.array_distinct(F.filter(toks, lambda t: ~t.isin(QUERY_STOPWORDS))), limit)


def query_seeds(role_names, skills, capabilities, required, related, expansion, query_text) -> Column:
    """Cleaned, distinct seeds in search order, before canonical names and aliases."""
    raw = F.concat(role_names, _by_strength(skills), names_of(capabilities), required, related, expansion, query_tokens(query_text))
    return F.array_distinct(F.filter(F.transform(raw, clean_token), lambda t: t.isNotNull()))


def draft_text(category, role_names, skills, capabilities, related, seniority) -> Column:
    def strong(label, strengths):
        names = names_of(F.filter(skills, lambda e: e["strength"].isin(strengths)))
        return F.when(F.size(names) > 0, F.concat(F.lit(label + ": "), F.array_join(names, ", ")))

    def listed(label, a):
        return F.when(F.size(a) > 0, F.concat(F.lit(label + ": "), F.array_join(a, ", ")))

    caps = F.transform(capabilities, lambda e: F.concat(e["strength"], F.lit(": "), e["name"]))
    return F.concat_ws(
        ". ", F.concat(F.lit("role: "), blank_to_null(category)), listed("roles", role_names), strong("must have", ["must have"]), strong("main focus", ["main focus"]),
        strong("nice to have", ["nice to have"]), strong("familiarity", ["familiarity"]), strong("skills", ["unknown", ""]),
        listed("capabilities", caps), listed("related skills", related), F.concat(F.lit("seniority: "), blank_to_null(seniority)))


def prepare(jobs: DataFrame) -> DataFrame:
    """Sentence grades and candidate term lists of each text."""
    x = F.col("text")
    d = jobs.withColumn("_graded", graded_sentences(x)).withColumn("_literal", literal_candidates(x))
    d = d.withColumn("_raw", with_hints(x, F.col("_literal")))
    return d.withColumn("_filtered", filter_noise(F.col("_raw"))).withColumn("_literal_f", filter_noise(F.col("_literal")))


def required_candidates(prepared: DataFrame) -> DataFrame:
    onto = F.col("ontology_terms") if "ontology_terms" in prepared.columns else _empty()
    return prepared.withColumn("_req0", select_required(F.col("_filtered"), F.col("_literal_f"), onto, F.col("_graded")))


def choose_terms(d: DataFrame) -> DataFrame:
    """required_skills and _related. Ontology columns (core_skills, known_canonical, expanded_skills,
    core_terms, alias_terms) are used when present; else the text alone decides."""
    def col(n):
        return F.col(n) if n in d.columns else _empty()

    c = F.col
    core_t, alias_t = col("core_terms"), col("alias_terms")
    base = F.when(F.size(col("core_skills")) > 0, col("core_skills")).otherwise(col("known_canonical"))
    first = F.when(F.size(base) > 0, F.concat(base, c("_req0"))).when(F.size("_req0") > 0, c("_req0")).otherwise(c("_filtered"))
    out = d.withColumn("required_skills", compress(first, core_t, alias_t, MAX_REQUIRED))
    grown = F.when(F.size(col("expanded_skills")) > 0, col("expanded_skills")).otherwise(base)
    pool = [F.array_except(a, c("required_skills")) for a in (F.concat(grown, c("_filtered")), c("_raw"), c("_literal"))]
    out = out.withColumn("_pool", F.when(F.size(pool[0]) > 0, pool[0]).when(F.size(pool[1]) > 0, pool[1]).otherwise(pool[2]))
    out = out.withColumn("_related", F.array_except(compress(c("_pool"), core_t, alias_t, MAX_RELATED), c("required_skills")))
    return out.withColumn("_related", compress(c("_related"), core_t, alias_t, MAX_RELATED))


def finish(d: DataFrame) -> DataFrame:
    """All remaining profile columns; ``adjacent``, ``known_roles`` and ``known_capabilities`` hold the ontology's where known."""
    def col(n):
        return F.col(n) if n in d.columns else _empty()

    c, x = F.col, F.col("text")
    near = col("adjacent")
    override = c("category_override") if "category_override" in d.columns else F.lit(None).cast("string")
    d = d.withColumn("preferred_seniority", preferred_seniority(x)).withColumn("_phrase", role_phrase(x))
    d = d.withColumn("roles", roles(x, c("_phrase"), col("known_roles"))).withColumn("job_category", job_category(x, c("_phrase"), c("required_skills"), override))
    d = d.withColumn("skill_signals", skill_signals(c("required_skills"))).withColumn("capability_signals", capability_signals(x, c("_graded"), col("known_capabilities")))
    d = d.withColumn("transferable_score", transferable_score(c("capability_signals"), F.size(F.array_distinct(near)), c("_related")))
    grown = F.concat(c("_related"), F.array_except(names_of(c("capability_signals")), c("required_skills")), near)
    d = d.withColumn("related_skills", compress(grown, col("core_terms"), col("alias_terms"), MAX_RELATED))
    d = d.withColumn("related_skills", F.when(F.size("related_skills") > 0, c("related_skills")).otherwise(related_fallback(x, c("required_skills"), MAX_RELATED)))
    d = d.withColumn("lexical_query", lexical_query(c("roles"), c("skill_signals"), c("capability_signals")))
    d = d.withColumn("query_expansion", query_expansion(c("roles"), c("required_skills"), c("related_skills"), c("capability_signals")))
    d = d.withColumn("signal_quality", signal_quality(c("skill_signals"), c("capability_signals"))).withColumn("required_years", required_years(x))
    text_q = embedding_query(c("_phrase"), c("job_category"), c("required_skills"), c("related_skills"), c("preferred_seniority"), c("roles"))
    d = d.withColumn("query_text", F.coalesce(blank_to_null(text_q), x))
    d = d.withColumn("confidence", query_confidence(c("required_skills"), c("job_category"), c("preferred_seniority"), c("required_years"), c("query_text")))
    d = d.withColumn("filters", F.map_filter(F.create_map(
        F.lit("category"), override, F.lit("seniority_hint"), c("preferred_seniority")), lambda k, v: v.isNotNull()))
    return d.drop("_graded", "_literal", "_raw", "_filtered", "_literal_f", "_req0", "_pool", "_related", "_phrase")


def profile(jobs: DataFrame) -> DataFrame:
    """Full profile per job (job_id, text[, category_override]) from the text alone."""
    return finish(choose_terms(required_candidates(prepare(jobs))))


def merge_profiles(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Fallback lists first, scalars by precedence, larger confidence; profiles join on job_id."""
    p, f = primary.alias("p"), fallback.alias("f")
    j = p.join(f, F.col("p.job_id") == F.col("f.job_id"))

    def both(n):
        return F.array_distinct(F.concat(F.col(f"f.{n}"), F.col(f"p.{n}")))

    def first(a, b, n):
        return F.coalesce(blank_to_null(F.col(f"{a}.{n}")), F.col(f"{b}.{n}"))

    out = j.select(
        F.col("p.job_id").alias("job_id"), both("required_skills").alias("required_skills"), both("related_skills").alias("_rel"), both("roles").alias("roles"),
        dedupe_signals(F.concat("f.skill_signals", "p.skill_signals")).alias("skill_signals"),
        dedupe_signals(F.concat("f.capability_signals", "p.capability_signals")).alias("capability_signals"),
        F.coalesce(F.when(F.col("p.required_years") != 0, F.col("p.required_years")), F.col("f.required_years")).alias("required_years"),
        first("f", "p", "preferred_seniority").alias("preferred_seniority"), first("f", "p", "job_category").alias("job_category"),
        first("f", "p", "query_text").alias("query_text"), F.greatest("p.confidence", "f.confidence").alias("confidence"))
    return out.withColumn("related_skills", F.array_except("_rel", "required_skills")).withColumn(
        "signal_quality", signal_quality(F.col("skill_signals"), F.col("capability_signals"))).drop("_rel")
