"""Retrieval, matching and evaluation scores as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.text import blank_to_null, first_chars, first_items, let, normalize_skill, normalize_token
from matchloom.operators.facets import FILTERS, contains_any, normalize_label, spaced

# Fixed values -----------------------------------------------------------
FUSION_WEIGHTS = {"vector": 0.48, "keyword": 0.37, "metadata": 0.15}
POLICIES = {"v1": {"semantic": 0.42, "skill": 0.33, "experience": 0.18, "seniority": 0.07, "category": 0.03}}
RANK_WEIGHTS = {"deterministic": 0.30, "agent": 0.70}
SENIORITY_RANKS = {"intern": 0, "junior": 1, "mid": 2, "senior": 3, "lead": 4, "staff": 5, "principal": 6}
TERM_STOPWORDS = ["and", "or", "with", "for", "the", "a", "an", "to", "of", "in"]
MAX_PENALTY = 0.12
DIMENSIONS = ["skill", "experience", "technical", "culture"]
RECRUITER = {"skill": 0.30, "experience": 0.35, "technical": 0.20, "culture": 0.15}
HIRING_MANAGER = {"skill": 0.40, "experience": 0.20, "technical": 0.30, "culture": 0.10}
DEFAULT_WEIGHTS = {"skill": 0.35, "experience": 0.30, "technical": 0.20, "culture": 0.15}
RERANK_GATE = {"pool": 8, "gap": 0.015, "confidence": 0.65, "unknown": 0.5, "coverage": 0.6, "fusion": 0.45}
# ------------------------------------------------------------------------


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def r4(c: Column) -> Column:
    """Four decimals, rounding the scaled value (as numpy blocks and SQL engines do)."""
    return F.round(c * 10000) / 10000


def rnd(c: Column, digits: int) -> Column:
    return F.round(c * 10 ** digits) / 10 ** digits


def two_digits(c: Column) -> Column:
    """c to two decimals, deciding ties on the exact binary value.

    The product's rounding error (Veltkamp split) tells on which side of a
    half the true value lies; an exact half goes to the even digit.
    """
    def decide(x):
        big = x * 134217729.0
        high = big - (big - x)
        p = x * 100.0
        err = (high * 100.0 - p) + (x - high) * 100.0
        tie = (p - F.floor(p)) == 0.5
        return F.when(tie & (err > 0), F.ceil(p).cast("double")).when(tie & (err < 0), F.floor(p).cast("double")).otherwise(F.rint(p)) / 100.0

    return let(c.cast("double"), decide)


def lower_set(*arrays: Column) -> Column:
    """Distinct trimmed lower-case values over several arrays."""
    both = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
    return F.array_distinct(F.filter(F.transform(both, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def share(hit: Column, of: Column) -> Column:
    """size(hit) / size(of), 0 for an empty denominator."""
    return F.when(F.size(of) > 0, F.size(hit) / F.size(of)).otherwise(F.lit(0.0))


# -- retrieval ------------------------------------------------------------
def vector_unit(s: Column) -> Column:
    return clip01((s + 1.0) / 2.0)


def keyword_score(pool: Column, terms: Column) -> Column:
    return r4(share(F.array_intersect(terms, pool), F.array_distinct(terms)))


def fusion(vector: Column, keyword: Column, metadata: Column, weights: dict[str, float] | None = None) -> Column:
    w = {k: max(0.0, v) for k, v in (weights or FUSION_WEIGHTS).items()}
    total = sum(w.values()) or 1.0
    return clip01((vector * w["vector"] + keyword * w["keyword"] + metadata * w["metadata"]) / total)


def job_facts(category: Column, industry: Column, min_years: Column, seniority: Column) -> Column:
    """What metadata_score asks of a job; the same for all candidates, so made before jobs meet candidates."""
    return F.struct(
        F.when(blank_to_null(category).isNotNull(), normalize_token(category)).alias("category"), normalize_label(industry, FILTERS["industries"]).alias("industry"),
        min_years.alias("years"), F.when(F.coalesce(seniority, F.lit("")) != "", F.lower(F.trim(seniority))).alias("level"))


def candidate_facts(category: Column, years: Column, seniority: Column) -> Column:
    """What metadata_score asks of a candidate, likewise; ``hits``: 1/0 whether the category holds a term of each industry, .5 when it has no terms."""
    cat = normalize_token(category)
    terms = [list(dict.fromkeys(spaced(t) for t in entry["category_terms"])) for entry in FILTERS["industries"].values()]
    hits = [F.when(contains_any(cat, ts), F.lit(1.0)).otherwise(F.lit(0.0)) if ts else F.lit(0.5) for ts in terms]
    return F.struct(
        cat.alias("category"), years.alias("years"), F.when(F.coalesce(seniority, F.lit("")) != "", F.lower(F.trim(seniority))).alias("level"),
        F.array(*hits).alias("hits"))


def prepared_metadata(job: Column, candidate: Column) -> Column:
    """metadata_score of job_facts and candidate_facts."""
    need, years = job["years"], candidate["years"]
    s_cat = F.when(job["category"].isNull(), 0.5).when(candidate["category"] == job["category"], 1.0).otherwise(0.0)
    s_exp = (
        F.when(need.isNull(), 0.5).when(years.isNull(), 0.0).when(need <= 0, 1.0)
        .otherwise(clip01(years / F.nullif(need, F.lit(0.0)))))
    s_sen = F.when(job["level"].isNull(), 0.5).when(candidate["level"].isNull(), 0.2).when(candidate["level"] == job["level"], 1.0).otherwise(0.4)
    s_ind = F.lit(0.5)
    for place, name in enumerate(FILTERS["industries"]):
        s_ind = F.when(job["industry"] == name, F.get(candidate["hits"], F.lit(place))).otherwise(s_ind)
    return F.when(
        job["industry"] != "", s_cat * 0.4 + s_ind * 0.15 + s_exp * 0.3 + s_sen * 0.15
    ).otherwise(s_cat * 0.5 + s_exp * 0.35 + s_sen * 0.15)


def metadata_score(category: Column, industry: Column, min_years: Column, seniority: Column,
                   c_category: Column, c_years: Column, c_seniority: Column) -> Column:
    return prepared_metadata(job_facts(category, industry, min_years, seniority), candidate_facts(c_category, c_years, c_seniority))


def keyword_predicate(terms: Column, category: Column, industry: Column, min_years: Column,
                      c_category: Column, c_years: Column, pool: Column, summary: Column, heads: int | None = None) -> Column:
    """Which documents a keyword search may return. ``heads``: how many leading terms are looked for in the summary (None: all)."""
    key = normalize_label(industry, FILTERS["industries"])
    by_industry = F.lit(True)
    for name, entry in FILTERS["industries"].items():
        by_industry = F.when(key == name, contains_any(F.lower(c_category), [t.lower() for t in entry["category_terms"]])).otherwise(by_industry)
    cat_ok = F.when(blank_to_null(category).isNotNull(), F.lower(c_category) == F.lower(F.trim(category))).otherwise(by_industry)
    years_ok = min_years.isNull() | F.coalesce(c_years >= min_years, F.lit(False))
    in_summary = let(F.lower(F.coalesce(summary, F.lit(""))), lambda s: F.exists(F.slice(terms, 1, heads) if heads else terms, lambda t: s.contains(t)))
    terms_ok = (F.size(terms) == 0) | F.arrays_overlap(pool, terms) | in_summary
    return F.coalesce(cat_ok, F.lit(False)) & years_ok & terms_ok


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable & (norm > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(norm, F.lit(0.0))))).otherwise(F.lit(0.0))


# -- matching -------------------------------------------------------------
def skill_set(a: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(a, normalize_skill), lambda x: x != ""))


def with_words(terms: Column) -> Column:
    """array<struct<t, w>>: each term with its distinct content words."""
    return F.transform(terms, lambda t: F.struct(t.alias("t"), F.array_except(
        F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"[a-z0-9+#.-]+"), F.lit(0))),
        F.array(*[F.lit(s) for s in TERM_STOPWORDS])).alias("w")))


def term_match(pool: Column, target: Column) -> Column:
    """1 for an exact member, else the best word overlap, +.2 when one contains the other."""
    def overlap(c):
        raw = F.size(F.array_intersect(target["w"], c["w"])) / F.size(target["w"])
        return let(raw, lambda o: F.when(o <= 0, F.lit(0.0)).when(
            c["t"].contains(target["t"]) | target["t"].contains(c["t"]), F.least(F.lit(1.0), o + 0.2)).otherwise(o))

    best = F.coalesce(F.array_max(F.transform(pool, overlap)), F.lit(0.0))
    return F.when(F.exists(pool, lambda c: c["t"] == target["t"]), F.lit(1.0)).when(F.size(target["w"]) == 0, F.lit(0.0)).otherwise(best)


def soft_overlap(pool: Column, targets: Column) -> Column:
    """Mean term_match over the targets; both arguments come from with_words.

    Members of the pool that share no word with any target, nor are one, count nothing and are left out first."""
    wanted = F.struct(F.array_distinct(F.flatten(F.transform(targets, lambda t: t["w"]))).alias("w"), F.transform(targets, lambda t: t["t"]).alias("t"))
    near = let(wanted, lambda v: F.filter(pool, lambda c: F.arrays_overlap(v["w"], c["w"]) | F.array_contains(v["t"], c["t"])))
    total = let(near, lambda some: F.aggregate(targets, F.lit(0.0), lambda s, t: s + term_match(some, t)))
    return F.when(F.size(targets) > 0, total / F.size(targets)).otherwise(F.lit(0.0))


def candidate_skills(core: Column, expanded: Column, normalized: Column) -> Column:
    """A candidate's skills as skill_overlap compares them: core, expanded and normalised."""
    return F.struct(skill_set(core).alias("c"), skill_set(expanded).alias("e"), skill_set(normalized).alias("n"))


def job_skills(required: Column, extra: Column, targets: int | None = None) -> Column:
    """A job's skills as skill_overlap compares them: all, of which the first ``n`` are the required ones. ``targets``: terms that count (None: all)."""
    req = first_items(required, targets)
    return F.struct(F.size(skill_set(req)).alias("n"), first_items(skill_set(F.concat(req, extra)), targets).alias("x"))


def candidate_terms(core: Column, expanded: Column, normalized: Column) -> Column:
    """candidate_skills with words; the same for all jobs, so made before candidates meet jobs."""
    return let(candidate_skills(core, expanded, normalized), lambda v: F.struct(*[with_words(v[n]).alias(n) for n in "cen"]))


def job_terms(required: Column, extra: Column, targets: int | None = None) -> Column:
    """job_skills with words, likewise."""
    return let(job_skills(required, extra, targets), lambda v: F.struct(v["n"].alias("n"), with_words(v["x"]).alias("x")))


def prepared_overlap(candidate: Column, job: Column) -> Column:
    """struct(score, core_overlap, expanded_overlap, normalized_overlap) of candidate_terms and job_terms."""
    required = F.slice(job["x"], F.lit(1), job["n"])
    c, e, n = soft_overlap(candidate["c"], required), soft_overlap(candidate["e"], job["x"]), soft_overlap(candidate["n"], required)
    return let(F.struct(c.alias("c"), e.alias("e"), n.alias("n"), (F.size(candidate["c"]) > 0).alias("h")), lambda v: F.struct(
        F.when(v["h"], 0.45 * v["c"] + 0.35 * v["e"] + 0.2 * v["n"]).otherwise(0.5 * v["n"] + 0.5 * v["e"]).alias("score"),
        v["c"].alias("core_overlap"), v["e"].alias("expanded_overlap"), v["n"].alias("normalized_overlap")))


def skill_overlap(core: Column, expanded: Column, normalized: Column, required: Column, extra: Column, targets: int | None = None) -> Column:
    """prepared_overlap of skills that stand in one row."""
    packed = F.struct(candidate_terms(core, expanded, normalized).alias("a"), job_terms(required, extra, targets).alias("b"))
    return let(packed, lambda p: prepared_overlap(p["a"], p["b"]))


def experience_fit(years: Column, required: Column) -> Column:
    ratio = years / F.nullif(required, F.lit(0.0))
    return (
        F.when(required.isNull() | (required <= 0), 0.5).when(years.isNull(), 0.0).when(ratio <= 1, clip01(ratio))
        .otherwise(clip01(1.0 - F.least(F.lit(0.15), (ratio - 1.0) * 0.08))))


def seniority_fit(level: Column, preferred: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in SENIORITY_RANKS.items() for x in kv])
    a, b = F.try_element_at(ranks, F.lower(F.trim(level))), F.try_element_at(ranks, F.lower(F.trim(preferred)))
    return (
        F.when(F.coalesce(preferred, F.lit("")) == "", 0.5).when(F.coalesce(level, F.lit("")) == "", 0.0)
        .when(a.isNull() | b.isNull(), 0.5).otherwise(clip01(1.0 - F.abs(a - b) / max(SENIORITY_RANKS.values()))))


def deterministic_score(raw_similarity: Column, overlap: Column, years: Column, required: Column,
                        level: Column, preferred: Column, same_category: Column, policy: str = "v1") -> Column:
    """struct(score, semantic_similarity, experience_fit, seniority_fit, category_fit)."""
    p = POLICIES[policy]
    sem, exp, sen = vector_unit(raw_similarity), experience_fit(years, required), seniority_fit(level, preferred)
    cat = F.when(F.coalesce(same_category, F.lit(False)), F.lit(p["category"])).otherwise(F.lit(0.0))
    total = clip01(p["semantic"] * sem + p["skill"] * clip01(overlap) + p["experience"] * exp + p["seniority"] * sen + cat)
    return F.struct(total.alias("score"), sem.alias("semantic_similarity"), exp.alias("experience_fit"),
                    sen.alias("seniority_fit"), cat.alias("category_fit"))


def final_rank(deterministic: Column, agent: Column) -> Column:
    return clip01(F.when(agent.isNull(), deterministic).otherwise(
        deterministic * RANK_WEIGHTS["deterministic"] + agent * RANK_WEIGHTS["agent"]))


def must_have(terms: Column, pool: Column, adjacent: Column) -> Column:
    """struct(rate, penalty) over the job's must-have terms (repeats count)."""
    names = F.filter(F.transform(terms, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    rate = share(F.filter(names, lambda t: F.array_contains(pool, t)), names)
    eff = F.least(F.lit(1.0), rate + (1.0 - rate) * clip01(adjacent) * 0.5)
    none = F.size(names) == 0
    return F.struct(
        F.when(none, F.lit(1.0)).otherwise(r4(rate)).alias("rate"),
        F.when(none, F.lit(0.0)).otherwise(r4(F.least(F.lit(MAX_PENALTY), (1.0 - eff) * MAX_PENALTY))).alias("penalty"))


def _or_none(a: Column, fallback: Column) -> Column:
    return F.when(F.size(a) > 0, F.array_join(a, ", ")).when(F.size(fallback) > 0, F.array_join(fallback, ", ")).otherwise("none explicit")


def skill_sentence(required: Column, candidate_tokens: Column) -> Column:
    """'Matched ...; missing or weaker skills: ...' part of an explanation."""
    empty = F.array().cast("array<string>")

    def text(p):
        req, cand = p["req"], p["cand"]
        matched = F.slice(F.array_intersect(req, cand), 1, 6)
        missing = F.slice(F.array_except(req, cand), 1, 4)
        supporting = F.slice(F.array_except(F.array_except(cand, matched), missing), 1, 4)
        return F.concat(
            F.lit("Matched required skills: "), _or_none(matched, F.slice(req, 1, 4)), F.lit(". Candidate evidence tokens: "),
            _or_none(supporting, F.slice(cand, 1, 4)), F.lit("; missing or weaker skills: "), _or_none(missing, empty), F.lit(". "))

    packed = F.struct(F.slice(lower_set(required), 1, 6).alias("req"), F.slice(lower_set(candidate_tokens), 1, 10).alias("cand"))
    return let(packed, text)


def deterministic_explanation(required: Column, tokens: Column, semantic: Column, skill: Column, experience: Column, seniority: Column, rate: Column) -> Column:
    return F.concat(skill_sentence(required, tokens), F.format_string(
        "Deterministic signals: semantic=%.2f, skill=%.2f, experience=%.2f, seniority=%.2f; must-have match=%.2f.",
        *[two_digits(c) for c in (semantic, skill, experience, seniority, rate)]))


def grounded_explanation(required: Column, tokens: Column, scores: dict[str, Column], weights: dict[str, Column]) -> Column:
    return F.concat(skill_sentence(required, tokens), F.format_string(
        "Scores/weights: skill=%.2f, experience=%.2f, technical=%.2f, culture=%.2f; final weights skill=%.2f, experience=%.2f, technical=%.2f, culture=%.2f.",
        *[two_digits(scores[k]) for k in DIMENSIONS], *[two_digits(weights[k]) for k in DIMENSIONS]))


def relevant_experience(items: Column, years: Column) -> Column:
    """First three 'title at company' lines, else the years line."""
    def line(e):
        t, c = blank_to_null(F.trim(e["title"])), blank_to_null(F.trim(e["company"]))
        return F.when(t.isNotNull() & c.isNotNull(), F.concat(t, F.lit(" at "), c)).otherwise(F.coalesce(t, c))

    lines = F.filter(F.transform(F.slice(items, 1, 3), line), lambda x: x.isNotNull())
    fallback = F.when(years.isNotNull(), F.array(F.concat(F.round(years, 1).cast("string"), F.lit(" years of relevant experience"))))
    return F.when(F.size(lines) > 0, lines).otherwise(F.coalesce(fallback, F.array().cast("array<string>")))


def distinct_lines(items: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(items, lambda e: F.coalesce(
        F.concat(blank_to_null(e["title"]), F.lit(" at "), blank_to_null(e["company"])), blank_to_null(e["title"]), blank_to_null(e["company"]))), lambda x: x.isNotNull()))


def project_evidence(items: Column, chars: int | None = None) -> Column:
    """Distinct descriptions, cut at ``chars`` characters if given."""
    return F.array_distinct(F.filter(F.transform(items, lambda e: first_chars(F.trim(e["description"]), chars)), lambda x: x.isNotNull() & (x != "")))


def normalize_weights(w: dict[str, Column]) -> dict[str, Column]:
    total = w["skill"] + w["experience"] + w["technical"] + w["culture"]
    return {k: F.when(total > 0, r4(w[k] / F.nullif(total, F.lit(0.0)))).otherwise(F.lit(DEFAULT_WEIGHTS[k])) for k in DIMENSIONS}


def negotiate_weights(required_years: Column, n_required: Column) -> dict[str, dict[str, Column]]:
    """Recruiter, hiring-manager and final weights."""
    senior = F.coalesce(required_years >= 5.0, F.lit(False))
    rec = {k: F.lit(v) for k, v in RECRUITER.items()}
    for k, delta in (("experience", 0.10), ("technical", -0.05), ("culture", -0.05)):
        rec[k] = F.when(senior, rec[k] + F.lit(delta)).otherwise(rec[k])
    hm = {k: F.lit(v) for k, v in HIRING_MANAGER.items()}
    for k, delta in (("technical", 0.10), ("experience", -0.05), ("culture", -0.05)):
        hm[k] = F.when(n_required >= 6, hm[k] + F.lit(delta)).otherwise(hm[k])
    rec, hm = normalize_weights(rec), normalize_weights(hm)
    return {"recruiter": rec, "hiring_manager": hm, "final": normalize_weights({k: (rec[k] + hm[k]) / 2.0 for k in DIMENSIONS})}


def weighting_summary(w: dict[str, dict[str, Column]]) -> Column:
    part = "(S:%.2f, E:%.2f, T:%.2f, C:%.2f)"
    return F.format_string(
        f"Recruiter focus {part} | Hiring manager focus {part} | Final negotiated {part}",
        *[two_digits(w[who][k]) for who in ("recruiter", "hiring_manager", "final") for k in DIMENSIONS])


def weighted_score(scores: dict[str, Column], weights: dict[str, Column]) -> Column:
    return r4(clip01(sum((scores[k] * weights[k] for k in DIMENSIONS[1:]), scores["skill"] * weights["skill"])))


def exact_overlap(required: Column, candidate: Column) -> Column:
    req = lower_set(required)
    return r4(share(F.array_intersect(req, lower_set(candidate)), req))


def heuristic_scores(required: Column, normalized: Column, stack: Column, skills: Column, years: Column, required_years: Column,
                     level: Column, preferred: Column, raw_score: Column, same_category: Column) -> dict[str, Column]:
    fit = r4(experience_fit(years, required_years))
    sen = (F.when(preferred.isNull(), 0.5).when(level.isNull(), 0.0)
           .when(F.lower(F.trim(preferred)) == F.lower(F.trim(level)), 1.0).otherwise(0.4))
    cover = exact_overlap(stack, skills)
    depth = r4(F.least(F.lit(1.0), cover * 0.8 + raw_score * 0.2))
    return {
        "skill": exact_overlap(required, normalized), "experience": r4((fit + sen) / 2.0), "technical": r4((cover + depth) / 2.0),
        "culture": F.when(F.coalesce(same_category, F.lit(False)), F.lit(0.75)).otherwise(F.lit(0.6))}


def sentences(text: Column) -> Column:
    """Split after . ! ? followed by white space."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), lambda s: F.trim(s)), lambda s: s != "")


def evidence_sentences(text: Column, terms: Column, limit: int = 4, chars: int | None = None) -> Column:
    """Sentences of 25+ characters by number of contained terms, stable, distinct; cut at ``chars`` characters if given."""
    def pick(names):
        scored = F.transform(sentences(text), lambda s, i: let(F.lower(s), lambda low: F.struct(
            (-F.size(F.filter(names, lambda t: low.contains(t)))).alias("n"), i.alias("i"), first_chars(s, chars).alias("s"), F.length(s).alias("len"))))
        keep = F.array_sort(F.filter(scored, lambda e: (e["n"] < 0) & (e["len"] >= 25)))
        return F.slice(F.array_distinct(F.transform(keep, lambda e: e["s"])), 1, limit)

    return let(F.filter(F.transform(terms, lambda t: F.lower(F.trim(t))), lambda t: t != ""), pick)


def rerank_text(summary: Column, skills: Column, category: Column, level: Column, years: Column, chars: int | None = None, names_read: int | None = None) -> Column:
    """Text that a re-ranker reads. ``chars`` of the summary and ``names_read`` skills, if given."""
    names = F.transform(first_items(skills, names_read), lambda s: F.lower(F.trim(s)))
    parts = [first_chars(F.trim(summary), chars), F.array_join(F.filter(names, lambda s: s != ""), " "), F.trim(category), F.trim(level), years.cast("string")]
    return F.trim(F.concat_ws(" ", *[blank_to_null(p) for p in parts]))


# -- evaluation -----------------------------------------------------------
def groundedness(explanation: Column, expected: Column, candidate: Column) -> Column:
    def score(p):
        space = F.array_union(p["e"], p["c"])
        cover = share(F.filter(space, lambda t: p["x"].contains(t)), space)
        bonus = F.when(F.size(F.split(p["x"], r"\s+")) >= 12, 0.1).otherwise(0.0)
        return F.when(p["x"] == "", F.lit(0.0)).when(F.size(space) == 0, F.lit(0.5)).otherwise(r4(F.least(F.lit(1.0), cover + bonus)))

    return let(F.struct(F.lower(F.trim(F.coalesce(explanation, F.lit("")))).alias("x"), lower_set(expected).alias("e"), lower_set(candidate).alias("c")), score)


def dimension_consistency(scores: dict[str, Column], final: Column) -> Column:
    given = F.array(*[scores[k] for k in DIMENSIONS if scores.get(k) is not None])
    vals = F.transform(F.filter(given, lambda v: v.isNotNull()), clip01)
    mean = F.aggregate(vals, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(vals), F.lit(0))
    return F.when(F.size(vals) == 0, F.lit(0.0)).when(final.isNull(), r4(mean)).otherwise(r4(F.greatest(F.lit(0.0), 1.0 - F.abs(mean - clip01(final)))))


def text_coverage(tokens: Column, text: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(low == "", F.lit(0.0)).otherwise(let(low, lambda x: let(lower_set(tokens), lambda ts: r4(share(F.filter(ts, lambda t: x.contains(t)), ts)))))


def explanation_quality(expected: Column, candidate: Column, explanation: Column, consistency: Column) -> Column:
    """struct(overall, groundedness, coverage, specificity, passed)."""
    g, c, s = groundedness(explanation, expected, candidate), text_coverage(expected, explanation), text_coverage(candidate, explanation)
    overall = r4(F.least(F.lit(1.0), 0.4 * g + 0.2 * c + 0.2 * s + 0.2 * consistency))
    return F.struct(overall.alias("overall"), g.alias("groundedness"), c.alias("coverage"), s.alias("specificity"), (overall >= 0.6).alias("passed"))


def per_second(n: Column, ms: Column) -> Column:
    return F.when((n > 0) & (ms > 0), r4(n / (F.nullif(ms, F.lit(0.0)) / 1000.0))).otherwise(F.lit(0.0))


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    def part(t, p):
        return F.greatest(F.coalesce(t, F.lit(0)), F.lit(0)) / 1000.0 * F.lit(float(p))

    return F.when(tokens_in.isNotNull() | tokens_out.isNotNull(), F.round(part(tokens_in, price_in) + part(tokens_out, price_out), 6))


def grade_for(overlap: Column, rank: Column) -> Column:
    return (F.when((overlap >= 0.75) & (rank == 0), 3).when((overlap >= 0.5) & (rank <= 1), 3)
            .when(overlap >= 0.5, 2).when(overlap >= 0.35, 2).otherwise(1)).cast("long")


