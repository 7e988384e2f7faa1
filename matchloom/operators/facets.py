"""Filter dictionaries, candidate filters and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import let, normalize_region, normalize_token

# Fixed values -----------------------------------------------------------
FILTERS = {
    "industries": {
        "technology": {"aliases": ["it", "tech", "information technology", "software"],
                       "category_terms": ["information technology", "it", "software", "engineering", "developer", "platform"]},
        "finance": {"aliases": ["fintech", "banking", "financial services"],
                    "category_terms": ["finance", "fintech", "banking", "accounting", "investment", "audit"]},
        "healthcare": {"aliases": ["health care", "health tech", "medical"],
                       "category_terms": ["healthcare", "health care", "medical", "clinical", "pharma"]},
        "e commerce": {"aliases": ["ecommerce", "e-commerce", "online retail", "digital commerce"],
                       "category_terms": ["e commerce", "ecommerce", "retail", "marketplace", "digital commerce", "online retail"]},
        "manufacturing": {"aliases": ["industrial", "automotive", "production"],
                          "category_terms": ["manufacturing", "industrial", "automotive", "production", "factory"]},
    },
    "job_families": {
        "software engineering": {"aliases": ["software engineer", "sde", "swe", "programmer", "developer", "backend", "frontend"],
                                 "category_terms": ["software", "engineering", "programming", "development", "backend", "frontend"]},
        "data engineering": {"aliases": ["data engineer"], "category_terms": ["data", "etl", "pipeline", "warehouse"]},
        "data analysis": {"aliases": ["data analyst", "business analyst"], "category_terms": ["analysis", "bi", "tableau", "analytics"]},
        "mobile": {"aliases": ["ios developer", "android developer", "mobile engineer"],
                   "category_terms": ["mobile", "ios", "android", "flutter", "react native"]},
        "devops": {"aliases": ["site reliability engineer", "sre", "devops engineer"],
                   "category_terms": ["devops", "infrastructure", "ci/cd", "aws", "cloud", "reliability"]},
        "qa": {"aliases": ["quality assurance", "test engineer", "sdet", "qa engineer"],
               "category_terms": ["qa", "testing", "automation", "quality assurance"]},
        "security": {"aliases": ["cybersecurity", "infosec", "security engineer"], "category_terms": ["security", "penetration testing", "soc"]},
        "design": {"aliases": ["designer", "ui/ux", "product designer"], "category_terms": ["design", "ux", "ui", "figma"]},
        "product management": {"aliases": ["product manager", "pm"], "category_terms": ["product", "roadmap", "agile"]},
        "project management": {"aliases": ["project manager", "scrum master"], "category_terms": ["project", "scrum", "pmp", "agile"]},
        "information technology": {"aliases": ["it", "sysadmin", "system administration"],
                                   "category_terms": ["it", "support", "network", "system administration"]},
        "human resources": {"aliases": ["hr", "recruiter", "talent acquisition"],
                            "category_terms": ["hr", "recruitment", "human resources", "talent"]},
        "finance": {"aliases": ["accountant", "financial analyst", "banking"], "category_terms": ["finance", "accounting", "banking", "financial"]},
        "sales": {"aliases": ["account executive", "sales representative", "business development"],
                  "category_terms": ["sales", "business development", "bdr"]},
        "marketing": {"aliases": ["digital marketing", "seo specialist", "public relations"],
                      "category_terms": ["marketing", "seo", "content", "pr", "public relations"]},
    },
    "educations": ["Bachelor", "Master", "PhD"],
    "regions": ["India", "Remote", "United Kingdom", "United States"],
}
DEGREE_PATTERNS = {
    "bachelor": (1, ["bachelor", "bachelors", "b.tech", "btech", "b.e", "be ", "b.sc", "bsc", "ba "]),
    "master": (2, ["master", "masters", "m.tech", "mtech", "m.e", "m.sc", "msc", "mba", "ms "]),
    "phd": (3, ["phd", "doctor", "doctorate", "dphil"]),
}
# ------------------------------------------------------------------------


def load_filters(path: str) -> dict:
    """A user's own filter file (YAML with the same four keys)."""
    import yaml

    with open(path, encoding="utf-8") as fh:
        return {**FILTERS, **(yaml.safe_load(fh) or {})}


def spaced(term: str) -> str:
    """Lower case with '-' and '_' as spaces, for dictionary terms."""
    return " ".join(term.lower().replace("-", " ").replace("_", " ").split())


def normalize_label(c: Column, dictionary: dict) -> Column:
    """Canonical key of a label, by key first, then by alias; else the label itself."""
    t = normalize_token(c)
    names: dict[str, str] = {}
    for key, entry in dictionary.items():
        for alias in entry["aliases"]:
            names.setdefault(alias, key)
    names.update({key: key for key in dictionary})
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(m, t), t)


def contains_any(c: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def education_level(degrees: Column) -> Column:
    """Highest of bachelor 1, master 2, PhD 3 over an array of degrees; 0 if none."""
    def level(x):
        return let(normalize_token(x), lambda t: F.greatest(
            *[F.when(contains_any(t, ws), F.lit(n)).otherwise(F.lit(0)) for n, ws in DEGREE_PATTERNS.values()]))

    return F.coalesce(F.array_max(F.transform(degrees, level)), F.lit(0)).cast("long")


def education_need(wanted: Column) -> Column:
    """Least level that a job's education filter asks for; 0 if none."""
    w = normalize_token(wanted)
    need = F.lit(0)
    for name, (n, _) in DEGREE_PATTERNS.items():
        need = F.when(w == name, F.lit(n)).otherwise(need)
    return need


def matches_education(degrees: Column, wanted: Column) -> Column:
    return education_level(degrees) >= education_need(wanted)


def locations(*places: Column) -> Column:
    """Normalised non-empty places; each argument is an array of strings."""
    return F.filter(F.transform(F.concat(*places), lambda p: normalize_region(p)), lambda p: p != "")


def matches_region(places: Column, wanted: Column) -> Column:
    w = normalize_region(wanted)
    remote = F.exists(places, lambda p: p.contains("remote") | p.contains("wfh"))
    return F.when(w == "", F.lit(True)).when(w == "remote", remote).otherwise(F.exists(places, lambda p: p.contains(w)))


def education_labels(degrees: Column) -> Column:
    def has(ws):
        return F.exists(degrees, lambda x: contains_any(normalize_token(x), ws))

    return F.filter(F.array(*[F.when(has(ws), F.lit(n)) for n, (_, ws) in DEGREE_PATTERNS.items()]), lambda x: x.isNotNull())


def inferred_labels(category: Column, skills: Column, dictionary: dict) -> Column:
    """Display labels of dictionary entries with any term inside the joined tokens."""
    toks = F.filter(F.array_union(F.array(normalize_token(category)), F.transform(skills, normalize_token)), lambda t: t != "")

    def labels(joined):
        out = []
        for key, entry in dictionary.items():
            terms = [spaced(t) for t in [key, *entry["aliases"], *entry["category_terms"]]]
            out.append(F.when(contains_any(joined, list(dict.fromkeys(terms))), F.lit(title_label(key))))
        return F.filter(F.array(*out), lambda x: x.isNotNull())

    return let(F.array_join(F.array_sort(toks), " "), labels)


def industry_seeds(dictionary: dict) -> dict[str, list[str]]:
    return {k: list(dict.fromkeys(spaced(t) for t in [*e["aliases"], *e["category_terms"]])) for k, e in dictionary.items()}


def industry_term_table(spark, taxonomy: DataFrame, dictionary: dict = FILTERS["industries"]) -> DataFrame:
    """(industry, tag): seed terms plus every taxonomy skill that touches a seed."""
    seeds = spark.createDataFrame([(k, t) for k, ts in industry_seeds(dictionary).items() for t in ts], "industry string, tag string")
    touching = taxonomy.select(
        F.col("skill"), F.explode(F.array_distinct(F.filter(F.transform(
            F.concat(F.array("skill", "domain", "family"), "parents"), normalize_token), lambda x: x != ""))).alias("tag"))
    grown = touching.join(seeds, "tag").select("industry", normalize_token(F.col("skill")).alias("tag"))
    return seeds.unionByName(grown).distinct()


def candidate_tag_table(docs: DataFrame, taxonomy: DataFrame, alias_map: DataFrame, dictionary: dict = FILTERS["industries"]) -> DataFrame:
    """(candidate_id, tag): canonical skills with their domain, family and parent, plus the category."""
    category = normalize_label(F.col("category"), dictionary)
    toks = docs.select("candidate_id", F.explode(F.array_distinct(F.concat(
        F.transform(F.concat("skills", "core_skills", "expanded_skills"), normalize_token), F.array(category)))).alias("token")).where("token <> ''")
    canon = toks.join(alias_map.withColumnRenamed("alias", "token"), "token", "left").select(
        "candidate_id", F.coalesce("canonical", "token").alias("skill"))
    tags = canon.join(taxonomy, "skill", "left").select("candidate_id", F.explode(F.concat(
        F.array("skill"), F.transform(F.array("domain", "family"), normalize_token),
        F.transform(F.coalesce("parents", F.array().cast("array<string>")), normalize_token))).alias("tag"))
    return tags.where("tag <> ''").distinct()


def title_label(key: str) -> str:
    return {"e commerce": "E-commerce", "ci cd": "CI/CD"}.get(spaced(key), spaced(key).title())


def filter_options(filters: dict = FILTERS) -> dict[str, list[str]]:
    label = title_label
    return {
        "job_families": sorted(label(k) for k in filters["job_families"]), "educations": sorted(filters["educations"]),
        "regions": sorted(filters["regions"]), "industries": sorted(label(k) for k in filters["industries"]),
    }


def industry_fits(docs: DataFrame, taxonomy: DataFrame, alias_map: DataFrame, dictionary: dict) -> DataFrame:
    """(candidate_id, industry): industries of the filter file that a candidate's tags touch."""
    terms = industry_term_table(docs.sparkSession, taxonomy, dictionary)
    return candidate_tag_table(docs, taxonomy, alias_map).join(terms, "tag").select("candidate_id", "industry").distinct()


def enrich_hits(hits: DataFrame, docs: DataFrame, fits: DataFrame | None = None) -> DataFrame:
    """Join hits to documents and drop those failing the job's filters.

    ``hits``: job_id, candidate_id, rank, experience_years and the job's
    min_years, education, region, and with ``fits`` (see ``industry_fits``) its
    industry key (any may be null). Rank is carried through.
    """
    if fits is not None:
        told = fits.withColumn("_fit", F.lit(True))
        hits = hits.join(told, ["candidate_id", "industry"], "left").where((F.coalesce("industry", F.lit("")) == "") | F.col("_fit")).drop("_fit")
    joined = hits.join(docs.select("candidate_id", "degree", "location"), "candidate_id")
    years_ok = F.col("min_years").isNull() | F.coalesce(F.col("experience_years") >= F.col("min_years"), F.lit(False))
    return joined.where(
        years_ok & matches_education(F.array("degree"), F.col("education"))
        & matches_region(locations(F.array("location")), F.col("region")))
