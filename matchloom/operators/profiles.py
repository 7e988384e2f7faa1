"""Job profiles that also consult the skill ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import jobtext as jt
from matchloom.operators import ontology as on
from matchloom.operators.containment import contained, listed
from matchloom.operators.ranking import top_k
from matchloom.session import materialize


def _arrays(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Position-ordered array per job; a job has few distinct terms."""
    return rows.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))), lambda e: e["v"]).alias(out))


def with_known(jobs: DataFrame, tokens: DataFrame, name: str) -> DataFrame:
    """The jobs with the ontology tokens (table ``token``) that stand in their text, as the array ``name``."""
    found = contained(jobs, "job_id", F.lower("text"), tokens, "token")
    return listed(found, jobs, "job_id", "token", name)


def ontology_profile(jobs: DataFrame, ont: on.Ontology, roles: DataFrame | None = None, capabilities: DataFrame | None = None, order: str = "skill") -> DataFrame:
    """Profile per job text with ontology terms, normalised seeds and adjacent skills. ``roles``, ``capabilities``: tables
    with ``token``; the ontology's own by default."""
    vocab = ont.alias_map.select("alias", "canonical").unionByName(ont.taxonomy.select(F.col("skill").alias("alias"), F.col("skill").alias("canonical"))).dropDuplicates(["alias"])
    hits = on.ngram_hits(jobs.select("job_id", "text"), "job_id", vocab).where(~F.col("canonical").isin(jt.STOPWORDS))
    empty = F.array().cast("array<string>")
    d = jt.prepare(jobs).join(_arrays(hits, "canonical", "ontology_terms"), "job_id", "left").withColumn("ontology_terms", F.coalesce("ontology_terms", empty))
    d = materialize(jt.required_candidates(d), "profile-terms")
    norm = on.normalize(d.select("job_id", F.concat("ontology_terms", "_req0").alias("s")), "job_id", F.col("s"), ont, order).select(
        "job_id", "core_skills", "expanded_skills", "canonical_skills")
    d = d.join(norm, "job_id")
    tokens = d.select("job_id", F.explode(F.array_distinct(F.concat("_raw", "_filtered", "ontology_terms", "expanded_skills", "canonical_skills"))).alias("token"))
    named = tokens.join(ont.alias_map.withColumnRenamed("alias", "token"), "token", "left").withColumn("name", F.coalesce("canonical", "token"))
    known = named.join(ont.taxonomy.select(F.col("skill").alias("name"), F.lit(1).alias("_t")), "name", "left").join(
        ont.alias_map.select(F.col("canonical").alias("name")).distinct().withColumn("_a", F.lit(1)), "name", "left")
    marks = known.groupBy("job_id").agg(
        F.collect_set(F.when(F.col("_t") == 1, F.col("token"))).alias("core_terms"), F.collect_set(F.when(F.col("_t").isNull() & (F.col("_a") == 1), F.col("token"))).alias("alias_terms"))
    d = d.join(marks, "job_id", "left")
    for c in ("core_terms", "alias_terms"):
        d = d.withColumn(c, F.coalesce(c, empty))
    d = d.withColumn("known_canonical", F.filter("canonical_skills", lambda t: F.array_contains(F.col("core_terms"), t) | F.array_contains(F.col("alias_terms"), t)))
    d = materialize(jt.choose_terms(d), "profile-choice")
    seeds = on.canonicalize(on.explode_tokens(d, "job_id", F.col("required_skills")), ont.alias_map, "job_id").withColumnRenamed("canonical", "skill")
    seeds = seeds.join(ont.taxonomy.select("skill"), "skill", "left_semi").select("job_id", "pos", "skill")
    near = on.adjacent_skills(seeds, ont.taxonomy, "job_id", 10, order).withColumnRenamed("n", "pos")
    d = d.join(_arrays(near, "skill", "adjacent"), "job_id", "left").withColumn("adjacent", F.array_distinct(F.coalesce("adjacent", empty)))
    d = with_known(d, roles if roles is not None else ont.roles, "known_roles")
    return jt.finish(with_known(d, capabilities if capabilities is not None else ont.capabilities, "known_capabilities"))


def query_terms(seeds: DataFrame, alias_map: DataFrame, limit: int = 32, extra: int = 12) -> DataFrame:
    """seeds: job_id, pos, token. Canonical names in order, then up to ``extra`` reverse aliases, cut to ``limit``."""
    canon = on.canonicalize(seeds, alias_map, "job_id").select("job_id", "pos", F.col("canonical").alias("term"))
    back = canon.join(alias_map.withColumnRenamed("canonical", "term"), "term").select("job_id", F.col("alias").alias("term")).distinct()
    back = back.join(canon.select("job_id", "term"), ["job_id", "term"], "left_anti")
    more = top_k(back, ["job_id"], [F.asc("term")], extra, "n").select("job_id", (F.col("n") + 1000000).cast("long").alias("pos"), "term")
    both = canon.select("job_id", F.col("pos").cast("long").alias("pos"), "term").unionByName(more)
    return top_k(both, ["job_id"], [F.asc("pos"), F.asc("term")], limit, "place").select("job_id", "place", "term")
