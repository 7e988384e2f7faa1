"""Ingestion: candidate build, content hashes, change plan, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import resume as rs
from matchloom.functions import text as tx
from matchloom.operators import ontology as on
from matchloom.operators.experience import parse_resumes
from matchloom.session import materialize

VERSIONS = {"normalization_version": "norm-1", "taxonomy_version": "taxonomy-1", "embedding_text_version": "embedding-text-1", "experience_years_method": "month-union-1"}
KEY = ["source_dataset", "candidate_id"]


def default_versions(df: DataFrame) -> DataFrame:
    for name, value in VERSIONS.items():
        df = df.withColumn(name, F.coalesce(tx.blank_to_null(F.col(name)), F.lit(value)))
    return df


def payload(scalars: list[str], lists: list[str], sets: list[str]) -> Column:
    """Canonical JSON: fixed field order, nulls kept, set-like arrays sorted and distinct. Contacts stay out."""
    fields = [F.col(c).alias(c) for c in scalars] + [F.col(c).alias(c) for c in lists] + [tx.sorted_unique(F.col(c)).alias(c) for c in sets]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def normalization_hash(content: Column, stored: Column, *versions: Column) -> Column:
    """The stored hash while its three versions are current, else the content's SHA-256."""
    names = ["normalization_version", "taxonomy_version", "experience_years_method"]
    current = stored.isNotNull() & (stored != "")
    for name, v in zip(names, versions):
        current = current & v.eqNullSafe(F.lit(VERSIONS[name]))
    return F.when(current, stored).otherwise(F.sha2(content, 256))


def embedding_hash(text: Column, norm_hash: Column) -> Column:
    return F.sha2(F.concat_ws("\x01", "candidate_id", "source_dataset", tx.embedding_text(text), "embedding_text_version", "normalization_version", "taxonomy_version", norm_hash), 256)


def plan_changes(batch: DataFrame, state: DataFrame, *, write_docs: bool = True, write_vectors: bool = True,
                 force_upsert: bool = False, force_reembed: bool = False) -> DataFrame:
    """Per candidate: needs_upsert, needs_embedding and the embedding hash to store.

    batch and state carry KEY, normalization_hash and embedding_hash; an
    upsert resets the stored embedding hash unless it is unchanged.
    """
    prev = state.select(*KEY, F.col("normalization_hash").alias("_pn"), F.col("embedding_hash").alias("_pe"))
    j = batch.join(prev, KEY, "left")
    up = F.lit(write_docs) & (F.lit(force_upsert) | ~F.col("_pn").eqNullSafe(F.col("normalization_hash")))
    emb = F.lit(write_vectors) & (F.lit(force_reembed) | ~F.col("_pe").eqNullSafe(F.col("embedding_hash")))
    return j.select(
        *batch.columns, up.alias("needs_upsert"), emb.alias("needs_embedding"),
        F.when(F.col("_pe") == F.col("embedding_hash"), F.col("embedding_hash")).alias("stored_embedding_hash")).withColumn(
        "action", F.concat_ws("+", F.when(F.col("needs_upsert"), "upsert"), F.when(F.col("needs_embedding"), "embed")))


def counters(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("seen"), F.count_if("needs_upsert").alias("upserted"), F.count_if(~F.col("needs_upsert")).alias("skipped"),
                    F.count_if("needs_embedding").alias("embedded"), F.count_if(~F.col("needs_embedding")).alias("embed_skipped"))


def cleaned_skills(skills: Column) -> Column:
    """Sanitised skills, or the raw list when nothing survives."""
    return tx.let(tx.sanitize_skills(skills), lambda s: F.when(F.size(s) > 0, s).otherwise(tx.skill_list_raw(skills)))


def span_years(items: Column, as_of_idx: int) -> Column:
    """Years covered by one record's month intervals: distinct months listed, counted. Row-local."""
    def idx(m):
        return F.when(m.rlike(r"^\d{4}-\d{2}$"), F.substring(m, 1, 4).cast("int") * 12 + F.substring(m, 6, 2).cast("int") - 1)

    spans = F.transform(items, lambda e: F.struct(idx(e["start_date"]).alias("s"), F.coalesce(idx(e["end_date"]), F.lit(as_of_idx)).alias("e")))
    ok = F.filter(spans, lambda x: x["s"].isNotNull() & (x["e"] >= x["s"]))
    months = F.array_distinct(F.flatten(F.transform(ok, lambda x: F.sequence(x["s"], F.greatest(x["e"], x["s"])))))
    return tx.let(months, lambda m: F.when(F.size(m) > 0, F.round(F.size(m) / 12, 1)))


def build_candidates(resumes: DataFrame, ont: on.Ontology, as_of_idx: int) -> DataFrame:
    """Stored-candidate rows of unstructured résumés (candidate_id, source_dataset, category, text)."""
    c = F.col
    p = parse_resumes(resumes)
    p = p.withColumn("experience", rs.typed_experience(c("experience"))).withColumn("education", rs.typed_education(c("education")))
    p = p.withColumn("_skills", F.when(F.size("skills") > 0, c("skills")).otherwise(rs.fallback_skills(c("text"))))
    p = p.withColumn("abilities", rs.abilities(c("summary"), F.array_compact(F.transform("experience", lambda e: e["description"])), c("text")))
    p = p.withColumn("_cleaned", cleaned_skills(c("_skills")))
    p = materialize(p, "parsed")  # several branches below read it; parse each text and clean its skills once
    vocab = ont.alias_map.select("alias", "canonical")
    bare = p.where(F.size("_skills") == 0).select("candidate_id", "text")
    hints = on.alias_hints(bare, "candidate_id", vocab)
    p = p.join(hints, "candidate_id", "left").withColumn(
        "skills", F.when(F.size("_skills") > 0, c("_cleaned")).otherwise(cleaned_skills(F.coalesce("hints", F.array().cast("array<string>")))))
    n = on.normalize(p.select("candidate_id", F.concat("skills", "abilities").alias("t")), "candidate_id", c("t"), ont)
    years = F.coalesce(span_years(c("experience"), as_of_idx), tx.years_from_text(c("text")))
    d = p.join(n, "candidate_id").withColumn("experience_years", years)
    d = d.withColumn("_inj", rs.inject_category(c("core_skills"), c("canonical_skills"), c("expanded_skills"), c("category"), F.array().cast("array<string>")))
    for name in ("core_skills", "canonical_skills", "expanded_skills"):
        d = d.withColumn(name, c(f"_inj.{name}"))
    titles = F.array_distinct(F.array_compact(F.transform("experience", lambda e: e["title"])))
    d = d.withColumn("seniority_level", tx.seniority_bucket(c("experience_years"))).withColumn("embedding_text", rs.build_embedding_text(
        name=c("name"), category=c("category"), summary=c("summary"), core=c("core_skills"), canonical=c("canonical_skills"), expanded=c("expanded_skills"),
        capabilities=c("capability_phrases"), titles=titles, fallback=c("text")))
    return d.drop("_skills", "_cleaned", "hints", "_inj")


def upgrade(stored: DataFrame, ont: on.Ontology, as_of_idx: int) -> DataFrame:
    """Re-normalise stored candidates to the current versions.

    Needs candidate_id, source_dataset, name, category, summary, skills,
    normalized_skills, abilities, experience (items), experience_years,
    seniority_level and the version columns.
    """
    c = F.col
    src = F.when(F.size("skills") > 0, c("skills")).otherwise(c("normalized_skills"))
    d = stored.withColumn("skills", cleaned_skills(src))
    n = on.normalize(d.select("candidate_id", F.concat("skills", "abilities").alias("t")), "candidate_id", c("t"), ont)
    d = d.drop("alias_applied", "taxonomy_applied").join(n, "candidate_id")
    has_items = F.size("experience") > 0
    d = d.withColumn("experience_years", F.when(has_items, span_years(c("experience"), as_of_idx)).otherwise(c("experience_years")))
    d = d.withColumn("seniority_level", F.when(has_items, tx.seniority_bucket(c("experience_years"))).otherwise(c("seniority_level")))
    titles = F.array_distinct(F.array_compact(F.transform("experience", lambda e: e["title"])))
    d = d.withColumn("embedding_text", rs.build_embedding_text(
        name=c("name"), category=c("category"), summary=c("summary"), core=c("core_skills"), canonical=c("canonical_skills"), expanded=c("expanded_skills"),
        capabilities=c("capability_phrases"), titles=titles, fallback=F.lit(None).cast("string")))
    return default_versions(d)
