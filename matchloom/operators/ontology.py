"""Skill ontology joins.

Tokens travel in long form (id, pos, token), so one entity with very many
tokens is many rows, not one task. Vocabulary tables carry no broadcast hint:
Spark broadcasts them only below its own size threshold and otherwise shuffles,
splitting hot tokens by its skew join.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.operators.ranking import places, top_k
from matchloom.session import materialize

# Fixed values -----------------------------------------------------------
MIN_KEY = 5  # shortest taxonomy key that may match inside a longer token
VERSION_PATTERNS = [
    r"^(sql server|ms sql server|microsoft sql server)\s+([0-9]{4}(?:\s*r2)?|[0-9]{4}r2)$",
    r"^(windows(?: server)?)\s+(xp|nt|7|8|10|[0-9]{4})$",
    r"^(oracle)\s+([0-9]+(?:\.[0-9]+)+|[0-9]{1,2}[a-z](?:r[0-9]+)?|[0-9]{1,2}[a-z]/[0-9]{1,2}[a-z])$",
    r"^(oracle)\s+([0-9]{1,2}[a-z]\s+rac)$",
]
# ------------------------------------------------------------------------


@dataclass
class Ontology:
    """alias_map(alias, canonical), taxonomy(skill, ord, domain, family, parents), three
    one-column tag tables (token) and versions(token, canonical, version)."""

    alias_map: DataFrame
    taxonomy: DataFrame
    roles: DataFrame
    capabilities: DataFrame
    review: DataFrame
    versions: DataFrame


def load_ontology(spark: SparkSession, config_dir: str) -> Ontology:
    """Read a user's six ontology YAML files; a missing file gives an empty table."""
    import yaml

    def read(name: str) -> dict:
        path = Path(config_dir) / name
        return (yaml.safe_load(path.read_text(encoding="utf-8")) or {}) if path.exists() else {}

    def table(rows: list, schema: str, *cleaned: str) -> DataFrame:
        df = spark.createDataFrame(rows, schema)
        for c in cleaned:
            df = df.withColumn(c, tx.clean_token(F.col(c)))
        return df.where(F.col(cleaned[0]).isNotNull())

    raw = read("skill_aliases.yml")
    pairs = [(str(a), str(c)) for c, e in raw.items() for a in [c, *((e or {}).get("aliases") or [] if isinstance(e, dict) else [])]]
    taxonomy = [(str(k), i, e.get("domain"), e.get("family"), [x for x in e.get("parents") or [] if isinstance(x, str)])
                for i, (k, e) in enumerate(read("skill_taxonomy.yml").items()) if isinstance(e, dict)]
    review_doc = read("skill_review_required.yml")
    review = [(str(e["token"]),) for key in ("ambiguous_skills", "taxonomy_review_required", "canonical_merge_candidates")
              for e in review_doc.get(key) or [] if isinstance(e, dict) and isinstance(e.get("token"), str)]
    versions = [(str(k), e.get("canonical") or str(k), str(e.get("version") or "unknown"))
                for k, e in read("versioned_skills.yml").items() if isinstance(e, dict)]
    return Ontology(
        table(pairs, "alias string, canonical string", "alias", "canonical").dropDuplicates(["alias"]),
        table(taxonomy, "skill string, ord int, domain string, family string, parents array<string>", "skill", "domain", "family")
        .withColumn("parents", F.array_compact(F.transform("parents", tx.clean_token))),
        table([(str(k),) for k in read("skill_role_candidates.yml")], "token string", "token").distinct(),
        table([(str(k),) for k in read("skill_capability_phrases.yml")], "token string", "token").distinct(),
        table(review, "token string", "token").distinct(),
        table(versions, "token string, canonical string, version string", "token", "canonical", "version"),
    )


def explode_tokens(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, pos, token) with cleaned tokens; the first position of each token stays."""
    # cleaned before they are rows, and without a filter on the list: either would clean them once more
    long = df.select(key, F.posexplode_outer(F.transform(tokens, tx.clean_token)).alias("pos", "token"))
    return long.where("token is not null").groupBy(key, "token").agg(F.min("pos").alias("pos"))


def canonicalize(tokens: DataFrame, alias_map: DataFrame, key: str) -> DataFrame:
    """(key, pos, canonical, aliased): alias look-up, then first position per canonical name."""
    joined = tokens.join(alias_map.select(F.col("alias").alias("token"), "canonical"), "token", "left")
    name = F.coalesce("canonical", "token")
    return joined.groupBy(key, name.alias("canonical")).agg(
        F.min("pos").alias("pos"), F.max(name != F.col("token")).alias("aliased"))


def exact_core(canon: DataFrame, taxonomy: DataFrame) -> DataFrame:
    return canon.join(taxonomy.select(F.col("skill").alias("canonical")), "canonical", "left_semi")


def longest_contained(tokens: DataFrame, taxonomy: DataFrame, order: str = "skill") -> DataFrame:
    """(token, skill): the longest taxonomy key of at least five characters inside each distinct token.

    Both sides are keyed by five characters (every five-gram of the token, the
    first five of the key), so this is an equi join instead of a nested loop
    over the whole vocabulary.
    """
    distinct = tokens.select("token").distinct().where(F.length("token") >= MIN_KEY)
    grams = distinct.select("token", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("token") - (MIN_KEY - 1)),
        lambda i: F.struct(F.substring("token", i, F.lit(MIN_KEY)).alias("g"), i.alias("i")))).alias("x")).select("token", "x.g", "x.i")
    keys = taxonomy.where(F.length("skill") >= MIN_KEY).select(F.substring("skill", 1, MIN_KEY).alias("g"), "skill", F.col(order).alias("_o"))
    hits = grams.join(keys, "g").where(F.substring(F.col("token"), F.col("i"), F.length("skill")) == F.col("skill"))
    best = hits.groupBy("token").agg(F.min(F.struct((-F.length("skill")).alias("n"), "_o", "skill")).alias("b"))
    return best.select("token", F.col("b.skill").alias("skill"))


def core_skills(canon: DataFrame, taxonomy: DataFrame, key: str, order: str = "skill") -> DataFrame:
    """(key, pos, skill): exact taxonomy members, else the longest contained key; first position wins."""
    marked = canon.join(taxonomy.select(F.col("skill").alias("canonical"), F.lit(True).alias("_exact")), "canonical", "left")
    loose = longest_contained(marked.where("_exact is null").select(F.col("canonical").alias("token")), taxonomy, order)
    resolved = marked.join(loose.withColumnRenamed("token", "canonical"), "canonical", "left")
    skill = F.when(F.col("_exact"), F.col("canonical")).otherwise(F.col("skill"))
    return resolved.select(key, "pos", skill.alias("skill")).where("skill is not null").groupBy(key, "skill").agg(F.min("pos").alias("pos"))


def expand_parents(core: DataFrame, taxonomy: DataFrame, key: str) -> DataFrame:
    """(key, skill, pos): each core skill followed by its direct parents, first occurrence kept."""
    joined = core.join(taxonomy.select("skill", "parents"), "skill")
    both = joined.select(key, "pos", F.posexplode(F.concat(F.array("skill"), F.transform("parents", tx.clean_token))).alias("j", "name"))
    return both.where("name is not null").groupBy(key, F.col("name").alias("skill")).agg(F.min(F.struct("pos", "j")).alias("pos"))


def tag_members(canon: DataFrame, tags: DataFrame) -> DataFrame:
    return canon.join(tags.select(F.col("token").alias("canonical")).distinct(), "canonical", "left_semi")


def parse_version(token: Column) -> Column:
    """struct(canonical, version) from the anchored version patterns, else null."""
    out = F.lit(None).cast("struct<canonical:string,version:string>")
    for rx in reversed(VERSION_PATTERNS):
        name = F.replace(F.replace(F.regexp_extract(token, rx, 1), F.lit("microsoft sql server"), F.lit("sql server")), F.lit("ms sql server"), F.lit("sql server"))
        out = F.when(token.rlike(rx), F.struct(name.alias("canonical"), F.regexp_extract(token, rx, 2).alias("version"))).otherwise(out)
    return out


def versioned(tokens: DataFrame, versions: DataFrame) -> DataFrame:
    """Adds canonical and version; the version table wins over the patterns."""
    v = versions.select("token", F.struct("canonical", "version").alias("_v"))
    r = tokens.join(v, "token", "left").withColumn("_v", F.coalesce("_v", parse_version(F.col("token"))))
    return r.where("_v is not null").select(*tokens.columns, F.col("_v.canonical").alias("canonical"), F.col("_v.version").alias("version"))


def normalize(entities: DataFrame, key: str, tokens: Column, ont: Ontology, order: str = "skill") -> DataFrame:
    """All ontology lists of each entity: canonical, core, expanded, capability, role, review, versioned.

    One explode, look-up joins on the token, one final group per entity. The
    grouped items are distinct tokens, so a group is at most the vocabulary.
    """
    canon = materialize(canonicalize(explode_tokens(entities, key, tokens), ont.alias_map, key), "canonical")  # read by two steps
    tax = ont.taxonomy.select("skill", "parents")
    unmatched = canon.select(F.col("canonical").alias("token")).distinct().join(tax.select(F.col("skill").alias("token")), "token", "left_anti")
    loose = longest_contained(unmatched, ont.taxonomy, order)
    to_core = tax.select(F.col("skill").alias("canonical"), "skill").unionByName(loose.withColumnRenamed("token", "canonical")).join(tax, "skill")
    tags = (
        ont.capabilities.select("token", F.lit("c").alias("t")).unionByName(ont.roles.select("token", F.lit("r").alias("t")))
        .unionByName(ont.review.select("token", F.lit("v").alias("t"))).groupBy("token").agg(F.collect_set("t").alias("tags")))
    table = ont.versions.select(F.col("token").alias("canonical"), F.struct(F.col("canonical"), "version").alias("_v"))
    marked = (
        canon.join(to_core, "canonical", "left").join(tags.withColumnRenamed("token", "canonical"), "canonical", "left")
        .join(table, "canonical", "left").withColumn("_v", F.coalesce("_v", parse_version(F.col("canonical")))))
    item = F.struct("pos", "canonical", "skill", "parents", "tags", F.concat_ws("=", "canonical", F.concat("_v.canonical", F.lit("@"), "_v.version")).alias("ver"), F.col("_v").isNotNull().alias("has_v"))
    grouped = marked.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("aliased").alias("alias_applied"))

    def pick(cond, col):
        return F.transform(F.filter("items", cond), lambda e: e[col])

    def tagged(t):
        return pick(lambda e: F.coalesce(F.array_contains(e["tags"], t), F.lit(False)), "canonical")

    def in_core(e):
        return e["skill"].isNotNull()

    lists = {
        "canonical_skills": pick(lambda e: F.lit(True), "canonical"), "core_skills": F.array_distinct(pick(in_core, "skill")),
        "expanded_skills": F.array_distinct(F.flatten(F.transform(F.filter("items", in_core), lambda e: F.concat(F.array(e["skill"]), e["parents"])))),
        "capability_phrases": tagged("c"), "role_candidates": tagged("r"), "review_required_skills": tagged("v"),
        "versioned_skills": pick(lambda e: e["has_v"], "ver"),
    }
    out = entities.select(key).join(grouped, key, "left").select(
        key, *[F.coalesce(c, F.array().cast("array<string>")).alias(n) for n, c in lists.items()], F.coalesce("alias_applied", F.lit(False)).alias("alias_applied"))
    return out.withColumn("taxonomy_applied", sum((F.size(n) for n in list(lists)[1:]), F.lit(0)) > 0)


PAGE = 32  # members of a domain, family or parent that are met at once


def adjacent_skills(seeds: DataFrame, taxonomy: DataFrame, key: str, limit: int = 12, order: str = "skill") -> DataFrame:
    """(key, n, skill, evidence): skills sharing a seed's domain, else family, else parent, seed by seed, until ``limit``.

    Any number of seeds: of a group that holds s of the entity's seeds only the first ``limit + s`` members in taxonomy
    order can matter, and seeds are passed over once the groups of those before them surely fill the answer. Members are
    numbered and joined in pages, so a group is met only as far as that.
    """
    own = taxonomy.select("skill", F.col(order).alias("_o"), "domain", "family", "parents")
    s = seeds.join(own.withColumnRenamed("skill", "seed"), seeds["skill"] == F.col("seed")).select(key, "pos", "seed", "domain", "family", "parents")

    def groups() -> Column:
        def one(kind, tag):
            return F.struct(F.lit(kind).alias("kind"), tag.alias("tag"))

        return F.array_distinct(F.concat(F.array(one(1, F.col("domain")), one(2, F.col("family"))), F.coalesce(F.transform("parents", lambda p: one(3, p)), F.array().cast(
            "array<struct<kind:int,tag:string>>"))))

    listed = own.select("skill", "_o", F.explode(groups()).alias("g")).where("g.tag <> ''").select(F.concat_ws(":", "g.kind", "g.tag").alias("gid"), "_o", "skill")
    numbered = materialize(places(listed, "gid", [F.asc("_o"), F.asc("skill")], "place"), "adjacent-members")
    sizes = numbered.groupBy("gid").agg(F.max("place").alias("members"))
    wanted = s.select(key, "pos", "seed", F.explode(groups()).alias("g")).where("g.tag <> ''").select(
        key, "pos", "seed", "g.kind", "g.tag", F.concat_ws(":", "g.kind", "g.tag").alias("gid"))
    mine = wanted.groupBy(key, "gid").agg(F.count_distinct("seed").alias("mine"))
    met = wanted.join(mine, [key, "gid"]).join(sizes, "gid").where("members > mine")
    yields = met.groupBy(key, "pos").agg(F.max(F.col("members") - F.col("mine")).alias("sure"))
    ahead = F.sum("sure").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))  # one row per seed
    needed = yields.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < limit).select(key, "pos")
    paged = met.join(needed, [key, "pos"]).withColumn("most", F.col("mine") + limit).withColumn(
        "page", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("most") - 1) / PAGE))))
    vocab = numbered.select("gid", "place", "skill", "_o", F.floor((F.col("place") - 1) / PAGE).alias("page"))
    pairs = paged.join(vocab, ["gid", "page"]).where("place <= most").join(s.select(key, F.col("seed").alias("skill")).distinct(), [key, "skill"], "left_anti")
    best = pairs.groupBy(key, "pos", "seed", "skill", "_o").agg(F.min(F.struct("kind", "tag")).alias("b"))
    kept = top_k(best, [key], [F.asc("pos"), F.asc("_o")], limit, "n")
    why = F.element_at(F.array(F.lit("domain"), F.lit("family"), F.lit("parent")), F.col("b.kind"))
    return kept.select(key, "n", "skill", F.concat(
        "skill", F.lit(" is adjacent to "), "seed", F.lit(" via shared "), why, F.lit(" '"), "b.tag", F.lit("'.")).alias("evidence"))


def relation_profile(tokens: DataFrame, taxonomy: DataFrame, key: str, prefix: str) -> DataFrame:
    """Per entity: its skills and the domains, families and parents they carry (sets bounded by the vocabulary)."""
    j = tokens.join(taxonomy.select("skill", "domain", "family", "parents"), "skill", "left")
    return j.groupBy(key).agg(
        F.collect_set("skill").alias(prefix + "skills"), F.collect_set("domain").alias(prefix + "domains"),
        F.collect_set("family").alias(prefix + "families"), F.array_distinct(F.flatten(F.collect_set("parents"))).alias(prefix + "parents"))


def skill_facts(tokens: DataFrame, taxonomy: DataFrame, key: str) -> DataFrame:
    """Per entity: sorted array of (skill, domain, family, parents)."""
    j = tokens.join(taxonomy.select("skill", "domain", "family", "parents"), "skill", "left")
    return j.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("skill", "domain", "family", "parents"))).alias("facts"))


def adjacent_matches(facts: Column, skills: Column, domains: Column, families: Column, parents: Column, limit: int) -> Column:
    """Candidate skills equal to, or sharing domain, family or parent with, the job's set (row-local)."""
    def related(f):
        return (
            F.array_contains(skills, f["skill"]) | F.coalesce(F.array_contains(domains, f["domain"]), F.lit(False))
            | F.coalesce(F.array_contains(families, f["family"]), F.lit(False)) | F.coalesce(F.arrays_overlap(parents, f["parents"]), F.lit(False)))

    return F.slice(F.transform(F.filter(facts, related), lambda f: f["skill"]), 1, limit)


def adjacent_score(matches: Column, skills: Column) -> Column:
    return F.when(F.size(skills) > 0, F.least(F.lit(1.0), F.round(F.size(matches) / F.size(skills), 4))).otherwise(F.lit(0.0))


def ngram_hits(texts: DataFrame, key: str, vocab: DataFrame, max_n: int = 4) -> DataFrame:
    """(key, pos, canonical): vocabulary phrases among a text's 1..4-grams, longest first.

    Grams are made inside the row and reduced to distinct (key, gram) before
    the hash join.
    """
    clean = F.btrim(F.regexp_replace(F.regexp_replace(tx.squash(F.lower("text")), "&", " and "), tx.WS + "+", " "), F.lit(tx.EDGE_CHARS))
    words = F.regexp_extract_all(clean, F.lit(r"[a-zA-Z0-9+.#-]+"), F.lit(0))

    def grams(ws):
        sizes = [
            F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(1))), lambda i: F.struct(
                F.lit(max_n - n).alias("a"), i.alias("b"), F.array_join(F.slice(ws, i, n), " ").alias("g"))))
            for n in range(max_n, 0, -1)]
        return F.concat(*[F.coalesce(s, F.array().cast("array<struct<a:int,b:int,g:string>>")) for s in sizes])

    long = texts.select(key, F.explode(tx.let(words, grams)).alias("x")).groupBy(key, F.col("x.g").alias("alias")).agg(F.min(F.struct("x.a", "x.b")).alias("pos"))
    return long.join(vocab, "alias").groupBy(key, "canonical").agg(F.min("pos").alias("pos"))


def alias_hints(texts: DataFrame, key: str, vocab: DataFrame, limit: int | None = 30) -> DataFrame:
    """(key, hints): canonical names of aliases that stand free in the text, longest aliases first; None: all of them.

    A word of the text that begins an alias gives its 1..3-grams, which are hash joined with each alias's first three
    words; the boundary test then runs once per text. The vocabulary is written first, so Spark knows its size: below the
    broadcast threshold no gram is shuffled, and of a text's matches each task ships one row.
    """
    def head(c):
        return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))

    keyed = materialize(vocab.where(F.length("alias") >= 3).select("alias", "canonical", F.array_join(F.slice(head(F.col("alias")), 1, 3), " ").alias("g")).distinct(), "alias-vocabulary")
    begins = keyed.select(F.substring_index("g", " ", 1).alias("w")).distinct()

    def words(ws):  # a text without words has an empty one
        row = F.transform(ws, lambda w, i: F.struct(w.alias("w"), F.get(ws, i + 1).alias("w2"), F.get(ws, i + 2).alias("w3")))
        return F.when(F.size(ws) > 0, row).otherwise(F.array(F.struct(F.lit("").alias("w"), F.lit(None).cast("string").alias("w2"), F.lit(None).cast("string").alias("w3"))))

    begun = texts.select(key, F.inline(tx.let(head(F.col("text")), words))).join(begins, "w", "left_semi")
    grams = F.array_distinct(F.array("w", F.concat_ws(" ", "w", "w2"), F.concat_ws(" ", "w", "w2", "w3")))
    cand = begun.select(key, F.explode(grams).alias("g")).join(keyed, "g").select(key, "alias", "canonical")
    per = cand.groupBy(key).agg(F.array_sort(F.collect_set(F.struct((-F.length("alias")).alias("n"), "alias", "canonical"))).alias("c"))
    compact = F.concat(F.lit(" "), tx.single_spaced(F.lower("text")), F.lit(" "))

    def free(t):
        return F.filter("c", lambda e: t.contains(e["alias"]) & F.rlike(t, F.concat(F.lit(r"(?<![a-z0-9])\Q"), e["alias"], F.lit(r"\E(?![a-z0-9])"))))

    return texts.join(per, key).select(key, F.array_distinct(F.transform(tx.first_items(tx.let(compact, free), limit), lambda e: e["canonical"])).alias("hints")).where(F.size("hints") > 0)
