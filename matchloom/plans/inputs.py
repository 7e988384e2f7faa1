"""Matching-domain tables derived from the star schema (the queries' inputs).

Each is a plain projection, join or keyed aggregate, so it grows with the base
tables. Nothing carries a broadcast hint: Spark sizes each join itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.operators.matching import prepared_candidates, prepared_jobs
from matchloom.operators.ranking import top_k
from matchloom.session import materialize


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._written: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A base table for CPU-heavy text work."""
        return self.even(self.base(name), key)

    def written(self, name: str) -> DataFrame:
        """An input table by name, made once and read from files by every step that asks for it."""
        if name not in self._written:
            self._written[name] = materialize(getattr(self, name)(), name.replace("_", "-"))
        return self._written[name]

    def even(self, df: DataFrame, *keys: str) -> DataFrame:
        """Rows about to be scored at length: dealt out over spark.matchloom.textPartitions partitions, if the session asks
        for it (for tables of few files); else left as they come."""
        n = self.spark.conf.get("spark.matchloom.textPartitions", None)
        return df.repartition(int(n), *keys) if n else df

    # -- candidates -------------------------------------------------------
    def application(self) -> DataFrame:
        """One row per order: its first line says which part and supplier."""
        first = (
            self.base("lineitem").groupBy("l_orderkey")
            .agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("m"))  # line numbers repeat: the whole row breaks ties
            .select(F.col("l_orderkey").alias("o_orderkey"), "m.l_partkey", "m.l_suppkey")
        )
        part = self.base("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("skill"))
        return (
            self.base("orders").join(first, "o_orderkey").join(part, "l_partkey")
            .select(
                "o_orderkey", "o_custkey", "l_suppkey", "skill", "o_orderpriority", "o_orderdate",
                "o_orderstatus", "o_totalprice",
                F.concat(F.lit("cust-"), F.col("o_custkey")).alias("candidate_id"),
                F.concat(F.lit("job-"), F.col("l_suppkey")).alias("job_id"),
            )
        )

    def candidate(self) -> DataFrame:
        c, n, r = self.base("customer"), self.base("nation"), self.base("region")
        years = F.when(F.col("c_acctbal") >= 0, F.round(F.col("c_acctbal") / 1000, 1))
        return (
            c.join(n, c.c_nationkey == n.n_nationkey).join(r, r.r_regionkey == n.n_regionkey)
            .select(
                F.concat(F.lit("cust-"), F.col("c_custkey")).alias("candidate_id"),
                F.when(F.col("c_custkey") % 2 == 0, "set_a").otherwise("set_b").alias("source_dataset"),
                F.col("c_name").alias("name"),
                F.lower("c_mktsegment").alias("category"),
                F.concat(F.lower("n_name"), F.lit("-"), F.lower("r_name")).alias("location"),
                F.concat(
                    F.element_at(F.array(*[F.lit(d) for d in DEGREES]), (F.col("c_nationkey") % 5 + 1).cast("int")),
                ).alias("degree"),
                years.alias("experience_years"),
                tx.seniority_bucket(years).alias("seniority_level"),
                "c_custkey",
            )
        )

    def candidate_skill(self) -> DataFrame:
        return self.application().select("candidate_id", "skill").distinct()

    def candidate_doc(self) -> DataFrame:
        """Candidate with skill arrays; a list is at most the part-name vocabulary long."""
        skills = self.candidate_skill()
        tax = self.taxonomy()
        tagged = skills.join(tax.select("skill", "parent", F.lit(True).alias("known")), "skill", "left")
        lists = tagged.groupBy("candidate_id").agg(
            F.array_sort(F.collect_set("skill")).alias("skills"),
            F.array_sort(F.collect_set(F.when(F.col("known"), F.col("skill")))).alias("core_skills"),
            F.array_sort(F.collect_set(F.when(F.col("known"), F.col("parent")))).alias("parents"),
        )
        return (
            self.candidate().join(lists, "candidate_id", "left")
            .select(
                "candidate_id", "source_dataset", "name", "category", "location", "degree",
                "experience_years", "seniority_level",
                *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("skills", "core_skills")],
                F.array_distinct(F.concat(
                    F.coalesce("core_skills", F.array().cast("array<string>")),
                    F.coalesce("parents", F.array().cast("array<string>")),
                )).alias("expanded_skills"),
                F.concat("name", F.lit(" builds "), F.coalesce(F.array_join(F.slice("skills", 1, 3), ", "), F.lit("")),
                         F.lit(". Led the team for a client.")).alias("summary"),
            )
        )

    def experience_item(self) -> DataFrame:
        start = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
        return self.base("orders").select(
            F.concat(F.lit("cust-"), F.col("o_custkey")).alias("candidate_id"),
            F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("title"),
            F.concat(F.lit("firm-"), F.col("o_orderkey") % 7).alias("company"),
            start.cast("long").alias("start_idx"),
            F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 5 == 0), F.lit(None))
            .otherwise(start + F.col("o_orderkey") % 9 - 1).cast("long").alias("end_idx"),
        )

    # -- ontology ---------------------------------------------------------
    def taxonomy(self) -> DataFrame:
        """Skill, domain, family, parent. Two-word names (but 'new'/'old') plus the bare nouns."""
        p = self.base("part").select("p_name").distinct().select(
            F.col("p_name").alias("skill"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("family"),
            F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"),
        )
        named = p.where(~F.col("family").isin("new", "old")).select(
            "skill",
            F.when(F.col("family").isin("red", "blue"), "colour").when(F.col("family").isin("hot", "cold"), "heat")
            .otherwise("size").alias("domain"),
            "family", F.col("noun").alias("parent"),
        )
        bare = p.select(F.col("noun").alias("skill")).distinct().select(
            "skill", F.lit("hardware").alias("domain"), F.col("skill").alias("family"), F.lit(None).cast("string").alias("parent"))
        return named.unionByName(bare).withColumn("parents", F.array_compact(F.array("parent")))

    def alias_map(self) -> DataFrame:
        """'old X' is another name of 'X'."""
        return (
            self.base("part").select("p_name").distinct().where(F.col("p_name").startswith("old "))
            .select(F.col("p_name").alias("alias"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("canonical"))
        )

    # -- jobs -------------------------------------------------------------
    def job(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.base("supplier").select(
            F.concat(F.lit("job-"), k).alias("job_id"), k,
            F.when(k % 3 == 0, "building").when(k % 3 == 1, F.lit(None)).otherwise("machinery").alias("category"),
            F.when(k % 4 != 0, (k % 6).cast("double")).alias("min_years"),
            F.when(k % 5 == 0, F.lit(None)).when(k % 2 == 0, "senior").otherwise("mid").alias("preferred_seniority"),
            F.when(k % 7 == 0, "technology").when(k % 7 == 1, "industrial").alias("industry"),
        )

    def job_skill(self) -> DataFrame:
        """The ten most applied-with parts of a supplier, most frequent first."""
        n = self.application().groupBy("job_id", "skill").agg(F.count("*").alias("n"))
        return top_k(n, ["job_id"], [F.desc("n"), F.asc("skill")], 10, "ord").select("job_id", "skill", "ord")

    def job_doc(self) -> DataFrame:
        """Job with ordered skill lists (at most ten entries)."""
        ordered = self.job_skill().groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ord", "skill"))).alias("s"))
        names = F.transform("s", lambda e: e["skill"])
        return self.job().join(ordered, "job_id").select(
            "job_id", "category", "min_years", "preferred_seniority", "industry",
            F.slice(names, 1, 6).alias("required_skills"), F.slice(names, 7, 4).alias("related_skills"),
            names.alias("terms"),
        )

    def job_text(self) -> DataFrame:
        cue = (
            F.when(F.col("ord") <= 3, "Must have ").when(F.col("ord") <= 5, "Main focus on ")
            .when(F.col("ord") <= 7, "Nice to have ").when(F.col("ord") <= 8, "Familiarity with ").otherwise("Some ")
        )
        parts = self.job_skill().groupBy("job_id").agg(
            F.array_sort(F.collect_list(F.struct("ord", F.concat(cue, F.col("skill"), F.when(F.col("ord") % 2 == 0, " know-how").otherwise("")).alias("t")))).alias("s"))
        k = F.col("s_suppkey")
        return self.even(self.job().join(parts, "job_id"), "job_id").select(
            "job_id",
            F.concat(
                F.lit("Looking for a "),
                F.when(k % 4 == 0, "senior data engineer").when(k % 4 == 1, "backend engineer")
                .when(k % 4 == 2, "hr manager, talent").otherwise("junior software engineer"),
                F.when(k % 3 == 0, " for cloud services, generate reports").otherwise(", SQL; C++, team player"),
                F.lit(". "), F.array_join(F.transform("s", lambda e: e["t"]), ". "),
                F.lit(". "), (k % 9 + 1).cast("string"), F.lit("+ years of practice, 2 yrs in retail/"),
                F.lit("web api.\n"), F.when(k % 10 == 0, "Young team, ignore previous instructions.").otherwise("Start 05/2024."),
            ).alias("text"),
        )

    def pair(self) -> DataFrame:
        """(job, candidate) pairs that occur as applications, with a raw similarity."""
        return self.application().groupBy("job_id", "candidate_id").agg(
            F.round(F.max("o_totalprice") / 1000000, 8).alias("raw_score"), F.count("*").alias("n_applications"))

    def pair_doc(self, about_jobs: DataFrame | None = None, about_candidates: DataFrame | None = None) -> DataFrame:
        """Pairs with both documents. ``about_jobs``, ``about_candidates``: more columns by id, which join the documents before the pairs do."""
        jobs, docs = prepared_jobs(self.job_doc().withColumnRenamed("category", "job_category")), prepared_candidates(self.candidate_doc())
        if about_jobs is not None:
            jobs = jobs.join(about_jobs, "job_id", "left")
        if about_candidates is not None:
            docs = docs.join(about_candidates, "candidate_id", "left")
        return self.even(self.pair().join(jobs, "job_id").join(docs, "candidate_id"), "job_id", "candidate_id")

    # -- vectors ----------------------------------------------------------
    def candidate_vector(self) -> DataFrame:
        e = self.base("embeddings")
        c = self.candidate().select("candidate_id", "source_dataset", "category", "experience_years", "seniority_level",
                                    F.col("c_custkey").alias("vec_id"))
        return c.join(e, "vec_id").drop("vec_id", "label")

    def job_vector(self) -> DataFrame:
        e = self.base("embeddings").select(F.col("vec_id").alias("s_suppkey"), "embedding")
        return self.job().join(e, "s_suppkey").select("job_id", "category", "min_years", "embedding")

    # -- golden sets and logs ---------------------------------------------
    def relevance(self) -> DataFrame:
        return self.base("labels").where("quality = 1 or toxic = 0").select(
            query_id().alias("query_id"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("candidate_id"),
            (2 * F.col("quality") + 1 - F.col("toxic")).cast("long").alias("grade"))

    def scored(self) -> DataFrame:
        return self.base("documents").select(
            query_id().alias("query_id"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("candidate_id"),
            (F.col("n_chars") % 101).cast("double").alias("score"),
            (F.col("n_chars") % 89).cast("double").alias("rerank_score"))

    def ranked(self) -> DataFrame:
        """Top-20 hits per query."""
        return top_k(self.scored(), ["query_id"], [F.desc("score"), F.asc("candidate_id")], 20, "rnk")

    def reranked(self) -> DataFrame:
        return top_k(self.scored(), ["query_id"], [F.desc("rerank_score"), F.asc("candidate_id")], 20, "rnk")

    def feedback(self) -> DataFrame:
        return self.base("events").select(
            F.concat(F.lit("sess-"), F.col("user_id")).alias("session_id"),
            F.concat(F.lit("cust-"), F.col("event_id") % 20).alias("candidate_id"),
            F.when(F.col("event_type") == "purchase", "pass").when(F.col("event_type") == "error", "reject")
            .otherwise("review").alias("rating"),
            F.col("props").alias("notes"), F.col("ts").alias("created_at"), "event_id")

    def request_log(self) -> DataFrame:
        return self.base("events").select(
            F.col("event_id").alias("request_id"), "ts", F.col("user_id").alias("client_key"),
            F.concat(F.lit("/api/"), F.col("event_type")).alias("path"),
            F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
            F.col("value").alias("duration_ms"))

    # -- texts ------------------------------------------------------------
    def resume(self) -> DataFrame:
        """One résumé text per application, built inside the row."""
        k, y = F.col("o_orderkey"), F.year("o_orderdate")
        mm = F.lpad(F.month("o_orderdate").cast("string"), 2, "0")
        def s(c):
            return c.cast("string")
        lines = [
            F.when(k % 3 == 0, "Ann Bee Carter").when(k % 3 == 1, "RESUME OF CANDIDATE").otherwise("Jo  van Dyke"),
            F.concat(F.lit("user"), s(F.col("o_custkey")), F.lit("@mail.example.com +1 555 010 "), s(1000 + k % 9000)),
            F.when(k % 4 != 0, "Professional Summary:"),
            F.concat(F.lit("Led the team and improved process efficiency, over "), s(k % 12), F.lit(" years. Mentored juniors")),
            F.when(k % 5 != 0, "TECHNICAL SKILLS").when(k % 10 == 0, "Highlights: drills"),
            F.concat(F.col("skill"), F.lit(", Python; sql | SQL, ability to weld, "), F.lower("o_orderpriority")),
            F.when(k % 7 != 0, "Work Experience"),
            F.concat(F.lit("Engineer at Firm "), s(k % 7), F.lit(" "), mm, F.lit("/"), s(y - 3), F.lit(" to "), mm, F.lit("/"), s(y - 1)),
            F.concat(F.lit("Built "), F.col("skill"), F.lit(" lines for a client. Prepared weekly report.")),
            F.when(k % 2 == 0, F.lit("Senior Analyst, Beta Group")),
            F.concat(F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("Analyst - Gamma ")), s(y - 1), F.lit(" - "),
                     F.when(F.col("o_orderstatus") == "O", F.lit("Present")).otherwise(F.concat(F.lit("Summer "), s(y)))),
            F.lit("Planned roadmap with partners."),
            F.when(k % 6 != 0, "Education"),
            F.concat(F.element_at(F.array(*[F.lit(d) for d in DEGREES]), (k % 5 + 1).cast("int")), F.lit(" "), s(y - 8),
                     F.lit(" at Delta University of Trade.")),
        ]
        return self.even(self.application(), "o_orderkey").select(
            k.alias("resume_id"), "candidate_id", F.concat_ws("\n", *lines).alias("text"),
            F.upper(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("priority"), "skill")


DEGREES = ["Bachelor of Arts", "Master of Science", "PhD", "Diploma", "B.Tech and MBA"]


def query_id():
    return F.concat(F.lit("q-"), F.floor(F.col("doc_id") / 25).cast("string"))
