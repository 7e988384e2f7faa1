"""The operators applied to whole tables: name -> query, name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import (
    decontamination, exact_dedup, importance, language, licenses, mixing, ngram_join, pii, quality, sharding, spelling, token_counts, toxicity)
from matchloom.session import shared_dir, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: (ship(spark), fn(spark, sf_dir))[1]
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_quality")
def op1(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_pii")
def op2(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query("op3_exact_dedup", exact_dedup.ORACLE)
def op3(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


@query("op4_decontamination")
def op4(spark, sf_dir):
    return decontamination.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_licenses", licenses.oracle())
def op5(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op5_license_notices")
def op5_notices(spark, sf_dir):
    """Licences by any usual notice, wherever it stands; ``op5_licenses`` is the scan by whole lines that its SQL describes."""
    return licenses.scan_notices(table(spark, sf_dir, "documents"))


@query("op6_language")
def op6(spark, sf_dir):
    return language.fit_and_identify(table(spark, sf_dir, "documents"))


@query("op7_ngram_jaccard_join")
def op7(spark, sf_dir):
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


@query("op8_sharding")
def op8(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_token_counts", token_counts.ORACLE)
def op9(spark, sf_dir):
    """All documents under two tokenizers, the second batch committed twice, then the toxic documents deleted.

    Rows without id count, as nothing can delete them; the SQL's NOT IN leaves them out.
    """
    docs, rollup = table(spark, sf_dir, "documents"), token_counts.TokenRollup(spark, shared_dir(spark, "token-rollup"))
    rollup.commit(0, token_counts.count_tokens(docs, "words-1"), repeated=True)
    for _ in range(2):
        rollup.commit(1, token_counts.count_tokens(docs, "pieces-1"), repeated=True)
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    gone = rollup.state().join(toxic, "doc_id", "left_semi").withColumn("tokens", F.lit(None).cast("long"))
    rollup.commit(2, gone.select("doc_id", "source", "lang", "tokenizer", "tokens"), repeated=True)
    return rollup.totals()


@query("op10_mixing", mixing.oracle())
def op10(spark, sf_dir):
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"))
    time = lambda i: F.get("positions", F.lit(i))
    return plan.select("doc_id", "size", "source_size", "target", "taken", time(0).alias("position"), time(1).alias("position_again")).orderBy(
        F.asc_nulls_last("position"), "doc_id")


@query("op11_spelling_variants")
def op11(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_importance_resampling")
def op12(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_toxicity")
def op13(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
