"""JSON-lines sources with validation, and the JSON-lines sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = (
    "query_id string, job_description string, expected_role string, expected_skills array<string>, expected_optional_skills array<string>, "
    "expected_seniority string, job_family string, soft_golden boolean, relevant_candidates array<struct<candidate_id:string,grade:int,reason:string>>, _corrupt string"
)
REQUIRED = ["query_id", "job_description", "expected_role", "expected_skills", "expected_optional_skills", "expected_seniority", "relevant_candidates"]
TRUE_WORDS = ["1", "true", "yes", "relevant"]


def golden_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every non-blank, non-soft line with its parsed row and the reason it is unusable (null when fine)."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(F.trim("value") != "")
    d = lines.withColumn("row", F.from_json("value", GOLDEN, {"columnNameOfCorruptRecord": "_corrupt"}))
    d = d.where(~F.coalesce("row.soft_golden", F.lit(False)))
    present = F.json_object_keys("value")
    missing = F.array_except(F.array(*[F.lit(r) for r in REQUIRED]), present)
    reason = (
        F.when(F.col("row").isNull() | F.col("row._corrupt").isNotNull() | present.isNull(), "malformed")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(missing), ",")))
        .when(F.coalesce(F.size("row.relevant_candidates"), F.lit(0)) <= 0, "invalid relevant_candidates"))
    return d.select("line", "value", "row", reason.alias("reason"))


def read_golden(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Golden queries; in strict mode the first unusable line fails the job."""
    d = golden_rows(spark, path)
    if strict:
        bad = F.raise_error(F.concat(F.lit("golden set: "), F.col("reason"), F.lit(" in "), F.col("value")))
        d = d.where(F.when(F.col("reason").isNotNull(), bad.cast("boolean")).otherwise(True))
    return d.where("reason is null").select("line", "row.*").drop("_corrupt", "soft_golden")


def read_binary_reference(spark: SparkSession, path: str, field: str, keys: list[str]) -> DataFrame:
    """(keys, value): booleans, numbers (non-zero integer part) or words; the last line of a key wins; malformed lines are skipped."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parsed = lines.select("line", *[F.trim(F.get_json_object("value", f"$.{k}")).alias(k) for k in keys],
                          F.get_json_object("value", f"$.{field}").alias("v"), F.col("value").rlike(rf'"{field}"\s*:\s*"').alias("is_text"))
    num = F.col("v").try_cast("double")
    value = (
        F.when(F.col("is_text"), F.lower(F.trim("v")).isin(TRUE_WORDS)).when(F.col("v").isin("true", "false"), F.col("v") == "true")
        .when(num.isNotNull(), F.floor(F.abs(num)) != 0))
    ok = parsed.withColumn("value", value).where("value is not null")
    for k in keys:
        ok = ok.where(F.coalesce(F.col(k), F.lit("")) != "")
    return ok.groupBy(*keys).agg(F.max_by("value", "line").alias("value"))


def read_float_reference(spark: SparkSession, path: str, json_path: str, keys: list[str]) -> DataFrame:
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parsed = lines.select("line", *[F.trim(F.get_json_object("value", f"$.{k}")).alias(k) for k in keys],
                          F.round(F.get_json_object("value", f"$.{json_path}").try_cast("double"), 4).alias("value")).where("value is not null")
    for k in keys:
        parsed = parsed.where(F.coalesce(F.col(k), F.lit("")) != "")
    return parsed.groupBy(*keys).agg(F.max_by("value", "line").alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
