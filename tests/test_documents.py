"""Stored documents with nested parts of changing shape."""

import re

from pyspark.sql import functions as F

from matchloom.sources import documents as dc

PLAIN = [("id", "long"), ("kind", "string")]


def test_shapes_of_all_times_are_read_together(spark, tmp_path):
    path = str(tmp_path / "docs")
    first = spark.createDataFrame([(1, "a", "Ann", ["x", "y"]), (2, "b", None, None)], "id long, kind string, name string, skills array<string>")
    dc.write_documents(first, path, {"raw": ["name"], "parsed": ["skills"]}, by="kind")
    second = spark.createDataFrame([(3, "a", "Bo", {"main": "z"}, 2.5)], "id long, kind string, name string, skills map<string,string>, years double")
    dc.write_documents(second, path, {"raw": ["name"], "parsed": ["skills", "years"]}, by="kind")
    got = dc.read_documents(spark, path, PLAIN, {
        "name": ("raw", "name", "string"), "skills": ("parsed", "skills", "array<string>"), "main": ("parsed", "skills.main", "string"),
        "years": ("parsed", "years", "double"), "none": ("parsed", "no.such[3]", "long")})
    assert sorted(map(tuple, got.collect())) == [
        (1, "a", "Ann", ["x", "y"], None, None, None), (2, "b", None, None, None, None, None), (3, "a", "Bo", None, "z", 2.5, None)]


def test_values_come_back_as_they_were(spark, tmp_path):
    row = spark.range(200).select(
        F.col("id"), F.lit("k").alias("kind"), F.concat(F.lit('é "q"\n'), F.col("id").cast("string")).alias("text"), (F.col("id") / 3).alias("x"),
        F.array(F.struct(F.col("id").alias("n"), F.lit(None).cast("string").alias("t"))).alias("items"))
    dc.write_documents(row, str(tmp_path / "d"), {"all": ["text", "x", "items"]})
    back = dc.read_documents(spark, str(tmp_path / "d"), PLAIN, {
        "text": ("all", "text", "string"), "x": ("all", "x", "double"), "items": ("all", "items", "array<struct<n:bigint,t:string>>")})
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, row.collect()))


def test_a_scan_reads_the_wanted_part_and_folder(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = spark.range(10).select("id", F.when(F.col("id") < 5, "a").otherwise("b").alias("kind"), F.lit("long text").alias("text"), F.lit("n").alias("name"), F.lit(1).alias("x"))
    dc.write_documents(rows, path, {"raw": ["text", "name"], "parsed": ["x"]}, by="kind")
    read = dc.read_documents(spark, path, PLAIN, {"name": ("raw", "name", "string")}).where("kind = 'a'")
    plan = read._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: (.*)", plan).group(1)
    assert "parsed" not in schema and re.search(r"PartitionFilters: \[.*kind.*= a", plan)
    assert read.count() == 5
