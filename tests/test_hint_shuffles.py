"""Alias hints: a vocabulary that is small when made, though its source is large, meets the texts without a shuffle of their grams."""

from pyspark.sql import functions as F

from matchloom.operators import ontology as on


def test_grams_are_not_shuffled(spark):
    texts = spark.createDataFrame([(1, "Red bolt, old ring; red bolt"), (2, "a ring-bolt"), (3, "none")], "id long, text string")
    names = spark.range(3_000_000).select((F.col("id") % 3).alias("k")).distinct()
    word = F.element_at(F.array(F.lit("red bolt"), F.lit("ring"), F.lit("c++")), (F.col("k") + 1).cast("int"))
    vocab = names.select(word.alias("alias"), F.upper(word).alias("canonical"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        hints = on.alias_hints(texts, "id", vocab)
        plan = hints._jdf.queryExecution().sparkPlan().toString()
        assert not [line for line in plan.splitlines() if "SortMergeJoin [g#" in line or "ShuffledHashJoin [g#" in line]
        assert {r.id: r.hints for r in hints.collect()} == {1: ["RED BOLT", "RING"], 2: ["RING"]}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
