"""Alias hints: only words that begin an alias become grams."""

from pyspark.sql import functions as F

from matchloom.operators import ontology as on


def test_only_words_that_begin_an_alias_become_grams(spark):
    texts = spark.createDataFrame([(1, "C++ and Red  bolt, ring of power; red"), (2, "bolt red"), (3, "+++"), (4, None), (5, "a.net .NET red bolt")], "id long, text string")
    vocab = spark.createDataFrame([("red bolt", "A"), ("ring of power game", "B"), ("ring of power", "C"), ("c++", "D"), ("red", "E"), (".net", "F"), ("+++", "G"), ("bolt, ring", "H")], "alias string, canonical string")
    hints = on.alias_hints(texts, "id", vocab)
    assert {r.id: r.hints for r in hints.collect()} == {1: ["C", "H", "A", "D", "E"], 2: ["E"], 3: ["G"], 5: ["A", "F", "E"]}
    assert "LeftSemi" in hints._jdf.queryExecution().optimizedPlan().toString()  # before: three grams of every word of a text met the vocabulary
