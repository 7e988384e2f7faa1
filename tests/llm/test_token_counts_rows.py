from matchloom.llm.queries import QUERIES
from matchloom.llm.token_counts import TokenRollup, count_tokens

from .conftest import rows
from .test_token_counts import SCHEMA, totals

DOCS = [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (1, "c", "de", "t"), (2, "d", "en", "s"), (None, "e f g", "en", "s"), (None, "h", None, None), (None, "h", None, None)]


def test_rows_with_repeated_and_null_ids(table, spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    for _ in range(2):
        rollup.commit(0, count_tokens(table(DOCS), "words-1"), repeated=True)
    assert totals(rollup) == [("s", "en", "words-1", 4, 8), ("t", "de", "words-1", 1, 1), (None, None, "words-1", 2, 2)]
    revised = spark.createDataFrame([(1, "t", "de", "words-1", 5), (1, "t", "de", "words-1", 7), (2, "s", "en", "words-1", None), (None, None, None, "words-1", 10), (None, "s", "en", "words-1", None)], SCHEMA)
    for _ in range(2):
        rollup.commit(1, revised, repeated=True)
    assert totals(rollup) == [("s", "en", "words-1", 1, 3), ("t", "de", "words-1", 2, 12), (None, None, "words-1", 3, 12)]
    rollup.commit(2, spark.createDataFrame([(1, None, None, "words-1", None)], SCHEMA), repeated=True)
    assert totals(rollup) == [("s", "en", "words-1", 1, 3), (None, None, "words-1", 3, 12)]


def test_query_counts_every_row(table, spark, tmp_path):
    table(DOCS + [(3, "toxic words", "en", "s"), (3, "toxic", "de", "t")]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1), (2, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = [r for r in rows(QUERIES["op9_token_counts"](spark, str(tmp_path)), "source", "lang", "tokenizer", "documents", "tokens") if r[2] == "words-1"]
    assert got == [("s", "en", "words-1", 4, 8), ("t", "de", "words-1", 1, 1), (None, None, "words-1", 2, 2)]
