import random
from collections import Counter

import pytest

from matchloom.llm.token_counts import TokenRollup, count_tokens

from .conftest import rows

SCHEMA = "doc_id long, source string, lang string, tokenizer string, tokens long"


def totals(rollup):
    return rows(rollup.totals(), "source", "lang", "tokenizer", "documents", "tokens")


def test_against_a_recount(spark, tmp_path):
    r, truth = random.Random(1), {}
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    for batch in range(4):
        changes = {(r.randrange(30), r.choice(["t1", "t2"])): (r.choice(["a", "b", None]), r.choice(["en", None]), r.choice([None, 0, 5, 9])) for _ in range(25)}
        df = spark.createDataFrame([(d, s, lang, t, n) for (d, t), (s, lang, n) in changes.items()], SCHEMA)
        rollup.commit(batch, df)
        for k, v in changes.items():
            truth.pop(k, None)
            if v[2] is not None:
                truth[k] = v
        if batch == 2:
            before = totals(rollup)
            rollup.commit(batch, df)  # again: nothing changes
            assert totals(rollup) == before
    docs, tokens = Counter(), Counter()
    for (_, t), (s, lang, n) in truth.items():
        docs[s, lang, t] += 1
        tokens[s, lang, t] += n
    want = sorted(((*k, docs[k], tokens[k]) for k in docs), key=lambda t: tuple((x is None, x) for x in t))
    assert totals(rollup) == want


def test_edges(table, spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    assert rollup.totals().collect() == [] and rollup.state().collect() == []
    rollup.commit(0, count_tokens(table([]), "words-1"))
    docs = table([(1, None), (2, ""), (3, "a b " * 100_000, None, None), (4, "é, 12"), (4, "é, 12")], clash=True)
    rollup.commit(1, count_tokens(docs, "words-1"))
    rollup.commit(2, count_tokens(docs, "pieces-1"))
    assert totals(rollup) == [("s", "en", "pieces-1", 3, 4), ("s", "en", "words-1", 3, 2), (None, None, "pieces-1", 1, 200_000), (None, None, "words-1", 1, 200_000)]
    rollup.commit(3, spark.createDataFrame([(77, "s", "en", "words-1", None)], SCHEMA))
    assert len(totals(rollup)) == 4
    with pytest.raises(Exception, match="without doc_id"):
        rollup.commit(4, spark.createDataFrame([(None, "s", "en", "words-1", 3)], SCHEMA))
