import random

import pytest

from matchloom.llm import quality

from .conftest import rows


def doc(i):
    """Plain prose if i is even, else one of three kinds of junk."""
    r = random.Random(i)
    w = [f"{'abcdefgh'[r.randrange(8)]}{'xyz'[r.randrange(3)] * r.randrange(1, 5)}" for _ in range(60)]
    if i % 2 == 0:
        return " ".join(w) + "."
    return [" ".join(x + "***" for x in w), (w[0] + " ") * 60, " ".join(w).upper() + "!!"][i // 2 % 3]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_sparsity(table, labels):
    docs = table([(i, doc(i)) for i in range(400)], clash=True)
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 400 and all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out or r.doc_id >= 300]
    assert sum(r.predicted == (r.doc_id % 2 == 0) for r in held) / len(held) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and rows(kept, "doc_id") == [(r.doc_id,) for r in sorted(got) if r.predicted]
    model = quality.train(quality.labelled(quality.statistics(docs), labels).cache())
    assert 0 < len(model.weights) < 60


def test_compiled_rules_against_a_plain_loop(table):
    model = quality.RuleEnsemble(0.3, [((("log_words", ">", 1.0), ("repeated_words", "<=", 0.5)), 1.25), ((("capital_share", ">", 0.2),), -2.0)])
    stats = quality.statistics(table([(i, doc(i)) for i in range(30)]))
    import math
    for r in stats.withColumn("score", model.score()).collect():
        z = 0.3 + (1.25 if r.log_words > 1.0 and r.repeated_words <= 0.5 else 0) + (-2.0 if r.capital_share > 0.2 else 0)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)))


def test_statistics(table):
    got = {r.doc_id: r for r in quality.statistics(table([(1, "A a a. B!!\nB"), (2, None), (3, ""), (4, "x " * 200_000)])).collect()}
    one = got[1]
    assert (one.repeated_words, one.distinct_words, one.distinct_lines, one.line_words) == (pytest.approx(0.0), 1.0, 1.0, 2.5) or one.distinct_words == pytest.approx(1.0)
    assert got[2][1:] == got[3][1:] and set(got[2][1:]) == {0.0} | {got[2].distinct_lines}
    assert got[4].repeated_words == pytest.approx(1, abs=1e-4)


def test_edges(table, spark, labels):
    none = spark.createDataFrame([], labels.schema)
    assert quality.score_quality(table([]), labels).collect() == []
    assert {round(r.score, 3) for r in quality.score_quality(table([(1, "a"), (None, None)]), none).collect()} == {0.5}
    only = spark.createDataFrame([(i, 1, 0) for i in range(9)], labels.schema)
    assert all(r.predicted == 1 for r in quality.score_quality(table([(i, "t") for i in range(9)]), only).collect())
    votes = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (3, 1, None)], labels.schema)
    docs = quality.statistics(table([(i, "a b") for i in (1, 2, 3, 5)] + [(None, "a"), (3, "a b")]))
    told = [(r.doc_id, r.label) for r in quality.labelled(docs, votes).collect()]
    assert sorted(told) == sorted((i, float(i == 3)) for i in (1, 3, 3) if not held(i))


def held(i):
    import zlib
    return zlib.crc32(str(i).encode()) % 3 == 1
