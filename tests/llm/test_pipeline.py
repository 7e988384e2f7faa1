"""The stages over the smallest tables, each held against a plain version of its decision."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from matchloom.llm import decontamination, mixing, quality
from matchloom.session import materialize

from .test_ngram_join import brute as links
from .test_sharding import brute as shards

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out.append(docs)
        docs = materialize(stage(spark, docs, SF), "test-stage")
    return [*out, docs]


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_names(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1]) and len(cp.STAGES) == 5


def test_quality(spark, steps):
    scored = quality.score_quality(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert ids(steps[1]) == Counter(r.doc_id for r in scored if r.predicted)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in label.items() if q == 1]
    assert sum(i in ids(steps[1]) for i in good) >= 0.95 * len(good)


def test_near_duplicates(steps):
    want = links([(r.doc_id, r.text) for r in steps[1].collect()])
    assert ids(steps[2]) == Counter(i for i, (_, component, _) in want.items() if i == component)


def test_decontamination(spark, steps):
    hit = {r.doc_id for r in decontamination.contaminated_pairs(steps[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids(steps[3]) == Counter(i for i in ids(steps[2]) if i not in hit)
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        assert not any(item.text.lower() in r.text.lower() for r in steps[3].collect())


def test_mixing(steps):
    assert ids(steps[4]) == Counter({r.doc_id: r.copies for r in mixing.mixing_plan(steps[3]).collect() if r.copies})


def test_sharding(spark, steps):
    docs = [(r.doc_id, r.text) for r in steps[4].collect()]
    want, text = shards(docs, cp.SHARDS), dict(docs)
    assert all(r.shard == want[text[r.doc_id]] for r in steps[5].collect()) and steps[5].count() == len(docs)


def test_run(spark, steps):
    assert sorted(map(str, cp.run(spark, SF).collect())) == sorted(map(str, steps[5].collect()))
