import random

import numpy as np
import pyarrow as pa
import pytest

from matchloom.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"
BAD = ["grobnak", "vilewort", "sludgem"]


def rows_of(n, seed, share=0.2):
    """Documents of invented words; a toxic one has one to three bad stems with any ending."""
    r = random.Random(seed)
    syllables = "ka lo mi tu re sa en do vi pa".split()
    out = []
    for i in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randrange(2, 5))) for _ in range(r.randrange(15, 60))]
        bad = r.random() < share
        for _ in range(r.randrange(1, 4) if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "s", "ish", "er"]))
        out.append((i, " ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def data(spark, table):
    rows = rows_of(900, 1)
    labelled = [(i, None, y) for i, _, y in rows if i % 3 == 0]
    return rows, table([(i, t) for i, t, _ in rows], clash=True), spark.createDataFrame(labelled, LABELS)


def held(i):
    import zlib
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_documents_are_told_apart(data):
    rows, docs, labels = data
    truth = {i: y for i, _, y in rows}
    got = toxicity.score_toxicity(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == 900 and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    wrong = [r for r in got if r.held_out and r.predicted != truth[r.doc_id]]
    assert len([r for r in got if r.held_out]) > 150 and len(wrong) <= 4


def test_labels_of_held_out_rows_are_not_learned(spark, data):
    rows, docs, labels = data
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = ({r.doc_id: r.score for r in toxicity.score_toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_without_labels_0_the_prior_comes_from_unlabelled_text(data):
    rows, docs, labels = data
    model = toxicity.train(docs, labels.where("toxic = 1"))
    assert 0.12 < model.prior < 0.3
    truth = {i: y for i, _, y in rows}
    got = [r for r in toxicity.score(docs, model).collect() if r.held_out]
    assert sum(r.predicted != truth[r.doc_id] for r in got) <= 4


def test_features_and_scores_against_a_plain_loop(data):
    def plain(text):
        data = b" " + text.lower().encode() + b" "
        data = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in data)
        return {data[i : i + n] for n in toxicity.GRAMS for i in range(len(data) - n + 1) if b" " not in data[i + 1 : i + n - 1]}

    def number(g):
        h = 0
        for byte in g:
            h = (h * int(toxicity._FACTOR) + byte + 1) % 2**64
        return int(toxicity.mix(np.array([h], np.uint64))[0] >> np.uint64(64 - toxicity.BITS))

    texts = ["", None, "Abcde", "Groß-artig: ÉTÉ", "a b c", "x" * 40 + " yz", "idiot"]
    got = {i: set() for i in range(len(texts))}
    for t, f in toxicity.grams(pa.array(texts)):
        for a, b in zip(t.tolist(), f.tolist()):
            got[a].add(b)
    assert got == {i: {number(g) for g in plain(t or "")} for i, t in enumerate(texts)}
    features = np.array(sorted({number(g) for g in plain("Groß-artig idiot")}))
    r = np.random.default_rng(0)
    model = toxicity.Classifiers(features, r.random((2, len(features))), np.array([-1.0, -2.0]), 0.1)
    want = [np.mean([1 / (1 + np.exp(-(b + sum(w[features.searchsorted(n)] for n in {number(g) for g in plain(t or "")} & set(features.tolist()))))) 
                     for w, b in zip(model.weights, model.intercepts)]) for t in texts]
    assert model.scores(pa.array(texts)) == pytest.approx(want)


def test_risk_is_corrected_by_the_prior():
    """Half of the unlabelled rows are toxic; plain positive-against-unlabelled learning would call them negative."""
    toxic = np.tile(np.array([[1, 1, 0]], np.uint8), (300, 1))
    unlabelled = np.concatenate([toxic, np.tile(np.array([[0, 1, 1]], np.uint8), (300, 1))])
    w, b = toxicity.fit(toxic, unlabelled, 0.5, 3)
    assert w @ [1, 1, 0] + b > 1 and w @ [0, 1, 1] + b < -1 and (w >= 0).all()


def test_edges(spark, table, data):
    _, docs, labels = data
    none = spark.createDataFrame([], LABELS)
    assert {(r.score, r.predicted) for r in toxicity.score_toxicity(docs, none).collect()} == {(0.0, 0)}
    assert toxicity.score_toxicity(table([]), labels).collect() == []
    model = toxicity.train(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, 1, None)], LABELS)))
    odd = table([(1, None), (2, ""), (3, "- !"), (None, "grobnakish you"), (4, "word " * 100_000 + "vilewort"), (5, "vileworts"), (5, "vileworts")])
    got = sorted((r.doc_id or -1, r.held_out, round(r.score, 9), r.predicted) for r in toxicity.score(odd, model).collect())
    assert [(g[0], g[3]) for g in got] == [(-1, 1), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (5, 1)]
    assert len({g[2] for g in got if g[0] in (1, 2, 3)}) == 1 and got[0][1] is False
