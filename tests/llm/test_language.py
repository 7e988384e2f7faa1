import random

import numpy as np
import pyarrow as pa
import pytest

from matchloom.llm import language

SYLLABLES = {"aa": "ka lo mi tu re sa".split(), "bb": "sch ung eit zer ach ölk".split(), "cc": "eau oix ère ien que çon".split()}


def text(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(table):
    return language.train(table([(i, text(k, 60, i), k) for i, k in enumerate(list(SYLLABLES) * 40)]))


def test_held_out_accuracy(table, model):
    docs = table([(1000 + i, text(k, 12, 1000 + i), k) for i, k in enumerate(list(SYLLABLES) * 30)], clash=True)
    want = {r.doc_id: r.lang for r in docs.collect()}
    got = language.identify_language(docs, model).collect()
    assert len(got) == 90 and all(r.lang_pred == want[r.doc_id] and 0 <= r.score <= 1 for r in got)


def test_mixtures_are_found_and_estimated(table, model):
    docs = table([(1, text("aa", 150, 1) + " " + text("bb", 50, 2)), (2, text("aa", 60, 3) + text("bb", 60, 4) + text("cc", 80, 5)), (3, text("cc", 200, 6))])
    got = {r.doc_id: r for r in language.identify_language(docs, model).collect()}
    shares = {i: {p.split(":")[0]: float(p.split(":")[1]) for p in r.languages.split(",")} for i, r in got.items()}
    assert shares[1]["aa"] == pytest.approx(0.75, abs=0.05) and set(shares[1]) == {"aa", "bb"}
    assert set(shares[2]) == {"aa", "bb", "cc"} and got[2].lang_pred == "cc"
    assert shares[3] == {"cc": 1.0}


def test_expectation_maximisation_against_a_plain_loop(model):
    texts = pa.array([text("aa", 40, 7) + " " + text("cc", 25, 8)])
    bucket, first, begin = language._trigrams(texts)
    ll = np.add.reduceat(model.logp[bucket], first, axis=0, dtype=np.float64)
    p = np.exp(ll - ll.max(1, keepdims=True))
    theta = np.array([0.5, 0.0, 0.5])
    for _ in range(language.ROUNDS):
        r = p * theta
        theta = (r / r.sum(1, keepdims=True)).mean(0)
    got, _ = language._mixture(p, begin, np.array([0]), np.array([[True, False, True]]))
    assert got[0] == pytest.approx(theta, abs=5e-3)


def test_edges(table, model):
    docs = table([(1, None), (2, ""), (3, "12 34 -- !"), (None, text("bb", 30, 1)), (4, "語 " * 100_000), (5, text("aa", 9, 2)), (5, text("aa", 9, 2))])
    got = sorted(((r.doc_id or -1, r.lang_pred, r.held_out) for r in language.identify_language(docs, model).collect()))
    assert [g[:2] for g in got if g[0] != 4] == [(-1, "bb"), (1, "und"), (2, "und"), (3, "und"), (5, "aa"), (5, "aa")] and got[0][2] is False
    assert language.identify_language(table([]), model).collect() == []
    blind = language.fit_and_identify(table([(1, "abc", None), (2, None, "en")])).collect()
    assert {(r.lang_pred, r.score) for r in blind} == {("und", 0.0)}
    assert language.fit_and_identify(table([])).collect() == []


def test_one_language_only(table):
    got = language.fit_and_identify(table([(i, text("aa", 20, i), "aa") for i in range(12)])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("aa", 1.0)}
