import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from matchloom.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_vocabulary(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute(n):
    form, out = {}, {}
    for w in n:
        others = sorted((-n[v], v) for v in n if one_edit(w, v))
        good = bool(others) and -others[0][0] >= 2 * n[w]
        form[w] = others[0][1] if good else None
        out[w] = len(others)
    root = {}
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return sorted((w, form[w] or "", root[w], n[w], out[w], n[form[w]] if form[w] else None) for w in n)


def told(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def random_words(r, k, letters="abcdéÀ÷x", longest=9):
    return list({"".join(r.choice(letters) for _ in range(r.randrange(3, longest))) for _ in range(k)})


def test_documents_against_brute_force(spark, table):
    r = random.Random(5)
    stems = ["Straße", "CAFÉTERIA", "receive", "possible", "tomorrow", "Ünique", "separate"]
    docs = []
    for i in range(220):
        words = []
        for _ in range(60):
            w = r.choice(stems)
            at = r.randrange(len(w))
            words.append(r.choice([w, w, w.lower(), w[:at] + w[at + 1:], w[:at] + r.choice("aeé") + w[at:], w[:at] + "x" + w[at + 1:]]))
        docs.append((i if i % 50 else None, " ".join(words).replace("x ", "x-")))
    docs += [(3, docs[3][1]), (900, None), (901, ""), (902, "1 2 中 -")]
    want = brute(brute_vocabulary(docs))
    got = spelling.spelling_variants(table(docs, clash=True), most=40)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and dict(got.dtypes)["n_near"] == "bigint"
    assert told(got) == want and len(want) > 200 and any(w[1] and w[2] != w[1] for w in want)


@pytest.mark.parametrize("most", [3, 50, 4096])
def test_random_words_against_brute_force(spark, most):
    r = random.Random(most)
    n = {w: r.choice([3, 4, 8, 16, 40, 40, 200]) for w in random_words(r, 900)}
    got = spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(5), most=most)
    assert told(got) == brute(n)


def test_leaves_larger_than_a_subtree_are_dealt_in_parts(spark):
    """Anagrams cannot be told apart by counts; here hundreds of them, and their neighbours, meet in parts of at most 7."""
    r = random.Random(1)
    base = list("abcdefgh")
    words = set()
    while len(words) < 300:
        r.shuffle(base)
        words.add("".join(base))
    words |= {w[:3] + "z" + w[4:] for w in list(words)[:120]} | {w[:5] + w[6:] for w in list(words)[:120]}
    n = {w: 3 + zlib.crc32(w.encode()) % 50 for w in words}
    got = spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long"), most=7)
    assert told(got) == brute(n)


def test_chains_end_at_their_root(spark):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbbb", "bbbbbbb", "bbbbbbbc"]
    n = {w: 3 * 2**i for i, w in enumerate(words)}
    got = {r.word: r.root for r in spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"bbbbbbbc"}


def test_search_reaches_every_near_word_and_compares_right():
    r = random.Random(9)
    words = sorted(random_words(r, 1500, "abcdefé", 8))
    own = spelling.Words.of(words, np.arange(len(words)))
    total = Counter()
    for b in spelling.Subtree(own).visit(own):
        for row in b.to_pylist():
            total[row["word"]] += row["n_near"]
    assert total and dict(total) == {w: k for w in words if (k := sum(one_edit(w, v) for v in words))}


def test_edges(table):
    empty = spelling.spelling_variants(table([]))
    assert empty.collect() == [] and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.spelling_variants(table([(1, None), (2, ""), (None, "ab cd")])).collect() == []
    long = "q" * 30_000
    docs = [(1, f"{long} {long} {long} {long[1:]} {long[1:]} {long[1:]} {'z' * 20_000}")] * 2 + [(2, "word " * 100_000)]
    assert told(spelling.spelling_variants(table(docs))) == brute(brute_vocabulary(docs))
