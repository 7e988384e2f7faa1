import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from matchloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, [*w, *[f"{a} {b}" for a, b in zip(w, w[1:])]]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def brute(docs, target):
    """What the contract says, row by row."""
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    rows, may = [], []
    for i, text in docs:
        words, fs = features(text)
        g = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in map(bucket, fs)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words) >= 20:
            may.append(rows[-1])
    may.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: 25 * len(may) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows), key=str)


def told(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in df.dtypes} == {"bigint"}
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def benchmark(spark):
    r = random.Random(2)
    texts = [" ".join(f"b{r.randrange(300)}" for _ in range(40)) for _ in range(30)] + [None, ""]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_documents_against_brute_force(table, benchmark):
    r = random.Random(7)
    docs = []
    for i in range(700):
        n = r.choice([0, 1, 2, 19, 20, 21, 60])
        docs.append((i * 37 % 701 - 200, r.choice([" ", "-", "\n"]).join(r.choice(["Ab1", "ÉTÉ", "中文", "b7", "B12", f"w{r.randrange(90)}"]) for _ in range(n))))
    docs += [(None, "x " * 30), (None, None), (5000, None), (5001, ""), (5002, "- . !"), (2**62, "big " * 40), (-(2**62), "small " * 40)]
    docs += [(6000 + i, "b1 b2 b3 " * 9) for i in range(5)] + [(docs[11][0], docs[11][1])]
    assert told(importance.resample(table(docs, clash=True), benchmark[1])) == brute(docs, benchmark[0])


def test_buckets_of_runs_are_crc32():
    texts = ["", None, "a", "Ab cd  ef", "É" * 300 + " " + "z" * 500, "\x00A\x7f9", "x " * 50]
    got, text, words = importance.run_buckets(pa.array(texts))
    want = [(i, bucket(f)) for i, t in enumerate(texts) for f in features(t)[1]]
    assert sorted(zip(text.tolist(), got.tolist())) == sorted(want)
    assert words.tolist() == [len(features(t)[0]) for t in texts]


@pytest.mark.parametrize("digit", [3, 11])
def test_radix_sort_is_a_sort(spark, digit):
    r = random.Random(digit)
    rows = [(r.choice([0, 1, 5, -(2**63), 2**63 - 1, r.randrange(-900, 900)]), r.choice([4, 4, 4, r.randrange(50)]), k) for k in range(800)]
    got = importance.radix_ranked(spark.createDataFrame(rows, "a long, b long, k long").repartition(6), [("b", True), ("a", False), ("k", False)],
                                  digit, least_block=64)
    want = sorted(rows, key=lambda t: (-t[1], t[0], t[2]))
    assert [tuple(x)[:3] for x in sorted(got.collect(), key=lambda x: x["place"])] == want
    assert sorted(x["place"] for x in got.collect()) == list(range(800))


def test_equal_keys_are_placed_without_gaps_in_bounded_groups(spark):
    rows = spark.range(5000).selectExpr("1L AS a").repartition(7)
    assert sorted(r["place"] for r in importance.radix_ranked(rows, [("a", True)]).collect()) == list(range(5000))


def test_edges(table, benchmark, spark):
    assert told(importance.resample(table([]), benchmark[1])) == []
    none = spark.createDataFrame([], "item_id long, text string")
    docs = [(i, f"w{i % 7} " * 25) for i in range(40)] + [(90, "long word " * 100_000)]
    assert told(importance.resample(table(docs), none)) == brute(docs, [])
