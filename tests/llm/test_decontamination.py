import itertools
import random

import pytest

from matchloom.llm.decontamination import AGREE, MASKS, WINDOW, Index, contaminated_pairs, decontaminate

from .conftest import rows


def test_masks_leave_no_gap():
    for gone in itertools.combinations(range(WINDOW), WINDOW - AGREE):
        assert any(not {at + p for p in mask} & set(gone) for mask in MASKS for at in range(WINDOW - mask[-1]))


def brute(docs, items):
    out = {}
    for d, t in docs:
        for i, b in items:
            x, y = (t or "").lower().split(), (b or "").lower().split()
            w = min(WINDOW, len(y))
            need = AGREE if len(y) >= WINDOW else w
            best = max(((sum(p == q for p, q in zip(x[a : a + w], y[c : c + w])), -a) for a in range(len(x) - w + 1) for c in range(len(y) - w + 1)),
                       default=(0, 0)) if len(y) >= 8 else (0, 0)
            if best[0] and best[0] >= need:
                out[d, i] = best
    return sorted((d, i, -a, n) for (d, i), (n, a) in out.items())


@pytest.mark.parametrize("block_words", [1 << 18, 60])
def test_against_every_window(table, words, spark, block_words):
    r = random.Random(3)
    items = [(i, " ".join(words(n, i, 60))) for i, n in enumerate([3, 7, 8, 10, 12, 13, 14, 20, 35, 60, 60])]
    docs = []
    for d in range(120):
        w = words(r.randrange(0, 60), 500 + d, 60)
        take = items[d % len(items)][1].split()
        start = r.randrange(0, max(1, len(take) - 12))
        take = [x if r.random() > 0.12 else f"sub{r.randrange(9)}" for x in take[start : start + r.randrange(8, 30)]]
        at = r.randrange(len(w) + 1)
        docs.append((d, " ".join(w[:at] + take + w[at:])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(contaminated_pairs(table(docs, clash=True), bench, block_words), "doc_id", "item_id", "first_word", "agreeing")
    want = brute(docs, items)
    assert len(want) > 40 and got == want
    kept = rows(decontaminate(table(docs, clash=True), bench, block_words), "doc_id")
    assert kept == [(d,) for d, _ in docs if d not in {g[0] for g in got}]


def test_case_marks_and_very_long_texts(table, words, spark):
    item = "L'été où je fus né, à l'âge d'un an: ÉCOLE de la forêt près du lac bleu"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, " ".join(words(20, 4)))], "item_id long, text string")
    docs = table([(1, "x " * 150_000 + item.upper().replace(" ", "!!\n") + " y" * 150_000), (2, None), (3, ""), (None, item), (4, "a b c"), (5, " ".join(words(20, 4)))])
    got = rows(contaminated_pairs(docs, bench), "doc_id", "item_id")
    assert got == [(1, 1), (5, None), (None, 1)]
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns and rows(clean, "doc_id") == [(2,), (3,), (4,)]


def test_empty_and_repeated(table, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    item = " ".join(f"v{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item), (1, item), (2, item)], "item_id long, text string")
    docs = table([(1, item), (1, item)])
    assert contaminated_pairs(docs, none).collect() == [] and decontaminate(docs, none).count() == 2
    assert contaminated_pairs(table([]), bench).collect() == []
    assert rows(contaminated_pairs(docs, bench), "doc_id", "item_id") == [(1, 1), (1, 2)]


def test_repetitive_texts_against_every_window(table, spark):
    r = random.Random(5)

    def dull(n, kinds):
        return " ".join(r.choice(["la", "na", "hey", "oh"][:kinds]) for _ in range(n))

    items = [(1, dull(40, 1)), (2, dull(30, 2)), (3, "one two three four " * 8), (4, "one two three four " * 8), (5, "la " * 12 + "stop")]
    docs = [(k, f"{dull(k % 3 * 9, 2)} mid {'one two tree four ' * (k % 7)} {dull(k * 2, k % 3 + 1)}") for k in range(40)]
    got = rows(contaminated_pairs(table(docs), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id", "first_word", "agreeing")
    want = brute(docs, items)
    assert len(want) > 40 and got == want


def test_one_word_texts_cost_no_product():
    import time

    import pyarrow as pa

    index = Index.build([1, 2], ["ha " * 20_000, "so it goes " * 7_000])
    start = time.time()
    t, i, first, best = index.matches(pa.array(["ha " * 20_000, "x " + "so it goes " * 7_000]))
    assert list(zip(t, i, first, best)) == [(0, 0, 0, 13), (1, 1, 1, 13)] and time.time() - start < 2


def test_many_pairs_are_compared_in_parts(monkeypatch, words):
    import pyarrow as pa

    from matchloom.llm import decontamination as dm

    items = [" ".join(words(40, k, 5)) for k in range(6)]
    texts = [" ".join(words(9, 50 + k, 5) + items[k % 6].split()[k : k + 25] + ["and"] + items[k // 2].split()[k + 2 : k + 20]) for k in range(9)]
    whole = [x.tolist() for x in Index.build(range(6), items).matches(pa.array(texts))]
    monkeypatch.setattr(dm, "_PAIRS", 7)
    assert [x.tolist() for x in Index.build(range(6), items).matches(pa.array(texts))] == whole and whole[0]
    assert sorted((t, i, a, n) for t, i, a, n in zip(*whole)) == brute(list(enumerate(texts)), list(enumerate(items)))


def test_copies_in_the_benchmark_are_looked_for_once(table, spark):
    item = " ".join(f"v{k}" for k in range(20))
    bench = spark.createDataFrame([(k, item) for k in range(300)] + [(None, item), (7, "other words " * 10)], "item_id long, text string")
    got = contaminated_pairs(table([(1, item), (2, "v1 v2")]), bench, 50)
    assert got.count() == 301 and got.where("item_id IS NULL").count() == 1
