from collections import defaultdict

import pytest

from matchloom.llm.common import word_count
from matchloom.llm.mixing import SCHEDULES, invert_schedule, mix, mixing_plan
from pyspark.sql import functions as F


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and cap * sizes[s] < left * weight[s] / w - 1e-9}
        if not more:
            return {s: cap * sizes[s] if s in full else left * weight[s] / w for s in names}
        full |= more


def test_targets_and_taken(table):
    docs = [(i, "w " * (i % 7 + 1), "en", ["b", "a", "c", None, "é"][i % 5 if i % 3 else 0]) for i in range(400)]
    plan = mixing_plan(table(docs, clash=True)).collect()
    assert len(plan) == len(docs)
    sizes, taken = defaultdict(int), defaultdict(int)
    for p in plan:
        sizes[p.source] += p.size
        taken[p.source] += p.taken
        assert p.size == p.doc_id % 7 + 1 and p.taken <= 2 * p.size and list(p.positions) == sorted(p.positions)
    want = targets(sizes)
    for p in plan:
        assert p.target == pytest.approx(want[p.source]) and p.source_size == sizes[p.source]
    assert all(abs(taken[s] - want[s]) <= 8 for s in sizes)
    assert sorted(map(str, plan)) == sorted(map(str, mixing_plan(table(docs, parts=7)).collect()))


def test_order_of_the_mix(table):
    docs = table([(i, "w " * (i % 5), "en", f"s{i % 3}") for i in range(90)], clash=True)
    order = mix(docs)
    assert order.columns == docs.columns
    got = [r.doc_id for r in order.collect()]
    plan = {r.doc_id: r.positions for r in mixing_plan(docs).collect()}
    assert sorted(got) == sorted(i for i, p in plan.items() for _ in p)
    assert [t for t, _ in sorted((t, i) for i, p in plan.items() for t in p)] == sorted(t for p in plan.values() for t in p)
    assert got == [i for _, i in sorted((t, i) for i, p in plan.items() for t in p)]


@pytest.mark.parametrize("knots", SCHEDULES)
def test_inverse(spark, knots):
    def area(t):
        total = 0.0
        for (a, u), (b, v) in zip(knots, knots[1:]):
            if t > a:
                x = min(t, b)
                at = u + (v - u) * (x - a) / (b - a)
                total += (x - a) * (u + at) / 2
        return total
    for r in spark.range(0, 41).select((F.col("id") / 40).alias("x"), invert_schedule(F.col("id") / 40, knots).alias("t")).collect():
        assert area(r.t) / area(1.0) == pytest.approx(r.x, abs=1e-9)


def test_edges(table, spark):
    assert mixing_plan(table([])).collect() == [] and mix(table([])).collect() == []
    empty = mixing_plan(table([(1, None), (2, ""), (None, " \n")])).collect()
    assert {(p.size, p.target, p.taken) for p in empty} == {(0, 0.0, 0)}
    again = mixing_plan(table([(1, "a b"), (1, "a b"), (1, "a b c"), (None, "d")])).collect()
    assert len(again) == 4 and sum(p.size for p in again) == 8
    assert spark.range(1).select(word_count(F.lit(" a\tb c \n d "))).first()[0] == 3
