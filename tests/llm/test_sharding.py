import random
from collections import defaultdict

import pytest

from matchloom.llm.sharding import minimax_cuts, shard_documents


def brute(docs, k):
    """Shard of every group by trying capacities one by one."""
    group = defaultdict(list)
    for i, t in docs:
        group[t or ""].append(i)
    order = sorted(group, key=lambda t: (min((i for i in group[t] if i is not None), default=10**9)))
    size = [(len(t.encode()) + 1) * len(group[t]) for t in order]

    def cut(capacity):
        out, room, shard = [], capacity, 0
        for s in size:
            if s > room:
                room, shard = capacity, shard + 1
            room -= s
            out.append(shard)
        return out
    capacity = max(size)
    while cut(capacity)[-1] >= k:
        capacity += 1
    return {t: s for t, s in zip(order, cut(capacity))}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(table, seed):
    r = random.Random(seed)
    texts = ["ä" * r.randrange(1, 60) + str(j) for j in range(60)] + [None, ""]
    docs = [(i, r.choice(texts)) for i in range(150)] + [(900 + i, texts[3]) for i in range(seed * 40)]
    want = brute(docs, 5)
    got = shard_documents(table(docs, clash=True), 5, ranges=4).collect()
    text = dict(docs)
    assert len(got) == len(docs) and all(g.shard == want[text[g.doc_id] or ""] for g in got)
    slots = defaultdict(list)
    for g in got:
        slots[g.shard].append(g.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_search_reads_finer_until_exact(spark):
    r = random.Random(5)
    ends, at = [], 0
    for i in range(700):
        at += r.randrange(1, 400)
        ends.append((at, i + 1))
    df = spark.createDataFrame(ends, "bytes long, rows long")
    largest = max(b - a for (a, _), (b, _) in zip([(0, 0), *ends], ends))
    assert minimax_cuts(df, at, largest, 6, buckets=96) == minimax_cuts(df, at, largest, 6, buckets=100_000)


def test_edges(table):
    assert shard_documents(table([]), 8).collect() == []
    one = shard_documents(table([(None, None), (1, None), (1, None), (2, "")]), 3).collect()
    assert {r.shard for r in one} == {0} and sorted(r.slot for r in one) == [0, 1, 2, 3] and {r.size for r in one} == {1}
    single = shard_documents(table([(i, "t" * i) for i in range(9)]), 1).collect()
    assert sorted(r.slot for r in single) == list(range(9))
