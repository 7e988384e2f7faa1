"""Matching reads the relations with the documents, so the wide rows of the pairs are shuffled once per side."""

from matchloom.plans import scoring as ps
from matchloom.plans.inputs import Inputs

SF = "/root/testdata/sf0.001"


def joins_above_the_pairs(df) -> int:
    """Joins of the optimised plan that have the pairs' aggregate (raw_score) below them."""
    def walk(node) -> tuple[int, bool]:
        if node.nodeName() == "Aggregate" and "raw_score" in node.output().mkString(","):
            return 0, True
        below = [walk(node.children().apply(k)) for k in range(node.children().size())]
        has = any(h for _, h in below)
        return sum(n for n, h in below if h) + (has and node.nodeName() == "Join"), has

    joins, seen = walk(df._jdf.queryExecution().optimizedPlan())
    assert seen
    return joins


def test_pairs_meet_each_side_once(spark):
    """Before, the pairs with both documents were joined twice more, to the jobs' and the candidates' relations."""
    assert joins_above_the_pairs(ps.matched(Inputs(spark, SF))) == 2
