"""Queries that read the hybrid hits in several steps search once, from documents that are made once."""

from matchloom.plans import retrieval as rt
from matchloom.plans.inputs import Inputs

SF = "/root/testdata/sf0.001"


def test_hits_are_read_from_files(spark, monkeypatch):
    """Before, every step that read the hits searched again, and the searches and the merge each made the documents."""
    made = []
    whole = Inputs.application
    monkeypatch.setattr(Inputs, "application", lambda self: made.append(1) or whole(self))
    i = Inputs(spark, SF)
    plan = rt.hits(i)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "Join" not in plan
    assert i.written("candidate_doc") is i.written("candidate_doc")
    assert len(made) == 2  # the jobs and the documents
