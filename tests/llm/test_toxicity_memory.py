"""A task holds the arrays of one small piece of text at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from matchloom.llm import toxicity
from matchloom.llm.wordhash import slices


def test_arrays_of_a_piece_are_small():
    """Before, pieces of 1 MB took 58 MB here."""
    batch = pa.RecordBatch.from_arrays([pa.array(["plain words of some length here " * 64] * 1024)], names=["text"])
    model = toxicity.Classifiers(np.arange(1024), np.ones((5, 1024)), np.zeros(5), 0.1)
    tracemalloc.start()
    scores = np.concatenate([model.scores(part.column("text")) for part in slices(batch, "text", toxicity.PIECE)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) == 1024 and len(set(scores)) == 1
    assert peak < 40 << 20
