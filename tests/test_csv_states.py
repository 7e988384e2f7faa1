"""Lines of CSV files are told apart as they are read: counts run on over batches and start anew with each split."""

import pyarrow as pa

from matchloom.sources import csv as cs

LINES = [("f", 0, 0, False), ("f", 0, 1, False), ("f", 0, 0, True), ("f", 0, 1, False), ("f", 0, 0, False), ("f", 9, 1, False), ("f", 9, 0, False), ("g", 0, 2, False)]
WANT = [(False, 1, 0), (False, 2, 0), (True, 2, 0), (True, 2, 1), (False, 3, 1), (False, 1, 0), (True, 1, 1), (False, 1, 0)]


def batch(rows):
    names = ["file", "block", "quotes", "blank"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.bool_()))], names=names)


def test_states_do_not_depend_on_batches():
    for n in (1, 2, 3, 8):
        out = cs._states(iter([batch(LINES[j:j + n]) for j in range(0, len(LINES), n)]))
        assert [(r["odd"], r["n0"], r["n1"]) for b in out for r in b.to_pylist()] == WANT


def test_no_line_is_sorted_to_be_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID,T\n1,"x\ny"\n2,z\n')
    plan = cs.records(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
