"""Every registered query against its SQL on DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    status, rows, _, note = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert status in ("ok", "rows"), note
    if name not in ORACLES:
        assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["job_id", "candidate_id", "rank"]
