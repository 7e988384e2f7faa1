"""Texts made of a candidate's years agree with their SQL where the balance is a negative zero."""

import shutil

import pytest

import __spark_entry__ as entry
from compare import TABLES, compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def signed(tmp_path_factory):
    import duckdb

    d = tmp_path_factory.mktemp("signed")
    for t in TABLES:
        if t != "customer":
            shutil.copy(f"{SF}/{t}.parquet", d / f"{t}.parquet")
    duckdb.connect().execute(f"""COPY (SELECT * REPLACE (CASE c_custkey % 3 WHEN 0 THEN -0.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal)
      FROM '{SF}/customer.parquet') TO '{d}/customer.parquet' (FORMAT parquet)""")
    return str(d)


@pytest.mark.parametrize("name", ["s11_hash_payload", "s12_normalization_hash", "s13_embedding_hash", "k24_rerank_text"])
def test_negative_zero(spark, signed, name):
    status, rows, _, note = compare(spark, duck(signed), name, entry.queries()[name], entry.oracle_sql()[name], signed)
    assert status == "ok" and rows > 0, note
