import hashlib

from pyspark.sql import functions as F

from matchloom.llm.exact_dedup import exact_dedup

from .conftest import rows


def test_groups_and_edge_cases(table):
    long = "x y " * 200_000
    docs = table([(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, long), (7, long), (None, "a"), (None, "alone"), (8, "r"), (8, "r")], clash=True)
    got = rows(exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept")
    assert got == [(1, 1, 3, True), (2, 1, 3, False), (3, 3, 1, True), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 2, True), (7, 6, 2, False),
                   (8, 8, 2, True), (8, 8, 2, True), (None, 1, 3, False), (None, None, 1, True)]
    digest = dict(rows(exact_dedup(docs, "largest").where("doc_id <> 8"), "keep_id", "text_sha256"))
    assert digest[2] == hashlib.sha256(b"a").hexdigest() and digest[5] == hashlib.sha256(b"").hexdigest()


def test_collisions_are_told_apart(table):
    docs = table([(i, t) for i, t in enumerate(["aa", "bb", "aa", "c", "bb", "dd"])])
    weak = exact_dedup(docs, hash_of=lambda t: F.lpad(F.length(t).cast("string"), 2, "0").cast("binary"))
    assert rows(weak, "doc_id", "keep_id", "group_size") == rows(exact_dedup(docs), "doc_id", "keep_id", "group_size")


def test_empty(table):
    assert exact_dedup(table([])).collect() == []
