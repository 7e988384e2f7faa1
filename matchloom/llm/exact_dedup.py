"""Exact deduplication: a 128-bit content hash names the group, byte equality confirms it.

Copies are combined inside the map tasks (the grouping key is hash plus text), so a text that a third of all rows
share reaches the shuffle once per task. Documents then meet their group on digests only; texts are not shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import text_of
from matchloom.session import materialize


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, keep: str = "smallest", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when all their bytes are. ``keep`` says whether the smallest or the largest doc_id of a group stays.

    * Null text counts as empty; so null and empty texts are one group.
    * A null doc_id never wins over another id; a group of nothing but null ids keeps them (keep_id null, kept true).
    * Repeated rows (same doc_id and text) are one document told twice: each row is returned, each counts in
      group_size, and all are kept if the id is.
    * A hash that two different texts share gives two groups. The rows of such groups are told apart by their SHA-256;
      should two different texts agree in both digests, the job fails rather than merging them.
    * An empty table gives no rows. Other columns are ignored whatever their names.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    texts = docs.select("doc_id", text_of().alias("t")).select("doc_id", "t", hash_of(F.col("t")).alias("h"))
    same_bytes = texts.groupBy("h", "t").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    group = materialize(  # written, so that the join below has its own exchange and Spark can split a hot group there
        same_bytes.select("h", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"), "keep_id", "group_size")
        .groupBy("h", "sha").agg(F.count("*").alias("texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
            F.raise_error(F.lit("two different texts share both digests")).cast("long"))), "dedup-groups")
    row = texts.select("doc_id", "h", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"))
    return row.join(group, ["h", "sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
