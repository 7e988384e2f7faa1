"""Token-count rollups that are kept up to date by deltas.

A batch brings inserts, revised counts and deletes of (document, tokenizer). Against the state left by earlier batches
each becomes a signed change, and the changes are summed by source, language and tokenizer into that batch's own
partial totals. Totals are the sum over batches. State and partial totals of a batch are folders named after it and are
replaced as a whole, and a batch only reads earlier ones, so committing it again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import text_of, word_count

GROUP = ["source", "lang", "tokenizer"]
PART = "struct<source: string, lang: string, tokens: bigint, documents: bigint>"
#: Tokenizer versions by what they count: runs of non-blanks; runs of letters, single digits and single marks.
TOKENIZERS = {
    "words-1": lambda text: word_count(text),
    "pieces-1": lambda text: F.regexp_count(text, F.lit(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]")).cast("long"),
}


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Inserts for all documents: doc_id, source, lang, tokenizer, tokens. Null text has no tokens."""
    return docs.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), TOKENIZERS[tokenizer](text_of()).alias("tokens"))


class TokenRollup:
    """Rollup in a shared folder. Changes have doc_id, source, lang, tokenizer and tokens (null: delete).

    * An insert of a known (document, tokenizer) is a revision: the old count leaves its old group, the new one enters.
    * Deletes of what is not there, and revisions to the same count and group, change nothing.
    * Null source or language is a group of its own. Rows without doc_id cannot be revised and are refused with an error.
    * A commit with ``repeated`` takes tables whose ids repeat or are null: all rows of a (document, tokenizer) in a batch
      count, together replace what it had, and leave together. Rows without doc_id are inserts that later batches add
      to; deletes without doc_id change nothing. The batch names them, so committing it again counts them once.
    * Otherwise, of several changes of one (document, tokenizer) in a batch, the largest by (tokens, source, lang) counts, a delete only
      if there is no other. An empty batch is a batch like any other.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, what: str, schema: str, before: int | None) -> DataFrame:
        empty = self.spark.createDataFrame([], f"{schema}, batch int")
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return empty
        rows = self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.path}/{what}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def state(self, before: int | None = None) -> DataFrame:
        """Counts in force per (document, tokenizer) and group, after the batches before ``before``; rows without id are not listed."""
        rows = self._read("state", f"doc_id long, tokenizer string, groups array<{PART}>", before).where("doc_id IS NOT NULL")
        last = rows.groupBy("doc_id", "tokenizer").agg(F.max(F.struct("batch", "groups")).alias("s"))
        return last.select("doc_id", "tokenizer", F.inline("s.groups"))

    def commit(self, batch: int, changes: DataFrame, repeated: bool = False) -> None:
        if repeated:
            parts = changes.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer", "source", "lang").agg(
                F.sum("tokens").alias("tokens"), F.count("tokens").alias("documents"))
        else:
            named = F.when(F.col("doc_id").isNull(), F.raise_error(F.lit("a change without doc_id"))).otherwise(F.col("doc_id")).cast("long")
            one = changes.groupBy(named.alias("doc_id"), "tokenizer").agg(F.max(F.struct("tokens", "source", "lang")).alias("c"))
            parts = one.select("doc_id", "tokenizer", "c.source", "c.lang", "c.tokens", F.col("c.tokens").isNotNull().cast("long").alias("documents"))
        # one list of groups per id, but none for all rows without id: those stay apart; an empty list is a delete
        apart = F.when(F.col("doc_id").isNull(), F.struct("source", "lang"))
        groups = F.filter(F.collect_list(F.struct("source", "lang", "tokens", "documents")), lambda g: g["documents"] > 0)
        parts.groupBy("doc_id", "tokenizer", apart.alias("apart")).agg(groups.alias("groups")).drop("apart").write.mode("overwrite").parquet(f"{self.path}/state/batch={batch}")
        new = self.spark.read.parquet(f"{self.path}/state/batch={batch}")
        old = self.state(before=batch).join(new.where("doc_id IS NOT NULL").select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
        signed = new.select("tokenizer", F.inline("groups")).select(*GROUP, F.col("documents").alias("d"), F.col("tokens").alias("t")).unionByName(
            old.select(*GROUP, (-F.col("documents")).alias("d"), (-F.col("tokens")).alias("t")))
        delta = signed.groupBy(*GROUP).agg(F.sum("d").cast("long").alias("documents"), F.sum("t").alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens of every group that holds a document."""
        rows = self._read("delta", "source string, lang string, tokenizer string, documents long, tokens long", None)
        return rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents > 0")


ORACLE = r"""
SELECT source, lang, tokenizer, count(*) AS documents, sum(tokens)::BIGINT AS tokens FROM (
  SELECT doc_id, source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents
  UNION ALL SELECT doc_id, source, lang, 'pieces-1', len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}|[^\s\p{L}\p{N}]')) FROM documents)
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1, 2, 3
"""
