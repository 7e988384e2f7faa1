"""Résumé CSV sources: one unstructured file, or people with child files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from matchloom.functions import text as tx
from matchloom.operators.ranking import places
from matchloom.session import materialize

RESUME = "ID string, Resume_str string, Resume_html string, Category string"
PEOPLE = "person_id long, name string, email string, phone string, linkedin string"
CHILDREN = {
    "abilities": "person_id long, ability string", "skills": "person_id long, skill string",
    "education": "person_id long, institution string, program string, start_date string, location string",
    "experience": "person_id long, title string, firm string, start_date string, end_date string, location string",
}


# before a line: whether its split had an odd number of quotes; up to it: records begun, if the split begins outside of quotes or inside
_STATE = StructType([StructField("odd", BooleanType()), StructField("n0", LongType()), StructField("n1", LongType())])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds _STATE to the lines of whole splits, which come in file order one split after the other."""
    at, quotes, begun = None, 0, [0, 0]
    for batch in batches:
        file, block = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
        code, names = file.indices.to_numpy(), file.dictionary.to_pylist()
        here, blank = batch.column("quotes").to_numpy(), batch.column("blank").to_numpy(zero_copy_only=False)
        odd, n = np.zeros(len(here), bool), np.zeros((2, len(here)), np.int64)
        cuts = (np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(here)]):
            if a == b:
                continue
            if at != (names[code[a]], block[a]):
                at, quotes, begun = (names[code[a]], block[a]), 0, [0, 0]
            upto = quotes + np.cumsum(here[a:b], dtype=np.int64)
            odd[a:b] = (upto - here[a:b]) % 2 == 1
            for k in (0, 1):
                n[k, a:b] = begun[k] + np.cumsum(~blank[a:b] & (odd[a:b] == bool(k)))
            quotes, begun = int(upto[-1]), n[:, b - 1].tolist()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odd), pa.array(n[0]), pa.array(n[1])], names=[*batch.schema.names, *_STATE.names])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, record): the records of CSV files without their headers, numbered in file order over all files.

    A file is read in splits by as many tasks as it has. Whether a line begins a record follows from the quotes before it:
    those of its split, which are counted as its lines are read, and those of the earlier splits, of which only sums are
    needed; a line is sorted or shuffled only to be put together with others of its record. So this asks for quotes around whole
    values, doubled inside them (RFC 4180); a record with any other quote fails the job by name, it is never read askew.
    Lines without text between records are none. The lines are written once, so that all steps see the same splits; the
    table of splits is as small as the list of them that the scan itself is planned from.
    """
    c = F.col
    text = spark.read.option("lineSep", "\n").text(path).select(
        c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    blank = F.rtrim(c("value"), F.lit("\r")) == ""
    counted = text.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"')))).withColumn("blank", blank)
    lines = materialize(counted.mapInArrow(_states, StructType([*counted.schema.fields, *_STATE.fields])), "csv-lines")
    splits = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.max("n0").alias("n0"), F.max("n1").alias("n1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    everything = Window.partitionBy(F.lit(0)).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum(F.when(c("inside"), c("n1")).otherwise(c("n0"))).over(everything), F.lit(0)))
    splits = splits.withColumn("header", F.min("base").over(Window.partitionBy("file")) + 1).select("file", "block", "inside", "base", "header")

    placed = lines.join(materialize(splits, "csv-splits"), ["file", "block"])
    placed = placed.withColumn("seq", c("base") + F.when(c("inside"), c("n1")).otherwise(c("n0"))).withColumn("within", c("odd") != c("inside"))
    placed = placed.where("seq <> header and not (blank and not within)")
    single = ~c("within") & (c("quotes") % 2 == 0)
    parts = placed.where(~single).groupBy("seq").agg(F.min("file").alias("file"), F.array_sort(F.collect_list(F.struct("line", "value"))).alias("parts"))
    whole = placed.where(single).select("file", "seq", "value").unionByName(
        parts.select("file", "seq", F.array_join(F.transform("parts", lambda e: e["value"]), "\n").alias("value")))
    # a quoted value shrinks to one quote, which must then stand between separators
    bare = F.regexp_replace("value", '"[^"]*"', '"')
    astray = (F.regexp_count(c("value"), F.lit('"')) % 2 == 1) | bare.rlike(r'[^,"]"|"[^,"]')
    whole = whole.withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    return whole.select("file", "seq", F.when(astray, F.raise_error(F.concat(
        F.lit("a quote that neither begins nor ends a value (split=False reads such files) in record "), c("seq").cast("string"), F.lit(" of "), c("file")))).otherwise(c("value")).alias("record"))


def _read(spark: SparkSession, path: str, schema: str, split: bool = True) -> DataFrame:
    """Scan with a fixed schema; ``seq`` grows in file order.

    ``split``: a file is read by several tasks (see ``records``). Without it each file is one task's, and Spark's own
    reader takes quotes as they come.
    """
    if not split:
        df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        return df.withColumn("seq", F.monotonically_increasing_id())
    row = F.from_csv("record", F.lit(schema), {"escape": '"', "multiLine": "true"})
    return records(spark, path).select(row.alias("row"), "seq").select("row.*", "seq")


def read_resumes(spark: SparkSession, path: str, limit: int | None = None, split: bool = True) -> DataFrame:
    """(candidate_id, source_dataset, raw_id, category, text, html) of the unstructured file; ``limit`` takes its first records."""
    df = _read(spark, path, RESUME, split)
    if limit is not None:
        df = df.orderBy("seq").limit(limit)
    c = F.col
    return df.select(
        tx.normalize_identifier(c("ID"), "resume").alias("candidate_id"), F.lit("resumes").alias("source_dataset"), tx.clean_text(c("ID")).alias("raw_id"),
        tx.clean_text(c("Category")).alias("category"), F.coalesce(tx.clean_text(c("Resume_str")), F.lit("")).alias("text"), tx.clean_text(c("Resume_html")).alias("html"))


def people(df: DataFrame, limit: int | None) -> DataFrame:
    """First ``limit`` people in key order (file order is not defined on a cluster)."""
    return df.orderBy("person_id").limit(limit) if limit is not None else df


def read_people(spark: SparkSession, path: str, limit: int | None = None, split: bool = True) -> DataFrame:
    return people(_read(spark, path, PEOPLE, split), limit)


def read_child(spark: SparkSession, path: str, kind: str, split: bool = True) -> DataFrame:
    return _read(spark, path, CHILDREN[kind], split)


def grouped(child: DataFrame, parents: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, pos, columns): every child of the kept parents, one row each, placed by its own ``order`` value.

    A parent's list is its rows by ``pos``. No list is built here, so a parent that holds most of the children costs
    no more than any other; who needs an array builds it with ``listed``.
    """
    return child.join(parents.select(key), key, "left_semi").select(key, F.col(order).alias("pos"), *columns)


def listed(rows: DataFrame, key: str, columns: list[str], most: int = 10_000) -> DataFrame:
    """(key, items): the rows of ``grouped`` as one array per key, in order.

    ``most`` bounds an array. A key with more rows fails the job by name; its rows are never cut.
    """
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    checked = rows.join(n, key).withColumn("pos", F.when(F.col("_n") <= most, F.col("pos")).otherwise(
        F.raise_error(F.concat(F.lit(f"more than {most} rows of one key: "), F.col(key).cast("string"))).cast("long")))
    lists = checked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("_items"))
    keep = (lambda e: e[columns[0]]) if len(columns) == 1 else (lambda e: F.struct(*[e[c].alias(c) for c in columns]))
    return lists.select(key, F.transform("_items", keep).alias("items"))


def listed_pieces(rows: DataFrame, key: str, columns: list[str], piece: int = 10_000) -> DataFrame:
    """(key, piece, items): as ``listed``, but a key with more than ``piece`` rows has several arrays, numbered from 0 in order."""
    placed = places(rows.select(key, "pos", *columns), key, [F.asc("pos")], "_at").withColumn("piece", F.floor((F.col("_at") - 1) / piece).cast("long"))
    lists = placed.groupBy(key, "piece").agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("_items"))
    keep = (lambda e: e[columns[0]]) if len(columns) == 1 else (lambda e: F.struct(*[e[c].alias(c) for c in columns]))
    return lists.select(key, "piece", F.transform("_items", keep).alias("items"))


def union_sources(*parts: DataFrame) -> DataFrame:
    """Concatenation without deduplication; ids carry their source prefix."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
