"""A stored inverted index for keyword search, and a top-k that leaves out blocks that cannot matter.

Documents of one category and seniority lie in blocks of bounded size; a block keeps its documents' fields, the postings
of its terms and its summaries. Beside the blocks stand two tables that say which blocks hold a term, and which hold a
character gram in a summary. From these a search knows for every job and block the best score any document there can
have. It scores each job's most promising blocks first, and of the rest only those whose bound reaches the score that the
job's k-th hit has by then. The answer is that of ``search.keyword_top_k`` over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import scoring as sc
from matchloom.operators.ranking import places, top_k
from matchloom.operators.search import ANY, HAS, HIT_TYPES, KeywordBlock, distinct_queries, job_rows, prepared_queries, shared_hits
from matchloom.session import materialize, shared_dir

BLOCK_ROWS = 16384  # a block's terms are one byte per document or less, so few large blocks cost less than many small ones
GRAM = 3  # shorter terms are looked up by grams of their own length
FOUND = "job_id string, candidate_id string, keyword_score double, metadata_score double, fusion_score double"
BLOCK = ("block long, category string, level string, top_years double, n int, ids array<string>, years array<double>, level_nos array<int>, places array<string>, "
         "summaries array<string>, terms array<string>, ends array<int>, docs array<int>")


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One block as one row; at most BLOCK_ROWS documents come here."""
    rows = rows.sort_values("candidate_id")
    posts: dict[str, list[int]] = {}
    for j, pool in enumerate(rows["pool"]):
        for t in pool:
            posts.setdefault(t, []).append(j)
    terms = sorted(posts)
    years = rows["experience_years"].to_numpy(dtype=float)
    known = years[~np.isnan(years)]
    return pd.DataFrame([{
        "block": int(key[0]), "category": rows["category"].iloc[0], "level": rows["level"].iloc[0], "top_years": float(known.max()) if len(known) else None,
        "n": len(rows), "ids": rows["candidate_id"].tolist(), "years": [None if y != y else float(y) for y in years],
        "level_nos": rows["level_no"].tolist(), "places": rows["places"].tolist(), "summaries": rows["summary"].tolist(), "terms": terms,
        "ends": np.cumsum([len(posts[t]) for t in terms]).tolist(), "docs": [j for t in terms for j in posts[t]]}])


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


class KeywordIndex:
    """The index in a folder: ``blocks``, ``terms`` (term, block), ``grams`` (gram, block)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @classmethod
    def build(cls, items: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> KeywordIndex:
        """items: candidate_id, category, experience_years, seniority_level, pool, summary and optional constraints."""
        def text(c: str) -> Column:
            return F.coalesce(F.lower(c), F.lit(""))

        rows = items.select("candidate_id", text("category").alias("category"), "experience_years", text("seniority_level").alias("level"),
                            F.coalesce("pool", F.array().cast("array<string>")).alias("pool"), text("summary").alias("summary"),
                            *[F.col(n) if n in items.columns else F.lit(None).cast("int" if n == "level_no" else "string").alias(n) for n in HAS])
        # alike documents lie together, so a block has few terms and a narrow range of years, which makes its bound tight
        order = [F.asc("skills"), F.desc_nulls_last("experience_years"), F.asc("candidate_id")]
        keyed = rows.withColumn("group", F.concat_ws("\x01", "category", "level")).withColumn("skills", F.array_join(F.array_sort("pool"), "\x01"))
        dealt = places(keyed, "group", order, "place").withColumn("block", F.xxhash64("group", F.floor((F.col("place") - 1) / block_rows)))
        dealt.drop("group", "skills", "place").groupBy("block").applyInPandas(_pack, BLOCK).write.mode("overwrite").parquet(f"{path}/blocks")
        blocks = items.sparkSession.read.parquet(f"{path}/blocks")
        blocks.select(F.explode("terms").alias("term"), "block").repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        lines = blocks.select("block", F.explode("summaries").alias("s"))
        grams = lines.select("block", F.explode(F.concat(*[_grams(F.col("s"), n) for n in range(1, GRAM + 1)])).alias("gram")).distinct()
        grams.repartition("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")
        return cls(items.sparkSession, path)

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(job_id, block, bound): every block that may hold a document for the job, with the best score one there can have.

        queries: as prepared by ``search``."""
        about = self._table("blocks").select("block", "category", "level", "top_years")
        terms = queries.select("job_id", F.explode("terms").alias("term"))
        held = terms.join(self._table("terms"), "term").groupBy("job_id", "block").agg(F.count("*").alias("present"))
        heads = queries.select(F.explode("heads").alias("term")).distinct()
        parts = heads.where("term <> ''").select("term", F.explode(_grams(F.col("term"), GRAM)).alias("gram")).unionByName(
            heads.where((F.col("term") != "") & (F.length("term") < GRAM)).select("term", F.col("term").alias("gram")))
        wanted = parts.groupBy("term").agg(F.count("*").alias("grams"))
        inside = parts.join(self._table("grams"), "gram").groupBy("term", "block").agg(F.count("*").alias("seen")).join(wanted, "term").where("seen = grams")
        told = queries.select("job_id", F.explode("heads").alias("term")).join(inside, "term").select("job_id", "block", F.lit(0).cast("long").alias("present"))
        # a job without terms, or with an empty one, may meet any block of its category
        open_jobs = queries.where((F.size("terms") == 0) | F.array_contains("heads", "")).select("job_id", F.coalesce(F.lower("category"), F.lit(ANY)).alias("key"))
        keyed = about.select("block", F.explode(F.array("category", F.lit(ANY))).alias("key"))
        every = open_jobs.join(keyed, "key").select("job_id", "block", F.lit(0).cast("long").alias("present"))
        pairs = held.unionByName(told).unionByName(every).groupBy("job_id", "block").agg(F.max("present").alias("present"))
        j = pairs.join(queries.select("job_id", F.col("category").alias("wanted"), "industry", "min_years", "preferred_seniority", F.greatest(F.size("terms"), F.lit(1)).alias("n_terms")), "job_id")
        j = j.join(about, "block").where(F.col("wanted").isNull() | (F.lower("wanted") == F.col("category")))
        j = j.where(F.col("min_years").isNull() | (F.col("top_years") >= F.col("min_years")))
        w = sc.FUSION_WEIGHTS
        meta = sc.r4(sc.metadata_score(F.col("wanted"), F.col("industry"), F.col("min_years"), F.col("preferred_seniority"), F.col("category"), F.col("top_years"), F.nullif("level", F.lit(""))))
        bound = sc.clip01((sc.r4(F.col("present") / F.col("n_terms")) * w["keyword"] + meta * w["metadata"]) / sum(w.values())) + 1e-4  # a rounding step
        return j.select("job_id", "block", bound.alias("bound"))

    def _score(self, queries: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        """Local top-k of each (job, block); a block is held while its jobs stream past, so it is shipped once."""
        blank = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in self._table("blocks").schema.fields}
        jobs = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in jobs.schema.fields]
        visited = self._table("blocks").join(pairs.select("block").distinct(), "block", "left_semi").select(*[F.col(c) for c in blank], F.lit(0).alias("side"), *none)
        asked = pairs.select("block", F.col("job_id").alias("q_job_id")).join(jobs, "q_job_id").select(
            *[F.col(c) if c == "block" else v for c, v in blank.items()], F.lit(1).alias("side"), *jobs.columns)
        met = visited.unionByName(asked).repartition("block").sortWithinPartitions("block", "side")
        return met.mapInArrow(_meet(k), FOUND)

    def search(self, queries: DataFrame, k: int, heads: int | None = None, lead: int = 2) -> DataFrame:
        """Top-k per job: job_id, candidate_id, keyword_score, metadata_score, fusion_score, rank."""
        return self.search_counted(queries, k, heads, lead)[0]

    def search_counted(self, queries: DataFrame, k: int, heads: int | None = None, lead: int = 2) -> tuple[DataFrame, DataFrame]:
        """The hits, and the (job, block) pairs with ``stage``: first (among the ``lead`` best bounds), later or skipped."""
        q, shares = distinct_queries(prepared_queries(queries, heads))
        bounds = materialize(self.bounds(q), "keyword-bounds")
        first = top_k(bounds, ["job_id"], [F.desc("bound"), F.asc("block")], lead, "place")
        hits = materialize(top_k(self._score(q, first, k), ["job_id"], [F.desc("fusion_score"), F.asc("candidate_id")], k), "keyword-first")
        reached = hits.where(F.col("rank") == k).select("job_id", F.col("fusion_score").alias("reached"))
        rest = bounds.join(first.select("job_id", "block", F.lit(True).alias("first")), ["job_id", "block"], "left").join(reached, "job_id", "left")
        stage = F.when(F.col("first"), "first").when(F.col("bound") < F.coalesce("reached", F.lit(-1.0)), "skipped").otherwise("later")
        dealt = materialize(rest.select("job_id", "block", stage.alias("stage")), "keyword-stages")
        more = self._score(q, dealt.where("stage = 'later'"), k)
        both = hits.drop("rank").unionByName(more)
        found = top_k(both, ["job_id"], [F.desc("fusion_score"), F.asc("candidate_id")], k)
        return shared_hits(found, shares), dealt


def _block(row: dict) -> KeywordBlock:
    n, ends = len(row["ids"]), np.array(row["ends"], np.int64)
    names = {c: row[f] for c, f in (("level_no", "level_nos"), ("places", "places")) if any(v is not None for v in row[f])}
    codes = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    return KeywordBlock(np.array(row["ids"], dtype=object).astype(str), [row["category"]] * n, [row["level"]] * n, np.array([np.nan if y is None else y for y in row["years"]], dtype=float),
                        row["summaries"], pd.DataFrame(names, index=range(n)), np.array(row["docs"], np.int64), codes, row["terms"])


def _meet(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, None
        for batch in batches:
            blocks, side = batch.column("block").to_numpy(), batch.column("side").to_numpy()
            cuts = (np.flatnonzero((blocks[1:] != blocks[:-1]) | (side[1:] != side[:-1])) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(blocks)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if side[a] == 0:
                    at, block = blocks[a], _block(part.slice(0, 1).to_pylist()[0])
                elif at == blocks[a] and block is not None:
                    asked = part.select([c for c in part.schema.names if c.startswith("q_")])
                    found = block.ask_all(job_rows(asked.rename_columns([c[2:] for c in asked.schema.names])), k)
                    if len(found):
                        yield pa.RecordBatch.from_pandas(found, schema=HIT_TYPES, preserve_index=False)
    return run


def keyword_index(items: DataFrame, purpose: str = "keyword-index", **options) -> KeywordIndex:
    """An index in a fresh shared folder."""
    return KeywordIndex.build(items, shared_dir(items.sparkSession, purpose), **options)
