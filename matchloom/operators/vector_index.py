"""An inverted-file index of vectors: approximate top-k that reads only the cells nearest to a query.

Cells are the clusters of a bounded sample; every vector is stored, in a folder of its nearest cell, and large cells in
parts of bounded size. A search sends each query to its nearest cells, reads those folders only, and meets the parts in
tasks: a part is held and its queries stream past, so vectors are shipped once whatever the number of queries.
With ``probe`` as large as the number of cells the answer is that of the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from matchloom.operators.ranking import top_k
from matchloom.operators.search import HAS, ITEM_ROWS, NEEDS, VECTOR_HITS, VectorBlock, _frame, _present, vectors

SAMPLE_PER_CELL = 256
_LOT = 1 << 30
LOT_ROWS = 1024  # queries asked at once
FOUND = "job_id string, candidate_id string, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _celled(df: DataFrame) -> StructType:
    return StructType(list(df.schema.fields)).add("cell", IntegerType())


def fit_cells(items: DataFrame, cells: int, sample_per_cell: int = SAMPLE_PER_CELL, seed: int = 17) -> np.ndarray:
    """Unit centroids of about ``cells * sample_per_cell`` vectors, chosen by a hash of their id; k-means runs as Spark jobs."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = items.count()
    if not n:
        return np.zeros((0, 0))
    share = min(_LOT, _LOT * cells * sample_per_cell // n)
    some = items.where(F.pmod(F.xxhash64("candidate_id", F.lit("cells")), F.lit(_LOT)) < share)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    unit = some.select(F.transform("embedding", lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12))).alias("x"))
    distinct = unit.distinct().limit(cells + 1).collect()
    if len(distinct) <= cells:  # nothing to cluster: every vector is a center
        return _unit(np.array(sorted(r["x"] for r in distinct)))
    model = KMeans(k=cells, seed=seed, maxIter=12, distanceMeasure="euclidean").fit(unit.select(array_to_vector("x").alias("features")))
    return _unit(np.array(model.clusterCenters()))


class VectorIndex:
    """The index in a folder: ``cells`` (cell, center) and ``vectors/cell=<n>/part=<m>``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # one row per cell
        self.centers = np.array([r["center"] for r in rows])

    @classmethod
    def build(cls, items: DataFrame, path: str, cells: int, part_rows: int = ITEM_ROWS, sample_per_cell: int = SAMPLE_PER_CELL, seed: int = 17) -> VectorIndex:
        """items: candidate_id, category, experience_years, embedding, and optional constraints of the search. Rows without
        a vector are left out. Unknown years count as 0."""
        spark = items.sparkSession
        x = items.where("embedding IS NOT NULL").select(
            "candidate_id", "category", F.coalesce("experience_years", F.lit(0.0)).cast("double").alias("years"),
            F.col("embedding").cast("array<float>").alias("embedding"), *_present(items, HAS))
        centers = fit_cells(x, cells, sample_per_cell, seed)
        schema = "cell int, center array<double>"
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], schema).write.mode("overwrite").parquet(f"{path}/cells")
        sent = spark.sparkContext.broadcast(centers)  # cells x dimensions numbers

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                nearest = (_unit(_matrix(batch.column("embedding"))) @ sent.value.T).argmax(1) if batch.num_rows else np.zeros(0)
                yield batch.append_column("cell", pa.array(nearest.astype(np.int32)))

        placed = x.mapInArrow(place, _celled(x)) if len(centers) else x.withColumn("cell", F.lit(0))
        # a cell is cut into parts before it is shuffled, so a cell that holds a third of all vectors is many tasks
        sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
        dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("candidate_id"), F.col("parts")).cast("int")).drop("parts")
        dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").write.mode("overwrite").partitionBy("cell", "part").parquet(f"{path}/vectors")
        return cls(spark, path)

    def nearest(self, queries: DataFrame, probe: int) -> DataFrame:
        """The queries, once per cell among their ``probe`` nearest."""
        sent, n = self.spark.sparkContext.broadcast(self.centers), min(probe, len(self.centers))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                likeness = _matrix(batch.column("embedding")) @ sent.value.T
                cells = np.argsort(-likeness, axis=1, kind="stable")[:, :n]
                rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
                yield rows.append_column("cell", pa.array(cells.ravel().astype(np.int32)))

        return queries.mapInArrow(near, _celled(queries))

    def search(self, queries: DataFrame, k: int, probe: int) -> DataFrame:
        """Inner-product top-k per job among the vectors of its ``probe`` nearest cells: job_id, candidate_id, score, rank.

        queries: job_id, category, min_years, embedding and optional constraints, as in the exact search; queries without a
        vector find nothing. The folders of cells that no query is near to are not read."""
        schema = FOUND + ", rank long"
        if not len(self.centers):
            return self.spark.createDataFrame([], schema)
        needs = _present(queries, NEEDS)
        q = queries.where("embedding IS NOT NULL").select(
            "job_id", "category", F.col("min_years").cast("double").alias("min_years"), F.col("embedding").cast("array<float>").alias("embedding"), *needs)
        q = self.nearest(q, probe)
        items = self.spark.read.parquet(f"{self.path}/vectors")
        if probe < len(self.centers):
            visited = [r["cell"] for r in q.select("cell").distinct().collect()]  # cell numbers
            items = items.where(F.col("cell").isin(visited))
        has = _present(items, HAS)
        parts = self.spark.read.parquet(f"{self.path}/vectors").select("cell", "part").distinct()  # from folder names
        none = {**{n: F.lit(None).cast("int" if n == "need_level" else "string") for n in NEEDS}, **{n: F.lit(None).cast("int" if n == "level_no" else "string") for n in HAS}}
        held = items.select("cell", "part", F.lit(0).alias("side"), F.col("candidate_id").alias("id"), "category", F.col("years").alias("years"), "embedding",
                            *[(F.col(n) if n in has else none[n]).alias(n) for n in HAS], *[none[n].alias(n) for n in NEEDS])
        asked = q.join(F.broadcast(parts), "cell").select(
            "cell", "part", F.lit(1).alias("side"), F.col("job_id").alias("id"), "category", F.col("min_years").alias("years"), "embedding",
            *[none[n].alias(n) for n in HAS], *[(F.col(n) if n in needs else none[n]).alias(n) for n in NEEDS])
        met = held.unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "side")
        return top_k(met.mapInArrow(_meet(k), FOUND), ["job_id"], [F.desc("score"), F.asc("candidate_id")], k)


def _meet(k: int):
    """Rows sorted by part, its vectors first, then the queries, of which one batch at a time is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pending, part = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "side")], 1)
            cuts = (np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(key)]):
                if a == b:
                    continue
                if at != tuple(key[a, :2]):
                    at, pending, part = tuple(key[a, :2]), [], None
                if key[a, 2] == 0:
                    pending.append(batch.slice(a, b - a))
                elif pending:
                    part = part or _part(pa.concat_batches(pending))
                    pending = [True]
                    for lo in range(a, b, LOT_ROWS):
                        asked = batch.slice(lo, min(LOT_ROWS, b - lo))
                        jobs = [SimpleNamespace(job_id=r["id"], min_years=r["years"], **{n: r[n] for n in ("category", *NEEDS)})
                                for r in asked.select(["id", "years", "category", *NEEDS]).to_pylist()]
                        found = part.ask_all(vectors(asked.column("embedding")), jobs, k)
                        yield pa.RecordBatch.from_pandas(_frame(found, VECTOR_HITS.names), schema=VECTOR_HITS, preserve_index=False)
    return run


def _part(batch: pa.RecordBatch) -> VectorBlock:
    names = [n for n in HAS if batch.column(n).null_count < batch.num_rows]
    has = pd.DataFrame({n: batch.column(n).to_pandas() for n in names}, index=range(batch.num_rows))
    return VectorBlock(vectors(batch.column("embedding")), batch.column("id").to_numpy(zero_copy_only=False).astype(str),
                       batch.column("years").to_numpy(zero_copy_only=False), has, batch.column("category").to_numpy(zero_copy_only=False))


def recall(found: DataFrame, exact: DataFrame, ks: list[int]) -> DataFrame:
    """k, wanted, hit, recall: share of the exact search's first k of all jobs that are among the found first k."""
    f = found.select("job_id", "candidate_id", F.col("rank").alias("found_rank"))
    j = exact.join(f, ["job_id", "candidate_id"], "left")
    sums = j.agg(*[F.count_if(F.col("rank") <= k).alias(f"w{k}") for k in ks], *[F.count_if((F.col("rank") <= k) & (F.col("found_rank") <= k)).alias(f"h{k}") for k in ks])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"w{k}").alias("wanted"), F.col(f"h{k}").alias("hit")) for k in ks])).alias("r")).select("r.*")
    return rows.withColumn("recall", F.round(F.col("hit") / F.col("wanted"), 4))
