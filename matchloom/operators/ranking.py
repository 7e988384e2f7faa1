"""Top-k, exact percentiles and run-length positions that survive one hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.session import materialize


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.

    The filter sits directly on ``row_number`` so Spark plans a partial
    WindowGroupLimit: each map task ships at most ``k`` rows per key, whatever
    the key's size. ``order`` must end in a unique column.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def places(df: DataFrame, key: str, order: list[Column], name: str = "position") -> DataFrame:
    """Every row's place within its key, from 1.

    Rows are numbered within range partitions of (key, order) and lifted by the key's rows in the partitions before, so
    one key's rows are spread over as many tasks as they fill. ``order`` must end in a unique column.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, F.col(key), *order).withColumn("_range", F.spark_partition_id())
    inside = materialize(ranged.withColumn("_in", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order))), "places")
    ahead = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    blocks = inside.groupBy(key, "_range").agg(F.max("_in").alias("_n"))  # one row per partition that a key lies in
    blocks = blocks.select(key, "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    return _join(inside, blocks, [key, "_range"]).select(*df.columns, (F.col("_in") + F.col("_ahead")).alias(name))


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Newest row per key as a map-side combined max of a struct: rows are sorted within tasks, and a task ships one row per key."""
    rest = [c for c in df.columns if c not in keys and c not in by]
    best = df.groupBy(*keys).agg(F.max(F.struct(*by, *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in [*by, *rest]])


def exact_percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float], buckets: int = 256) -> DataFrame:
    """Exact linear-interpolation percentiles per key, in bounded memory per task.

    Equal values are counted map-side, a mergeable sketch splits each key's
    value range into ``buckets`` even slices, and only the slices that hold a
    wanted rank are ranked. So a key with a third of all rows costs one slice
    per percentile, not one sort of the whole key. ``keys`` must not be empty.
    """
    runs = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    grid = [i / buckets for i in range(1, buckets)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, grid, 10000).alias("_cuts"))
    sliced = _join(runs, cuts, keys).select(
        *keys, value, "_n", F.size(F.filter("_cuts", lambda c: c < F.col(value))).alias("_b"))
    per_slice = sliced.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    w = Window.partitionBy(*keys).orderBy("_b")  # at most ``buckets`` rows per key
    offsets = per_slice.select(
        *keys, "_b", (F.sum("_bn").over(w) - F.col("_bn")).alias("_before"), F.sum("_bn").over(w).alias("_upto"),
        F.sum("_bn").over(Window.partitionBy(*keys)).alias("_total"))
    wanted = F.array(*[F.lit(p) for p in ps.values()])
    def rank_of(p):
        return (F.col("_total") - 1) * p
    hit = F.exists(wanted, lambda p: (F.floor(rank_of(p)) < F.col("_upto")) & (F.ceil(rank_of(p)) >= F.col("_before")))
    needed = _join(sliced, offsets.where(hit), [*keys, "_b"])
    wv = Window.partitionBy(*keys, "_b").orderBy(value)
    placed = needed.withColumn("_hi", F.col("_before") + F.sum("_n").over(wv)).withColumn("_lo", F.col("_hi") - F.col("_n"))
    aggs = []
    for name, p in ps.items():
        r = rank_of(F.lit(p))
        lo = F.max(F.when((F.floor(r) >= F.col("_lo")) & (F.floor(r) < F.col("_hi")), F.col(value)))
        hi = F.max(F.when((F.ceil(r) >= F.col("_lo")) & (F.ceil(r) < F.col("_hi")), F.col(value)))
        w_hi = F.max(r - F.floor(r))
        aggs.append((F.round((lo * (1 - w_hi) + hi * w_hi) * 10000) / 10000).alias(name))
    return placed.groupBy(*keys).agg(*aggs)


def _join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys)
