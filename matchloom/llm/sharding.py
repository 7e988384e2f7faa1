"""Minimax contiguous sharding.

Documents with equal texts are one atomic group. Groups stand in the order of their smallest doc_id and are cut into
contiguous shards so that the largest shard is as small as it can be: the smallest capacity for which a greedy pass
(take groups until the next would not fit) needs no more than the given shards is found by search, then the shards are
cut there.

Order and sizes come from one range sort; running totals are summed inside range partitions and lifted by the totals
of the partitions in front, so no task sees everything. The search runs on a bounded sample of exact group ends, read
finer around the possible cuts until nothing is open.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import before, text_of
from matchloom.session import materialize


class _Ends:
    """What the driver knows of the sorted group ends: a bounded sample of exact ends, finer where cuts may fall.

    ``whole[i]`` says that no group ends between known end i-1 and known end i.
    """

    def __init__(self, ends: DataFrame, total: int, buckets: int):
        self.ends, self.total, self.buckets = ends, total, buckets
        self.rows, self.whole = {0: 0}, {0: True}
        self._read(0, total, buckets)

    def _read(self, a: int, b: int, buckets: int) -> None:
        width = max(1, -(-(b - a) // buckets))
        inside = self.ends.where((F.col("bytes") > a) & (F.col("bytes") <= b))
        ends = [f(c) for f in (F.min, F.max) for c in ("bytes", "rows")]
        for _, low, low_rows, high, high_rows, n in inside.groupBy(F.floor((F.col("bytes") - a - 1) / width)).agg(*ends, F.count("*")).collect():
            self.rows[high], self.whole[high] = high_rows, n <= 2 or self.whole.get(high, False)
            self.rows[low], self.whole[low] = low_rows, True  # the first end of a bucket follows the last known one before it
        self.known = sorted(self.rows)

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Greedy cuts if unknown ends are absent (a result that surely can be reached) or lie just where they help."""
        out, at = [], 0
        for _ in range(shards):
            bound = min(self.total, at + capacity)
            i = bisect.bisect_right(self.known, bound)
            at = bound if hopeful and i < len(self.known) and not self.whole[self.known[i]] else self.known[i - 1]
            out.append(at)
        return out

    def smallest(self, low: int, high: int, shards: int, hopeful: bool) -> int:
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, hopeful)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def refine(self, regions: list[tuple[int, int]]) -> None:
        for a, b in regions:
            i, j = bisect.bisect_right(self.known, a) - 1, bisect.bisect_left(self.known, b)
            self._read(self.known[i], self.known[min(j, len(self.known) - 1)], max(2, self.buckets // len(regions)))


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int, buckets: int = 32768) -> list[tuple[int, int]]:
    """Ends of the shards as (bytes, rows): the greedy cuts at the smallest feasible capacity.

    A binary search on what is known of the ends brackets that capacity from both sides; where the two disagree, the
    ends there are read at a finer grain. ``buckets`` bounds the ends read per round; each round narrows by as much.
    """
    known = _Ends(ends, total, buckets)
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest  # the latter always suffices
    while True:
        low, high = known.smallest(low, high, shards, True), known.smallest(low, high, shards, False)
        sure, hoped = known.cuts(low, shards, False), known.cuts(high, shards, True)
        open_regions = [(a, b) for a, b in zip(sure, hoped) if a < b]
        if not open_regions:
            return [(c, known.rows[c]) for c in sure]
        known.refine(open_regions)


def shard_documents(docs: DataFrame, shards: int = 8, ranges: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard (from 0), slot (gapless from 0 within its shard).

    * Size is the text's UTF-8 bytes plus 1; null text has none and size 1 like the empty text, and is in its group.
    * Groups are equal 128-bit content hashes with equal length: should two texts collide, they merely stay together.
    * Groups whose ids are all null come last. Ties in the smallest id are broken by hash, rows of a group by id,
      null ids last; repeated rows are interchangeable and each gets a slot of its own.
    * An empty table gives no rows; with fewer groups than shards, or a group larger than an even share, later
      shards may be empty. Other columns are ignored whatever their names.

    ``ranges``: range partitions of the sort (default: the session's shuffle partitions).
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = text_of().cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
                       F.unhex(F.md5(body)).alias("h"))
    first = materialize(rows.groupBy("h", "size").agg(F.min("doc_id").alias("lead")), "shard-groups")  # own exchange below: hot groups can be split
    order = [F.asc_nulls_last("lead"), F.asc("h"), F.asc("size"), F.asc_nulls_last("doc_id")]
    by_range = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ordered = materialize(
        rows.join(first, ["h", "size"]).repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
        .withColumn("n", F.count("*").over(by_range)).withColumn("upto", F.sum("size").over(by_range)), "shard-order")
    blocks = ordered.groupBy("range").agg(F.max("n").alias("bn"), F.max("upto").alias("bu"))
    blocks = before(before(blocks, ["range"], "bn", "n_ahead"), ["range"], "bu", "ahead").select("range", "n_ahead", "ahead")
    placed = ordered.join(blocks, "range").select(
        "doc_id", "size", "text_crc32", "lead", "h", (F.col("n") + F.col("n_ahead")).alias("rows"), (F.col("upto") + F.col("ahead")).alias("bytes"))
    ends = materialize(
        placed.groupBy("lead", "h", "size").agg(F.max("bytes").alias("bytes"), F.max("rows").alias("rows"), F.sum("size").alias("whole"))
        .select("bytes", "rows", "whole").repartitionByRange("bytes").sortWithinPartitions("bytes"), "shard-ends")
    total, largest = ends.agg(F.max("bytes"), F.max("whole")).first()
    cuts = minimax_cuts(ends, total, largest, shards) if total else [(0, 0)] * shards
    shard, start = F.lit(shards - 1), F.lit(cuts[-2][1] if shards > 1 else 0)
    for k in range(shards - 2, -1, -1):
        within = F.col("bytes") <= cuts[k][0]
        shard, start = F.when(within, k).otherwise(shard), F.when(within, cuts[k - 1][1] if k else 0).otherwise(start)
    return placed.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("rows") - start - 1).alias("slot"))
