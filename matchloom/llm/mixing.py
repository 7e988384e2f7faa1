"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a target number of words. Its documents stand in a fixed pseudo-random order and are read once or
more until the target is met; a copy belongs to the mix if the middle of its words lies within the target. Every
source also has a weight schedule over the training time 0..1. The integral of the schedule is the share of the
target demanded so far, so inverting it at a copy's middle gives the copy's training position.

A source is cut into hash buckets, so one that holds a third of all rows is summed by many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import before, text_of, word_count
from matchloom.session import materialize

# Weight schedules as (time, weight) knots, linear in between; sources take them in turn.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)),
)


def invert_schedule(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Time at which the integral of the schedule reaches ``share`` (0..1) of its total."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total, out, begun = sum(area), F.lit(1.0), [sum(area[:i]) for i in range(len(area))]
    want = share * F.lit(total)
    for (t0, w0), (t1, w1), done in reversed(list(zip(knots, knots[1:], begun))):
        y = want - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        u = F.when(y <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * y / (F.lit(w0) + F.sqrt(F.lit(w0 * w0) + F.lit(2.0 * slope) * y)))
        inside = F.lit(t0) + u
        out = inside if t1 == knots[-1][0] else F.when(want < F.lit(done + (t1 - t0) * (w0 + w1) / 2), inside).otherwise(out)
    return F.least(out, F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source: skey, source_size, class (its place in the repeating weights), target.

    ``sizes`` has skey, source, size. Sources by code point, null last, take the weights in turn and divide ``share``
    times all words by weight; a target above ``cap`` times its source is cut there and the rest shared again by
    weight, until none is above. The driver sees two sums per round; the table has one row per source.
    """
    per = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    klass = (rank % len(weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), klass + 1)
    table = materialize(per.withColumn("class", klass).withColumn("weight", weight).drop("source"), "mix-sources")
    everything = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, cut = float(share) * everything[0] / max(everything[1], 1), (0, 0, 0)
    ceiling = F.lit(float(cap)) * F.col("source_size")
    while True:  # the level of words per weight only rises, so each round cuts more sources or is the last
        above = table.where(ceiling <= F.lit(level) * F.col("weight"))
        now = above.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if now[0] <= cut[0] or now[2] == everything[1]:
            break
        cut = now
        level = (float(share) * everything[0] - float(cap) * cut[1]) / (everything[1] - cut[2])
    free = F.lit(level) * F.col("weight")
    return table.select("skey", "source_size", "class", F.when(ceiling <= free, ceiling).otherwise(free).alias("target"))


def _sized(docs: DataFrame, digits: int, *more: str) -> DataFrame:
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    skey = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    row = [F.struct(*docs.columns).alias("row")] if "row" in more else []
    return docs.select("doc_id", "source", skey.alias("skey"), word_count(text_of()).alias("size"), key.alias("key"), *row).withColumn(
        "bucket", F.substring("key", 1, digits))


def _planned(docs: DataFrame, weights, share, cap, schedules, digits, whole_rows: bool) -> DataFrame:
    sizes = materialize(_sized(docs, digits), "mix-sizes")
    targets = source_targets(sizes, weights, share, cap)
    blocks = before(sizes.groupBy("skey", "bucket").agg(F.sum("size").alias("n")), ["bucket"], "n", "ahead", ["skey"]).drop("n")
    running = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        (_sized(docs, digits, "row") if whole_rows else sizes).withColumn("upto", F.sum("size").over(running))
        .join(blocks, ["skey", "bucket"]).join(targets, "skey")
        .withColumn("middle", (F.col("ahead") + F.col("upto") - F.col("size")).cast("double") + F.col("size") / F.lit(2.0))
    )
    times = []
    for copy in range(math.ceil(cap)):
        at = F.lit(float(copy)) * F.col("source_size") + F.col("middle")
        demanded = F.when(F.col("target") > 0, at / F.col("target")).otherwise(0.0)
        time = F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            time = F.when(F.col("class") % len(schedules) == k, invert_schedule(demanded, knots)).otherwise(time)
        times.append(F.when(at <= F.col("target"), time))
    return placed.withColumn("positions", F.array_compact(F.array(*times)))


def mixing_plan(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
    schedules: tuple = SCHEDULES, digits: int = 2,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, positions (one per copy).

    * Null text has no words. Texts without words take part with size 0: their copies cost nothing.
    * A null source is a source of its own, after all others.
    * Ties: a document's place within its source is the MD5 of its id, then id, then size. Rows that agree in all
      three are interchangeable; so reruns give the same rows. A null id counts as the empty text.
    * An empty table gives no rows; a table without a single word has targets 0 and all its documents at time 0.
    * Other columns are ignored whatever their names.

    ``digits``: hex digits that cut a source into buckets (16 to the power of it).
    """
    return _planned(docs, weights, share, cap, schedules, digits, False).select(
        "doc_id", "source", "size", "source_size", "target", F.size("positions").alias("copies"),
        (F.size("positions") * F.col("size")).alias("taken"), "positions")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
    schedules: tuple = SCHEDULES, digits: int = 2,
) -> DataFrame:
    """The documents in training order, each as often as ``mixing_plan`` takes it, with exactly their own columns."""
    plan = _planned(docs, weights, share, cap, schedules, digits, True)
    copies = plan.select("row", "doc_id", F.explode("positions").alias("position"))
    return copies.orderBy("position", "doc_id").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _sql_time(share: str, knots) -> str:
    """The same inversion as SQL text."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    n = lambda x: f"{float(x)!r}::DOUBLE"
    want, out = f"(({share}) * {n(sum(area))})", "1.0::DOUBLE"
    for k in reversed(range(len(area))):
        (t0, w0), (t1, w1), done = knots[k], knots[k + 1], sum(area[:k])
        y = f"({want} - {n(done)})"
        u = (f"CASE WHEN {y} <= 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {y} / ({n(w0)} + sqrt({n(w0 * w0)} + "
             f"{n(2.0 * (w1 - w0) / (t1 - t0))} * {y})) END")
        inside = f"({n(t0)} + {u})"
        out = inside if k == len(area) - 1 else f"CASE WHEN {want} < {n(done + (t1 - t0) * (w0 + w1) / 2)} THEN {inside} ELSE {out} END"
    return f"least({out}, 1.0::DOUBLE)"


def oracle() -> str:
    """The documents' plan with the default parameters, in SQL."""
    time = lambda x: "CASE class " + " ".join(f"WHEN {k} THEN {_sql_time(x, s)}" for k, s in enumerate(SCHEDULES)) + " END"
    return f"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, source_size, class, CASE class WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM (
    SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS class
    FROM d GROUP BY source)
), r AS (  -- sources by words per weight: those in front of the first that stays below its cap are cut
  SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source) AS place, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER f, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM s WINDOW f AS (ORDER BY source_size::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, class, least(2.0::DOUBLE * source_size, weight * l.level) AS target
  FROM s, (SELECT coalesce(arg_min(level, place) FILTER (2.0::DOUBLE * source_size > level * weight), max(level)) AS level FROM r) l
), m AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.class,
         (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::DOUBLE + size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, source_size::DOUBLE + middle AS again, CASE WHEN target > 0 THEN middle / target ELSE 0.0::DOUBLE END AS x1,
         CASE WHEN target > 0 THEN (source_size::DOUBLE + middle) / target ELSE 0.0::DOUBLE END AS x2 FROM m
)
SELECT doc_id, size, source_size, target, ((middle <= target)::INT + (again <= target)::INT) * size AS taken,
       CASE WHEN middle <= target THEN {time("x1")} END AS position, CASE WHEN again <= target THEN {time("x2")} END AS position_again
FROM c
"""
