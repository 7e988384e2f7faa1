"""Resampling of documents towards a target distribution.

Every run of one or two words falls into one of a fixed number of buckets. How much likelier a bucket is in the target
than in the corpus is its gain; the gains are one small array that every task holds, and a document's weight is the mean
of the gains of its runs. Adding a Gumbel variate to each weight and taking the largest sums draws without replacement
in proportion to the (exponential) weights.

The largest are found by a radix sort over all documents, least significant digit first. A pass is a stable counting
sort: counts per (block, digit) are summed into the number of rows that go ahead of each, and a row's destination is
that number plus its rank among the rows of its block and digit. Blocks are equal runs of destinations, so whatever the
keys are, no task holds more than a block of one digit; after the last pass the destination is the rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import before, sent_if_small
from matchloom.llm.wordhash import slices
from matchloom.session import materialize

BUCKETS = 10_000
SCALE = 1000
DIGIT = 11  # bits of a digit
WIDE = 64  # longer words are hashed one by one
PIECE = 1 << 20  # bytes of text hashed at once
_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FULL = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _crc_table()


def crc32_after(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of what led to ``state`` followed by ``length`` bytes of ``data`` from ``start``, for many at once."""
    order = np.argsort(-length, kind="stable")
    reg, at, n = state[order] ^ _FULL, start[order], length[order]
    wide = int(np.searchsorted(-n, -WIDE))
    for j in range(min(WIDE, int(n.max(initial=0)))):
        to = int(np.searchsorted(-n, -j))  # words longer than j
        part = reg[wide:to]
        reg[wide:to] = _TABLE[(part ^ data[at[wide:to] + j]) & 255] ^ (part >> 8)
    for k in range(wide):
        reg[k] = np.uint32(zlib.crc32(data[at[k] : at[k] + n[k]].tobytes(), int(reg[k] ^ _FULL))) ^ _FULL
    out = np.empty_like(reg)
    out[order] = reg ^ _FULL
    return out


def run_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of one word, then of all of two, the text each belongs to, and the number of words per text.

    Words are runs of digits, letters (A-Z lowered) and anything beyond ASCII; null texts have none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    word = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)  # texts begin and end here
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.append(True, ~word[:-1])))
    length = np.flatnonzero(word & (edge[1:] | np.append(~word[1:], True))) + 1 - starts
    text = np.searchsorted(offsets, starts, "right") - 1
    one = crc32_after(np.zeros(len(starts), np.uint32), data, starts, length)
    pair = np.flatnonzero(text[1:] == text[:-1])
    spaced = one[pair] ^ _FULL
    spaced = (_TABLE[(spaced ^ np.uint32(32)) & 255] ^ (spaced >> 8)) ^ _FULL
    two = crc32_after(spaced, data, starts[pair + 1], length[pair + 1])
    return (np.concatenate([one, two]).astype(np.int64) % buckets, np.concatenate([text, text[pair]]),
            np.bincount(text, minlength=len(texts)).astype(np.int64))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences per bucket over all whole texts; a task sends one row per bucket, so the driver gets a fixed number."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                total += np.bincount(run_buckets(part.column("text"), buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(odds)) per bucket, counts smoothed by one."""
    s, t, k = corpus.astype(float), target.astype(float), float(len(corpus))
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of a text's runs, 0 without any."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                bucket, text, words = run_buckets(part.column("text"), len(g))
                n = np.maximum(2 * words - 1, 0)
                order = np.argsort(text, kind="stable")
                total = np.zeros(len(words), np.int64)
                some = np.flatnonzero(n)
                if len(some):
                    total[some] = np.add.reduceat(g[bucket[order]], (np.cumsum(n) - n)[some])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                                                 names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) of a uniform number that the seed and doc_id decide; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def radix_ranked(rows: DataFrame, keys: list[tuple[str, bool]], digit: int = DIGIT, least_block: int = 1024) -> DataFrame:
    """The rows with ``place``, their position from 0 in the order of the long columns ``keys`` (name, descending).

    Rows equal in all keys stand in any order. Digits in which no two rows differ take no pass. Blocks hold
    ``least_block`` rows, or a 4096th of more than 4096 times as many, so there are at most 2^(12 + digit) counts."""
    columns = rows.columns
    rows = materialize(rows.withColumn("place", F.monotonically_increasing_id()).withColumn("block", F.shiftright("place", 33)), "radix-0")
    about = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{i}") for i, (c, _) in enumerate(keys) for f in (F.min, F.max)]).first()
    if not about["n"]:
        return rows.drop("block")
    size = max(least_block, about["n"] >> 12)
    passes: list[Column] = []
    for i in range(len(keys) - 1, -1, -1):
        name, down = keys[i]
        low, high = about[f"min_{i}"], about[f"max_{i}"]
        if high - low < 1 << 63:
            value = F.lit(high) - F.col(name) if down else F.col(name) - F.lit(low)
            bits = (high - low).bit_length()
        else:  # the difference is no long: flip the sign bit, read as unsigned
            value = F.col(name).bitwiseXOR(F.lit(-(1 << 63)))
            value, bits = F.bitwise_not(value) if down else value, 64
        passes += [F.shiftrightunsigned(value, s).bitwiseAND(F.lit((1 << digit) - 1)) for s in range(0, bits, digit)]
    for k, key in enumerate(passes or [F.lit(0).cast("long")]):  # one pass at least, which makes places gapless
        rows = rows.withColumn("digit", key)
        counts = materialize(rows.groupBy("digit", "block").agg(F.count("*").alias("n")), "radix-counts")
        ahead = before(counts.groupBy("digit").agg(F.sum("n").alias("m")), ["digit"], "m", "ahead").select("digit", "ahead")
        offsets = before(counts, ["block"], "n", "within", ["digit"]).join(F.broadcast(ahead), "digit").select(
            "digit", "block", (F.col("ahead") + F.col("within")).alias("offset"))
        rank = F.row_number().over(Window.partitionBy("digit", "block").orderBy("place")) - 1
        moved = rows.withColumn("rank", rank).join(sent_if_small(materialize(offsets, "radix-offsets")), ["digit", "block"])
        moved = moved.withColumn("place", F.col("offset") + F.col("rank"))
        rows = materialize(moved.select(*columns, "place", F.floor(F.col("place") / size).cast("long").alias("block")), f"radix-{k + 1}")
    return rows.drop("block")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (from 1; null if not drawn).

    Of the documents with ``least_words`` words or more, ``percent`` per cent (rounded down) are drawn: those of largest
    score, ties to the smaller doc_id.

    * Null and empty texts have no runs and weight 0; they are scored but never drawn.
    * Repeated rows are each weighed and may each be drawn; a null doc_id sorts after all others of its score. Rows of
      one doc_id and one score are ranked in any order.
    * An empty table gives no rows; an empty target makes every bucket equally likely there.
    * Other columns are ignored whatever their names.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = materialize(weigh(docs, gain).withColumn("score", F.col("weight") + gumbel(seed)), "resample-scored")
    may = scored.where(F.col("n_words") >= least_words).select("doc_id", "n_features", "weight", "score")
    keyed = may.withColumn("no_id", F.col("doc_id").isNull().cast("long")).withColumn("id", F.coalesce("doc_id", F.lit(0)))
    ranked = radix_ranked(keyed, [("score", True), ("no_id", False), ("id", False)])
    drawn = ranked.count() * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank")
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, rank).unionByName(scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))
