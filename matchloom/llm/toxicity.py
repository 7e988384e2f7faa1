"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples are used as labels; everything else is unlabelled text, in which toxic documents hide at
the class prior. The risk of a classifier g over negatives cannot be measured, but it equals the risk of calling
unlabelled text negative minus the prior times that of calling toxic text negative. Where a mini-batch takes this
difference below zero the classifier has begun to memorise, and the step is taken back along that term.

Features are runs of five, six and eight bytes inside a word or at its ends, present or not, so inflected words share features
with their stem. Those that mark the confirmed examples are kept. Several linear classifiers are trained with numpy, each
in a task of its own on its own part of a bounded sample; a document's score is the mean of their probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.wordhash import mix, slices
from matchloom.session import materialize

BITS = 20
GRAMS = (5, 6, 8)
PIECE = 1 << 18  # bytes of text looked at at once; a task holds some 70 to 100 times that in arrays
_U64 = np.uint64
_FACTOR = _U64(0x9E3779B97F4A7C15)
_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text is divisible by 5. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) of every place of a gram, per gram length; a text without letters or digits has none.

    A gram is a run of bytes of a lower-cased word, which may include one separator before or after it."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    blank = pa.scalar("", pa.large_string())
    texts = pc.binary_join_element_wise(blank, texts, blank, pa.scalar(" ", pa.large_string()))  # a separator on both ends
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    separator = _SEPARATOR[data]
    before = np.append(0, np.cumsum(separator))  # separators in front of each byte
    byte = np.where(separator, 32, data).astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    for n in GRAMS:
        if len(data) < n:
            continue
        m = len(data) - n + 1
        at = np.flatnonzero(before[n - 1 : n - 1 + m] == before[1 : 1 + m])  # none inside
        h = np.zeros(len(at), np.uint64)
        for j in range(n):
            h = h * _FACTOR + byte[at + j] + _U64(1)
        yield text[at], (mix(h) >> _U64(64 - BITS)).astype(np.int64)


def _marks(column: pa.Array, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, slot) of the features that have a slot (-1: none), sorted."""
    found = [np.zeros(0, np.int64)]
    width = int(slot.max(initial=0)) + 1
    for text, feature in grams(column):
        s = slot[feature]
        at = s >= 0
        found.append(text[at] * width + s[at])
    pairs = np.unique(np.concatenate(found))
    return pairs // width, pairs % width


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, toxic, any: in how many of the task's texts each feature occurs; one row per feature and task at most."""
    total = np.zeros((1 << BITS, 2), np.int64)
    every = np.arange(1 << BITS)
    for batch in batches:
        for part in slices(batch, "text", PIECE):
            text, feature = _marks(part.column("text"), every)
            toxic, plain = (part.column(c).to_numpy(zero_copy_only=False)[text] for c in ("toxic", "plain"))
            total[:, 0] += np.bincount(feature[toxic], minlength=1 << BITS)
            total[:, 1] += np.bincount(feature[plain], minlength=1 << BITS)
    seen = np.flatnonzero(total.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen, 0]), pa.array(total[seen, 1])], names=["feature", "p", "u"])


def fit(toxic: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int, steps: int = 600, rate: float = 0.02, shrink: float = 3e-5,
        least: int = 64) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear classifier by the non-negative risk with sigmoid loss; rows hold 0 or 1.

    Adam steps over up to 8 mini-batches a round, each with the same share of both classes and ``least`` toxic rows or more.
    Features mark toxic text, so none may count against it: weights stay at 0 or above."""
    def rise(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    rng = np.random.default_rng(seed)
    theta = np.zeros(toxic.shape[1] + 1, np.float32)
    theta[-1] = np.log(prior / (1 - prior))
    m, v, step = np.zeros_like(theta), np.zeros_like(theta), 0
    batches = max(1, min(8, len(toxic) // least, len(unlabelled)))
    while step < steps:
        for pi, ui in zip(np.array_split(rng.permutation(len(toxic)), batches), np.array_split(rng.permutation(len(unlabelled)), batches)):
            x, y = toxic[pi].astype(np.float32), unlabelled[ui].astype(np.float32)
            sx, sy = rise(x @ theta[:-1] + theta[-1]), rise(y @ theta[:-1] + theta[-1])
            negative = sy.mean() - prior * sx.mean()  # estimated risk over negatives
            dx, dy = prior * sx * (1 - sx) / len(sx), sy * (1 - sy) / len(sy)
            # the positive risk falls by dx as outputs rise, the negative one by dx and rises by dy
            gx, gy = (-2 * dx, dy) if negative >= 0 else (dx, -dy)
            grad = np.append(x.T @ gx + y.T @ gy + shrink * theta[:-1], gx.sum() + gy.sum()).astype(np.float32)
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            theta[:-1] = np.maximum(theta[:-1], 0)
    return theta[:-1], float(theta[-1])


@dataclass
class Classifiers:
    """Linear classifiers over the features that have a slot; without any nothing is toxic."""

    features: np.ndarray  # feature of each slot
    weights: np.ndarray  # classifier x slot
    intercepts: np.ndarray
    prior: float

    def scores(self, column: pa.Array) -> np.ndarray:
        if not len(self.intercepts):
            return np.zeros(len(column))
        slot = np.full(1 << BITS, -1, np.int64)
        slot[self.features] = np.arange(len(self.features))
        text, s = _marks(column, slot)
        z = np.repeat(self.intercepts[:, None], len(column), axis=1)
        for k, w in enumerate(self.weights):
            z[k] += np.bincount(text, w[s], minlength=len(column))
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).mean(0)


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, toxic_docs: int = 4000, unlabelled_docs: int = 12_000,
          features: int = 1024, members: int = 5, least_lift: float = 1.5, least_worth: float = 10.0) -> Classifiers:
    """Classifiers from the confirmed toxic documents (``labels.toxic`` 1) and unlabelled text, of rows that are not held out.

    ``toxic_docs``, ``unlabelled_docs``: about so many whole documents are fitted to, chosen by hashes of ids and row numbers; all
    if there are fewer. ``prior``: share of toxic documents; if None it is the share of toxic ones among the labelled, or
    without labels 0, which serve nothing else, how often the features that mark toxic documents best occur in unlabelled
    text, as a share of how often they do in toxic documents. Several labels of one id vote, a tie is toxic.
    ``features``: at most so many are kept, of those that are e^``least_lift`` times as common in toxic documents and whose
    log-likelihood gain (documents times lift) is ``least_worth`` or more.
    """
    vote = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("toxic"))
    may = docs.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    confirmed = vote.where("toxic").select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out())
    n_toxic, n_all = confirmed.count(), may.count()
    if not n_toxic or not n_all:
        return Classifiers(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    parts = 1 << 30
    ids = confirmed.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(parts)) < min(parts, parts * toxic_docs // n_toxic))
    ids = F.broadcast(materialize(ids.withColumn("toxic", F.lit(True)), "toxicity-ids"))  # about ``toxic_docs`` numbers
    n_rows = max(1, may.select("doc_id").join(ids, "doc_id").count())
    # by row, so that copies and repeated ids are thinned like all others
    lot = F.pmod(F.xxhash64("row", F.lit("lot")), F.lit(parts))
    numbered = may.withColumn("row", F.monotonically_increasing_id()).join(ids, "doc_id", "left")
    plain, toxic = lot < min(parts, parts * unlabelled_docs // n_all), F.coalesce("toxic", F.lit(False)) & (lot < min(parts, parts * toxic_docs // n_rows))
    sample = materialize(numbered.select("text", "row", plain.alias("plain"), toxic.alias("toxic")).where("plain OR toxic"), "toxicity-sample")
    n = sample.agg(F.sum(F.col("toxic").cast("long")).alias("p"), F.sum(F.col("plain").cast("long")).alias("u")).first()
    if not n["p"] or not n["u"]:
        return Classifiers(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    counts = sample.select("text", "plain", "toxic").mapInArrow(_document_counts, "feature long, p long, u long").groupBy("feature").agg(
        F.sum("p").alias("p"), F.sum("u").alias("u"))
    lift = F.log((F.col("p") + 0.5) / (n["p"] + 1.0)) - F.log((F.col("u") + 0.5) / (n["u"] + 1.0))
    best = counts.withColumn("worth", F.col("p") * lift).where((lift >= least_lift) & (F.col("worth") >= least_worth)).orderBy(F.desc("worth"), "feature").limit(features).collect()
    if not best:
        return Classifiers(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    told = vote.where(~held_out()).agg(F.count_if("toxic").alias("toxic"), F.count("*").alias("n")).first()
    if prior is None and told["toxic"] < told["n"]:
        prior = told["toxic"] / told["n"]
    if prior is None:
        common = [r for r in best if r["p"] * 20 >= n["p"]][:16] or best[:16]
        prior = (sum(r["u"] for r in common) / n["u"]) / (sum(r["p"] for r in common) / n["p"])
    prior = float(np.clip(prior, 1 / (n["u"] + 2), 0.5))
    chosen = np.array([r["feature"] for r in best], np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(chosen)  # ``features`` numbers

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(1 << BITS, -1, np.int64)
        slot[sent.value] = np.arange(len(sent.value))
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                text, s = _marks(part.column("text"), slot)
                ends = np.append(0, np.cumsum(np.bincount(text, minlength=part.num_rows)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(s, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("toxic"), part.column("plain"), lists], names=["row", "toxic", "plain", "slots"])

    rows = sample.select("text", "row", "toxic", "plain").mapInArrow(marks, "row long, toxic boolean, plain boolean, slots array<long>")
    # each classifier leaves out another part of the sample
    dealt = rows.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1)))).where(
        (F.lit(members) == 1) | (F.pmod(F.xxhash64("row", F.lit("member")), F.lit(members)) != F.col("member")))

    def learn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        x = np.zeros((len(pdf), len(chosen)), np.uint8)
        for i, s in enumerate(pdf["slots"]):
            x[i, s] = 1
        toxic, unlabelled = x[pdf["toxic"].to_numpy()], x[pdf["plain"].to_numpy()]
        if not len(toxic) or not len(unlabelled):
            return pd.DataFrame({"member": [], "weights": [], "intercept": []})
        w, b = fit(toxic, unlabelled, prior, int(key[0]))
        return pd.DataFrame({"member": [int(key[0])], "weights": [w.tolist()], "intercept": [b]})

    learned = dealt.groupBy("member").applyInPandas(learn, "member int, weights array<double>, intercept double").orderBy("member").collect()
    return Classifiers(chosen, np.array([r["weights"] for r in learned]).reshape(len(learned), len(chosen)), np.array([r["intercept"] for r in learned]), prior)


def score(docs: DataFrame, model: Classifiers) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    * Null and empty texts, and texts without a word, have no features and get the score of that.
    * Repeated rows are each scored; a null doc_id is not held out. Without confirmed toxic documents every score is 0.
    * An empty table gives no rows. Other columns are ignored whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most ``features`` x ``members`` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                s = m.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                                 names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, train(docs, labels, **options))
