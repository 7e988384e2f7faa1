"""Language identification as a mixture: which languages does a document hold, in which shares?

Every language has a distribution over character trigrams of words. A word's likelihood under a language is the product
over its trigrams; a document is a mixture of languages with unknown shares, estimated by expectation-maximisation over
its words. How many languages there are is decided by likelihood minus a penalty per language (BIC).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import held_out
from matchloom.llm.wordhash import U64, mix, slices

BITS = 18  # trigrams are counted in so many hash buckets (as a power of two)
ROUNDS, SETTLED = 12, 1e-3  # of expectation-maximisation, and the change of shares at which it ends
PIECE = 2 << 20  # bytes of text worked on at once


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket per trigram, first trigram of each word, first word of each text with one more at the end).

    Words are runs of letters in lower case; the trigrams of a word reach one place over either end."""
    lower = pc.utf8_lower(texts.fill_null("")).to_pylist()
    code = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower])]).astype(np.int64)
    letter = _is_letter()[code]
    c = np.where(letter, code, 0).astype(np.uint64)
    b = np.concatenate([[0], c[:-1]]).astype(np.uint64)
    a = np.where(b > 0, np.concatenate([[0, 0], c[:-2]])[: len(c)].astype(np.uint64), U64(0))
    at = np.flatnonzero((c > 0) | (b > 0))
    bucket = (mix((a[at] << U64(42)) | (b[at] << U64(21)) | c[at]) >> U64(64 - BITS)).astype(np.int64)
    starts = np.flatnonzero((c > 0) & (b == 0))
    return bucket, np.searchsorted(at, starts), np.searchsorted(starts, begin)


def _count(languages: list[str]):
    """(language, bucket, n) of the rows of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                bucket, first, texts = _trigrams(part.column("text"))
                of_text = np.array([languages.index(x) for x in part.column("lang").to_pylist()], np.int64)
                per_text = np.diff(np.append(first, len(bucket))[texts])
                key, n = np.unique((np.repeat(of_text, per_text) << BITS) | bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key >> BITS), pa.array(key & ((1 << BITS) - 1)), pa.array(n)], names=["lang", "bucket", "n"])
    return run


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # bucket x language

    def shares(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(share of each language in each text, number of words, posterior of the best language if there is but one)."""
        bucket, first, begin = _trigrams(texts)
        n, langs = np.diff(begin), len(self.languages)
        share, certain = np.zeros((len(n), langs)), np.ones(len(n))
        if not len(first) or not langs:
            return share, n, certain
        word = np.add.reduceat(self.logp[bucket], first, axis=0, dtype=np.float64)
        word -= word.max(1, keepdims=True)
        some = np.flatnonzero(n)
        whole = np.add.reduceat(word, begin[some], axis=0)  # log likelihood under one language alone
        best = whole.argmax(1)
        top = whole[np.arange(len(some)), best]
        share[some, best] = 1.0
        certain[some] = 1 / np.exp(whole - top[:, None]).sum(1)
        if langs < 2:
            return share, n, certain
        penalty = 0.5 * np.log(n[some])
        # no mixture has a likelihood above 0 here, so only texts whose best language lies below the penalty can gain
        left = np.flatnonzero(top + penalty < 0)
        if not len(left):
            return share, n, certain
        gain = top[left] - penalty[left]
        likely = np.exp(word)
        everything, _ = _mixture(likely, begin, some[left], np.ones((len(left), langs), bool))
        rank = np.argsort(-everything, axis=1, kind="stable")
        for k in range(2, langs + 1):
            allowed = np.zeros((len(left), langs), bool)
            np.put_along_axis(allowed, rank[:, :k], True, 1)
            theta, loglik = _mixture(likely, begin, some[left], allowed)
            score = loglik - k * penalty[left]
            better = np.flatnonzero(score > gain)
            if not len(better):
                break
            share[some[left[better]]], certain[some[left[better]]] = theta[better], 1.0
            left, rank, gain = left[better], rank[better], score[better]
        return share, n, certain


def _mixture(likely: np.ndarray, begin: np.ndarray, texts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the allowed languages in each text by expectation-maximisation, and the log likelihood."""
    theta = allowed / allowed.sum(1, keepdims=True)
    loglik = np.zeros(len(texts))
    busy = np.arange(len(texts))
    for _ in range(ROUNDS):
        n = begin[texts[busy] + 1] - begin[texts[busy]]
        at = np.cumsum(n) - n
        rows = likely[np.arange(n.sum()) + np.repeat(begin[texts[busy]] - at, n)] * np.repeat(theta[busy], n, axis=0)
        total = np.maximum(rows.sum(1), 1e-300)
        loglik[busy] = np.add.reduceat(np.log(total), at)
        new = np.add.reduceat(rows / total[:, None], at, axis=0) / n[:, None]
        moved = np.abs(new - theta[busy]).max(1) > SETTLED
        theta[busy] = new
        busy = busy[moved]
        if not len(busy):
            break
    return theta, loglik


def train(docs: DataFrame, train_docs: int = 2000) -> Model:
    """Trigram model of each language from documents with a language that are not held out.

    ``train_docs``: about so many whole documents per language are read, chosen by a hash of their id; of languages with
    fewer, all. The driver gets the counts, at most one per language and bucket."""
    told = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    n = {r["lang"]: r["count"] for r in told.groupBy("lang").count().collect()}
    languages = sorted(n)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    parts = 1 << 30
    limit = F.create_map(*[F.lit(x) for k in languages for x in (k, min(parts, parts * train_docs // n[k]))])
    chosen = told.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(parts)) < limit[F.col("lang")]).select("lang", "text")
    counts = chosen.mapInArrow(_count(languages), "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((1 << BITS, len(languages)))
    table[counts["bucket"], counts["lang"]] = counts["n"]
    seen = max(1, int((table.sum(1) > 0).sum()))
    return Model(languages, np.log((table + 0.5) / (table.sum(0) + 0.5 * seen)).astype(np.float32))


def identify_language(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, languages.

    ``lang_pred`` is the language with the largest share, ``score`` that share (if the document has but one language,
    its posterior against the others), ``languages`` all shares, largest first, as ``en:0.75,fr:0.25``.

    * Null texts, texts without a letter, and any text if no language was learned: ``und``, score 0, no languages.
    * Ties go to the language that sorts first. Repeated rows are each answered; a null doc_id is not held out.
    * An empty table gives no rows. Other columns are ignored whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array(["und", *m.languages], object)
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                share, n, certain = m.shares(part.column("text"))
                known = (n > 0) & bool(m.languages)
                first = share.argmax(1) if m.languages else np.zeros(len(n), np.int64)
                score = share.max(1) * certain if m.languages else np.zeros(len(n))
                mixed = [",".join(f"{m.languages[i]}:{s[i]:.2f}" for i in np.argsort(-s, kind="stable") if s[i] > 0) for s in share]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("held_out"), pa.array(names[np.where(known, first + 1, 0)].tolist(), pa.string()),
                    pa.array(np.where(known, np.clip(score, 0, 1), 0.0)), pa.array(mixed, pa.string())],
                    names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, languages string")


def fit_and_identify(docs: DataFrame, train_docs: int = 2000) -> DataFrame:
    return identify_language(docs, train(docs, train_docs))
