"""Benchmark decontamination by spaced-seed hashing.

A mask picks some word positions and ignores the others; two texts whose picked words agree have equal hashes there even
if ignored words were replaced. Hashes of all benchmark positions under all masks are met by those of all document
positions, and around each hit the words are compared one by one. The four masks leave no gap: whichever three words of
a 13-word window are replaced, one of the masks still fits on kept words, so the result is exact.

The benchmark is sent to the tasks in blocks of bounded size; with a larger benchmark the documents are read once per
block. Documents are not shuffled. Equal benchmark texts are looked for once, and of places in one text whose
neighbourhood is the same word for word only the first is compared, so repetitive texts cost no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import text_of, word_count
from matchloom.llm.wordhash import U64, mix, slices, word_hashes
from matchloom.session import materialize

MASKS = ((0, 2, 5, 8, 9), (0, 1, 3, 5, 6), (0, 1, 2, 5, 7), (0, 1, 3, 7, 9))
WINDOW, AGREE, SHORTEST = 13, 10, 8  # words of a window, of them equal, and least words of an item
_FACTOR = np.random.Generator(np.random.PCG64(7)).integers(1, 2**62, (len(MASKS), 5), dtype=np.uint64) * U64(2) + U64(1)
_BITS = 22
_AROUND = np.random.Generator(np.random.PCG64(8)).integers(1, 2**62, 2 * WINDOW - 1, dtype=np.uint64) * U64(2) + U64(1)
_OUTSIDE = U64(0x9E3779B97F4A7C15)  # stands for the words beyond a text's ends
_PAIRS = 1 << 17  # pairs of places compared at a time


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(pc.utf8_lower(texts), letters_only=True)


def _seeds(words: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the picked words for every position at which the whole mask fits."""
    n = max(0, len(words) - MASKS[mask][-1])
    out = np.zeros(n, np.uint64)
    for place, factor in zip(MASKS[mask], _FACTOR[mask]):
        out += words[place : place + n] * factor
    return mix(out + U64(mask))


def _first_of_kind(words: np.ndarray, begin: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the ascending places ``at`` are the first of their text with these very words around them, as far as any
    window over the place reaches."""
    hashes = []
    for s in range(0, len(at), _PAIRS):
        a, t = at[s : s + _PAIRS], text[s : s + _PAIRS]
        total = t.astype(np.uint64) * _OUTSIDE
        for factor, shift in zip(_AROUND, range(1 - WINDOW, WINDOW)):
            here = a + shift
            inside = (here >= begin[t]) & (here < begin[t + 1])
            total += np.where(inside, words[np.clip(here, 0, len(words) - 1)], _OUTSIDE) * factor
        hashes.append(mix(total))
    return np.sort(np.unique(np.concatenate(hashes), return_index=True)[1]) if hashes else np.zeros(0, np.int64)


def _best(t, i, first, best):
    """One row per text and item: most agreeing words, then the first window."""
    order = np.lexsort((first, -best, i, t))
    t, i, first, best = t[order], i[order], first[order], best[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (i[1:] != i[:-1])
    return t[new], i[new], first[new], best[new]


@dataclass
class Index:
    """One block of benchmark items: their words, and their seeds sorted by hash."""

    ids: np.ndarray
    words: np.ndarray
    begin: np.ndarray  # of each item in words, one more at the end
    keys: np.ndarray
    place: np.ndarray  # in words, of the seed's first position
    maybe: np.ndarray  # by the hash's first bits: any seed there?

    @classmethod
    def build(cls, ids, texts) -> Index:
        words, begin = _words(pa.array(texts, pa.string()))
        item = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        keys, place = [], []
        for m, mask in enumerate(MASKS):
            seeds = _seeds(words, m)
            at = np.arange(len(seeds))
            inside = (item[at] == item[at + mask[-1]]) & (np.diff(begin)[item[at]] >= SHORTEST)
            at = at[inside]
            at = at[_first_of_kind(words, begin, item[at], at)]
            keys.append(seeds[at])
            place.append(at)
        key, where = np.concatenate(keys), np.concatenate(place)
        order = np.argsort(key, kind="stable")
        maybe = np.zeros(1 << _BITS, bool)
        maybe[key >> U64(64 - _BITS)] = True
        return cls(np.array(ids, np.int64), words, begin, key[order], where[order], maybe)

    def matches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word of the window in the text, agreeing words) for every text and item that share a
        window; of several windows the one with most agreeing words, then the first."""
        words, begin = _words(texts)
        at, lo, n = [], [], []
        for m in range(len(MASKS)):
            seeds = _seeds(words, m)
            hits = np.flatnonzero(self.maybe[seeds >> U64(64 - _BITS)])
            left, right = np.searchsorted(self.keys, seeds[hits], "left"), np.searchsorted(self.keys, seeds[hits], "right")
            some = np.flatnonzero(right > left)
            some = some[_first_of_kind(words, begin, np.searchsorted(begin, hits[some], "right") - 1, hits[some])]
            at.append(hits[some])
            lo.append(left[some])
            n.append((right - left)[some])
        at, lo, n = np.concatenate(at), np.concatenate(lo), np.concatenate(n)
        order = np.argsort(at, kind="stable")  # the masks' equal pairs come together
        at, lo, ends = at[order], lo[order], np.cumsum(n[order])
        out = tuple(np.zeros(0, np.int64) for _ in range(4))
        for s in range(0, int(ends[-1]) if len(ends) else 0, _PAIRS):
            k = np.arange(s, min(s + _PAIRS, ends[-1]))
            hit = np.searchsorted(ends, k, "right")
            found = self.place[lo[hit] + k - np.where(hit > 0, ends[hit - 1], 0)]
            pair = np.unique(np.stack([at[hit], found], 1), axis=0)
            text = np.searchsorted(begin, pair[:, 0], "right") - 1
            item = np.searchsorted(self.begin, pair[:, 1], "right") - 1
            out = _best(*(np.concatenate(x) for x in zip(out, self._verify(words, begin, pair, text, item))))
        return out

    def _verify(self, words, begin, pair, text, item):
        """Windows around the hits that agree well enough."""
        length = np.minimum(WINDOW, self.begin[item + 1] - self.begin[item])
        need = np.where(length < WINDOW, length, AGREE)
        shift = np.arange(-WINDOW + 1, 2 * WINDOW - 1)
        here, there = pair[:, 0][:, None] + shift, pair[:, 1][:, None] + shift
        inside = (
            (here >= begin[text][:, None]) & (here < begin[text + 1][:, None])
            & (there >= self.begin[item][:, None]) & (there < self.begin[item + 1][:, None]))
        same = inside & (words[np.clip(here, 0, max(len(words) - 1, 0))] == self.words[np.clip(there, 0, max(len(self.words) - 1, 0))])
        agreed = np.concatenate([np.zeros((len(pair), 1), np.int64), np.cumsum(same, 1)], 1)
        fits = np.concatenate([np.zeros((len(pair), 1), np.int64), np.cumsum(inside, 1)], 1)
        starts = np.arange(WINDOW)
        ends = starts[None, :] + length[:, None]
        count = np.take_along_axis(agreed, ends, 1) - agreed[:, :WINDOW]
        whole = np.take_along_axis(fits, ends, 1) - fits[:, :WINDOW] == length[:, None]
        count = np.where(whole, count, 0)
        best = count.argmax(1)
        top = count[np.arange(len(pair)), best]
        good = top >= need
        return text[good], item[good], (pair[:, 0] - begin[text])[good] + best[good] - WINDOW + 1, top[good]


def _distinct(benchmark: DataFrame) -> DataFrame:
    """(rep, text): each benchmark text once, under a number of its own."""
    return materialize(benchmark.where("text IS NOT NULL").select("text").distinct().withColumn("rep", F.monotonically_increasing_id()), "bench-texts")


def _indexes(texts: DataFrame, block_words: int) -> Iterator:
    """Broadcast index blocks of distinct texts. Their number follows the benchmark's size; one block is on the driver at a time."""
    words = texts.agg(F.coalesce(F.sum(word_count(text_of())), F.lit(0))).first()[0]
    blocks = -(-words // block_words)
    for b in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        yield texts.sparkSession.sparkContext.broadcast(Index.build([r["rep"] for r in rows], [r["text"] for r in rows]))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, block_words: int = 1 << 18) -> DataFrame:
    """(doc_id, item_id, first_word, agreeing): documents and the benchmark items that they hold passages of.

    Words: lower case; ASCII characters other than letters and digits separate. A document holds a passage of an item if
    13 words in a row agree in 10 places at least with 13 in a row of the item, place by place; an item of 8 to 12 words
    must occur whole; shorter items tell nothing. One row per document and item: of its windows the one that agrees in
    most places, then the first; ``first_word`` counts the document's words from 0.

    * Null and empty texts, on either side, hold nothing. Null ids stay null and count as an id.
    * Repeated documents or items give one row: the best over all rows of that id.
    * Empty tables give no rows. Other columns are ignored whatever their names.

    ``block_words``: words of the benchmark in one broadcast.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema, found_schema = (f"doc_id long, {k} long, first_word long, agreeing long" for k in ("item_id", "rep"))
    out = None

    def pairs(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    t, i, first, best = index.value.matches(part.column("text"))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(t, pa.int64())), pa.array(index.value.ids[i], pa.int64()),
                         pa.array(first, pa.int64()), pa.array(best, pa.int64())], names=["doc_id", "rep", "first_word", "agreeing"])
        return run

    items = _distinct(benchmark)
    for index in _indexes(items, block_words):
        found = texts.mapInArrow(pairs(index), found_schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    members = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").join(items, "text").select("rep", "item_id").distinct()

    def best(df, *keys):
        top = df.groupBy(*keys).agg(F.max(F.struct("agreeing", (-F.col("first_word")).alias("f"))).alias("m"))
        return top.select(*keys, (-F.col("m.f")).alias("first_word"), F.col("m.agreeing").alias("agreeing"))

    return best(best(out, "doc_id", "rep").join(members, "rep"), "doc_id", "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_words: int = 1 << 18) -> DataFrame:
    """The documents that hold no passage of any item (see ``contaminated_pairs``), with all their columns, unshuffled."""
    def clean(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[index.value.matches(part.column("text"))[0]] = False
                    yield part.filter(pa.array(keep))
        return run

    for index in _indexes(_distinct(benchmark), block_words):
        docs = docs.mapInArrow(clean(index), docs.schema)
    return docs
