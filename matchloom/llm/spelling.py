"""Spelling variants by a trie over letter counts.

A word is a vector: its length, then how often each letter group occurs. All vectors form a trie, one level per entry.
Two words one edit apart differ by a surplus of at most one letter and a deficit of at most one, so a depth-first search
that may spend one of each finds every leaf where a near word can stand; the words there are compared letter by letter.

The trie is never in one place. Counts per node, taken level by level in Spark, cut it into subtrees of bounded size;
the part above the cuts is small and sends every word to the subtrees it can reach, each subtree is searched by a task
that streams its visitors, and what they found is summed up per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import sent_if_small, text_of
from matchloom.session import materialize

LETTERS = "etaoinshrdlucmfwypvbgkjqxz"  # one group each, common ones first; all other letters share the last groups
OTHERS = 6
LEVELS = 1 + len(LETTERS) + OTHERS  # level 0 is the length
STEP = 6  # levels that one counting job looks at
LEAF = 12  # nodes with so few words are not split further within a task
BLOCK = 1 << 16  # search states or compared pairs at once
_GROUP = np.full(128, 255, np.uint8)
for _i, _c in enumerate(LETTERS):
    _GROUP[ord(_c)] = _i
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "word string, n_near long, best_n long, best string"


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, thin: int = 97) -> DataFrame:
    """word, n: letter runs of whole texts, A-Z lowered, of at least so many code points and occurrences.

    Where ``thin`` divides the CRC-32 of ``<doc_id>:<run>``, the run loses the code point at that number modulo its length."""
    run = F.explode(F.regexp_extract_all(text_of(), F.lit(RUN), F.lit(0)))
    raw = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    low = raw.select("id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % thin == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and the length of each word."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), n


def vectors(words: list[str]) -> np.ndarray:
    """One row of LEVELS counts per word."""
    points, n = code_points(words)
    group = np.where(points < 128, _GROUP[np.minimum(points, 127)], 255).astype(np.int64)
    group = np.where(group == 255, len(LETTERS) + points % OTHERS, group)
    flat = np.repeat(np.arange(len(words)) * LEVELS, n) + 1 + group
    out = np.bincount(flat, minlength=len(words) * LEVELS).reshape(len(words), LEVELS)
    out[:, 0] = n
    return out


class Trie:
    """Sorted child keys per level (parent * span + count; parents are numbered among the inner nodes of their level).

    ``leaf[level]`` names the leaf that a node is, -1 for inner nodes."""

    def __init__(self, keys: list[np.ndarray], span: list[int], leaf: list[np.ndarray]):
        self.keys, self.span, self.leaf = keys, span, leaf

    @staticmethod
    def of_paths(paths: list[tuple[int, ...]]) -> Trie:
        """A trie whose leaf ``i`` ends path ``i``; no path begins another one."""
        order = sorted(range(len(paths)), key=lambda i: paths[i])
        keys, span, leaf = [], [], []
        node = np.zeros(len(order), np.int64)
        deep = np.array([len(paths[i]) for i in order])
        for level in range(int(deep.max(initial=0))):
            here = deep > level
            count = np.array([paths[i][level] if len(paths[i]) > level else 0 for i in order], np.int64)
            span.append(int(count.max()) + 3)
            at, inverse = np.unique(node[here] * span[-1] + count[here], return_inverse=True)
            node[here] = inverse
            ends = np.full(len(at), -1, np.int64)
            last = deep == level + 1
            ends[node[last]] = np.array(order)[last]
            keys.append(at)
            leaf.append(ends)
            node[here] = (np.cumsum(ends < 0) - 1)[node[here]]
        return Trie(keys, span, leaf)

    @staticmethod
    def of_vectors(rows: np.ndarray) -> tuple[Trie, np.ndarray, np.ndarray]:
        """The trie of all rows, their order in it, and where each leaf begins in that order (one more entry at the end).

        A node with at most LEAF rows, or at the last level, is a leaf."""
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        keys, span, leaf = [], [], []
        begin = np.zeros(1, np.int64)  # first row of each inner node
        end = np.full(1, len(rows), np.int64)
        starts: list[np.ndarray] = []
        n_leaves = 0
        for level in range(LEVELS):
            if not len(begin):
                break
            size = end - begin
            at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
            parent = np.repeat(np.arange(len(begin)), size)
            span.append(int(rows[at, level].max(initial=0)) + 3)
            key, first, n = np.unique(parent * span[-1] + rows[at, level], return_index=True, return_counts=True)
            keys.append(key)
            is_leaf = (n <= LEAF) | (level == LEVELS - 1)
            leaf.append(np.where(is_leaf, n_leaves + np.cumsum(is_leaf) - 1, -1))
            starts.append(np.stack([at[first[is_leaf]], at[first[is_leaf]] + n[is_leaf]]))
            n_leaves += int(is_leaf.sum())
            begin, end = at[first[~is_leaf]], at[first[~is_leaf]] + n[~is_leaf]
        return Trie(keys, span, leaf), order, np.concatenate(starts, axis=1) if starts else np.zeros((2, 0), np.int64)

    def reach(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, leaf, own) for every leaf that holds or may hold a vector at most one surplus and one deficit away.

        Only as long as the row or one longer: of two near words the shorter one, or either of equal ones, finds the other.
        ``own``: nothing was spent, so it is the row's own leaf."""
        n = len(rows)
        start = np.repeat([False, True], n)
        q = np.tile(np.arange(n), 2)
        stack = [(1, *self._child(0, q, np.zeros(2 * n, np.int64), rows[q, 0] + start, np.zeros(2 * n, bool), np.zeros(2 * n, bool), start))]
        while stack:
            level, q, node, plus, minus, longer = stack.pop()
            if len(q) > BLOCK:
                half = len(q) // 2
                stack += [(level, *(x[cut] for x in (q, node, plus, minus, longer))) for cut in (slice(None, half), slice(half, None))]
                continue
            leaf = self.leaf[level - 1][node]
            at = leaf >= 0
            if at.any():
                yield q[at], leaf[at], ~(plus | minus | longer)[at]
            q, node, plus, minus, longer = (x[~at] for x in (q, node, plus, minus, longer))
            if not len(q):
                continue
            node = (np.cumsum(self.leaf[level - 1] < 0) - 1)[node]  # numbers among the inner nodes
            count = rows[q, level]
            more, less = np.flatnonzero(~plus), np.flatnonzero(~(minus | longer) & (count > 0))
            again = np.concatenate([np.arange(len(q)), more, less])
            change = np.repeat([0, 1, -1], [len(q), len(more), len(less)])
            stack.append((level + 1, *self._child(
                level, q[again], node[again], count[again] + change, plus[again] | (change == 1), minus[again] | (change == -1), longer[again])))

    def _child(self, level: int, q: np.ndarray, node: np.ndarray, count: np.ndarray, *spent: np.ndarray) -> tuple[np.ndarray, ...]:
        """Goes on to the children with these counts; states without such a child end."""
        if level >= len(self.keys) or not len(self.keys[level]):
            return tuple(x[:0] for x in (q, node, *spent))
        key = node * self.span[level] + count
        at = np.minimum(np.searchsorted(self.keys[level], key), len(self.keys[level]) - 1)
        there = (self.keys[level][at] == key) & (count < self.span[level])
        return tuple(x[there] for x in (q, at, *spent))


@dataclass
class Words:
    """Words with their counts and vectors; code points padded with 0 on the right and on the left, and their sums.

    The words of a subtree have one length, its visitors that or one less, so the padding is small."""

    words: list[str]
    n: np.ndarray
    rows: np.ndarray
    left: np.ndarray
    right: np.ndarray
    total: np.ndarray

    @staticmethod
    def of(words: list[str], n: np.ndarray, width: int = 0) -> Words:
        points, length = code_points(words)
        width = max(width, int(length.max(initial=0)))
        place = np.arange(len(points)) - np.repeat(np.cumsum(length) - length, length)
        row = np.repeat(np.arange(len(words)), length)
        left, right = np.zeros((len(words), width), np.uint32), np.zeros((len(words), width), np.uint32)
        left[row, place] = points
        right[row, place + width - length[row]] = points
        return Words(words, n, vectors(words), left, right, left.sum(1, dtype=np.int64))

    @property
    def width(self) -> int:
        return self.left.shape[1]


def near(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether word ``j`` is word ``i`` with exactly one letter replaced by a greater one, or one letter more; both have one width.

    So of two near words exactly one meets the other. Words apart in one letter are ordered as the sums of their letters."""
    length, gap = a.rows[i, 0], b.rows[j, 0] - a.rows[i, 0]
    out = np.zeros(len(i), bool)
    step = max(1, (BLOCK * 16) // max(a.width, 1))
    for one, some in ((0, np.flatnonzero((gap == 0) & (a.total[i] < b.total[j]))), (1, np.flatnonzero(gap == 1))):
        for k in range(0, len(some), step):
            s = some[k : k + step]
            differ = a.left[i[s]] != b.left[j[s]]
            if one:
                out[s] = differ.argmax(1) + (a.right[i[s]] != b.right[j[s]])[:, ::-1].argmax(1) >= length[s]
            else:
                out[s] = differ.sum(1) == 1
    return out


def _best(words: list[str], keys: list[str], key: np.ndarray, other: np.ndarray, other_n: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    """Per key the number of near words and the most frequent of them, ties to the smallest."""
    order = np.lexsort((rank[other], -other_n[other], key))
    key, other = key[order], other[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(first, len(key)))
    return pa.RecordBatch.from_arrays(
        [pa.array([keys[i] for i in key[first]], pa.string()), pa.array(count, pa.int64()), pa.array(other_n[other[first]], pa.int64()),
         pa.array([words[i] for i in other[first]], pa.string())], names=["word", "n_near", "best_n", "best"])


def _rank(words: list[str]) -> np.ndarray:
    out = np.empty(len(words), np.int64)
    out[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    return out


class Subtree:
    """The words of one subtree, asked for the near words of visitors."""

    def __init__(self, own: Words):
        self.own, self.rank = own, _rank(own.words)
        self.trie, self.order, self.bounds = Trie.of_vectors(own.rows)

    def visit(self, who: Words) -> Iterator[pa.RecordBatch]:
        """What the visitors (or the own words themselves) and the own words learn from each other."""
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for q, leaf, _ in self.trie.reach(who.rows):
            begin, size = self.bounds[0][leaf], self.bounds[1][leaf] - self.bounds[0][leaf]
            upto = np.cumsum(size)
            for lo in range(0, int(upto[-1]), 8 * BLOCK):  # pairs of a visitor and a word of a leaf, in blocks
                pair = np.arange(lo, min(lo + 8 * BLOCK, int(upto[-1])))
                state = np.searchsorted(upto, pair, "right")
                i, j = q[state], self.order[pair - (upto - size)[state] + begin[state]]
                ok = near(who, i, self.own, j)
                hits.append((i[ok], j[ok]))
            if sum(len(h[0]) for h in hits) > 8 * BLOCK:
                yield from self._told(who, hits)
                hits = []
        if sum(len(h[0]) for h in hits):
            yield from self._told(who, hits)

    def _told(self, who: Words, hits: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        i, j = (np.concatenate(x) for x in zip(*hits))
        yield _best(self.own.words, who.words, i, j, self.own.n, self.rank)
        yield _best(who.words, self.own.words, j, i, who.n, _rank(who.words))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by subtree, its own words first, then the visitors, of which one batch at a time is held."""
    cell, pending, tree = None, [], None

    def close():
        t = tree or (Subtree(_words(pa.concat_batches(pending))) if pending else None)
        if t is not None:
            yield from t.visit(t.own)

    for batch in batches:
        cells, own = batch.column("cell").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (own[1:] != own[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
            if a == b:
                continue
            if cells[a] != cell:
                yield from close()
                cell, pending, tree = cells[a], [], None
            part = batch.slice(a, b - a)
            if own[a]:
                pending.append(part)
            elif pending:  # a subtree without words of its own has nothing to tell
                tree = tree or Subtree(_words(pa.concat_batches(pending)))
                yield from tree.visit(_words(part, tree.own.width))
    yield from close()


def _words(batch: pa.RecordBatch, width: int = 0) -> Words:
    return Words.of(batch.column("word").to_pylist(), batch.column("n").to_numpy(), width)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = vectors(batch.column("word").to_pylist()).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * LEVELS, pa.int32()), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), lists], names=["word", "n", "counts"])


def subtrees(counted: DataFrame, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Paths of the subtrees of at most ``most`` words, and into how many parts each is dealt (1 but for larger last-level leaves).

    Each job counts the nodes of STEP levels below the nodes that are still too large; only subtrees with a too large
    parent come to the driver, a few per ``most`` words."""
    def key(level: int) -> Column:
        return F.concat_ws(".", F.slice("counts", 1, level))

    out, rows, level = [], counted, 0
    while True:
        deep = range(level + 1, min(level + STEP, LEVELS) + 1)
        nodes = rows.select(F.explode(F.array(*[
            F.struct(F.lit(d).alias("level"), key(d).alias("node"), key(d - 1).alias("parent")) for d in deep])).alias("x")).select("x.*")
        nodes = materialize(nodes.groupBy("level", "node", "parent").count(), "spelling-nodes")
        large = nodes.where(F.col("count") > most).select((F.col("level") + 1).alias("level"), F.col("node").alias("parent"))
        below = nodes.where(F.col("level") == level + 1).unionByName(nodes.join(sent_if_small(large), ["level", "parent"], "left_semi"))
        for r in below.where((F.col("count") <= most) | (F.col("level") == LEVELS)).collect():
            out.append((tuple(map(int, r["node"].split("."))), -(-r["count"] // most)))
        level = deep[-1]
        left = nodes.where((F.col("level") == level) & (F.col("count") > most)).select(F.col("node").alias("open"))
        if level == LEVELS or left.isEmpty():
            return sorted(out)
        rows = rows.join(sent_if_small(left), key(level) == F.col("open"), "left_semi")


def near_words(words: DataFrame, most: int = 4096) -> DataFrame:
    """word, n_near, best_n, best of every word that has a near word: how many, and the most frequent (ties to the smallest).

    ``words``: distinct word, n. ``most``: words of a subtree; of more than 2^14 times as many words, 2^-14 of them."""
    counted = materialize(words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(
        _count, "word string, n long, counts array<int>"), "spelling-words")
    cuts = subtrees(counted, max(most, counted.count() >> 14))
    parts = np.array([p for _, p in cuts], np.int64)
    base = np.cumsum(parts) - parts
    top = words.sparkSession.sparkContext.broadcast((Trie.of_paths([p for p, _ in cuts]), parts, base))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, parts, base = top.value
        for whole in batches:
            for batch in (whole.slice(k, 2048) for k in range(0, whole.num_rows, 2048)):
                rows = vectors(batch.column("word").to_pylist())
                home = np.frombuffer(batch.column("home").to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), np.int64)
                for q, leaf, own in trie.reach(rows):
                    n = parts[leaf]
                    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    who = np.repeat(q, n)
                    cell = np.repeat(base[leaf], n) + part
                    mine = np.repeat(own, n) & (home[who] % np.repeat(n, n) == part)
                    take = batch.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(mine), take.column("word"), take.column("n")],
                                                     names=["cell", "own", "word", "n"])

    home = F.pmod(F.xxhash64("word"), F.lit(1 << 40)).alias("home")
    sent = counted.select("word", "n", home).mapInArrow(route, "cell long, own boolean, word string, n long")
    told = sent.repartition("cell").sortWithinPartitions("cell", F.desc("own")).mapInArrow(_search, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b")
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def group_variants(words: DataFrame, ratio: int = 2, most: int = 4096) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (distinct word, n).

    Words are near if one inserted, deleted or replaced code point makes one the other. ``form`` is the near word of
    largest n, ties to the smallest in code-point order, if that n is at least ``ratio`` times the word's; ``root`` the end
    of the chain of forms. With ratio 2 a chain at least doubles n at each step, so it is short.
    """
    words = materialize(words.select("word", "n"), "spelling-vocabulary")
    told = words.join(near_words(words, most), "word", "left")
    good = F.col("best_n") >= ratio * F.col("n")
    formed = materialize(told.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"),
        F.when(good, F.col("best_n")).alias("form_n")), "spelling-forms")
    up = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # every round doubles how far each word has followed its chain
        above = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        up = materialize(up.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")),
                         "spelling-roots")
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    return formed.join(up.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, **options) -> DataFrame:
    """The variants among all words of ``docs``; one row per word of ``vocabulary``.

    * Null and empty texts have no words; a null doc_id counts as an empty id in the hash that thins words.
    * Repeated rows count each time. Ties of n go to the smallest word. A run of any length is one word.
    * An empty table, or no word frequent enough, gives no rows. Other columns are ignored whatever their names.
    """
    return group_variants(vocabulary(docs), **options)
