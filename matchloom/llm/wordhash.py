"""Word hashes of Arrow text columns, computed on their buffers with numpy; used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SEPARATORS = [0x20, *range(0x09, 0x0E)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd
SPAN = 1 << 21  # bytes hashed at once


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text; a longer text is a run of its own."""
    sizes = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    ends = np.cumsum(pa.compute.binary_length(sizes).to_numpy(zero_copy_only=False)) if len(sizes) else np.zeros(0)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def word_hashes(texts: pa.Array, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words with A-Z lowered, and where each text's words begin (one more entry at the end).

    Null texts have no words. ``letters_only`` lets every ASCII byte that is no letter or digit be a separator too.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    is_sep = np.zeros(256, bool)
    is_sep[_SEPARATORS] = True
    if letters_only:
        is_sep[:128] = [not chr(b).isalnum() for b in range(128)]
    sep = is_sep[data]
    begin = ~sep
    begin[1:] &= sep[:-1] | False
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begin[inner] |= ~sep[inner]
    starts = np.flatnonzero(begin)
    del begin
    per_text = np.searchsorted(starts, offsets)
    out = np.empty(len(starts), np.uint64)
    weight = np.where(is_sep, U64(0), _BYTE[_LOWER])
    w = 0
    while w < len(starts):
        first = starts[w]
        to = max(w + 1, int(np.searchsorted(starts, first + SPAN)))
        last = starts[to] if to < len(starts) else len(data)
        at = starts[w:to] - first
        lengths = np.diff(np.append(at, last - first))
        place = np.arange(last - first) - np.repeat(at, lengths)
        out[w:to] = np.add.reduceat(weight[data[first:last]] * _powers(int(lengths.max()))[place], at)
        w = to
    return mix(out), per_text


_SHINGLE = _RNG.integers(1, 2**62, 16, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; a text of fewer words has its whole sequence as one."""
    words, per_text = word_hashes(texts)
    n = max(0, len(words) - k + 1)
    joined = np.zeros(n, np.uint64)
    for j in range(k):
        joined += words[j : j + n] * _SHINGLE[j]
    joined = mix(joined)
    out = []
    for a, b in zip(per_text[:-1].tolist(), per_text[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(joined[a : b - k + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _SHINGLE[: b - a]).sum(dtype=np.uint64, keepdims=True) + _SHINGLE[10 + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
