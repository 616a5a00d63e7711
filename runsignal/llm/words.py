"""Words of a batch of texts as numpy arrays, computed on the UTF-8 bytes.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``.  All six separators are single bytes that occur in no
longer UTF-8 sequence, so bytes are enough.  Every word gets a 64-bit hash: equal words have equal
hashes, different words collide with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text taken at a time; a longer text is taken alone
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, as many as the longest chunk needs."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
        return self.up, self.down


@dataclass
class Words:
    """``first[d]:first[d + 1]`` are the words of text d; start and end are byte offsets in ``data``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, so that temporary arrays stay small."""
    sizes = np.nan_to_num(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words_of(texts: pa.Array, powers: Powers, lower: bool = False, separators: np.ndarray | None = None) -> Words:
    """Words of every text; a null text has none.  ``separators``: a table of the bytes that end a word, white space among them."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if texts.null_count:  # bytes under a null are not part of a text
        keep = np.repeat(~texts.is_null().to_numpy(zero_copy_only=False), np.diff(offsets))
        sizes = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
        data, offsets = data[keep], np.concatenate(([0], np.cumsum(sizes)))
    if lower:
        data = _LOWER[data]
    size = len(data)
    space = (_SPACE if separators is None else separators)[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(data, start, end, first, np.zeros(0, np.uint64))
    up, down = powers.upto(size)
    code = _CODE[data]
    if separators is not None:
        code[space] = 0
    code *= up[:size]
    # A segment runs to the next word's start: separators count nothing.
    value = np.add.reduceat(code, start) * down[start]
    return Words(data, start, end, first, mix(value + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words inside one text, and the index of its first word."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(n - k + 1)
    at = at[at + k <= np.repeat(w.first[1:], w.counts)[: n - k + 1]]
    return mix(run_hash(w.hash, at, k)), at


def run_hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Combined hash of h[at : at + k] (order counts), before mixing."""
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[at + j]
    return out
