"""Benchmark items in documents within an edit distance: CGK embedding, bit-sampling LSH, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Powers, chunks, mix, run_hash, words_of

FILTER = 1 << 22  # entries of the bit tables that most words and keys are ruled out by


@dataclass(frozen=True)
class Leaks:
    """An item of n words is in a document if some window of it is at most floor(n * edits / 100) word edits away.

    ``repeats`` walks with ``samples`` sampled steps each reach the target recall: 0.99 over all distances allowed, as the
    tests measure.  Items under ``least`` words
    are too short for walks; they are looked up by pieces, of which one is always left whole, so none is missed.  ``block``: words of items sent to the tasks at a time.
    """

    edits: int = 20
    repeats: int = 48
    samples: int = 3
    least: int = 8
    longest_walk: int = 64
    block: int = 500_000

    def allowed(self, n: int) -> int:
        return n * self.edits // 100

    def size_class(self, n: int) -> int:
        """Items of about the same length share one window size."""
        return int(np.log(n / self.least) / np.log(1.25))

    def starts(self, n: int) -> np.ndarray:
        """Words of an item at which walks start.  A walk gets through about half as many words as it has steps, so a long item
        gets as many starts as cover it: in one of the stretches at most the average share of words is edited.  The last start
        lies behind the words that may be missing where a text begins."""
        reach = self.longest_walk // 2
        last = max(self.allowed(n), n - reach)
        return np.unique(np.linspace(0, last, max(2, -(-n // reach))).astype(np.int64))


def leaked(docs: DataFrame, items: DataFrame, cfg: Leaks = Leaks()) -> DataFrame:
    """``(row, hits)`` for every row of docs: the row and an array of ``(item_id, distance)``, best first, empty if clean.

    Words are lower-cased (A-Z) runs of ``[^\\x20\\x09-\\x0D]``; distance counts inserted, dropped and replaced
    words of the closest window.  Null and empty texts have no hits; null and empty items hit nothing.  An item of one word
    hits every text that holds the word.
    Equal items hit alike, each under its id.  Items come in blocks of bounded size, and every document
    is held against each block.
    """
    out = docs.select(F.struct(*docs.columns).alias("row"), "text", F.array().cast(HITS).alias("hits"))
    size = F.length("text") - F.length(F.translate("text", " \t\n\x0b\f\r", "")) + 1
    n = items.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-n // cfg.block)
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text")
        out = _against(out, block.orderBy("item_id", "text").toArrow(), cfg)
    return out.select("row", "hits")


HITS = "array<struct<item_id:bigint,distance:int>>"


def _against(rows: DataFrame, block: pa.Table, cfg: Leaks) -> DataFrame:
    index = Index(block, cfg)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in chunks(batch):
                hits = part.column("hits").to_pylist()
                for d, found in index.search(words_of(part.column("text"), powers, lower=True)).items():
                    more = [{"item_id": i, "distance": e} for i, e in found]
                    hits[d] = sorted(hits[d] + more, key=lambda h: (h["distance"], h["item_id"]))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), pa.array(hits, kind)], names=["row", "text", "hits"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string, hits {HITS}")


class Index:
    """Items of one block: their words, the pairs of neighbouring words, and the sampled walks of each."""

    def __init__(self, block: pa.Table, cfg: Leaks) -> None:
        self.cfg = cfg
        text = block.column("text").combine_chunks() if block.num_rows else pa.array([], pa.string())
        w = words_of(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text, Powers(), lower=True)
        used = [d for d, n in enumerate(w.counts) if n]
        ids = block.column("item_id").to_pylist()
        self.ids = [ids[d] for d in used]
        self.words = [w.hash[w.first[d] : w.first[d + 1]] for d in used]
        self.classes: dict[int, list[int]] = {}
        short, long = ([i for i, x in enumerate(self.words) if (len(x) < cfg.least) == few] for few in (True, False))
        for i in long:
            self.classes.setdefault(cfg.size_class(len(self.words[i])), []).append(i)
        self.pieces = self._pieces(short)
        self.pairs = np.zeros(FILTER, bool)
        for x in (self.words[i] for i in long):
            self.pairs[pair_hash(x[:-1], x[1:]) % np.uint64(FILTER)] = True
        self.shape = {}
        self.keys, self.items, self.offsets = {}, {}, {}
        for c, members in self.classes.items():
            sizes = [len(self.words[i]) for i in members]
            window = max(n + cfg.allowed(n) for n in sizes)
            # Every edit breaks at most two of the item's n - 1 neighbouring pairs.
            need = min(n - 1 - 2 * cfg.allowed(n) for n in sizes)
            rng = np.random.default_rng(1000 + c)
            steps = rng.integers(0, min(min(sizes), cfg.longest_walk), (cfg.repeats, cfg.samples))
            flat = np.concatenate([np.append(self.words[i], np.zeros(cfg.longest_walk, np.uint64)) for i in members])
            first = np.cumsum([0] + [n + cfg.longest_walk for n in sizes[:-1]])
            starts = [cfg.starts(n) for n in sizes]
            count, offset = [len(x) for x in starts], np.concatenate(starts)
            self.shape[c] = window, need, np.sort(steps, axis=1), int(offset.max()) + max(map(cfg.allowed, sizes))
            key = sampled_walks(flat, np.repeat(first, count) + offset, self.shape[c][2])
            order = np.argsort(key.ravel(), kind="stable")
            self.keys[c] = key.ravel()[order]
            self.items[c], self.offsets[c] = (np.tile(x, cfg.repeats)[order] for x in (np.repeat(members, count), offset))
        self.masks: dict[int, dict[int, int]] = {}

    def _pieces(self, short: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By size: sorted hashes of pieces, their items and where in them they start.  k edits leave one of k + 1 pieces whole."""
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for i in short:
            x = self.words[i]
            edges = np.linspace(0, len(x), min(self.cfg.allowed(len(x)) + 1, len(x)) + 1).astype(int).tolist()
            for a, b in zip(edges, edges[1:]):
                rows.setdefault(b - a, []).append((int(run_hash(x, np.array([a]), b - a)[0]), i, a))
        columns = {size: list(zip(*sorted(r))) for size, r in rows.items()}
        return {size: (np.array(key, np.uint64), np.array(item), np.array(at)) for size, (key, item, at) in columns.items()}

    def search(self, w) -> dict[int, list[tuple[int, int]]]:
        """Per text: (item id, distance) of every item found."""
        best = self._by_walks(w)
        best.update(self._by_pieces(w))
        out: dict[int, list[tuple[int, int]]] = {}
        for (d, item), e in best.items():
            out.setdefault(d, []).append((self.ids[item], e))
        return out

    def _by_pieces(self, w) -> dict[tuple[int, int], int]:
        """Text and item -> distance, of the short items."""
        best: dict[tuple[int, int], int] = {}
        if not self.pieces:
            return best
        doc = w.doc
        for size, (keys, items, offsets) in self.pieces.items():
            at = np.arange(max(len(w.hash) - size + 1, 0))
            at = at[at + size <= w.first[doc[at] + 1]]
            key = run_hash(w.hash, at, size)
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            hit = np.flatnonzero(hi > lo)
            for p, d, i, to in zip(at[hit].tolist(), doc[at[hit]].tolist(), lo[hit].tolist(), hi[hit].tolist()):
                for item, offset in zip(items[i:to].tolist(), offsets[i:to].tolist()):
                    if best.get((d, item)) == 0:
                        continue
                    m = len(self.words[item])
                    k = self.cfg.allowed(m)
                    a, b = max(w.first[d], p - offset - k), min(w.first[d + 1], p - offset + m + k)
                    e = self.distance(item, w.hash[a:b].tolist()) if k else 0
                    if e <= k and e < best.get((d, item), k + 1):
                        best[d, item] = e
        return best

    def _by_walks(self, w) -> dict[tuple[int, int], int]:
        """Text and item -> distance, of the items that are long enough for walks."""
        cfg, n = self.cfg, len(w.hash)
        best: dict[tuple[int, int], int] = {}
        if n < 2 or not self.classes:
            return best
        known = self.pairs[pair_hash(w.hash[:-1], w.hash[1:]) % np.uint64(FILTER)]
        ends = w.first[1:-1]
        known[ends[(ends > 0) & (ends < n)] - 1] = False
        total = np.concatenate(([0], np.cumsum(known)))
        padded = np.append(w.hash, np.zeros(cfg.longest_walk, np.uint64))
        tried: dict[tuple[int, int], list[int]] = {}
        for c, (window, need, steps, far) in self.shape.items():
            at = np.flatnonzero(total[np.minimum(np.arange(n) + window - 1, n - 1)] - total[np.minimum(np.arange(n), n - 1)] >= need)
            if not len(at):
                continue
            # A walk from inside an item starts as far inside such a window, give or take the edits.
            edge = np.zeros(n + far + 1, np.int64)
            edge[at] += 1
            edge[at + far + 1] -= 1
            at = np.flatnonzero(np.cumsum(edge[:n]) > 0)
            key = sampled_walks(padded, at, steps).ravel()
            lo = np.searchsorted(self.keys[c], key)
            hit = np.flatnonzero(self.keys[c][np.minimum(lo, len(self.keys[c]) - 1)] == key)
            for h in hit:
                p, i = int(at[h % len(at)]), int(lo[h])
                d = int(np.searchsorted(w.first, p, "right")) - 1
                while i < len(self.keys[c]) and self.keys[c][i] == key[h]:
                    item, s = int(self.items[c][i]), p - int(self.offsets[c][i])
                    i += 1
                    k = cfg.allowed(len(self.words[item]))
                    places = tried.setdefault((d, item), [])
                    # What was looked at around a near place holds this one's windows as well.
                    if best.get((d, item)) == 0 or any(abs(s - q) <= k for q in places):
                        continue
                    places.append(s)
                    # The window may start and end some edits before or after where the hit puts it.
                    a, b = max(w.first[d], s - 3 * k), min(w.first[d + 1], s + len(self.words[item]) + 3 * k)
                    text = w.hash[a:b].tolist()
                    # k edits leave all but k of the item's words in place.
                    if sum(map(self.mask(item).__contains__, text)) < len(self.words[item]) - k:
                        continue
                    e = self.distance(item, text)
                    if e <= k and e < best.get((d, item), k + 1):
                        best[d, item] = e
        return best

    def mask(self, item: int) -> dict[int, int]:
        """Places of each of the item's words, as bits."""
        if item not in self.masks:
            masks: dict[int, int] = {}
            for i, x in enumerate(self.words[item].tolist()):
                masks[x] = masks.get(x, 0) | 1 << i
            self.masks[item] = masks
        return self.masks[item]

    def distance(self, item: int, text: list[int]) -> int:
        """Fewest word edits between the item and any window of the text (bit-parallel dynamic programming)."""
        masks, m = self.mask(item), len(self.words[item])
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, e = full, 0, m
        least = m
        for x in text:
            eq = masks.get(x, 0)
            v = eq | down
            h = (((eq & up) + up) ^ up) | eq
            more, less = down | ~(h | up) & full, up & h
            if more & top:
                e += 1
            elif less & top:
                e -= 1
            more, less = more << 1 & full, less << 1 & full
            up, down = less | ~(v | more) & full, more & v
            least = min(least, e)
        return least


def pair_hash(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * np.uint64(0x9FB21C651E98DF25) + y)


def sampled_walks(words: np.ndarray, starts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """(walks, starts) hashes of the words read at the sampled steps of a random walk from each start.

    The walk reads the word under its pointer, and moves on if that word's random bit for the step is set.  Equal words
    get equal bits, so two walks that differ by an edit fall into step again: few edits, few different reads.
    """
    out = np.zeros((len(steps), len(starts)), np.uint64)
    seed = (np.arange(1, len(steps) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for a in range(0, len(starts), 4096):
        at = np.tile(starts[a : a + 4096], (len(steps), 1))
        key = np.tile(np.arange(1, len(steps) + 1, dtype=np.uint64)[:, None], (1, at.shape[1]))
        for j in range(int(steps.max()) + 1):
            word = words[at]
            for column in steps.T:
                rows = np.flatnonzero(column == j)
                if len(rows):
                    key[rows] = pair_hash(key[rows], word[rows])
            at += (mix(word ^ seed) >> np.uint64(j % 64) & np.uint64(1)).astype(at.dtype)
        out[:, a : a + 4096] = key
    return out
