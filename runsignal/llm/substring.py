"""Repeated word windows across all documents, found with suffix automata over shards of the corpus itself.

The reference is the corpus, so automata over all of it can be neither built in one place nor sent to every
task.  It is cut into shards that need not know of each other: every window of ``window`` words belongs to
the smallest hash among its short grams (its anchor), and equal windows have equal anchors.  Only anchors that occur
twice or more matter.  A shard holds the segments (runs of windows) around one anchor.  A segment that repeats
whole goes by a group-by on its hash.  The first segment of each kind is streamed through the automaton of the earlier
ones, and where the matching statistic reaches the window length, the window has occurred before; in shards
of more kinds than an automaton takes, a group-by on the hashes of windows finds the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .words import Powers, Words, chunks, grams, mix, run_hash, words_of


@dataclass(frozen=True)
class Repeats:
    """``gram`` words an anchor.  A shard with over ``shard`` different segments is dealt out
    further, by whole window.  Tables with up to ``send`` spans are sent to the documents, larger ones are joined by
    document."""

    window: int = 20
    gram: int = 8
    shard: int = 4096
    send: int = 1_000_000


class Automaton:
    """Suffix automaton of several sequences, with the matching statistics of a sequence against it."""

    def __init__(self) -> None:
        self.go: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def match(self, seq: list) -> list[int]:
        """For every position, the length of the longest piece ending there that occurs in the automaton."""
        go, link, size = self.go, self.link, self.size
        at = n = 0
        out = []
        for x in seq:
            while at and x not in go[at]:
                at = link[at]
                n = size[at]
            if x in go[at]:
                at = go[at][x]
                n += 1
            out.append(n)
        return out

    def add(self, seq: list) -> None:
        last = 0
        for x in seq:
            last = self._step(last, x)

    def _step(self, last: int, x) -> int:
        go, link, size = self.go, self.link, self.size
        if x in go[last]:
            q = go[last][x]
            return q if size[q] == size[last] + 1 else self._split(last, x, q)
        new = self._state({}, size[last] + 1, 0)
        p = last
        while p >= 0 and x not in go[p]:
            go[p][x] = new
            p = link[p]
        if p >= 0:
            q = go[p][x]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, x, q)
        return new

    def _split(self, p: int, x, q: int) -> int:
        go, link, size = self.go, self.link, self.size
        new = self._state(dict(go[q]), size[p] + 1, link[q])
        link[q] = new
        while p >= 0 and go[p].get(x) == q:
            go[p][x] = new
            p = link[p]
        return new

    def _state(self, go: dict, size: int, link: int) -> int:
        self.go.append(go)
        self.size.append(size)
        self.link.append(link)
        return len(self.go) - 1


def without_repeats(docs: DataFrame, cfg: Repeats = Repeats()) -> DataFrame:
    """``(row, n_words, n_removed)`` for every row of docs: row is the whole row with its text cut.

    A word goes if a window of ``window`` words that covers it also starts earlier: in a smaller doc_id, or
    earlier in the same document.  Windows are judged on the input.  Pieces that stay keep their inner
    separators and are joined by one space; a document that loses nothing keeps its text as it is.  A null
    text stays null with 0 words.  Rows with a null doc_id lose nothing and remove nothing; rows with one
    doc_id start at the same places, so equal ones do not remove each other.
    """
    spans = repeated_spans(docs, cfg)
    left = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d_doc_id"), F.col("text").alias("d_text"))
    # Left outer, so every document comes through once.
    joined = _by_document(left, spans, cfg.send, "left").select("row", "d_text", "span_start", "span_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in chunks(batch, "d_text"):
                text = part.column("d_text")
                w = words_of(text, powers)
                starts, ends = part.column("span_start").to_pylist(), part.column("span_end").to_pylist()
                out, removed = text.to_pylist(), np.zeros(part.num_rows, np.int64)
                for d, s in enumerate(starts):
                    if s:
                        a, b = w.first[d], w.first[d + 1]
                        stay = ~covered(b - a, s, ends[d])
                        removed[d] = (b - a) - stay.sum()
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], stay.astype(np.int8), [0])))).reshape(-1, 2)
                        out[d] = " ".join(w.data[w.start[a + i] : w.end[a + j - 1]].tobytes().decode() for i, j in edge)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(out, pa.string()), pa.array(w.counts), pa.array(removed)], names=["row", "text", "n_words", "n_removed"])

    cut = joined.mapInArrow(run, f"row {left.schema['row'].dataType.simpleString()}, text string, n_words long, n_removed long")
    return cut.select(F.col("row").withField("text", F.col("text")).alias("row"), "n_words", "n_removed")


def covered(n: int, starts: list[int], ends: list[int]) -> np.ndarray:
    """Which of n words lie in one of the ranges."""
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, ends, -1)
    return np.cumsum(gone[:-1]) > 0


def repeated_spans(docs: DataFrame, cfg: Repeats) -> DataFrame:
    """``(s_doc, span_start, span_end)``: for every document that loses words, the word ranges that go."""
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    rows = segments(docs, cfg)
    # Written, so that the join is one of two shuffles, in which Spark splits an anchor that very many segments have.
    twice = written(rows.groupBy("anchor").agg(F.count("*").alias("n_anchor")).where("n_anchor > 1").select("anchor"), "anchors")
    rows = written(rows.join(twice, "anchor"), "segments")
    kinds = rows.groupBy("anchor", "seg", "n").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    kinds = written(kinds, "kinds")
    size = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = written(_content(docs, kinds.join(size, "anchor"), cfg), "shards")
    # A segment that is not the first of its kind goes whole.
    later = rows.join(kinds, ["anchor", "seg", "n"]).where("doc_id <> first.doc_id OR at <> first.at")
    later = later.select(F.col("doc_id").alias("s_doc"), F.col("at").alias("s"), (F.col("at") + F.col("n") + cfg.window - 1).alias("e"))
    shards = several.where(F.col("kinds") <= cfg.shard)
    partial = _streamed(shards.select("anchor", "doc_id", "at", "words"), cfg)
    # In the largest shards every window is a shard of its own, all of one kind.
    wide = several.where(F.col("kinds") > cfg.shard).select("doc_id", "at", F.posexplode("windows").alias("j", "value")).select("value", "doc_id", (F.col("at") + F.col("j")).alias("at"))
    first = wide.groupBy("value").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    again = wide.join(first, "value").where("doc_id <> first.doc_id OR at <> first.at")
    again = again.select(F.col("doc_id").alias("s_doc"), F.col("at").alias("s"), (F.col("at") + cfg.window).alias("e"))
    return written(_merged(later.unionByName(partial).unionByName(again)), "spans")


def segments(docs: DataFrame, cfg: Repeats) -> DataFrame:
    """``(anchor, seg, n, doc_id, at)``: runs of n windows with one anchor, from word ``at`` on; seg identifies the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in chunks(batch):
                w = words_of(part.column("text"), powers)
                value, place, head, n = anchored(w, cfg)
                whole = run_hash(w.hash, head, cfg.window), run_hash(w.hash, head + n - 1, cfg.window)
                # A segment is shorter than two windows: its first and its last one cover it.
                seg = mix(whole[0] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(whole[1]) + n.astype(np.uint64))
                doc = np.searchsorted(w.first, head, "right") - 1
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[place].view(np.int64)), pa.array(seg.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(ids[doc].astype(np.int64)), pa.array((head - w.first[doc]).astype(np.int32))],
                    names=["anchor", "seg", "n", "doc_id", "at"],
                )

    return docs.mapInArrow(run, "anchor long, seg long, n int, doc_id long, at int")


def anchored(w: Words, cfg: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, and of every segment the index of its anchor among them, its first word and its number of windows."""
    value, at = grams(w, cfg.gram)
    span = cfg.window - cfg.gram + 1
    none = np.zeros(0, np.int64)
    if len(value) < span:
        return value, none, none, none
    i = np.flatnonzero(at[span - 1 :] - at[: len(at) - span + 1] == span - 1)
    if not len(i):
        return value, none, none, none
    best, least = np.zeros(len(i), np.int64), value[i]
    for j in range(1, span):  # the leftmost smallest hash
        x = value[i + j]
        less = x < least
        best[less] = j
        least = np.where(less, x, least)
    place = i + best
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (at[i[1:]] != at[i[:-1]] + 1))))
    return value, place[new], at[i[new]], np.diff(np.append(new, len(i)))


def _content(docs: DataFrame, kinds: DataFrame, cfg: Repeats) -> DataFrame:
    """Adds the word hashes of the first segment of every kind, and the hashes of its windows."""
    refs = kinds.groupBy(F.col("first.doc_id").alias("s_doc")).agg(F.collect_list(F.struct("anchor", "first.at", "n", "kinds")).alias("refs"))
    joined = _by_document(docs.withColumn("d_doc_id", F.col("doc_id")), written(refs, "refs"), cfg.send, "inner", F.size("refs"))
    out = pa.schema([("anchor", pa.int64()), ("kinds", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("words", pa.binary()), ("windows", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in chunks(batch):
                w = words_of(part.column("text"), powers)
                rows = []
                for d, (doc_id, refs) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("refs").to_pylist())):
                    for r in refs:
                        a = w.first[d] + r["at"]
                        if a + r["n"] + cfg.window - 1 <= w.first[d + 1]:
                            windows = mix(run_hash(w.hash, a + np.arange(r["n"]), cfg.window)).view(np.int64).tolist() if r["kinds"] > cfg.shard else None
                            rows.append({"anchor": r["anchor"], "kinds": r["kinds"], "doc_id": doc_id, "at": r["at"], "words": w.hash[a : a + r["n"] + cfg.window - 1].tobytes(), "windows": windows})
                yield pa.RecordBatch.from_pylist(rows, out)

    return joined.select("doc_id", "text", "refs").mapInArrow(run, "anchor long, kinds long, doc_id long, at int, words binary, windows array<long>")


def _streamed(rows: DataFrame, cfg: Repeats) -> DataFrame:
    """Streams the segments of each shard, in document order, through the automaton of the earlier ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, automaton = None, None, Automaton()
        for batch in batches:
            docs, starts, ends = [], [], []
            for anchor, doc, at, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "at", "words"))):
                if (anchor, doc, at) == last:
                    continue  # an equal row
                last = anchor, doc, at
                if anchor != now:
                    now, automaton = anchor, Automaton()
                seq = np.frombuffer(raw, np.int64).tolist()
                for i, n in enumerate(automaton.match(seq)):
                    if n >= cfg.window:
                        docs.append(doc)
                        starts.append(at + i - cfg.window + 1)
                        ends.append(at + i + 1)
                automaton.add(seq)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["s_doc", "s", "e"])

    return rows.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "at").mapInArrow(run, "s_doc long, s int, e int")


def _merged(spans: DataFrame) -> DataFrame:
    """Spans of each document, overlapping and touching ones joined; a document has fewer spans than words."""
    lists = spans.groupBy("s_doc").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for s, e in zip(batch.column("s").to_pylist(), batch.column("e").to_pylist()):
                s, e = np.array(s, np.int64), np.array(e, np.int64)
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
                starts.append(s[new].astype(np.int32))
                ends.append(e[np.append(new[1:] - 1, len(e) - 1)].astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("s_doc"), pa.array(starts, kind), pa.array(ends, kind)], names=["s_doc", "span_start", "span_end"])

    return lists.mapInArrow(run, "s_doc long, span_start array<int>, span_end array<int>")


def _by_document(docs: DataFrame, side: DataFrame, send: int, how: str, size=None) -> DataFrame:
    """Join by doc_id: the written side is sent to the documents if it has been counted to be small, else both are shuffled."""
    n = side.agg(F.coalesce(F.sum(size if size is not None else F.size("span_start")), F.lit(0))).first()[0]
    return docs.join(F.broadcast(side) if n <= send else side, F.col("d_doc_id") == F.col("s_doc"), how)
