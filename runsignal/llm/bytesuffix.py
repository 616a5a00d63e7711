"""Repeated byte strings across all documents, from the interval trees of enhanced suffix arrays.

A suffix array over the whole corpus fits no task, so strings of ``length`` bytes are dealt out by content: each
belongs to the smallest hash among its short grams (its anchor), so equal strings meet.  Runs of strings with one
anchor are segments; equal segments are one kind, which enters its shard once, whatever its number of
occurrences.  A task sorts the suffixes of the kinds of many shards, takes the common prefixes of neighbours and scans them with
a stack: every interval whose suffixes differ in the byte before them is a maximal repeat, and its group holds all
occurrences.  In every interval only the earliest occurrence goes on to the wider one, so each loses once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .substring import _by_document, _merged, covered
from .words import CHUNK, Powers, chunks, mix

_CODE = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_END = 0xFF  # no byte of UTF-8
_BLOCK = CHUNK // 2  # bytes of pieces whose suffixes are sorted at once: about 150 bytes of arrays for each


@dataclass(frozen=True)
class ByteRepeats:
    """Strings of ``length`` bytes; ``gram`` bytes an anchor.  A shard of over ``shard`` kinds is dealt out further, by whole string.
    Up to ``send`` spans, and a tenth as many kinds, are sent to the documents, more are joined by document."""

    length: int = 100
    gram: int = 48
    shard: int = 4096
    send: int = 1_000_000


def without_repeated_bytes(docs: DataFrame, cfg: ByteRepeats = ByteRepeats()) -> DataFrame:
    """``(row, n_bytes, n_removed, n_spans, kept)`` for every row of docs: the row itself and the bytes of its text that stay.

    Texts are UTF-8 bytes.  A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a smaller doc_id, or earlier in
    the same document.  Strings are judged on the input, and none runs from one document into the next.  n_spans counts the
    maximal runs that go; what stays may be cut within a character, so ``kept`` is binary.  A null text counts as empty.  Rows with a
    null doc_id lose nothing and remove nothing.  Repeated rows start at the same places, so they do not remove each other.  Long texts are
    read in blocks; columns of any name come back within ``row``.  No documents give no rows.
    """
    left = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d_doc_id"), F.col("text").alias("d_text"))
    joined = _by_document(left, removed_spans(docs, cfg), cfg.send, "left").select("row", "d_text", "span_start", "span_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "d_text"):
                kept, counts = [], []
                for text, starts, ends in zip(*(part.column(c) for c in ("d_text", "span_start", "span_end"))):
                    data = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
                    n = len(data)
                    if starts.is_valid:
                        raw = np.frombuffer(data, np.uint8)
                        # Spans are merged: every one is a maximal run.
                        gone = covered(n, starts.values.to_numpy(), ends.values.to_numpy())
                        kept.append(raw[~gone].tobytes())
                        counts.append((n, int(gone.sum()), len(starts)))
                    else:
                        kept.append(data.to_pybytes())
                        counts.append((n, 0, 0))
                counts = np.array(counts, np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(c) for c in counts), pa.array(kept, pa.binary())], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"row {left.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_groups(docs: DataFrame, cfg: ByteRepeats = ByteRepeats()) -> DataFrame:
    """``(group, length, via, doc_id, start)``: maximal repeats within segments, with all occurrences.

    A row is an occurrence of the group's string at byte ``start``.  Where it stands for all occurrences of a longer repeat that begins
    with that string, ``via`` is that group; its rows are further occurrences.  So nested repeats list each occurrence once, and the
    number of rows stays in proportion to the text.
    """
    rows, kinds, found, wide = _stages(docs, cfg)
    kind = F.concat(F.hex("anchor"), F.lit("/"), F.hex("seg"))
    bytes_of = F.col("n") + cfg.length - 1
    copies = kinds.where("m > 1").select("anchor", "seg", "n")
    whole = rows.join(copies, ["anchor", "seg", "n"]).select(kind.alias("group"), bytes_of.alias("length"), F.lit(None).cast("string").alias("via"), "doc_id", F.col("at").alias("start"))
    # Where the kind occurs more than once, its own group has the others.
    inner = found.select("group", "length", F.coalesce("via", F.when(F.col("m") > 1, kind)).alias("via"), "doc_id", F.col("start"))
    again = wide.groupBy("value").agg(F.count("*").alias("m")).where("m > 1").select("value")
    windows = wide.join(again, "value").select(F.hex("value").alias("group"), F.lit(cfg.length).alias("length"), F.when(F.col("m") > 1, kind).alias("via"), "doc_id", F.col("at").alias("start"))
    return whole.unionByName(inner).unionByName(windows)


def removed_spans(docs: DataFrame, cfg: ByteRepeats) -> DataFrame:
    """``(s_doc, span_start, span_end)``: for every document that loses bytes, the ranges that go."""
    rows, kinds, found, wide = _stages(docs, cfg)
    # All occurrences of a kind but its first one lie in the kind's own group.
    later = rows.join(kinds.where("m > 1"), ["anchor", "seg", "n"]).where("doc_id <> first.doc_id OR at <> first.at")
    later = later.select(F.col("doc_id").alias("s_doc"), F.col("at").alias("s"), (F.col("at") + F.col("n") + cfg.length - 1).alias("e"))
    lost = found.where("lost").select(F.col("doc_id").alias("s_doc"), F.col("start").alias("s"), (F.col("start") + F.col("length")).alias("e"))
    first = wide.groupBy("value").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    again = wide.join(first, "value").where("doc_id <> first.doc_id OR at <> first.at")
    again = again.select(F.col("doc_id").alias("s_doc"), F.col("at").alias("s"), (F.col("at") + cfg.length).alias("e"))
    return written(_merged(later.unionByName(lost).unionByName(again)), "spans")


def _stages(docs: DataFrame, cfg: ByteRepeats) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Segments whose anchor occurs twice, their kinds (first place, number m), what the suffix arrays give, and the windows of the largest shards."""
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    rows = segments(docs, cfg)
    # Written, so that the join is one of two shuffles, in which Spark splits an anchor that very many segments have.
    twice = written(rows.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor"), "anchors")
    rows = written(rows.join(twice, "anchor"), "segments")
    kinds = written(rows.groupBy("anchor", "seg", "n").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("m")), "kinds")
    size = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = written(contents(docs, kinds.join(size, "anchor"), cfg), "shards")
    found = written(intervals(several.where(F.col("kinds") <= cfg.shard), cfg), "intervals")
    wide = several.where(F.col("kinds") > cfg.shard).select("anchor", "seg", "m", "doc_id", "at", F.posexplode("windows").alias("j", "value"))
    return rows, kinds, found, wide.select("anchor", "seg", "m", "value", "doc_id", (F.col("at") + F.col("j")).alias("at"))


def segments(docs: DataFrame, cfg: ByteRepeats) -> DataFrame:
    """``(anchor, seg, n, doc_id, at)``: runs of n strings with one anchor, from byte ``at`` on; seg identifies the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in chunks(batch):
                data, edge = raw_bytes(part.column("text"))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                # Blocks of a long text overlap by what a string needs; a segment may be cut, a string is not.
                for begin in range(0, max(1, len(data)), 4 * CHUNK):
                    end = min(len(data), begin + 4 * CHUNK + cfg.length - 1)
                    anchor, seg, at, n = _segments(data[begin:end], edge - begin, powers, cfg)
                    doc = np.searchsorted(edge, at + begin, "right") - 1
                    arrays = (anchor.view(np.int64), seg.view(np.int64), n.astype(np.int32), ids[doc], (at + begin - edge[doc]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["anchor", "seg", "n", "doc_id", "at"])

    return docs.mapInArrow(run, "anchor long, seg long, n int, doc_id long, at int")


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, and the end; null texts have none."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8), offsets - offsets[0]


def _segments(data: np.ndarray, edge: np.ndarray, powers: Powers, cfg: ByteRepeats) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, first byte and number of strings of every segment."""
    size = len(data)
    windows = size - cfg.length + 1
    if windows <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums, down = _prefix(data, powers)
    value = sums[cfg.gram :] - sums[: -cfg.gram]
    value *= down[: len(value)]
    head = value = mix(value)
    # The least of the next span values, doubling the reach.
    span, reach = cfg.length - cfg.gram + 1, 1
    while 2 * reach <= span:
        value = np.minimum(value[:-reach], value[reach:])
        reach *= 2
    least = np.minimum(value[:windows], value[span - reach :][:windows]) if reach < span else value[:windows]
    whole = np.ones(windows, bool)
    inner = edge[(edge > 0) & (edge < size)]
    cut = np.zeros(windows + 1, np.int32)
    np.add.at(cut, np.clip(inner - cfg.length + 1, 0, windows), 1)
    np.add.at(cut, np.minimum(inner, windows), -1)
    whole = np.cumsum(cut[:-1]) == 0
    # The anchor is the leftmost least gram: another one where the value changes or the gram falls out.  So no segment repeats within itself.
    other = (least[1:] != least[:-1]) | (head[: windows - 1] == least[:-1])
    new, last = whole.copy(), whole.copy()
    new[1:] &= ~whole[:-1] | other
    last[:-1] &= ~whole[1:] | other
    at = np.flatnonzero(new)
    n = np.flatnonzero(last) - at + 1
    seg = mix((sums[at + n + cfg.length - 1] - sums[at]) * down[at] + n.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return least[at], seg, at, n


def _prefix(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * up[: len(data)], out=sums[1:])
    return sums, down


def contents(docs: DataFrame, kinds: DataFrame, cfg: ByteRepeats) -> DataFrame:
    """Adds the bytes of the first occurrence of every kind, or in the largest shards the hashes of its strings."""
    refs = kinds.groupBy(F.col("first.doc_id").alias("s_doc")).agg(F.collect_list(F.struct("anchor", "seg", "m", "first.at", "n", "kinds")).alias("refs"))
    joined = _by_document(docs.withColumn("d_doc_id", F.col("doc_id")), written(refs, "refs"), cfg.send // 10, "inner", F.size("refs"))
    kind = "anchor long, seg long, m long, doc_id long, at int, kinds long, bytes binary, windows array<long>"
    names = [c.split()[0] for c in kind.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in chunks(batch):
                columns: list[list] = [[] for _ in names]
                for doc_id, text, refs in zip(*(part.column(c) for c in ("doc_id", "text", "refs"))):
                    data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                    for r in refs.as_py():
                        piece = data[r["at"] : r["at"] + r["n"] + cfg.length - 1]
                        if len(piece) < r["n"] + cfg.length - 1:
                            continue  # another row of the same doc_id has it
                        far = r["kinds"] > cfg.shard
                        row = r["anchor"], r["seg"], r["m"], doc_id.as_py(), r["at"], r["kinds"], None if far else piece.tobytes(), _windows(piece, powers, cfg) if far else None
                        for c, v in zip(columns, row):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return joined.select("doc_id", "text", "refs").mapInArrow(run, kind)


def _windows(piece: np.ndarray, powers: Powers, cfg: ByteRepeats) -> list[int]:
    sums, down = _prefix(piece, powers)
    value = sums[cfg.length :] - sums[: -cfg.length]
    return mix(value * down[: len(value)]).view(np.int64).tolist()


def intervals(shards: DataFrame, cfg: ByteRepeats) -> DataFrame:
    """``(anchor, seg, m, group, length, via, doc_id, start, lost)``: the members of all maximal repeats of the shards.

    A member is an occurrence in the first occurrence of a kind, or the earliest one of the group ``via``.  It is lost if the group has an
    earlier one.
    """
    names = ["anchor", "seg", "m", "group", "length", "via", "doc_id", "start", "lost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_shards(batches):
            seg, anchor = (table.column(c).to_numpy() for c in ("seg", "anchor"))
            new = np.concatenate(([True], (seg[1:] != seg[:-1]) | (anchor[1:] != anchor[:-1])))
            table = table.filter(pa.array(new))  # rows of one doc_id may hold the same
            anchor, seg, m, doc, at = (table.column(c).to_numpy() for c in ("anchor", "seg", "m", "doc_id", "at"))
            kind, offset, group, length, via, lost = _tree(table.column("bytes"), doc, at, cfg.length)
            # The group's name: its shard and its number in the task's block, of which a shard lies in one only.
            head = [f"{a:016X}" for a in anchor.view(np.uint64).tolist()]
            named = [f"{head[k]}:{g}" for k, g in zip(kind.tolist(), group)]
            above = [None if v is None else f"{head[k]}:{v}" for k, v in zip(kind.tolist(), via)]
            arrays = [anchor[kind], seg[kind], m[kind], pa.array(named, pa.string()), length.astype(np.int32), pa.array(above, pa.string()), doc[kind], (at[kind] + offset).astype(np.int32), lost]
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)

    rows = shards.select("anchor", "seg", "m", "doc_id", "at", "bytes")
    return rows.repartition("anchor").sortWithinPartitions("anchor", "seg").mapInArrow(run, "anchor long, seg long, m long, group string, length int, via string, doc_id long, start int, lost boolean")


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of about _BLOCK bytes that hold all rows of their shards."""
    held, size = [], 0
    for batch in batches:
        for part in chunks(batch, "bytes", _BLOCK):
            held.append(part)
            size += part.nbytes
            if size < _BLOCK:
                continue
            block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            anchor = block.column("anchor").to_numpy()
            end = int(np.searchsorted(anchor, anchor[-1]))
            if end:
                yield block.slice(0, end)
            held = [block.slice(end)]
            size = held[0].nbytes if end else 0  # a shard that is larger alone: as much again before the next try
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield table.to_batches()[0]


def suffixes(data: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, compared over ``longest`` bytes, and the common prefix of each with the one before.

    Prefix doubling from eight bytes on; the ranks of every round give the common prefixes by halving."""
    n = len(data)
    symbol = np.concatenate((data + np.uint8(1), np.zeros(8, np.uint8)))  # the end sign becomes the least
    first = np.zeros(n, np.uint64)
    for j in range(8):
        first = first << np.uint64(8) | symbol[j : n + j]
    rounds, key, k = [], first, 8
    while True:
        order = np.argsort(key)
        inorder = key[order]
        rank = np.empty(n, np.uint32)
        rank[order] = np.cumsum(np.concatenate(([True], inorder[1:] != inorder[:-1])), dtype=np.uint32)
        rounds.append((k, rank))
        if k >= longest or rank[order[-1]] == n:
            break
        key = rank.astype(np.uint64) << np.uint64(32)
        key[:-k] |= rank[k:]
        k *= 2
    x, y, same = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k, rank in reversed(rounds):
        i, j = x + same, y + same
        ok = np.maximum(i, j) < n
        ok[ok] = rank[i[ok]] == rank[j[ok]]
        same[ok] += k
    i, j = np.minimum(x + same, n - 1), np.minimum(y + same, n - 1)
    differ = first[i] ^ first[j]
    for b in range(1, 8):
        same += (differ >> np.uint64(64 - 8 * b)) == 0
    return order, np.concatenate(([0], same))


def _tree(pieces: pa.Array, doc: np.ndarray, at: np.ndarray, least: int) -> tuple:
    """Members of the maximal repeats of ``least`` bytes among the pieces: piece, offset, group, length, via, lost."""
    raw, edge = raw_bytes_of(pieces)
    size = np.diff(edge)
    data = np.full(edge[-1] + len(size), _END, np.uint8)
    begin = edge[:-1] + np.arange(len(size))
    data[np.arange(edge[-1]) + np.repeat(np.arange(len(size)), size)] = raw
    order, same = suffixes(data, int(size.max()) + 1)
    piece = np.searchsorted(begin, order, "right") - 1
    rest = begin[piece] + size[piece] - order
    same[1:] = np.minimum(same[1:], np.minimum(rest[1:], rest[:-1]))
    # Runs of neighbours that share enough; where all have one byte before them, so have all intervals within.
    long = same >= least
    start = np.flatnonzero(long & ~np.concatenate(([False], long[:-1]))) - 1
    end = np.flatnonzero(long & ~np.concatenate((long[1:], [False]))) + 1
    members: list[tuple] = []
    if len(start):
        before = np.where(order == begin[piece], 256, data[np.maximum(order, 1) - 1].astype(np.int64))
        change = np.concatenate(([0], np.cumsum(np.concatenate(([False], before[1:] != before[:-1])) | (before == 256))))
        # An end sign counts as different from all, another one too.
        diverse = (change[end] - change[start + 1] > 0) | (before[start] == 256)
        place = np.lexsort((at[piece] + order - begin[piece], doc[piece]))
        moved = (doc[piece][place][1:] != doc[piece][place][:-1]) | ((at[piece] + order - begin[piece])[place][1:] != (at[piece] + order - begin[piece])[place][:-1])
        turn = np.empty(len(order), np.int64)
        turn[place] = np.cumsum(np.concatenate(([0], moved)))
        for a, b in zip(start[diverse].tolist(), end[diverse].tolist()):
            scan(same[a:b].tolist(), turn[a:b].tolist(), before[a:b].tolist(), a, members)
    which, group, length, via, lost = (list(c) for c in zip(*members)) if members else ([], [], [], [], [])
    which = np.array(which, np.int64)
    return piece[which], (order - begin[piece])[which], group, np.array(length, np.int64), via, np.array(lost, bool)


def raw_bytes_of(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    pieces = pieces.cast(pa.large_binary())
    offsets = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, pieces.offset * 8)
    return np.frombuffer(pieces.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def scan(same: list[int], turn: list[int], before: list[int], shift: int, members: list[tuple]) -> None:
    """Stack scan of neighbouring suffixes: appends (suffix, group, length, via, lost) for the members of every left-diverse interval.

    same[t] is the common prefix of suffixes t - 1 and t (same[0] is not read); turn orders occurrences; before is the byte ahead, 256 if there is none.
    An interval is [prefix, members, earliest suffix, byte ahead or -1 if it differs]; a member is (suffix, group it stands for).
    """
    stack: list[list] = []
    for t in range(1, len(same) + 1):
        prefix = same[t] if t < len(same) else 0
        node = [0, [(t - 1, None)], t - 1, -1 if before[t - 1] == 256 else before[t - 1]]
        while stack and stack[-1][0] > prefix:
            node = _closed(_joined(stack.pop(), node, turn), turn, shift, members)
        if stack and stack[-1][0] == prefix:
            _joined(stack[-1], node, turn)
        elif prefix:
            stack.append([prefix, *node[1:]])


def _joined(wide: list, node: list, turn: list[int]) -> list:
    if len(node[1]) > len(wide[1]):
        wide[1], node[1] = node[1], wide[1]
    wide[1] += node[1]
    if turn[node[2]] < turn[wide[2]]:
        wide[2] = node[2]
    if wide[3] != node[3]:
        wide[3] = -1
    return wide


def _closed(interval: list, turn: list[int], shift: int, members: list[tuple]) -> list:
    """What goes on to the wider interval: the earliest member for all of a maximal repeat.  Where all have one byte ahead, the repeat is
    part of the one that begins there, so its members go on as they are."""
    length, own, best, byte = interval
    if byte >= 0:
        return interval
    group = f"{shift + best}.{length}"
    members += [(shift + s, group, length, via, turn[s] > turn[best]) for s, via in own]
    return [0, [(best, group)], best, -1]
