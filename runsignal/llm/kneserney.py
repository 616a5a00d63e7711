"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped to score.

Counts travel as Arrow arrays: every task adds up what it has read and deals sorted arrays of hashes and counts
out by hash range, and one task a range merges them.  The model is a set of flat files, one set for each range.
A scoring task maps them into memory and looks its tokens up by binary search, so only the pages it touches are read
and tasks on one machine share them.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem, copy_files
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import path, written
from .words import Powers, chunks, mix, words_of

BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: arrays of the model: name, type.  ctx_* are by context word, bi_* by bigram, uni_* by word.
ARRAYS = {"bi_key": "u8", "bi_n": "u4", "ctx_key": "u8", "ctx_n": "u8", "ctx_1": "u4", "ctx_2": "u4", "ctx_3": "u4"}
WORDS = {"uni_key": "u8", "uni_left": "u4", "uni_n": "u8"}


@dataclass(frozen=True)
class Model:
    """Where the arrays are (``root``), into how many hash ranges they are cut, and the sums over all training tokens.

    ``n_tokens``, ``n_types``: tokens and distinct tokens; ``n_bigrams``: distinct bigrams; ``d_bi``, ``d_uni``: discounts of
    counts 1, 2 and 3 or more; ``freed``: what the discounts take from the unigram level."""

    root: str
    parts: int
    n_tokens: int
    n_types: int
    n_bigrams: int
    d_bi: tuple[float, float, float]
    d_uni: tuple[float, float, float]
    freed: float


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9FB21C651E98DF25) + right)


def token_pairs(part: pa.RecordBatch, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every token of the texts, the token before it, and the first token of each text: words, then one end."""
    w = words_of(part.column("text"), powers, lower=True)
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    right = np.full(first[-1], END, np.uint64)
    right[np.arange(len(w.hash)) + w.doc] = w.hash
    left = np.empty_like(right)
    left[1:] = right[:-1]
    left[first[:-1]] = BEGIN
    return left, right, first


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of the key arrays (k, n), sorted, with the sums of their counts (m, n)."""
    key, n = np.concatenate(keys, axis=1), np.concatenate(counts, axis=1)
    order = np.lexsort(key[::-1])
    key, n = key[:, order], n[:, order]
    new = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0)))) if key.shape[1] else np.zeros(0, np.int64)
    return key[:, new], np.add.reduceat(n, new, axis=1, dtype=n.dtype) if len(new) else n


def dealt(key: np.ndarray, n: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row for each hash range of the first key: the keys and counts in it, array after array."""
    edge = np.searchsorted(key[0], range_edges(parts))
    edge[-1] = key.shape[1]
    used = [p for p in range(parts) if edge[p + 1] > edge[p]]
    blobs = [[b"".join(row[edge[p] : edge[p + 1]].tobytes() for row in x) for p in used] for x in (key, n)]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())], names=["part", "key", "n"])


def range_edges(parts: int) -> np.ndarray:
    """First hash of each of ``parts`` equal ranges, and the end."""
    return np.array([(p << 64) // parts for p in range(parts)] + [2**64 - 1], np.uint64)


def train(docs: DataFrame, parts: int, buffer: int = 5_000_000) -> Model:
    """Counts every token of ``docs`` (text; null is empty) and writes the model's files.

    ``parts`` sets how large one merging task is; a common context is one key among all the keys of its range, and
    its bigrams have been added up by the tasks that read them.  ``buffer`` tokens are added up at a time.
    """
    spark = docs.sparkSession
    root = path(spark, "kneserney")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, kept, size = Powers(), [], 0
        for batch in batches:
            for part in chunks(batch):
                left, right, _ = token_pairs(part, powers)
                kept.append(np.stack((left, right)))
                size += len(left)
                if size >= buffer:
                    yield dealt(*merge(kept, [np.ones((1, k.shape[1]), np.uint32) for k in kept]), parts)
                    kept, size = [], 0
        if size:
            yield dealt(*merge(kept, [np.ones((1, k.shape[1]), np.uint32) for k in kept]), parts)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, (left, right), (n,) in gathered(batches, 2, 1):
            new = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1])))
            kinds = [np.add.reduceat((n == k) if k < 3 else (n >= 3), new, dtype=np.uint32) for k in (1, 2, 3)]
            pair = pair_key(left, right)
            order = np.argsort(pair)
            save(root, p, dict(zip(ARRAYS, (pair[order], n[order], left[new], np.add.reduceat(n, new, dtype=np.uint64), *kinds))))
            yield from with_counts(dealt(*merge([right[None]], [np.stack((np.ones(len(n), np.uint32), n))]), parts), n)

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, (word,), (left, n) in gathered(batches, 1, 2, "u8"):
            save(root, p, dict(zip(WORDS, (word, left, n))))
            c = np.bincount(np.minimum(left, 5).astype(np.int64), minlength=5)
            sums = [int(n.sum()), len(word), int(left.sum()), *(int(x) for x in c[1:5])]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums], names=["n_tokens", "n_types", "n_bigrams", "u1", "u2", "u3", "u4"])

    blob = "part int, key binary, n binary"
    pairs = docs.select("text").mapInArrow(count, blob).repartition(parts, "part")
    words = written(pairs.mapInArrow(contexts, blob + ", b1 long, b2 long, b3 long, b4 long"), "contexts")
    sums = words.select("part", "key", "n").repartition(parts, "part").mapInArrow(unigrams, "n_tokens long, n_types long, n_bigrams long, u1 long, u2 long, u3 long, u4 long")
    s = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns)).first()
    b = words.agg(*(F.coalesce(F.sum(f"b{i}"), F.lit(0)) for i in (1, 2, 3, 4))).first()
    d = discounts(s["u1"], s["u2"], s["u3"], s["u4"])
    freed = (d[0] * s["u1"] + d[1] * s["u2"] + d[2] * (s["n_types"] - s["u1"] - s["u2"])) / s["n_bigrams"] if s["n_bigrams"] else 1.0
    return Model(root, parts, s["n_tokens"], s["n_types"], s["n_bigrams"], discounts(*b), d, freed)


def with_counts(batch: pa.RecordBatch, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batch, and on its first row how many counts are 1, 2, 3 and 4."""
    c = np.bincount(np.minimum(n, 5).astype(np.int64), minlength=5)[1:5]
    rows = batch.num_rows
    extra = [pa.array([int(x)] + [0] * (rows - 1), pa.int64()) for x in c]
    yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=["part", "key", "n", "b1", "b2", "b3", "b4"])


def gathered(batches: Iterator[pa.RecordBatch], width: int, sums: int, kind: str = "u4") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """All rows of each hash range that this task has, merged; sums are added up in the given type."""
    kept: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for p, key, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            a, b = kept.setdefault(p, ([], []))
            a.append(np.frombuffer(key, np.uint64).reshape(width, -1))
            b.append(np.frombuffer(n, np.uint32).reshape(sums, -1).astype(kind, copy=False))
    for p in sorted(kept):
        yield p, *merge(*kept.pop(p))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3+ from the numbers of things seen once to four times.  Where a text is too small to
    have them all, half the count's step is taken."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3)))


def local_path(uri: str) -> str | None:
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith(("file:", "/")) else None


def save(root: str, part: int, arrays: dict[str, np.ndarray]) -> None:
    """Write flat arrays.  A repeated task writes the same bytes under another name first, then puts them in place."""
    for name, values in arrays.items():
        data = np.ascontiguousarray(values, (ARRAYS | WORDS)[name]).tobytes()
        at = f"{root}/{part}.{name}"
        draft = f"{at}.{uuid.uuid4().hex}"
        if to := local_path(at):
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(local_path(draft), "wb") as f:
                f.write(data)
            os.replace(local_path(draft), to)
        else:
            fs, to = FileSystem.from_uri(at)
            draft = FileSystem.from_uri(draft)[1]
            fs.create_dir(os.path.dirname(to), recursive=True)
            with fs.open_output_stream(draft) as f:
                f.write(data)
            fs.move(draft, to)


def mapped(root: str, part: int, name: str) -> np.ndarray:
    """One array, memory-mapped.  From a store without local paths it is fetched once to the executor's own Spark folder."""
    kind, at = (ARRAYS | WORDS)[name], f"{root}/{part}.{name}"
    local = local_path(at)
    if local is None:
        local = os.path.join(SparkFiles.getRootDirectory(), f"{root.rsplit('/', 1)[-1]}.{part}.{name}")
        fs, there = FileSystem.from_uri(at)
        if not os.path.exists(local) and fs.get_file_info(there).size:
            draft = f"{local}.{uuid.uuid4().hex}"
            copy_files(there, draft, source_filesystem=fs, destination_filesystem=LocalFileSystem())
            os.replace(draft, local)
    if not os.path.exists(local) or not os.path.getsize(local):
        return np.zeros(0, kind)
    return np.memmap(local, kind, "r")


class Arrays:
    """Look-ups of many keys in the arrays of one kind; a range is mapped when it is first needed."""

    def __init__(self, model: Model, key: str, *values: str) -> None:
        self.model, self.names = model, (key, *values)
        self.edges = range_edges(model.parts)
        self.open: dict[int, list[np.ndarray]] = {}

    def part(self, hashes: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.edges, hashes, "right") - 1, self.model.parts - 1)

    def find(self, keys: np.ndarray, part: np.ndarray | None = None) -> list[np.ndarray]:
        """The values of keys that are sorted by range; 0 where a key is missing.  ``part``: their ranges, if not by the key itself."""
        part = self.part(keys) if part is None else part
        out = [np.zeros(len(keys), (ARRAYS | WORDS)[v]) for v in self.names[1:]]
        edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(keys) else []
        for a, b in zip(edge, edge[1:]):
            p = int(part[a])
            if p not in self.open:
                self.open[p] = [mapped(self.model.root, p, n) for n in self.names]
            table, *values = self.open[p]
            if len(table):
                at = np.minimum(np.searchsorted(table, keys[a:b]), len(table) - 1)
                hit = table[at] == keys[a:b]
                for o, v in zip(out, values):
                    o[a:b][hit] = v[at[hit]]
        return out


def score(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """``(id, n_tokens, n_known, base_score, score)`` of every row: log10 probabilities of the whole text.

    Tokens are the lower-cased words and one end; a null or empty text has the end alone.  base_score: unigrams with one
    added to every count.  score: the model's; a word never seen gets what the unigram level keeps for one
    unknown type.  An untrained model gives every token the same probability.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        bigrams, contexts, words = Arrays(model, "bi_key", "bi_n"), Arrays(model, "ctx_key", "ctx_n", "ctx_1", "ctx_2", "ctx_3"), Arrays(model, "uni_key", "uni_left", "uni_n")
        for batch in batches:
            for part in chunks(batch):
                left, right, first = token_pairs(part, powers)
                known, base, full = token_scores(left, right, model, bigrams, contexts, words)
                sums = [np.add.reduceat(x, first[:-1]) if part.num_rows else x for x in (known, base, full)]
                yield pa.RecordBatch.from_arrays([part.column(id_column), pa.array(np.diff(first)), *map(pa.array, sums)], names=[id_column, "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, "text").mapInArrow(run, f"{id_column} {kind}, n_tokens long, n_known long, base_score double, score double")


def token_scores(left, right, model: Model, bigrams: Arrays, contexts: Arrays, words: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token: whether it is known, its base score and its model score."""
    types, back = np.unique(right, return_inverse=True)
    seen, count = words.find(types)
    base = np.log10((count + 1.0) / (model.n_tokens + model.n_types + 1.0))
    # Unigram level: how many different tokens come before this one; what the discounts free goes to all types alike.
    d = np.array([0.0, *model.d_uni])
    low = (seen - d[np.minimum(seen, 3)]) / max(model.n_bigrams, 1)
    low = low + model.freed / (model.n_types + 1.0)
    key, part = pair_key(left, right), bigrams.part(left)
    order = np.lexsort((key, part))
    n = np.zeros(len(key), np.uint32)
    n[order] = bigrams.find(key[order], part[order])[0]
    before, which = np.unique(left, return_inverse=True)
    total, one, two, more = contexts.find(before)
    d = np.array([0.0, *model.d_bi])
    size = np.maximum(total, 1).astype(float)
    weight = np.where(total > 0, (d[1] * one + d[2] * two + d[3] * more) / size, 1.0)
    p = (n - d[np.minimum(n, 3)]) / size[which] + weight[which] * low[back]
    return (count > 0).astype(np.int64)[back], base[back], np.log10(p)


def trained_on(doc_id: Column, modulus: int, held_out: int) -> Column:
    """True for the documents that a model may see: crc32 of the id as text does not leave ``held_out``.  Null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus != held_out
