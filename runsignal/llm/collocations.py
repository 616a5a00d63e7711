"""Phrase collocations per language, counted in counting quotient filters.

Words get dense ids; texts become sequences of ids in which 0 breaks a piece.  Every task adds its n-grams up, packs
them into one sorted filter for each part of the key space, and one task a part merges the filters of all others.
A phrase can only be frequent if its words and its inner pairs are: rarer words have no id, and longer
phrases are counted only over frequent pairs, as long as those are few enough to be sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quotient import Packing, Sum, summed
from .scratch import written
from .words import Powers, Words, chunks, mix, words_of

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = True
_SEPARATOR = _BREAK.copy()
_SEPARATOR[[9, 32]] = True


@dataclass(frozen=True)
class Phrases:
    """Phrases of 2 to ``longest`` (at most 4) words that occur ``least`` times; the ``top`` ones of each language.

    One gives way to a longer one that holds it and has ``num``/``den`` of its count.  ``buffer`` n-grams are added up in a task at a time.
    Up to ``send`` words or pairs are sent to all tasks; of more, words are joined by shuffle, and longer phrases are counted whatever their pairs."""

    least: int = 30
    longest: int = 4
    top: int = 2000
    num: int = 80
    den: int = 100
    buffer: int = 1_500_000
    send: int = 4_000_000


def collocations(docs: DataFrame, cfg: Phrases = Phrases()) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` of the best phrases of each language, from the columns text and lang.

    Lower-cases A-Z, splits texts at ``.,;:!?`` and line ends into pieces and those at blanks and tabs into words.  A null text is
    empty, a null lang is ``und``; repeated rows count each time, whatever their other columns, and the longest text is read whole.  For a
    phrase that occurs a times, cut after k words, l and r count its two parts and the score is floor(2000000 a / (l + r));
    the lowest cut counts, the first of equal ones.  Ties in score go by a, then by the bytes of the phrase.  An empty table gives no rows.
    """
    words, grams = counted(docs, cfg)
    return ranked(words, grams, cfg)


def counted(docs: DataFrame, cfg: Phrases) -> tuple[DataFrame, DataFrame]:
    """Frequent words ``(id, lang, word, n, total)``, total counting all words of the language, and frequent n-grams ``(ids, a)``."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).withColumn("seed", F.xxhash64("lang"))
    seen = written(word_counts(docs, cfg).groupBy("lang", "key").agg(F.min("word").alias("word"), F.sum("n").alias("n")), "words")
    totals = seen.where("word IS NULL").select("lang", F.col("n").alias("total"))
    words = written(dense_ids(seen.where(f"word IS NOT NULL AND n >= {cfg.least}"), "key", tasks), "vocabulary")
    n_words = words.count()
    bits = max(1, n_words.bit_length())
    sequences = written(sequenced(docs, words.select("lang", "key", "id"), n_words, cfg), "sequences")
    grams = written(frequent(sequences, [2], bits, None, tasks, cfg), "pairs")
    if cfg.longest > 2:
        pairs = None
        if grams.count() <= cfg.send:
            left, right = (c.to_numpy().astype(np.uint64) for c in grams.selectExpr("ids[0]", "ids[1]").toArrow().columns)
            pairs = np.sort(left << np.uint64(bits) | right)
        grams = grams.unionByName(written(frequent(sequences, list(range(3, cfg.longest + 1)), bits, pairs, tasks, cfg), "longer"))
    return words.join(totals, "lang"), grams


def cut(part: pa.RecordBatch, powers: Powers) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of the texts, their keys (language counts), and whether a piece begins with them."""
    w = words_of(part.column("text"), powers, lower=True, separators=_SEPARATOR)
    seed = mix(part.column("seed").to_numpy(zero_copy_only=False).view(np.uint64))
    breaks = np.cumsum(_BREAK[w.data])[w.start] if len(w.start) else np.zeros(0, np.int64)
    begins = np.ones(len(w.start), bool)
    doc = w.doc
    begins[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
    return w, mix(w.hash ^ seed[doc]), begins


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end] of every row, as text."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    flat = data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat.tobytes())).cast(pa.string())


def word_counts(docs: DataFrame, cfg: Phrases) -> DataFrame:
    """``(lang, key, word, n)`` as counted by each task; a row without a word holds all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, kept, held = Powers(), [], 0
        for batch in batches:
            for part in chunks(batch):
                w, key, _ = cut(part, powers)
                key, at, n = np.unique(key, return_index=True, return_counts=True)
                kept.append((key, n, slices(w.data, w.start[at], w.end[at]), part.column("lang").take(pa.array(w.doc[at]))))
                held += len(key)
                if held > cfg.buffer // 4:
                    kept = [merged(kept)]
                    held = len(kept[0][0])
                    if held > cfg.buffer // 8:
                        yield from rows(*kept[0])
                        kept, held = [], 0
        if kept:
            yield from rows(*merged(kept))

    def merged(kept):
        key, at, back = np.unique(np.concatenate([k[0] for k in kept]), return_index=True, return_inverse=True)
        n = np.bincount(back, np.concatenate([k[1] for k in kept]), len(key)).astype(np.int64)
        word, lang = (pa.concat_arrays([k[i] for k in kept]).take(pa.array(at)) for i in (2, 3))
        return key, n, word, lang

    def rows(key, n, word, lang):
        names = ["lang", "key", "word", "n"]
        for at in range(0, len(key), 100_000):
            to = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([lang[to], pa.array(key[to].view(np.int64)), word[to], pa.array(n[to])], names=names)
        coded = lang.dictionary_encode()
        total = np.bincount(coded.indices.to_numpy(), n, len(coded.dictionary)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.zeros(len(total), np.int64)), pa.nulls(len(total), pa.string()), pa.array(total)], names=names)

    return docs.mapInArrow(run, "lang string, key long, word string, n long")


def dense_ids(rows: DataFrame, by: str, buckets: int) -> DataFrame:
    """Adds ``id``, 1 to the number of rows, without bringing the rows together: places in a bucket behind the sizes of the buckets before."""
    rows = rows.withColumn("bucket", F.pmod(F.col(by), F.lit(buckets)))
    size = rows.groupBy("bucket").agg(F.count("*").alias("size"))
    before = size.withColumn("before", F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).select("bucket", "before")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(by, "lang"))
    return rows.withColumn("place", place).join(F.broadcast(before), "bucket").withColumn("id", (F.col("before") + F.col("place")).cast("int")).drop("bucket", "before", "place")


def sequenced(docs: DataFrame, words: DataFrame, n_words: int, cfg: Phrases) -> DataFrame:
    """``(ids)``: texts as packed 32-bit ids, with 0 for words without an id and between pieces."""
    if n_words > cfg.send:
        return joined(docs, words)
    table = words.select("key", "id").toArrow()
    key, ids = (table.column(c).to_numpy() for c in ("key", "id"))
    order = np.argsort(key.view(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast((key.view(np.uint64)[order], ids[order].astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, (key, ids) = Powers(), sent.value
        for batch in batches:
            for part in chunks(batch):
                _, k, begins = cut(part, powers)
                found = np.zeros(len(k), np.int32)
                if len(key):
                    at = np.minimum(np.searchsorted(key, k), len(key) - 1)
                    found = np.where(key[at] == k, ids[at], 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([packed(found, begins)], pa.binary())], names=["ids"])

    return docs.select("text", "lang", "seed").mapInArrow(run, "ids binary")


def packed(ids: np.ndarray, begins: np.ndarray) -> bytes:
    at = np.arange(len(ids)) + np.cumsum(begins)
    out = np.zeros(len(ids) + int(begins.sum()) + 1, np.int32)
    out[at] = ids
    return out.tobytes()


def joined(docs: DataFrame, words: DataFrame) -> DataFrame:
    """The same without sending the words: every word is a row, joined by its key and brought back to its text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in chunks(batch):
                w, k, begins = cut(part, powers)
                row = part.column("row").take(pa.array(w.doc))
                yield pa.RecordBatch.from_arrays([row, pa.array(np.arange(len(k))), pa.array(begins), pa.array(k.view(np.int64))], names=["row", "at", "begins", "key"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            begins = now.column("begins").to_numpy(zero_copy_only=False)
            # What follows the last begin may go on in the next batch.
            end = int(np.flatnonzero(begins)[-1])
            rest = now.slice(end)
            yield part_of(now.slice(0, end))
        if rest is not None:
            yield part_of(rest)

    def part_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, begins = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "begins"))
        return pa.RecordBatch.from_arrays([pa.array([packed(ids, begins.astype(bool))], pa.binary())], names=["ids"])

    tokens = written(docs.withColumn("row", F.monotonically_increasing_id()), "rows").select("row", "text", "seed").mapInArrow(split, "row long, at long, begins boolean, key long")
    found = tokens.join(words.select("key", "id"), "key", "left").select("row", "begins", F.coalesce("id", F.lit(0)).alias("id"), "at")
    ordered = found.repartition("row").sortWithinPartitions("row", "at").select("begins", "id")
    return ordered.mapInArrow(lambda batches: pack(b for b in batches if b.num_rows), "ids binary")


def frequent(sequences: DataFrame, sizes: list[int], bits: int, pairs: np.ndarray | None, tasks: int, cfg: Phrases) -> DataFrame:
    """``(ids, a)`` of the n-grams of these sizes that occur often enough; ``pairs``: the frequent ones, sorted, if known."""
    packing = {n: Packing(n, bits, (tasks - 1).bit_length()) for n in sizes}
    sent = None if pairs is None else sequences.sparkSession.sparkContext.broadcast(pairs)

    def grams(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        follows = (ids[:-1] > 0) & (ids[1:] > 0)
        if sent is not None and len(sent.value):
            pair = ids[:-1].astype(np.uint64) << np.uint64(bits) | ids[1:].astype(np.uint64)
            at = np.minimum(np.searchsorted(sent.value, pair), len(sent.value) - 1)
            follows &= sent.value[at] == pair
        elif sent is not None:
            return
        for n in sizes:
            m = len(ids) - n + 1
            if m > 0:
                at = np.flatnonzero(np.logical_and.reduce([follows[j : j + m] for j in range(n - 1)]))
                yield n, packing[n].keys(np.stack([ids[at + j] for j in range(n)]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {n: [] for n in sizes}
        held = 0
        for batch in batches:
            for data in batch.column(0):
                ids = np.frombuffer(data.as_buffer(), np.int32)
                for n, key in grams(ids):
                    kept[n].append(key)
                    held += key.size
                if held > cfg.buffer:
                    yield from filters(kept)
                    kept, held = {n: [] for n in sizes}, 0
        yield from filters(kept)

    def filters(kept: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for n, keys in kept.items():
            if not keys:
                continue
            key, a = summed(keys, [np.ones(k.shape[1], np.uint64) for k in keys])
            parts, edge = np.unique(packing[n].part(key), return_index=True)
            edge = np.append(edge, key.shape[1])
            blobs = [packing[n].filter(key[:, i:j], a[i:j]) for i, j in zip(edge, edge[1:])]
            for i in range(0, len(blobs), 256):
                size = len(blobs[i : i + 256])
                yield pa.RecordBatch.from_arrays([pa.array([n] * size, pa.int32()), pa.array(parts[i : i + 256].astype(np.int64)), pa.array(blobs[i : i + 256], pa.binary())], names=["n", "part", "filter"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, Sum()
        for batch in batches:
            for n, part, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (n, part) != now:
                    if now:
                        yield kept_of(now[0], *total.merge())
                    now, total = (n, part), Sum()
                total.add(*packing[n].entries(part, data))
        if now:
            yield kept_of(now[0], *total.merge())

    def kept_of(n: int, key: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
        often = a >= cfg.least
        ids = packing[n].ids(key[:, often]).T.astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * n), pa.array(np.ascontiguousarray(ids).ravel()))
        return pa.RecordBatch.from_arrays([lists, pa.array(a[often].astype(np.int64))], names=["ids", "a"])

    filters_of = sequences.mapInArrow(count, "n int, part long, filter binary")
    # A task that has several parts merges one after the other.
    return filters_of.repartition(tasks, "n", "part").sortWithinPartitions("n", "part").mapInArrow(merge, "ids array<int>, a long")


def ranked(words: DataFrame, grams: DataFrame, cfg: Phrases) -> DataFrame:
    """The result from frequent words and n-grams, in joins on the parts of each phrase."""
    spelled = grams.withColumn("gram", F.monotonically_increasing_id())
    spelled = written(spelled, "grams").select("gram", "a", F.posexplode("ids").alias("at", "id"))
    spelled = spelled.join(words.select("id", "lang", "word", F.col("total")), "id")
    phrases = spelled.groupBy("gram").agg(F.min("lang").alias("lang"), F.min("total").alias("n"), F.min("a").alias("a"), F.expr("transform(sort_array(collect_list(struct(at, word))), x -> x.word)").alias("words"))
    phrases = written(phrases.select("lang", "n", "a", "words", F.array_join("words", " ").alias("phrase")), "phrases")
    parts = phrases.select("lang", "phrase", F.col("a").alias("f")).unionByName(words.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")))
    k = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = phrases.select("lang", "phrase", "a", "n", "words", k)
    cuts = cuts.select("lang", "phrase", "a", "n", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"), F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    wide = "decimal(20,0)"
    cuts = cuts.withColumn("score", F.expr(f"CAST((CAST(a AS {wide}) * 2000000) div (CAST(l AS {wide}) + r) AS long)"))
    best = cuts.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # What a longer one takes over, whether that one stays or not.
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    inside = phrases.where("size(words) > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stays = F.expr(f"longer IS NULL OR CAST(longer AS {wide}) * {cfg.den} < CAST(a AS {wide}) * {cfg.num}")
    left = best.join(inside, ["lang", "phrase"], "left").where(stays).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First among a few dozen shares of each language, so that no task sorts all its phrases.
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    heads = left.withColumn("place", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("place") <= cfg.top)
    out = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= cfg.top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
