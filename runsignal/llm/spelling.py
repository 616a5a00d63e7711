"""Spelling variants: words one edit apart, found by probing all edits of every word in Bloom filters of the vocabulary.

The filters are blocked (one 64-byte line a word) and split by word length, built in pieces by the tasks and bounded in
size.  The hash of a word is a polynomial in its letters, so hashes of edited words come from sums without writing the words
down.  Only edits that pass the filter become rows; a join with the vocabulary removes those that pass by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .words import Powers, mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = np.array([*range(97, 123), *range(0xC0, 0x100)], np.uint32)  # what words are made of, in code-point order
_CODE = np.zeros(256, np.uint64)
_CODE[LETTERS] = np.random.default_rng(13).integers(1, 2**63, len(LETTERS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PIECE = 1 << 14  # lines of a piece: a megabyte


def _length(n: int) -> np.uint64:
    return np.uint64(n * 0xD1B54A32D192ED03 % 2**64)


@dataclass(frozen=True)
class Spelling:
    """Words of ``least`` letters and ``times`` occurrences; a form is ``ratio`` times as frequent as its variant.

    Runs whose hash ``drop`` divides lose a letter (0: none).  Filters take ``bits`` bits a word, but at most ``most`` bytes in all: a larger
    vocabulary makes them less selective, not larger, and leaves more to the join.  Words of ``shards`` letters and more share a filter."""

    least: int = 7
    times: int = 2
    ratio: int = 10
    drop: int = 31
    bits: int = 16
    most: int = 128 << 20
    shards: int = 64
    probes: int = 1 << 19


def spelling_variants(docs: DataFrame, cfg: Spelling = Spelling()) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of the vocabulary.

    Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of the whole texts, A-Z lower-cased; runs with an unlucky hash of doc_id and run
    lose one letter (planted typing errors).  A null text has none, a null doc_id hashes as an empty one, repeated rows count again, other
    columns do not matter.  n_near counts the words exactly one insertion, deletion or replacement away; form is the most frequent of them,
    of equal ones the first in code-point order, if it is ``ratio`` times as frequent, else null; root is where following forms ends, the
    word itself if it has none.  An empty table gives no rows.
    """
    words = written(vocabulary(docs, cfg), "vocabulary")
    pairs = near_pairs(words, cfg)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("first")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), first)
    out = words.join(near, "word", "left").withColumn("form_n", -F.col("first.less"))
    fits = F.col("form_n") >= cfg.ratio * F.col("n")
    out = written(out.select("word", F.when(fits, F.col("first.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("form_n")).alias("form_n")), "forms")
    ends = out.join(roots(out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))), "word", "left")
    return ends.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(docs: DataFrame, cfg: Spelling) -> DataFrame:
    """``(word, n)``."""
    # A run of fewer letters cannot become a word.
    runs = F.expr(f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\\\u00C0-\\\\u00FF]{{{cfg.least},}}', 0)")
    rows = docs.select("doc_id", F.explode(runs).alias("run"))
    word = F.col("run")
    if cfg.drop:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % cfg.drop == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    return rows.select(word.alias("word")).where(F.length("word") >= cfg.least).groupBy("word").agg(F.count("*").alias("n")).where(f"n >= {cfg.times}")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from the form of each word: every round doubles the steps taken; frequencies grow along a path, so it ends."""
    while True:
        forms = written(forms, "roots")
        after = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        forms = forms.join(after, "root", "left")
        if forms.where("next IS NOT NULL").isEmpty():
            return forms.select("word", "root")
        forms = forms.select("word", F.coalesce("next", "root").alias("root"))


@dataclass
class Lines:
    """Bloom filters of all lengths in one array of 64-byte lines: those of a length begin at ``begin`` and are ``size`` many."""

    begin: np.ndarray
    size: np.ndarray
    data: np.ndarray | None = None

    @classmethod
    def planned(cls, counts: dict[int, int], cfg: Spelling) -> Lines:
        need = np.array([-(-counts.get(k, 0) * cfg.bits // 512) for k in range(cfg.shards + 1)])
        room = cfg.most // 64 - len(need)
        if need.sum() > room:
            need = need * room // need.sum()
        size = np.maximum(need, 1)
        return cls(np.concatenate(([0], np.cumsum(size)[:-1])), size)

    def line(self, h: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """The line of words by their mixed hash and length."""
        shard = np.minimum(length, len(self.size) - 1)
        return self.begin[shard] + ((h >> np.uint64(32)) * self.size[shard].astype(np.uint64) >> np.uint64(32)).astype(np.int64)

    def may_hold(self, h: np.ndarray, length: int) -> np.ndarray:
        """Indices of the hashes that the filter does not rule out; each of eight bits is looked at only where those before are set."""
        h = mix(h + _length(length))
        line, bits, at = self.line(h, length), mix(h), np.arange(len(h))
        for lane in range(8):
            ok = (self.data[line, lane] >> (bits >> np.uint64(6 * lane) & np.uint64(63)) & np.uint64(1)).astype(bool)
            line, bits, at = line[ok], bits[ok], at[ok]
        return at


def letters(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words of each length: their places, and their letters as a matrix of code points."""
    size = pa.compute.utf8_length(words).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        text = "".join(words.take(pa.array(at)).to_pylist())
        yield at, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(at), n)


def filters(words: DataFrame, cfg: Spelling) -> Lines:
    """The filters of a vocabulary: each task fills whole pieces, which together are at most ``most`` bytes."""
    shard = F.least(F.length("word"), F.lit(cfg.shards))
    lines = Lines.planned({r.shard: r.n for r in words.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}, cfg)
    total = int(lines.size.sum())

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for _, x in letters(batch.column("word")):
                h = mix((_CODE[x] * powers.upto(x.shape[1])[0][: x.shape[1]]).sum(1, dtype=np.uint64) + _length(x.shape[1]))
                line = lines.line(h, np.full(len(h), x.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(line // _PIECE), pa.array(line % _PIECE), pa.array(mix(h).view(np.int64))], names=["piece", "line", "bits"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, data = None, np.zeros((_PIECE, 8), np.uint64)
        for batch in batches:
            piece, line, bits = (batch.column(c).to_numpy() for c in ("piece", "line", "bits"))
            edge = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1], [True]))) if len(piece) else []
            for a, b in zip(edge, edge[1:]):
                if piece[a] != now:
                    if now is not None:
                        yield made(now, data)
                    now, data = piece[a], np.zeros((_PIECE, 8), np.uint64)
                for lane in range(8):
                    np.bitwise_or.at(data[:, lane], line[a:b], np.uint64(1) << (bits[a:b].view(np.uint64) >> np.uint64(6 * lane) & np.uint64(63)))
        if now is not None:
            yield made(now, data)

    def made(piece: int, data: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([data[: total - piece * _PIECE].tobytes()], pa.binary())], names=["piece", "data"])

    dealt = words.select("word").mapInArrow(hashes, "piece long, line long, bits long").repartition("piece").sortWithinPartitions("piece")
    lines.data = np.zeros((total, 8), np.uint64)
    for r in dealt.mapInArrow(filled, "piece long, data binary").collect():
        at = r["piece"] * _PIECE
        lines.data[at : at + len(r["data"]) // 64] = np.frombuffer(r["data"], np.uint64).reshape(-1, 8)
    return lines


def near_pairs(words: DataFrame, cfg: Spelling) -> DataFrame:
    """``(word, n, near, near_n)``: all pairs one edit apart, each once: with the longer word first, or the one with the smaller letter."""
    sent = words.sparkSession.sparkContext.broadcast(filters(words, cfg))
    used = [r.c for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()]
    alphabet = np.array(sorted(ord(c) for c in used if c), np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, lines = Powers(), sent.value
        for batch in batches:
            for at, x in letters(batch.column("word")):
                step = max(1, cfg.probes // (x.shape[1] * max(len(alphabet), 1)))
                for i in range(0, len(at), step):
                    for near, of in edits(x[i : i + step], powers, lines):
                        rows = batch.select(["word", "n"]).take(pa.array(at[i + of]))
                        yield pa.RecordBatch.from_arrays([*rows.columns, near], names=["word", "n", "near"])

    def edits(x: np.ndarray, powers: Powers, lines: Lines) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Edited words that may be in the vocabulary, and the rows of x that they come from."""
        n = x.shape[1]
        up = powers.upto(n)[0][:n]
        code = _CODE[x] * up
        whole = code.sum(1, dtype=np.uint64)
        # Another letter at a place: a larger one, since the pair is found from its other side too.
        for a in range(0, n, max(1, cfg.probes // max(1, len(alphabet) * len(x)))):
            b = min(n, a + max(1, cfg.probes // max(1, len(alphabet) * len(x))))
            row, place, letter = np.nonzero(alphabet > x[:, a:b, None])
            place += a
            h = whole[row] - code[row, place] + _CODE[alphabet[letter]] * up[place]
            ok = lines.may_hold(h, n)
            near = x[row[ok]]
            near[np.arange(len(ok)), place[ok]] = alphabet[letter[ok]]
            yield spelled(near), row[ok]
        if n > cfg.least:
            # One of several equal letters in a row is enough.
            ahead = np.cumsum(code, axis=1, dtype=np.uint64)
            row, place = np.nonzero(np.concatenate((x[:, 1:] != x[:, :-1], np.ones((len(x), 1), bool)), axis=1))
            down = np.uint64(pow(int(up[1]), -1, 2**64)) if n > 1 else np.uint64(1)
            h = ahead[row, place] - code[row, place] + (whole[row] - ahead[row, place]) * down
            ok = lines.may_hold(h, n - 1)
            keep = np.ones((len(ok), n), bool)
            keep[np.arange(len(ok)), place[ok]] = False
            yield spelled(x[row[ok]][keep].reshape(len(ok), n - 1)), row[ok]

    def spelled(x: np.ndarray) -> pa.Array:
        return pa.array(np.ascontiguousarray(x).view(f"<U{x.shape[1]}").ravel().tolist() if len(x) else [], pa.string())

    found = words.mapInArrow(run, "word string, n long, near string")
    exact = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return written(found.join(exact, "near").select("word", "n", "near", "near_n"), "pairs")
