"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import written
from .words import Powers, Words, chunks, grams, mix, words_of


@dataclass(frozen=True)
class NearDup:
    """``shingle`` words a shingle; links from ``num``/``den`` similarity on.

    ``bands`` bands of ``rows`` hashes: a pair exactly at 0.8 is missed with probability
    (1 - 0.8**6)**40, about 5e-6.  Signatures are compared ``batch`` hashes at a time and a pair is
    given up once the probability that it reaches the threshold is below ``miss``.  Ids of up to ``send`` pairs are
    sent to all tasks; more are joined by shuffle.
    """

    shingle: int = 5
    num: int = 80
    den: int = 100
    rows: int = 6
    bands: int = 40
    batch: int = 24
    miss: float = 1e-6
    send: int = 500_000

    @property
    def hashes(self) -> int:
        return self.rows * self.bands


def near_groups(docs: DataFrame, cfg: NearDup = NearDup()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of docs.

    Lower-cases A-Z.  A document's set holds its distinct shingles; with fewer words than a shingle, the
    whole sequence is the only one; without words or with a null text it is empty and linked with nothing.
    component_id is the smallest doc_id reachable over links, kept is ``doc_id = component_id``.
    Rows with equal doc_id are one document with several texts: all get the same component.
    A row with a null doc_id stays alone (component null, kept).
    """
    sigs = written(signatures(docs, cfg), "signatures")
    # Equal sets are one class; only its smallest doc_id goes on.
    full = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    firsts = written(full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")), "firsts")
    member = full.select("doc_id", "f1", "f2", "n_shingles").join(firsts, ["f1", "f2", "n_shingles"]).select("doc_id", "rep")
    equal = member.where("doc_id > rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    near = near_links(docs, sigs, firsts, cfg)
    label = components(equal.unionByName(near))
    out = sigs.select("doc_id", "n_shingles").join(label, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_links(docs: DataFrame, sigs: DataFrame, firsts: DataFrame, cfg: NearDup) -> DataFrame:
    """Links (a, b) that connect what verified links connect: to the least id of the component, or verified ones; equal sets have been merged.

    1. Stars: every document is compared with the most central one (the hub) among those it shares a bucket with.  What
       a verified link has joined needs no further comparison, so n near copies cost n pairs, not n**2.  As long
       as that joins much, documents that still share buckets across components get another hub.
    2. Of the documents that still share a bucket across components, only those pairs are compared that share a band and
       something rare (``prefix_pairs``).
    """
    band = (
        sigs.join(firsts.withColumnRenamed("rep", "doc_id"), ["f1", "f2", "n_shingles", "doc_id"])
        .select("doc_id", F.posexplode("bands").alias("band", "value"))
        .select(F.xxhash64("band", "value").alias("bucket"), F.col("doc_id").alias("id"))
    )
    shared = band.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket")
    members = written(band.join(shared, "bucket"), "members")
    labels, hubs, first = None, None, None
    while True:
        now = members.withColumn("label", F.col("id")) if labels is None else members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        bounds = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("bucket", "n")
        now = written(now.join(bounds, "bucket"), "open")
        central = now.groupBy("id").agg(F.sum("n").alias("weight"))
        if hubs is not None:
            central = central.join(hubs, F.col("id") == F.col("hub"), "left_anti")
        ranked = now.join(central, "id")
        top = ranked.groupBy("bucket").agg(F.max_by(F.struct(F.col("id").alias("hub"), F.col("label").alias("hub_label"), "weight"), F.struct("weight", "id")).alias("top")).select("bucket", "top.*")
        best = now.join(top, "bucket").groupBy("id", "label").agg(F.max_by(F.struct("hub", "hub_label"), F.struct("weight", "hub")).alias("top")).select("id", "label", "top.*")
        best = written(best, "hubs")
        # A hub may have a more central one itself.
        next_hub = best.select(F.col("id").alias("hub"), F.col("hub").alias("next"), F.col("hub_label").alias("next_label"))
        best = best.join(next_hub, "hub", "left").select("id", "label", F.coalesce("next", "hub").alias("hub"), F.coalesce("next_label", "hub_label").alias("hub_label"))
        star = written(best.where("label <> hub_label").select("id", "hub"), "star")
        hubs = star.select("hub") if hubs is None else hubs.unionByName(star.select("hub"))
        first = star if first is None else first
        good = written(verified(docs, probable(_ordered(star, "id", "hub"), sigs, cfg), cfg), "links")
        opened, joined = star.count(), good.count()
        if joined:
            labels = written(components(good if labels is None else good.unionByName(_to_least(labels))), "labels")
        if joined < 0.2 * opened or not opened:
            break
    left = written(_still_open(members, labels).select("id", "label").distinct(), "left")
    pairs = written(prefix_pairs(docs, left, cfg).join(_ordered(first, "id", "hub"), ["a", "b"], "left_anti"), "pairs")
    links = good if labels is None else _to_least(labels)
    if pairs.isEmpty():
        return links
    return links.unionByName(written(verified(docs, probable(pairs, sigs, cfg, banded=True), cfg), "links"))


def _to_least(labels: DataFrame) -> DataFrame:
    """Components as links, which are fewer and shorter than those that made them."""
    return labels.where("id > label").select(F.col("id").alias("a"), F.col("label").alias("b"))


def _still_open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of buckets that hold several components."""
    now = members.withColumn("label", F.col("id")) if labels is None else members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    bounds = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    return now.join(bounds, "bucket")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()


def prefix_pairs(docs: DataFrame, rows: DataFrame, cfg: NearDup) -> DataFrame:
    """Pairs (a, b) of documents in rows ``(id, label)``, with different labels, that can reach the threshold by what is rare in them.

    All sets are put in one order, rare shingles first.  With c = t / (1 + t), similarity t of x and y needs c (|x| + |y|) shared shingles.  If
    the first shared one is at place p of x and q of y, at most |x| - p and |y| - q are shared.  So it lies in the first (1 - t) |x| of the
    larger set and the first (1 - 2c) |y| of the smaller one: a fifth and a ninth at 0.8.  A text that is too far from its hub has more
    than a ninth of its own, so that loosely similar texts meet in nothing that they have in common with the hub.
    Counts may be off: any order gives the same links.
    """
    c = cfg.num / (cfg.num + cfg.den)
    texts = _involved(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), rows.select(F.col("id").alias("a"), F.col("id").alias("b")), cfg)
    sent = docs.sparkSession.sparkContext.broadcast(shingle_counts(texts, cfg))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, count = Powers(), sent.value
        for batch in batches:
            for part in chunks(batch):
                ids, size, token, place = [], [], [], []
                for doc_id, s in zip(part.column("doc_id").to_pylist(), shingle_sets(words_of(part.column("text"), powers, lower=True), cfg.shingle)):
                    n = len(s)
                    first = s[np.argsort(count[s >> np.uint64(64 - _COUNTERS)], kind="stable")[: (cfg.den - cfg.num) * n // cfg.den + 1]]
                    ids.append(np.full(len(first), doc_id, np.int64))
                    size.append(np.full(len(first), n, np.int32))
                    place.append(np.arange(len(first), dtype=np.int32))
                    token.append(first.view(np.int64))
                columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, size, place, token)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_PREFIX)

    prefix = written(texts.mapInArrow(run, "id long, size int, place int, token long").join(rows, "id"), "prefix")
    shared = F.lit(c) * (F.col("x.size") + F.col("y.size")) - 1e-6
    reach = (F.col("x.size") - F.col("x.place") >= shared) & (F.col("y.size") - F.col("y.place") >= shared)
    smaller = prefix.where(F.col("place") <= (1 - 2 * c) * F.col("size") + 1e-6)
    near = (F.col("x.size") >= F.col("y.size")) & (F.col("y.size") * cfg.den >= F.col("x.size") * cfg.num) & (F.col("x.label") != F.col("y.label"))
    return _ordered(prefix.alias("x").join(smaller.alias("y"), (F.col("x.token") == F.col("y.token")) & near & reach), "x.id", "y.id")


_COUNTERS = 20  # bits of a shingle's hash that choose its counter: 2 MB in all
_PREFIX = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("token", pa.int64())])


def shingle_counts(texts: DataFrame, cfg: NearDup) -> np.ndarray:
    """How many sets hold a shingle of each group of hashes, up to 65535; added up by range, so the driver gets one array."""
    ranges, size = 16, 1 << _COUNTERS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, total = Powers(), np.zeros(size, np.int64)
        for batch in batches:
            for part in chunks(batch):
                for s in shingle_sets(words_of(part.column("text"), powers, lower=True), cfg.shingle):
                    np.add.at(total, s >> np.uint64(64 - _COUNTERS), 1)
        if total.any():
            parts = np.minimum(total, 65535).astype(np.uint16).reshape(ranges, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["range", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, n in zip(*(c.to_pylist() for c in batch.columns)):
                sums[r] = sums.get(r, np.zeros(size // ranges, np.int64)) + np.frombuffer(n, np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 65535).astype(np.uint16).tobytes() for x in sums.values()], pa.binary())], names=["range", "n"])

    total = np.zeros((ranges, size // ranges), np.uint16)
    for r in texts.mapInArrow(count, "range int, n binary").repartition(ranges, "range").mapInArrow(add, "range int, n binary").collect():
        total[r["range"]] = np.frombuffer(r["n"], np.uint16)
    return total.ravel()


def signatures(docs: DataFrame, cfg: NearDup) -> DataFrame:
    """Per document: set size, two 64-bit fingerprints of the set, 16 bits of each minimum, band values."""
    rng = np.random.default_rng(11)
    mul = rng.integers(0, 2**31, cfg.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, cfg.hashes, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(words_of(part.column("text"), powers, lower=True), cfg.shingle)
                n = len(sets)
                low = np.full((n, cfg.hashes), 2**32 - 1, np.uint32)
                f = np.zeros((2, n), np.uint64)
                for d, s in enumerate(sets):
                    x = (s >> np.uint64(32)).astype(np.uint32)
                    for at in range(0, len(x), 256):
                        np.minimum(low[d], (x[at : at + 256, None] * mul + add).min(0), out=low[d])
                    f[0, d], f[1, d] = np.add.reduce(mix(s + np.uint64(1))), np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                value = np.zeros((n, cfg.bands), np.uint64)
                for j in range(cfg.rows):
                    value = value * np.uint64(0x9FB21C651E98DF25) + low[:, j * cfg.bands : (j + 1) * cfg.bands]
                flat = pa.array(mix(value).view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.array([len(s) for s in sets], np.int64)),
                        pa.array(f[0].view(np.int64)),
                        pa.array(f[1].view(np.int64)),
                        pa.array([row.tobytes() for row in (low & np.uint32(0xFFFF)).astype(np.uint16)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * cfg.bands), flat),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "low", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, low binary, bands array<long>")


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    value, at = grams(w, k)
    edge = np.searchsorted(at, w.first)
    out = []
    for d, n in enumerate(w.counts):
        if n >= k:
            out.append(np.unique(value[edge[d] : edge[d + 1]]))
        elif n:
            short = w.hash[w.first[d] : w.first[d + 1]]
            out.append(mix(np.add.reduce(mix(short * (2 * np.arange(n, dtype=np.uint64) + np.uint64(3))), keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_matches(cfg: NearDup) -> list[tuple[int, int]]:
    """For each number of hashes compared, the fewest equal ones at which a pair is not given up.

    With a uniform prior the similarity after m of n equal hashes is Beta(m + 1, n - m + 1); its upper tail
    beyond t is the chance that a binomial(n + 1, t) is at most m.
    """
    t, out = cfg.num / cfg.den, []
    for n in range(cfg.batch, cfg.hashes + 1, cfg.batch):
        term, total, m = (1 - t) ** (n + 1), 0.0, 0
        while total + term < cfg.miss:
            total += term
            term *= (n + 1 - m) / (m + 1) * t / (1 - t)
            m += 1
        out.append((n, m))
    return out


def probable(pairs: DataFrame, sigs: DataFrame, cfg: NearDup, banded: bool = False) -> DataFrame:
    """Pairs that the sequential test does not give up; ``banded``: only those that share a band."""
    steps = least_matches(cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, cfg.hashes) for c in ("low_a", "low_b"))
            alive, same, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            if banded:
                alive = np.flatnonzero((x == y).reshape(-1, cfg.rows, cfg.bands).all(1).any(1))
            for n, least in steps:
                same[alive] += (x[alive, done:n] == y[alive, done:n]).sum(1)
                alive, done = alive[same[alive] >= least], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    low = sigs.where("n_shingles > 0").select("doc_id", "low", F.col("n_shingles").alias("n"))
    low = _involved(low, pairs, cfg)
    for side in "ab":
        pairs = pairs.join(low.select(F.col("doc_id").alias(side), F.col("low").alias(f"low_{side}"), F.col("n").alias(f"n_{side}")), side)
    # The sizes alone bound the similarity.
    fits = f"{cfg.den} * least(n_a, n_b) >= {cfg.num} * greatest(n_a, n_b)"
    return pairs.where(fits).mapInArrow(run, "a long, b long").distinct()


def _involved(rows: DataFrame, pairs: DataFrame, cfg: NearDup) -> DataFrame:
    """Rows of the documents in the pairs.  Ids that have been counted to be few are sent to the rows; else both are shuffled."""
    ids = pairs.select(F.col("a").alias("i_id")).unionByName(pairs.select(F.col("b").alias("i_id"))).distinct()
    side = F.broadcast(ids) if pairs.count() <= cfg.send else ids
    return rows.join(side, F.col("doc_id") == F.col("i_id"), "left_semi")


def with_texts(docs: DataFrame, pairs: DataFrame, cfg: NearDup) -> DataFrame:
    """Adds ``text_a`` and ``text_b`` to written pairs."""
    text = _involved(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), pairs, cfg)
    for side in "ab":
        pairs = pairs.join(text.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs


def verified(docs: DataFrame, pairs: DataFrame, cfg: NearDup) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in chunks(batch, "text_a"):
                x, y = (shingle_sets(words_of(part.column(c), powers, lower=True), cfg.shingle) for c in ("text_a", "text_b"))
                both = np.array([len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y)], np.int64)
                union = np.array([len(s) + len(t) for s, t in zip(x, y)], np.int64) - both
                yield part.select(["a", "b"]).filter(pa.array(cfg.den * both >= cfg.num * union))

    return with_texts(docs, written(pairs, "probable"), cfg).mapInArrow(run, "a long, b long").distinct()
