"""Language of whole texts: the family first, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .words import chunks

# Families of common languages.  A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"),
}
UNKNOWN = "und"


@dataclass(frozen=True)
class Learning:
    """The machines are fitted on a hash sample of about ``per_lang`` labelled rows of each language (all of them, if there
    are fewer), chosen by id and text, so that copies are thinned like other rows; ``bits``: the features are frequencies of hashed pairs and triples of bytes in 2**bits places."""

    per_lang: int = 500
    bits: int = 12
    iterations: int = 10
    reg: float = 0.01


@dataclass(frozen=True)
class Models:
    """``families``: languages of each; ``problems``: pairs of families or languages; a positive margin speaks for the first."""

    families: dict[str, list[str]]
    problems: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray
    bits: int


def _table() -> np.ndarray:
    """Bytes as features see them: letters lower-cased, everything else of ASCII a space."""
    out = np.arange(256, dtype=np.uint32)
    out[:128] = 32
    letters = np.arange(97, 123)
    out[letters] = out[letters - 32] = letters
    return out


def grams_of(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of every pair and triple of bytes inside a text (2**bits for those that count nothing): two rows; and text offsets."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    x, offsets = _table()[data], offsets - offsets[0]
    n = len(x)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # bytes up to the text's end
    end = np.array([32, 32], np.uint32)
    y, z = np.append(x, end)[1 : n + 1], np.append(x, end)[2 : n + 2]
    two, three = x | y << np.uint32(8), x | y << np.uint32(8) | z << np.uint32(16)
    places = np.stack([(g * np.uint32(2654435761) ^ np.uint32(k)) * np.uint32(2246822519) >> np.uint32(32 - bits) for k, g in ((1, two), (2, three))])
    blank = (x == 32) & (y == 32)
    places[0, (left < 2) | blank] = places[1, (left < 3) | blank] = 1 << bits
    return places, offsets


def frequencies(places: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """(texts, 2**bits) frequencies in percent."""
    out = np.zeros((len(offsets) - 1, (1 << bits) + 1))
    for d, (a, b) in enumerate(zip(offsets, offsets[1:])):
        out[d] = np.bincount(places[:, a:b].ravel(), minlength=(1 << bits) + 1)
    out = out[:, :-1]
    return 100 * out / np.maximum(out.sum(1, keepdims=True), 1)


def learn(docs: DataFrame, lang: str = "lang", cfg: Learning = Learning(), id_column: str = "doc_id") -> Models:
    """Fits the machines on the rows with a language and a letter in their text."""
    rows = docs.where(F.col(lang).isNotNull() & has_letter(F.col("text"))).select(F.xxhash64("text", id_column).alias("place"), "text", F.col(lang).alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    families: dict[str, list[str]] = {}
    for name in sorted(counts):
        families.setdefault(next((f for f, members in FAMILIES.items() if name in members), name), []).append(name)
    groups = [sorted(families), *(families[f] for f in sorted(families))]
    problems = [p for g in groups for p in combinations(g, 2)]
    if not problems:
        return Models(families, [], np.zeros((0, 1 << cfg.bits)), np.zeros(0), cfg.bits)
    share = F.coalesce(*(F.when(F.col("lang") == name, F.lit(min(1.0, cfg.per_lang / n))) for name, n in counts.items()))
    # The texts are gathered once few are left, not where they are read.
    sample = rows.where(F.pmod("place", F.lit(1_000_000)) < share * 1_000_000).select("text", "lang").repartition(4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                x = frequencies(*grams_of(part.column("text"), cfg.bits), cfg.bits)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) << cfg.bits), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("lang"), flat], names=["lang", "x"])

    sample = written(sample.mapInArrow(run, "lang string, x array<double>"), "languages")
    family = F.coalesce(*(F.when(F.col("lang").isin(*members), F.lit(f)) for f, members in families.items()))
    svm = LinearSVC(maxIter=cfg.iterations, regParam=cfg.reg)
    weights, bias = [], []
    for a, b in problems:
        side = family if a in families and b in families and (a, b) in combinations(groups[0], 2) else F.col("lang")
        data = sample.withColumn("side", side).where(F.col("side").isin(a, b))
        fitted = svm.fit(data.select(array_to_vector("x").alias("features"), (F.col("side") == a).cast("double").alias("label")))
        weights.append(fitted.coefficients.toArray())
        bias.append(fitted.intercept)
    return Models(families, problems, np.array(weights), np.array(bias), cfg.bits)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def winners(margins: np.ndarray, problems: list[tuple[str, str]], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: which name wins most of its duels (then by the sum of margins, then by order), and how sure its worst duel is."""
    votes, total = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
    sure = np.ones((len(margins), len(names)))
    for (a, b), m in zip(problems, margins.T):
        if a in names and b in names:
            for name, x in ((a, m), (b, -m)):
                i = names.index(name)
                votes[:, i] += x > 0
                total[:, i] += x
                sure[:, i] = np.minimum(sure[:, i], 1 / (1 + np.exp(-2 * np.clip(x, -50, 50))))
    best = (votes + 1 / (1 + np.exp(-np.clip(total, -30, 30))) / 2).argmax(1)
    return best, sure[np.arange(len(best)), best]


def languages(docs: DataFrame, models: Models) -> DataFrame:
    """``(row, lang_pred, score)`` for every row of docs, from its whole text alone.

    A null text or one without letters is ``und`` with score 0, and so is everything if nothing was learned.  score is the
    probability-like sureness of the weakest duel on the way, between 0 and 1.
    """
    names = sorted(models.families)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.concatenate((models.weights, np.zeros((len(models.weights), 1))), axis=1)
        for batch in batches:
            for part in chunks(batch):
                n = part.num_rows
                places, offsets = grams_of(part.column("text"), models.bits)
                size = np.add.reduceat(np.append((places < 1 << models.bits).sum(0), 0), offsets[:-1]) if n else np.zeros(0)
                size = np.where(np.diff(offsets) > 0, size, 1)
                margins = np.zeros((n, len(weights)))
                for j, w in enumerate(weights):
                    sums = np.add.reduceat(np.append(w[places[0]] + w[places[1]], 0.0), offsets[:-1])
                    margins[:, j] = np.where(np.diff(offsets) > 0, 100 * sums / np.maximum(size, 1), 0) + models.bias[j]
                family, sure = winners(margins, _of(models, names), names)
                lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
                for i, name in enumerate(names):
                    members = models.families[name]
                    rows = np.flatnonzero(family == i)
                    best, own = winners(margins[rows], _of(models, members), members)
                    lang[rows] = np.array(members, object)[best]
                    score[rows] = np.minimum(sure[rows], own)
                letter = part.column("letter").to_numpy(zero_copy_only=False).astype(bool)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.where(letter, lang, UNKNOWN), pa.string()), pa.array(np.where(letter, score, 0.0))], names=["row", "lang_pred", "score"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", has_letter(F.col("text")).alias("letter"))
    if not names:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def _of(models: Models, names: list[str]) -> list[tuple[str, str]]:
    """The problems between these names; others are renamed out of the way."""
    return [p if p[0] in names and p[1] in names else ("", "") for p in models.problems]
