"""URL verdicts: listed rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "depth", "labels", "digit_ratio", "entropy", "n_params", "suffix_rate", "domain_rate")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Trees:
    """``train_rows``: the trees are fitted on at most so many labelled urls, those with the smallest hashes.
    ``prior``: strength of the overall rate in the rates of suffixes and domains, which count all labelled urls.
    ``send``: rates of at most so many suffixes or domains are broadcast."""

    train_rows: int = 20_000
    trees: int = 10
    depth: int = 4
    prior: float = 10.0
    send: int = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def listed(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does.  Equally long: the first listed."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the lexical features of ``u_url``, ``host`` and ``path`` (all but the suffix rates)."""
    n = F.length("u_url")
    digits = n - F.length(F.translate("u_url", "0123456789", ""))
    each = F.array_distinct(F.split("u_url", ""))
    part = lambda c: (F.length("u_url") - F.length(F.replace(F.col("u_url"), c, F.lit("")))) / F.length("u_url")
    entropy = F.aggregate(F.filter(each, lambda c: c != ""), F.lit(0.0), lambda a, c: a - part(c) * F.log2(part(c)))
    query = F.regexp_extract("u_url", r"\?([^#]*)", 1)
    return rows.withColumns(
        {
            "length": n.cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "digit_ratio": F.coalesce(F.try_divide(digits, n), F.lit(0.0)),
            "entropy": F.when(n > 0, entropy).otherwise(0.0),
            "n_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
            "u_suffix": F.substring_index("host", ".", -1),
            "u_domain": F.substring_index("host", ".", -2),
        }
    )


def judged_urls(pages: DataFrame, rules: list[Rule], cfg: Trees = Trees(), id_column: str = "page_id") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every page.

    A listed rule decides; its verdicts are also the labels that the trees learn from.  Other urls
    are blocked if the trees give block a probability ``score`` above one half.  A null url has an empty host and
    path and is judged like an empty one.  Without labels of both kinds every unlisted url gets the only
    label there is, or allow.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select(id_column, url.alias("u_url"), host_of(url).alias("host"), path_of(url).alias("path"))
    text, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = lexical(rows.withColumns({"rule": text, "u_listed": verdict}))
    label = (F.col("u_listed") == "block").cast("double")
    known = rows.where("u_listed IS NOT NULL").withColumn("label", label)
    # One row a domain, which has one suffix.
    counts = written(known.groupBy("u_suffix", "u_domain").agg(F.count("*").alias("n"), F.sum("label").alias("bad")), "url_counts")
    n, bad = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    if not 0 < bad < n:
        only = "block" if n and bad else "allow"
        return _result(rows.withColumn("score", F.lit(1.0 if only == "block" else 0.0)), id_column)
    sample = written(known.orderBy(F.xxhash64("u_url", id_column)).limit(cfg.train_rows), "urls")
    rates = {c: counts.groupBy(c).agg(((F.sum("bad") + cfg.prior * bad / n) / (F.sum("n") + cfg.prior)).alias(f"{name}_rate")) for c, name in (("u_suffix", "suffix"), ("u_domain", "domain"))}
    rates = {c: F.broadcast(rate) if rate.count() <= cfg.send else rate for c, rate in rates.items()}

    def complete(df: DataFrame) -> DataFrame:
        for c, rate in rates.items():
            df = df.join(rate, c, "left")
        df = df.fillna(bad / n, ["suffix_rate", "domain_rate"])
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)

    model = GBTClassifier(maxIter=cfg.trees, maxDepth=cfg.depth, seed=1, maxBins=64).fit(complete(sample).select("features", "label"))
    scored = model.transform(complete(rows)).withColumn("score", vector_to_array("probability")[1])
    return _result(scored, id_column)


def _result(rows: DataFrame, id_column: str) -> DataFrame:
    guess = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return rows.select(id_column, "host", "path", "rule", F.coalesce("u_listed", guess).alias("verdict"), "score")
