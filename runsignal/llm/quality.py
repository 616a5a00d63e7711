"""Quality rules per document and per host, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits in percent.  ``host_limits``: a host is rejected if its shrunk failure rate of a rule is above.  Up to ``send``
    rejected hosts are sent to all tasks."""

    min_words: int = 10
    repeat_words: int = 20
    dup_lines: int = 50
    symbols: int = 50
    window: int = 5
    send: int = 500_000
    host_limits: dict[str, float] = field(default_factory=lambda: {"short": 0.5, "repeats": 0.5, "lines": 0.5, "symbols": 0.5})


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), BLANK, " " * len(BLANK)), " "), "")


def measured(docs: DataFrame, cfg: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """``(row, m)`` for every row of docs: the row itself (of it the columns ``keep``, if given) and the counts of its whole text.

    ``n_repeat_words`` are words in windows of five that occur twice or more in the text.  Windows are
    compared by 64-bit hashes; only texts with a repeated hash are sorted.  Nothing is shuffled.
    """
    k = cfg.window
    text = F.col("m_text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("m_text"))
    out = out.withColumns({"m_words": words(text), "m_lines": lines})
    out = out.withColumns(
        {
            "m_n": F.size("m_words"),
            "m_chars": F.length(F.translate(text, BLANK, "")),
            "m_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
            "m_n_lines": F.size("m_lines"),
            "m_dup": F.size("m_lines") - F.size(F.array_distinct("m_lines")),
            "m_hash": F.when(
                F.size("m_words") > k,
                F.transform(F.sequence(F.lit(0), F.size("m_words") - k), lambda i: F.xxhash64(*(F.get("m_words", i + j) for j in range(k)))),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    repeats = F.size(F.array_distinct("m_hash")) < F.size("m_hash")
    numbered = F.transform("m_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn("m_sorted", F.when(repeats, F.sort_array(numbered)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter("m_sorted", lambda x, i: F.coalesce(F.get("m_sorted", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("m_sorted", i + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn("m_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # Windows at p and the next start q cover min(k, q - p) new words.
    steps = F.transform("m_at", lambda p, i: F.coalesce(F.least(F.lit(k), F.get("m_at", i + 1) - p), F.lit(k)))
    out = out.withColumn("m_repeat", F.aggregate(steps, F.lit(0), lambda a, x: a + x))
    m = {"n_words": "m_n", "word_chars": "m_chars", "n_symbols": "m_symbols", "n_lines": "m_n_lines", "n_dup_lines": "m_dup", "n_repeat_words": "m_repeat"}
    # Exploding the one struct keeps later filters from being moved below: they would count everything anew.
    return out.select("row", F.explode(F.array(F.struct(*(F.col(c).cast("long").alias(n) for n, c in m.items())))).alias("m"))


def failures(m: str, cfg: Rules) -> dict[str, Column]:
    """The rules that count for a host."""
    c = {n: F.col(f"{m}.{n}") for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
    return {
        "short": c["n_words"] < cfg.min_words,
        "repeats": 100 * c["n_repeat_words"] > cfg.repeat_words * c["n_words"],
        "lines": 100 * c["n_dup_lines"] > cfg.dup_lines * c["n_lines"],
        "symbols": 100 * c["n_symbols"] > cfg.symbols * c["word_chars"],
    }


def host_verdicts(rows: DataFrame, host: str, cfg: Rules = Rules()) -> DataFrame:
    """``(host, rule, n, failed, rate, rejected)``: failure rates per host, shrunk by an empirical beta prior.

    The prior of each rule comes from all hosts by the method of moments: its mean is the overall rate,
    its strength follows from how much more the hosts differ than chance would make them.  A rule that nobody
    or everybody fails, or a single host, leaves the rate as it is.  Rows without a host count for none.
    """
    sums = [F.count("*").alias("n"), *(F.sum(ok.cast("long")).alias(f"f_{name}") for name, ok in failures("m", cfg).items())]
    wide = rows.where(F.col(f"row.{host}").isNotNull()).groupBy(F.col(f"row.{host}").alias("host")).agg(*sums)
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"f_{name}").alias("failed"), F.lit(limit).alias("limit")) for name, limit in cfg.host_limits.items()))
    long = wide.select("host", "n", F.inline(pairs))
    x = F.expr("double(failed) * failed / n")
    prior = long.groupBy("rule").agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.sum("failed").alias("bad"), F.sum(F.expr("double(n) * n")).alias("n2"), F.sum(x).alias("f2"))
    prior = prior.withColumn("mean", F.expr("double(bad) / total")).withColumn("free", F.expr("total - n2 / total - (k - 1)"))
    spread = F.when((F.col("mean") > 0) & (F.col("mean") < 1) & (F.col("free") > 0), F.expr("((f2 - total * mean * mean) / nullif(mean * (1 - mean), 0) - (k - 1)) / nullif(free, 0)"))
    prior = prior.withColumn("rho", F.least(F.greatest(spread, F.lit(1e-6)), F.lit(1 - 1e-6)))
    prior = prior.select("rule", "mean", F.coalesce(F.expr("(1 - rho) / rho"), F.lit(0.0)).alias("strength"))
    # One row for each rule: small whatever the input.
    out = long.join(F.broadcast(prior), "rule")
    rate = F.expr("(failed + mean * strength) / (n + strength)")
    return out.select("host", "rule", "n", "failed", rate.alias("rate"), (rate > F.col("limit")).alias("rejected"))


def judged(docs: DataFrame, host: str = "source", cfg: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """``(row, m, base_failed, host_rejected, kept)`` for every row of docs; ``keep`` (with the host) narrows the rows.

    A document is kept if its own rules pass (enough words, few repeated ones) and its host is not rejected.
    A null or empty text has no words and fails; a document without a host is judged by itself.
    """
    # Written: the rates of hosts and the verdicts both read the counts, and counting a text costs more than keeping it.
    rows = written(measured(docs, cfg, keep), "measured")
    fails = failures("m", cfg)
    bad = host_verdicts(rows, host, cfg).where("rejected").select(F.col("host").alias("m_host")).distinct().withColumn("m_bad", F.lit(True))
    out = rows.withColumn("base_failed", fails["short"] | fails["repeats"])
    # Written, so that its size is known: a short list goes to the documents, and no text is shuffled by host.  A long one
    # is joined by host, where large hosts are split at run time.
    bad = written(bad, "hosts")
    out = out.join(F.broadcast(bad) if bad.count() <= cfg.send else bad, F.col(f"row.{host}") == F.col("m_host"), "left").withColumn("host_rejected", F.coalesce("m_bad", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("m_host", "m_bad")
