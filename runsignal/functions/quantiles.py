"""Exact quantiles of groups that are too large for one task.

``percentile`` keeps a whole group's distinct values in one aggregation buffer.  That is fine
for a bounded series, not for values pooled over all units.  Here a mergeable sketch first
brackets the wanted rank, one counting pass then keeps only the values inside the bracket
(a share of about ``4 / ACCURACY`` of the group), and the exact value is read from those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.historian import sent_if_small
from ..sources.tables import stage

ACCURACY = 2000


def pooled_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per key with ``n`` and one exact, linearly interpolated quantile per entry of ``probs``."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    # The sketch sees every value weighted by how often it occurs.
    margin = 2.0 / ACCURACY
    sketch = [
        F.expr(f"approx_percentile({value}, {max(0.0, p - margin)!r}D, {ACCURACY})").alias(f"_lo_{k}")
        for k, p in probs.items()
    ] + [
        F.expr(f"approx_percentile({value}, {min(1.0, p + margin)!r}D, {ACCURACY})").alias(f"_hi_{k}")
        for k, p in probs.items()
    ]
    brackets = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("_min"), F.max(value).alias("_max"), *sketch)
    )
    # The bracket must span a few ranks beyond the sketch error; small groups are taken whole.
    whole = F.col("n") * margin < 4
    wanted = F.array(
        *[
            F.struct(
                F.lit(k).alias("_k"),
                (F.lit(float(p)) * (F.col("n") - 1)).alias("_pos"),
                F.when(whole | F.lit(p - margin <= 0), F.col("_min")).otherwise(F.col(f"_lo_{k}")).alias("_from"),
                F.when(whole | F.lit(p + margin >= 1), F.col("_max")).otherwise(F.col(f"_hi_{k}")).alias("_to"),
            )
            for k, p in probs.items()
        ]
    )
    targets = brackets.select(*keys, "n", F.explode(wanted).alias("_q")).select(
        *keys, "n", "_q._k", "_q._pos", "_q._from", "_q._to"
    )
    # A few rows per key, written once: the sketch pass is not repeated and its size is known.
    hit = counts.join(sent_if_small(stage(targets, "ranks")), keys)
    low = F.col("_v") < F.col("_from")
    reduced = (
        hit.where(F.col("_v") <= F.col("_to"))
        .withColumn("_v", F.when(~low, F.col("_v")))  # everything below the bracket folds into one row
        .groupBy(*keys, "_k", "_v")
        .agg(F.sum("_c").alias("_c"), F.first("_pos").alias("_pos"), F.first("n").alias("n"))
    )
    w = Window.partitionBy(*keys, "_k").orderBy(F.col("_v").asc_nulls_first())
    placed = reduced.withColumn("_end", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.min(F.when(F.col("_end") > F.floor("_pos"), F.col("_v")))
    right = F.min(F.when(F.col("_end") > F.ceil("_pos"), F.col("_v")))
    frac = F.first(F.col("_pos") - F.floor("_pos"))
    exact = placed.groupBy(*keys, "_k").agg(
        F.first("n").alias("n"), (left + (right - left) * frac).alias("_x")
    )
    out = exact.groupBy(*keys).agg(
        F.first("n").alias("n"), *[F.max(F.when(F.col("_k") == k, F.col("_x"))).alias(k) for k in probs]
    )
    return out
