"""Tag and signal quality.  Works on bucketed history, so a tag has at most one row per bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import days_between, pearson, seconds
from ..settings import Settings


def tag_health(history: DataFrame, cfg: Settings, gap_factor: float = 1.0) -> DataFrame:
    """Range, mean, share of unchanged values and number of gaps per tag."""
    w = Window.partitionBy("unit", "id").orderBy("ts")
    prev = F.lag("value").over(w)
    step = seconds("ts") - seconds(F.lag("ts").over(w))
    rows = history.select(
        "unit",
        "id",
        "value",
        F.when(prev.isNotNull(), (F.col("value") == prev).cast("double")).alias("_same"),
        (step > F.lit(gap_factor * cfg.bucket_s)).alias("_gap"),
    )
    return (
        rows.groupBy("unit", "id")
        .agg(
            F.count("value").alias("n"),
            F.min("value").alias("vmin"),
            F.max("value").alias("vmax"),
            F.avg("value").alias("vmean"),
            F.avg("_same").alias("flat_share"),
            F.count_if("_gap").alias("gaps"),
        )
        .withColumn("exclude", F.coalesce(F.col("flat_share") >= cfg.flat_share, F.lit(False)))
    )


def mark_spikes(features: DataFrame, cfg: Settings, value: str = "dd_abs_max") -> DataFrame:
    """Label stretches above the spike level and blank those too short to be real.

    Needs grid rows.  A stretch lasts its rows times the bucket width.
    """
    order = Window.partitionBy("unit").orderBy("ts")
    high = F.coalesce(F.col(value) > cfg.spike, F.lit(False))
    edge = F.coalesce(high != F.lag(high).over(order), F.lit(True))
    out = (
        features.withColumn("_edge", edge.cast("int"))
        .withColumn("_part", F.sum("_edge").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy("unit", "_part")))
    )
    short = F.col("_rows") * F.lit(cfg.bucket_s) < F.lit(cfg.spike_hours * 3600)
    return (
        out.withColumn("spike", F.when(high, F.when(short, "removed").otherwise("kept")))
        .withColumn("spike_start", high & F.col("_edge").cast("boolean"))
        .withColumn(value, F.when(F.col("spike").isNull() | (F.col("spike") == "kept"), F.col(value)))
        .drop("_edge", "_part", "_rows")
    )


def spike_counts(marked: DataFrame) -> DataFrame:
    start = F.col("spike_start")
    return marked.groupBy("unit").agg(
        F.count_if(start & (F.col("spike") == "removed")).alias("removed"),
        F.count_if(start & (F.col("spike") == "kept")).alias("kept"),
        F.count_if(F.col("spike") == "removed").alias("rows_blanked"),
    )


def alarm_band(x, cfg: Settings):
    return F.when(x >= cfg.alarm, "alarm").when(x >= cfg.prealarm, "prealarm").when(x.isNotNull(), "normal")


def alarms(features: DataFrame, cfg: Settings, value: str = "dd_abs_max") -> DataFrame:
    """Rows in each band and first crossings, per run."""
    x = F.col(value)
    rows = features.where(F.col("run_id").isNotNull()).withColumn("_band", alarm_band(x, cfg))
    age = days_between("ts", "run_start")
    return rows.groupBy("unit", F.col("run_id").alias("run")).agg(
        F.count_if(F.col("_band") == "normal").alias("normal_rows"),
        F.count_if(F.col("_band") == "prealarm").alias("prealarm_rows"),
        F.count_if(F.col("_band") == "alarm").alias("alarm_rows"),
        F.min(F.when(x >= cfg.prealarm, F.col("ts"))).alias("first_prealarm"),
        F.min(F.when(x >= cfg.alarm, F.col("ts"))).alias("first_alarm"),
        F.min(F.when(x >= cfg.alarm, age)).alias("days_to_alarm"),
    )


def pass_mean_check(sensors: DataFrame, recorded: DataFrame) -> DataFrame:
    """Mean of a pass's sensors against the recorded pass mean (unit, grp, ts, value)."""
    built = sensors.groupBy("unit", "grp", "ts").agg(F.avg("value").alias("built"))
    both = built.join(recorded.withColumnRenamed("value", "recorded"), ["unit", "grp", "ts"])
    diff = F.col("built") - F.col("recorded")
    return both.groupBy("unit", "grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(diff).alias("bias"),
        F.stddev_samp(diff).alias("std"),
        pearson("built", "recorded").alias("corr"),
    )


def proxy_check(dense: DataFrame, proxy: DataFrame, value: str = "dd_abs_max") -> DataFrame:
    """Drift from the sparse sensors against the dense ones where both exist."""
    both = (
        dense.select("unit", "ts", F.col(value).alias("dense"))
        .join(proxy.select("unit", "ts", F.col(value).alias("proxy")), ["unit", "ts"])
        .where(F.col("dense").isNotNull() & F.col("proxy").isNotNull())
    )
    diff = F.col("proxy") - F.col("dense")
    return both.groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(diff).alias("bias"),
        F.stddev_samp(diff).alias("std"),
        pearson("dense", "proxy").alias("corr"),
    )


def pinned_values(history: DataFrame) -> DataFrame:
    """Share of the most frequent value, distinct values and zeros per tag.

    Values are counted before they meet per tag, so a tag stuck at one value costs one row.
    """
    counts = history.groupBy("unit", "id", "value").agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy("unit", "id").agg(
        F.sum("_c").alias("n"),
        F.count(F.lit(1)).alias("distinct_values"),
        (F.max("_c") / F.sum("_c")).alias("mode_share"),
        (F.coalesce(F.sum(F.when(F.col("value") == 0, F.col("_c"))), F.lit(0)) / F.sum("_c")).alias("zero_share"),
    )
