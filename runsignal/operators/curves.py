"""Data behind the usual charts: bands, trajectories, smoothed fleet curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import days_between
from ..functions.rolling import rolling_medians
from ..settings import PASSES, Settings
from ..sources.historian import sent_if_small
from ..sources.tables import stage
from .drift import centred, grid_position

BAND = ("lo", "q1", "med", "q3", "hi", "mean")


def pass_bands(drift: DataFrame, frame: DataFrame, cfg: Settings, smooth: bool = True) -> DataFrame:
    """Distribution of sensor drift per pass and bucket on the dense grid, smoothed over the whole series."""
    raw = (
        drift.where(F.col("drift").isNotNull() & F.col("grp").isNotNull())
        .groupBy("unit", "ts", "grp")
        .agg(
            F.min("drift").alias("lo"),
            F.max("drift").alias("hi"),
            F.percentile("drift", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
            F.avg("drift").alias("mean"),
        )
        .select("unit", "ts", "grp", "lo", F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3"), "hi", "mean")
    )
    grid = frame.select("unit", "ts", F.explode(F.array(*[F.lit(p) for p in PASSES])).alias("grp"))
    out = grid.join(raw, ["unit", "ts", "grp"], "left")
    present = F.max(F.col("med").isNotNull()).over(Window.partitionBy("unit", "grp"))
    out = out.withColumn("_p", present).where("_p").drop("_p")
    rows = cfg.rows(cfg.band_hours)
    if smooth and rows > 1:
        smoothed = rolling_medians(out, ["unit", "grp"], grid_position("ts", cfg.bucket_s), list(BAND), *centred(rows), 1)
        out = smoothed.select("unit", "grp", "ts", *[F.col(f"{c}_med").alias(c) for c in BAND])
    return out.select("unit", "grp", "ts", *BAND)


def axis_range(bands: DataFrame, least: float = 10.0, margin: float = 1.15) -> DataFrame:
    """Robust value range of a unit's bands, so that single spikes do not set the scale."""
    high = F.greatest(F.percentile("hi", 0.99), F.lit(least)) * margin
    low = F.least(F.percentile("lo", 0.01), F.lit(-least)) * margin
    return bands.groupBy("unit").agg(low.alias("ymin"), high.alias("ymax"))


def trajectories(frame: DataFrame, value: str = "dd_max") -> DataFrame:
    """Worst signed drift against run age, one line per run."""
    return frame.where(F.col("run_id").isNotNull()).select(
        "unit", "run_id", "ts", days_between("ts", "run_start").alias("run_age_days"), value
    )


def overlay(clean: DataFrame, value: str = "dd_abs_max") -> DataFrame:
    """Clean trajectories re-based at the start of the analysis window."""
    return clean.select(
        "unit", "run_id", "ts", days_between("ts", "analysis_start").alias("age_days"), value
    ).where(F.col("age_days") >= 0)


def fleet_smooth(series: DataFrame, cfg: Settings, value: str = "dd_abs_max") -> DataFrame:
    """Trailing rolling median per unit on the union of all units' time stamps.

    Frames count union rows.  A unit's curve reaches past its own last row as long as its frame
    still holds enough values.  The union has at most one row per bucket.
    """
    rows = cfg.rows(cfg.fleet_hours)
    least = max(1, rows // 3)
    series = stage(series.select("unit", "ts", value), "series")
    # Time stamps are numbered inside their month, after the counts of the months before: one row a month.
    stamps = series.select("ts", F.date_trunc("month", "ts").alias("_m")).distinct()
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    months = stamps.groupBy(F.col("_m").alias("_b")).agg(F.count(F.lit(1)).alias("_n")).select("_b", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_m").orderBy("ts"))
    numbered = stamps.withColumn("_in", inside).join(sent_if_small(months), F.col("_m") == F.col("_b"))
    union = stage(numbered.select("ts", (F.col("_in") + F.col("_before")).cast("int").alias("_pos")), "stamps")
    placed = series.select("unit", "ts", value).join(union, "ts")
    last = F.max("_pos").over(Window.partitionBy("unit"))
    reach = F.when(F.col("_pos") == last, F.sequence(F.lit(0), F.lit(rows - 1))).otherwise(F.array(F.lit(0)))
    longer = placed.select("unit", "_pos", value, reach.alias("_r")).select(
        "unit", F.explode("_r").alias("_k"), (F.col("_pos") + F.col("_k")).alias("_pos"), value
    )
    own = longer.select("unit", "_pos", F.when(F.col("_k") == 0, F.col(value)).alias(value))
    smooth = rolling_medians(own, ["unit"], F.col("_pos"), [value], rows - 1, 0, least)
    return smooth.join(union, "_pos").select("unit", "ts", value, F.col(f"{value}_med").alias("smooth"))


def clean_share(windows: DataFrame) -> DataFrame:
    """Clean against total days of every run, with the unit's mean."""
    mean = F.avg("clean_days").over(Window.partitionBy("unit"))
    return windows.select("unit", "run", "length_days", "clean_days", mean.alias("mean_clean_days"))
