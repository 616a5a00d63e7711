"""Runs: gap-and-island segmentation of a unit's active time.

Input is the unit frame, one row per unit and bucket on the dense grid.  All windows share the
partition key ``unit``, so one exchange serves the whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import days_between, half_even, median, seconds
from ..settings import Settings


def online_mask(sensor_median, hot: float) -> Column:
    """Unit is firing: the median sensor is hot; unknown counts as off."""
    return F.coalesce(F.col(sensor_median) > F.lit(hot), F.lit(False))


def add_activity(frame: DataFrame, cfg: Settings, use_online: bool = True) -> DataFrame:
    """Add ``cracking``: feed above a share of its running level and, if asked, unit online.

    A unit without any feed value falls back to the online mask.
    """
    unit = Window.partitionBy("unit")
    out = frame.withColumn("_top", F.max("feed_total").over(unit)).withColumn(
        "_level",
        median(F.when(F.col("feed_total") > F.col("_top") * cfg.level_floor, F.col("feed_total"))).over(unit),
    )
    online = online_mask("sensor_median", cfg.hot) if "sensor_median" in frame.columns else F.lit(False)
    fed = F.coalesce(F.col("feed_total") > F.col("_level") * cfg.feed_frac, F.lit(False))
    active = (fed & online) if use_online and "sensor_median" in frame.columns else fed
    return out.withColumn("cracking", F.when(F.col("_top").isNull(), online).otherwise(active)).drop("_top", "_level")


def label_runs(frame: DataFrame, cfg: Settings, active: str = "cracking") -> DataFrame:
    """Add ``run_id``, ``run_start``, ``run_end`` to every grid row (NULL outside runs).

    Short interruptions stay inside a run; a run starts and ends on an active row; runs shorter
    than ``min_run_days`` are dropped and the rest numbered from 0.
    """
    order = Window.partitionBy("unit").orderBy("ts")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("unit").orderBy(F.col("ts").desc()).rowsBetween(Window.unboundedPreceding, 0)
    island = Window.partitionBy("unit", "_island")
    own = F.when(F.col(active), F.col("ts"))
    limit = F.lit(cfg.gap_limit_s)
    out = (
        frame.withColumn("_next", F.last(own, ignorenulls=True).over(back))
        .withColumn("_seen", F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn(
            "_new",
            F.col(active) & (F.col("_seen").isNull() | (seconds("ts") - seconds("_seen") >= limit)),
        )
        .withColumn("_island", F.sum(F.col("_new").cast("int")).over(so_far))
        .withColumn(
            "_inside",
            F.col(active)
            | F.coalesce(seconds("_next") - seconds("_seen") < limit, F.lit(False)),
        )
        .withColumn("_start", F.min(own).over(island))
        .withColumn("_end", F.max(own).over(island))
        .withColumn(
            "_kept", F.col("_inside") & (days_between("_end", "_start") >= F.lit(cfg.min_run_days))
        )
        .withColumn(
            "_run", F.sum((F.col("_kept") & (F.col("ts") == F.col("_start"))).cast("int")).over(so_far) - 1
        )
    )
    kept = F.col("_kept")
    return (
        out.withColumn("run_id", F.when(kept, F.col("_run").cast("int")))
        .withColumn("run_start", F.when(kept, F.col("_start")))
        .withColumn("run_end", F.when(kept, F.col("_end")))
        .drop("_next", "_seen", "_new", "_island", "_inside", "_start", "_end", "_kept", "_run")
    )


def segment_runs(mask: DataFrame, cfg: Settings, active: str = "cracking") -> DataFrame:
    """(unit, run, start, end) from a mask on a grid; needs only the active rows."""
    order = Window.partitionBy("unit").orderBy("ts")
    gap = seconds("ts") - seconds(F.lag("ts").over(order))
    islands = (
        mask.where(F.col(active))
        .select("unit", "ts", F.coalesce(gap >= F.lit(cfg.gap_limit_s), F.lit(True)).cast("int").alias("_new"))
        .withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("unit", "_island")
        .agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
        .where(days_between("end", "start") >= F.lit(cfg.min_run_days))
    )
    number = F.row_number().over(Window.partitionBy("unit").orderBy("start")) - 1
    return islands.select("unit", number.alias("run"), "start", "end")


def runs_of(frame: DataFrame) -> DataFrame:
    """(unit, run, start, end) of a labelled frame."""
    return (
        frame.where(F.col("run_id").isNotNull())
        .groupBy("unit", F.col("run_id").alias("run"))
        .agg(F.min("run_start").alias("start"), F.max("run_end").alias("end"))
    )


def run_age_days() -> Column:
    """Days since the start of the row's run, NULL outside runs."""
    return days_between("ts", "run_start")


def attach_runs(index: DataFrame, runs: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Run number and age for arbitrary (unit, ts) rows; both ends of a run belong to it.

    Runs are laid out per day, so the join is an equality on (unit, day) and each row meets only
    the runs of its own day instead of every run of its unit.
    """
    days = runs.select(
        "unit",
        F.col("run").alias("run_id"),
        F.col(start).alias("run_start"),
        F.col(end).alias("run_end"),
        F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("_day"),
    )
    hits = index.withColumn("_day", F.to_date("ts")).alias("i").join(
        days.alias("d"),
        (F.col("i.unit") == F.col("d.unit"))
        & (F.col("i._day") == F.col("d._day"))
        & F.col("i.ts").between(F.col("d.run_start"), F.col("d.run_end")),
        "left",
    )
    return hits.select(
        "i.*", "d.run_id", "d.run_start", "d.run_end", days_between("i.ts", "d.run_start").alias("run_age_days")
    ).drop("_day")


def run_table(runs: DataFrame) -> DataFrame:
    return runs.select(
        "unit", "run", "start", "end", half_even(days_between("end", "start"), 2).alias("length_days")
    )


def complete_cycles(runs: DataFrame, data_start, data_end, cfg: Settings) -> DataFrame:
    """Runs bounded by a gap on both sides; they keep their numbers."""
    edge = F.lit(cfg.edge_hours * 3600)
    first, last = F.lit(data_start).cast("timestamp"), F.lit(data_end).cast("timestamp")
    return runs.where(
        (seconds("start") - seconds(first) >= edge) & (seconds(last) - seconds("end") >= edge)
    )


def gaps(runs: DataFrame) -> DataFrame:
    """Idle interval between each run and the next one of its unit."""
    nxt = F.lead("start").over(Window.partitionBy("unit").orderBy("start"))
    return (
        runs.select("unit", "run", F.col("end").alias("gap_start"), nxt.alias("gap_end"))
        .where(F.col("gap_end").isNotNull())
        .withColumn("gap_days", days_between("gap_end", "gap_start"))
    )


def run_stats(table: DataFrame) -> DataFrame:
    """Number of runs and run length statistics per unit.

    Lengths carry two decimals: they are added as whole hundredths, so that a mean that lies on an exact half is rounded
    the same whatever the order of the rows.
    """
    x = F.col("length_days")
    cents = F.round(x * 100).cast("long")
    n, total = F.count(x), F.sum(cents).cast("decimal(18,0)")
    apart = n.cast("decimal(18,0)") * F.sum(cents * cents).cast("decimal(18,0)") - total * total
    return table.groupBy("unit").agg(
        n.alias("count"),
        half_even(F.try_divide(total.cast("double"), n * F.lit(100.0)), 1).alias("mean"),
        half_even(F.sqrt(F.try_divide(apart.cast("double"), (n * (n - 1)).cast("double"))) / 100.0, 1).alias("std"),
        half_even(F.min(x), 1).alias("min"),
        half_even(F.max(x), 1).alias("max"),
    )


def run_histogram(table: DataFrame, width: float = 2.0, bins: int = 19) -> DataFrame:
    """Run lengths in bins of equal width from 0; the last bin is closed on the right."""
    top = width * bins
    x = F.col("length_days")
    index = F.when(x == top, F.lit(bins - 1)).otherwise(F.floor(x / width)).cast("int")
    return (
        table.where(x.between(0.0, top))
        .groupBy(index.alias("bin"))
        .agg(F.count(F.lit(1)).alias("runs"))
        .select("bin", (F.col("bin") * width).alias("lo"), ((F.col("bin") + 1) * width).alias("hi"), "runs")
    )


def median_run_length(table: DataFrame) -> DataFrame:
    """Median over all runs; lengths carry two decimals, so the buffer holds few distinct values."""
    return table.agg(F.count("length_days").alias("runs"), median("length_days").alias("median_days"))
