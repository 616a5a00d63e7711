"""Delta (deviation from the pass) and drift (delta since the start of the run).

Shuffle plan: the join with the labels distributes the sensor rows by (unit, ts), or leaves them as they are if they come by unit.
The pass mean and the health aggregation work on that distribution.  The baseline reads only the first hours of each run,
shrinks to one row per run and sensor and is written once, so that its size is known when it is
joined back.  Where rows and labels come by unit it is a window over them, without a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import none_if_nan, plus_hours, seconds, spread_over, steady_mean
from ..functions.rolling import rolling_medians
from ..settings import PASSES, Settings
from ..sources.historian import sent_if_small
from ..sources.tables import stage

LABELS = ("unit", "ts", "cracking", "run_id", "run_start")


def sensor_delta(sensors: DataFrame, frame: DataFrame, cfg: Settings, by_pass: bool = True) -> DataFrame:
    """(unit, id, grp, ts, run_id, run_start, value, delta) for live sensors of active rows.

    A sensor without a pass has a NULL delta.  With ``by_pass=False`` the reference is the mean
    of the whole unit.
    """
    live = (
        sensors.select("unit", "id", "grp", "ts", "value")
        .where(F.col("value") > F.lit(cfg.hot))
        .join(frame.where(F.col("cracking")).select("unit", "ts", "run_id", "run_start"), ["unit", "ts"])
    )
    if by_pass:
        pack = steady_mean("value", Window.partitionBy("unit", "ts", "grp"))
        return live.withColumn("delta", F.when(F.col("grp").isNotNull(), F.col("value") - pack))
    return live.withColumn("delta", F.col("value") - steady_mean("value", Window.partitionBy("unit", "ts")))


def sensor_drift(sensors: DataFrame, frame: DataFrame, cfg: Settings, by_pass: bool = True, by_unit: bool = False) -> DataFrame:
    """``sensor_delta`` plus ``baseline`` and ``drift``; both NULL outside runs or without a baseline.

    ``by_unit``: sensors and frame lie in the same buckets of units, so the rows of a run and sensor are found where they are.
    """
    if by_unit:
        early = F.when(F.col("ts") <= plus_hours("run_start", cfg.baseline_hours), F.col("delta"))
        baseline = steady_mean(early, Window.partitionBy("unit", "run_id", "id"))
        rows = sensor_delta(sensors, frame, cfg, by_pass).withColumn("baseline", baseline)
        return rows.withColumn("drift", F.col("delta") - F.col("baseline"))
    early = frame.where(F.col("ts") <= plus_hours("run_start", cfg.baseline_hours))
    baseline = stage(
        sensor_delta(sensors, sent_if_small(early.select(*LABELS)), cfg, by_pass)
        .groupBy("unit", "run_id", "id")
        .agg(steady_mean("delta").alias("baseline")),
        "baseline",
    )
    return (
        sensor_delta(sensors, frame, cfg, by_pass)
        .join(sent_if_small(baseline), ["unit", "run_id", "id"], "left")
        .withColumn("drift", F.col("delta") - F.col("baseline"))
    )


def worst_of(columns: dict[str, Column]) -> Column:
    """Name of the largest column; the first name wins ties, NULL when all are NULL."""
    top = F.greatest(*columns.values())
    out = F.lit(None).cast("string")
    for name, value in reversed(list(columns.items())):
        out = F.when(value == top, F.lit(name)).otherwise(out)
    return out


def health(drift: DataFrame) -> DataFrame:
    """Unit and pass health per bucket, all from one aggregation."""
    return drift.groupBy("unit", "ts").agg(
        (F.max("delta") - F.min("delta")).alias("delta_spread"),
        F.max("drift").alias("dd_max"),
        F.max(F.abs("drift")).alias("dd_abs_max"),
        F.percentile("drift", 0.95).alias("dd_p95"),
        *[F.max(F.when(F.col("grp") == p, F.abs("drift"))).alias(f"dd_abs_max_{p}") for p in PASSES],
    )


def pass_balance(frame: DataFrame) -> DataFrame:
    """Add ``pass_imbalance`` (NULL for units with a single instrumented pass) and ``worst_pass``."""
    per_pass = {p: F.col(f"dd_abs_max_{p}") for p in PASSES}
    unit = Window.partitionBy("unit")
    seen = [F.max(c.isNotNull().cast("int")).over(unit) for c in per_pass.values()]
    return (
        frame.withColumn("_passes", sum(seen[1:], seen[0]))
        .withColumn("pass_imbalance", F.when(F.col("_passes") > 1, spread_over(list(per_pass.values()))))
        .withColumn("worst_pass", worst_of(per_pass))
        .drop("_passes")
    )


def centred(rows: int) -> tuple[int, int]:
    """Rows behind and ahead in a frame of ``rows``; one of even length looks one row further back."""
    ahead = (rows - 1) // 2
    return rows - 1 - ahead, ahead


def grid_position(ts, bucket_s: int) -> Column:
    """Number of a bucket of the dense grid."""
    return F.floor(seconds(ts) / F.lit(int(bucket_s)))


# Up to this many rows a median frame is sorted anew for each row, in place; longer ones go through ``rolling_medians``.
SHORT_FRAME = 64


def short_median(value: str, keys: list[str], position: str, behind: int, ahead: int, least: int) -> Column:
    """The same as ``rolling_medians`` has, as a window expression: rows stay where they are."""
    return _frame_median(value, Window.partitionBy(*keys).orderBy(position).rangeBetween(-behind, ahead), least)


def rolling_median(value: str, keys: list[str], rows: int, least: int) -> Column:
    """Median over ``rows`` rows of the dense grid around each, as a window expression; NULL below ``least`` values."""
    behind, ahead = centred(rows)
    return _frame_median(value, Window.partitionBy(*keys).orderBy("ts").rowsBetween(-behind, ahead), least)


def _frame_median(value: str, frame: Window, least: int) -> Column:
    half = F.lit(0.5)
    at = lambda v, i: F.get(v, i.cast("int"))
    values = F.sort_array(F.collect_list(none_if_nan(F.col(value))).over(frame))
    middle = lambda v: F.when(F.size(v) % 2 == 1, at(v, F.floor(F.size(v) / 2))).otherwise(
        half * at(v, F.floor(F.size(v) / 2) - 1) + half * at(v, F.floor(F.size(v) / 2))
    )
    return F.transform(F.array(values), lambda v: F.when(F.size(v) >= least, middle(v)))[0]


def drift_rate(series: DataFrame, cfg: Settings, value: str = "dd_abs_max", name: str = "coking_rate") -> DataFrame:
    """Change per day of the smoothed drift, restarted in every run.

    ``series`` must be on the dense grid with ``run_id``.
    """
    rows = cfg.rows(cfg.rate_hours, least=2)
    behind, ahead = centred(rows)
    smooth, least = f"{value}_med", max(2, rows // 3)
    if rows <= SHORT_FRAME:
        out = series.withColumn("_at", grid_position("ts", cfg.bucket_s)).withColumn(smooth, short_median(value, ["unit", "run_id"], "_at", behind, ahead, least))
    else:
        out = rolling_medians(series.withColumn("_at", grid_position("ts", cfg.bucket_s)), ["unit", "run_id"], F.col("_at"), [value], behind, ahead, least)
    step_h = cfg.bucket_s / 3600.0
    change = F.col(smooth) - F.lag(smooth).over(Window.partitionBy("unit", "run_id").orderBy("_at"))
    return out.withColumn(name, F.when(F.col("run_id").isNotNull(), change / F.lit(step_h) * 24.0)).drop(smooth, "_at")
