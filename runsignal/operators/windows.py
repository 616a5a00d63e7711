"""Analysis windows: the settled part of each run, and what is cut from it.

Everything is computed on feature rows that already carry ``run_id``, ``run_start`` and
``run_end``; windows partition by (unit, run).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import days_between, half_even, hours_between, median, plus_hours
from ..settings import PASSES, Settings
from ..sources.historian import sent_if_small
from .changepoint import change_points

RUN = ["unit", "run_id"]


def _run_rows(features: DataFrame) -> DataFrame:
    return features.where(F.col("run_id").isNotNull())


def add_feed_ok(rows: DataFrame, cfg: Settings) -> DataFrame:
    """``feed_ok``: feed above a share of the run's own running feed."""
    run = Window.partitionBy(*RUN)
    feed = F.col("feed_total")
    return (
        rows.withColumn("_top", F.max(feed).over(run))
        .withColumn("_med", median(F.when(feed > F.col("_top") * cfg.run_level_floor, feed)).over(run))
        .withColumn("feed_ok", F.coalesce(feed > F.col("_med") * cfg.settled_frac, F.lit(False)))
        .drop("_top", "_med")
    )


def rolling_std(value: str, cfg: Settings) -> Column:
    """Trailing sample deviation inside the run; needs ``roll_min`` values."""
    frame = Window.partitionBy(*RUN).orderBy("ts").rowsBetween(-(cfg.roll_rows - 1), 0)
    return F.when(F.count(value).over(frame) >= cfg.roll_min, F.stddev_samp(value).over(frame))


def finish_windows(bounds: DataFrame) -> DataFrame:
    """Durations of windows given by their four time stamps, rounded half to even."""
    return bounds.withColumns(
        {
            "warmup_hours": half_even(hours_between("analysis_start", "run_start"), 1),
            "tail_hours": half_even(hours_between("run_end", "analysis_end"), 1),
            "length_days": half_even(days_between("run_end", "run_start"), 2),
            "clean_days": half_even(days_between("analysis_end", "analysis_start"), 2),
        }
    )


WINDOW_COLUMNS = [
    "unit", "run", "run_start", "run_end", "analysis_start", "analysis_end",
    "warmup_hours", "tail_hours", "length_days", "clean_days", "settled",
]


def label_windows(features: DataFrame, cfg: Settings, cot: str | None = "cot") -> DataFrame:
    """Add ``analysis_start``, ``analysis_end`` and ``settled`` of the run to every row of it.

    The window goes from the first settled row to the last row with full feed.  Rows outside runs
    keep NULLs.  No join: the bounds are aggregates over the run's own partition.
    """
    run = Window.partitionBy(*RUN)
    rows = add_feed_ok(features, cfg)
    calm = F.lit(True)
    if cot:
        rows = rows.withColumn("_std", rolling_std(cot, cfg))
        calm = F.coalesce(F.col("_std") < cfg.cot_std, F.lit(False))
    earliest = plus_hours("run_start", cfg.warmup_hours)
    good = F.col("feed_ok") & calm & (F.col("ts") >= earliest)
    in_run = F.col("run_id").isNotNull()
    return (
        rows.withColumn("_first", F.min(F.when(good, F.col("ts"))).over(run))
        .withColumn("_last", F.max(F.when(F.col("feed_ok"), F.col("ts"))).over(run))
        .withColumn("settled", F.when(in_run, F.col("_first").isNotNull()))
        .withColumn("analysis_start", F.when(in_run, F.coalesce("_first", earliest)))
        .withColumn(
            "analysis_end",
            F.when(
                in_run,
                F.when(F.col("_last") > F.col("analysis_start"), F.col("_last")).otherwise(F.col("run_end")),
            ),
        )
        .drop("_first", "_last", "_std", "feed_ok")
    )


def windows_of(labelled: DataFrame) -> DataFrame:
    """One row per run of a frame that has been through ``label_windows``."""
    keep = ("run_start", "run_end", "analysis_start", "analysis_end", "settled")
    bounds = _run_rows(labelled).groupBy("unit", F.col("run_id").alias("run")).agg(*[F.max(c).alias(c) for c in keep])
    return finish_windows(bounds).select(*WINDOW_COLUMNS)


def analysis_windows(features: DataFrame, cfg: Settings, cot: str | None = "cot") -> DataFrame:
    """One window per run."""
    return windows_of(label_windows(features, cfg, cot))


AIR = tuple(f"decoke_air_{p}" for p in PASSES)
SIGNALS = ("feed_total", "cot_ctrl", "cot")


def _with_signals(rows: DataFrame) -> DataFrame:
    """Adds missing signal columns as NULL, and per unit whether it has values of each (``_has_*``)."""
    absent = {c: F.lit(None).cast("double") for c in (*AIR, *SIGNALS) if c not in rows.columns}
    rows = rows.withColumns(absent) if absent else rows
    some = {"air": F.count(F.coalesce(*(F.col(c) for c in AIR))), **{c: F.count(c) for c in SIGNALS}}
    has = rows.groupBy("unit").agg(*((n > 0).alias(f"_has_{c}") for c, n in some.items()))
    return rows.join(sent_if_small(has), "unit")


def analysis_windows_v2(features: DataFrame, cfg: Settings) -> DataFrame:
    """Three layers: gap flag, setpoint stability and change points, combined per row.

    Each layer uses its preferred signal in the units where it has values, else its fallback; a unit gets the same
    windows alone and among others.
    """
    rows = _run_rows(_with_signals(features))
    run = Window.partitionBy(*RUN)
    order = run.orderBy("ts")

    rows = add_feed_ok(rows, cfg)
    flagged = F.coalesce(F.greatest(*(F.col(c) for c in AIR), F.lit(float("-inf"))) > cfg.air_on, F.lit(False))
    has_air, has_set, has_cot = (F.col(f"_has_{c}") for c in ("air", "cot_ctrl", "cot"))
    rows = rows.withColumn("_on", F.when(has_air, ~flagged).otherwise(F.col("feed_ok")))

    step = F.coalesce(F.abs(F.col("cot_ctrl") - F.lag("cot_ctrl").over(order)), F.lit(0.0)) > cfg.setpoint_step
    std = F.coalesce(rolling_std("cot_ctrl", cfg), F.lit(999.0)) < cfg.setpoint_std
    measured = F.coalesce(rolling_std("cot", cfg), F.lit(999.0)) < cfg.cot_std
    rows = rows.withColumn("_stable", F.when(has_set, ~step & std).when(has_cot, measured).otherwise(F.lit(True)))

    # The unit's own first two signals.
    there = F.filter(F.array(*(F.struct(F.col(f"_has_{c}").alias("has"), F.col(c).cast("double").alias("v")) for c in SIGNALS)), lambda x: x["has"])
    rows = rows.withColumns({"_n_signals": F.least(F.size(there), F.lit(2)), "_s1": F.get(there, F.lit(0))["v"], "_s2": F.get(there, F.lit(1))["v"]})
    breaks = change_points(rows, ["_s1", "_s2"], cfg, "_n_signals")  # one row per run
    floor = plus_hours("run_start", cfg.warmup_hours)
    found = F.size("breaks") > 0
    rows = rows.withColumn("_row", F.row_number().over(order) - 1).withColumn("_rows", F.count(F.lit(1)).over(run))
    joined = rows.join(breaks, RUN, "left")
    first_break = F.try_element_at("breaks", F.lit(1))
    last_break = F.when(F.size("breaks") > 1, F.try_element_at("breaks", F.lit(-1))).otherwise(F.col("_rows") - 1)
    inside = F.when(
        found,
        (F.col("_row") >= first_break) & (F.col("_row") <= last_break),
    ).otherwise(F.lit(True))
    valid = (
        inside
        & (F.col("ts") >= floor)
        & F.col("_on")
        & F.col("_stable")
        & (F.col("_rows") >= 2 * cfg.cp_min_rows)
    )
    bounds = (
        joined.groupBy("unit", F.col("run_id").alias("run"), "run_start", "run_end")
        .agg(
            F.min(F.when(valid, F.col("ts"))).alias("analysis_start"),
            F.max(F.when(valid, F.col("ts"))).alias("analysis_end"),
            F.max("_rows").alias("_n"),
            F.coalesce(F.bool_or(found), F.lit(False)).alias("_cp"),
            F.bool_or("_has_air").alias("_air"),
        )
        .withColumn("settled", F.col("analysis_start").isNotNull())
    )
    long_enough = F.col("_n") >= 2 * cfg.cp_min_rows
    methods = {
        "pelt_used": F.col("_cp") & long_enough,
        "warmup_method": F.when(~long_enough, "none")
        .when(F.col("_cp"), "pelt")
        .otherwise(f"heuristic_{cfg.warmup_hours:g}h"),
        "decoke_method": F.when(~long_enough, "none").when(F.col("_air"), "decoke_air").otherwise("feed_heuristic"),
    }
    return finish_windows(bounds).withColumns(methods).select(*WINDOW_COLUMNS, *methods)


def attach_windows(features: DataFrame, windows: DataFrame) -> DataFrame:
    """Bounds from a stored window table, by (unit, run)."""
    w = windows.select("unit", F.col("run").alias("run_id"), "analysis_start", "analysis_end")
    return features.join(w, RUN, "left")


def in_window() -> Column:
    """Row lies in its run's window, both ends included; an empty window holds no row."""
    inside = (F.col("analysis_end") > F.col("analysis_start")) & F.col("ts").between(
        F.col("analysis_start"), F.col("analysis_end")
    )
    return F.coalesce(inside, F.lit(False))


def clean_rows(labelled: DataFrame, phase: str = "clean") -> DataFrame:
    return labelled.where(in_window()).withColumn("phase", F.lit(phase))


def retention(labelled: DataFrame) -> DataFrame:
    """Rows before and after the cut, share kept and number of runs, per unit."""
    out = labelled.withColumn("_in", in_window()).groupBy("unit").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("_in").alias("clean_rows"),
        F.count_distinct(F.when(F.col("_in"), F.col("run_id"))).alias("runs"),
    )
    return out.withColumn("pct_kept", 100.0 * F.col("clean_rows") / F.col("total_rows"))


def window_averages(windows: DataFrame) -> DataFrame:
    return windows.groupBy("unit").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if("settled").alias("settled"),
        F.avg("warmup_hours").alias("warmup_avg"),
        F.avg("tail_hours").alias("tail_avg"),
        F.avg("clean_days").alias("clean_avg"),
        F.avg("length_days").alias("length_avg"),
    )


def suspicious(windows: DataFrame, warmup_over: float = 48.0, tail_over: float = 48.0) -> DataFrame:
    return windows.where((F.col("warmup_hours") > warmup_over) | (F.col("tail_hours") > tail_over))


def quality_class(windows: DataFrame, cfg: Settings) -> DataFrame:
    def grade(x, amber):
        return F.when(F.col(x) > cfg.red_hours, "red").when(F.col(x) > amber, "amber").otherwise("green")

    return windows.withColumn("warmup_class", grade("warmup_hours", cfg.warmup_amber_hours)).withColumn(
        "tail_class", grade("tail_hours", cfg.tail_amber_hours)
    )


def compare_windows(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Second method against the first, per run; runs the first method lacks keep NULLs."""
    a = v1.select(
        "unit",
        "run",
        F.col("warmup_hours").alias("warmup_h_v1"),
        F.col("tail_hours").alias("tail_h_v1"),
        F.col("clean_days").alias("clean_d_v1"),
    )
    b = v2.select(
        "unit",
        "run",
        F.col("warmup_hours").alias("warmup_h_v2"),
        F.col("tail_hours").alias("tail_h_v2"),
        F.col("clean_days").alias("clean_d_v2"),
        "pelt_used",
        "decoke_method",
    )
    return (
        b.join(a, ["unit", "run"], "left")
        .withColumn("delta_clean_days", half_even(F.col("clean_d_v2") - F.col("clean_d_v1"), 2))
        .withColumn("delta_warmup_h", half_even(F.col("warmup_h_v2") - F.col("warmup_h_v1"), 1))
    )


def comparison_means(compared: DataFrame) -> DataFrame:
    return compared.groupBy("unit").agg(
        F.avg("delta_clean_days").alias("mean_delta_clean_days"), F.avg("delta_warmup_h").alias("mean_delta_warmup_h")
    )


def method_counts(v2: DataFrame) -> DataFrame:
    return v2.groupBy("unit").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if("settled").alias("settled"),
        F.count_if("pelt_used").alias("pelt_runs"),
        F.count_if(F.col("decoke_method") == "decoke_air").alias("air_runs"),
    )


def windows_from_clean(clean: DataFrame) -> DataFrame:
    """Window bounds recovered from clean rows when the window table is gone."""
    return clean.groupBy("unit", F.col("run_id").alias("run")).agg(
        F.min("ts").alias("analysis_start"),
        F.max("ts").alias("analysis_end"),
        F.min("ts").alias("run_start"),
        F.max("ts").alias("run_end"),
    )


def zones(labelled: DataFrame) -> DataFrame:
    """All rows of each run labelled warmup, clean or tail."""
    zone = (
        F.when(F.col("ts") < F.col("analysis_start"), "warmup")
        .when(F.col("ts") <= F.col("analysis_end"), "clean")
        .otherwise("tail")
    )
    return labelled.where(F.col("analysis_start").isNotNull()).withColumn("zone", zone)


def context_rows(features: DataFrame, windows: DataFrame, cfg: Settings) -> DataFrame:
    """Rows of the given runs plus some hours on either side, in five zones.

    A row may belong to two runs.  The windows are laid out per day, so the join is an equality
    on (unit, day).
    """
    w = (
        windows.select("unit", "run", "run_start", "run_end", "analysis_start", "analysis_end")
        .withColumn("_from", plus_hours("run_start", -cfg.context_hours))
        .withColumn("_to", plus_hours("run_end", cfg.context_hours))
        .withColumn("_day", F.explode(F.sequence(F.to_date("_from"), F.to_date("_to"))))
    )
    keep = [c for c in features.columns if c not in ("run_start", "run_end")]
    hits = (
        features.select(*keep)
        .withColumn("_day", F.to_date("ts"))
        .join(w, ["unit", "_day"])
        .where(F.col("ts").between(F.col("_from"), F.col("_to")))
    )
    zone = (
        F.when(F.col("ts") < F.col("run_start"), "before")
        .when(F.col("ts") < F.col("analysis_start"), "warmup")
        .when(F.col("ts") <= F.col("analysis_end"), "clean")
        .when(F.col("ts") <= F.col("run_end"), "tail")
        .otherwise("after")
    )
    return hits.withColumn("zone", zone).drop("_day", "_from", "_to")


def apply_exclusions(clean: DataFrame, exclusions: DataFrame, value: str = "dd_abs_max") -> DataFrame:
    """Blank ``value`` where a row lies in a listed (unit, reason, t0, t1), ends included; keep the row."""
    reasons = _exclusion_hits(clean, exclusions).groupBy("unit", "ts").agg(F.min("reason").alias("excluded"))
    out = clean.join(reasons, ["unit", "ts"], "left")
    return out.withColumn(value, F.when(F.col("excluded").isNull(), F.col(value)))


def exclusion_counts(clean: DataFrame, exclusions: DataFrame) -> DataFrame:
    return _exclusion_hits(clean, exclusions).groupBy("unit", "reason").agg(F.count(F.lit(1)).alias("n"))


def _exclusion_hits(clean: DataFrame, exclusions: DataFrame) -> DataFrame:
    days = exclusions.withColumn("_day", F.explode(F.sequence(F.to_date("t0"), F.to_date("t1"))))
    return (
        clean.select("unit", "ts", F.to_date("ts").alias("_day"))
        .join(days, ["unit", "_day"])
        .where(F.col("ts").between(F.col("t0"), F.col("t1")))
    )
