"""Whole analyses as jobs that read events and metadata and write tables.

One job covers every unit at once; ``unit`` narrows it to one.  Nothing is collected: the only
actions are table writes.  Tables already present are reused unless ``refresh`` is set.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import as_number
from ..operators import catalog as ct
from ..operators import corr as co
from ..operators import curves as cv
from ..operators import drift as dr
from ..operators import features as ft
from ..operators import fleet as fl
from ..operators import partials as pt
from ..operators import quality as ql
from ..operators import resample as rs
from ..operators import runs as rn
from ..operators import windows as wn
from ..settings import PASSES, PLANT, Settings
from ..sources import tables as tb
from ..sources.historian import good_samples, only_tags


def load_catalog(spark: SparkSession, metadata: DataFrame, out: str, refresh: bool = False) -> DataFrame:
    """Saved catalog, or a new one; a saved one without the pass column gets it added."""
    catalog = tb.read_or_build(spark, f"{out}/catalog", lambda: ct.build_catalog(metadata), refresh, by=None)
    return catalog if "grp" in catalog.columns else ct.add_pass(catalog)


def _only(catalog: DataFrame, unit: str | None) -> DataFrame:
    return ct.tags_for(catalog, unit) if unit else catalog


def history_of(events: DataFrame, catalog: DataFrame, start, end, cfg: Settings) -> DataFrame:
    return rs.load_history(good_samples(events, start, end), catalog, cfg.bucket_s)


def coverage_report(
    spark: SparkSession, events: DataFrame, metadata: DataFrame, out: str, unit: str | None = None, refresh: bool = False,
) -> None:
    """Samples per tag and year, and per role and year."""
    tags = _only(load_catalog(spark, metadata, out, refresh), unit)
    _coverage_tables(spark, tags, rs.coverage_by_year(events, tags), rs.coverage(events, tags), out)


def stored_coverage_report(
    spark: SparkSession, store: str, metadata: DataFrame, out: str, unit: str | None = None, state_s: int = 3600,
) -> list[str]:
    """The same from an event store: only days that are new since the last report are read; returns them."""
    tags = _only(load_catalog(spark, metadata, out), unit)
    fresh = pt.refresh_states(spark, store, f"{out}/states", state_s)
    states = only_tags(pt.read_states(spark, f"{out}/states"), tags)
    _coverage_tables(spark, tags, pt.years_from(states), pt.coverage_from(states), out)
    return fresh


def _coverage_tables(spark: SparkSession, tags: DataFrame, years: DataFrame, coverage: DataFrame, out: str) -> None:
    tb.write_table(years, f"{out}/coverage_by_year", by=None)
    by_year = tb.read_table(spark, f"{out}/coverage_by_year")
    tb.write_table(coverage, f"{out}/coverage", by=None)
    tb.write_table(rs.coverage_matrix(by_year), f"{out}/coverage_matrix", by=None)
    tb.write_table(rs.role_by_year(by_year, tags), f"{out}/coverage_roles", by=None)
    tb.write_table(ct.count_roles(tags), f"{out}/catalog_roles", by=None)
    tb.write_table(ct.count_passes(tags), f"{out}/catalog_passes", by=None)
    tb.write_table(ct.incomplete_passes(tags), f"{out}/catalog_incomplete", by=None)


def feature_tables(
    spark: SparkSession, events: DataFrame, metadata: DataFrame, out: str, start, end, cfg: Settings = Settings(),
    unit: str | None = None, proxy: bool = False, refresh: bool = False,
) -> DataFrame:
    """Feature matrix with everything that needs the sensors: drift bands, trajectories, tag health.

    Saved tables are kept apart by unit, range, mode and settings (``request_folder``), and each is reused only if it is
    complete: another request, or a job cut off half-way, never answers this one.
    """
    at = request_folder(out, unit, start, end, proxy, cfg)
    made: dict = {}

    def prepared():
        if not made:
            tags = _only(load_catalog(spark, metadata, out, refresh), unit)
            made["prep"] = ft.prepare(history_of(events, tags, start, end, cfg), tags, cfg, proxy=proxy)
        return made["prep"]

    builders = {
        "features": (lambda: ft.build_features(prepared(), cfg, extras=True), "unit"),
        "pass_bands": (lambda: cv.pass_bands(dr.sensor_drift(prepared().sensors, prepared().labels, cfg), prepared().labels, cfg), "unit"),
        "axis_range": (lambda: cv.axis_range(tb.read_table(spark, f"{at}/pass_bands")), None),
        "trajectories": (lambda: cv.trajectories(ft.with_health(prepared(), cfg)), "unit"),
        "tag_health": (lambda: ql.tag_health(prepared().history, cfg), None),
    }
    for name, (build, by) in builders.items():
        tb.read_or_build(spark, f"{at}/{name}", build, refresh, by=by)
    return tb.read_table(spark, f"{at}/features")


def refresh_units(
    spark: SparkSession, events: DataFrame, metadata: DataFrame, out: str, start, end, units: list[str], cfg: Settings = Settings(), proxy: bool = False,
) -> DataFrame:
    """Builds the features of some units anew and replaces just these in the saved fleet table."""
    at = f"{request_folder(out, None, start, end, proxy, cfg)}/features"
    catalog = load_catalog(spark, metadata, out)
    tags = catalog.where(F.col("unit").isin([*units, PLANT]))
    prepared = ft.prepare(history_of(events, tags, start, end, cfg), tags, cfg, proxy=proxy)
    tb.write_table(ft.build_features(prepared, cfg, extras=True), at, only=True)
    return tb.read_table(spark, at)


def request_folder(out: str, unit, start, end, proxy: bool, cfg: Settings) -> str:
    """Folder of one request's tables: the unit in clear, everything else that changes rows as a digest."""
    digest = hashlib.sha256(repr((str(start), str(end), proxy, cfg)).encode()).hexdigest()[:16]
    return f"{out}/requests/{unit or 'all'}-{digest}"


def clean_tables(
    spark: SparkSession, features: DataFrame, out: str, start, end, cfg: Settings = Settings(), setpoints: bool = True
) -> None:
    """Analysis windows by both methods, clean rows of each, and the comparison.

    Runs are found again from feed alone; only complete cycles are kept, under their own numbers.
    ``setpoints=False`` judges stability by the measured temperature even where set points are recorded.
    """
    bare = features.drop("run_id", "run_start", "run_end", "run_age_days", "cracking")
    labelled = rn.label_runs(rn.add_activity(bare, cfg, use_online=False), cfg)
    edge = F.lit(cfg.edge_hours * 3600)
    whole = (F.unix_timestamp("run_start") - F.unix_timestamp(F.lit(start).cast("timestamp")) >= edge) & (
        F.unix_timestamp(F.lit(end).cast("timestamp")) - F.unix_timestamp("run_end") >= edge
    )
    kept = {c: F.when(whole, F.col(c)) for c in ("run_id", "run_start", "run_end")}
    frame = tb.stage(labelled.withColumns(kept).withColumn("run_age_days", rn.run_age_days()), "cycles")
    tb.write_table(rn.run_table(rn.runs_of(labelled)), f"{out}/runs_all", by=None)

    first = tb.stage(wn.label_windows(frame, cfg), "windows")
    tb.write_csv(wn.windows_of(first), f"{out}/windows_csv")
    tb.write_table(wn.windows_of(first), f"{out}/windows", by=None)
    tb.write_table(wn.clean_rows(first), f"{out}/clean")
    tb.write_table(wn.retention(first), f"{out}/retention", by=None)
    tb.write_table(wn.zones(first), f"{out}/zones")
    v1 = tb.read_table(spark, f"{out}/windows")
    tb.write_table(wn.quality_class(v1, cfg), f"{out}/window_quality", by=None)

    tb.write_table(wn.analysis_windows_v2(frame.drop("cot_ctrl") if not setpoints else frame, cfg), f"{out}/windows_adv", by=None)
    v2 = tb.read_table(spark, f"{out}/windows_adv")
    tb.write_csv(v2, f"{out}/windows_adv_csv")
    tb.write_table(wn.clean_rows(wn.attach_windows(frame, v2), "clean_adv"), f"{out}/clean_adv")
    tb.write_table(wn.compare_windows(v1, v2), f"{out}/window_comparison", by=None)
    tb.write_table(wn.comparison_means(tb.read_table(spark, f"{out}/window_comparison")), f"{out}/window_comparison_means", by=None)
    tb.write_table(wn.method_counts(v2), f"{out}/window_methods", by=None)


def correlation_tables(spark: SparkSession, features: DataFrame, out: str, cfg: Settings = Settings()) -> None:
    tb.write_table(co.correlation_matrix(features, cfg), f"{out}/correlations", by=None)
    for target in ("coking_rate", "dd_abs_max"):
        tb.write_table(co.driver_rank(features, target, cfg), f"{out}/drivers_{target}", by=None)
    tb.write_table(co.lagged_correlation(features, "cot", "dd_abs_max", cfg), f"{out}/lags", by=None)
    tb.write_table(co.best_lag(tb.read_table(spark, f"{out}/lags")), f"{out}/best_lag", by=None)
    tb.write_table(co.phase_rank(features, "dd_abs_max", cfg), f"{out}/drivers_by_phase", by=None)
    tb.write_table(co.pass_correlations(features, cfg), f"{out}/drivers_by_pass", by=None)
    pairs = (("run_age_days", "dd_abs_max"), ("cot", "coking_rate"), ("steam_hc", "coking_rate"))
    for x, y in pairs:
        tb.write_table(co.pair_points(features, x, y), f"{out}/points_{x}_{y}")
    drivers = [c for c in co.DEFAULT_COLUMNS if c not in ("coil_out_P", "coking_rate") and not c.startswith("eff_")]
    clean = tb.read_table(spark, f"{out}/clean")
    tb.write_table(co.phase_correlations(clean, "dd_abs_max", [*drivers, "steam_hc_spread"]), f"{out}/phases", by=None)
    tb.write_table(co.classify_drivers(tb.read_table(spark, f"{out}/phases")), f"{out}/driver_classes", by=None)


def unit_report(
    spark: SparkSession, events: DataFrame, metadata: DataFrame, out: str, start, end, cfg: Settings = Settings(),
    unit: str | None = None, proxy: bool = False, refresh: bool = False,
) -> DataFrame:
    """Everything for one unit, or for all of them: features, runs, windows, correlations, alarms."""
    features = feature_tables(spark, events, metadata, out, start, end, cfg, unit, proxy, refresh)
    tb.write_table(rn.run_table(rn.runs_of(features)), f"{out}/runs", by=None)
    tb.write_csv(tb.read_table(spark, f"{out}/runs"), f"{out}/run_summary_csv")
    tb.write_table(ft.run_summary(features, cfg), f"{out}/run_summary", by=None)
    tb.write_table(
        co.run_level_correlations(tb.read_table(spark, f"{out}/run_summary")), f"{out}/run_level", by=None
    )
    tb.write_table(rn.gaps(rn.runs_of(features)), f"{out}/gaps", by=None)
    tb.write_table(ql.alarms(features, cfg), f"{out}/alarms", by=None)
    marked = ql.mark_spikes(features, cfg)
    tb.write_table(ql.spike_counts(marked), f"{out}/spikes", by=None)
    clean_tables(spark, features, out, start, end, cfg)
    correlation_tables(spark, features, out, cfg)
    return features


def fleet_report(
    spark: SparkSession, events: DataFrame, metadata: DataFrame, out: str, start, end, cfg: Settings = Settings(),
    proxy: bool = False, refresh: bool = False,
) -> None:
    """All units in one job, then the comparisons between them."""
    features = unit_report(spark, events, metadata, out, start, end, cfg, None, proxy, refresh)
    runs = tb.read_table(spark, f"{out}/runs")
    tb.write_table(rn.run_stats(runs), f"{out}/run_stats", by=None)
    tb.write_table(rn.run_histogram(runs), f"{out}/run_histogram", by=None)
    tb.write_table(rn.median_run_length(runs), f"{out}/run_median", by=None)
    tb.write_table(cv.fleet_smooth(features.select("unit", "ts", "dd_abs_max"), cfg), f"{out}/fleet_health")
    ranks = tb.read_table(spark, f"{out}/drivers_dd_abs_max")
    tb.write_table(fl.sign_agreement(ranks), f"{out}/sign_agreement", by=None)
    tb.write_table(fl.unit_outliers(runs), f"{out}/unit_outliers", by=None)
    tb.write_table(fl.pooled_by_age(features), f"{out}/pooled_by_age", by=None)


def recorded_pass_check(events: DataFrame, tags: DataFrame, sensors: DataFrame, start, end, cfg: Settings) -> DataFrame:
    """Reconstructed pass means against recorded ones; ``tags`` is (id, unit, grp) of the recorded tags."""
    samples = good_samples(events, start, end)
    recorded = rs.bucket_means(samples.join(tags.select("id"), "id", "left_semi"), cfg.bucket_s).join(tags, "id")
    return ql.pass_mean_check(sensors, recorded.select("unit", "grp", "ts", as_number(recorded, "value").alias("value")))
