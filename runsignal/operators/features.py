"""Feature matrix: one row per unit and bucket, one job for all units."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import days_between, half_even, median, ratio, spread_over, steady_mean, steady_sum
from ..settings import PASSES, PLANT, STEAM_TO_VOLUME, Settings
from ..sources.historian import sent_if_small
from ..sources.tables import stage, stage_by
from . import drift as dr
from .catalog import choose_sensor_role
from .resample import fill_grid
from .runs import add_activity, label_runs, run_age_days

SENSOR = "sensor"

# Composition columns, the role they come from and the description pattern.
SPECIES = (
    ("feed_C2H6", "feed_GC", "C2H6"),
    ("feed_C3H8", "feed_GC", "C3H8"),
    ("feed_C4H10", "feed_GC", "C4H10"),
    ("feed_C5p", "feed_GC", "C5+"),
    ("feed_CO2", "feed_GC", "CO2"),
    ("eff_C2H4", "effluent_GC", "C2H4"),
    ("eff_C3H6", "effluent_GC", "C3H6"),
    ("eff_CH4", "effluent_GC", "CH4"),
    ("eff_C2H6", "effluent_GC", "C2H6"),
    ("eff_C3H8", "effluent_GC", "C3H8"),
)

# Columns of the finished matrix in their documented order.
FEATURE_COLUMNS = (
    ["cot", "feed_total", "steam_total", "steam_hc", "resid_proxy", "coil_out_P", "draft", "feed_coilT"]
    + ["feed_C2H6", "feed_C3H8", "feed_C4H10", "feed_C5p", "feed_CO2"]
    + ["tube_cot_mean", "dd_abs_max", "dd_p95", "delta_spread", "coking_rate"]
    + ["eff_C2H4", "eff_C3H6", "eff_CH4", "eff_C2H6", "eff_C3H8"]
    + [f"{kind}_{p}" for p in PASSES for kind in ("feed", "steam", "steam_hc")]
    + ["steam_hc_spread"]
    + [f"dd_abs_max_{p}" for p in PASSES]
    + ["pass_imbalance", "worst_pass", "run_id", "run_age_days", "cracking"]
)


def mark_sensors(history: DataFrame, catalog: DataFrame | None, proxy: bool = False) -> DataFrame:
    """Give the chosen sensor set of each unit the role ``sensor`` and drop the other set.

    Without a catalog every unit is taken to have the dense set.
    """
    is_set = F.col("role").isin("tube_COT", "tube_COT_long")
    if catalog is None:
        return history.where(F.col("role") != "tube_COT_long").withColumn(
            "role", F.when(is_set, F.lit(SENSOR)).otherwise(F.col("role"))
        )
    # One row per unit; joining by unit with a shuffle would gather a large unit's rows.
    chosen = sent_if_small(choose_sensor_role(catalog, proxy))
    return (
        history.join(chosen, "unit", "left")
        .where(~is_set | (F.col("role") == F.col("sensor_role")))
        .withColumn("role", F.when(is_set, F.lit(SENSOR)).otherwise(F.col("role")))
        .drop("sensor_role")
    )


def _value(role: str, extra: Column | None = None) -> Column:
    cond = F.col("role") == role
    return F.when(cond if extra is None else cond & extra, F.col("value"))


def unit_levels(history: DataFrame, cfg: Settings) -> DataFrame:
    """``unit_levers`` and the median of the sensors, per unit and bucket."""
    return with_median(unit_levers(history, cfg), history)


def with_median(levels: DataFrame, history: DataFrame) -> DataFrame:
    """Adds the median of the sensors.

    The exact median needs an object buffer, which would take the whole aggregation out of
    generated code; it is computed on the sensor rows alone and joined on the same keys.
    """
    sensors = history.where((F.col("unit") != PLANT) & (F.col("role") == SENSOR))
    medians = sensors.groupBy("unit", "ts").agg(median("value").alias("sensor_median"))
    return levels.join(medians, ["unit", "ts"], "left")


def unit_levers(history: DataFrame, cfg: Settings) -> DataFrame:
    """Per unit and bucket: sums and means of every lever."""
    grp = F.col("grp")
    own = history.where(F.col("unit") != PLANT)
    return (
        own.groupBy("unit", "ts")
        .agg(
            steady_mean(_value("cot_ctrl")).alias("cot"),
            steady_sum(_value("feed_flow")).alias("feed_total"),
            steady_sum(_value("dil_steam")).alias("steam_total"),
            steady_mean(_value("coil_out_P")).alias("coil_out_P"),
            steady_mean(_value("draft")).alias("draft"),
            steady_mean(_value("feed_coilT")).alias("feed_coilT"),
            steady_mean(_value(SENSOR, F.col("value") > cfg.hot)).alias("tube_cot_mean"),
            *[steady_sum(_value("feed_flow", grp == p)).alias(f"feed_{p}") for p in PASSES],
            *[steady_sum(_value("dil_steam", grp == p)).alias(f"steam_{p}") for p in PASSES],
            *[steady_mean(_value("decoke_air", grp == p)).alias(f"decoke_air_{p}") for p in PASSES],
        )
    )


SUMMED = ["feed_total", "steam_total"] + [f"{k}_{p}" for k in ("feed", "steam") for p in PASSES]


def zero_where_silent(frame: DataFrame, columns=SUMMED) -> DataFrame:
    """A sum over tags that are all missing reads as 0; NULL only if the unit never had such a tag."""
    unit = Window.partitionBy("unit")
    known = {c: F.max(F.col(c).isNotNull()).over(unit) for c in columns}
    return frame.withColumns({c: F.when(k, F.coalesce(F.col(c), F.lit(0.0))) for c, k in known.items()})


def species_tags(catalog: DataFrame, history: DataFrame) -> DataFrame:
    """(unit, id, species): the first catalogued tag per composition column that returned data."""
    loaded = history.where(F.col("role").isin("feed_GC", "effluent_GC")).select("unit", "id", "role").distinct()
    options = F.array(
        *[
            F.when((F.col("role") == role) & F.col("description").rlike(token), F.lit(column))
            for column, role, token in SPECIES
        ]
    )
    return (
        catalog.join(loaded, ["unit", "id", "role"])
        .withColumn("species", F.explode(F.array_compact(options)))
        .groupBy("unit", "species")
        .agg(F.min(F.struct("ord", "id")).alias("t"))
        .select("unit", F.col("t.id").alias("id"), "species")
    )


def _species_columns(rows: DataFrame, keys: list[str], role: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("species") == c, F.col("value"))).alias(c) for c, r, _ in SPECIES if r == role]
    )


# The plant-wide feed has one row per bucket; up to this many rows it is sent to every executor.
BROADCAST_BUCKETS = 1_000_000


def gas_rows(history: DataFrame, catalog: DataFrame) -> DataFrame:
    return history.where(F.col("role").isin("feed_GC", "effluent_GC")).join(
        species_tags(catalog, history), ["unit", "id"]
    )


def add_effluent(levels: DataFrame, gases: DataFrame) -> DataFrame:
    rows = gases.where(F.col("role") == "effluent_GC")
    return levels.join(_species_columns(rows, ["unit", "ts"], "effluent_GC"), ["unit", "ts"], "left")


def feed_quality(gases: DataFrame) -> DataFrame:
    """Composition of the common feed per bucket, the same for every unit."""
    return _species_columns(gases.where(F.col("role") == "feed_GC"), ["ts"], "feed_GC")


def unit_constants(levels: DataFrame, cfg: Settings) -> DataFrame:
    """One row per unit: which summed levers it has, and the running level of each pass's feed."""
    tops = levels.groupBy("unit").agg(
        *[(F.count(c) > 0).alias(f"has_{c}") for c in SUMMED],
        *[F.max(f"feed_{p}").alias(f"top_{p}") for p in PASSES],
    )
    running = {
        p: F.when(F.col(f"feed_{p}") > F.col(f"top_{p}") * cfg.level_floor, F.col(f"feed_{p}")) for p in PASSES
    }
    typical = (
        levels.select("unit", *[f"feed_{p}" for p in PASSES])
        .join(sent_if_small(tops), "unit")
        .groupBy("unit")
        .agg(*[median(x).alias(f"level_{p}") for p, x in running.items()])
    )
    return tops.join(typical, "unit")


def with_constants(rows: DataFrame, cfg: Settings) -> DataFrame:
    """``unit_constants`` added to grid rows that have their levers: the same values without a second pass over the levels."""
    unit = Window.partitionBy("unit")
    out = rows.withColumns(
        {**{f"has_{c}": F.count(c).over(unit) > 0 for c in SUMMED}, **{f"top_{p}": F.max(f"feed_{p}").over(unit) for p in PASSES}}
    )
    running = {p: F.when(F.col(f"feed_{p}") > F.col(f"top_{p}") * cfg.level_floor, F.col(f"feed_{p}")) for p in PASSES}
    return out.withColumns({f"level_{p}": median(x).over(unit) for p, x in running.items()})


def label_frame(levels: DataFrame, cfg: Settings, plant: DataFrame | None = None, use_online: bool = True) -> DataFrame:
    """Narrow unit frame on the dense grid: feed, sensor median, activity and run labels.

    Only what the labels need goes through the sorts.  Units without sensors are left out.
    """
    narrow = fill_grid(levels.select("unit", "ts", "feed_total", "sensor_median"), cfg.bucket_s, plant)
    has_sensor = F.max(F.col("sensor_median").isNotNull()).over(Window.partitionBy("unit"))
    frame = zero_where_silent(narrow, ["feed_total"]).withColumn("_has", has_sensor).where("_has").drop("_has")
    return label_runs(add_activity(frame, cfg, use_online), cfg)


def feed_frame(history: DataFrame, cfg: Settings) -> DataFrame:
    """Feed only: total feed on the dense grid, mask and runs without looking at sensors."""
    feed = (
        history.where(F.col("role") == "feed_flow").groupBy("unit", "ts").agg(steady_sum("value").alias("feed_total"))
    )
    frame = zero_where_silent(fill_grid(feed, cfg.bucket_s), ["feed_total"])
    return label_runs(add_activity(frame, cfg, use_online=False), cfg)


def steam_per_feed(frame: DataFrame, cfg: Settings) -> DataFrame:
    """Steam ratio of the unit and of every pass, and its spread over the passes.

    A pass ratio counts only while the pass runs above a share of its own running level
    (``top_<P>`` and ``level_<P>`` from ``unit_constants``).
    """
    ratios = {
        f"steam_hc_{p}": F.when(
            (F.col(f"top_{p}") > 0) & (F.col(f"feed_{p}") > F.col(f"level_{p}") * cfg.feed_frac),
            ratio(f"steam_{p}", f"feed_{p}"),
        )
        for p in PASSES
    }
    return frame.withColumns(ratios).withColumns(
        {
            "steam_hc": F.when(F.col("feed_total") > 0, ratio("steam_total", "feed_total")),
            "steam_hc_spread": spread_over([f"steam_hc_{p}" for p in PASSES]),
        }
    )


def residence(frame: DataFrame) -> DataFrame:
    """Inverse of the total volume flow; a missing side counts as 0, both missing is NULL."""
    feed, steam = F.col("feed_total"), F.col("steam_total") * F.lit(STEAM_TO_VOLUME)
    total = F.when(
        feed.isNotNull() | steam.isNotNull(),
        F.coalesce(feed, F.lit(0.0)) + F.coalesce(steam, F.lit(0.0)),
    )
    return frame.withColumn("_t", total).withColumn(
        "resid_proxy", F.when(F.col("_t") > 0, F.lit(1.0) / F.col("_t"))
    ).drop("_t")


@dataclass
class Prepared:
    """The intermediate tables every later step starts from; written once each; ``history`` and ``levels`` only if kept."""

    history: DataFrame           # bucketed long history, sensors marked
    levels: DataFrame            # levers per unit and bucket that has data
    labels: DataFrame            # narrow frame on the dense grid with runs
    constants: DataFrame | None  # one row per unit; None: made from the levels where they are used
    feed: DataFrame | None       # common feed composition per bucket
    by_unit: bool = False        # history and labels lie in the same buckets of units

    @property
    def sensors(self) -> DataFrame:
        return self.history.where(F.col("role") == SENSOR)


def prepare(
    history: DataFrame, catalog: DataFrame | None, cfg: Settings, proxy: bool = False, use_online: bool = True, keep: bool = True, buckets: int = 0
) -> Prepared:
    """Build the shared tables.

    Without a catalog there are no composition columns and no plant-wide tags.  ``keep=False`` is for a history that is cheaper to
    build again from its source than to write and distribute: already distributed by unit, it then goes through levels, drift and
    health without another exchange, and each step builds only the columns that it needs.  ``buckets``: the history lies in so many
    buckets of units; the labels are then written alike, so no step exchanges or sends them.
    """
    kept = stage if keep else lambda df, name: df
    if catalog is None:
        marked = kept(mark_sensors(history, None), "history")
        levers, feed, plant = unit_levers(marked, cfg), None, None
    else:
        tags = stage(catalog, "catalog")
        marked = kept(mark_sensors(history, tags, proxy), "history")
        # Analysers of the common feed belong to the plant: one row per bucket and tag.
        plant = stage(marked.where(F.col("unit") == PLANT), "plant")
        feed = stage(feed_quality(gas_rows(plant, tags)), "feed")
        levers = add_effluent(unit_levers(marked, cfg), gas_rows(marked.where(F.col("unit") != PLANT), tags))
    levels = stage(with_median(levers, marked), "levels") if keep else levers
    labels = label_frame(levels if keep else with_median(unit_levers(marked, cfg), marked), cfg, plant, use_online)
    labels = stage_by(labels, "labels", ("unit",), buckets, ("unit", "ts")) if buckets else stage(labels, "labels")
    constants = stage(unit_constants(levels, cfg), "constants") if keep else None
    return Prepared(marked, levels, labels, constants, feed, buckets > 0)


def complete(rows: DataFrame, prep: Prepared, cfg: Settings) -> DataFrame:
    """Add every lever and ratio to labelled grid rows; one join on (unit, ts), no window."""
    levers = prep.levels.drop("feed_total", "sensor_median")
    out = rows.join(levers, ["unit", "ts"], "left")
    out = with_constants(out, cfg) if prep.constants is None else out.join(sent_if_small(prep.constants), "unit")
    zeros = {
        c: F.when(F.col(f"has_{c}"), F.coalesce(F.col(c), F.lit(0.0))) for c in SUMMED if c != "feed_total"
    }
    out = out.withColumns(zeros)
    if prep.feed is not None:
        out = out.join(sent_if_small(prep.feed, BROADCAST_BUCKETS), "ts", "left")
    return residence(steam_per_feed(out, cfg)).drop(*[f"has_{c}" for c in SUMMED], *[f"{k}_{p}" for k in ("top", "level") for p in PASSES])


def unit_frame(prep: Prepared, cfg: Settings) -> DataFrame:
    """Labelled grid rows with all levers, without drift."""
    return complete(prep.labels, prep, cfg)


def with_health(prep: Prepared, cfg: Settings) -> DataFrame:
    """The labels with health columns and coking rate."""
    drift = dr.sensor_drift(prep.sensors, prep.labels, cfg, by_unit=prep.by_unit)
    joined = prep.labels.join(dr.health(drift), ["unit", "ts"], "left")
    return dr.drift_rate(dr.pass_balance(joined), cfg)


def build_features(prep: Prepared, cfg: Settings, extras: bool = False) -> DataFrame:
    """The feature matrix; ``extras`` adds ``cot_ctrl`` and ``decoke_air_<P>`` for the second window method."""
    full = complete(with_health(prep, cfg), prep, cfg).withColumn("run_age_days", run_age_days())
    more = ["cot_ctrl"] + [f"decoke_air_{p}" for p in PASSES] if extras else []
    if extras:
        full = full.withColumn("cot_ctrl", F.col("cot"))
    absent = {c: F.lit(None).cast("double") for c in FEATURE_COLUMNS if c not in full.columns}
    full = full.withColumns(absent) if absent else full
    return full.select("unit", "ts", *FEATURE_COLUMNS, "run_start", "run_end", *more)


# Drivers averaged per run.
SUMMARY_DRIVERS = (
    "cot", "feed_total", "steam_hc", "resid_proxy", "coil_out_P", "draft",
    "feed_C2H6", "feed_C3H8", "feed_C5p", "eff_C2H4",
)


def run_summary(features: DataFrame, cfg: Settings) -> DataFrame:
    """One row per run over its active rows: mean drivers, coking slope and final drift."""
    last = F.row_number().over(Window.partitionBy("unit", "run_id").orderBy(F.col("ts").desc()))
    drivers = [c for c in SUMMARY_DRIVERS if c in features.columns]
    rows = features.where(F.col("run_id").isNotNull() & F.col("cracking")).withColumn("_back", last)
    x, y = F.col("run_age_days"), F.col("dd_abs_max")
    return (
        rows.groupBy("unit", F.col("run_id").alias("run"))
        .agg(
            F.min("run_start").alias("start"),
            half_even(days_between(F.max("run_end"), F.min("run_start")), 2).alias("length_days"),
            *[F.avg(c).alias(c) for c in drivers],
            median(F.when(F.col("_back") <= cfg.tail_rows, y)).alias("dd_end"),
            F.when(F.regr_count(y, x) > 5, half_even(F.regr_slope(y, x), 3)).alias("coking_slope_Cpd"),
        )
    )
