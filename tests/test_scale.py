"""What keeps the larger tables within their limits: the same rows from fewer exchanges, files and calls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from runsignal.operators import changepoint as cp
from runsignal.operators import corr as co
from runsignal.operators import drift as dr
from runsignal.operators import runs as rn
from runsignal.settings import Settings
from runsignal.sources import store as st
from runsignal.sources import tables as tb


@pytest.mark.parametrize("min_rows,penalty", [(4, 1.0), (12, 10.0), (2, 0.3)])
def test_many_runs_at_once_have_the_breaks_of_each(min_rows, penalty):
    rng = np.random.default_rng(min_rows)
    sizes = rng.integers(1, cp.SHORT_RUN + 6, 200)
    edge, used = np.concatenate(([0], np.cumsum(sizes))), rng.integers(0, 3, 200)
    x = np.round(rng.normal(size=(edge[-1], 2)) + np.repeat(rng.integers(0, 3, edge[-1] // 5 + 1), 5)[: edge[-1], None], 1)
    x[rng.random(edge[-1]) < 0.0005] = np.nan
    got = cp.segments(x, used, edge, min_rows, penalty)
    each = [x[a:b, :k] for a, b, k in zip(edge, edge[1:], used)]
    assert got == [cp.segment(y, min_rows, penalty) if y.size and np.isfinite(y).all() else [] for y in each]
    assert any(got) or penalty > 5


def test_mean_run_length_on_an_exact_half(spark):
    # The mean is exactly 20.25; added as doubles these give less in one order and more in another.
    lengths = [20.12, 20.38, 20.31, 20.19, 20.1, 20.4, 0.01, 40.49] * 3
    for rows in (lengths, lengths[::-1], sorted(lengths)):
        df = spark.createDataFrame([("u", v) for v in rows], "unit string, length_days double").coalesce(1)
        got = rn.run_stats(df).first()
        assert (got["count"], got["mean"], got["min"], got["max"]) == (24, 20.2, 0.0, 40.5)
        assert got["std"] == pytest.approx(np.round(np.std(lengths, ddof=1), 1))
    one = rn.run_stats(spark.createDataFrame([("u", 3.25)], "unit string, length_days double")).first()
    assert (one["mean"], one["std"]) == (3.2, None)


@pytest.mark.parametrize("late,kind", [(0.1 - 1e-16, "unclassified"), (0.1, "unclassified"), (0.1 + 1e-16, "unclassified"), (0.0999, "weak")])
def test_a_correlation_of_exactly_the_level_is_not_below_it(spark, late, kind):
    rows = [("u", "x", 0, 12, 0.05, 0.9), ("u", "x", 1, 12, float(late), 0.8)]
    phases = spark.createDataFrame(rows, "unit string, driver string, phase int, n int, rho double, p double")
    assert co.classify_drivers(phases).first()["class"] == kind


def test_short_median_is_the_rolling_median(spark):
    rng = np.random.default_rng(1)
    rows = [(f"u{u}", int(i), None if rng.random() < 0.3 else float(np.round(rng.normal(), 1))) for u in range(2) for i in range(60) if i not in (20, 21)]
    df = spark.createDataFrame(rows, "unit string, at long, v double")
    long = dr.rolling_medians(df, ["unit"], F.col("at"), ["v"], 3, 4, 2)
    both = long.withColumn("short", dr.short_median("v", ["unit"], "at", 3, 4, 2)).collect()
    assert len(both) == len(rows) and [r.short for r in both] == [r.v_med for r in both]


def test_features_are_made_without_exchanges_of_sensor_rows(spark):
    plan = queries()["spikes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Lines by unit for the drift and for the levers, labels (twice) and the baseline at most.
    assert plan.count("Exchange hashpartitioning") <= 6


@pytest.mark.parametrize("name", ["feature_matrix", "run_summary", "feature_matrix_proxy", "feature_species"])
def test_lines_are_distributed_once_for_all_passes(spark, name):
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan and "Bucketed: true" in plan


@pytest.mark.parametrize("name", ["run_summary", "feature_matrix_proxy", "feature_species", "spikes"])
def test_labels_and_baseline_are_not_distributed_anew(spark, name):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    scans = [line for line in plan.splitlines() if "FileScan" in line and "labels" in line]
    assert scans and all("Bucketed: true" in line for line in scans)
    assert "run_start" not in "".join(line for line in plan.splitlines() if "Exchange" in line) and "/baseline-" not in plan


def test_baseline_as_a_window_is_the_baseline_of_two_passes(spark):
    rng = np.random.default_rng(2)
    grid = [(f"u{u}", int(t) * 3600, bool(rng.random() < 0.9), t // 40 if t % 40 < 30 else None) for u in range(3) for t in range(160)]
    frame = spark.createDataFrame([(u, t, c, r, None if r is None else r * 40 * 3600) for u, t, c, r in grid], "unit string, s long, cracking boolean, run_id int, r long")
    frame = frame.select("unit", F.timestamp_seconds("s").alias("ts"), "cracking", "run_id", F.timestamp_seconds("r").alias("run_start"))
    rows = [(u, f"{u}:{i}", [None, "A", "B"][i % 3], t, float(np.round(rng.normal(860, 20), 2)) if rng.random() < 0.9 else None) for u, t, _, _ in grid for i in range(6) if (i, t // 3600 // 40) != (4, 1) or t % 144000 > 86400]
    sensors = spark.createDataFrame(rows, "unit string, id string, grp string, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    cfg = Settings(hot=820.0, baseline_hours=12.0)
    columns = ("unit", "id", "grp", "ts", "run_id", "value", "delta", "baseline", "drift")
    two, one = (sorted(map(str, dr.sensor_drift(sensors, frame, cfg, by_unit=b).select(*columns).collect())) for b in (False, True))
    assert one == two and any("drift=None" in r for r in one) and any("drift=None" not in r for r in one)


def test_rows_staged_by_unit_need_no_exchange(spark):
    rows = spark.range(500).select((F.col("id") % 7).cast("string").alias("unit"), F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    rows = rows.unionByName(rows.limit(1).select(F.lit(None).cast("string").alias("unit"), "ts", "v"))
    back = tb.stage_by(rows.repartition(4, "unit"), "rows", ("unit",), 4, ("unit", "ts"))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert "Exchange" not in back.groupBy("unit", "ts").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString()
    assert tb.stage_by(rows.where("v < 0").repartition(4, "unit"), "rows", ("unit",), 4).count() == 0


def test_correlations_bring_rows_together_once(spark):
    rows = [("u", float(i % 7), float(i % 5), None if i % 3 else 1.0 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "unit string, a double, b double, c double")
    plan = co.pair_stats(df, [("a", "b"), ("a", "c"), ("b", "c")], ["unit"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_columns_of_correlations_are_not_planned_as_one_filter(spark):
    # The last unit has rows but not one number; such rows were filtered by all columns at once, and planning that took minutes and the driver's memory.
    rows = [(u, f"{u}" == "a" or i % 2 == 0, None if u == "c" else float(i % 7), None if u == "c" or i % 5 == 0 else float(i * i % 11)) for u in "abc" for i in range(40)]
    df = spark.createDataFrame(rows, "unit string, cracking boolean, x double, y double")
    made = df.withColumns({f"x{i}": F.when(F.col("x") > i - 3, F.col("x") * (i + 1)) for i in range(4)}).withColumns({f"r{i}": F.when(F.col(f"x{i}") > 2, F.col("y") / F.col(f"x{i}")) for i in range(4)})
    stats = co.pair_stats(co.active_rows(made), [(f"{c}{i}", "y") for c in "xr" for i in range(4)], ["unit"])
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "isnan" in line]
    got = {(r.unit, r.a): (r.n, r.pearson) for r in stats.collect()}
    want = {(r.unit, r.a): (r.n, r.pearson) for r in co.pair_correlations(co.pairs_of(co.active_rows(made), [(f"{c}{i}", "y") for c in "xr" for i in range(4)], ["unit"]), ["unit"]).collect()}
    assert set(got) == set(want) and {u for u, _ in got} == {"a", "b"}
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], nan_ok=True) for k in got)


def test_one_file_a_unit(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 5).cast("string").alias("unit"), F.timestamp_seconds(F.col("id") * 604800 / 10).alias("ts"), "id")
    at = f"file://{tmp_path}/t"
    tb.write_table(rows.repartition(6), at)
    assert len(list(tmp_path.glob("t/data/*/unit=*/*.parquet"))) == 5
    assert sorted(r.id for r in tb.read_table(spark, at).select("id").collect()) == list(range(2000))


def test_samples_meet_intervals_of_their_own_hour(spark, tmp_path):
    at = f"file://{tmp_path}/events"
    samples = spark.range(0, 72 * 60).select(F.lit("t").alias("ID"), F.timestamp_seconds(F.col("id") * 60).alias("EventTime"), F.lit("Good").alias("Status"), F.lit(1.0).alias("Value"))
    st.write_events(samples, at)
    spans = spark.createDataFrame([("a", 23 * 3600 + 1800, 25 * 3600 + 60), ("b", 0, 60), ("c", 7200, 7200)], "error string, x long, y long")
    spans = spans.select("error", F.timestamp_seconds("x").alias("t0"), F.timestamp_seconds("y").alias("t1"))
    got = st.around(st.read_store(spark, at), spans)
    assert {r.error: r["count"] for r in got.groupBy("error").count().collect()} == {"a": 91, "b": 1}
    assert "_hour" in got._jdf.queryExecution().optimizedPlan().toString()


def test_samples_are_shown_once_and_meet_arrays_of_intervals(spark, tmp_path):
    # Three tags with two samples a minute in one hour, each with its first error there; a null tag, a null time, and values that are no numbers.
    rows = [(i, None if i == 7 else 3600 * 5 + 30 * (i % 120), i % 3 if i % 50 else None, "error" if i % 40 in (3, 4, 5) else "view", None if i % 11 == 0 else i / 7) for i in range(240)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
    df.write.parquet(f"{tmp_path}/events.parquet")
    out = queries()["store_around"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = lambda text: next((i for i, line in enumerate(plan) if text in line), -1)
    assert first("date_format") > first("Join Inner") >= 0 and first("Generate explode(_spans") >= 0
    samples = [(f"{u}:{k}" if u is not None else k, s, "Bad" if k == "error" else "Good", v) for _, s, u, k, v in rows if s is not None]
    at = {}
    for tag, s, status, _ in samples:
        if status == "Bad":
            at[tag] = min(at.get(tag, s), s)
    want = sorted((e, tag, s, status) for e, t in at.items() for tag, s, status, _ in samples if t - 3600 <= s < t + 3600)
    got = sorted((r.error, r.ID, (int(r.EventTime[11:13]) * 60 + int(r.EventTime[14:16])) * 60 + int(r.EventTime[17:]), r.Status) for r in out.collect())
    assert got == want and len(at) > 2


def test_many_intervals_are_joined_by_shuffle(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/events"
    samples = spark.range(0, 72 * 60).select(F.lit("t").alias("ID"), F.timestamp_seconds(F.col("id") * 60).alias("EventTime"), F.lit("Good").alias("Status"), F.lit(1.0).alias("Value"))
    st.write_events(samples, at)
    spans = spark.createDataFrame([("a", 23 * 3600 + 1800, 25 * 3600 + 60), ("b", 0, 60), (None, 60, 7200)], "error string, x long, y long")
    spans = spans.select("error", F.timestamp_seconds("x").alias("t0"), F.timestamp_seconds("y").alias("t1"))
    sent = st.around(st.read_store(spark, at), spans)
    monkeypatch.setattr(st, "fits_broadcast", lambda df: False)
    dealt = st.around(st.read_store(spark, at), spans)
    assert sent.columns == dealt.columns and sorted(map(str, sent.collect())) == sorted(map(str, dealt.collect())) and sent.count() == 91 + 1 + 119
