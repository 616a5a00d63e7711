"""Small signals with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runsignal.functions.exprs import half_even, steady_mean, steady_sum
from runsignal.functions.quantiles import pooled_quantiles
from runsignal.operators import changepoint as cp
from runsignal.operators import corr as co
from runsignal.operators import fleet as fl
from runsignal.operators import drift as dr
from runsignal.operators import quality as ql
from runsignal.operators import resample as rs
from runsignal.operators import runs as rn
from runsignal.operators import windows as wn
from runsignal.settings import Settings
from runsignal.sources import tables as tb

CFG = Settings()
T0 = 1735689600


def grid(spark, pdf: pd.DataFrame, step: int = 1800):
    """Frame on a grid: column i is the row number."""
    df = spark.createDataFrame(pdf)
    return df.withColumn("ts", F.timestamp_seconds(F.lit(T0) + F.col("i") * step)).withColumn("unit", F.lit("u"))


def test_half_even(spark):
    row = spark.range(1).select(half_even(F.lit(20.625), 2), half_even(F.lit(2.5), 0)).first()
    assert tuple(row) == (20.62, 2.0)


@pytest.mark.parametrize("idle, expected", [(11, 1), (12, 2)])
def test_exact_gap(spark, idle, expected):
    on = [True] * 200 + [False] * idle + [True] * 200
    df = grid(spark, pd.DataFrame({"i": range(len(on)), "cracking": on}))
    assert rn.segment_runs(df, CFG).count() == expected
    labelled = rn.label_runs(df, CFG)
    assert rn.runs_of(labelled).count() == expected
    # Idle rows inside a run belong to it, idle rows between runs do not.
    inside = labelled.where("NOT cracking AND run_id IS NOT NULL").count()
    assert inside == (idle if expected == 1 else 0)


def test_short_runs_are_dropped_and_renumbered(spark):
    on = [True] * 100 + [False] * 20 + [True] * 200 + [False] * 20 + [True] * 150
    df = grid(spark, pd.DataFrame({"i": range(len(on)), "cracking": on}))
    runs = {r.run: (r.start, r.end) for r in rn.segment_runs(df, CFG).collect()}
    assert sorted(runs) == [0, 1]
    assert rn.runs_of(rn.label_runs(df, CFG)).where("run > 1").count() == 0


def test_mask_without_feed_uses_sensors(spark):
    pdf = pd.DataFrame({"i": range(4), "sensor_median": [600.0, 400.0, None, 700.0]})
    df = grid(spark, pdf).withColumn("feed_total", F.lit(None).cast("double"))
    df = df.withColumn("sensor_median", F.when(~F.isnan("sensor_median"), F.col("sensor_median")))
    assert [r.cracking for r in rn.add_activity(df, CFG).orderBy("ts").collect()] == [True, False, False, True]


def test_fill_grid_adds_missing_buckets(spark):
    df = grid(spark, pd.DataFrame({"i": [0, 3, 4], "x": [1.0, 2.0, 3.0]})).select("unit", "ts", "x")
    got = [r.x for r in rs.fill_grid(df, 1800).orderBy("ts").collect()]
    assert got == [1.0, None, None, 2.0, 3.0]
    plant = grid(spark, pd.DataFrame({"i": [-1, 6]}))
    assert rs.fill_grid(df, 1800, plant).count() == 8


def test_even_window_looks_further_back(spark):
    df = grid(spark, pd.DataFrame({"i": range(8), "x": np.arange(1.0, 9.0)})).withColumn("run_id", F.lit(0))
    got = [r.m for r in df.select("ts", dr.rolling_median("x", ["unit"], 4, 1).alias("m")).orderBy("ts").collect()]
    want = pd.Series(np.arange(1.0, 9.0)).rolling(4, min_periods=1, center=True).median().tolist()
    assert got == want


@pytest.mark.parametrize("hours", [24.0, 12.0, 2.5, 1.0])
def test_drift_rate_matches_pandas(spark, hours):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=300).cumsum(), 1)
    x[rng.random(300) < 0.3] = np.nan
    run = np.repeat([0, 1, 2], 100)
    pdf = pd.DataFrame({"i": range(300), "run_id": run, "x": x})
    df = grid(spark, pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = dr.drift_rate(df, CFG.with_(rate_hours=hours), value="x", name="r").orderBy("ts").toPandas()["r"].to_numpy(float)
    win = max(2, int(hours / 0.5))
    want = np.concatenate(
        [pd.Series(x[run == k]).rolling(win, min_periods=max(2, win // 3), center=True).median().diff() / 0.5 * 24 for k in range(3)]
    )
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_worst_pass_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, 3.0, 3.0, 1.0), (None, None, None, None), (0.0, None, 0.0, None)], "a double, b double, c double, d double")
    got = [r.w for r in df.select(dr.worst_of({k.upper(): F.col(k) for k in "abcd"}).alias("w")).collect()]
    assert got == ["B", None, "A"]


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (2.0, 4.0), (5.0, 2.0)], "x double, y double").withColumn("unit", F.lit("u"))
    r = co.pair_correlations(co.pairs_of(df, [("x", "y")], ["unit"]), ["unit"]).first()
    assert r.spearman == pytest.approx(0.316227766)


def test_random_correlations_match_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({c: np.round(rng.normal(size=400), 1) for c in ("cot", "feed_total", "steam_hc", "draft")})
    pdf["cot"] = np.round(pdf["cot"] + pdf["draft"], 1)
    pdf = pdf.mask(rng.random(pdf.shape) < 0.2)
    pdf["coil_out_P"] = 1.5                       # constant: left out, no error
    pdf["i"] = range(400)
    df = grid(spark, pdf)
    for method in ("spearman", "pearson"):
        got = co.correlation_matrix(df, CFG, method=method).toPandas().pivot(index="a", columns="b", values="r")
        want = pdf.drop(columns=["coil_out_P", "i"]).corr(method="pearson") if method == "pearson" else None
        if want is None:
            cols = list(got.columns)
            want = pd.DataFrame(index=cols, columns=cols, dtype=float)
            for a in cols:
                for b in cols:
                    sub = pdf[[a, b]].dropna() if a != b else pdf[[a]].dropna().assign(z=lambda d: d[a])
                    ranks = sub.rank()
                    want.loc[a, b] = np.corrcoef(ranks.iloc[:, 0], ranks.iloc[:, 1])[0, 1]
        assert "coil_out_P" not in got.columns
        np.testing.assert_allclose(got.to_numpy(float), want.loc[got.index, got.columns].to_numpy(float), atol=1e-9)


def test_shared_ranks_equal_ranks_of_each_pair(spark):
    rng = np.random.default_rng(4)
    names = ["a", "b", "c", "d", "e"]
    pdf = pd.DataFrame(np.round(rng.normal(size=(300, 5)), 1), columns=names)
    pdf["unit"] = np.repeat(["u", "v", "w"], 100)
    pdf.loc[(pdf.index % 3 == 0) & (pdf.unit == "v"), ["a", "b"]] = np.nan  # one pattern for two columns
    pdf.loc[(rng.random(300) < 0.4) & (pdf.unit == "w"), "c"] = np.nan
    pdf.loc[pdf.unit == "u", "e"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in names) + ", unit string").repartition(4)
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i:]]
    got, want = (
        {(r.unit, r.a, r.b): [r.n, *(v is not None and round(v, 9) for v in (r.pearson, r.spearman, r.x_std))] for r in x.collect()}
        for x in (co.pair_stats(df, pairs, ["unit"]), co.pair_correlations(co.pairs_of(df, pairs, ["unit"]), ["unit"]))
    )
    assert got == want and len(got) == 40


def test_ranks_compare_full_doubles(spark):
    """0.1 + 0.2 is not 0.3, and it ranks behind it."""
    df = spark.createDataFrame([(0.1 + 0.2, 1.0), (0.3, 1.0), (0.5, 2.0), (0.7, 3.0)], "x double, y double").withColumn("unit", F.lit("u"))
    r = co.pair_correlations(co.pairs_of(df, [("x", "y")], ["unit"]), ["unit"]).first()
    assert r.spearman == pytest.approx(0.9486832980505138)


def test_constant_driver_is_not_ranked(spark):
    pdf = pd.DataFrame({"i": range(50), "cot": 1.0, "draft": np.arange(50.0), "dd_abs_max": np.arange(50.0) ** 2})
    got = co.driver_rank(grid(spark, pdf), "dd_abs_max", CFG, ("cot", "draft")).collect()
    assert [(r.driver, r.spearman) for r in got] == [("draft", pytest.approx(1.0))]


def test_best_lag(spark):
    i = np.arange(2000)
    x = (7 * i * i) % 1009
    pdf = pd.DataFrame({"i": i, "x": x.astype(float), "y": [float(x[k - 34]) if k >= 34 else np.nan for k in i]})
    xc = co.lagged_correlation(grid(spark, pdf), "x", "y", CFG)
    best = co.best_lag(xc).first()
    assert (best.lag_steps, round(best.corr, 9)) == (34, 1.0)
    assert xc.count() == 193
    others = xc.where("lag_steps <> 34").agg(F.max(F.abs("corr"))).first()[0]
    assert others == pytest.approx(0.1057, abs=5e-5)


def test_lag_counts_rows_or_time(spark):
    pdf = pd.DataFrame({"i": [0, 1, 2, 10, 11, 12], "x": [1.0, 5.0, 2.0, 8.0, 3.0, 9.0], "y": [0.0, 1.0, 5.0, 2.0, 8.0, 3.0]})
    df = grid(spark, pdf)
    cfg = CFG.with_(max_lag=1)
    rows = {r.lag_steps: r for r in co.lagged_correlation(df, "x", "y", cfg).collect()}
    time = {r.lag_steps: r for r in co.lagged_correlation(df, "x", "y", cfg, by_time=True).collect()}
    assert rows[1].n == 5 and rows[1].corr == pytest.approx(1.0)
    assert time[1].n == 4


def test_age_zero_is_in_no_phase(spark):
    df = spark.createDataFrame([(0.0,), (0.01,), (5.0,), (5.01,), (35.0,), (36.0,)], "a double")
    got = [r.p for r in df.select(co.phase_bin(F.col("a"), CFG.phase_edges).alias("p")).collect()]
    assert got == [None, "(0,5]", "(0,5]", "(5,10]", "(25,35]", None]


def test_p_values(spark):
    # Known two-sided values: t = 2.228139 at 10 and 1.959964 at very many degrees of freedom give 5 %.
    df = spark.createDataFrame([(2.2281388519, 10.0), (12.706204736, 1.0), (1.9599640, 1e7), (0.0, 5.0)], "t double, d double")
    got = [r.p for r in df.select(co.p_value(F.col("t"), F.col("d")).alias("p")).collect()]
    assert got == [pytest.approx(0.05, abs=1e-6)] * 3 + [pytest.approx(1.0)]


def test_driver_classes(spark):
    rows = []
    for name, rho in {"w": (0.05, 0.02, 0.01), "r": (0.3, 0.2, -0.3), "f": (0.2, 0.3, 0.6), "c": (0.5, 0.4, 0.45), "n": (0.15, 0.1, 0.12)}.items():
        rows += [("u", k, name, 50, x, 0.2 if name == "n" else 0.001) for k, x in enumerate(rho)]
    df = spark.createDataFrame(rows, "unit string, phase int, driver string, n int, rho double, p double")
    got = {r.driver: r["class"] for r in co.classify_drivers(df).collect()}
    assert got == {"w": "weak", "r": "spurious_reversal", "f": "feedback_reinforcement", "c": "causal", "n": "unclassified"}


def test_change_points_of_steps():
    x = np.concatenate([np.zeros(100), np.full(300, 5.0), np.zeros(80)])[:, None]
    assert cp.kernel_width(x) == 1.0  # most pairs are equal
    assert cp.segment(x, 12, 10.0) == [100, 400]


def brute_force(x, min_rows, penalty):
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(-1) * cp.kernel_width(x)
    k = np.exp(-np.clip(d, cp.NEAREST, cp.FARTHEST))
    np.fill_diagonal(k, 1.0)
    best, back = [0.0] + [np.inf] * n, [0] * (n + 1)
    for t in range(min_rows, n + 1):
        for s in range(0, t - min_rows + 1):
            c = best[s] + (t - s) - k[s:t, s:t].sum() / (t - s) + penalty
            if c < best[t]:
                best[t], back[t] = c, s
    out, t = [], n
    while back[t] > 0:
        t = back[t]
        out.append(t)
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_change_points_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(m, 1.0, size=(rng.integers(8, 40), 2)) for m in (0, 4, -3, 0)])
    assert cp.segment(x, 5, 2.0) == brute_force(x, 5, 2.0)


def test_large_kernel_width_is_exact():
    x = np.random.default_rng(2).normal(size=(3000, 2))
    pairs = 3000 * 2999 // 2
    direct = float(np.median(np.concatenate(list(cp._pair_blocks(x)))))
    assert pairs > 4_000_000 and 1.0 / cp.kernel_width(x) == pytest.approx(direct, rel=1e-12)


def test_pooled_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    big, small = np.round(rng.gamma(2.0, 5.0, 60_000), 3), rng.normal(size=37)
    pdf = pd.DataFrame({"k": [1] * len(big) + [2] * len(small), "v": np.concatenate([big, small])})
    probs = {"lo": 0.01, "mid": 0.5, "hi": 0.95, "top": 1.0}
    got = {r.k: r for r in pooled_quantiles(spark.createDataFrame(pdf), ["k"], "v", probs).collect()}
    for k, x in ((1, big), (2, small)):
        assert got[k].n == len(x)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(x, p), abs=1e-12)


def test_spikes_need_duration_and_height(spark):
    x = [10.0, 70.0, 70.0, 10.0] + [80.0] * 7 + [10.0, None, 65.0]
    pdf = pd.DataFrame({"i": range(len(x)), "dd_abs_max": x})
    df = grid(spark, pdf).withColumn("dd_abs_max", F.when(~F.isnan("dd_abs_max"), F.col("dd_abs_max")))
    marked = ql.mark_spikes(df, CFG)
    assert tuple(ql.spike_counts(marked).first())[1:] == (2, 1, 3)
    assert marked.where("dd_abs_max > 60").count() == 7


def test_tag_health(spark):
    pdf = pd.DataFrame({"i": [0, 1, 2, 5, 6], "value": [1.0, 1.0, 1.0, 2.0, 2.0]})
    r = ql.tag_health(grid(spark, pdf).withColumn("id", F.lit("a")), CFG).first()
    assert (r.n, r.vmin, r.vmax, r.flat_share, r.gaps, r.exclude) == (5, 1.0, 2.0, 0.75, 1, False)


def test_exclusions_keep_the_row(spark):
    pdf = pd.DataFrame({"i": range(5), "dd_abs_max": np.arange(5.0)})
    df = grid(spark, pdf)
    ex = spark.createDataFrame([("u", "fault")], "unit string, reason string").select(
        "unit", "reason", F.timestamp_seconds(F.lit(T0 + 1800)).alias("t0"), F.timestamp_seconds(F.lit(T0 + 5400)).alias("t1")
    )
    got = [r.dd_abs_max for r in wn.apply_exclusions(df, ex).orderBy("ts").collect()]
    assert got == [0.0, None, None, None, 4.0]
    assert wn.exclusion_counts(df, ex).first().n == 3


def test_old_time_column_is_renamed(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    grid(spark, pd.DataFrame({"i": [0]})).withColumnRenamed("ts", "timestamp").write.parquet(path)
    assert "ts" in tb.read_table(spark, path).columns


def test_stage_uses_the_shared_folder(spark, shared):
    assert tb.stage(spark.range(5), "five").count() == 5
    assert list((shared / "runsignal").glob("five-*"))


def test_window_method_two_uses_air_and_setpoints(spark):
    n = 240
    feed = [60.0] * 40 + [100.0] * 180 + [70.0] * 20
    pdf = pd.DataFrame({"i": range(n), "feed_total": feed, "cot_ctrl": [830.0] * n, "cot": [830.0] * n, "decoke_air_A": [0.0] * 220 + [5.0] * 20})
    df = grid(spark, pdf).withColumn("run_id", F.lit(0))
    df = df.withColumn("run_start", F.timestamp_seconds(F.lit(T0))).withColumn("run_end", F.timestamp_seconds(F.lit(T0 + (n - 1) * 1800)))
    r = wn.analysis_windows_v2(df, CFG).first()
    assert (r.settled, r.pelt_used, r.warmup_method, r.decoke_method) == (True, True, "pelt", "decoke_air")
    assert (r.warmup_hours, r.tail_hours) == (20.0, 10.0)
    r = wn.analysis_windows_v2(df.drop("cot_ctrl", "decoke_air_A"), CFG).first()
    assert (r.decoke_method, r.warmup_hours, r.tail_hours) == ("feed_heuristic", 20.0, 10.0)
    short = df.where("i < 20").withColumn("run_end", F.timestamp_seconds(F.lit(T0 + 19 * 1800)))
    r = wn.analysis_windows_v2(short, CFG).first()
    assert (r.settled, r.warmup_method, r.decoke_method, r.analysis_start) == (False, "none", "none", None)


def test_second_method_chooses_signals_per_unit(spark):
    """A unit without decoke air and set points gets the same windows alone and next to one that has them."""
    from runsignal.operators import windows as wn

    rows = spark.range(400).selectExpr(
        "explode(array('A', 'B')) AS unit", "timestamp_seconds(1735689600 + 1800 * id) AS ts", "0 AS run_id", "timestamp'2025-01-01 00:00:00' AS run_start",
        "timestamp_seconds(1735689600 + 1800 * 399) AS run_end", "100.0 + (id % 3) * 0.1 - IF(id < 60 OR id > 350, 30, 0) AS feed_total", "830.0 + (id % 2) * 0.1 AS cot",
        "id AS i",
    ).selectExpr("*", "IF(unit = 'A', 830.0, NULL) AS cot_ctrl", "IF(unit = 'A', IF(i < 100, 1.0, 0.0), NULL) AS decoke_air_A").drop("i")
    cfg = Settings()
    both = {r.unit: r for r in wn.analysis_windows_v2(rows, cfg).collect()}
    alone = wn.analysis_windows_v2(rows.where("unit = 'B'").drop("cot_ctrl", "decoke_air_A"), cfg).first()
    assert both["B"] == alone and alone.settled and alone.decoke_method == "feed_heuristic" and alone.pelt_used
    assert both["A"].decoke_method == "decoke_air" and both["A"].analysis_start != alone.analysis_start


def test_shared_ranks_equal_ranks_of_each_pair(spark):
    rng = np.random.default_rng(4)
    names = ["a", "b", "c", "d", "e"]
    pdf = pd.DataFrame(np.round(rng.normal(size=(300, 5)), 1), columns=names)
    pdf["unit"] = np.repeat(["u", "v", "w"], 100)
    pdf.loc[(pdf.index % 3 == 0) & (pdf.unit == "v"), ["a", "b"]] = np.nan  # one pattern for two columns
    pdf.loc[(rng.random(300) < 0.4) & (pdf.unit == "w"), "c"] = np.nan
    pdf.loc[pdf.unit == "u", "e"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in names) + ", unit string").repartition(4)
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i:]]
    got, want = (
        {(r.unit, r.a, r.b): [r.n, *(v is not None and round(v, 9) for v in (r.pearson, r.spearman, r.x_std))] for r in x.collect()}
        for x in (co.pair_stats(df, pairs, ["unit"]), co.pair_correlations(co.pairs_of(df, pairs, ["unit"]), ["unit"]))
    )
    assert got == want and len(got) == 40


def test_ranks_compare_full_doubles(spark):
    """Values that differ from the eighth digit on keep their order and stay distinct."""
    from runsignal.operators import quality as ql

    rows = spark.range(60).selectExpr("'A' AS unit", "830 + 1e-5 * id AS cot", "50000 + 0.001 * id AS draft", "1.0 * id AS y")
    got = co.pair_correlations(co.pairs_of(rows, [("cot", "y"), ("draft", "y")], ["unit"]), ["unit"]).collect()
    assert [r.spearman for r in got] == pytest.approx([1.0, 1.0], abs=1e-12)
    small = spark.range(1000).selectExpr("'A' AS unit", "'t' AS id", "1 / (20000 + 0.01 * id) AS value")
    assert ql.pinned_values(small).first().distinct_values == 1000


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Started from another folder, with nothing on PYTHONPATH, Python workers still run the package's functions."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from runsignal.session import local_session
from runsignal.operators.changepoint import change_points
from runsignal.settings import Settings
spark = local_session(2, 2)
rows = spark.range(180).selectExpr("'A' AS unit", "0 AS run_id", "timestamp_seconds(id * 1800) AS ts", "IF(id < 90, 0.0, 5.0) AS x")
print("breaks", change_points(rows, ["x"], Settings()).first().breaks)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "breaks [90]" in done.stdout, done.stderr[-2000:]


def test_forecast_from_merged_sums(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 4)) * [30, 5, 0.1, 2] + [40, 830, 0.4, 9]
    y = x @ [0.5, -0.2, 30.0, 1.5] + 7 + rng.normal(size=400)
    pdf = pd.DataFrame(x, columns=fl.FORECAST_DRIVERS).assign(label=y, unit=np.repeat(["a", "b", "c", "d"], 100))
    rows = spark.createDataFrame(pdf)
    want = np.linalg.lstsq(np.column_stack((x, np.ones(400))), y, rcond=None)[0]
    got = fl.fit_forecaster(rows)
    assert [*got.weights, got.intercept] == pytest.approx(want.tolist(), rel=1e-6)
    # Sums of the units, stored apart and merged, give the same; a constant driver gets no weight.
    parts = [fl.gram(rows.where(F.col("unit") == u)) for u in "abcd"]
    again = fl.solved(fl.merged_gram(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])).first())
    assert again.weights == pytest.approx(got.weights, rel=1e-9)
    flat = fl.fit_forecaster(rows.withColumn("cot0", F.lit(5.0)))
    assert flat.weights[1] == 0 and all(np.isfinite(flat.weights))
    none = fl.fit_forecaster(rows.limit(0))
    out = {r.unit: (r.n, r.rmse) for r in fl.forecast_error(got, rows.where("unit = 'a'"), rows).collect()}
    assert out["b"] == (0, None) and out["a"][0] == 100 and 0.5 < out["a"][1] < 2
    assert none.transform(rows).where("prediction IS NOT NULL").count() == 0


def test_steady_sums_do_not_depend_on_the_order(spark):
    rng = np.random.default_rng(9)
    values = np.concatenate((np.round(rng.normal(scale=50, size=400), 2), np.round(rng.uniform(800, 900, 400), 3))).tolist()
    orders = [values, values[::-1], rng.permutation(values).tolist()]
    rows = [(k, x) for k, order in enumerate(orders) for x in order]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "k int, x double").repartition(parts)
        got = df.groupBy("k").agg(steady_sum("x").alias("s"), steady_mean("x").alias("m")).collect()
        assert len({(r.s, r.m) for r in got}) == 1 and got[0].s == pytest.approx(math.fsum(values), abs=1e-9)
        assert got[0].m == got[0].s / len(values)
        over = Window.partitionBy("k")
        assert {r.m for r in df.select(steady_mean("x", over).alias("m")).distinct().collect()} == {got[0].m}


def test_steady_sums_of_odd_groups(spark):
    nan, inf = float("nan"), float("inf")
    groups = {
        "none": ([None, None], None),
        "nulls": ([None, 0.5, 0.25], 0.75),
        "negative": ([-1e-20, -2.5, 1.25], -1.25),
        "large": ([1e300, 1.5], 1e300),
        "edge": ([2.0**52, 0.5], 2.0**52 + 0.5),
        "infinite": ([inf, 1.0], inf),
        "many": ([0.999] * 200_000, 199_800.0),
    }
    rows = [(k, x) for k, (values, _) in groups.items() for x in values] + [("nan", nan), ("nan", 1.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(steady_sum("x").alias("s"), steady_mean("x").alias("m")).collect()}
    assert math.isnan(got["nan"][0]) and math.isnan(got["nan"][1])
    for k, (values, want) in groups.items():
        n = sum(v is not None for v in values)
        assert got[k] == ((None, None) if want is None else (pytest.approx(want), pytest.approx(want / n)))
    assert df.limit(0).agg(steady_sum("x").alias("s")).first().s is None
