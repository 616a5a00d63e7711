"""End to end on the closed-form plant, through the jobs."""

import pytest
from plant import LENGTHS, events, metadata
from pyspark.sql import functions as F

from runsignal.operators import catalog as ct
from runsignal.operators import drift as dr
from runsignal.operators import features as ft
from runsignal.plans import jobs
from runsignal.settings import Settings
from runsignal.sources import store as st
from runsignal.sources import tables as tb

CFG = Settings()
START, END = "2025-01-01", "2025-03-02"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    events(spark).write.parquet(f"{path}/e")
    return spark.read.parquet(f"{path}/e"), metadata(spark)


@pytest.fixture(scope="module")
def out(spark, data, tmp_path_factory):
    folder = "file://" + str(tmp_path_factory.mktemp("out"))
    jobs.fleet_report(spark, *data, folder, START, END, CFG)
    jobs.coverage_report(spark, *data, folder)
    return folder


def test_runs_have_known_lengths(spark, out):
    rows = tb.read_table(spark, f"{out}/runs").orderBy("unit", "run").collect()
    found = {}
    for r in rows:
        found.setdefault(r.unit, []).append(r.length_days)
    assert found == {f"1H{chr(65 + u)}": v for u, v in LENGTHS.items()}


def test_largest_drift_is_the_steepest_sensor(spark, data):
    tags = ct.build_catalog(data[1])
    prep = ft.prepare(jobs.history_of(data[0], tags, START, END, CFG), tags, CFG)
    drift = dr.sensor_drift(prep.sensors, prep.labels, CFG).where("drift IS NOT NULL")
    four = drift.groupBy("unit", "run_id", "run_start", "grp", "ts").agg(
        F.count("*").alias("n"), F.max_by("id", "drift").alias("id"), F.max("drift").alias("top"), F.max(F.abs("drift")).alias("big")
    ).where("n = 4")
    late = four.where((F.unix_timestamp("ts") - F.unix_timestamp("run_start")) >= 57 * 3600)
    assert late.where((F.regexp_extract("id", r"\d(\d{3})A", 1).cast("int") - 1) % 48 != 3).count() == 0
    top, big = four.agg(F.max("top"), F.max("big")).first()
    assert top == pytest.approx(28.485, abs=1e-3) and big == pytest.approx(28.512369791666668, abs=1e-9)


def test_bad_samples_never_arrive(spark, out):
    assert tb.read_table(spark, jobs.request_folder(out, None, START, END, False, CFG) + "/features").agg(F.max("cot")).first()[0] <= 833.0


def test_feature_matrix_shape(spark, out):
    f = tb.read_table(spark, jobs.request_folder(out, None, START, END, False, CFG) + "/features")
    assert set(ft.FEATURE_COLUMNS) <= set(f.columns)
    assert f.count() == 7 * 2880  # dense grid, outage rows included
    silent = f.where("feed_total = 0 AND cot IS NULL").groupBy("unit").count().collect()
    assert len(silent) == 7 and {r["count"] for r in silent} == {20}
    assert f.where("feed_C5p IS NOT NULL").count() == 7 * 2860
    assert f.where("eff_C2H4 IS NOT NULL OR coil_out_P IS NOT NULL").count() == 0


def test_windows_written_both_ways(spark, out):
    table = tb.read_table(spark, f"{out}/windows")
    csv = tb.read_windows_csv(spark, f"{out}/windows_csv")
    assert table.count() == csv.count() > 0
    assert table.select(csv.columns).exceptAll(csv).count() == 0
    clean = tb.read_table(spark, f"{out}/clean")
    assert {r.phase for r in clean.select("phase").distinct().collect()} == {"clean"}
    assert {r.phase for r in tb.read_table(spark, f"{out}/clean_adv").select("phase").distinct().collect()} == {"clean_adv"}
    # The first runs touch the start of the data and are not complete cycles.
    assert table.where("run = 0").count() == 0


def test_coverage(spark, out):
    m = tb.read_table(spark, f"{out}/coverage_matrix")
    assert m.columns == ["id", "2025"] and m.count() == 7 * (1 + 4 + 4 + 16) + 1
    roles = {r.role: r["2025"] for r in tb.read_table(spark, f"{out}/coverage_roles").collect()}
    assert roles["feed_flow"] == roles["dil_steam"] == 80080
    assert roles["cot_ctrl"] == 2 * 20020  # bad samples count too
    assert roles["tube_COT"] == 317044


def test_every_unit_agrees(spark, out):
    rows = {r.driver: r for r in tb.read_table(spark, f"{out}/sign_agreement").collect()}
    assert rows["run_age_days"].agree and rows["run_age_days"].positive == 7
    assert tb.read_table(spark, f"{out}/pooled_by_age").count() > 20


def test_requests_do_not_answer_each_other(spark, data, tmp_path):
    folder = f"file://{tmp_path}"
    one = jobs.feature_tables(spark, *data, folder, START, END, CFG, unit="1HA")
    assert {r.unit for r in one.select("unit").distinct().collect()} == {"1HA"}
    all_units = jobs.feature_tables(spark, *data, folder, START, END, CFG)
    assert all_units.select("unit").distinct().count() == 7
    shorter = jobs.feature_tables(spark, *data, folder, START, "2025-01-20", CFG, unit="1HA")
    assert 0 < shorter.count() < one.count()
    # A table without its success mark was cut off: it is built again.
    at = tmp_path / jobs.request_folder("x", "1HA", START, END, False, CFG)[2:]
    (at / "features" / "_SUCCESS").unlink()
    assert jobs.feature_tables(spark, *data, folder, START, END, CFG, unit="1HA").count() == one.count()
    assert (at / "features" / "_SUCCESS").exists()


def test_one_unit_is_refreshed(spark, data, tmp_path):
    folder = f"file://{tmp_path}"
    before = jobs.feature_tables(spark, *data, folder, START, END, CFG)
    hotter = data[0].withColumn("Value", F.expr("try_cast(Value AS DOUBLE)") + F.when(F.col("ID").startswith("01TC"), 7.0).otherwise(0.0))
    after = jobs.refresh_units(spark, hotter, data[1], folder, START, END, ["1HB"], CFG)
    means = [{r.unit: r.cot for r in x.groupBy("unit").agg(F.round(F.avg("cot"), 6).alias("cot")).collect()} for x in (before, after)]
    assert {u for u in means[0] if means[0][u] != means[1][u]} == {"1HB"} and after.count() == 7 * 2880


def test_stored_coverage_reads_new_days_only(spark, data, out, tmp_path):
    store, folder = f"file://{tmp_path}/store", f"file://{tmp_path}/out"
    late = F.col("EventTime") >= "2025-02-01"
    st.write_events(data[0].where(~late), store)
    assert len(jobs.stored_coverage_report(spark, store, data[1], folder)) > 20
    st.write_events(data[0].where(late), store, only=True)
    days = data[0].where(late).select(F.to_date("EventTime")).distinct().count()
    assert len(jobs.stored_coverage_report(spark, store, data[1], folder)) == days > 0
    for name in ("coverage_matrix", "coverage_roles", "coverage_by_year"):
        assert sorted(map(tuple, tb.read_table(spark, f"{folder}/{name}").collect())) == sorted(map(tuple, tb.read_table(spark, f"{out}/{name}").collect()))


def test_saved_features_are_reused(spark, data, out):
    again = jobs.feature_tables(spark, spark.createDataFrame([], data[0].schema), data[1], out, START, END, CFG)
    assert again.count() == 7 * 2880


def test_run_length_dropped_and_shuffled_input(spark, data):
    """Order of the input rows does not matter; a pass offset leaves delta unchanged."""
    tags = ct.build_catalog(data[1]).where("unit = '1HA'")
    hist = jobs.history_of(data[0], tags, START, END, CFG)
    shifted = hist.withColumn("value", F.when((F.col("role") == "tube_COT") & (F.col("grp") == "B") & (F.col("value") > 0), F.col("value") + 64.0).otherwise(F.col("value")))
    out = []
    for h in (hist, shifted.orderBy(F.rand(3))):
        prep = ft.prepare(h, None, CFG)
        d = dr.sensor_delta(prep.sensors, prep.labels, CFG)
        out.append(d.select("id", "ts", F.round("delta", 6).alias("delta")))
    assert out[0].count() > 0 and out[0].exceptAll(out[1]).count() == 0
