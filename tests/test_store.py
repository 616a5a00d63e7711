"""Versioned tables, the event store and the daily states."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from runsignal.operators import partials as pt
from runsignal.operators import resample as rs
from runsignal.sources import store as st
from runsignal.sources import tables as tb
from runsignal.sources import versions as vs
from runsignal.sources.historian import good_samples, read_events, read_metadata


def rows(spark, units, n=5, value=1.0):
    return spark.createDataFrame([(u, i, value) for u in units for i in range(n)], "unit string, i int, v double")


def test_readers_keep_their_version(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    tb.write_table(rows(spark, "ab"), at)
    old = tb.read_table(spark, at)
    tb.write_table(rows(spark, "abc", 7, 2.0), at)
    new = tb.read_table(spark, at)
    assert (old.count(), new.count()) == (10, 21) and old.agg(F.max("v")).first()[0] == 1.0
    assert vs.read(spark, at, number=1).count() == 10
    assert len(vs.expire(spark, at, keep=1)) == 1 and new.count() == 21


def test_one_unit_is_replaced(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    tb.write_table(rows(spark, ["a", "b", "c d/e"]), at)
    before = vs.current(spark, at)
    tb.write_table(rows(spark, ["c d/e", "n"], 2, 3.0), at, only=True)
    got = {(r.unit, r["count"]) for r in tb.read_table(spark, at).groupBy("unit").count().collect()}
    assert got == {("a", 5), ("b", 5), ("c d/e", 2), ("n", 2)}
    after = vs.current(spark, at)
    assert after.number == before.number + 1 and all(after.parts[p] == before.parts[p] for p in ("unit=a", "unit=b"))


def test_units_that_share_files(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    units = ["a", "b", "c d/e", "50%", None]
    tb.write_table(rows(spark, units), at, folders=False)
    assert not list(tmp_path.glob("t/data/*/unit=*")) and len(list(tmp_path.glob("t/data/*/*.parquet"))) <= 2
    old = tb.read_table(spark, at)
    tb.write_table(rows(spark, ["c d/e", "n"], 2, 3.0), at, only=True)
    tb.write_table(rows(spark, ["50%", None], 3, 4.0), at, only=True)
    count = lambda df: {(r.unit, r["count"], r.v) for r in df.groupBy("unit").agg(F.count("*").alias("count"), F.max("v").alias("v")).collect()}
    assert count(old) == {(u, 5, 1.0) for u in units}
    now = {("a", 5, 1.0), ("b", 5, 1.0), ("c d/e", 2, 3.0), ("n", 2, 3.0), ("50%", 3, 4.0), (None, 3, 4.0)}
    assert count(tb.read_table(spark, at)) == now
    assert count(vs.read(spark, at, ["unit=a", "unit=n", "unit=missing"])) == {("a", 5, 1.0), ("n", 2, 3.0)}
    tb.write_table(rows(spark, ["a", "z"]), at, folders=False)  # a whole new table: no unit of the old one is left
    assert count(tb.read_table(spark, at)) == {("a", 5, 1.0), ("z", 5, 1.0)}
    vs.expire(spark, at, keep=1)
    assert count(tb.read_table(spark, at)) == {("a", 5, 1.0), ("z", 5, 1.0)}


def test_a_saved_frame_makes_no_folder_a_unit(spark, shared):
    before = set(shared.glob("runsignal/shelf-*"))
    out = queries()["saved_frame"](spark, "/root/testdata/sf0.001")
    [made] = set(shared.glob("runsignal/shelf-*")) - before
    assert [p.name for p in made.glob("frame/data/*/unit=*")] == ["unit=1"]
    units = out.groupBy("unit").count().collect()
    assert len(units) > 5 and "1" in {r.unit for r in units} and out.groupBy("unit", "ts").count().where("count > 1").count() == 0


def test_what_is_not_committed_is_not_read(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    tb.write_table(rows(spark, "ab"), at)
    rows(spark, "xy").write.partitionBy("unit").parquet(f"{at}/data/version=halfway")
    (tmp_path / "t" / "_commits" / "0000000002").write_text('{"parts": {"unit=a"')  # its writer died
    assert tb.read_table(spark, at).count() == 10 and vs.current(spark, at).number == 1
    tb.write_table(rows(spark, "z"), at, only=True)
    assert vs.current(spark, at).number == 3 and tb.read_table(spark, at).count() == 15


def test_two_writers(spark, tmp_path, monkeypatch):
    """The slower one adds its units to what the faster one has committed."""
    at = f"file://{tmp_path}/t"
    tb.write_table(rows(spark, "a"), at)
    put, met = vs._put, []

    def late(spark, path, text, replace):
        if "_commits" in path and not met:
            met.append(1)
            vs.write(rows(spark, "b"), at, by="unit", only=True)
        return put(spark, path, text, replace)

    monkeypatch.setattr(vs, "_put", late)
    tb.write_table(rows(spark, "c"), at, only=True)
    assert {r.unit for r in tb.read_table(spark, at).select("unit").distinct().collect()} == {"a", "b", "c"}


def test_empty_table_keeps_its_columns(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    tb.write_table(rows(spark, ""), at)
    assert tb.read_table(spark, at).columns == ["unit", "i", "v"] and tb.read_table(spark, at).count() == 0
    with pytest.raises(FileNotFoundError):
        vs.read(spark, f"file://{tmp_path}/none")


def events(spark, first, last, value=1.0):
    """Two tags, a sample every ten minutes from day ``first`` to before day ``last`` of 2025."""
    n = (last - first) * 144
    t = F.timestamp_seconds(F.lit(int(dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc).timestamp())) + F.lit(first * 86400) + F.col("id") * 600)
    out = spark.range(n).select(t.alias("EventTime"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("ID"), (F.col("id") % 7 + value).alias("Value"))
    status = F.when(F.minute("EventTime") == 30, "Bad").otherwise("Good")
    return out.select("ID", "EventTime", status.alias("Status"), "Value")


def test_a_month_reads_its_own_days(spark, tmp_path):
    at = f"file://{tmp_path}/e"
    st.write_events(events(spark, 0, 60), at)
    month = good_samples(st.read_store(spark, at), "2025-02-01 00:00:00", "2025-02-08 06:00:00")
    plan = month._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("\n")[0]
    assert "day" in filters and "2025-02-01" in filters and "2025-02-08" in filters
    assert len({f.split("day=")[1][:10] for f in month.inputFiles()}) <= 60
    want = good_samples(events(spark, 0, 60), "2025-02-01 00:00:00", "2025-02-08 06:00:00")
    assert month.count() == want.count() == 2 * (7 * 144 + 36) * 5 // 6
    assert month.exceptAll(want).count() == 0


def test_days_do_not_depend_on_the_zone(spark, tmp_path):
    at = f"file://{tmp_path}/e"
    st.write_events(events(spark, 0, 3), at)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        got = good_samples(st.read_store(spark, at), "2025-01-02 09:00:00", "2025-01-03 09:00:00").count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == 2 * 144 * 5 // 6


def test_intervals_prune_when_the_job_runs(spark, tmp_path):
    at = f"file://{tmp_path}/e"
    st.write_events(events(spark, 0, 30), at)
    spans = spark.sql("SELECT 'p' AS name, TIMESTAMP '2025-01-10 23:50:00' AS t0, TIMESTAMP '2025-01-11 00:10:00' AS t1 UNION ALL SELECT 'q', TIMESTAMP '2025-01-20 00:00:00', TIMESTAMP '2025-01-20 00:30:00'")
    spans.write.parquet(f"file://{tmp_path}/spans")
    out = st.around(st.read_store(spark, at), spark.read.parquet(f"file://{tmp_path}/spans"))
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.name, r.n) for r in out.groupBy("name").agg(F.count("*").alias("n")).collect()} == {("p", 4), ("q", 6)}


def test_states_read_new_days_only(spark, tmp_path):
    at, states = f"file://{tmp_path}/e", f"file://{tmp_path}/s"
    st.write_events(events(spark, 0, 10), at)
    assert len(pt.refresh_states(spark, at, states, 3600)) == 10 and pt.refresh_states(spark, at, states, 3600) == []
    st.write_events(events(spark, 10, 14), at, only=True)
    st.write_events(events(spark, 3, 4, 50.0), at, only=True)  # a day that has been corrected
    assert sorted(pt.refresh_states(spark, at, states, 3600)) == ["day=2025-01-04", *(f"day=2025-01-{d}" for d in range(11, 15))]
    now = st.read_store(spark, at)
    for width in (3600, 7200, 7 * 86400):
        whole = rs.bucket_means(good_samples(now), width)
        means = pt.means_from(pt.read_states(spark, states), width)
        both = whole.join(means.withColumnRenamed("value", "v"), ["id", "ts"], "full").where("v IS NULL OR value IS NULL OR abs(v - value) > 1e-9")
        assert both.count() == 0 and means.count() == whole.count()
    a, b = ({r.id: r for r in x.collect()} for x in (rs.coverage(now), pt.coverage_from(pt.read_states(spark, states))))
    assert all((a[k].n, a[k].t0, a[k].t1, a[k].vmin, a[k].vmax, round(a[k].vmean, 9)) == (b[k].n, b[k].t0, b[k].t1, b[k].vmin, b[k].vmax, round(b[k].vmean, 9)) for k in a)
    assert sorted(map(tuple, rs.coverage_by_year(now).collect())) == sorted(map(tuple, pt.years_from(pt.read_states(spark, states)).collect()))
    assert len(pt.refresh_states(spark, at, states, 7200)) == 14  # another bucket is another table
    with pytest.raises(ValueError):
        pt.refresh_states(spark, at, states, 7000)


def test_catalog_tables(spark, tmp_path):
    tb.ensure_schema(spark, "plant_one", f"file://{tmp_path}/w")
    tb.save_managed(events(spark, 0, 1), "plant_one.events")
    assert read_events(spark, table="plant_one.events").count() == 288
    spark.createDataFrame([("a", "b", "c", 1)], "ID string, Description string, UoM string, x int").write.parquet(f"file://{tmp_path}/m")
    assert read_metadata(spark, path=f"file://{tmp_path}/m").columns == ["ID", "Description", "UoM"]
    spark.sql("DROP TABLE plant_one.events")
    spark.sql("DROP SCHEMA plant_one")


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    tb.ensure_schema(spark, "plant_two", f"file://{tmp_path}/w")
    left = spark.range(400).selectExpr("cast(id % 20 AS string) AS unit", "timestamp_seconds(id) AS ts", "cast(id AS double) AS v")
    for name in ("features", "labels"):
        tb.save_bucketed(left.withColumnRenamed("v", name), f"plant_two.{name}", buckets=4, location=f"file://{tmp_path}/{name}")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("plant_two.features").join(spark.table("plant_two.labels"), ["unit", "ts"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert joined.count() == 400 and joined.where("features = labels").count() == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for name in ("features", "labels"):
        spark.sql(f"DROP TABLE plant_two.{name}")
    spark.sql("DROP SCHEMA plant_two")
