"""Stored analysis windows of one unit: time stamps in, derived columns out."""

import pytest
from pyspark.sql import functions as F

from runsignal.operators import windows as wn

# Run, run_start, run_end, analysis_start, analysis_end, warmup_hours, tail_hours, length_days, clean_days.
FIRST = """
0,2025-02-14 11:00:00,2025-03-05 18:30:00,2025-02-14 23:00:00,2025-03-05 18:00:00,12.0,0.5,19.31,18.79
1,2025-03-07 01:30:00,2025-03-17 15:30:00,2025-03-07 13:30:00,2025-03-17 15:00:00,12.0,0.5,10.58,10.06
2,2025-04-28 11:00:00,2025-05-17 08:30:00,2025-05-04 14:30:00,2025-05-17 07:00:00,147.5,1.5,18.9,12.69
3,2025-05-18 17:30:00,2025-06-06 14:30:00,2025-05-19 21:30:00,2025-06-06 11:00:00,28.0,3.5,18.88,17.56
4,2025-06-08 09:00:00,2025-06-29 07:00:00,2025-06-14 10:00:00,2025-06-29 06:00:00,145.0,1.0,20.92,14.83
5,2025-06-30 17:00:00,2025-07-18 10:30:00,2025-07-01 05:00:00,2025-07-18 10:00:00,12.0,0.5,17.73,17.21
6,2025-07-19 22:30:00,2025-08-14 09:00:00,2025-07-20 15:00:00,2025-08-14 08:30:00,16.5,0.5,25.44,24.73
7,2025-08-16 10:00:00,2025-09-06 20:30:00,2025-08-17 07:00:00,2025-09-06 20:00:00,21.0,0.5,21.44,20.54
8,2025-09-08 10:00:00,2025-10-02 09:30:00,2025-09-08 22:00:00,2025-09-30 12:00:00,12.0,45.5,23.98,21.58
9,2025-10-05 09:00:00,2025-10-27 06:30:00,2025-10-06 02:30:00,2025-10-27 05:30:00,17.5,1.0,21.9,21.12
10,2025-10-28 16:00:00,2025-11-18 07:00:00,2025-10-29 05:30:00,2025-11-18 06:00:00,13.5,1.0,20.62,20.02
11,2025-11-19 17:00:00,2025-12-12 11:30:00,2025-11-20 05:00:00,2025-12-04 08:00:00,12.0,195.5,22.77,14.12
12,2025-12-13 23:30:00,2026-01-01 18:30:00,2025-12-15 17:00:00,2026-01-01 18:00:00,41.5,0.5,18.79,17.04
13,2026-01-03 09:00:00,2026-01-28 09:00:00,2026-01-03 21:00:00,2026-01-28 08:00:00,12.0,1.0,25.0,24.46
14,2026-01-29 19:00:00,2026-02-15 13:00:00,2026-01-30 11:30:00,2026-02-15 12:30:00,16.5,0.5,16.75,16.04
"""
SECOND = """
0,2025-02-14 11:00:00,2025-03-05 18:30:00,2025-02-14 23:00:00,2025-03-03 09:00:00,12.0,57.5,19.31,16.42
1,2025-03-07 01:30:00,2025-03-17 15:30:00,2025-03-07 18:00:00,2025-03-14 19:00:00,16.5,68.5,10.58,7.04
2,2025-04-28 11:00:00,2025-05-17 08:30:00,2025-05-04 14:30:00,2025-05-12 14:30:00,147.5,114.0,18.9,8.0
3,2025-05-18 17:30:00,2025-06-06 14:30:00,2025-05-19 21:30:00,2025-05-24 03:30:00,28.0,323.0,18.88,4.25
4,2025-06-08 09:00:00,2025-06-29 07:00:00,2025-06-14 10:00:00,2025-06-28 20:00:00,145.0,11.0,20.92,14.42
5,2025-06-30 17:00:00,2025-07-18 10:30:00,2025-07-07 08:30:00,2025-07-16 18:30:00,159.5,40.0,17.73,9.42
6,2025-07-19 22:30:00,2025-08-14 09:00:00,2025-07-21 12:30:00,2025-08-11 19:30:00,38.0,61.5,25.44,21.29
7,2025-08-16 10:00:00,2025-09-06 20:30:00,2025-08-17 19:00:00,2025-09-05 16:30:00,33.0,28.0,21.44,18.9
8,2025-09-08 10:00:00,2025-10-02 09:30:00,2025-09-09 07:00:00,2025-09-30 11:00:00,21.0,46.5,23.98,21.17
9,2025-10-05 09:00:00,2025-10-27 06:30:00,2025-10-06 02:30:00,2025-10-26 05:30:00,17.5,25.0,21.9,20.12
10,2025-10-28 16:00:00,2025-11-18 07:00:00,2025-10-29 05:30:00,2025-11-16 12:30:00,13.5,42.5,20.62,18.29
11,2025-11-19 17:00:00,2025-12-12 11:30:00,2025-11-20 05:00:00,2025-12-04 08:00:00,12.0,195.5,22.77,14.12
12,2025-12-13 23:30:00,2026-01-01 18:30:00,2025-12-15 17:00:00,2026-01-01 06:00:00,41.5,12.5,18.79,16.54
13,2026-01-03 09:00:00,2026-01-28 09:00:00,2026-01-03 21:00:00,2026-01-22 18:00:00,12.0,135.0,25.0,18.88
14,2026-01-29 19:00:00,2026-02-15 13:00:00,2026-01-30 11:30:00,2026-02-14 22:30:00,16.5,14.5,16.75,15.46
"""
DERIVED = ("warmup_hours", "tail_hours", "length_days", "clean_days")


def parse(text):
    return [line.split(",") for line in text.strip().splitlines()]


def windows(spark, text):
    times = ("run_start", "run_end", "analysis_start", "analysis_end")
    df = spark.createDataFrame([tuple(r[:5]) for r in parse(text)], ["run", *times])
    df = df.select(F.lit("1HA").alias("unit"), F.col("run").cast("int"), *[F.to_timestamp(c).alias(c) for c in times])
    return wn.finish_windows(df)


@pytest.mark.parametrize("text", [FIRST, SECOND])
def test_derived_columns(spark, text):
    got = [tuple(r[c] for c in DERIVED) for r in windows(spark, text).orderBy("run").collect()]
    assert got == [tuple(map(float, r[5:])) for r in parse(text)]


def test_flags(spark):
    w = windows(spark, FIRST)
    flagged = lambda *limits: sorted(r.run for r in wn.suspicious(w, *limits).collect())
    assert flagged(48.0, 48.0) == [2, 4, 11]
    assert flagged(48.0, 24.0) == [2, 4, 8, 11]


def test_comparison(spark):
    second = windows(spark, SECOND).withColumn("pelt_used", F.lit(True)).withColumn("decoke_method", F.lit("feed_heuristic"))
    r = wn.comparison_means(wn.compare_windows(windows(spark, FIRST), second)).first()
    assert (round(r.mean_delta_clean_days, 3), round(r.mean_delta_warmup_h, 3)) == (-3.098, 12.967)
