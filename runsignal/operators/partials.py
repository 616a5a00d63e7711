"""Daily partial states: counts, sums and bounds that can be added up, stored by day.

A state is one row for each tag, bucket and status of a day.  Means over any multiple of the bucket, coverage and yearly counts all come from
states, so a longer range reads the raw samples of its new days only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import as_number, bucket
from ..sources import versions


def states_of(events: DataFrame, state_s: int) -> DataFrame:
    """``(day, id, ts, good, rows, n, total, low, high, t0, t1)`` from the rows of an event store; combined on the map side."""
    src = events.select(
        "day",
        F.col("ID").alias("id"),
        bucket("EventTime", state_s).alias("ts"),
        F.coalesce(F.col("Status") == "Good", F.lit(False)).alias("good"),
        F.col("EventTime").alias("time"),
        as_number(events, "Value").alias("value"),
    )
    return src.groupBy("day", "id", "ts", "good").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("n"),
        F.sum("value").alias("total"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.min("time").alias("t0"),
        F.max("time").alias("t1"),
    )


def refresh_states(spark: SparkSession, store: str, at: str, state_s: int) -> list[str]:
    """Brings the states at ``at`` up to date with the event store; returns the days that were read.

    The states' commit notes which version of each day they were made from: days that are new or have been replaced are read, no others.
    """
    if 86400 % state_s:
        raise ValueError("the bucket of the states must divide a day")
    have = versions.current(spark, at)
    made = {} if have is None or have.note.get("state_s") != state_s else have.note["from"]
    want = versions.current(spark, store).parts
    fresh = [day for day, version in want.items() if made.get(day) != version]
    if fresh or not made:
        rows = states_of(versions.read(spark, store, fresh), state_s).repartition("day")
        versions.write(rows, at, by="day", only=bool(made), note={"state_s": state_s, "from": {**made, **{d: want[d] for d in fresh}}})
    return fresh


def read_states(spark: SparkSession, at: str) -> DataFrame:
    return versions.read(spark, at)


def means_from(states: DataFrame, bucket_s: int) -> DataFrame:
    """Mean of the good samples per tag and bucket, as ``resample.bucket_means`` has it; ``bucket_s`` is a multiple of the states' bucket."""
    out = states.where("good AND n > 0").groupBy("id", bucket("ts", bucket_s).alias("ts")).agg((F.sum("total") / F.sum("n")).alias("value"))
    return out


def coverage_from(states: DataFrame) -> DataFrame:
    """Samples, first and last time, value range and mean per tag, as ``resample.coverage``; any status counts."""
    return states.groupBy("id").agg(
        F.sum("rows").alias("n"),
        F.min("t0").alias("t0"),
        F.max("t1").alias("t1"),
        F.min("low").alias("vmin"),
        F.max("high").alias("vmax"),
        F.try_divide(F.sum("total"), F.sum("n")).alias("vmean"),
    )


def years_from(states: DataFrame) -> DataFrame:
    """Samples per tag and year, as ``resample.coverage_by_year``, for sessions whose year begins with a bucket."""
    return states.groupBy("id", F.year("ts").alias("yr")).agg(F.sum("rows").alias("n"))
