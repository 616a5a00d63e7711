"""Long sensor events: one row per sample, filtered on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import as_number, col

EVENT_COLUMNS = ("ID", "EventTime", "Status", "Value")

# Up to this many tags the id list is sent to every executor (roughly 100 MB of short strings).
BROADCAST_TAGS = 2_000_000


def read_events(spark: SparkSession, table: str | None = None, path: str | None = None) -> DataFrame:
    """The events table, by catalog name or by parquet path."""
    df = spark.read.table(table) if table else spark.read.parquet(path)
    return df.select(*EVENT_COLUMNS)


def read_metadata(spark: SparkSession, table: str | None = None, path: str | None = None) -> DataFrame:
    df = spark.read.table(table) if table else spark.read.parquet(path)
    return df.select("ID", "Description", "UoM")


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_TAGS) -> bool:
    """Whether a dimension has at most ``limit`` rows; looks at no more than ``limit + 1``."""
    return df.limit(limit + 1).count() <= limit


def sent_if_small(df: DataFrame, limit: int = BROADCAST_TAGS) -> DataFrame:
    """Marked for broadcast when its size has been checked, else left to a shuffle join."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def utc_day(ts) -> Column:
    """Day of a time in UTC, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(col(ts)) / 86400).cast("int"))


def days_between(events: DataFrame, start=None, end=None) -> DataFrame:
    """Keeps the days of an event store that [start, end) touches; constants, so that other folders are not listed."""
    if start is not None:
        events = events.where(F.col("day") >= utc_day(F.lit(start).cast("timestamp")))
    if end is not None:
        events = events.where(F.col("day") <= utc_day(F.lit(end).cast("timestamp")))
    return events


def good_samples(events: DataFrame, start=None, end=None) -> DataFrame:
    """Good, numeric samples in the half-open range [start, end) as (id, time, value).

    Filters stay on raw columns so they reach the parquet scan; an event store is also narrowed to the days of the range.
    """
    keep = events.where(F.col("Status") == "Good")
    if "day" in events.columns:
        keep = days_between(keep, start, end)
    if start is not None:
        keep = keep.where(F.col("EventTime") >= F.lit(start).cast("timestamp"))
    if end is not None:
        keep = keep.where(F.col("EventTime") < F.lit(end).cast("timestamp"))
    return keep.select(
        F.col("ID").alias("id"), F.col("EventTime").alias("time"), as_number(events, "Value").alias("value")
    ).where(F.col("value").isNotNull())


def only_tags(samples: DataFrame, tags: DataFrame) -> DataFrame:
    """Keep samples of the tags listed in ``tags.id``.

    A checked, bounded id list goes to the samples; a longer one is joined by tag, where a tag that holds
    a third of all samples is split at run time.  The rows are the same either way.
    """
    return samples.join(sent_if_small(tags.select("id").distinct()), "id", "left_semi")
