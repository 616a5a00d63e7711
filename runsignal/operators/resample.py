"""Bucketing, grids and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import as_number, bucket, steady_mean
from ..settings import PLANT
from ..sources.historian import only_tags, sent_if_small


def bucket_means(samples: DataFrame, bucket_s: int, keys=("id",)) -> DataFrame:
    """Mean per tag and epoch-aligned bucket.

    The mean is combined on the map side, so a tag with very many samples reaches the shuffle as
    one row per bucket and task.
    """
    return samples.groupBy(*keys, bucket("time", bucket_s).alias("ts")).agg(steady_mean("value").alias("value"))


def load_history(samples: DataFrame, catalog: DataFrame, bucket_s: int) -> DataFrame:
    """Bucketed long history (unit, id, role, grp, ts, value) of all catalogued tags.

    The catalog is joined after the aggregation, on far fewer rows than there are samples.
    """
    means = bucket_means(only_tags(samples, catalog), bucket_s)
    tags = sent_if_small(catalog.select("id", "unit", "role", "grp"))
    return means.join(tags, "id").select(
        "unit", "id", "role", "grp", "ts", "value"
    )


def grid_span(history: DataFrame) -> DataFrame:
    """First and last bucket of every unit over all its tags, plant-wide tags included."""
    own = history.where(F.col("unit") != PLANT).groupBy("unit").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    plant = history.where(F.col("unit") == PLANT)
    return own.select(
        "unit",
        F.least("t0", plant.agg(F.min("ts")).scalar()).alias("t0"),
        F.greatest("t1", plant.agg(F.max("ts")).scalar()).alias("t1"),
    )


def dense_grid(span: DataFrame, bucket_s: int) -> DataFrame:
    """Every bucket from t0 to t1 of each unit."""
    step = F.make_dt_interval(secs=F.lit(int(bucket_s)))
    return span.select("unit", F.explode(F.sequence("t0", "t1", step)).alias("ts"))


def fill_grid(frame: DataFrame, bucket_s: int, plant: DataFrame | None = None) -> DataFrame:
    """Add the missing buckets of each unit as rows of NULLs.

    Each row is stretched up to its successor, so no join with a separate grid is needed and the
    unit partitioning made here also serves the windows that follow.  Every unit reaches as far
    as the plant-wide rows in ``plant`` do.
    """
    w = Window.partitionBy("unit").orderBy("ts")
    step = F.make_dt_interval(secs=F.lit(int(bucket_s)))
    src = frame.withColumn("_prev", F.lag("ts").over(w)).withColumn("_next", F.lead("ts").over(w))
    begin = end = F.col("ts")
    if plant is not None:
        begin = F.least(begin, plant.agg(F.min("ts")).scalar())
        end = F.greatest(end, plant.agg(F.max("ts")).scalar())
    first = F.when(F.col("_prev").isNull(), begin).otherwise(F.col("ts"))
    last = F.when(F.col("_next").isNull(), end).otherwise(F.col("_next") - step)
    rows = src.withColumn("_at", F.explode(F.sequence(first, last, step)))
    here = F.col("_at") == F.col("ts")
    values = [c for c in frame.columns if c not in ("unit", "ts")]
    return rows.select("unit", F.col("_at").alias("ts"), *[F.when(here, F.col(c)).alias(c) for c in values])


def to_wide(history: DataFrame, ids: list[str], bucket_s: int) -> DataFrame:
    """One column per requested tag on the unit's dense grid; for a handful of named tags.

    Sensor sets stay long: a column per sensor would not survive a fleet.
    """
    own = history.where(F.col("id").isin(ids))
    span = own.groupBy("unit").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    values = own.groupBy("unit", "ts").pivot("id", ids).agg(F.first("value"))
    return dense_grid(span, bucket_s).join(values, ["unit", "ts"], "left")


def coverage(events: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Sample count, first and last time, value range and mean per tag; any status counts."""
    src = events.select(
        F.col("ID").alias("id"), F.col("EventTime").alias("time"), as_number(events, "Value").alias("value")
    )
    if tags is not None:
        src = only_tags(src, tags)
    out = src.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("time").alias("t0"),
        F.max("time").alias("t1"),
        F.min("value").alias("vmin"),
        F.max("value").alias("vmax"),
        F.avg("value").alias("vmean"),
    )
    return _listed(out, tags).orderBy("id")


def coverage_by_year(events: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    src = events.select(F.col("ID").alias("id"), F.col("EventTime").alias("time"))
    if tags is not None:
        src = only_tags(src, tags)
    out = src.groupBy("id", F.year("time").alias("yr")).agg(F.count(F.lit(1)).alias("n"))
    return _listed(out, tags).orderBy("id", "yr")


def _listed(per_tag: DataFrame, tags: DataFrame | None) -> DataFrame:
    """Second, cheap id filter: covers tag lists too long to be sent to the samples."""
    return per_tag if tags is None else per_tag.join(tags.select("id").distinct(), "id", "left_semi")


def coverage_matrix(by_year: DataFrame) -> DataFrame:
    """Tag x year counts over all years present, 0 where a tag has no sample."""
    wide = by_year.groupBy("id").pivot("yr").sum("n")
    return wide.na.fill(0, wide.columns[1:])


def role_by_year(by_year: DataFrame, roles: DataFrame) -> DataFrame:
    """Role x year counts over all years present; ``roles`` maps id to role."""
    wide = by_year.join(roles.select("id", "role"), "id").groupBy("role").pivot("yr").sum("n")
    return wide.na.fill(0, wide.columns[1:])
