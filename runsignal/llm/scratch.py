"""Intermediate tables in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import checkpoint_root

T = TypeVar("T")


def path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: cuts lineage, and a lost executor costs nothing.  It goes away with the session."""
    spark, at = df.sparkSession, path(df.sparkSession, name)
    df.write.parquet(at)
    folder = spark._jvm.org.apache.hadoop.fs.Path(at)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(at)


def per_process(data: bytes, build: Callable[[bytes], T]) -> T:
    """What ``build`` makes of ``data``, kept by a Python worker for its later tasks."""
    kept = vars(sys).setdefault("_runsignal_kept", {})
    key = (build.__qualname__, hash(data))
    if key not in kept:
        kept[key] = build(data)
    return kept[key]
