"""Session helper for tests and benchmarks; clusters bring their own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str | int | None = None, partitions: int = 8, name: str = "runsignal", **conf: str) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
