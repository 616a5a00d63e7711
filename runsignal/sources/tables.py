"""Tables the jobs write and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import versions

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as the session names it.

    Only where it is unset and Spark runs in one process, as in tests, is one made, once a session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_shared_folder", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="runsignal-")
        spark._shared_folder = root
    return root.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and read it back.

    Used where several later steps need the same rows: they would otherwise each repeat the scan
    and its shuffle.  The copy survives lost executors and goes away with the session.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/runsignal/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, by: tuple[str, ...], buckets: int, order: tuple[str, ...] = ()) -> DataFrame:
    """``stage`` for rows that several steps take by the same keys: every step reads just its columns, without an exchange.

    ``df`` comes distributed by these keys in as many partitions; each is written as one bucket.
    """
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{checkpoint_root(spark)}/runsignal/{name}"
    df.write.bucketBy(buckets, *by).sortBy(*(order or by)).option("path", path).format("parquet").saveAsTable(name)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.table(name)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to its end: a job cut off half-way leaves no success mark."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ensure_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}" + (f" LOCATION '{location}'" if location else ""))


def write_table(df: DataFrame, path: str, by: str | None = "unit", fmt: str = "parquet", only: bool = False, folders: bool = True) -> None:
    """A new version of a table, schema included; readers of the version before are not disturbed.

    Rows of a unit come together first, so a folder gets one file; where many rows come together, Spark splits them over
    several tasks.  ``only``: just the units that df has rows of are replaced.  ``folders=False`` is for thousands of small units: they
    share files, each unit's rows side by side; a unit replaced later gets a folder.
    """
    by = by if by and by in df.columns else None
    if by:
        df = df.hint("rebalance", by)
    if by and not folders and not only:
        df, by = df.sortWithinPartitions(by), None
    versions.write(df, path, by=by, only=only, fmt=fmt)


def save_managed(df: DataFrame, name: str, fmt: str = "parquet") -> None:
    """Overwrite a table of the session catalog."""
    df.write.mode("overwrite").option("overwriteSchema", "true").format(fmt).saveAsTable(name)


def save_bucketed(df: DataFrame, name: str, by: tuple[str, ...] = ("unit", "ts"), buckets: int = 64, location: str | None = None) -> None:
    """A table of the session catalog in buckets of ``by``, each sorted by it: two such tables join by these columns without an exchange.

    ``buckets`` is fixed by the table, so choose it for its size, not for the cluster.  Rows are spread first, so a bucket is one file.
    """
    writer = df.repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by)
    (writer.option("path", location) if location else writer).saveAsTable(name)


def normalise_time(df: DataFrame) -> DataFrame:
    """Older tables call the time column ``timestamp``; here it is always ``ts``."""
    if "ts" not in df.columns and "timestamp" in df.columns:
        df = df.withColumnRenamed("timestamp", "ts")
    if "ts" in df.columns and not isinstance(df.schema["ts"].dataType, T.TimestampType):
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    # A folder without commits is a plain table.
    df = normalise_time(versions.read(spark, path) if versions.current(spark, path) else spark.read.parquet(path))
    # Folder names are read back as the narrowest type; unit is text everywhere.
    return df.withColumn("unit", F.col("unit").cast("string")) if "unit" in df.columns else df


def read_or_build(spark: SparkSession, path: str, build, refresh: bool = False, by: str | None = "unit", folders: bool = True) -> DataFrame:
    """Saved table if there is a complete one, else build it, save it as a new version and read it back.

    A DataFrame read earlier keeps its version's files, also while the table is built anew.
    """
    if refresh or not complete(spark, path):
        write_table(build(), path, by=by, folders=folders)
    return read_table(spark, path)


WINDOW_SCHEMA = T.StructType(
    [
        T.StructField("unit", T.StringType()),
        T.StructField("run", T.IntegerType()),
        T.StructField("run_start", T.TimestampType()),
        T.StructField("run_end", T.TimestampType()),
        T.StructField("analysis_start", T.TimestampType()),
        T.StructField("analysis_end", T.TimestampType()),
        T.StructField("warmup_hours", T.DoubleType()),
        T.StructField("tail_hours", T.DoubleType()),
        T.StructField("length_days", T.DoubleType()),
        T.StructField("clean_days", T.DoubleType()),
        T.StructField("settled", T.BooleanType()),
    ]
)
WINDOW_SCHEMA_V2 = T.StructType(
    WINDOW_SCHEMA.fields
    + [
        T.StructField("pelt_used", T.BooleanType()),
        T.StructField("warmup_method", T.StringType()),
        T.StructField("decoke_method", T.StringType()),
    ]
)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampFormat", TIME_FORMAT).csv(path)


def read_windows_csv(spark: SparkSession, path: str, v2: bool = False) -> DataFrame:
    schema = WINDOW_SCHEMA_V2 if v2 else WINDOW_SCHEMA
    return spark.read.schema(schema).option("header", True).option("timestampFormat", TIME_FORMAT).csv(path)
