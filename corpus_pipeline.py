"""Corpus pipeline: stages of the text operators over ``documents``, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsignal.llm import decontam, neardup, pieces, quality, substring
from runsignal.llm.queries import piece_file
from runsignal.llm.scratch import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail their own rules or come from a rejected host."""
    return quality.judged(docs).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id."""
    gone = neardup.near_groups(docs).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("gone_id"), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that start earlier elsewhere are cut from the text; ``n_chars`` follows."""
    row = substring.without_repeats(docs).select("row.*")
    return row.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else row


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.leaked(docs, items).where(F.size("hits") == 0).select("row.*")


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as ids: ``doc_id, source, lang, n_ids, ids``."""
    out = pieces.encoded(docs.select("doc_id", "source", "lang", "text"), pieces.read_model(piece_file()))
    return out.select("row.doc_id", "row.source", "row.lang", F.coalesce(F.size("ids"), F.lit(0)).alias("n_ids"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("piece_ids", piece_ids),
]

#: SQL expresses neither the near-duplicate groups nor the ids; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
