"""Registered queries of the operators: thin wrappers with the parameters of a production run."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesuffix import without_repeated_bytes
from .chat import perspectives
from .collocations import collocations
from .decontam import leaked
from .kneserney import score, train, trained_on
from .langid import languages, learn
from .neardup import NearDup, near_groups
from .pieces import decoded, encoded, read_model
from .quality import judged, words
from .sharding import sharded
from .spelling import spelling_variants
from .substring import without_repeats
from .urls import Rule, judged_urls

URL_RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def piece_file() -> str:
    """The vocabulary file: the one that the variable PIECE_MODEL names, else that of the public_tokenizers package, which only this needs."""
    if named := os.environ.get("PIECE_MODEL"):
        return named
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def __getattr__(name: str) -> str:
    if name == "PIECES":
        return piece_file()
    raise AttributeError(name)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents", "doc_id", "text"), NearDup(shingle=4))


def op2_piece_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = read_model(piece_file())
    ids = encoded(table(spark, sf_dir, "documents", "doc_id", "text"), model)
    out = decoded(ids, model)
    digest = F.sha2(F.array_join(F.col("row.ids"), " "), 256)
    return out.select("row.row.doc_id", F.coalesce(F.size("row.ids"), F.lit(0)).cast("long").alias("n_ids"), digest.alias("ids_sha256"), F.col("text").eqNullSafe(F.col("row.row.text")).alias("round_trip"))


def op3_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaked(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    best = F.get("hits", F.lit(0))
    return out.select("row.doc_id", (F.size("hits") == 0).alias("kept"), F.size("hits").cast("long").alias("n_items"), best["item_id"].alias("item_id"), best["distance"].alias("distance"), "hits")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents", "doc_id", "text", "source"), keep=["doc_id", "source"])
    return out.select("row.doc_id", *(f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept", "host_rejected")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.array_join(words(F.col("row.text")), " "), 256).alias("kept_sha256"))


def op6_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


def op8_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    models = learn(docs.where(trained_on(F.col("doc_id"), 4, 2)))
    held_out = F.coalesce(~trained_on(F.col("row.doc_id"), 4, 2), F.lit(False))
    return languages(docs.select("doc_id", "text"), models).select("row.doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs.where(trained_on(F.col("doc_id"), 7, 2)), parts=int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = score(docs, model).withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
    return out.select("doc_id", F.coalesce(~trained_on(F.col("doc_id"), 7, 2), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op11_phrase_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents", "text", "lang"))


def op12_interval_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_bytes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_bloom_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_dedup,
        op2_piece_stream,
        op3_cgk_decontamination,
        op4_host_rules,
        op5_substring_dedup,
        op6_ring_shards,
        op7_url_trees,
        op8_language_families,
        op9_kneser_ney,
        op10_perspectives,
        op11_phrase_filters,
        op12_interval_tree,
        op13_bloom_spelling,
    )
}
