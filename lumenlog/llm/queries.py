"""The subpackage's queries, with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.scratch import Scratch

from . import bpe_trie, clusters, decontamination, fingerprints, licenses, near_dup, oracles, packing, passages, quality, sharding, substrings, token_files, vector_codes
from .common import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measure(documents(spark, sf_dir)).drop("text")
    scratch = Scratch(spark, "op1")
    kept = scratch.keep(measured, "measures")  # without texts; read for the sketches and for the verdicts
    judged = quality.judge(kept, scratch.keep(quality.thresholds(kept), "thresholds"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir), Scratch(spark, "op2"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = [f"shard-{i:03d}" for i in range(64)]
    return sharding.place(documents(spark, sf_dir).select("doc_id"), "doc_id", shards).select("doc_id", "slot", "shard")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(documents(spark, sf_dir))


def op5_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(documents(spark, sf_dir), Scratch(spark, "op7"), width=2)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "op9").path("tokens")
    token_files.write_tokens(documents(spark, sf_dir), folder, vocabulary("word_bpe_49k.json"))
    return token_files.read_documents(spark, folder).withColumnRenamed("key", "doc_id")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir), Scratch(spark, "op10"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op11"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.hits(documents(spark, sf_dir), benchmark, Scratch(spark, "op12")).drop("items")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op13"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sharding": op3_sharding,
    "op4_fingerprints": op4_fingerprints,
    "op5_bpe_trie": op5_bpe_trie,
    "op6_packing": op6_packing,
    "op7_near_dup": op7_near_dup,
    "op8_licenses": op8_licenses,
    "op9_token_files": op9_token_files,
    "op10_passages": op10_passages,
    "op11_vector_codes": op11_vector_codes,
    "op12_decontamination": op12_decontamination,
    "op13_clusters": op13_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality": oracles.op1(),
    "op7_near_dup": oracles.op7(),
    "op8_licenses": oracles.op8(),
    "op11_vector_codes": oracles.op11(),
    "op12_decontamination": oracles.op12(),
    "op13_clusters": oracles.op13(),
}
