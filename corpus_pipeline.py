"""From raw documents to packed token windows, in four stages.

Each stage takes what the one before kept, as a table with the columns of ``documents``, and its
decisions take effect; the last returns the pieces of the packed windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm import near_dup, packing, quality, substrings
from lumenlog.llm.queries import vocabulary
from lumenlog.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or their group's thresholds go."""
    return quality.filter_documents(docs, Scratch(spark, "stage-quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest id stays."""
    return near_dup.keep_one(docs, Scratch(spark, "stage-near"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that are found elsewhere go; ``n_chars`` follows the text, other columns stay as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    beside = docs.select("doc_id", "text", F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("beside"))
    cut = substrings.remove_repeats(beside, Scratch(spark, "stage-substrings"), with_text=True, carry=("beside",))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return cut.select(*[made.get(c, F.col(f"beside.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4,096 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("suffix_dedup", suffix_dedup), ("packing", pack)]

#: SQL can express neither the byte-level removal nor the packing; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each kept in the shared folder before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
