"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the blank and the five controls from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def split_words(text: Column, separators: str = BLANKS) -> Column:
    """Array of the words between separators; no empty strings."""
    return F.array_remove(F.split(text, separators), "")


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once for the row, whatever the optimizer does to projections."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
