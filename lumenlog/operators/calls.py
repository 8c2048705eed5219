"""Model calls: totals, and the place of each call in its conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import floor_rank, nth_values


def totals(calls: DataFrame) -> DataFrame:
    """Calls, tokens and token percentiles by role."""
    ranked = nth_values(calls, ["role"], "tokens", {"p50": floor_rank(0.5), "p95": floor_rank(0.95)})
    return calls.groupBy("role").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).join(ranked.drop("n"), "role")


def positions(calls: DataFrame) -> DataFrame:
    """Place of each call among those of its role in the conversation, and their number."""
    own = Window.partitionBy("conversation", "role")
    return calls.withColumns({"place": F.row_number().over(own.orderBy("turn", "tokens", "text")), "of": F.count("*").over(own)})


def conversations(calls: DataFrame) -> DataFrame:
    """Turns, tokens and roles of every conversation; long ones are sums, not lists."""
    return calls.groupBy("conversation").agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens"), F.countDistinct("role").alias("roles"), F.min_by("role", "turn").alias("first_role"))
