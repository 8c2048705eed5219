"""Network requests put together from the events of their life."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def requests(events: DataFrame) -> DataFrame:
    """One row a request and hop: columns ``tab``, ``request``, ``hop``, ``kind`` (sent, response, finished, failed), ``ts_ms``, ``url``, ``status``.

    A request's events may come in any order; its times and status are conditional aggregates, so no
    list of events is gathered. A request with neither end is pending.
    """
    of = lambda kind, column: F.max(F.when(F.col("kind") == kind, F.col(column)))
    grouped = events.groupBy("tab", "request", "hop").agg(
        F.min(F.when(F.col("kind") == "sent", F.col("ts_ms"))).alias("start_ms"),
        F.max(F.when(F.col("kind").isin("finished", "failed"), F.col("ts_ms"))).alias("end_ms"),
        of("sent", "url").alias("url"),
        of("response", "status").alias("status"),
        F.bool_or(F.col("kind") == "failed").alias("failed"),
    )
    state = F.when(F.col("failed"), "failed").when(F.col("end_ms").isNull(), "pending").when(F.col("status") >= 400, "error").otherwise("ok")
    return grouped.select("tab", "request", "hop", "url", "status", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), state.alias("state"))
