"""Connected components of large graphs as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.scratch import Scratch


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one at most, and none if a larger one leads to it."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("x"))
    seen = ends.groupBy("x.node").agg(F.sum("x.down").alias("down"), F.max("x.up").alias("up"))
    return not seen.where("down > 1 OR down = 1 AND up = 1").limit(1).count()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``component``, the smallest node that it reaches, for the nodes of ``edges`` (``u``, ``v``).

    Alternates two steps until only stars around smallest nodes are left: every node links its larger neighbours to its
    smallest one, then its smaller neighbours and itself to it. The number of rounds grows with the
    logarithm of the graph. Smallest neighbours are partial aggregates and the joins are plain ones,
    so a node of very many neighbours is spread over tasks. Each round is kept in the shared folder.
    """
    now = scratch.keep(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.where(F.col("u") > F.col("m")).select("u", F.col("m").alias("v"))
        ).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(linked.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
