"""Exact values by rank, without gathering a group in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 10_000


def nth_values(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For every group the values at given ranks (from 0, as functions of the group's size), and the size ``n``.

    Two passes: rows are counted in ``CELLS`` equal cells between the group's least and greatest
    value, which tells the cell of each rank; only that cell's distinct values are ordered.
    Null values are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(1)), ["_all"]
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    cell = F.when(F.col("_high") == F.col("_low"), 0).otherwise(F.least(F.lit(CELLS - 1), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * CELLS))).cast("int")
    placed = rows.join(stats, keys).withColumn("_cell", cell)
    counted = placed.groupBy(*keys, "n", "_cell").agg(F.count("*").alias("_rows"))
    upto = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items()]))
    cumulated = counted.withColumn("_end", F.sum("_rows").over(upto)).withColumn("_want", wanted)
    begin = F.col("_end") - F.col("_rows")
    targets = cumulated.where((F.col("_want.rank") >= begin) & (F.col("_want.rank") < F.col("_end"))).select(*keys, "_cell", F.col("_want.name").alias("_name"), (F.col("_want.rank") - begin).alias("_rank"))
    inside = placed.join(targets, [*keys, "_cell"]).groupBy(*keys, "_name", "_rank", "_v").agg(F.count("*").alias("_rows"))
    within = Window.partitionBy(*keys, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = inside.withColumn("_end", F.sum("_rows").over(within)).where((F.col("_rank") >= F.col("_end") - F.col("_rows")) & (F.col("_rank") < F.col("_end")))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])
    return stats.select(*keys, "n").join(wide, keys, "left").drop("_all")


def floor_rank(p: float) -> Callable[[Column], Column]:
    """Rank of a percentile: floor(n p), the last at most."""
    return lambda n: F.least(n - 1, F.floor(n * p))


def ceil_rank(p: float) -> Callable[[Column], Column]:
    """Rank of a percentile: ceil(n p) - 1."""
    return lambda n: F.greatest(F.lit(0), F.ceil(n * p) - 1)
