"""Running values over the ordered rows of each key, where one key may hold a large part of all rows.

A window over a key sorts all its rows in one task. Here rows are dealt by ranges of key and order
together and kept, so a hot key fills several ranges; running values are taken within each range,
and what earlier ranges of the same key hold is carried on. As ranges are in order, each begins
within one key at most: what is carried is one row a range, whatever the data, and is broadcast.

Kinds of values are those that can be carried: ``sum``, ``max``, ``min``, and ``last``, the value
of the last row where it isn't null. Rows that agree in key and order stand in any order but in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.scratch import Scratch

_OF = {"sum": F.sum, "max": F.max, "min": F.min}
_BOTH = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least, "last": lambda own, carried: F.coalesce(own, carried)}


def ranged(rows: DataFrame, keys: list[str], order: list[str], scratch: Scratch, parts: int | None = None) -> DataFrame:
    """``rows`` as a kept table with ``_range``, the number of the range of keys and order that a row is in.

    ``parts`` ranges, or as many as the session's shuffles have. With no keys all rows are one sequence.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *[F.col(c) for c in (*keys, *order)])
    return scratch.keep(dealt.withColumn("_range", F.spark_partition_id()), "ranged")


def running(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, tuple[str, Column]], frame: str = "before", backwards: bool = False) -> DataFrame:
    """``rows`` of :func:`ranged` with a column for each of ``columns``, which are (kind, value).

    ``frame`` says which rows of the key count: those ``before`` a row, those ``upto`` it (itself
    included), or ``all``. ``backwards`` reads the order from its end. Without a row that counts, or with nulls
    only, a value is null. Null keys are a key. A chain of calls on one table is fine: ``_range`` stays.
    """
    by = [F.desc(c) if backwards else F.asc(c) for c in order]
    within = Window.partitionBy(*keys, "_range")
    if frame != "all":
        within = within.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0 if frame == "upto" else -1)
    elif any(kind == "last" for kind, _ in columns.values()):
        within = within.orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    latest = F.min_by if backwards else F.max_by
    place = F.struct(*[F.col(c) for c in order])

    def own(kind: str, value: Column) -> Column:
        return (F.last(value, ignorenulls=True) if kind == "last" else _OF[kind](value)).over(within)

    def total(kind: str, value: Column) -> Column:
        return latest(value, F.when(value.isNotNull(), place)) if kind == "last" else _OF[kind](value)

    ends = rows.groupBy(*keys, "_range").agg(*[total(*x).alias(f"_t_{name}") for name, x in columns.items()])
    of_key = Window.partitionBy(*keys)
    step = F.desc("_range") if backwards else F.asc("_range")
    if frame == "all":
        earlier = of_key.orderBy(step).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        needed = F.count("*").over(earlier) > 1
    else:
        earlier = of_key.orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        needed = F.row_number().over(of_key.orderBy(step)) > 1
    carry = [(F.last(f"_t_{name}", ignorenulls=True) if kind == "last" else _OF[kind](f"_t_{name}")).over(earlier).alias(f"_c_{name}") for name, (kind, _) in columns.items()]
    carried = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_of"), needed.alias("_needed"), *carry).where("_needed").drop("_needed")
    here = rows.withColumns({f"_o_{name}": own(*x) for name, x in columns.items()})
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = here.join(F.broadcast(carried), same, "left")  # two rows a range at most
    if frame == "all":
        value = {name: F.coalesce(f"_c_{name}", f"_o_{name}") for name in columns}
    else:
        value = {name: _BOTH[kind](F.col(f"_o_{name}"), F.col(f"_c_{name}")) for name, (kind, _) in columns.items()}
    return joined.withColumns(value).select(*rows.columns, *columns)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` of :func:`ranged` with each row's number within its key, from 1."""
    return running(rows, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, "upto")


def every_nth(rows: DataFrame, order: list[str], step: int, scratch: Scratch) -> DataFrame:
    """The first row in ``order`` and each ``step``-th after it, by exact numbers over all rows without a task that holds them all.

    Rows that agree in ``order`` count in any order; null values come first. An empty table stays empty.
    """
    if step < 1:
        raise ValueError("a step is 1 or more")
    own = numbered(ranged(rows, [], order, scratch), [], order, "_place")
    return own.where(F.pmod(F.col("_place") - 1, F.lit(step)) == 0).select(*rows.columns)
