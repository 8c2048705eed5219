"""Metric series: rates of counters, percentiles of histograms, thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.scratch import Scratch

from .scans import numbered, ranged, running


def rates(points: DataFrame, series: str = "series", time: str = "time_ms", value: str = "total") -> DataFrame:
    """Change a second of a cumulative counter; a drop is a restart from zero; null without time between points."""
    own = ranged(points, [series], [time, "id"], Scratch(points.sparkSession, "rates"))
    rows = running(own, [series], [time, "id"], {"_lag": ("last", F.struct(F.col(value).alias("value"), F.col(time).alias("time")))})
    before, then = F.col("_lag.value"), F.col("_lag.time")
    change = F.when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    seconds = (F.col(time) - then) / 1000
    return rows.withColumn("rate", F.when(seconds > 0, change / seconds)).drop("_lag", "_range")


def histogram_percentile(bounds: list[float], counts: Column, p: float) -> Column:
    """Percentile of a histogram, interpolated in its bucket; the last, open bucket gives its lower bound."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c)
    rank = total * p
    lower, upper = F.lit([bounds[0], *bounds]), F.lit([*bounds, bounds[-1]])
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(0).alias("at"), F.lit(None).cast("double").alias("found"))

    def step(s: Column, c: Column) -> Column:
        share = F.when(c > 0, (rank - s["seen"]) / c)
        value = F.get(lower, s["at"]) + (F.get(upper, s["at"]) - F.get(lower, s["at"])) * share
        hit = s["found"].isNull() & (c > 0) & (s["seen"] + c >= rank)
        return F.struct((s["seen"] + c).alias("seen"), (s["at"] + 1).alias("at"), F.when(hit, value).otherwise(s["found"]).alias("found"))

    return F.aggregate(counts, start, step)["found"]


def histograms(rows: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Counts of values up to each bound and above the last."""
    edges = [None, *bounds, None]
    tests = [F.count_if((F.col(value) > low if low is not None else F.lit(True)) & (F.col(value) <= high if high is not None else F.lit(True)) & F.col(value).isNotNull()).cast("double") for low, high in zip(edges, edges[1:], strict=False)]
    return rows.groupBy(*keys).agg(F.array(*tests).alias("counts"))


def thinned(points: DataFrame, series: str, order_by: list[str], most: int) -> DataFrame:
    """Evenly chosen points of each series, the first and last among them."""
    own = numbered(ranged(points, [series], order_by, Scratch(points.sparkSession, "thinned")), [series], order_by, "_place")
    counted = running(own, [series], order_by, {"_n": ("sum", F.lit(1))}, "all").withColumn("_i", F.col("_place") - 1)
    chosen = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / (most - 1) + 0.5).cast("int"))
    kept = (F.col("_n") <= most) | F.array_contains(chosen, F.col("_i").cast("int"))
    return counted.where(kept).select(*points.columns)


def without_late(points: DataFrame, arrival: str = "id") -> DataFrame:
    """Points later than all of their series that arrived before: repeats and late ones go. Of equal arrivals the earlier time is first."""
    order = [arrival, "time_ms"]
    own = ranged(points, ["series"], order, Scratch(points.sparkSession, "late"))
    newest = running(own, ["series"], order, {"_newest": ("max", F.col("time_ms"))})
    return newest.where(F.col("_newest").isNull() | (F.col("time_ms") > F.col("_newest"))).select(*points.columns)


def measure_of() -> Column:
    """What a series is plotted as: rate, p95, average or value."""
    kind = F.col("kind")
    return (
        F.when((kind == "sum") & F.col("monotonic"), "rate")
        .when((kind == "histogram") & (F.size("bounds") > 0), "p95")
        .when((kind == "summary") & quantile(0.95).isNotNull(), "p95")
        .when(kind.isin("histogram", "exponentialHistogram", "summary"), "average")
        .otherwise("value")
    )


def quantile(p: float) -> Column:
    """The value of a summary's quantile, null without it."""
    return F.get(F.filter("quantiles", lambda q: F.abs(q["quantile"] - p) < 1e-9), F.lit(0))["value"]


def bucket_percentile(bounds: Column, counts: Column, p: float, low: Column, high: Column) -> Column:
    """``value``, ``lower`` and ``upper`` of the bucket that holds a percentile; edges stay within the least and largest value, if known."""
    rank = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c) * p
    seen = F.transform(counts, lambda _, i: F.aggregate(F.slice(counts, 1, i), F.lit(0.0), lambda s, c: s + c))
    hits = F.filter(F.sequence(F.lit(0), F.size(counts) - 1), lambda i: (F.get(counts, i) > 0) & (F.get(seen, i) + F.get(counts, i) >= rank))
    i = F.get(hits, F.lit(0))
    first = F.get(bounds, F.lit(0))
    under = F.least(F.coalesce(low, F.least(F.lit(0.0), first)), first)
    lower0 = F.when(i == 0, under).otherwise(F.get(bounds, i - 1))
    upper0 = F.when(i == F.size(bounds), F.greatest(F.coalesce(high, F.get(bounds, i - 1)), lower0)).otherwise(F.get(bounds, i))
    lower = F.when(low.isNotNull(), F.greatest(lower0, F.least(low, upper0))).otherwise(lower0)
    upper = F.when(high.isNotNull(), F.least(upper0, F.greatest(high, lower))).otherwise(upper0)
    value = lower + (upper - lower) * ((rank - F.get(seen, i)) / F.get(counts, i))
    inside = F.struct(value.alias("value"), lower.alias("lower"), upper.alias("upper"))
    return F.when(i.isNotNull(), inside).when((rank > 0) & high.isNotNull(), F.struct(high.alias("value"), high.alias("lower"), high.alias("upper")))


def intervals(points: DataFrame) -> DataFrame:
    """``points`` of OTLP and what each adds to its series: ``measure, plotted, interval_count, average, p50, bound``.

    A cumulative point (``temporality`` 2) is compared with the cumulative point before it if both
    have the same start: counters give the change a second, distributions the buckets between them.
    Counters that fell, or began anew, count from their start; distributions whose count or sum fell
    count whole. ``plotted`` is null where there is nothing to say, ``bound`` tells that a
    bucket was too wide to place the p95, so that its upper edge is given. Columns that a kind
    doesn't need may be missing or null.
    """
    kinds = {"monotonic": "boolean", "temporality": "int", "start_ms": "double", "value": "double", "count": "double", "sum": "double", "min": "double", "max": "double", "bounds": "array<double>", "buckets": "array<double>", "quantiles": "array<struct<quantile:double,value:double>>"}
    for name, kind in kinds.items():
        if name not in points.columns:
            points = points.withColumn(name, F.lit(None).cast(kind))
    cumulative = F.col("temporality") == 2
    keys = ["series", "_cumulative"]
    own = ranged(points.withColumn("_cumulative", F.coalesce(cumulative, F.lit(False))), keys, ["time_ms"], Scratch(points.sparkSession, "intervals"))
    rows = running(own, keys, ["time_ms"], {"_lag": ("last", F.struct("start_ms", "time_ms", "value", "count", "sum", "buckets"))})
    rows = rows.withColumn("_before", F.when(cumulative & F.col("_lag.start_ms").eqNullSafe(F.col("start_ms")), F.col("_lag")))
    per_second = lambda amount, ms: F.when(ms > 0, amount / (ms / 1000))
    rate = F.when(F.col("value") >= F.col("_before.value"), per_second(F.col("value") - F.col("_before.value"), F.col("time_ms") - F.col("_before.time_ms"))).otherwise(per_second(F.col("value"), F.col("time_ms") - F.col("start_ms")))
    fell = F.coalesce(F.col("_before.count") > F.col("count"), F.lit(False)) | F.coalesce(F.col("_before.sum") > F.col("sum"), F.lit(False))
    rows = rows.withColumn("_since", F.when(~fell, F.col("_before")))
    split = F.coalesce(F.col("kind").isin("histogram", "exponentialHistogram", "summary"), F.lit(False))
    count = F.when(split, F.col("count") - F.coalesce("_since.count", F.lit(0.0)))
    rows = rows.withColumn("interval_count", count)
    total = F.col("sum") - F.coalesce("_since.sum", F.lit(0.0))
    between = F.when(F.size("_since.buckets") == F.size("buckets"), F.zip_with("buckets", "_since.buckets", lambda a, b: a - b)).otherwise(F.col("buckets"))
    some = F.col("interval_count") > 0
    rows = rows.withColumns({"average": F.when(some, total / F.col("interval_count")), "_between": F.when((F.col("kind") == "histogram") & some & (F.size("bounds") > 0), between)})
    rows = rows.withColumns({f"_p{p}": bucket_percentile(F.col("bounds"), F.col("_between"), p / 100, F.col("min"), F.col("max")) for p in (50, 95)})
    coarse = lambda b: b["upper"] - b["lower"] > F.abs(b["value"])
    wide = F.coalesce(coarse(F.col("_p95")), F.lit(False))
    p95 = F.when(wide, F.col("_p95.upper")).otherwise(F.col("_p95.value"))
    of_split = F.when(some, F.coalesce(p95, F.when(F.col("kind") == "summary", quantile(0.95)), F.col("average")))
    plotted = F.when(split, of_split).when((F.col("kind") == "sum") & F.col("monotonic"), rate).otherwise(F.col("value"))
    p50 = F.when(F.col("kind") == "summary", F.when(some, quantile(0.5))).otherwise(F.when(~coarse(F.col("_p50")), F.col("_p50.value")))
    return rows.withColumns({"measure": measure_of(), "plotted": plotted, "p50": p50, "bound": wide}).drop("_lag", "_before", "_since", "_between", "_p50", "_p95", "_cumulative", "_range")


def series(points: DataFrame) -> DataFrame:
    """Every series with points to plot: their number, the newest one's time and value."""
    last = F.max(F.struct("time_ms", "id", "plotted"))
    return points.where("plotted IS NOT NULL").groupBy("series").agg(F.count("*").alias("points"), last.alias("l")).select("series", "points", F.col("l.time_ms").alias("latest_ms"), F.col("l.plotted").alias("latest"))
