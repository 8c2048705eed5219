"""Volumes, latencies, patterns, facets and comparisons of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.fields import ALIASES, first_number
from lumenlog.functions.text import first_line, template
from lumenlog.scratch import Scratch

from .ranks import floor_rank, nth_values

BUCKETS, TREND, TOP_PATTERNS, SAMPLES = 30, 10, 20, 5


def is_error() -> Column:
    """Level error or fatal, or a status of 500 or more."""
    return F.lower("level").isin("error", "fatal") | F.coalesce(first_number("statusCode", "status") >= 500, F.lit(False))


def time_range(events: DataFrame) -> DataFrame:
    """One row: ``low`` and ``high`` of ``ts_ms``, less a half percent of outliers at either end if they stretch it.

    If the trimmed range is under half of the whole, ends further from it than a tenth of it (one
    second at least) are cut to the trimmed ends, else to the outermost rows within that margin.
    """
    k = lambda n: F.floor(n * 0.005)
    ends = nth_values(events, [], "ts_ms", {"least": lambda n: F.lit(0), "low": k, "high": lambda n: n - 1 - k(n), "most": lambda n: n - 1})
    margin = F.greatest(F.lit(1000.0), (F.col("high") - F.col("low")) * 0.1)
    trims = (k(F.col("n")) > 0) & (F.col("high") - F.col("low") < (F.col("most") - F.col("least")) / 2)
    bounds = ends.withColumns({"trims": trims, "from": F.col("low") - margin, "to": F.col("high") + margin})
    near = events.select("ts_ms").join(F.broadcast(bounds), (F.col("ts_ms") >= F.col("from")) & (F.col("ts_ms") <= F.col("to")) | ~F.col("trims"))
    return near.agg(F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high"))


def bucket(low: Column, high: Column, buckets: int) -> Column:
    """Which of equal parts of the range ``ts_ms`` is in; -1 outside, and without a time."""
    part = F.least(F.lit(buckets - 1), F.floor((F.col("ts_ms") - low) / F.greatest(F.lit(1.0), (high - low) / buckets)))
    return F.when((F.col("ts_ms") >= low) & (F.col("ts_ms") <= high), part).otherwise(-1).cast("int")


def _ranged(rows: DataFrame, buckets: int) -> DataFrame:
    """The kept rows of :func:`narrow` within the time range, with ``bucket``, and the range's ``low`` and ``high``, which go through the driver."""
    found = time_range(rows).first()
    low, high = (F.lit(v).cast("double") for v in (found["low"], found["high"]))
    return rows.withColumns({"low": low, "high": high, "bucket": bucket(low, high, buckets)}).where("bucket >= 0")


def narrow(events: DataFrame, name: str, **columns: Column) -> DataFrame:
    """The columns that several passes need, read from the events once and kept."""
    return Scratch(events.sparkSession, name).keep(events.select(*[value.alias(c) for c, value in columns.items()]), "rows")


def outlier(value: str) -> Column:
    """Flags a peak against the mean and deviation of the whole series (a short one: one row a bucket)."""
    every = Window.partitionBy(F.lit(1))
    mean, deviation = F.avg(value).over(every), F.stddev_pop(value).over(every)
    return (F.col(value) >= 3) & (F.col(value) > mean + F.greatest(2.5 * deviation, 0.5 * mean, F.lit(1.0)))


def volume(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Events, errors and warnings of every bucket, empty ones included, with flags for peaks."""
    rows = _ranged(narrow(events, "volume", ts_ms=F.col("ts_ms"), error=is_error(), warning=F.lower("level") == "warn"), buckets)
    counted = rows.groupBy("bucket").agg(F.count("*").alias("events"), F.count_if("error").alias("errors"), F.count_if(F.col("warning") & ~F.col("error")).alias("warnings"))
    spark = events.sparkSession
    full = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left").fillna(0)
    return full.withColumns({"peak_events": outlier("events"), "peak_errors": outlier("errors")})


def latency(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Count, mean and 95th percentile of durations in every bucket that has any."""
    rows = _ranged(narrow(events, "latency", ts_ms=F.col("ts_ms"), duration=first_number("durationMs", "duration")), buckets)
    ranked = nth_values(rows, ["bucket"], "duration", {"p95": floor_rank(0.95)})
    return ranked.join(rows.groupBy("bucket").agg(F.avg("duration").alias("average")), "bucket")


def percentiles(events: DataFrame) -> DataFrame:
    rows = narrow(events, "percentiles", duration=first_number("durationMs", "duration"))
    return nth_values(rows, [], "duration", {"p50": floor_rank(0.5), "p95": floor_rank(0.95), "p99": floor_rank(0.99)})


def statuses(events: DataFrame) -> DataFrame:
    found = events.select("id", first_number("statusCode", "status").cast("long").alias("status")).where("status IS NOT NULL")
    return found.groupBy("status").agg(F.count("*").alias("events"), F.min("id").alias("first_id"))


def patterns(rows: DataFrame, text: str, id: str, top: int = TOP_PATTERNS) -> DataFrame:
    """The most frequent templates of first lines: count, first and last id, the first one's text, five sample ids.

    Counting is a partial aggregate; only the top templates' rows are looked at again for samples.
    """
    templated = rows.select(F.col(id).alias("id"), first_line(F.col(text)).alias("line")).withColumn("pattern", template(F.col("line")))
    counted = templated.groupBy("pattern").agg(F.count("*").alias("events"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    best = counted.orderBy(F.desc("events"), "pattern").limit(top)  # a report of the top templates
    mine = templated.join(F.broadcast(best.select("pattern")), "pattern")
    order = Window.partitionBy("pattern").orderBy("id")
    samples = mine.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLES).groupBy("pattern").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("samples"), F.min_by("line", "id").alias("first_line"))
    return best.join(samples, "pattern")


def trend(events: DataFrame, key: Column, buckets: int = TREND) -> DataFrame:
    """Events of each key in each of ten parts of the range, and whether the key is new in the last quarter."""
    rows = _ranged(narrow(events, "trend", ts_ms=F.col("ts_ms"), key=key), buckets)
    first = rows.groupBy("key").agg(F.min("ts_ms").alias("first"), F.max("low").alias("low"), F.max("high").alias("high"))
    new = (F.col("high") - F.col("low") >= 60_000) & (F.col("first") >= F.col("low") + 0.75 * (F.col("high") - F.col("low")))
    return rows.groupBy("key", "bucket").agg(F.count("*").alias("events")).join(first.select("key", new.alias("is_new")), "key")


def field_counts(events: DataFrame) -> DataFrame:
    """Rows and distinct values of every field name of the open map."""
    return events.select(F.explode("fields").alias("name", "value")).groupBy("name").agg(F.count("*").alias("events"), F.countDistinct("value").alias("distinct_values"))


def facets(events: DataFrame, names: list[str], top: int = 5) -> DataFrame:
    """The most frequent values of each field."""
    counted = events.select(F.explode("fields").alias("name", "value")).where(F.col("name").isin(names)).groupBy("name", "value").agg(F.count("*").alias("events"))
    order = Window.partitionBy("name").orderBy(F.desc("events"), "value")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def suggestions(events: DataFrame, name: str, prefix: str, top: int = 20) -> DataFrame:
    """Values of a field that begin with a prefix, most frequent first, then first seen."""
    values = events.select("id", F.element_at("fields", name).alias("value")).where(F.lower("value").startswith(prefix.lower()))
    return values.groupBy("value").agg(F.count("*").alias("events"), F.min("id").alias("first_id")).orderBy(F.desc("events"), "first_id").limit(top)


def compare_sessions(events: DataFrame, baseline: str, latest: str) -> DataFrame:
    """Signatures of errors in a baseline, in the latest run and in earlier ones, with a verdict."""
    errors = events.where(is_error()).withColumn("signature", template(first_line(F.col("message"))))
    side = F.col("session_id")
    counts = errors.groupBy("signature").agg(
        F.count_if(side == baseline).alias("baseline"),
        F.count_if(side == latest).alias("latest"),
        F.count_if((side != baseline) & (side != latest)).alias("earlier"),
    )
    verdict = (
        F.when((F.col("baseline") > 0) & (F.col("latest") > 0), "reproduced")
        .when((F.col("baseline") > 0) & (F.col("earlier") > 0), "fixed")
        .when(F.col("baseline") > 0, "notSeen")
        .when((F.col("latest") > 0) & (F.col("earlier") == 0), "new")
        .otherwise("localOnly")
    )
    return counts.withColumn("verdict", verdict)


#: Fields that are offered first, in this order, and fields that never are.
PREFERRED = ["service", "path", "method", "host", "logger", "environment", "region", "version", "container", "pod"]
SKIPPED = ["level", "message", "timestamp", "status", "durationms", "traceid", "spanid", "parentspanid", "requestid"]


def facet_fields(events: DataFrame, top: int = 4) -> DataFrame:
    """Fields worth breaking events down by: ``name, events, distinct_values, place``, counted over all events.

    A field is offered if a fifth of the events has it, with two values or more, none over 80
    characters, and at most 50 or a fifth of its events. Of names of one meaning the best placed
    one stays, and a dotted name only if its last part is no field. Ties are placed by name.
    """
    every = events.agg(F.count("*").alias("_all"))
    counted = events.select(F.explode("fields").alias("name", "value")).groupBy("name").agg(F.count("*").alias("events"), F.countDistinct("value").alias("distinct_values"), F.max(F.length("value")).alias("_longest"))
    meant = F.create_map(*[F.lit(x) for pair in {n.lower(): group[0].lower() for group in ALIASES for n in group}.items() for x in pair])
    same = F.coalesce(F.element_at(meant, F.lower("name")), F.lower("name"))
    ranks = F.create_map(*[F.lit(x) for place, n in enumerate(PREFERRED) for x in (n, place)])
    rows = counted.withColumns({"_same": same, "_rank": F.coalesce(F.element_at(ranks, same), F.lit(len(PREFERRED)))}).join(F.broadcast(every))
    ids = (F.col("distinct_values") > 50) & (5 * F.col("distinct_values") > F.col("events"))
    fit = ~F.col("_same").isin(*SKIPPED) & ~F.col("_same").endswith(".time") & (F.coalesce("_longest", F.lit(0)) <= 80) & (5 * F.col("events") >= F.col("_all")) & (F.col("distinct_values") >= 2) & ~ids
    names = counted.select(F.col("name").alias("_last"))
    kept = rows.where(fit).join(names, F.col("name").contains(".") & (F.substring_index("name", ".", -1) == F.col("_last")), "left_anti")
    order = ["_rank", F.desc("events"), "name"]
    first = kept.withColumn("_n", F.row_number().over(Window.partitionBy("_same").orderBy(*order))).where("_n = 1").orderBy(*order).limit(top)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).select("name", "events", "distinct_values", "place")
