"""Tails of event streams: late rows, repeats, rolling counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

# Runs that must have been seen before a shorter lag is used, runs that count, the least lag, and every how many runs the whole lag is.
FEWEST_RUNS, COUNTED_RUNS, LEAST_LAG_MS, WHOLE_EVERY = 5, 20, 15_000, 10


def distinct_lines(stream: DataFrame, time: str = "ts", line: str = "line", lag: str = "60 seconds") -> DataFrame:
    """Rows of a tail whose reads overlap: a line repeated within the lag counts once, state ends with the watermark."""
    return stream.withWatermark(time, lag).dropDuplicatesWithinWatermark([line])


def rolling_volume(stream: DataFrame, time: str = "ts", width: str = "1 minute", lag: str = "60 seconds") -> DataFrame:
    """Events and errors of every window, final when the watermark has passed it."""
    counted = stream.withWatermark(time, lag).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("level").isin("error", "fatal")).alias("errors"))
    return counted.select(F.col("w.start").alias("start"), "events", "errors")


#: Whether a query runs batches without data, for time that has passed; read when it starts.
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append", idle: bool = True) -> StreamingQuery:
    """Handles what is there, batch by batch, restarting from the checkpoint, and ends.

    Without ``idle`` only batches with data run: needed where state waits for processing time, for which
    Spark runs empty batches without end.
    """
    spark = stream.sparkSession
    own = spark.conf.get(IDLE_BATCHES)
    spark.conf.set(IDLE_BATCHES, str(idle).lower())
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
    finally:
        spark.conf.set(IDLE_BATCHES, own)
    query.awaitTermination()
    return query


def note_lateness(batch: DataFrame, path: str, time: str = "ts", seen: str = "seen") -> None:
    """Appends how late, in milliseconds, the latest row of a run was, to the table at ``path``; a run without rows tells nothing.

    ``time`` is when a row happened and ``seen`` when it was first read, both timestamps; rows without either don't count.
    """
    late = batch.agg(F.max(F.unix_millis(seen) - F.unix_millis(time)).alias("late_ms"), F.max(seen).alias("at")).where("late_ms IS NOT NULL")
    late.write.mode("append").parquet(path)


def next_lag_ms(spark: SparkSession, path: str, most_ms: int) -> int:
    """How far back the next run has to read, judged from the runs that :func:`note_lateness` has told of.

    All of ``most_ms`` until some runs are known, and again every few runs, for rows later than the
    shorter lag are only seen then; else twice the greatest lateness of the last runs, within bounds.
    """
    try:
        runs = spark.read.parquet(path).where("late_ms IS NOT NULL")
    except AnalysisException:  # nothing has been told yet
        return most_ms
    n = runs.count()
    if n < FEWEST_RUNS or n % WHOLE_EVERY == WHOLE_EVERY - 1:
        return most_ms
    late = max(r.late_ms for r in runs.orderBy(F.desc("at")).limit(COUNTED_RUNS).collect())  # one number a run
    return min(most_ms, max(LEAST_LAG_MS, 2 * late))
