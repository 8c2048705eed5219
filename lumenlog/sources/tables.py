"""Plain tables as events, spans, metric points and model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def millis(column: str):
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))") / 1000.0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as log events: envelope columns and an open map of fields."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    status = F.when(kind == "error", 500 + F.col("event_id") % 4).otherwise(200)
    fields = {"user_id": F.col("user_id"), "event_type": kind, "durationMs": F.col("value"), "k": k, "statusCode": status}
    pairs = [x for name, value in fields.items() for x in (F.lit(name), value.cast("string"))]
    message = F.concat(kind, F.lit(" by user "), F.col("user_id").cast("string"), F.lit(" took "), F.floor(F.col("value") + 0.5).cast("string"), F.lit("ms k="), F.coalesce(k, F.lit("")))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        millis("ts").alias("ts_ms"),
        F.when(kind == "error", "error").when(kind == "signup", "warn").otherwise("info").alias("level"),
        message.alias("message"),
        F.col("props").alias("raw"),
        F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("server_id"),
        F.concat(F.lit("Service "), (F.col("user_id") % 5).cast("string")).alias("server"),
        F.substring(F.col("ts").cast("string"), 1, 10).alias("session_id"),
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("fields"),
        F.col("value").alias("duration_ms"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as traces: the order is the root span, its lines are children from shipping to receipt."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    day = lambda c: F.expr(f"datediff(CAST({c} AS DATE), DATE '1970-01-01')").cast("double")
    children = lines.select(
        F.col("l_orderkey").alias("trace_id"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("span_id"),
        F.col("l_orderkey").cast("string").alias("parent_id"),
        F.col("l_shipmode").alias("name") if "l_shipmode" in lines.columns else F.col("l_linestatus").alias("name"),
        F.lit("warehouse").alias("service"),
        day("l_shipdate").alias("start_ms"),
        (day("l_shipdate") + F.col("l_quantity")).cast("double").alias("end_ms"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("status_code"),
    )
    ends = children.groupBy("trace_id").agg(F.max("end_ms").alias("last"))
    roots = orders.join(ends, orders["o_orderkey"] == ends["trace_id"], "left").select(
        F.col("o_orderkey").alias("trace_id"),
        F.col("o_orderkey").cast("string").alias("span_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.col("o_orderpriority").alias("name"),
        F.lit("orders").alias("service"),
        day("o_orderdate").alias("start_ms"),
        F.greatest(day("o_orderdate"), F.coalesce("last", day("o_orderdate"))).alias("end_ms"),
        F.lit(0).alias("status_code"),
    )
    return roots.unionByName(children)


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user a gauge and a running sum of ``value`` over time: metric points."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = read(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("series"), F.col("event_id").alias("id"), millis("ts").alias("time_ms"), F.col("value"), F.count("*").over(order).cast("double").alias("total"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as model calls: tokens are a quarter of the characters."""
    rows = read(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("conversation"), F.col("turn"), F.col("role"), F.floor(F.length(F.coalesce(F.col("text"), F.lit(""))) / 4).cast("long").alias("tokens"), F.col("text"))
