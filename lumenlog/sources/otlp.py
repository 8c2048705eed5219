"""OTLP JSON payloads into spans, logs and metric points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:boolean,bytesValue:string,arrayValue:string,kvlistValue:string>"
ATTRIBUTES = f"array<struct<key:string,value:{VALUE}>>"
SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string,message:string>,attributes:{ATTRIBUTES}>"
TRACES = f"resourceSpans array<struct<resource:struct<attributes:{ATTRIBUTES}>,scopeSpans:array<struct<scope:struct<name:string>,spans:array<{SPAN}>>>>>"
LOG = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:string,severityText:string,body:{VALUE},traceId:string,spanId:string,attributes:{ATTRIBUTES}>"
LOGS = f"resourceLogs array<struct<resource:struct<attributes:{ATTRIBUTES}>,scopeLogs:array<struct<scope:struct<name:string>,logRecords:array<{LOG}>>>>>"
#: Levels of lists and objects within a value; deeper ones are told by ``NESTED``.
DEPTH, NESTED = 4, "[nested value]"
# Names of enumerations in JSON, by number from 0.
SPAN_KINDS = ["SPAN_KIND_UNSPECIFIED", "SPAN_KIND_INTERNAL", "SPAN_KIND_SERVER", "SPAN_KIND_CLIENT", "SPAN_KIND_PRODUCER", "SPAN_KIND_CONSUMER"]
STATUS_CODES = ["STATUS_CODE_UNSET", "STATUS_CODE_OK", "STATUS_CODE_ERROR"]
TEMPORALITIES = ["AGGREGATION_TEMPORALITY_UNSPECIFIED", "AGGREGATION_TEMPORALITY_DELTA", "AGGREGATION_TEMPORALITY_CUMULATIVE"]
LEVELS = ["trace", "debug", "info", "warn", "error", "fatal"]
SEVERITIES = ["SEVERITY_NUMBER_UNSPECIFIED", *[f"SEVERITY_NUMBER_{level.upper()}{n or ''}" for level in LEVELS for n in ("", 2, 3, 4)]]


def enum_of(value: Column, names: list[str]) -> Column:
    """The number of an enumeration's value, told as number, numeric text or name; null for others."""
    place = F.array_position(F.array(*map(F.lit, names)), value)
    return F.coalesce(value.try_cast("int"), F.when(place > 0, (place - 1).cast("int")))


def _scalar(value: Column) -> Column:
    return F.coalesce(value["stringValue"], value["intValue"], value["doubleValue"].try_cast("double").cast("string"), value["boolValue"].cast("string"), value["bytesValue"])


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def _nested(value: Column, depth: int) -> Column:
    """The JSON text of a list or an object; null for other values."""
    if not depth:
        return F.when(value["arrayValue"].isNotNull() | value["kvlistValue"].isNotNull(), F.lit(NESTED))

    def inside(v: Column) -> Column:
        deeper = _nested(v, depth - 1)
        text = F.coalesce(v["stringValue"], v["bytesValue"])
        plain = F.coalesce(_quoted(text), _scalar(v))
        return F.coalesce(plain, _quoted(deeper) if depth == 1 else deeper, F.lit("null"))

    listed = value["arrayValue"].isNotNull()
    items = F.transform(F.from_json(value["arrayValue"], f"values array<{VALUE}>")["values"], lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value"))).cast(ATTRIBUTES)
    entries = F.coalesce(F.when(listed, items).otherwise(F.reverse(_last_of_each(F.from_json(value["kvlistValue"], f"values {ATTRIBUTES}")["values"])).cast(ATTRIBUTES)), F.array().cast(ATTRIBUTES))
    each = F.transform(entries, lambda e: F.concat(F.coalesce(F.concat(_quoted(e["key"]), F.lit(":")), F.lit("")), inside(e["value"])))  # one expression a level
    text = F.concat(F.when(listed, "[").otherwise("{"), F.array_join(each, ","), F.when(listed, "]").otherwise("}"))
    return F.when(listed | value["kvlistValue"].isNotNull(), text)


def text_of(value: Column) -> Column:
    """A value as text: lists and objects as JSON without spaces, down to ``DEPTH`` levels."""
    return F.coalesce(_scalar(value), _nested(value, DEPTH))


def _last_of_each(attributes: Column) -> Column:
    listed = F.reverse(F.coalesce(attributes, F.array().cast(ATTRIBUTES)))
    keys = F.transform(listed, lambda a: a["key"])
    return F.filter(listed, lambda a, i: a["key"].isNotNull() & (F.array_position(keys, a["key"]) == i + 1))


def attribute_map(attributes: Column) -> Column:
    """Attributes as a map; the last of equal keys wins."""
    return F.map_from_entries(F.transform(_last_of_each(attributes), lambda a: F.struct(a["key"], text_of(a["value"]))))


def millis(nanos: Column) -> Column:
    """Milliseconds, with microseconds kept, of nanoseconds as text; zero and text that is no number are null."""
    number = nanos.try_cast("decimal(20,0)")
    return F.when(number > 0, (F.floor(number / 1000) / 1000).cast("double"))


def hex_id(id: Column) -> Column:
    """Lower-case hexadecimal id, also from base64; ids of zeros are null."""
    plain = F.when(id.rlike("^(?:[0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})$"), F.lower(id)).otherwise(F.lower(F.hex(F.try_to_binary(id, F.lit("base64")))))
    return F.when(~plain.rlike("^0*$"), plain)


def spans(payloads: DataFrame, json: str) -> DataFrame:
    """One row a span of export requests in a column of JSON text."""
    read = payloads.select(F.explode(F.from_json(json, TRACES)["resourceSpans"]).alias("r"))
    scoped = read.select(F.element_at(attribute_map(F.col("r.resource.attributes")), "service.name").alias("service"), F.explode("r.scopeSpans").alias("s"))
    one = scoped.select("service", F.col("s.scope.name").alias("scope"), F.explode("s.spans").alias("x"))
    return one.select(
        hex_id(F.col("x.traceId")).alias("trace_id"),
        hex_id(F.col("x.spanId")).alias("span_id"),
        hex_id(F.col("x.parentSpanId")).alias("parent_id"),
        F.col("x.name").alias("name"),
        F.coalesce(enum_of(F.col("x.kind"), SPAN_KINDS), F.lit(0)).alias("kind"),
        millis(F.col("x.startTimeUnixNano")).alias("start_ms"),
        millis(F.col("x.endTimeUnixNano")).alias("end_ms"),
        "service",
        "scope",
        F.coalesce(enum_of(F.col("x.status.code"), STATUS_CODES), F.lit(0)).alias("status_code"),
        attribute_map(F.col("x.attributes")).alias("attributes"),
    )


def logs(payloads: DataFrame, json: str) -> DataFrame:
    """One row a log record; a severity number decides over its text."""
    read = payloads.select(F.explode(F.from_json(json, LOGS)["resourceLogs"]).alias("r"))
    scoped = read.select(F.element_at(attribute_map(F.col("r.resource.attributes")), "service.name").alias("service"), F.explode("r.scopeLogs").alias("s"))
    one = scoped.select("service", F.explode("s.logRecords").alias("x"))
    names = F.array(*map(F.lit, LEVELS))
    severity = enum_of(F.col("x.severityNumber"), SEVERITIES)
    by_number = F.when(severity.between(1, 24), F.get(names, F.floor((severity - 1) / 4).cast("int")))
    return one.select(
        F.coalesce(millis(F.col("x.timeUnixNano")), millis(F.col("x.observedTimeUnixNano"))).alias("ts_ms"),
        F.coalesce(by_number, F.lower("x.severityText"), F.lit("info")).alias("level"),
        text_of(F.col("x.body")).alias("message"),
        "service",
        hex_id(F.col("x.traceId")).alias("trace_id"),
        hex_id(F.col("x.spanId")).alias("span_id"),
        attribute_map(F.col("x.attributes")).alias("fields"),
    )


POINT = f"struct<startTimeUnixNano:string,timeUnixNano:string,asDouble:double,asInt:string,count:string,sum:double,min:double,max:double,bucketCounts:array<string>,explicitBounds:array<double>,quantileValues:array<struct<quantile:double,value:double>>,attributes:{ATTRIBUTES}>"
METRIC = f"struct<name:string,unit:string,gauge:struct<dataPoints:array<{POINT}>>,sum:struct<isMonotonic:boolean,aggregationTemporality:string,dataPoints:array<{POINT}>>,histogram:struct<aggregationTemporality:string,dataPoints:array<{POINT}>>,exponentialHistogram:struct<aggregationTemporality:string,dataPoints:array<{POINT}>>,summary:struct<dataPoints:array<{POINT}>>>"
METRICS = f"resourceMetrics array<struct<resource:struct<attributes:{ATTRIBUTES}>,scopeMetrics:array<struct<metrics:array<{METRIC}>>>>>"


def metric_points(payloads: DataFrame, json: str) -> DataFrame:
    """One row a data point of gauges, sums, histograms of both kinds and summaries; ``series`` names service, metric and sorted attributes."""
    read = payloads.select(F.explode(F.from_json(json, METRICS)["resourceMetrics"]).alias("r"))
    scoped = read.select(F.element_at(attribute_map(F.col("r.resource.attributes")), "service.name").alias("service"), F.explode("r.scopeMetrics").alias("s"))
    one = scoped.select("service", F.explode("s.metrics").alias("m"))
    kind = F.when(F.col("m.histogram").isNotNull(), "histogram").when(F.col("m.exponentialHistogram").isNotNull(), "exponentialHistogram").when(F.col("m.summary").isNotNull(), "summary").when(F.col("m.sum").isNotNull(), "sum").otherwise("gauge")
    point = F.explode(F.coalesce("m.histogram.dataPoints", "m.exponentialHistogram.dataPoints", "m.summary.dataPoints", "m.sum.dataPoints", "m.gauge.dataPoints")).alias("p")
    rows = one.select("service", F.col("m.name").alias("name"), F.col("m.unit").alias("unit"), kind.alias("kind"), F.coalesce("m.sum.isMonotonic", F.lit(False)).alias("monotonic"), enum_of(F.coalesce("m.sum.aggregationTemporality", "m.histogram.aggregationTemporality", "m.exponentialHistogram.aggregationTemporality"), TEMPORALITIES).alias("temporality"), point)
    attributes = attribute_map(F.col("p.attributes"))
    return rows.select(
        "service",
        "name",
        "unit",
        "kind",
        "monotonic",
        "temporality",
        attributes.alias("attributes"),
        F.to_json(F.struct("service", "name", F.array_sort(F.map_entries(attributes)).alias("attributes"))).alias("series"),
        millis(F.col("p.startTimeUnixNano")).alias("start_ms"),
        millis(F.col("p.timeUnixNano")).alias("time_ms"),
        F.coalesce("p.asDouble", F.col("p.asInt").try_cast("double")).alias("value"),
        F.col("p.count").try_cast("double").alias("count"),
        F.col("p.sum").alias("sum"),
        F.col("p.min").alias("min"),
        F.col("p.max").alias("max"),
        F.col("p.quantileValues").alias("quantiles"),
        F.col("p.explicitBounds").alias("bounds"),
        F.transform("p.bucketCounts", lambda c: c.try_cast("double")).alias("buckets"),
    )
