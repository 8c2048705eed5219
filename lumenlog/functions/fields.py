"""Fields of events: alias groups, lookups, and the number and text rules of semi-structured values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that mean the same field, in the order in which they are tried.
ALIASES = [
    ["level", "severity", "log.level", "severityText", "SeverityText"],
    ["message", "msg", "body", "Body"],
    ["status", "statusCode", "status_code", "res.statusCode", "http.response.status_code", "attributes.http.response.status_code"],
    ["service", "service_name", "serviceName", "service.name", "resource.service.name", "resource.attributes.service.name"],
    ["logger", "logger_name", "log.logger"],
    ["method", "req.method", "http.request.method", "attributes.http.request.method", "http.method", "requestMethod"],
    ["path", "req.url", "url.path", "url", "url.full", "http.route", "http.target", "http.url", "requestUrl", "requestUri", "uri"],
    ["host", "hostname", "host.name"],
    ["environment", "service.environment", "deployment.environment.name"],
    ["requestId", "request_id", "req.id", "http.request.id"],
    ["traceId", "trace_id", "trace.id", "TraceId"],
    ["spanId", "span_id", "span.id", "SpanId"],
    ["parentSpanId", "parent_span_id", "parentId"],
    ["durationMs", "duration", "duration_ms", "responseTime"],
]
#: Columns of an event that can be asked for by name.
ENVELOPE = {
    "id": "id",
    "timestampMs": "ts_ms",
    "level": "level",
    "message": "message",
    "serverId": "server_id",
    "server": "server",
    "sessionId": "session_id",
}
NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)\s*$"


def once(value: Column, of) -> Column:
    """``of(value)`` with ``value`` computed once a row, also within lambdas, where common expressions are not shared."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def group_of(name: str) -> list[str]:
    """The names that mean the same as ``name``, itself included."""
    return next((g for g in ALIASES if name.lower() in {n.lower() for n in g}), [name])


def canonical(name: str) -> str:
    return group_of(name)[0]


def field(name: str) -> Column:
    """A field's text: the exact name, then its aliases, then the value of a ``name:value`` tag; null if missing."""
    names = list(dict.fromkeys([name, *group_of(name)]))
    found = [F.col(ENVELOPE[n]).cast("string") if n in ENVELOPE else F.element_at(F.col("fields"), n) for n in names]
    tags = F.filter(F.split(F.element_at(F.col("fields"), "tags"), r",\s*"), lambda t: t.startswith(f"{name}:"))
    tag = F.when(F.size(tags) > 0, F.array_join(F.transform(tags, lambda t: F.substring(t, len(name) + 2, 1 << 20)), ","))
    return F.coalesce(*found, tag)


def number(text: Column) -> Column:
    """The text as a double if it is a plain decimal number; else null."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def first_number(*names: str) -> Column:
    """The first of the fields that holds a number."""
    return F.coalesce(*[number(field(n)) for n in names])


def number_text(value: Column) -> Column:
    """A double without needless decimals: 200 rather than 200.0."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def level_of(level: Column, fallback: str = "info") -> Column:
    """The level's usual name; numeric codes 10 to 60 included."""
    low = F.lower(F.trim(level))
    codes = F.create_map(*[F.lit(x) for pair in {"10": "trace", "20": "debug", "30": "info", "40": "warn", "50": "error", "60": "fatal"}.items() for x in pair])
    return F.when(low.isin("trace", "debug", "info", "warn", "error", "fatal"), low).when(low == "warning", "warn").when(low == "critical", "fatal").otherwise(F.coalesce(F.element_at(codes, low), F.lit(fallback)))


def time_ms(value: Column, unit: str = "auto") -> Column:
    """Milliseconds since 1970 of a stored time: a number in ``unit`` (``s``, ``ms``, or by its size), or text of a date and time.

    Numbers below 1e11 count seconds under ``auto``. Text without a zone is UTC. Text in other forms
    than ISO 8601 and null are null.
    """
    text = F.trim(value.cast("string"))
    plain = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast("double"))
    scaled = {"s": plain * 1000, "ms": plain}.get(unit, F.when(F.abs(plain) < 1e11, plain * 1000).otherwise(plain))
    dated = F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d$"), F.concat(text, F.lit(":00Z"))).when(text.rlike(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(\.\d+)?$"), F.concat(text, F.lit("Z"))).when(text.rlike(r"^\d{4}-\d\d-\d\d[ T]"), text)
    return F.when(plain.isNotNull(), scaled).otherwise(F.unix_micros(dated.try_cast("timestamp")) / 1000.0)
