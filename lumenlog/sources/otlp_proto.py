"""OTLP export requests in protobuf, read into the JSON text that :mod:`lumenlog.sources.otlp` takes.

The reader is a walk over the wire format by tables of field numbers, in Arrow batches; payloads of a
table are spread over tasks as its rows are. Fields that the tables don't name are skipped, repeated
numbers may be packed or not, of a scalar that comes twice the last counts, and messages that come twice
are merged. A payload that breaks off, or nests deeper than ``MOST_DEPTH`` messages, gives no text but what is wrong.
"""

from __future__ import annotations

import base64
import json
import math
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_DEPTH = 32

# Field numbers of the public message definitions, with names and kinds. A kind is one of the
# scalars below or the name of a message; [] marks repeated fields.
MESSAGES: dict[str, dict[int, tuple[str, str]]] = {
    "Traces": {1: ("resourceSpans", "ResourceSpans[]")},
    "ResourceSpans": {1: ("resource", "Resource"), 2: ("scopeSpans", "ScopeSpans[]"), 3: ("schemaUrl", "string")},
    "ScopeSpans": {1: ("scope", "Scope"), 2: ("spans", "Span[]"), 3: ("schemaUrl", "string")},
    "Span": {1: ("traceId", "hex"), 2: ("spanId", "hex"), 3: ("traceState", "string"), 4: ("parentSpanId", "hex"), 5: ("name", "string"), 6: ("kind", "enum"), 7: ("startTimeUnixNano", "fixed64"), 8: ("endTimeUnixNano", "fixed64"), 9: ("attributes", "KeyValue[]"), 11: ("events", "Event[]"), 13: ("links", "Link[]"), 15: ("status", "Status")},
    "Event": {1: ("timeUnixNano", "fixed64"), 2: ("name", "string"), 3: ("attributes", "KeyValue[]")},
    "Link": {1: ("traceId", "hex"), 2: ("spanId", "hex"), 3: ("traceState", "string"), 4: ("attributes", "KeyValue[]")},
    "Status": {2: ("message", "string"), 3: ("code", "enum")},
    "Logs": {1: ("resourceLogs", "ResourceLogs[]")},
    "ResourceLogs": {1: ("resource", "Resource"), 2: ("scopeLogs", "ScopeLogs[]"), 3: ("schemaUrl", "string")},
    "ScopeLogs": {1: ("scope", "Scope"), 2: ("logRecords", "LogRecord[]"), 3: ("schemaUrl", "string")},
    "LogRecord": {1: ("timeUnixNano", "fixed64"), 2: ("severityNumber", "enum"), 3: ("severityText", "string"), 5: ("body", "AnyValue"), 6: ("attributes", "KeyValue[]"), 9: ("traceId", "hex"), 10: ("spanId", "hex"), 11: ("observedTimeUnixNano", "fixed64"), 12: ("eventName", "string")},
    "Metrics": {1: ("resourceMetrics", "ResourceMetrics[]")},
    "ResourceMetrics": {1: ("resource", "Resource"), 2: ("scopeMetrics", "ScopeMetrics[]"), 3: ("schemaUrl", "string")},
    "ScopeMetrics": {1: ("scope", "Scope"), 2: ("metrics", "Metric[]"), 3: ("schemaUrl", "string")},
    "Metric": {1: ("name", "string"), 2: ("description", "string"), 3: ("unit", "string"), 5: ("gauge", "Gauge"), 7: ("sum", "Sum"), 9: ("histogram", "Histogram"), 10: ("exponentialHistogram", "ExponentialHistogram"), 11: ("summary", "Summary")},
    "Gauge": {1: ("dataPoints", "Number[]")},
    "Sum": {1: ("dataPoints", "Number[]"), 2: ("aggregationTemporality", "enum"), 3: ("isMonotonic", "bool")},
    "Histogram": {1: ("dataPoints", "HistogramPoint[]"), 2: ("aggregationTemporality", "enum")},
    "ExponentialHistogram": {1: ("dataPoints", "ExponentialPoint[]"), 2: ("aggregationTemporality", "enum")},
    "Summary": {1: ("dataPoints", "SummaryPoint[]")},
    "Number": {2: ("startTimeUnixNano", "fixed64"), 3: ("timeUnixNano", "fixed64"), 4: ("asDouble", "double"), 6: ("asInt", "sfixed64"), 7: ("attributes", "KeyValue[]"), 8: ("flags", "enum")},
    "HistogramPoint": {2: ("startTimeUnixNano", "fixed64"), 3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 6: ("bucketCounts", "fixed64[]"), 7: ("explicitBounds", "double[]"), 9: ("attributes", "KeyValue[]"), 10: ("flags", "enum"), 11: ("min", "double"), 12: ("max", "double")},
    "ExponentialPoint": {1: ("attributes", "KeyValue[]"), 2: ("startTimeUnixNano", "fixed64"), 3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 7: ("zeroCount", "fixed64"), 10: ("flags", "enum"), 12: ("min", "double"), 13: ("max", "double"), 14: ("zeroThreshold", "double")},
    "SummaryPoint": {2: ("startTimeUnixNano", "fixed64"), 3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 6: ("quantileValues", "Quantile[]"), 7: ("attributes", "KeyValue[]"), 8: ("flags", "enum")},
    "Quantile": {1: ("quantile", "double"), 2: ("value", "double")},
    "Resource": {1: ("attributes", "KeyValue[]")},
    "Scope": {1: ("name", "string"), 2: ("version", "string"), 3: ("attributes", "KeyValue[]")},
    "KeyValue": {1: ("key", "string"), 2: ("value", "AnyValue")},
    "AnyValue": {1: ("stringValue", "string"), 2: ("boolValue", "bool"), 3: ("intValue", "int64"), 4: ("doubleValue", "double"), 5: ("arrayValue", "Array"), 6: ("kvlistValue", "KeyValues"), 7: ("bytesValue", "bytes")},
    "Array": {1: ("values", "AnyValue[]")},
    "KeyValues": {1: ("values", "KeyValue[]")},
}
#: Wire types of the scalars.
WIRE = {"enum": 0, "bool": 0, "int64": 0, "fixed64": 1, "sfixed64": 1, "double": 1, "string": 2, "hex": 2, "bytes": 2}
VARINT, EIGHT, LENGTH, FOUR = 0, 1, 2, 5


class Broken(ValueError):
    """A payload that is no message of its kind."""


def _varint(data: bytes, at: int, end: int) -> tuple[int, int]:
    value = shift = 0
    while at < end and shift < 70:
        byte = data[at]
        value |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return value & (1 << 64) - 1, at
        shift += 7
    raise Broken("a number breaks off")


def _raw(data: bytes, at: int, end: int, wire: int) -> tuple[object, int]:
    """What a field holds on the wire: a number, eight or four bytes, or the ends of its bytes."""
    if wire == VARINT:
        return _varint(data, at, end)
    size = {EIGHT: 8, FOUR: 4}.get(wire)
    if wire == LENGTH:
        size, at = _varint(data, at, end)
    if size is None:
        raise Broken(f"wire type {wire}")
    if at + size > end:
        raise Broken("a field breaks off")
    return (at, at + size), at + size


def _double(value: float) -> object:
    return value if math.isfinite(value) else "NaN" if value != value else "Infinity" if value > 0 else "-Infinity"


def _scalar(kind: str, raw, data: bytes):
    if kind == "enum":
        return raw & (1 << 32) - 1
    if kind == "bool":
        return bool(raw)
    if kind == "int64":
        return str(raw - (1 << 64) if raw >> 63 else raw)
    own = data[raw[0] : raw[1]]
    if kind == "fixed64" or kind == "sfixed64":
        return str(int.from_bytes(own, "little", signed=kind == "sfixed64"))
    if kind == "double":
        return _double(struct.unpack("<d", own)[0])
    return own.decode("utf-8", "replace") if kind == "string" else own.hex() if kind == "hex" else base64.b64encode(own).decode()


def _tags(fields: dict[int, tuple[str, str]]) -> dict[int, tuple[str, str, bool, bool, bool]]:
    """Names of fields by tag, the kind of one value, and whether it is a message, one of several, or numbers packed together."""
    found = {}
    for number, (name, kind) in fields.items():
        one, many = kind.removesuffix("[]"), kind.endswith("[]")
        if one in MESSAGES:
            found[number << 3 | LENGTH] = (name, one, True, many, False)
            continue
        found[number << 3 | WIRE[one]] = (name, one, False, many, False)
        if many and WIRE[one] == EIGHT:
            found[number << 3 | LENGTH] = (name, one, False, True, True)
    return found


TAGS = {message: _tags(fields) for message, fields in MESSAGES.items()}


def read(data: bytes, message: str, at: int = 0, end: int | None = None, depth: int = 0, into: dict | None = None) -> dict:
    """One message as the object that JSON would hold."""
    if depth > MOST_DEPTH:
        raise Broken(f"more than {MOST_DEPTH} messages within each other")
    out, end, tags = {} if into is None else into, len(data) if end is None else end, TAGS[message]
    while at < end:
        tag = data[at]
        if tag < 128:
            at += 1
        else:
            tag, at = _varint(data, at, end)
            tag &= (1 << 32) - 1
        if tag < 8:
            raise Broken("field number 0")
        if tag & 7 == LENGTH and at < end and data[at] < 128:  # the usual case of _raw
            begin, at = at + 1, at + 1 + data[at]
            if at > end:
                raise Broken("a field breaks off")
            raw = (begin, at)
        else:
            raw, at = _raw(data, at, end, tag & 7)
        known = tags.get(tag)
        if known is None:
            continue
        name, kind, within, many, packed = known
        if within:
            if many:
                out.setdefault(name, []).append(read(data, kind, *raw, depth + 1))
            else:
                out[name] = read(data, kind, *raw, depth + 1, out.get(name))
        elif packed:
            if (raw[1] - raw[0]) % 8:
                raise Broken("a list of numbers breaks off")
            out.setdefault(name, []).extend(_scalar(kind, (p, p + 8), data) for p in range(raw[0], raw[1], 8))
        else:
            value = data[raw[0] : raw[1]].decode("utf-8", "replace") if kind == "string" else _scalar(kind, raw, data)
            if many:
                out.setdefault(name, []).append(value)
            else:
                out[name] = value
    return out


def _texts(message: str):
    def read_all(payloads: pd.Series) -> pd.DataFrame:
        rows, encode = [], json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
        for payload in payloads:
            try:
                rows.append((None, None) if payload is None else (encode(read(bytes(payload), message)), None))
            except Broken as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["json", "error"], dtype=object)

    # Declared as such, or a filter on one of its columns would be pushed below it with a second reading of every payload.
    return F.pandas_udf(read_all, "json string, error string").asNondeterministic()


def with_json(payloads: DataFrame, body: str | Column, kind: str) -> DataFrame:
    """``payloads`` with ``json`` and ``error``; ``kind`` is Traces, Logs or Metrics.

    A payload that can't be read has a null ``json`` and what is wrong in ``error``; null payloads have
    neither, empty ones are requests without anything. Columns of these names are replaced.
    """
    own = F.col(body) if isinstance(body, str) else body
    read = payloads.withColumn("_read", _texts(kind)(own))
    return read.drop("json", "error").select("*", "_read.json", "_read.error").drop("_read")
