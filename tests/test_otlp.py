"""OTLP requests in JSON of every spelling, and the same ones in protobuf."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from lumenlog.sources import otlp, otlp_proto


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def f(number, value, wire=None):
    """A field: bytes and texts with their length, ints as varints, floats and (int, 8) as eight bytes."""
    if isinstance(value, float):
        return varint(number << 3 | 1) + struct.pack("<d", value)
    if isinstance(value, tuple):
        return varint(number << 3 | 1) + value[0].to_bytes(8, "little", signed=value[0] < 0)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def text(value):
    return f(1, value)


def pair(key, value):
    return f(1, key) + f(2, value)


RESOURCE = f(1, f(1, pair("service.name", text("shop"))))
VALUES = {
    "text": (text("é\""), 'é"'),
    "int": (f(3, -5), "-5"),
    "double": (f(4, 0.5), "0.5"),
    "bool": (f(2, 1), "true"),
    "bytes": (f(7, b"\x00\xff"), "AP8="),
    "list": (f(5, f(1, text("a\nb")) + f(1, f(3, 7)) + f(1, b"") + f(1, f(2, 0))), '["a\\nb",7,null,false]'),
    "object": (f(6, f(1, pair("k", f(5, f(1, text("v"))))) + f(1, pair("n", f(4, 2.5))) + f(1, pair("n", f(3, 9)))), '{"k":["v"],"n":9}'),
    "deep": (f(5, f(1, f(5, f(1, f(5, f(1, f(5, f(1, f(5, f(1, f(3, 1)))))))))))  , '[[[["[nested value]"]]]]'),
    "empty": (f(5, b""), "[]"),
}
ATTRIBUTES = b"".join(f(9, pair(k, v)) for k, (v, _) in VALUES.items())
SPAN = f(1, bytes(range(16))) + f(2, bytes(range(1, 9))) + f(4, bytes(8)) + f(5, "first") + f(5, "GET /a") + f(6, 2) + f(7, (1_700_000_000_123_456_789, 8)) + f(8, (1_700_000_001_000_000_000, 8)) + ATTRIBUTES + f(15, f(2, "bad")) + f(15, f(3, 2)) + f(99, "unknown") + varint(98 << 3 | 5) + b"\x01\x02\x03\x04" + f(97, 1.5)
TRACES = f(1, RESOURCE + f(2, f(1, f(1, "lib")) + f(2, SPAN)))
LOGS = f(1, RESOURCE + f(2, f(2, f(2, 17) + f(3, "odd") + f(5, f(6, f(1, pair("a", f(3, 1))))) + f(6, pair("x", text("y"))) + f(9, b"\x01" * 16) + f(10, b"\x02" * 8) + f(11, (1_700_000_000_000_000_000, 8)))))
COUNTER = f(1, "hits") + f(3, "1") + f(7, f(1, f(2, (1_000_000_000, 8)) + f(3, (2_000_000_000, 8)) + f(6, (-4, 8)) + f(7, pair("k", text("v")))) + f(2, 2) + f(3, 1))
HISTOGRAM = f(1, "time") + f(9, f(1, f(3, (2_000_000_000, 8)) + f(4, (6, 8)) + f(5, 12.5) + f(6, b"".join(n.to_bytes(8, "little") for n in (1, 2, 3))) + f(7, 1.0) + f(7, 2.0) + f(11, 0.5) + f(12, 9.0)) + f(2, 1))
SUMMARY = f(1, "sizes") + f(11, f(1, f(3, (3_000_000_000, 8)) + f(4, (2, 8)) + f(5, 3.0) + f(6, f(1, 0.95) + f(2, 2.5))))
METRICS = f(1, RESOURCE + f(2, f(2, COUNTER) + f(2, HISTOGRAM) + f(2, SUMMARY)))


def value_of(data):
    return otlp_proto.read(data, "AnyValue")


JSON_SPAN = {"traceId": bytes(range(16)).hex(), "spanId": bytes(range(1, 9)).hex(), "parentSpanId": "0" * 16, "name": "GET /a", "kind": "SPAN_KIND_SERVER", "startTimeUnixNano": "1700000000123456789", "endTimeUnixNano": "1700000001000000000", "attributes": [{"key": k, "value": value_of(v)} for k, (v, _) in VALUES.items()], "status": {"message": "bad", "code": "STATUS_CODE_ERROR"}}
SHOP = {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}]}
JSON_TRACES = {"resourceSpans": [{"resource": SHOP, "scopeSpans": [{"scope": {"name": "lib"}, "spans": [JSON_SPAN]}]}]}
JSON_LOGS = {"resourceLogs": [{"resource": SHOP, "scopeLogs": [{"logRecords": [{"severityNumber": "SEVERITY_NUMBER_ERROR", "severityText": "odd", "body": {"kvlistValue": {"values": [{"key": "a", "value": {"intValue": "1"}}]}}, "attributes": [{"key": "x", "value": {"stringValue": "y"}}], "traceId": "01" * 16, "spanId": "02" * 8, "observedTimeUnixNano": "1700000000000000000"}]}]}]}
JSON_METRICS = {
    "resourceMetrics": [
        {
            "resource": SHOP,
            "scopeMetrics": [
                {
                    "metrics": [
                        {"name": "hits", "unit": "1", "sum": {"dataPoints": [{"startTimeUnixNano": "1000000000", "timeUnixNano": "2000000000", "asInt": "-4", "attributes": [{"key": "k", "value": {"stringValue": "v"}}]}], "aggregationTemporality": "AGGREGATION_TEMPORALITY_CUMULATIVE", "isMonotonic": True}},
                        {"name": "time", "histogram": {"dataPoints": [{"timeUnixNano": "2000000000", "count": "6", "sum": 12.5, "bucketCounts": ["1", "2", "3"], "explicitBounds": [1.0, 2.0], "min": 0.5, "max": 9.0}], "aggregationTemporality": 1}},
                        {"name": "sizes", "summary": {"dataPoints": [{"timeUnixNano": "3000000000", "count": "2", "sum": 3.0, "quantileValues": [{"quantile": 0.95, "value": 2.5}]}]}},
                    ]
                }
            ],
        }
    ]
}


@pytest.mark.parametrize("kind, data, given, reader", [("Traces", TRACES, JSON_TRACES, otlp.spans), ("Logs", LOGS, JSON_LOGS, otlp.logs), ("Metrics", METRICS, JSON_METRICS, otlp.metric_points)])
def test_protobuf_and_json_give_the_same_rows(spark, kind, data, given, reader):
    binary = otlp_proto.with_json(spark.createDataFrame([(data,), (None,), (b"",)], "body binary"), "body", kind).where("error IS NULL AND json IS NOT NULL")
    found = [r.asDict(recursive=True) for r in reader(binary, "json").collect()]
    want = [r.asDict(recursive=True) for r in reader(spark.createDataFrame([(json.dumps(given),)], "body string"), "body").collect()]
    assert found == want and len(found) == {"Traces": 1, "Logs": 1, "Metrics": 3}[kind]
    if kind == "Traces":
        assert (found[0]["kind"], found[0]["status_code"], found[0]["parent_id"], found[0]["service"], found[0]["name"]) == (2, 2, None, "shop", "GET /a")
        assert found[0]["attributes"] == {k: v for k, (_, v) in VALUES.items()}
    elif kind == "Logs":
        assert (found[0]["level"], found[0]["message"]) == ("error", '{"a":1}')
    else:
        assert [r["temporality"] for r in found] == [2, 1, None] and found[0]["value"] == -4.0 and found[1]["buckets"] == [1.0, 2.0, 3.0]


def test_broken_payloads_are_told(spark):
    deep = b""
    for _ in range(40):
        deep = f(5, f(1, deep))
    broken = {"cut": TRACES[:-3], "tag": b"\x00", "wire": b"\x0b", "long": b"\x0a\xff\xff\xff\xff\xff\xff\xff\xff\xff\x7f", "varint": b"\x80" * 12, "packed": f(1, RESOURCE + f(2, f(2, f(9, f(1, f(6, b"123"))))))}
    for name, data in broken.items():
        (row,) = otlp_proto.with_json(spark.createDataFrame([(data, 1, 2)], "body binary, json int, error int"), "body", "Metrics" if name == "packed" else "Traces").collect()
        assert row.json is None and row.error, name
    with pytest.raises(otlp_proto.Broken):
        otlp_proto.read(deep, "AnyValue")
    assert otlp_proto.read(f(4, float("nan")), "AnyValue") == {"doubleValue": "NaN"}


def test_enumerations_in_every_spelling(spark):
    rows = spark.createDataFrame([("2",), ("SPAN_KIND_SERVER",), ("server",), (None,), ("2.5",)], "v string")
    assert [r[0] for r in rows.select(otlp.enum_of(F.col("v"), otlp.SPAN_KINDS)).collect()] == [2, 2, None, None, None]
    assert otlp.SEVERITIES[17] == "SEVERITY_NUMBER_ERROR" and otlp.SEVERITIES[24] == "SEVERITY_NUMBER_FATAL4"


def test_payloads_are_read_once(spark):
    """A filter on what is wrong, and columns taken from the text, don't read a payload again."""
    payloads = spark.createDataFrame([(bytes(TRACES),), (bytes(TRACES[:-1]),)], "body binary")
    good = otlp_proto.with_json(payloads, "body", "Traces").where("error IS NULL").select("json")
    assert good._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert good.count() == 1
