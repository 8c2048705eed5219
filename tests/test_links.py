"""Model calls, links, stored times, metric intervals and health rules on nulls, ties, empty tables and odd values."""

from pyspark.sql import functions as F

from lumenlog.functions import fields
from lumenlog.operators import errors, links, metrics, model_calls, sites

SPAN = f"trace_id string, span_id string, name string, service string, start_ms double, end_ms double, status_code int, attributes map<string,string>, events {model_calls.EVENTS}"
EVENT = "id long, ts_ms double, level string, message string, server_id string, server string, session_id string, fields map<string,string>"
POINT = "series string, id long, kind string, monotonic boolean, temporality int, start_ms double, time_ms double, value double, count double, sum double"


def span(id, attributes, events=None, name="x"):
    return ("t", id, name, "s", 0.0, 1.0, None, attributes, events)


def parts_of(spark, *spans):
    return [(r.span_id, r.message, r.role, r.kind, r.name, r.text) for r in model_calls.message_parts(spark.createDataFrame(list(spans), SPAN)).orderBy("span_id", "message", "part").collect()]


def test_calls_of_spans_without_attributes_and_with_odd_values(spark):
    rows = [span("a", None), span("b", {}), span("c", {"gen_ai.usage.input_tokens": "1e999x", "gen_ai.usage.output_tokens": " 7 ", "gen_ai.response.finish_reasons": "[]"}, name=None), span("d", {"gen_ai.operation.name": "", "gen_ai.x": "1", "gen_ai.response.finish_reasons": "stop"}, name="Chat.completion")]
    found = {r.span_id: r for r in model_calls.model_calls(spark.createDataFrame(rows, SPAN)).collect()}
    assert sorted(found) == ["c", "d"]
    assert (found["c"].operation, found["c"].input_tokens, found["c"].output_tokens, found["c"].finish_reasons) == ("other", None, 7.0, None)
    assert (found["d"].operation, found["d"].kind, found["d"].finish_reasons, found["d"].error) == ("chat", "model", ["stop"], False)
    assert model_calls.model_calls(spark.createDataFrame([], SPAN)).count() == 0


def test_messages_of_odd_shapes(spark):
    assert parts_of(spark, span("a", None), span("b", {"gen_ai.input.messages": "[broken"}), span("c", {"gen_ai.input.messages": "[1, null, {}]"}), span("d", {"gen_ai.prompt": ""})) == [("b", 0, "user", "text", None, "[broken"), ("d", 0, "user", "text", None, "")]
    several = '[{"role": "system", "content": [{"type": "text", "text": "a"}, {"type": "thinking", "content": "b"}, {"type": "image", "uri": "u"}, 5]}, {"role": "tool", "tool_call_id": "c1", "content": "{\\"r\\": 1}"}, "plain"]'
    assert parts_of(spark, span("a", {"gen_ai.input.messages": several})) == [
        ("a", 0, "system", "text", None, "a"),
        ("a", 0, "system", "reasoning", None, "b"),
        ("a", 0, "system", "other", "image", "u"),
        ("a", 1, "tool", "tool_result", None, '{"r":1}'),
        ("a", 2, "user", "text", None, "plain"),
    ]
    numbered = {"gen_ai.prompt.10.content": "last", "gen_ai.prompt.9.content": "first", "gen_ai.prompt.x.content": "no", "gen_ai.system_instructions": "be kind", "gen_ai.tool.definitions": '[{"function": {"name": "f"}}]'}
    assert parts_of(spark, span("a", numbered)) == [("a", 0, "system", "text", None, "be kind"), ("a", 1, "user", "text", None, "first"), ("a", 2, "user", "text", None, "last"), ("a", 3, "tools", "other", "f", '{"function":{"name":"f"}}')]


def test_links_of_missing_and_repeated_rows(spark):
    events = spark.createDataFrame([(1, 5.0, "error", None, "a", "A", "s", {"traceId": "T", "spanId": "X"}), (2, None, None, "PUT /a?b", "a::c", None, None, None), (3, 9.0, "info", "x", None, "B", "s", {"trace_id": "t", "kind": "span"})], EVENT)
    spans = spark.createDataFrame([("t", "x", 2.0), ("t", "x", 2.0), (None, "y", 1.0)], "trace_id string, span_id string, start_ms double")
    assert [(r.id, r.offset_ms, r.linked, r.span_omitted) for r in links.trace_logs(events, spans).collect()] == [(1, 3.0, True, False)]
    assert [(r.id, r.linked) for r in links.trace_logs(events, spans.limit(0)).orderBy("id").collect()] == [(1, False), (3, False)]
    assert [(r.trace_id, r.logs, r.name, r.services, r.errors) for r in links.log_traces(events, spans.limit(0)).collect()] == [("t", 1, "", ["A"], 1)]
    assert [r.r for r in events.orderBy("id").select(links.request_operation().alias("r")).collect()] == [None, "PUT /a", None]
    sessions = spark.createDataFrame([("s", "b", "x"), ("s", "a", "y")], "session_id string, label string, status string")
    assert sorted((r.id, r.label) for r in links.with_sessions(events, sessions).collect()) == [(1, "a"), (2, None), (3, "a")]
    assert sorted((r.id, r.crash_id) for r in links.with_crash(events, spark.createDataFrame([(9, 1), (8, 1), (7, None)], "crash_id long, error_id long")).collect()) == [(1, 8), (2, None), (3, None)]
    assert sorted((r.id, r.changed) for r in links.with_changed(events, spark.createDataFrame([(1,), (1,), (None,)], "id long")).collect()) == [(1, True), (2, False), (3, False)]
    assert events.where(links.in_group("a")).count() == 2
    pairs = spark.createDataFrame([(None, {"a": "1"}), ({"a": None, "b": "2"}, {"a": None, "b": "3", "c": ""}), (None, None)], "l map<string,string>, r map<string,string>")
    assert [r.d for r in pairs.select(links.differing_fields(F.col("l"), F.col("r")).alias("d")).collect()] == [["a"], ["b", "c"], []]


def test_stored_times(spark):
    texts = ["1700000000", "1700000000000", " -1.5 ", "2024-01-01", "2024-01-01 00:00", "2024-01-01T01:00:00+01:00", "2024-13-01 00:00", "2024", "soon", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    at = 1704067200000.0
    assert [r.m for r in rows.select(fields.time_ms(F.col("t")).alias("m")).collect()] == [1.7e12, 1.7e12, -1500.0, at, at, at, None, 2024000.0, None, None, None]
    assert rows.limit(1).select(fields.time_ms(F.col("t"), "ms").alias("m")).first().m == 1.7e9


def test_intervals_of_restarts_and_late_points(spark):
    rows = [("c", 1, "sum", True, 2, 0.0, 1000.0, 5.0, None, None), ("c", 2, "sum", True, 2, 0.0, 3000.0, 9.0, None, None), ("c", 3, "sum", True, 2, 0.0, 2000.0, 7.0, None, None), ("c", 4, "sum", True, 2, 0.0, 4000.0, 2.0, None, None), ("c", 5, "sum", True, 2, 4500.0, 5000.0, 3.0, None, None)]
    rows += [("e", 6, "exponentialHistogram", False, 2, None, 1.0, None, 2.0, 10.0), ("e", 7, "exponentialHistogram", False, 2, None, 2.0, None, 4.0, 16.0), ("e", 8, "exponentialHistogram", False, 2, None, 3.0, None, 4.0, 16.0), ("e", 9, "exponentialHistogram", False, 2, None, 4.0, None, 1.0, 4.0), ("g", 10, "gauge", False, None, None, 1.0, None, None, None)]
    points = spark.createDataFrame(rows, POINT)
    found = {r.id: r.plotted for r in metrics.intervals(metrics.without_late(points)).collect()}
    assert found == {1: 5.0, 2: 2.0, 4: 0.5, 5: 6.0, 6: 5.0, 7: 3.0, 8: None, 9: 4.0, 10: None}
    assert metrics.intervals(points.limit(0)).count() == metrics.without_late(points.limit(0)).count() == 0


def test_exceptions_of_odd_events(spark):
    rows = [(1, None, True), (2, "", False), (3, "{broken", True), (4, "fine", False), (5, '{"a": 1}', True), (6, '"text"', True), (7, '{"message": "x\\n  at f", "error": null, "exception": {"extendedStackTrace": [{"class": "C", "method": "m", "line": 3}]}}', True), (8, '{"err": {"stack": ["a", "b"], "rootCause": "low"}}', None), (9, '{"err": {"stack": ["a", "b"], "rootCause": "low"}}', True)]
    found = errors.exceptions(spark.createDataFrame(rows, "id long, raw string, is_json boolean")).orderBy("id", "block").collect()
    assert [(r.id, r.block, r.title, r.text) for r in found] == [(6, 0, "Exception", "text"), (7, 0, "exception", "    at C.m(Unknown Source:3)"), (7, 1, "x\n  at f", "x\n  at f"), (9, 0, "err", "a\nb"), (9, 1, "Caused by", "low")]


def test_health_of_missing_values(spark):
    rows = spark.createDataFrame([(s, i, None, None, None, None) for s in ("a", None) for i in range(3)], "site string, id long, level string, raw string, is_json boolean, fields map<string,string>")
    found = sites.health(rows, spark.createDataFrame([("a", 2), ("a", 1), (None, 5)], "site string, placeholders int"))
    assert [(r.site, r.hits, r.rule) for r in found.collect()] == [("a", 3, "unstructured")]
    assert sites.health(rows.limit(0), spark.createDataFrame([], "site string, placeholders int")).count() == 0


def test_telemetry_and_diffs_of_missing_values(spark):
    from lumenlog.operators import pages, telemetry

    rows = spark.createDataFrame([(None, None, None, None, None), (None, None, 2, None, {"http.method": "GET", "http.status_code": "x"}), ("s", "a", 2, 2, {"http.status_code": "500"})], "service string, name string, kind int, status_code int, attributes map<string,string>")
    found = {(r.service, r.code): r.hits for r in telemetry.findings(telemetry.tallies(rows)).collect()}
    assert found == {(None, "missing-route"): 1, (None, "old-attributes"): 2, ("s", "old-attributes"): 1}
    assert telemetry.findings(telemetry.tallies(rows.limit(0))).count() == 0
    diffs = spark.createDataFrame([("a", None), ("b", ""), ("c", "+no hunk"), ("d", "@@ -3 +0,0 @@\r\n-gone"), ("d", "@@ -3 +1 @@\n+x")], "key string, diff string")
    assert [tuple(r) for r in pages.diff_ranges(diffs, "key", "diff").collect()] == [("d", 1, 1)]


def test_facet_fields_of_aliases_dotted_and_long_values(spark):
    from lumenlog.operators import analytics

    made = [{"svc.zone": str(i % 2), "zone": str(i % 2), "a.b": str(i % 3), "host": "h", "service_name": str(i % 2), "service": str(i % 2), "prose": "x" * 81 + str(i % 2), "id": str(i), "level": str(i % 2)} for i in range(100)]
    rows = spark.createDataFrame([(m,) for m in [*made, None]], "fields map<string,string>")
    assert [(r.name, r.place) for r in analytics.facet_fields(rows).orderBy("place").collect()] == [("service", 1), ("a.b", 2), ("zone", 3)]
    assert analytics.facet_fields(rows.limit(0)).count() == 0


def test_statements_by_place(spark):
    """The closest within three lines, ties none, paths that end in each other, nulls and empty tables."""
    known = spark.createDataFrame([(1, "src/a.ts", 10, None), (2, "src/a.ts", 12, "near *"), (3, "lib/src/a.ts", 20, None), (4, "other/src/a.ts", 20, None), (5, "b.py", 1, None), (6, None, 5, None), (7, "c.py", None, "by text *")], "site long, file string, line int, pattern string")
    rows = [(1, "/app/src/a.ts", 13, None), (2, "a.ts", 11, None), (3, "src/a.ts", 15, None), (4, "src/a.ts", 16, "near x"), (5, "src/a.ts", 21, None), (6, "/x/other/src/a.ts", 23, None), (7, "C:\\y\\b.py", 4, None), (8, "xb.py", 1, "by text y"), (9, None, 1, None), (10, "b.py", None, None), (11, "./src/a.ts", 9, None), (7, "b.py", 1, None)]
    events = spark.createDataFrame(rows, "id long, file string, line int, message string")
    found = sorted((r.id, r.site, r.exact) for r in sites.written_by(events, known).collect())
    assert found == [(1, 2, True), (2, 1, True), (3, 2, True), (4, 2, False), (6, 4, True), (7, 5, True), (8, 7, False)]
    assert sites.written_by(events.limit(0), known).count() == sites.written_by(events, known.limit(0)).count() == 0


def test_volumes_of_nothing_and_of_rows_without_time_or_duration(spark):
    from lumenlog.operators import analytics

    events = spark.createDataFrame([(1, 5.0, "error", None, "a", "A", "s", {"durationMs": "3"}), (2, None, None, "x", None, None, None, None), (3, 5.0, "WARN", "y", "a", "A", "s", {"duration": "x"})], EVENT)
    full = analytics.volume(events).where("events > 0").collect()
    assert [(r.events, r.errors, r.warnings) for r in full] == [(2, 1, 1)]
    assert [(r.n, r.p95, r.average) for r in analytics.latency(events).collect()] == [(1, 3.0, 3.0)]
    assert [(r.n, r.p50) for r in analytics.percentiles(events).collect()] == [(1, 3.0)]
    assert sorted((r.key, r.events) for r in analytics.trend(events, F.col("server_id")).collect()) == [("a", 2)]
    none = events.limit(0)
    assert analytics.volume(none).agg(F.sum("events")).first()[0] == 0
    assert analytics.latency(none).count() == analytics.trend(none, F.col("server_id")).count() == 0


def test_spans_of_other_traces_are_left_out(spark):
    """Spans of traces that no log names don't reach the sort; those named in another case do."""
    events = spark.createDataFrame([(1, {"traceId": "Ab"}), (2, {"trace_id": ""}), (3, {"k": "cd"})], "id bigint, fields map<string,string>")
    spans = spark.createDataFrame([("aB", "s1"), ("aB", "s2"), ("cd", "s3"), (None, "s4"), ("", "s5")], "trace_id string, span_id string")
    assert sorted(r.span_id for r in links.spans_of_logs(spans, events).collect()) == ["s1", "s2"]
