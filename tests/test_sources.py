import datetime as dt

from pyspark.sql import functions as F

from lumenlog.operators import analytics, pages, traces
from lumenlog.sources import lines, otlp
from lumenlog.streaming import tail


def test_lines_of_all_forms(spark, tmp_path):
    (tmp_path / "in.log").write_text('{"level":"warning","msg":"slow","a":{"b":{"c":1}}}\n\nlevel=error msg="no go" n=3\n[ERROR] plain text\nPATH=/usr/bin\n[1,2]\n{}\r\n')
    rows = {r.line: r for r in lines.read_lines(spark, str(tmp_path / "in.log")).collect()}
    first = rows['{"level":"warning","msg":"slow","a":{"b":{"c":1}}}']
    assert (first.level, first.message, first.is_json) == ("warn", "slow", True)
    assert first.fields["a.b.c"] == first.fields["c"] == "1"
    second = rows['level=error msg="no go" n=3']
    assert (second.level, second.message, second.is_json, second.fields["n"]) == ("error", "no go", False, "3")
    assert (rows["[ERROR] plain text"].level, rows["PATH=/usr/bin"].fields, rows["{}"].message) == ("error", {}, "JSON event")


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'quoted "x",\nnext line', {"a": "1"}), (2, "plain", {"b": "2"})], "id int, message string, fields map<string,string>")
    lines.write_csv(rows, f"{tmp_path}/csv")
    back = {r.id: (r.message, r.fields) for r in lines.read_csv(spark, f"{tmp_path}/csv").collect()}
    assert back == {"1": ('quoted "x",\nnext line', {"a": "1"}), "2": ("plain", {"b": "2"})}
    lines.write_jsonl(rows, f"{tmp_path}/jsonl")
    assert spark.read.json(f"{tmp_path}/jsonl").count() == 2


def test_lines_beyond_the_most_of_a_trace_are_further_events(spark):
    rows = [("a", 0, "Error: x")] + [("a", i, f"    at f{i}") for i in range(1, 2500)] + [("a", 2500, "next"), ("b", 1, "other")]
    found = lines.joined_traces(spark.createDataFrame(rows, "source string, seq int, line string"), "source", "seq", "line").orderBy("source", "first").collect()
    assert [(r.source, r.first, r.n_lines) for r in found] == [("a", 0, 1000), ("a", 1000, 1000), ("a", 2000, 500), ("a", 2500, 1), ("b", 1, 1)]
    assert [x for r in found for x in r.text.split("\n")] == [r[2] for r in rows]


def test_otlp_logs(spark):
    body = '{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"api"}}]},"scopeLogs":[{"logRecords":[{"timeUnixNano":"1700000000123456789","severityNumber":17,"severityText":"info","body":{"stringValue":"bad"},"attributes":[{"key":"n","value":{"intValue":"7"}}]}]}]}]}'
    row = otlp.logs(spark.createDataFrame([(body,), (None,), ("{}",)], "body string"), "body").collect()
    assert [(r.level, r.message, r.service, r.fields, r.ts_ms) for r in row] == [("error", "bad", "api", {"n": "7"}, 1700000000123.456)]


def test_waterfall_of_the_known_trace(spark):
    spans = [("t", "a", None, 1000, 1200), ("t", "b", "a", 1010, 1040), ("t", "c", "a", 1050, 1150), ("t", "d", "c", 1060, 1140), ("t", "e", "gone", 1300, 1310)]
    frame = spark.createDataFrame([(*s[:3], float(s[3]), float(s[4]), "n", "s", 2 if s[1] == "c" else 0) for s in spans], "trace_id string, span_id string, parent_id string, start_ms double, end_ms double, name string, service string, status_code int")
    rows = sorted(traces.waterfall(frame).collect(), key=lambda r: r.ordinal)
    assert [(r.span_id, r.depth, r.offset_ms) for r in rows] == [("a", 0, 0), ("b", 1, 10), ("c", 1, 50), ("d", 2, 60), ("e", 0, 300)]
    assert [r.span_id for r in traces.critical_paths(frame).collect()] == ["e"]
    assert [r.span_id for r in traces.critical_paths(frame.where("span_id <> 'e'")).orderBy("step").collect()] == ["a", "c", "d"]
    assert {r.span_id: r.self_ms for r in traces.self_times(frame).collect()} == {"a": 70, "b": 30, "c": 20, "d": 80, "e": 10}
    one = traces.summaries(frame).first()
    assert (one.duration_ms, one.spans, one.errors, one.root_name) == (310, 5, 1, "n")


def test_deep_traces_keep_all_their_spans(spark):
    n = 70
    spans = [("t", f"s{i:03d}", f"s{i - 1:03d}" if i else None, float(i), 1000.0, "n", "s", 0) for i in range(n)]
    frame = spark.createDataFrame(spans, "trace_id string, span_id string, parent_id string, start_ms double, end_ms double, name string, service string, status_code int")
    rows = sorted(traces.waterfall(frame).collect(), key=lambda r: r.ordinal)
    assert [(r.span_id, r.depth, r.ordinal) for r in rows] == [(f"s{i:03d}", i, i + 1) for i in range(n)]
    assert [r.span_id for r in traces.critical_paths(frame).orderBy("step").collect()] == [f"s{i:03d}" for i in range(n)]


def test_outliers_are_trimmed_from_the_range(spark):
    rows = [(i, float(i * 1000)) for i in range(1000)] + [(2000 + i, 999_000.0 + 6 * 3_600_000 + i) for i in range(3)]
    low, high = analytics.time_range(spark.createDataFrame(rows, "id int, ts_ms double")).first()
    assert (low, high) == (0.0, 999_000.0)


def test_retention_by_bytes(spark):
    rows = spark.range(1, 2001).select("id", F.lit("m" * 10).alias("message"), F.lit("").alias("raw"), F.lit("").alias("server_id"), F.create_map().cast("map<string,string>").alias("fields"))
    one = rows.select(pages.size_estimate()).first()[0]
    kept = [r.id for r in pages.retained(rows, 10**9, one * 777 + 5).select("id").collect()]
    assert sorted(kept) == list(range(2001 - 777, 2001))


def test_tail_counts_repeats_once(spark, tmp_path):
    begin = dt.datetime(2024, 1, 1)
    rows = [(begin + dt.timedelta(seconds=i), f"line {i}", "error" if i % 10 == 0 else "info") for i in range(120)]
    schema = "ts timestamp, line string, level string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    spark.createDataFrame(rows[100:] + [(begin + dt.timedelta(seconds=500), "line 500", "info")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    seen: list = []
    tail.run_available(tail.distinct_lines(stream), f"{tmp_path}/c1", lambda df, _: seen.extend(df.collect()))
    assert sorted(r.line for r in seen) == sorted({r[1] for r in rows} | {"line 500"})
    windows: list = []
    tail.run_available(tail.rolling_volume(stream), f"{tmp_path}/c2", lambda df, _: windows.extend(df.collect()))
    assert {(r.events, r.errors) for r in windows} <= {(60, 6), (80, 8), (81, 8), (1, 0)} and windows


def test_replica_numbers_of_any_length(spark):
    from lumenlog.sources import lines

    rows = spark.createDataFrame([("shop_api_90000  | up",), ("web-12345 | {}",), ("a | b",)], "line string").select(lines.container_prefix(F.col("line")).alias("p")).select("p.service", "p.container", "p.payload").collect()
    assert [tuple(r) for r in rows] == [("api", "shop_api_90000", "up"), ("web", "web-12345", "{}"), (None, None, "a | b")]


def test_objects_are_parsed_once_a_level(spark):
    """Common expressions aren't shared within lambdas: each use of a level, and each look at the keys, parsed all of it again."""
    assert lines.flattened(F.col("line"))._jc.toString().count("from_json") == 4
    assert lines.logfmt(F.col("line"))._jc.toString().count("regexp_extract_all") == 3  # keys and values, and keys for their number
    rows = spark.createDataFrame([('{"a":{"b":{"c":{"d":1,"e":{"f":2}},"g":3}},"b":"x","g":null}',)], "line string")
    assert lines.parse(rows).first().fields == {"b": "x", "a.b.g": "3", "a.b.c.d": "1", "g": "3", "d": "1"}
