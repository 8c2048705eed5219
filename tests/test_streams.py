"""Streams in many batches, with restarts, against the operators over tables."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenlog.operators import pages, requests
from lumenlog.sources import lines
from lumenlog.streaming import state, tail

START = datetime(2024, 1, 1)


class Feed:
    """Rows written as files that a stream reads one a batch, and what comes out of it."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self, operator, idle=True):
        """One run over what has come since the last, from the checkpoint."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        keep = lambda batch, n: batch.write.mode("append").parquet(f"{self.folder}/out")
        tail.run_available(operator(stream), f"{self.folder}/checkpoint", keep, idle=idle)
        return self.spark.read.parquet(f"{self.folder}/out").collect()


def test_stack_traces(spark, tmp_path):
    own = random.Random(8)
    texts = ["Error: x", "    at f (a.js:1:2)", "Caused by: y", "plain", "  indented", "Traceback (most recent call last):", "", None]
    rows = [(own.choice(["hot", "hot", "b", None]), i, own.choice(texts)) for i in range(240)]
    schema = "source string, n bigint, line string"
    feed = Feed(spark, str(tmp_path), schema)
    operator = lambda stream: state.joined_traces(stream, "source", "n", "line", hold_ms=600_000)
    for begin in range(0, 240, 60):
        feed.add(rows[begin : begin + 60])
        if begin % 120:
            feed.run(operator, idle=False)  # two files a run: the state goes on in the next
    ends = [(s, 1000 + i, "the end") for i, s in enumerate(("hot", "b", None))]
    feed.add(ends)
    found = feed.run(operator, idle=False)
    table = spark.createDataFrame([(s, n, t or "") for s, n, t in rows], schema)
    want = lines.joined_traces(table, "source", "n", "line").collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, want), key=str)


def test_a_held_event_leaves_after_its_time(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), "source string, n bigint, line string")
    operator = lambda stream: state.joined_traces(stream, "source", "n", "line", hold_ms=1)
    feed.add([("a", 1, "Error: x"), ("a", 2, "  at f")])
    feed.run(operator, idle=False)
    feed.add([("b", 3, "other")])
    found = feed.run(operator, idle=False)
    assert ("a", 1, 2, "Error: x\n  at f") in [tuple(r) for r in found]
    feed.add([("a", 4, "  at late"), ("a", 5, "next")])
    found = [tuple(r) for r in feed.run(operator, idle=False) if r.source == "a"]
    assert ("a", 4, 1, "  at late") in found and sum(n for _, _, n, _ in found) >= 3, "a line after the time begins an event"


def test_crash_links(spark, tmp_path):
    own = random.Random(5)
    schema = "id bigint, server_id string, session_id string, level string, structured boolean, crash boolean, exits boolean, ts timestamp"
    rows, at = [], START
    for i in range(300):
        at += timedelta(milliseconds=own.randrange(1500))
        kind = own.choice(["structured", "structured", "crash", "other"])
        rows.append((i, own.choice(["a", "b", None]), "s", own.choice(["error", "info"]), kind == "structured", kind == "crash", None, at))
    feed = Feed(spark, str(tmp_path), schema)
    for begin in range(0, 300, 75):
        feed.add(rows[begin : begin + 75])
    feed.run(state.crash_links)
    found = feed.run(state.crash_links)
    table = spark.createDataFrame(rows, schema).withColumn("ts_ms", F.unix_millis("ts").cast("double"))
    want = pages.crash_links(table, F.col("structured"), F.col("crash")).collect()
    assert len(want) > 5 and sorted(map(tuple, found)) == sorted(map(tuple, want))


def test_a_crash_that_ends_its_process_may_come_later(spark, tmp_path):
    schema = "id bigint, server_id string, session_id string, level string, structured boolean, crash boolean, exits boolean, ts timestamp"
    feed = Feed(spark, str(tmp_path), schema)
    at = lambda s: START + timedelta(seconds=s)
    feed.add([(1, "a", "s", "error", True, False, False, at(0)), (2, "b", "s", "fatal", True, False, False, at(0)), (3, "c", "s", "error", True, False, False, at(0))])
    feed.add([(4, "a", "s", None, False, True, True, at(20)), (5, "b", "s", None, False, True, False, at(20)), (6, "a", "s", None, False, True, True, at(21))])
    feed.add([(7, "x", "s", None, False, False, False, at(200))])
    feed.add([(10, "x", "s", None, False, False, False, at(201))])
    feed.add([(8, "c", "s", None, False, True, True, at(5)), (9, "x", "s", None, None, None, None, None)])
    assert [tuple(r) for r in feed.run(state.crash_links)] == [(4, 1)], "and one that comes after the watermark is left out"


EVENT = "tab bigint, request string, kind string, url string, status int, ts timestamp"


def test_requests_as_over_a_table(spark, tmp_path):
    own = random.Random(6)
    rows = []
    for i in range(60):
        begin, status = own.randrange(60_000), own.choice([200, 204, 404, 503])
        life = [("sent", f"u{i}", None, 0), ("response", None, status, 40), ("data", None, None, 90), (own.choice(["finished", "failed"]), None, None, 700)]
        rows += [(i % 3, f"r{i}", kind, url, code, START + timedelta(milliseconds=begin + after + own.randrange(20))) for kind, url, code, after in life]
    rows.sort(key=lambda r: r[-1])
    feed = Feed(spark, str(tmp_path), EVENT)
    for begin in range(0, len(rows), 60):
        feed.add(rows[begin : begin + 60])
    found = feed.run(state.requests)
    table = spark.createDataFrame(rows, EVENT).select("*", F.lit(0).alias("hop"), F.unix_millis("ts").cast("double").alias("ts_ms"))
    want = requests.requests(table).collect()
    assert sorted((r.tab, r.request, r.hop, r.url, r.status, round(r.duration_ms), r.state) for r in found) == sorted((r.tab, r.request, r.hop, r.url, r.status, round(r.duration_ms), r.state) for r in want)


def test_redirects_unread_answers_and_lost_ends(spark, tmp_path):
    at = lambda ms: START + timedelta(milliseconds=ms)
    feed = Feed(spark, str(tmp_path), EVENT)
    feed.add([(1, "hop", "sent", "a", None, at(0)), (1, "quiet", "sent", "q", None, at(0)), (1, "lost", "sent", "l", None, at(0)), (2, "slow", "sent", "s", None, at(0)), (None, None, "sent", "n", None, at(0))])
    feed.add([(1, "hop", "sent", "b", 302, at(100)), (1, "quiet", "response", None, 500, at(50)), (2, "slow", "response", None, 200, at(50)), (1, "none", "finished", None, None, at(60)), (None, None, "failed", None, None, at(70))])
    feed.add([(1, "hop", "finished", None, None, at(300)), (2, "slow", "data", None, None, at(39_000))])
    feed.run(state.requests)
    feed.add([(9, "clock", "sent", "c", None, at(40_000))])  # the watermark passes 2,050: quiet is unread, slow has been heard of
    feed.add([(1, "quiet", "failed", None, None, at(40_100)), (2, "slow", "finished", None, None, at(40_200))])
    feed.add([(9, "clock", "failed", None, None, at(2_000_000))])
    feed.add([(9, "more", "sent", "m", None, at(2_000_000))])
    found = sorted([(str(r.request), r.hop, r.url, r.status, r.duration_ms, r.state) for r in feed.run(state.requests)], key=lambda r: (r[0], r[1], r[2], str(r[3]).zfill(9), r[4] or 0))
    assert found == sorted([
        ("None", 0, "n", None, 70.0, "failed"),
        ("clock", 0, "c", None, 1_960_000.0, "failed"),
        ("hop", 0, "a", 302, 100.0, "ok"),
        ("hop", 1, "b", None, 200.0, "ok"),
        ("lost", 0, "l", None, None, "pending"),
        ("quiet", 0, "q", 500, 40_100.0, "failed"),
        ("quiet", 0, "q", 500, 50.0, "unread"),
        ("slow", 0, "s", 200, 40_200.0, "ok"),
    ], key=lambda r: (r[0], r[1], r[2], str(r[3]).zfill(9), r[4] or 0))


def test_rates(spark, tmp_path):
    """Points that come out of order, restarts of counters, missing values, over two runs of the query."""
    from lumenlog.operators import metrics

    own = random.Random(7)
    schema, rows, totals = "series string, id bigint, total double, ts timestamp", [], {}
    for i in range(240):
        series = own.choice(["hot", "hot", "b", None])
        totals[series] = own.choice([totals.get(series, 0) + own.randrange(50)] * 8 + [0.0])
        rows.append((series, i, own.choice([float(totals[series])] * 9 + [None]), START + timedelta(milliseconds=100 * i + own.choice([0, 0, 0, -350]))))
    feed = Feed(spark, str(tmp_path), schema)
    for begin in range(0, 240, 60):
        feed.add(rows[begin : begin + 60])
        if begin == 60:
            feed.run(state.rates)
    found = feed.run(state.rates)
    table = spark.createDataFrame(rows, schema).withColumn("time_ms", F.unix_millis("ts").cast("double"))
    want = metrics.rates(metrics.without_late(table)).collect()
    shown = lambda some: sorted(((r.id, str(r.series), None if r.rate is None else round(r.rate, 6)) for r in some))
    assert len(want) > 150 and shown(found) == shown(want)


def test_a_series_begins_anew_after_its_time(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), "series string, id bigint, total double, ts timestamp")
    at = lambda s: START + timedelta(seconds=s)
    for row in [("a", 1, 10.0, at(0)), ("b", 2, 1.0, at(10_000)), ("b", 3, 2.0, at(10_001)), ("a", 4, 30.0, at(10_002)), ("a", 5, 34.0, at(10_004)), ("a", 6, 1.0, None)]:
        feed.add([row])
    found = sorted((r.id, r.rate) for r in feed.run(state.rates))
    assert found == [(1, None), (2, None), (3, 1.0), (4, None), (5, 2.0)]


def test_lag_follows_what_was_late(spark, tmp_path):
    path = f"{tmp_path}/late"
    assert tail.next_lag_ms(spark, path, 60_000) == 60_000
    told = []
    for run in range(12):
        late = [1_000, 9_000, 20_000][run % 3] if run < 9 else 2_000
        rows = [(START + timedelta(minutes=run), START + timedelta(minutes=run, milliseconds=m)) for m in (0, late)] + [(None, START), (START, None)]
        tail.note_lateness(spark.createDataFrame(rows, "ts timestamp, seen timestamp"), path)
        told.append(tail.next_lag_ms(spark, path, 60_000))
    tail.note_lateness(spark.createDataFrame([], "ts timestamp, seen timestamp"), path)
    assert told == [60_000] * 4 + [40_000] * 4 + [60_000] + [40_000] * 3
    assert tail.next_lag_ms(spark, path, 30_000) == 30_000
