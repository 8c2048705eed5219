"""Running values of keys that fill several ranges, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import metrics, pages, scans, traces
from lumenlog.scratch import Scratch
from lumenlog.sources import lines

SCHEMA = "k string, at int, id int, v double, _range0 string"


def rows(n=400):
    own = random.Random(3)
    keys = ["hot"] * 6 + ["a", "b", None, "c"]
    return [(own.choice(keys), own.randrange(40), i, own.choice([None, *map(float, range(-9, 9))]), "x") for i in range(n)]


def plain(some, frame, backwards, inclusive):
    out = {}
    order = sorted(some, key=lambda r: (r[1], r[2]), reverse=backwards)
    for r in order:
        same = [x for x in order if x[0] == r[0]]
        place = same.index(r)
        counted = same if frame == "all" else same[: place + inclusive]
        values = [x[3] for x in counted if x[3] is not None]
        out[r[2]] = (sum(values) if values else None, max(values, default=None), min(values, default=None), values[-1] if values else None, len(counted) or None)
    return out


@pytest.mark.parametrize("parts", [1, 7, 64])
@pytest.mark.parametrize("frame, backwards", [("before", False), ("upto", False), ("before", True), ("upto", True), ("all", False)])
def test_running(spark, parts, frame, backwards):
    some = rows()
    kept = scans.ranged(spark.createDataFrame(some, SCHEMA), ["k"], ["at", "id"], Scratch(spark, "t"), parts)
    v = F.col("v")
    columns = {"s": ("sum", v), "x": ("max", v), "n": ("min", v), "l": ("last", v), "c": ("sum", F.lit(1))}
    found = scans.running(kept, ["k"], ["at", "id"], columns, frame, backwards).collect()
    assert {r.id: (r.s, r.x, r.n, r.l, r.c) for r in found} == plain(some, frame, backwards, frame == "upto")


def test_numbers_over_all_rows_and_every_nth(spark):
    some = spark.createDataFrame(rows(), SCHEMA)
    ids = [r[2] for r in sorted(rows(), key=lambda r: (r[1], r[2]))]
    for step in (1, 7, 1000):
        assert sorted(r.id for r in scans.every_nth(some, ["at", "id"], step, Scratch(spark, "t")).collect()) == sorted(ids[::step])
    kept = scans.ranged(some, [], ["at", "id"], Scratch(spark, "t"), 9)
    assert [r.id for r in scans.numbered(kept, [], ["at", "id"], "n").orderBy("n").collect()] == ids
    assert scans.every_nth(some.limit(0), ["at"], 3, Scratch(spark, "t")).columns == some.columns
    assert scans.every_nth(some.limit(0), ["at"], 3, Scratch(spark, "t")).count() == 0
    with pytest.raises(ValueError):
        scans.every_nth(some, ["at"], 0, Scratch(spark, "t"))


def windows_of(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line.strip(" :+-") for line in plan.split("\n") if line.strip(" :+-").startswith("Window ")]


def test_no_window_sorts_a_whole_key(spark):
    """Windows are within a range, or over what the ranges of a key hold."""
    events = spark.createDataFrame([(1, 1.0, "error", "m", "s", "a")], "id int, ts_ms double, level string, message string, server_id string, session_id string")
    points = spark.createDataFrame([("s", 1, 1.0, 2.0)], "series string, id int, time_ms double, total double")
    ranges = spark.createDataFrame([("k", 1, 2)], "key string, a int, b int")
    for made in (
        pages.context(events, events.select("id")),
        pages.crash_links(events, F.lit(True), F.lit(True)),
        pages.merged_ranges(ranges, "key", "a", "b"),
        metrics.rates(points),
        metrics.thinned(points, "series", ["time_ms", "id"], 3),
        metrics.without_late(points),
        metrics.intervals(points.withColumn("kind", F.lit("sum"))),
        lines.joined_traces(events, "server_id", "id", "message"),
        traces.self_times(spark.createDataFrame([("t", "a", None, 0.0, 1.0)], "trace_id string, span_id string, parent_id string, start_ms double, end_ms double")),
    ):
        found = windows_of(made)
        assert found and all("_range#" in w for w in found)


def test_a_hot_source_in_many_ranges_gives_the_same(spark):
    """The operators over a hot key, in one range and in many."""
    own = random.Random(4)
    events = [(i, float(i * own.randrange(1, 900)), own.choice(["error", "info"]), own.choice(["x", "  at y", "crash"]), own.choice(["hot", "hot", "b", None]), "s") for i in range(300)]
    events = spark.createDataFrame(events, "id int, ts_ms double, level string, message string, server_id string, session_id string")
    points = spark.createDataFrame([(own.choice(["hot", "b"]), i, float(own.randrange(200)), float(own.randrange(50))) for i in range(300)], "series string, id int, time_ms double, total double")
    ranges = spark.createDataFrame([(own.choice(["hot", "b"]), a, a + own.randrange(6)) for a in [own.randrange(900) for _ in range(200)]], "key string, a int, b int")
    made = (
        lambda: pages.context(events, events.select("id").where("id % 10 = 0"), 3),
        lambda: pages.crash_links(events, F.col("message") != "crash", F.col("message") == "crash", 1e9),
        lambda: pages.merged_ranges(ranges, "key", "a", "b"),
        lambda: metrics.rates(points),
        lambda: metrics.thinned(points, "series", ["time_ms", "id"], 13),
        lambda: metrics.without_late(points),
        lambda: lines.joined_traces(events, "server_id", "id", "message"),
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = {}
    for parts in ("1", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found[parts] = [sorted(map(tuple, run().collect()), key=str) for run in made]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found["1"] == found["23"] and all(found["1"])


CALL = "trace_id string, span_id string, parent_id string, name string, service string, start_ms double, end_ms double, status_code int, attributes map<string,string>"


def call(span, parent, operation=None, tokens=None, trace="t"):
    attributes = {"gen_ai.operation.name": operation} if operation else {}
    if tokens is not None:
        attributes["gen_ai.usage.input_tokens"] = str(tokens)
    return (trace, span, parent, span, "s", 0.0, 1.0, 0, attributes or None)


def test_totals_beneath_agents(spark):
    """Nested agents, an agent without calls, spans without attributes, a span that comes twice, a cycle, a chain of 200."""
    chain = [call(f"c{i:03d}", f"c{i - 1:03d}" if i else "outer", "chat" if i % 2 else None, 1) for i in range(200)]
    some = [
        call("outer", None, "invoke_agent"),
        call("inner", "outer", "invoke_agent"),
        call("tool", "inner", "execute_tool"),
        call("deep", "tool", "chat", 7),
        call("none", "outer", "chat"),
        call("deep", "tool", "chat", 7),
        call("bare", "inner"),
        call("idle", "outer", "create_agent"),
        call("x", "y", "invoke_agent"),
        call("y", "x", "chat", 5),
        call("outer", None, "invoke_agent", trace="u"),
        *chain,
    ]
    from lumenlog.operators import model_calls

    found = {(r.trace_id, r.span_id): (r.model_calls, r.calls_input_tokens) for r in model_calls.chips(spark.createDataFrame(some, CALL)).collect() if r.kind == "agent"}
    assert found == {("t", "outer"): (102, 107.0), ("t", "inner"): (1, 7.0), ("t", "idle"): (None, None), ("u", "outer"): (None, None), ("t", "x"): (None, None)}
    assert model_calls.chips(spark.createDataFrame([], CALL)).count() == 0


def test_islands_of_equal_ranges_begin_once(spark, monkeypatch):
    """Equal rows stand in any order: what begins an island in one walk may come second in the next one."""
    ranges = spark.createDataFrame([("k", 1, 2), ("k", 10, 12), ("k", 10, 12), ("k", 10, 20), ("k", 30, 30), (None, 5, 6), (None, 5, 6)], "key string, a long, b long")
    calls, own = [], scans.running

    def reordered(rows, keys, order, *rest):
        calls.append(rows.groupBy(*keys, *order).count().agg(F.max("count")).first()[0])
        return own(rows, keys, order, *rest)

    monkeypatch.setattr(pages, "running", reordered)
    found = sorted(((r.key or "", r.a, r.b) for r in pages.merged_ranges(ranges, "key", "a", "b").collect()))
    assert found == [("", 5, 6), ("k", 1, 2), ("k", 10, 20), ("k", 30, 30)]
    assert calls == [1, 1]
