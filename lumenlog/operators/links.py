"""Events beside what they belong to: sessions, spans, traces, crashes, changed lines, each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.fields import field

# Forms of a request in a message.
METHOD = r"(?i)^(GET|HEAD|POST|PUT|PATCH|DELETE|OPTIONS|TRACE|CONNECT)$"
MESSAGE_METHOD = r"""(?i)\b(?:http[._]?)?(?:request)?method[=:]\s*["']?([a-z]+)"""
MESSAGE_PATH = r"""(?i)\b(?:http[._]?)?(?:request)?(?:url|uri|path|route|target)[=:]\s*["']?((?:[a-z][a-z\d+.-]*://[^\s/"']*)?/[^\s"',;]*)"""
MESSAGE_REQUEST = r"""\b(GET|HEAD|POST|PUT|PATCH|DELETE|OPTIONS)\s+(/[^\s"',;]*)"""


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def request_operation() -> Column:
    """``GET /path`` or ``/path`` of the request that an event names in fields or message, without its query; else null."""
    message, full = F.col("message"), lambda name: F.nullif(field(name), F.lit(""))
    path = F.coalesce(full("path"), _group(message, MESSAGE_PATH, 1), _group(message, MESSAGE_REQUEST, 2))
    methods = [full("method"), _group(message, MESSAGE_METHOD, 1), _group(message, MESSAGE_REQUEST, 1)]
    method = F.upper(F.coalesce(*[F.when(m.rlike(METHOD), m) for m in methods]))
    bare = F.regexp_replace(path, r"(?s)[?#].*$", "")
    route = F.when(bare == "", "/").otherwise(bare)
    return F.when(path.rlike(r"(?i)^(/|[a-z][a-z\d+.-]*://)"), F.concat_ws(" ", method, route))


def with_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events and the ``label`` and ``status`` of their session; null for sessions that aren't listed.

    Of repeated sessions the least label and status count. Catalyst broadcasts sessions if they are small.
    """
    listed = sessions.groupBy("session_id").agg(F.min(F.struct("label", "status")).alias("s"))
    return events.join(listed, "session_id", "left").select(events["*"], F.col("s.label").alias("label"), F.col("s.status").alias("status"))


def spans_of_logs(spans: DataFrame, events: DataFrame) -> DataFrame:
    """The spans of traces that events name, in any case. Taken before spans are sorted, the others cost a scan only."""
    named = events.select(F.lower(F.nullif(field("traceId"), F.lit(""))).alias("_named")).where("_named IS NOT NULL").distinct()
    return spans.join(named, F.lower(F.col("trace_id").cast("string")) == F.col("_named"), "left_semi")


def trace_logs(events: DataFrame, spans: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Logs of traces: ``trace_id, id, span_id, offset_ms, linked, span_omitted``.

    An event belongs to the trace that its field names, in any case. The event of a span itself is
    left out where the trace has spans. ``offset_ms`` counts from the trace's first span. ``linked``
    tells whether the log's span was received, ``span_omitted`` whether it is received but not in
    ``shown`` (``trace_id``, ``span_id``; all spans if missing). Ids of spans are lower case. Spans of other
    traces don't count, so :func:`spans_of_logs` may leave them out first.
    """
    traces = spans.groupBy(F.lower(F.col("trace_id").cast("string")).alias("trace_id")).agg(F.min("start_ms").alias("_start"))
    keys = lambda rows: rows.select(F.lower(F.col("trace_id").cast("string")).alias("trace_id"), F.lower("span_id").alias("span_id")).distinct()
    logs = events.select(F.lower(F.nullif(field("traceId"), F.lit(""))).alias("trace_id"), "id", "ts_ms", F.lower(field("spanId")).alias("span_id"), (F.coalesce(field("kind"), F.lit("")) == "span").alias("_span")).where("trace_id IS NOT NULL")
    placed = logs.join(traces, "trace_id", "left").where(~F.col("_span") | F.col("_start").isNull())
    known = placed.join(keys(spans).withColumn("_known", F.lit(True)), ["trace_id", "span_id"], "left")
    if shown is not None:
        known = known.join(keys(shown).withColumn("_shown", F.lit(True)), ["trace_id", "span_id"], "left")
    seen = F.col("_known") if shown is None else F.col("_shown")
    linked = F.coalesce("_known", F.lit(False))
    return known.select("trace_id", "id", "span_id", (F.col("ts_ms") - F.col("_start")).alias("offset_ms"), linked.alias("linked"), (linked & ~F.coalesce(seen, F.lit(False))).alias("span_omitted"))


def log_traces(events: DataFrame, spans: DataFrame) -> DataFrame:
    """One row a trace that logs name: ``trace_id, has_spans, logs``, and for those without spans name, services, start, duration, errors.

    Errors of a trace with spans are its spans' errors, so its logs are only counted. The name is
    the request of the first log that names one, else the first log's message.
    """
    traces = spans.select(F.lower(F.col("trace_id").cast("string")).alias("trace_id")).distinct().withColumn("has_spans", F.lit(True))
    made = events.withColumns({"trace_id": F.lower(F.nullif(field("traceId"), F.lit(""))), "_request": request_operation()})
    logs = made.where(F.col("trace_id").isNotNull() & (F.coalesce(F.element_at("fields", "kind"), F.lit("")) != "span"))
    summed = logs.groupBy("trace_id").agg(
        F.count("*").alias("logs"),
        F.coalesce(F.min(F.when(F.col("_request").isNotNull(), F.struct("id", "_request")))["_request"], F.min(F.struct("id", "message"))["message"], F.lit("")).alias("name"),
        F.array_sort(F.collect_set("server")).alias("services"),
        F.min("ts_ms").alias("start_ms"),
        F.max("ts_ms").alias("_end"),
        F.count_if(F.col("level").isin("error", "fatal")).alias("errors"),
    )
    found = summed.join(traces, "trace_id", "left").withColumn("has_spans", F.coalesce("has_spans", F.lit(False)))
    own = lambda c: F.when(~F.col("has_spans"), c)
    return found.select("trace_id", "has_spans", "logs", *[own(F.col(c)).alias(c) for c in ("name", "services", "start_ms", "errors")], own(F.col("_end") - F.col("start_ms")).alias("duration_ms"))


def differing_fields(left: Column, right: Column) -> Column:
    """Sorted names of fields that only one of two maps has, or whose values differ. A null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(left, empty), F.coalesce(right, empty)
    names = F.array_union(F.map_keys(a), F.map_keys(b))
    same = lambda n: F.map_contains_key(a, n) & F.map_contains_key(b, n) & F.element_at(a, n).eqNullSafe(F.element_at(b, n))
    return F.array_sort(F.filter(names, lambda n: ~same(n)))


def with_changed(events: DataFrame, changed_ids: DataFrame, id: str = "id") -> DataFrame:
    """Events and ``changed``: whether their id is among ``changed_ids``, such as rows of ``pages.in_ranges``."""
    hits = changed_ids.select(F.col(id)).where(F.col(id).isNotNull()).distinct().withColumn("changed", F.lit(True))
    return events.join(hits, id, "left").withColumn("changed", F.coalesce("changed", F.lit(False)))


def with_crash(events: DataFrame, crashes: DataFrame) -> DataFrame:
    """Events and the ``crash_id`` that ``pages.crash_links`` attached to them, null without one."""
    attached = crashes.where("error_id IS NOT NULL").groupBy(F.col("error_id").alias("id")).agg(F.min("crash_id").alias("crash_id"))
    return events.join(attached, "id", "left")


def in_group(source: str, column: str = "server_id") -> Column:
    """Whether an event's source is ``source`` or one of its containers, ``source::name``."""
    return (F.col(column) == source) | F.col(column).startswith(f"{source}::")


def entry_span() -> Column:
    """Whether a span is where work enters a service: without a parent, or of kind server (2) or consumer (5)."""
    return F.col("parent_id").isNull() | F.coalesce(F.col("kind").isin(2, 5), F.lit(False))
