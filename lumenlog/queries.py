"""Queries over the test tables, one an operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.functions import fields, redaction, text
from lumenlog.operators import analytics, calls, errors, links, metrics, model_calls, pages, requests, scans, sites, telemetry, traces
from lumenlog.plans import predicates as P
from lumenlog.scratch import Scratch
from lumenlog.sources import json_documents, lines, otlp, otlp_proto, tables, terminal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EV = """ev AS (SELECT event_id AS id, epoch_us(ts) / 1000.0 AS ts_ms,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level,
  event_type || ' by user ' || user_id || ' took ' || CAST(floor(value + 0.5) AS BIGINT) || 'ms k=' || regexp_extract(props, '"k": *([0-9]+)', 1) AS message,
  props AS raw, 'svc' || (user_id % 5) AS server_id, strftime(ts, '%Y-%m-%d') AS session_id, event_type, user_id, value,
  regexp_extract(props, '"k": *([0-9]+)', 1) AS k, CASE WHEN event_type = 'error' THEN 500 + event_id % 4 ELSE 200 END AS status FROM events)"""
#: 2024-01-15 00:00 UTC.
MID = 1705276800000.0
HOUR = 3_600_000.0


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return register


# Predicates: the matching events.
def _search(name: str, condition: Callable[[], Column], where: str) -> None:
    QUERIES[name] = lambda spark, d: tables.events(spark, d).where(condition()).select("id", "level", "message")
    ORACLE_SQL[name] = f"WITH {EV} SELECT id, level, message FROM ev WHERE {where}"


_search("d1_word", lambda: P.word("USER 7"), "contains(lower(level), 'user 7') OR contains(lower(message), 'user 7') OR contains(lower(raw), 'user 7')")
_search("d1_word_star", lambda: P.word("error*k=9"), "regexp_matches(message, '(?i)error.*k=9') OR regexp_matches(raw, '(?i)error.*k=9') OR regexp_matches(level, '(?i)error.*k=9')")
_search("d2_phrase", lambda: P.phrase("warn signup by user 1"), "contains(lower(level || ' ' || message || ' ' || raw), 'warn signup by user 1')")
_search("d3_field", lambda: P.has("event_type", "CHA"), "contains(lower(event_type), 'cha')")
_search("d3_missing_field", lambda: P.has("nothing", "x") | P.has("nothing", "") & P.has("user_id", "12"), "contains(CAST(user_id AS VARCHAR), '12')")
_search("d4_like", lambda: P.like("server_id", "none*") | P.like("event_type", "P*e"), "regexp_matches(event_type, '(?is)^p.*e$')")
_search("d6_regex", lambda: P.matches("message", r"took \d{3}ms k=[13579]$"), r"regexp_matches(message, 'took \d{3}ms k=[13579]$')")
_search("d7_compare", lambda: P.compares("duration", ">", 200) & P.compares("k", "<=", 30), "value > 200 AND CAST(k AS DOUBLE) <= 30")
_search("d7_compare_text", lambda: P.compares("event_type", ">", 200) | P.compares("user_id", "<", 3), "user_id < 3")
_search("d8_range", lambda: P.between("durationMs", 50, 60), "value BETWEEN 50 AND 60")
_search("d9_status_class", lambda: P.status_class(5) & P.exclude(P.has("statusCode", "503")), "status BETWEEN 500 AND 599 AND status <> 503")
_search("d10_exists", lambda: P.exists("duration_ms") & P.exclude(P.exists("requestId")) & P.has("k", "99"), "contains(k, '99')")
_search("d11_since", lambda: P.since(MID, HOUR * 24) & P.up_to(6000), f"ts_ms >= {MID} - {HOUR * 24} AND id <= 6000")
_search("d11_since_all", lambda: P.since(MID, HOUR * 24), f"ts_ms >= {MID} - {HOUR * 24}")
_search("d12_time", lambda: P.within(MID, MID + HOUR), f"ts_ms BETWEEN {MID} AND {MID + HOUR}")
_search("d14_exclude", lambda: P.exclude(P.has("event_type", "e")) & P.exclude(P.has("nothing", "x")), "NOT contains(event_type, 'e')")
_search("d17_levels", lambda: P.levels("error", "warn") & P.has("user_id", "77"), "level IN ('error', 'warn') AND contains(CAST(user_id AS VARCHAR), '77')")
_search("d17_no_levels", lambda: P.levels(), "false")
_search("d18_source", lambda: P.source("SVC3") & P.levels("error"), "server_id = 'svc3' AND level = 'error'")
_search("d19_session", lambda: P.sessions("2024-01-02", "2024-01-09"), "session_id IN ('2024-01-02', '2024-01-09')")
_search("d_any_of_all", lambda: (P.has("level", "error") & P.compares("durationMs", ">", 200) & P.exclude(P.has("user_id", "3"))) | P.has("event_type", "purchase"), "(level = 'error' AND value > 200 AND NOT contains(CAST(user_id AS VARCHAR), '3')) OR event_type = 'purchase'")


@query("d22_rules", f"WITH {EV} SELECT server_id, count(*) FILTER (level = 'error') AS failures, count(*) FILTER (value > 300) AS slow, count(*) FILTER (event_type = 'purchase' AND value < 5) AS cheap FROM ev GROUP BY server_id")
def rules(spark, d):
    """Several stored searches over one pass."""
    named = {"failures": P.levels("error"), "slow": P.compares("durationMs", ">", 300), "cheap": P.has("event_type", "purchase") & P.compares("durationMs", "<", 5)}
    return tables.events(spark, d).groupBy("server_id").agg(*[F.count_if(c).alias(n) for n, c in named.items()])


@query("e2_columns", f"WITH {EV} SELECT id, CAST(user_id AS VARCHAR) AS user_id, CAST(status AS VARCHAR) AS status, server_id AS server FROM ev")
def columns(spark, d):
    """Some fields as columns, by alias."""
    return tables.events(spark, d).select("id", fields.field("user_id").alias("user_id"), fields.field("status").alias("status"), fields.field("serverId").alias("server"))


@query("e4_fields", f"""WITH {EV}, f AS (SELECT 'user_id' AS name, CAST(user_id AS VARCHAR) AS value FROM ev UNION ALL SELECT 'event_type', event_type FROM ev UNION ALL SELECT 'durationMs', CAST(value AS VARCHAR) FROM ev
  UNION ALL SELECT 'k', k FROM ev UNION ALL SELECT 'statusCode', CAST(status AS VARCHAR) FROM ev) SELECT name, count(*) AS events, count(DISTINCT value) AS distinct_values FROM f GROUP BY name""")
def field_catalogue(spark, d):
    return analytics.field_counts(tables.events(spark, d))


@query("e6_suggestions", f"WITH {EV} SELECT k AS value, count(*) AS events, min(id) AS first_id FROM ev WHERE k LIKE '1%' GROUP BY k ORDER BY events DESC, first_id LIMIT 20")
def suggestions(spark, d):
    return analytics.suggestions(tables.events(spark, d), "k", "1")


@query("f6_crash_links", f"""WITH {EV}, l AS (SELECT *, event_type <> 'view' AS structured FROM ev), w AS (SELECT id, event_type, ts_ms, server_id, session_id,
  (SELECT max(p.id) FROM l p WHERE p.structured AND p.server_id = l.server_id AND p.session_id = l.session_id AND p.id < l.id) AS last_id FROM l),
  m AS (SELECT w.id AS crash_id, e.id AS error_id FROM w JOIN ev e ON e.id = w.last_id WHERE w.event_type = 'view' AND e.level = 'error' AND w.ts_ms - e.ts_ms <= 1800000)
  SELECT min(crash_id) AS crash_id, error_id FROM m GROUP BY error_id""")
def crash_links(spark, d):
    view = F.element_at("fields", "event_type") == "view"
    return pages.crash_links(tables.events(spark, d), ~view, view, 1_800_000)


@query("f8_changed_lines", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM (SELECT s_suppkey AS k, (s_suppkey * 37) % 1500 AS a, (s_suppkey * 37) % 1500 + 120 AS b FROM supplier) r WHERE r.k = l.l_suppkey AND l.l_partkey BETWEEN r.a AND r.b)")
def changed_lines(spark, d):
    """Places inside the ranges of their key: lines by supplier and part number."""
    lines = tables.read(spark, d, "lineitem")
    ranges = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") * 37 % 1500).alias("a"), (F.col("s_suppkey") * 37 % 1500 + 120).alias("b"))
    return pages.in_ranges(lines, ranges, "l_suppkey", "l_partkey", "a", "b", 100).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f9_compare", f"""WITH {EV}, s AS (SELECT lower(regexp_replace(regexp_replace(trim(message), '(?i)[0-9a-f]{{8,}}(?:-[0-9a-f]{{4,}})*', '<id>', 'g'), '(?i)[0-9]+(?:[.,:][0-9]+)*(?:[a-zµ]{{1,3}}\\b|%)?', '<n>', 'g')) || CASE WHEN user_id % 7 = 0 THEN '' ELSE '' END AS signature, session_id FROM ev WHERE level = 'error' OR status >= 500),
  c AS (SELECT signature, count(*) FILTER (session_id = '2024-01-03') AS baseline, count(*) FILTER (session_id = '2024-01-28') AS latest, count(*) FILTER (session_id NOT IN ('2024-01-03', '2024-01-28')) AS earlier FROM s GROUP BY signature)
  SELECT *, CASE WHEN baseline > 0 AND latest > 0 THEN 'reproduced' WHEN baseline > 0 AND earlier > 0 THEN 'fixed' WHEN baseline > 0 THEN 'notSeen' WHEN latest > 0 AND earlier = 0 THEN 'new' ELSE 'localOnly' END AS verdict FROM c""".replace(" || CASE WHEN user_id % 7 = 0 THEN '' ELSE '' END", ""))
def compare(spark, d):
    return analytics.compare_sessions(tables.events(spark, d), "2024-01-03", "2024-01-28")


RANGE = """n AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.005) AS BIGINT) AS cut FROM ev WHERE ts_ms IS NOT NULL), o AS (SELECT ts_ms, row_number() OVER (ORDER BY ts_ms) - 1 AS r FROM ev WHERE ts_ms IS NOT NULL),
  e AS (SELECT cut, min(ts_ms) FILTER (r = 0) AS least, min(ts_ms) FILTER (r = cut) AS lo, min(ts_ms) FILTER (r = n - 1 - cut) AS hi, min(ts_ms) FILTER (r = n - 1) AS most FROM o, n GROUP BY cut),
  rng AS (SELECT min(ts_ms) AS low, max(ts_ms) AS high FROM ev, e WHERE NOT (cut > 0 AND hi - lo < (most - least) / 2) OR ts_ms BETWEEN lo - greatest(1000, (hi - lo) * 0.1) AND hi + greatest(1000, (hi - lo) * 0.1))"""


@query("g1_time_range", f"WITH {EV}, {RANGE} SELECT low, high FROM rng")
def time_range(spark, d):
    return analytics.time_range(tables.events(spark, d))


@query("g1_time_range_trimmed", f"WITH ev0 AS (WITH {EV} SELECT * FROM ev), ev AS (SELECT * REPLACE (CASE WHEN id < 20 THEN ts_ms - 1e11 ELSE ts_ms END AS ts_ms) FROM ev0), {RANGE} SELECT low, high FROM rng")
def time_range_trimmed(spark, d):
    """With a few rows years earlier."""
    far = F.when(F.col("id") < 20, F.col("ts_ms") - 1e11).otherwise(F.col("ts_ms"))
    return analytics.time_range(tables.events(spark, d).withColumn("ts_ms", far))


BUCKETED = f"{EV}, {RANGE}, b AS (SELECT ev.*, CAST(least(29, floor((ts_ms - low) / greatest(1, (high - low) / 30))) AS INT) AS bucket FROM ev, rng WHERE ts_ms BETWEEN low AND high)"


@query("g3_volume", f"""WITH {BUCKETED}, c AS (SELECT i.bucket, count(b.id) AS events, count(b.id) FILTER (level = 'error' OR status >= 500) AS errors, count(b.id) FILTER (level = 'warn' AND NOT status >= 500) AS warnings
  FROM (SELECT CAST(range AS INT) AS bucket FROM range(30)) i LEFT JOIN b ON b.bucket = i.bucket GROUP BY i.bucket), s AS (SELECT avg(events) AS me, stddev_pop(events) AS de, avg(errors) AS mr, stddev_pop(errors) AS dr FROM c)
  SELECT bucket, events, errors, warnings, events >= 3 AND events > me + greatest(2.5 * de, 0.5 * me, 1) AS peak_events, errors >= 3 AND errors > mr + greatest(2.5 * dr, 0.5 * mr, 1) AS peak_errors FROM c, s""")
def volume(spark, d):
    return analytics.volume(tables.events(spark, d))


@query("g5_latency", f"WITH {BUCKETED} SELECT bucket, count(*) AS n, list_sort(list(value))[CAST(least(count(*) - 1, floor(count(*) * 0.95)) AS INT) + 1] AS p95, round(avg(value), 6) AS average FROM b GROUP BY bucket")
def latency(spark, d):
    return analytics.latency(tables.events(spark, d)).withColumn("average", F.round("average", 6))


@query("g6_percentiles", "SELECT count(*) AS n, " + ", ".join(f"list_sort(list(value))[CAST(least(count(*) - 1, floor(count(*) * {p / 100})) AS INT) + 1] AS p{p}" for p in (50, 95, 99)) + " FROM events")
def percentiles(spark, d):
    return analytics.percentiles(tables.events(spark, d))


@query("g7_statuses", f"WITH {EV} SELECT CAST(status AS BIGINT) AS status, count(*) AS events, min(id) AS first_id FROM ev GROUP BY status")
def statuses(spark, d):
    return analytics.statuses(tables.events(spark, d))


TEMPLATE = r"""lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '(?i)[0-9a-f]{{8,}}(?:-[0-9a-f]{{4,}})*', '<id>', 'g'), '(?i)[0-9]+(?:[.,:][0-9]+)*(?:[a-zµ]{{1,3}}\b|%)?', '<n>', 'g'), '([A-Za-z]:)?[\\/]?[^\s:]+[\\/][^\s:]+', '<path>', 'g'), '\s+', ' ', 'g'))"""
LINE = r"regexp_replace(split_part({0}, chr(10), 1), '\r$', '')"


@query("g10_patterns", f"""WITH {EV}, t AS (SELECT id, {LINE.format('message')} AS line, {TEMPLATE.format(LINE.format('message'))} AS pattern FROM ev)
  SELECT pattern, count(*) AS events, min(id) AS first_id, max(id) AS last_id, array_to_string(list_sort(list(id))[1:5], ',') AS samples, arg_min(line, id) AS first_line FROM t GROUP BY pattern ORDER BY events DESC, pattern LIMIT 20""")
def patterns(spark, d):
    return analytics.patterns(tables.events(spark, d), "message", "id")


@query("g12_trend", f"""WITH {EV}, {RANGE}, b AS (SELECT ev.*, CAST(least(9, floor((ts_ms - low) / greatest(1, (high - low) / 10))) AS INT) AS bucket, low, high FROM ev, rng WHERE ts_ms BETWEEN low AND high),
  f AS (SELECT message AS key, min(ts_ms) AS first, max(low) AS low, max(high) AS high FROM b GROUP BY message) SELECT b.message AS key, bucket, count(*) AS events, any_value(f.high - f.low >= 60000 AND first >= f.low + 0.75 * (f.high - f.low)) AS is_new FROM b JOIN f ON f.key = b.message GROUP BY b.message, bucket""")
def trend(spark, d):
    return analytics.trend(tables.events(spark, d), F.col("message"))


@query("g14_facets", f"""WITH {EV}, f AS (SELECT 'event_type' AS name, event_type AS value FROM ev UNION ALL SELECT 'k', k FROM ev UNION ALL SELECT 'statusCode', CAST(status AS VARCHAR) FROM ev), c AS (SELECT name, value, count(*) AS events FROM f GROUP BY name, value)
  SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY events DESC, value) AS INT) AS place FROM c QUALIFY place <= 5""")
def facets(spark, d):
    return analytics.facets(tables.events(spark, d), ["event_type", "k", "statusCode"])


@query("g26_counts", f"WITH {EV} SELECT server_id, session_id, count(*) AS events, count(*) FILTER (level = 'error') AS errors FROM ev GROUP BY server_id, session_id")
def counts(spark, d):
    return tables.events(spark, d).groupBy("server_id", "session_id").agg(F.count("*").alias("events"), F.count_if(F.col("level") == "error").alias("errors"))


@query("g21_nearest_rank", "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def nearest_rank(spark, d):
    from lumenlog.operators.ranks import ceil_rank, nth_values

    return nth_values(tables.read(spark, d, "events"), ["event_type"], "value", {"p50": ceil_rank(0.5), "p95": ceil_rank(0.95)})


@query("h1_context", f"""WITH {EV}, n AS (SELECT id, server_id, session_id, row_number() OVER (PARTITION BY server_id, session_id ORDER BY id) AS place FROM ev)
  SELECT a.id AS anchor, n.id, CAST(n.place - a.place AS INT) AS distance FROM n a JOIN n ON n.server_id = a.server_id AND n.session_id = a.session_id AND abs(n.place - a.place) <= 25 WHERE a.id % 100 = 0""")
def context(spark, d):
    rows = tables.events(spark, d)
    return pages.context(rows, rows.where("id % 100 = 0")).withColumn("distance", F.col("distance").cast("int"))


@query("h1_context_all", f"""WITH {EV}, n AS (SELECT id, server_id, session_id, row_number() OVER (PARTITION BY server_id, session_id ORDER BY id) AS place FROM ev)
  SELECT a.id AS anchor, n.id, CAST(n.place - a.place AS INT) AS distance FROM n a JOIN n ON n.server_id = a.server_id AND n.session_id = a.session_id AND abs(n.place - a.place) <= 25""")
def context_all(spark, d):
    """Around every event."""
    rows = tables.events(spark, d)
    return pages.context(rows, rows).withColumn("distance", F.col("distance").cast("int"))


@query("i1_natural_sort", f"WITH {EV} SELECT CAST(row_number() OVER (ORDER BY regexp_extract(message, '^[^0-9]+'), CAST(regexp_extract(message, '([0-9]+)', 1) AS BIGINT), CAST(regexp_extract(message, 'took ([0-9]+)', 1) AS BIGINT), CAST(k AS BIGINT), id) AS INT) AS place, id FROM ev QUALIFY place <= 200")
def natural_sort(spark, d):
    rows = pages.sorted_by(tables.events(spark, d).select("id", "ts_ms", "level", "message", "server_id", "server", "session_id", "fields"), "message", 200)
    return rows.select(F.row_number().over(Window.orderBy(text.natural_key(F.col("message")), "id")).alias("place"), "id")


@query("i1_numeric_sort", "SELECT event_id AS id, value AS duration FROM events ORDER BY value DESC, event_id LIMIT 300")
def numeric_sort(spark, d):
    rows = pages.sorted_by(tables.events(spark, d), "durationMs", 300, descending=True)
    return rows.select("id", F.col("duration_ms").alias("duration"))


@query("i3_page", f"WITH {EV} SELECT id, level, message FROM ev WHERE level <> 'info' AND id < 9000 ORDER BY id DESC LIMIT 1000")
def page(spark, d):
    return pages.newest(tables.events(spark, d), P.levels("error", "warn"), 1000, before=9000).select("id", "level", "message")


@query("j2_without_source", f"WITH {EV} SELECT id, server_id FROM ev WHERE server_id NOT IN ('svc1', 'svc4')")
def without_source(spark, d):
    rows = tables.events(spark, d)
    gone = spark.createDataFrame([("svc1",), ("svc4",)], "server_id string")
    return rows.join(F.broadcast(gone), "server_id", "left_anti").select("id", "server_id")


@query("j3_retention", f"""WITH {EV}, s AS (SELECT id, 256 + 2 * (length(message) + length(raw) + length(server_id)) + 5 * 32 + 2 * (length('user_idevent_typedurationMskstatusCode') + length(CAST(user_id AS VARCHAR)) + length(event_type) + length(k) + 3) AS size FROM ev),
  r AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS n, sum(size) OVER (ORDER BY id DESC) AS bytes FROM s) SELECT id FROM r WHERE n <= 3000""")
def retention(spark, d):
    return pages.retained(tables.events(spark, d), 3000, 1 << 40).select("id")


@query("j10_merged_ranges", """WITH r AS (SELECT l_suppkey AS key, l_partkey AS a, l_partkey + l_linenumber * 3 AS b FROM lineitem), m AS (SELECT *, max(b) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
  i AS (SELECT *, sum(CASE WHEN a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT key, min(a) AS a, max(b) AS b FROM i GROUP BY key, island""")
def merged_ranges(spark, d):
    rows = tables.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_linenumber") * 3).alias("b"))
    return pages.merged_ranges(rows, "key", "a", "b")


@query("k1_template", f"SELECT doc_id, md5({TEMPLATE.format(LINE.format('text'))}) AS template_md5 FROM documents")
def templates(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", F.md5(text.template(text.first_line(F.col("text")))).alias("template_md5"))


@query("k26_url_path", r"SELECT page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') AS path FROM pages")
def url_paths(spark, d):
    return tables.read(spark, d, "pages").select("page_id", text.url_path(F.col("url")).alias("path"))


@query("c10_leading_level", r"SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'unclassified' WHEN event_id % 5 IN (1, 2) THEN 'warn' WHEN event_id % 5 = 3 THEN 'error' ELSE 'info' END AS level FROM events")
def leading_levels(spark, d):
    kind = F.col("event_id") % 5
    line = F.when(kind == 0, F.concat(F.lit("plain "), F.col("event_type"))).when(kind == 1, "2024-01-01 10:00:00 WARNING slow").when(kind == 2, "[main] warn: x").when(kind == 3, "[ERROR] failed").otherwise(F.lit("INFO ok"))
    return tables.read(spark, d, "events").select(F.col("event_id").alias("id"), text.leading_level(line).alias("level"))


def _redacted(column: str) -> str:
    for pattern in text.SECRETS.values():
        column = f"regexp_replace({column}, '{pattern}', '\\1{text.REDACTED}', 'g')"
    return column


@query("o3_redact", f"SELECT doc_id, md5({_redacted('text')}) AS redacted_md5 FROM documents")
def redact(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", F.md5(text.redact(F.col("text"))).alias("redacted_md5"))


@query("o6_emails", f"SELECT doc_id, source FROM documents WHERE regexp_matches(text, '{text.EMAIL}') AND NOT regexp_matches(regexp_extract(text, '{text.EMAIL}'), '{text.EXAMPLE_EMAIL}')")
def emails(spark, d):
    return tables.read(spark, d, "documents").where(F.array_contains(text.found_kinds(F.col("text")), "email")).select("doc_id", "source")


@query("g22_sensitive", "SELECT source, kind, count(*) AS documents, max(doc_id) AS last_id FROM (" + " UNION ALL ".join(f"SELECT source, doc_id, '{kind}' AS kind FROM documents WHERE regexp_matches(text, '{p}')" for kind, p in text.SECRETS.items()) + ") GROUP BY source, kind")
def sensitive(spark, d):
    found = tables.read(spark, d, "documents").select("source", "doc_id", F.explode(text.found_kinds(F.col("text"))).alias("kind")).where(~F.col("kind").isin("email", "card"))
    return found.groupBy("source", "kind").agg(F.count("*").alias("documents"), F.max("doc_id").alias("last_id"))


@query("g22_sensitive_kinds")
def sensitive_kinds(spark, d):
    """With personal data: all kinds that are found. Without SQL, which has no Luhn check; tested by brute force."""
    found = tables.read(spark, d, "documents").select("source", "doc_id", F.explode(text.found_kinds(F.col("text"))).alias("kind"))
    return found.groupBy("source", "kind").agg(F.count("*").alias("documents"), F.max("doc_id").alias("last_id"))


@query("p3_noisy", f"WITH {EV}, c AS (SELECT event_type AS statement, count(*) AS hits, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM ev WHERE level IN ('info', 'warn') GROUP BY event_type) SELECT statement, hits, round(share, 6) AS share FROM c WHERE hits >= 500 AND share >= 0.2")
def noisy(spark, d):
    """Statements that make a large share of a log without being failures."""
    counted = tables.events(spark, d).where(P.levels("info", "warn")).groupBy(F.element_at("fields", "event_type").alias("statement")).agg(F.count("*").alias("hits"))
    total = counted.agg(F.sum("hits").alias("all"))
    shared = counted.join(F.broadcast(total)).withColumn("share", F.col("hits") / F.col("all"))
    return shared.where("hits >= 500 AND share >= 0.2").select("statement", "hits", F.round("share", 6).alias("share"))


SPANS = """day AS (SELECT l_orderkey AS trace_id, l_orderkey || '-' || l_linenumber AS span_id, CAST(l_orderkey AS VARCHAR) AS parent_id, l_linestatus AS name, 'warehouse' AS service,
  CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS start_ms, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + l_quantity AS end_ms, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS status_code FROM lineitem),
  lasts AS (SELECT trace_id, max(end_ms) AS last FROM day GROUP BY trace_id), ord AS (SELECT o_orderkey AS trace_id, CAST(o_orderkey AS VARCHAR) AS span_id, CAST(NULL AS VARCHAR) AS parent_id, o_orderpriority AS name, 'orders' AS service,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS start_ms, greatest(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)), coalesce(last, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)))) AS end_ms, 0 AS status_code FROM orders LEFT JOIN lasts ON lasts.trace_id = o_orderkey),
  spans0 AS (SELECT * FROM ord UNION ALL SELECT * FROM day), spans AS MATERIALIZED (SELECT * FROM spans0 QUALIFY row_number() OVER (PARTITION BY trace_id, span_id ORDER BY start_ms, end_ms, name, status_code) = 1),
  rooted AS (SELECT s.* REPLACE (CASE WHEN p.span_id IS NOT NULL THEN s.parent_id END AS parent_id) FROM spans s LEFT JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_id)"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return traces.distinct_spans(tables.spans(spark, d))


@query("j5_distinct_spans", f"WITH {SPANS} SELECT trace_id, count(*) AS spans FROM spans GROUP BY trace_id")
def distinct_spans(spark, d):
    return _spans(spark, d).groupBy("trace_id").agg(F.count("*").alias("spans"))


@query("r1_waterfall", f"""WITH {SPANS}, w AS (SELECT trace_id, span_id, CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END AS depth, start_ms, end_ms, coalesce(parent_id, span_id) AS top FROM rooted),
  t AS (SELECT w.*, r.start_ms AS rs, r.end_ms AS re FROM w JOIN rooted r ON r.trace_id = w.trace_id AND r.span_id = w.top)
  SELECT trace_id, span_id, CAST(depth AS INT) AS depth, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY rs, re, top, depth, start_ms, end_ms, span_id) AS INT) AS ordinal, start_ms - min(start_ms) OVER (PARTITION BY trace_id) AS offset_ms FROM t""")
def waterfall(spark, d):
    return traces.waterfall(_spans(spark, d))


@query("r2_critical_path", f"""WITH {SPANS}, root AS (SELECT * FROM rooted WHERE parent_id IS NULL QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY end_ms DESC, start_ms, span_id) = 1),
  child AS (SELECT * FROM rooted WHERE parent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trace_id, parent_id ORDER BY end_ms DESC, start_ms DESC, span_id DESC) = 1)
  SELECT trace_id, span_id, CAST(0 AS INT) AS step FROM root UNION ALL SELECT c.trace_id, c.span_id, CAST(1 AS INT) FROM child c JOIN root r ON r.trace_id = c.trace_id AND r.span_id = c.parent_id""")
def critical_path(spark, d):
    return traces.critical_paths(_spans(spark, d))


SELF = f"""{SPANS}, cl AS (SELECT s.trace_id, s.parent_id, greatest(s.start_ms, p.start_ms) AS a, least(s.end_ms, p.end_ms) AS b FROM spans s JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_id WHERE least(s.end_ms, p.end_ms) > greatest(s.start_ms, p.start_ms)),
  fr AS (SELECT *, max(b) OVER (PARTITION BY trace_id, parent_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cl), co AS (SELECT trace_id, parent_id, sum(greatest(0, b - greatest(a, coalesce(before, a)))) AS covered FROM fr GROUP BY trace_id, parent_id),
  st AS (SELECT s.*, greatest(0, s.end_ms - s.start_ms - coalesce(covered, 0)) AS self_ms FROM spans s LEFT JOIN co ON co.trace_id = s.trace_id AND co.parent_id = s.span_id)"""


@query("r3_self_time", f"WITH {SELF} SELECT trace_id, span_id, CAST(self_ms AS DOUBLE) AS self_ms FROM st")
def self_time(spark, d):
    return traces.self_times(_spans(spark, d)).select("trace_id", "span_id", "self_ms")


@query("g17_hotspots", f"""WITH {SELF}, g AS (SELECT service, name, count(*) AS spans, CAST(sum(self_ms) AS DOUBLE) AS self_ms, count(*) FILTER (status_code = 2) AS errors FROM st GROUP BY service, name)
  SELECT *, floor(self_ms / sum(self_ms) OVER () * 1000 + 0.5) / 1000 AS share FROM g WHERE self_ms > 0 ORDER BY self_ms DESC, name LIMIT 8""")
def hotspots(spark, d):
    return traces.hotspots(_spans(spark, d))


@query("g16_trace_summaries", f"""WITH {SPANS} SELECT trace_id, arg_min(name, (start_ms, end_ms, span_id)) FILTER (parent_id IS NULL) AS root_name, arg_min(service, (start_ms, end_ms, span_id)) FILTER (parent_id IS NULL) AS root_service,
  array_to_string(list_sort(list(DISTINCT service)), ',') AS services, min(start_ms) AS start_ms, max(end_ms) - min(start_ms) AS duration_ms, count(*) AS spans, count(*) FILTER (status_code = 2) AS errors FROM rooted GROUP BY trace_id""")
def trace_summaries(spark, d):
    return traces.summaries(_spans(spark, d))


COUNTERS = "pts AS (SELECT user_id AS series, event_id AS id, epoch_us(ts) / 1000.0 AS time_ms, value, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total FROM events)"


@query("s4_rates", f"WITH {COUNTERS}, l AS (SELECT *, lag(total) OVER w AS b, lag(time_ms) OVER w AS t FROM pts WINDOW w AS (PARTITION BY series ORDER BY time_ms, id)) SELECT series, id, round(CASE WHEN (time_ms - t) / 1000 > 0 THEN (CASE WHEN total >= b THEN total - b ELSE total END) / ((time_ms - t) / 1000) END, 6) AS rate FROM l")
def rates(spark, d):
    return metrics.rates(tables.counters(spark, d)).select("series", "id", F.round("rate", 6).alias("rate"))


BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


def _percentile_sql() -> str:
    edges = [None, *BOUNDS, None]
    counts = ", ".join(f"count(*) FILTER ({' AND '.join([f'value > {a}'] * (a is not None) + [f'value <= {b}'] * (b is not None))}) AS c{i}" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    lower, upper = [BOUNDS[0], *BOUNDS], [*BOUNDS, BOUNDS[-1]]
    cases, seen = "", "0"
    for i in range(len(BOUNDS) + 1):
        cases += f" WHEN c{i} > 0 AND {seen} + c{i} >= r THEN {lower[i]} + ({upper[i]} - {lower[i]}) * ((r - ({seen})) / c{i})"
        seen += f" + c{i}"
    return f"WITH h AS (SELECT user_id, {counts}, count(*) * 0.95 AS r FROM events GROUP BY user_id) SELECT user_id, round(CASE{cases} END, 6) AS p95 FROM h"


@query("k7_histogram_p95", _percentile_sql())
def histogram_p95(spark, d):
    counted = metrics.histograms(tables.read(spark, d, "events"), ["user_id"], "value", BOUNDS)
    return counted.select("user_id", F.round(metrics.histogram_percentile(BOUNDS, F.col("counts"), 0.95), 6).alias("p95"))


@query("h10_thinned", f"WITH {COUNTERS}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY time_ms, id) - 1 AS i, count(*) OVER (PARTITION BY series) AS c FROM pts), k AS (SELECT range AS k FROM range(20)) SELECT series, id FROM n WHERE c <= 20 OR EXISTS (SELECT 1 FROM k WHERE floor(k * (c - 1) / 19.0 + 0.5) = i)")
def thinned(spark, d):
    return metrics.thinned(tables.counters(spark, d), "series", ["time_ms", "id"], 20).select("series", "id")


CALLS = "cl AS (SELECT conv_id AS conversation, turn, role, CAST(floor(length(coalesce(text, '')) / 4) AS BIGINT) AS tokens, text FROM conversations)"


@query("g18_call_totals", f"WITH {CALLS} SELECT role, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, " + ", ".join(f"CAST(list_sort(list(tokens))[CAST(least(count(*) - 1, floor(count(*) * {p / 100})) AS INT) + 1] AS DOUBLE) AS p{p}" for p in (50, 95)) + " FROM cl GROUP BY role")
def call_totals(spark, d):
    return calls.totals(tables.calls(spark, d))


@query("h7_call_positions", f"WITH {CALLS} SELECT conversation, turn, role, CAST(row_number() OVER (PARTITION BY conversation, role ORDER BY turn, tokens, text) AS INT) AS place, count(*) OVER (PARTITION BY conversation, role) AS of FROM cl")
def call_positions(spark, d):
    return calls.positions(tables.calls(spark, d)).select("conversation", "turn", "role", "place", "of")


@query("q_conversations", f"WITH {CALLS} SELECT conversation, count(*) AS turns, CAST(sum(tokens) AS BIGINT) AS tokens, count(DISTINCT role) AS roles FROM cl GROUP BY conversation")
def conversation_totals(spark, d):
    return calls.conversations(tables.calls(spark, d)).drop("first_role")


def _line(kind: str) -> Column:
    """A log line of each form, made from a row of ``events``."""
    k = F.get_json_object("props", "$.k")
    user, number = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    if kind == "json":
        context_ = F.struct(F.struct(F.col("user_id").alias("id")).alias("user"), k.alias("k"))
        return F.to_json(F.struct(F.col("event_type").alias("msg"), F.when(F.col("event_type") == "error", "CRITICAL").otherwise("Warning").alias("severity"), F.col("event_id").alias("n"), context_.alias("ctx")))
    if kind == "logfmt":
        return F.concat(F.lit("level=debug n="), number, F.lit(' msg="user \\"'), user, F.lit('\\" did '), F.col("event_type"), F.lit('" k='), k, F.lit(" k=again"))
    prefix = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("shop_api_"), user, F.lit("  | "))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("[pod/web-"), user, F.lit("/main] 2024-01-01T00:00:00.123456789Z "))).otherwise(F.lit("a | b "))
    return F.concat(prefix, F.col("event_type"))


@query("c6_json_lines", f"WITH {EV} SELECT id, CASE WHEN event_type = 'error' THEN 'fatal' ELSE 'warn' END AS level, event_type AS message, true AS is_json, CAST(user_id AS VARCHAR) AS user_path, CAST(user_id AS VARCHAR) AS user_leaf, k FROM ev")
def json_lines(spark, d):
    rows = tables.read(spark, d, "events").select(F.col("event_id").alias("id"), _line("json").alias("line"))
    got = lambda n: F.element_at("fields", n)
    return lines.parse(rows).select("id", "level", "message", "is_json", got("ctx.user.id").alias("user_path"), got("id").alias("user_leaf"), got("k").alias("k"))


@query("c7_logfmt", f"WITH {EV} SELECT id, 'debug' AS level, 'user \"' || user_id || '\" did ' || event_type AS message, k, CAST(id AS VARCHAR) AS n, 4 AS pairs FROM ev")
def logfmt(spark, d):
    rows = tables.read(spark, d, "events").select(F.col("event_id").alias("id"), _line("logfmt").alias("line"))
    return lines.parse(rows).select("id", "level", "message", F.element_at("fields", "k").alias("k"), F.element_at("fields", "n").alias("n"), F.size("fields").alias("pairs"))


@query("c3_container_prefix", """SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'main' END AS service, CASE event_id % 3 WHEN 0 THEN 'shop_api_' || user_id WHEN 1 THEN 'pod/web-' || user_id || '/main' END AS container,
  CASE WHEN event_id % 3 = 1 THEN '2024-01-01T00:00:00.123456789Z' END AS time, CASE WHEN event_id % 3 = 2 THEN 'a | b ' ELSE '' END || event_type AS payload FROM events""")
def container_prefix(spark, d):
    rows = tables.read(spark, d, "events").select(F.col("event_id").alias("id"), lines.container_prefix(_line("prefix")).alias("p"))
    return rows.select("id", "p.*")


@query("c4_stack_traces", "SELECT user_id, event_id * 10 AS first, CAST(CASE WHEN event_type = 'error' THEN 3 ELSE 1 END AS INT) AS n_lines, CASE WHEN event_type = 'error' THEN 'Error: ' || user_id || chr(10) || '    at f (a.js:1:2)' || chr(10) || 'Caused by: ' || event_type ELSE event_type END AS text FROM events")
def stack_traces(spark, d):
    several = F.array(F.concat(F.lit("Error: "), F.col("user_id").cast("string")), F.lit("    at f (a.js:1:2)"), F.concat(F.lit("Caused by: "), F.col("event_type")))
    rows = tables.read(spark, d, "events").select("user_id", "event_id", F.posexplode(F.when(F.col("event_type") == "error", several).otherwise(F.array("event_type"))).alias("i", "line"))
    return lines.joined_traces(rows.select("user_id", (F.col("event_id") * 10 + F.col("i")).alias("seq"), "line"), "user_id", "seq", "line")


@query("c18_otlp_spans", """SELECT lpad(lower(to_hex(o_orderkey + 1)), 32, '0') AS trace_id, lpad(lower(to_hex(o_orderkey + 1)), 16, '0') AS span_id, CAST(NULL AS VARCHAR) AS parent_id, o_orderpriority AS name, 'orders' AS service,
  CAST((o_orderkey + 1) * 1000 AS DOUBLE) AS start_ms, (o_orderkey + 1) * 1000 + 0.25 AS end_ms, o_orderstatus AS status FROM orders""")
def otlp_spans(spark, d):
    key = F.col("o_orderkey") + 1
    text_value = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    span = F.struct(
        F.lpad(F.hex(key), 32, "0").alias("traceId"),
        F.base64(F.unhex(F.lpad(F.hex(key), 16, "0"))).alias("spanId"),
        F.lit("0000000000000000").alias("parentSpanId"),
        F.col("o_orderpriority").alias("name"),
        F.concat((key * 1000).cast("string"), F.lit("000000")).alias("startTimeUnixNano"),
        F.concat((key * 1000).cast("string"), F.lit("250999")).alias("endTimeUnixNano"),
        F.array(text_value("status", F.col("o_orderstatus"))).alias("attributes"),
    )
    resource = F.struct(F.array(text_value("service.name", F.lit("orders"))).alias("attributes"))
    payload = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    read = otlp.spans(tables.read(spark, d, "orders").select(payload.alias("body")), "body")
    return read.select("trace_id", "span_id", "parent_id", "name", "service", "start_ms", "end_ms", F.element_at("attributes", "status").alias("status"))


@query("c20_trace_parents", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN md5(CAST(event_id AS VARCHAR)) END AS trace_id FROM events")
def trace_parents(spark, d):
    header = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("00-"), F.md5(F.col("event_id").cast("string")), F.lit("-00f067aa0ba902b7-01"))).otherwise(F.lit("broken"))
    found = F.regexp_extract(header, "^[0-9a-f]{2}-([0-9a-f]{32})-[0-9a-f]{16}-[0-9a-f]{2}$", 1)
    return tables.read(spark, d, "events").select(F.col("event_id").alias("id"), F.nullif(found, F.lit("")).alias("trace_id"))


@query("g11_error_groups", """WITH t AS (SELECT event_id AS id, 'kind' || chr(97 + CAST(user_id % 4 AS INT)) || ': bad value <n>' AS template, CASE WHEN event_id % 2 = 0 THEN '/srv/db' || (user_id % 4) || (CASE WHEN user_id % 4 = 3 THEN '_' || (event_id % 4) ELSE '' END) || '.js:12' END AS location,
  'kind' || chr(97 + CAST(user_id % 4 AS INT)) AS kind FROM events WHERE event_type = 'error'), k AS (SELECT *, CASE WHEN location IS NOT NULL THEN kind || '@' || location ELSE template END AS key0 FROM t),
  o AS (SELECT template, min(key0) AS owner FROM k WHERE location IS NOT NULL GROUP BY template HAVING count(DISTINCT key0) = 1), p AS (SELECT k.*, CASE WHEN location IS NULL THEN coalesce(owner, key0) ELSE key0 END AS key FROM k LEFT JOIN o ON o.template = k.template)
  SELECT key, count(*) AS events, min(id) AS first_id, max(id) AS last_id, max(location) AS location, array_to_string(list_sort(list(id))[1:5], ',') AS samples FROM p GROUP BY key""")
def error_groups(spark, d):
    user, id = F.col("user_id"), F.col("event_id")
    file = F.concat(F.lit("/srv/db"), (user % 4).cast("string"), F.when(user % 4 == 3, F.concat(F.lit("_"), (id % 4).cast("string"))).otherwise(""), F.lit(".js"))
    first = F.concat(F.lit("Kind"), F.element_at(F.array(*map(F.lit, "abcd")), (user % 4 + 1).cast("int")), F.lit(": bad value "), user.cast("string"))
    stack = F.when(id % 2 == 0, F.concat(F.lit("\n    at run ("), file, F.lit(":12:5)"))).otherwise("")
    rows = tables.read(spark, d, "events").where("event_type = 'error'").select(id.alias("id"), F.concat(first, stack).alias("text"))
    return errors.error_groups(rows)


@query("c25_requests", """WITH e AS (SELECT user_id % 10 AS tab, event_id // 3 AS request, CAST(event_id % 2 AS INT) AS hop, CASE event_type WHEN 'click' THEN 'sent' WHEN 'view' THEN 'response' WHEN 'error' THEN 'failed' ELSE 'finished' END AS kind, epoch_us(ts) / 1000.0 AS ts_ms, 'u' || user_id AS url, CAST(200 + event_id % 300 AS INT) AS status FROM events),
  g AS (SELECT tab, request, hop, min(ts_ms) FILTER (kind = 'sent') AS s, max(ts_ms) FILTER (kind IN ('finished', 'failed')) AS f, max(url) FILTER (kind = 'sent') AS url, max(status) FILTER (kind = 'response') AS status, bool_or(kind = 'failed') AS failed FROM e GROUP BY ALL)
  SELECT tab, request, hop, url, status, f - s AS duration_ms, CASE WHEN failed THEN 'failed' WHEN f IS NULL THEN 'pending' WHEN status >= 400 THEN 'error' ELSE 'ok' END AS state FROM g""")
def request_join(spark, d):
    kind = F.col("event_type")
    named = F.when(kind == "click", "sent").when(kind == "view", "response").when(kind == "error", "failed").otherwise("finished")
    rows = tables.read(spark, d, "events").select((F.col("user_id") % 10).alias("tab"), F.floor(F.col("event_id") / 3).alias("request"), (F.col("event_id") % 2).cast("int").alias("hop"), named.alias("kind"), tables.millis("ts").alias("ts_ms"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), (200 + F.col("event_id") % 300).cast("int").alias("status"))
    return requests.requests(rows)


SITES = [(1, "error by user * took *ms"), (2, "purchase by user *"), (3, "by user * took *ms k=*"), (4, "view by user * k=7*"), (5, "signup by user 1*"), (6, "signup by user *1")]
SITE_SQL = "st(site, rx, score) AS (VALUES " + ", ".join(f"({n}, '{p.replace('*', '.*')}', {len(p.replace('*', ''))})" for n, p in SITES) + ")"
ATTRIBUTED = f"{EV}, {SITE_SQL}, h AS (SELECT id, site, score FROM ev JOIN st ON regexp_matches(message, rx)), a AS (SELECT id, min(site) AS site FROM (SELECT * FROM h QUALIFY score = max(score) OVER (PARTITION BY id)) GROUP BY id HAVING count(*) = 1)"


def _sites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = tables.events(spark, d)
    return rows, sites.attributed(rows, spark.createDataFrame(SITES, "site int, pattern string"))


@query("f7_statements", f"WITH {ATTRIBUTED} SELECT id, site FROM a")
def statements(spark, d):
    return _sites(spark, d)[1]


@query("g20_statement_statistics", f"WITH {ATTRIBUTED} SELECT site, count(*) AS hits, count(*) FILTER (level = 'error') AS errors, CAST(0 AS BIGINT) AS quiet, max(ev.id) AS last_id, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM a JOIN ev ON ev.id = a.id GROUP BY site")
def statement_statistics(spark, d):
    rows, found = _sites(spark, d)
    return sites.statistics(rows, found)


@query("p3_noisy_statements", f"WITH {ATTRIBUTED}, c AS (SELECT site, count(*) AS hits, count(*) FILTER (level = 'error') AS errors FROM a JOIN ev ON ev.id = a.id GROUP BY site) SELECT site, hits, 'noisy' AS rule FROM c WHERE hits >= 500 AND errors = 0 AND hits >= 0.3 * (SELECT sum(hits) FROM c)")
def noisy_statements(spark, d):
    rows, found = _sites(spark, d)
    return sites.findings(sites.statistics(rows, found))


def _metric_points(rows: DataFrame) -> DataFrame:
    attribute = F.struct(F.lit("type").alias("key"), F.struct(F.col("event_type").alias("stringValue")).alias("value"))
    point = F.struct(F.concat(((F.col("event_id") + 1) * 1000).cast("string"), F.lit("000000")).alias("timeUnixNano"), F.col("event_id").cast("string").alias("asInt"), F.array(attribute).alias("attributes"))
    metric = F.struct(F.lit("requests").alias("name"), F.struct(F.lit(True).alias("isMonotonic"), F.array(point).alias("dataPoints")).alias("sum"))
    payload = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics")))
    return otlp.metric_points(rows.select(payload.alias("body")), "body").select("name", "kind", "monotonic", "time_ms", "value", F.element_at("attributes", "type").alias("attribute"))


@query("c23_metric_points", "SELECT 'requests' AS name, 'sum' AS kind, true AS monotonic, CAST((event_id + 1) * 1000 AS DOUBLE) AS time_ms, CAST(event_id AS DOUBLE) AS value, event_type AS attribute FROM events")
def metric_points(spark, d):
    return _metric_points(tables.read(spark, d, "events"))


@query("o2_assignments", """SELECT event_id AS id, 'login user=u' || user_id || ' password=[REDACTED] api_key: "[REDACTED]", max_tokens=' || event_id || ' Authorization: [REDACTED] db_pwd=[REDACTED]; {"secret":"[REDACTED]","kind":"' || event_type || '"} cookie=[REDACTED]' AS redacted FROM events""")
def redacted_assignments(spark, d):
    """Assignments of sensitive keys in texts that carry them in every form."""
    own = F.format_string('login user=u%d password=p%d api_key: "k \\" %d", max_tokens=%d Authorization: Bearer abc%d db_pwd=x%d; {"secret":"s%d","kind":"%s"} cookie={"a": [%d]}', *["user_id"] + ["event_id"] * 6, "event_type", "event_id")
    return tables.read(spark, d, "events").select(F.col("event_id").alias("id"), redaction.redact_assignments(own).alias("redacted"))


@query("o4_fields", """SELECT event_id AS id, 'auth.token=[REDACTED]|auth.user=u' || user_id || '|max_tokens=' || event_id || '|note=key [REDACTED]|token=[REDACTED]|Api-Key=[REDACTED]|twin=[REDACTED]|x.secret.twin=[REDACTED]' AS redacted FROM events""")
def redacted_fields(spark, d):
    """Fields by name, by configured name, and as twins of sensitive paths."""
    n = F.col("event_id").cast("string")
    of = {"auth.token": F.concat(F.lit("t"), n), "auth.user": F.concat(F.lit("u"), F.col("user_id")), "max_tokens": n, "note": F.concat(F.lit("key AKIA"), F.lpad(n, 16, "0")), "token": F.concat(F.lit("t"), n), "Api-Key": n, "twin": F.concat(F.lit("w"), n), "x.secret.twin": F.concat(F.lit("w"), n)}
    made = F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v)])
    shown = F.array_join(F.transform(F.map_entries(redaction.redact_fields(made)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return tables.read(spark, d, "events").select(F.col("event_id").alias("id"), shown.alias("redacted"))


def _chains(rows: DataFrame) -> DataFrame:
    """Events as spans: each hundred is one chain, whose first span names itself as its parent."""
    n = F.col("event_id")
    return rows.select(F.floor(n / 100).alias("trace_id"), n.cast("string").alias("span_id"), F.when(n % 100 == 0, n).otherwise(n - 1).cast("string").alias("parent_id"), (n % 100).cast("double").alias("start_ms"), F.lit(200.0).alias("end_ms"))


@query("r1_deep_waterfall", "SELECT event_id // 100 AS trace_id, CAST(event_id AS VARCHAR) AS span_id, CAST(event_id % 100 AS INT) AS depth, CAST(event_id % 100 + 1 AS INT) AS ordinal, CAST(event_id % 100 AS DOUBLE) AS offset_ms FROM events")
def deep_waterfall(spark, d):
    """Chains of a hundred spans."""
    return traces.waterfall(_chains(tables.read(spark, d, "events")))


@query("r2_deep_critical_path", "SELECT event_id // 100 AS trace_id, CAST(event_id AS VARCHAR) AS span_id, CAST(event_id % 100 AS INT) AS step FROM events")
def deep_critical_path(spark, d):
    return traces.critical_paths(_chains(tables.read(spark, d, "events")))


def _call_spans(rows: DataFrame) -> DataFrame:
    """Turns of conversations as spans with attributes of five conventions, and calls of no model."""
    n, text_ = F.col("turn"), F.coalesce("text", F.lit(""))
    size, of = F.length(text_).cast("string"), lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k.replace("__", ".")), v if isinstance(v, Column) else F.lit(v))])
    attributes = (
        F.when(n % 6 == 0, of(gen_ai__operation__name="chat", gen_ai__system="acme", gen_ai__request__model="m1", gen_ai__response__model="m2", gen_ai__usage__input_tokens=size, gen_ai__response__finish_reasons='["stop","length"]', gen_ai__prompt__0__content=text_))
        .when(n % 6 == 1, of(gen_ai__provider__name="acme", gen_ai__usage__prompt_tokens="-5", gen_ai__usage__completion_tokens=size, gen_ai__completion__0__finish_reason="stop"))
        .when(n % 6 == 2, of(llm__request__type="completion", llm__request__model="m3", llm__usage__prompt_tokens="many"))
        .when(n % 6 == 3, of(gen_ai__tool__name="search", gen_ai__tool__call__id=F.concat(F.lit("c"), n.cast("string"))))
        .when(n % 6 == 4, of(gen_ai__agent__name="planner", error__type="timeout"))
        .otherwise(of(http__method="GET"))
    )
    name = F.when(n % 6 == 1, "Embeddings m1").otherwise(F.lit("step"))
    return rows.select(F.col("conv_id").alias("trace_id"), n.cast("string").alias("span_id"), name.alias("name"), F.lit("api").alias("service"), n.cast("double").alias("start_ms"), (n + 2.5).alias("end_ms"), F.when(n % 6 == 4, 2).otherwise(0).alias("status_code"), attributes.alias("attributes"))


@query("q3_model_calls", """WITH c AS (SELECT conv_id AS trace_id, turn, turn % 6 AS k, length(coalesce(text, '')) AS size FROM conversations WHERE turn % 6 <> 5)
  SELECT trace_id, CAST(turn AS VARCHAR) AS span_id, ['chat', 'embeddings', 'text_completion', 'execute_tool', 'invoke_agent'][k + 1] AS operation, ['model', 'model', 'model', 'tool', 'agent'][k + 1] AS kind,
  CASE WHEN k < 2 THEN 'acme' END AS provider, CASE k WHEN 0 THEN 'm2' WHEN 2 THEN 'm3' END AS model, CAST(2.5 AS DOUBLE) AS duration_ms, CAST(CASE WHEN k = 0 THEN size END AS DOUBLE) AS input_tokens, CAST(CASE WHEN k = 1 THEN size END AS DOUBLE) AS output_tokens,
  CASE k WHEN 0 THEN 'stop,length' WHEN 1 THEN 'stop' END AS finish_reasons, k = 4 AS error, CASE WHEN k = 4 THEN 'timeout' END AS error_message, k IN (0, 1) AS has_content FROM c""")
def model_call_rows(spark, d):
    """Operation, kind, names, tokens, reasons and content of spans (Q1 to Q4)."""
    found = model_calls.model_calls(_call_spans(tables.read(spark, d, "conversations")))
    return found.select("trace_id", "span_id", "operation", "kind", "provider", "model", "duration_ms", "input_tokens", "output_tokens", F.array_join("finish_reasons", ",").alias("finish_reasons"), "error", "error_message", "has_content")


def _message_spans(rows: DataFrame) -> DataFrame:
    """Turns as spans that carry one question and one tool call, in each of four conventions, and as runs of the tool."""
    n, said = F.col("turn"), F.concat(F.lit("t:"), F.coalesce("text", F.lit("")))
    id, arguments = F.concat(F.lit("c"), n.cast("string")), F.format_string('{"q": %d}', n)
    none = F.lit(None).cast("map<string,string>")
    of = lambda *kv: F.create_map(*[x if isinstance(x, Column) else F.lit(x) for x in kv])
    inner = F.array(F.struct(F.lit("tool_call").alias("type"), id.alias("id"), F.lit("search").alias("name"), F.struct(n.alias("q")).alias("arguments")))
    parts = lambda role, p: F.to_json(F.array(F.struct(F.lit(role).alias("role"), p.alias("parts"))))
    asked = F.array(F.struct(id.alias("id"), F.struct(F.lit("search").alias("name"), arguments.alias("arguments")).alias("function")))
    reply = F.struct(F.lit("assistant").alias("role"), asked.alias("tool_calls"))
    attributes = (
        F.when(n % 5 == 0, of("gen_ai.input.messages", parts("user", F.array(F.struct(F.lit("text").alias("type"), said.alias("content")))), "gen_ai.output.messages", parts("assistant", inner)))
        .when(n % 5 == 1, of("gen_ai.prompt", F.to_json(F.array(F.struct(F.lit("user").alias("role"), said.alias("content")))), "gen_ai.completion", F.to_json(reply)))
        .when(n % 5 == 2, of("gen_ai.prompt.0.role", "user", "gen_ai.prompt.0.content", said, "gen_ai.completion.0.tool_calls.0.name", "search", "gen_ai.completion.0.tool_calls.0.arguments", arguments, "gen_ai.completion.0.tool_calls.0.id", id))
        .when(n % 5 == 4, of("gen_ai.tool.name", "search", "gen_ai.tool.call.id", F.concat(F.lit("c"), (n - 1).cast("string")), "gen_ai.tool.call.result", F.lit("[1, 2]")))
        .otherwise(none)
    )
    event = lambda name, key, value: F.struct(F.lit(name).alias("name"), of(key, value).alias("attributes"))
    events = F.when(n % 5 == 3, F.array(event("gen_ai.user.message", "content", said), event("gen_ai.choice", "message", F.to_json(reply))))
    return rows.select(F.col("conv_id").alias("trace_id"), n.cast("string").alias("span_id"), F.lit("step").alias("name"), F.lit("api").alias("service"), n.cast("double").alias("start_ms"), (n + 1.5).alias("end_ms"), F.lit(0).alias("status_code"), attributes.alias("attributes"), events.alias("events"))


@query("q5_messages", """WITH t AS (SELECT *, CAST(turn AS VARCHAR) AS span_id FROM conversations) SELECT conv_id AS trace_id, span_id, CAST(0 AS INT) AS message, 'user' AS role, false AS output, 'text' AS kind, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS id, 't:' || coalesce(text, '') AS text FROM t WHERE turn % 5 < 4
  UNION ALL SELECT conv_id, span_id, 1, 'assistant', true, 'tool_call', 'search', 'c' || turn, '{"q":' || turn || '}' FROM t WHERE turn % 5 < 4 UNION ALL SELECT conv_id, span_id, 0, 'tool', true, 'tool_result', 'search', 'c' || (turn - 1), '[1,2]' FROM t WHERE turn % 5 = 4""")
def messages(spark, d):
    """Messages from list attributes, chat attributes, numbered attributes, events and tool runs."""
    return model_calls.message_parts(_message_spans(tables.read(spark, d, "conversations"))).drop("part")


@query("f5_tool_runs", """SELECT a.conv_id AS trace_id, CAST(a.turn AS VARCHAR) AS span_id, 'c' || a.turn AS tool_call_id, CAST(min(b.turn) AS VARCHAR) AS run_span_id, CAST(1.5 AS DOUBLE) AS duration_ms FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.turn % 5 = 4 GROUP BY a.conv_id, a.turn""")
def tool_runs(spark, d):
    rows = _message_spans(tables.read(spark, d, "conversations"))
    return model_calls.tool_runs(model_calls.message_parts(rows), model_calls.model_calls(rows)).select("trace_id", "span_id", "tool_call_id", "run_span_id", "duration_ms")


@query("c29_time_values", f"WITH {EV} SELECT id, CASE id % 5 WHEN 3 THEN floor(ts_ms / 1000) * 1000 WHEN 4 THEN NULL ELSE floor(ts_ms) END AS time_ms FROM ev")
def time_values(spark, d):
    """Stored times in seconds, milliseconds, text with and without a zone, and text that is no time."""
    ms = F.floor("ts_ms")
    at = F.timestamp_millis(ms)
    of = (
        F.when(F.col("id") % 5 == 0, ms.cast("string"))
        .when(F.col("id") % 5 == 1, F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss.SSS"))
        .when(F.col("id") % 5 == 2, F.concat(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("Asia/Tokyo"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+09:00")))
        .when(F.col("id") % 5 == 3, F.floor(ms / 1000).cast("string"))
        .otherwise(F.lit("yesterday"))
    )
    return tables.events(spark, d).select("id", fields.time_ms(of).alias("time_ms"))


def _traced(spark: SparkSession, d: str) -> DataFrame:
    """Events that name an order as their trace, some of them a line as their span, and some a request."""
    id, own = F.col("id"), F.col("id") % 1500
    extra = F.create_map(F.lit("trace_id"), own.cast("string"), F.lit("spanId"), F.concat(own.cast("string"), F.lit("-"), (id % 9).cast("string")), F.lit("kind"), F.when(id % 7 == 0, "span").otherwise(F.lit("log")))
    request = F.when(id % 4 == 0, F.concat(F.lit("done method=get url=https://shop.test/o/"), (id % 3).cast("string"), F.lit("?q=1"))).when(id % 4 == 1, F.concat(F.lit("POST /p/"), (id % 3).cast("string"))).otherwise(F.col("message"))
    return tables.events(spark, d).withColumns({"fields": F.map_concat("fields", extra), "message": request})


TRACED = f"""{EV}, tr AS (SELECT id, ts_ms, level, server_id, CAST(id % 1500 AS VARCHAR) AS trace_id, (id % 1500) || '-' || (id % 9) AS span_id, id % 7 = 0 AS own,
  CASE id % 4 WHEN 0 THEN 'done method=get url=https://shop.test/o/' || (id % 3) || '?q=1' WHEN 1 THEN 'POST /p/' || (id % 3) ELSE message END AS message,
  CASE id % 4 WHEN 0 THEN 'GET https://shop.test/o/' || (id % 3) WHEN 1 THEN 'POST /p/' || (id % 3) END AS request FROM ev)"""


@query("k4_request_operation", f"WITH {TRACED} SELECT id, request FROM tr")
def request_operations(spark, d):
    return _traced(spark, d).select("id", links.request_operation().alias("request"))


@query("f2_trace_logs", f"""WITH {SPANS}, {TRACED}, st AS (SELECT CAST(trace_id AS VARCHAR) AS trace_id, min(start_ms) AS start FROM spans GROUP BY trace_id), kn AS (SELECT DISTINCT CAST(trace_id AS VARCHAR) AS trace_id, span_id, parent_id IS NULL AS shown FROM spans)
  SELECT tr.trace_id, tr.id, tr.span_id, tr.ts_ms - st.start AS offset_ms, kn.span_id IS NOT NULL AS linked, kn.span_id IS NOT NULL AND NOT kn.shown AS span_omitted FROM tr LEFT JOIN st ON st.trace_id = tr.trace_id LEFT JOIN kn ON kn.trace_id = tr.trace_id AND kn.span_id = tr.span_id WHERE NOT tr.own OR st.trace_id IS NULL""")
def trace_logs(spark, d):
    """Logs beside their traces (F2) and whether their span is received and shown (F3), with only root spans shown."""
    events = _traced(spark, d)
    spans = traces.distinct_spans(links.spans_of_logs(tables.spans(spark, d), events))
    return links.trace_logs(events, spans, spans.where("parent_id IS NULL"))


@query("f15_log_traces", f"""WITH {TRACED}, g AS (SELECT tr.trace_id, count(*) AS logs, coalesce(arg_min(request, id) FILTER (request IS NOT NULL), arg_min(message, id)) AS name, array_to_string(list_sort(list(DISTINCT 'Service ' || substr(server_id, 4))), ',') AS services, min(ts_ms) AS start_ms, count(*) FILTER (level = 'error') AS errors, max(ts_ms) - min(ts_ms) AS duration_ms FROM tr WHERE NOT own GROUP BY tr.trace_id)
  SELECT trace_id, h.o_orderkey IS NOT NULL AS has_spans, logs, CASE WHEN h.o_orderkey IS NULL THEN name END AS name, CASE WHEN h.o_orderkey IS NULL THEN services END AS services, CASE WHEN h.o_orderkey IS NULL THEN start_ms END AS start_ms, CASE WHEN h.o_orderkey IS NULL THEN errors END AS errors, CASE WHEN h.o_orderkey IS NULL THEN duration_ms END AS duration_ms
  FROM g LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) h ON CAST(h.o_orderkey AS VARCHAR) = g.trace_id""")
def log_traces(spark, d):
    """Traces that logs name, where every second order has spans."""
    found = links.log_traces(_traced(spark, d), tables.read(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("trace_id")))
    return found.withColumn("services", F.when(F.col("services").isNotNull(), F.array_join("services", ",")))


@query("f1_sessions", f"WITH {EV} SELECT session_id, CASE WHEN session_id < '2024-01-15' THEN 'run ' || session_id END AS label, count(*) AS events, count(*) FILTER (level = 'error') AS errors FROM ev GROUP BY session_id")
def session_labels(spark, d):
    """Events with the labels of their sessions (F1) and errors by run (G28)."""
    rows = tables.events(spark, d)
    listed = rows.where("session_id < '2024-01-15'").select("session_id", F.concat(F.lit("run "), F.col("session_id")).alias("label"), F.lit("ended").alias("status"))
    return links.with_sessions(rows, listed).groupBy("session_id", "label").agg(F.count("*").alias("events"), F.count_if(F.col("level") == "error").alias("errors"))


@query("f13_differing_fields", """WITH e AS (SELECT *, lead(event_id) OVER w AS n, lead(user_id) OVER w AS u, lead(event_type) OVER w AS t, lead(value) OVER w AS v, lead(regexp_extract(props, '"k": *([0-9]+)', 1)) OVER w AS q, regexp_extract(props, '"k": *([0-9]+)', 1) AS k FROM events WINDOW w AS (PARTITION BY event_id // 2 ORDER BY event_id))
  SELECT event_id AS id, array_to_string(list_filter([CASE WHEN value <> v THEN 'durationMs' END, CASE WHEN event_type <> t THEN 'event_type' END, CASE WHEN k <> q THEN 'k' END, CASE WHEN (CASE event_type WHEN 'error' THEN 500 + event_id % 4 ELSE 200 END) <> (CASE t WHEN 'error' THEN 500 + n % 4 ELSE 200 END) THEN 'statusCode' END, CASE WHEN user_id <> u THEN 'user_id' END], lambda x: x IS NOT NULL), ',') AS names FROM e WHERE n IS NOT NULL""")
def differing_fields(spark, d):
    """Fields that differ between two events in a row."""
    rows = tables.events(spark, d)
    pair = rows.groupBy(F.floor(F.col("id") / 2).alias("pair")).agg(F.min_by("fields", "id").alias("a"), F.max_by("fields", "id").alias("b"), F.min("id").alias("id"), F.count("*").alias("n")).where("n = 2")
    return pair.select("id", F.array_join(links.differing_fields(F.col("a"), F.col("b")), ",").alias("names"))


@query("d13_changed", "SELECT l_suppkey, count(*) FILTER (c) AS changed, count(*) FILTER (NOT c) AS unchanged FROM (SELECT l_suppkey, EXISTS (SELECT 1 FROM (SELECT s_suppkey AS k, (s_suppkey * 37) % 1500 AS a, (s_suppkey * 37) % 1500 + 120 AS b FROM supplier) r WHERE r.k = l.l_suppkey AND l.l_partkey BETWEEN r.a AND r.b) AS c FROM lineitem l) GROUP BY l_suppkey")
def changed_events(spark, d):
    """Events from changed lines and from others."""
    keyed = lambda rows: rows.withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    lines_ = tables.read(spark, d, "lineitem")
    ranges = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") * 37 % 1500).alias("a"), (F.col("s_suppkey") * 37 % 1500 + 120).alias("b"))
    found = links.with_changed(keyed(lines_), keyed(pages.in_ranges(lines_, ranges, "l_suppkey", "l_partkey", "a", "b", 100)))
    return found.groupBy("l_suppkey").agg(F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("unchanged"))


@query("g8_sources", f"WITH {EV} SELECT session_id, count(DISTINCT server_id) AS sources, count(DISTINCT server_id) FILTER (server_id = 'svc1' OR starts_with(server_id, 'svc1::')) AS in_group FROM ev GROUP BY session_id")
def distinct_sources(spark, d):
    """Sources by session (G8), and those of one group of containers (F14)."""
    return tables.events(spark, d).groupBy("session_id").agg(F.countDistinct("server_id").alias("sources"), F.countDistinct(F.when(links.in_group("svc1"), F.col("server_id"))).alias("in_group"))


@query("h3_intervals", """WITH h AS (SELECT user_id AS series, CAST(floor(event_id / 500) AS BIGINT) AS t, CAST(count(*) FILTER (value <= 10) AS DOUBLE) AS b0, CAST(count(*) FILTER (value > 10 AND value <= 100) AS DOUBLE) AS b1, CAST(count(*) FILTER (value > 100) AS DOUBLE) AS b2, max(value) AS high FROM events GROUP BY ALL),
  r AS (SELECT *, b0 + b1 + b2 AS n, 0.95 * (b0 + b1 + b2) AS rank, greatest(0, max(high) OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING)) AS top FROM h),
  p AS (SELECT *, CASE WHEN b0 > 0 AND b0 >= rank THEN 0 WHEN b1 > 0 AND b0 + b1 >= rank THEN 1 ELSE 2 END AS i FROM r),
  q AS (SELECT *, [0.0, 10.0, 100.0][i + 1] AS lo0, [10.0, 100.0, greatest(top, 100.0)][i + 1] AS hi0, [0.0, b0, b0 + b1][i + 1] AS seen, [b0, b1, b2][i + 1] AS c FROM p),
  v AS (SELECT *, least(hi0, greatest(top, lo0)) AS hi FROM q), w AS (SELECT *, lo0 + (hi - lo0) * ((rank - seen) / c) AS p95 FROM v)
  SELECT series, t * 1000 + 1000.0 AS time_ms, n AS count, round(CASE WHEN hi - lo0 > abs(p95) THEN hi ELSE p95 END, 6) AS value, hi - lo0 > abs(p95) AS bound FROM w""")
def histogram_intervals(spark, d):
    """Cumulative histograms by user, each point sent twice: late points go, the rest gives percentiles of intervals."""
    rows = tables.read(spark, d, "events").select(F.col("user_id").alias("series"), F.floor(F.col("event_id") / 500).alias("t"), "value")
    low, high = F.col("value") <= 10, F.col("value") > 100
    each = rows.groupBy("series", "t").agg(F.count_if(low).alias("b0"), F.count_if(~low & ~high).alias("b1"), F.count_if(high).alias("b2"), F.max("value").alias("high"))
    order = Window.partitionBy("series").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    run = [F.sum(c).over(order).cast("double") for c in ("b0", "b1", "b2")]
    made = each.select("series", "t", F.array(*run).alias("buckets"), F.max("high").over(order).alias("max"))
    points = made.select("series", F.explode(F.array(F.col("t") * 2, F.col("t") * 2 + 1)).alias("id"), F.lit("histogram").alias("kind"), F.lit(False).alias("monotonic"), F.lit(2).alias("temporality"), F.lit(0.0).alias("start_ms"), (F.col("t") * 1000 + 1000.0).alias("time_ms"), F.lit(None).cast("double").alias("value"), (F.element_at("buckets", 1) + F.element_at("buckets", 2) + F.element_at("buckets", 3)).alias("count"), F.lit(None).cast("double").alias("sum"), F.lit(0.0).alias("min"), F.greatest(F.lit(0.0), F.col("max")).alias("max"), F.array(F.lit(10.0), F.lit(100.0)).alias("bounds"), "buckets")
    found = metrics.intervals(metrics.without_late(points))
    return found.select("series", "time_ms", F.col("interval_count").alias("count"), F.round("plotted", 6).alias("value"), "bound")


@query("s2_measures", f"WITH {EV} SELECT id, CASE id % 5 WHEN 0 THEN 'rate' WHEN 1 THEN 'value' WHEN 2 THEN 'p95' WHEN 3 THEN 'average' ELSE 'p95' END AS measure, CASE id % 5 WHEN 0 THEN value / 2 WHEN 1 THEN value WHEN 2 THEN 5 + 5 * 0.95 WHEN 3 THEN value / 4 ELSE value END AS plotted FROM ev")
def measures(spark, d):
    """Delta points of every kind, each a series of its own, through their payloads: counters, gauges, histograms, exponential ones, summaries."""
    n, value = F.col("event_id"), F.col("value")
    nanos = lambda s: F.concat(((n + s) * 1000).cast("string"), F.lit("000000"))
    kind = n % 5
    id = F.array(F.struct(F.lit("id").alias("key"), F.struct(n.cast("string").alias("stringValue")).alias("value")))
    point = lambda **more: F.array(F.struct(id.alias("attributes"), nanos(1).alias("startTimeUnixNano"), nanos(3).alias("timeUnixNano"), *[c.alias(k) for k, c in more.items()]))
    only = lambda k, points, **more: F.when(kind == k, F.struct(*[F.lit(v).alias(name) for name, v in more.items()], points.alias("dataPoints")))
    total = F.when(kind == 3, value).alias("sum")
    metric = F.struct(
        F.lit("m").alias("name"),
        only(0, point(asDouble=value), isMonotonic=True, aggregationTemporality=1).alias("sum"),
        only(1, point(asDouble=value)).alias("gauge"),
        only(2, point(count=F.lit("4"), bucketCounts=F.array(F.lit("0"), F.lit("4"), F.lit("0")), explicitBounds=F.array(F.lit(5.0), F.lit(10.0))), aggregationTemporality=1).alias("histogram"),
        only(3, point(count=F.lit("4"), sum=total), aggregationTemporality=1).alias("exponentialHistogram"),
        only(4, point(count=F.lit("4"), quantileValues=F.array(F.struct(F.lit(0.5).alias("quantile"), F.lit(0.0).alias("value")), F.struct(F.lit(0.95).alias("quantile"), value.alias("value"))))).alias("summary"),
    )
    payload = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics")))
    points = otlp.metric_points(tables.read(spark, d, "events").select(payload.alias("body")), "body")
    return metrics.intervals(points).select(F.element_at("attributes", "id").cast("bigint").alias("id"), "measure", "plotted")


@query("s7_series", f"WITH {COUNTERS} SELECT series, count(*) AS points, max(time_ms) AS latest_ms, arg_max(value, (time_ms, id)) AS latest FROM pts GROUP BY series")
def series_list(spark, d):
    return metrics.series(tables.counters(spark, d).withColumn("plotted", F.col("value")))


HEALTH = f"{EV}, hs AS (SELECT event_type AS site, id, level, CASE WHEN event_type = 'view' THEN 9000 ELSE 10 END AS size, event_type <> 'click' AS structured, event_type IN ('view', 'purchase', 'signup', 'error') AND (event_type <> 'error' OR id % 4 = 0) AS correlated FROM ev)"


@query("p5_health_rules", f"""WITH {HEALTH}, c AS (SELECT count(*) FILTER (structured) AS s, count(*) FILTER (structured AND correlated) AS k FROM hs), g AS (SELECT site, count(*) AS hits, avg(size) AS average, count(*) FILTER (NOT structured) AS plain, count(*) FILTER (structured AND NOT correlated AND level IN ('warn', 'error')) AS bare FROM hs GROUP BY site)
  SELECT site, hits, 'oversized' AS rule FROM g WHERE hits >= 3 AND average >= 8192 UNION ALL SELECT site, hits, 'contextless' FROM g, c WHERE s >= 50 AND 2 * k >= s AND bare >= 3 AND 2 * bare >= hits UNION ALL SELECT site, hits, 'unstructured' FROM g WHERE hits >= 3 AND plain = hits""")
def health_rules(spark, d):
    """Oversized, contextless and unstructured statements (P5 to P7)."""
    kind, n = F.element_at("fields", "event_type"), F.col("id")
    named = ~kind.isin("click", "error") | ((kind == "error") & (n % 4 == 0))
    rows = tables.events(spark, d).select(kind.alias("site"), "id", "level", F.when(kind == "view", F.lpad(F.lit(""), 9000, "x")).otherwise(F.lpad(F.lit(""), 10, "x")).alias("raw"), (kind != "click").alias("is_json"), F.when(named, F.map_concat("fields", F.create_map(F.lit("traceId"), F.lit("t")))).otherwise(F.col("fields")).alias("fields"))
    placeholders = rows.select("site", F.lit(2).alias("placeholders")).distinct()
    return sites.health(rows, placeholders)


@query("c14_exceptions", r"""WITH e AS (SELECT event_id AS id, event_id % 4 AS k, CAST(user_id AS VARCHAR) AS u FROM events)
  SELECT id, CAST(0 AS INT) AS block, CASE k WHEN 0 THEN 'IoError: bad ' || u WHEN 1 THEN 'E: ' || u WHEN 2 THEN 'error' ELSE 'Exception' END AS title, CASE k WHEN 0 THEN 'IoError: bad' || chr(10) || '    at f (a.js:1:2)' WHEN 1 THEN u WHEN 2 THEN 'text ' || u ELSE 'Traceback ' || u END AS text FROM e
  UNION ALL SELECT id, 1, 'Caused by: Net: down', 'Caused by: Net: down' FROM e WHERE k = 0""")
def exception_blocks(spark, d):
    """Exceptions with causes, in flat fields, as text in JSON, and in plain text."""
    k, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    cause = F.struct(F.lit("Net").alias("name"), F.lit("down").alias("message"))
    failed = F.struct(F.struct(F.lit("IoError").alias("type"), F.concat(F.lit("bad "), u).alias("message"), F.lit("IoError: bad\n    at f (a.js:1:2)").alias("stack"), cause.alias("cause")).alias("err"))
    flat = F.struct(F.lit("E").alias("exception.type"), u.alias("exception.message"))
    raw = F.when(k == 0, F.to_json(failed)).when(k == 1, F.to_json(flat)).when(k == 2, F.to_json(F.struct(F.concat(F.lit("text "), u).alias("error")))).otherwise(F.concat(F.lit("Traceback "), u))
    return errors.exceptions(tables.read(spark, d, "events").select(F.col("event_id").alias("id"), raw.alias("raw"), (k != 3).alias("is_json")))


@query("c22_entry_spans", "SELECT o_orderkey AS trace_id, count(*) AS entries FROM (SELECT o_orderkey, 1 AS x FROM orders UNION ALL SELECT l_orderkey, 1 FROM lineitem WHERE l_linenumber IN (2, 5)) GROUP BY o_orderkey")
def entry_spans(spark, d):
    """Spans where work enters a service: roots, and lines of two numbers taken as of kind server and consumer."""
    rows = tables.spans(spark, d).withColumn("kind", F.substring_index("span_id", "-", -1).cast("int"))
    rows = rows.withColumn("kind", F.when(F.col("parent_id").isNotNull(), F.col("kind")))
    return rows.where(links.entry_span()).groupBy("trace_id").agg(F.count("*").alias("entries"))


@query("g23_telemetry", """WITH e AS (SELECT *, CASE WHEN user_id % 5 = 0 THEN 'unknown_service:node' ELSE 'svc' || (user_id % 5) END AS service, CASE WHEN event_id % 2 = 0 THEN 'GET /u/' || (event_id + 10) ELSE 'GET /u/{id}' END AS name FROM events),
  t AS (SELECT service, 'unnamed-service' AS code, NULL AS example FROM e WHERE user_id % 5 = 0 UNION ALL SELECT service, 'span-name-ids', name FROM e WHERE event_id % 2 = 0 UNION ALL SELECT service, 'missing-route', name FROM e WHERE user_id % 5 = 2 UNION ALL SELECT service, 'unmarked-error', '503 ' || name FROM e WHERE event_type = 'error' AND event_id % 3 = 0
  UNION ALL SELECT service, 'old-attributes', 'http.method' FROM e UNION ALL SELECT service, 'unit-in-name', 'latency_ms' FROM e WHERE event_type = 'view' UNION ALL SELECT service, 'unnamed-service', NULL FROM e WHERE event_type = 'view' AND user_id % 5 = 0)
  SELECT service, code, CASE code WHEN 'missing-route' THEN 'information' WHEN 'old-attributes' THEN 'hint' WHEN 'unit-in-name' THEN 'hint' ELSE 'warning' END AS severity, count(*) AS hits, min(example) AS example FROM t GROUP BY service, code""")
def telemetry_findings(spark, d):
    """Conventions of spans and metrics by service (G23, P10): one service names no routes."""
    user, n = F.col("user_id"), F.col("event_id")
    service = F.when(user % 5 == 0, "unknown_service:node").otherwise(F.concat(F.lit("svc"), (user % 5).cast("string")))
    route = F.when(user % 5 == 2, "").otherwise(F.lit("/u/{id}"))
    name = F.when(n % 2 == 0, F.concat(F.lit("GET /u/"), (n + 10).cast("string"))).otherwise(F.lit("GET /u/{id}"))
    failed = F.col("event_type") == "error"
    attributes = F.create_map(F.lit("http.method"), F.lit("GET"), F.lit("http.route"), route, F.lit("http.response.status_code"), F.when(failed, "503").otherwise("200"))
    rows = tables.read(spark, d, "events")
    spans = rows.select(service.alias("service"), name.alias("name"), F.lit(2).alias("kind"), F.when(n % 3 == 0, 0).otherwise(2).alias("status_code"), attributes.alias("attributes"))
    named = rows.where("event_type = 'view'").select(service.alias("service"), F.lit("latency_ms").alias("name"), F.lit(None).cast("map<string,string>").alias("attributes"))
    return telemetry.findings(telemetry.tallies(spans, named))


@query("k23_diff_ranges", "SELECT p_partkey AS key, p_partkey + 1 AS a, p_partkey + 2 AS b FROM part UNION ALL SELECT p_partkey, p_partkey + 9, p_partkey + 9 FROM part UNION ALL SELECT p_partkey, p_partkey + 100, p_partkey + 100 FROM part")
def diff_ranges(spark, d):
    """Two hunks with lines added and removed, and a header between."""
    key = F.col("p_partkey")
    at = lambda n: (key + n).cast("string")
    text_ = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,3 +"), at(0), F.lit(",4 @@ f\n same\n+new\n+new\n same\n\n same\n same\n same\n same\n-old\n same\ndiff --git a/y b/y\n+++ b/y\n@@ -0,0 +"), at(100), F.lit(" @@\n+new\n\\ No newline"))
    return pages.diff_ranges(tables.read(spark, d, "part").select(key.alias("key"), text_.alias("diff")), "key", "diff")


@query("g13_facet_fields", f"""WITH {EV}, f AS (SELECT 'user_id' AS name, CAST(user_id AS VARCHAR) AS value FROM ev UNION ALL SELECT 'event_type', event_type FROM ev UNION ALL SELECT 'k', k FROM ev), s AS (SELECT name, count(*) AS events, count(DISTINCT value) AS distinct_values FROM f GROUP BY name)
  SELECT name, events, distinct_values, CAST(row_number() OVER (ORDER BY events DESC, name) AS INT) AS place FROM s WHERE 5 * events >= (SELECT count(*) FROM ev) AND distinct_values >= 2 AND NOT (distinct_values > 50 AND 5 * distinct_values > events) QUALIFY place <= 4""")
def facet_fields(spark, d):
    return analytics.facet_fields(tables.events(spark, d))


def _agent_trees(rows: DataFrame) -> DataFrame:
    """Events as spans of agents, models and tools: each hundred is one tree; views extend chains, others hang anywhere before."""
    n, kind = F.col("event_id") % 100, F.col("event_type")
    parent = F.when(kind == "view", n - 1).otherwise(F.pmod(F.col("event_id") * 7 + F.col("user_id"), n))
    texts = {
        "gen_ai.operation.name": F.when(kind == "signup", "invoke_agent").when(kind == "click", "execute_tool").otherwise("chat"),
        "gen_ai.agent.name": F.when(kind == "signup", F.concat(F.lit("agent "), F.col("user_id").cast("string"))),
        "gen_ai.request.model": F.when(~kind.isin("signup", "click"), F.concat(F.lit("model "), (F.col("user_id") % 3).cast("string"))),
        "gen_ai.tool.name": F.when((kind == "click") & (n % 2 == 0), "look"),
        "gen_ai.usage.input_tokens": F.when(kind != "click", F.floor("value").cast("string")),
        "gen_ai.usage.output_tokens": F.when(kind != "error", (F.col("event_id") % 13).cast("string")),
    }
    attributes = F.map_filter(F.create_map(*[x for key, value in texts.items() for x in (F.lit(key), value)]), lambda _, v: v.isNotNull())
    key = lambda at: F.concat(F.lit("s"), at.cast("string"))
    return rows.select(F.floor(F.col("event_id") / 100).alias("trace_id"), key(n).alias("span_id"), F.when(n > 0, key(parent)).alias("parent_id"), kind.alias("name"), F.lit("agents").alias("service"), F.floor(n / 3).cast("double").alias("start_ms"), F.lit(200.0).alias("end_ms"), F.lit(0).alias("status_code"), attributes.alias("attributes"))


AGENTS = """e AS (SELECT event_id // 100 AS trace_id, event_id % 100 AS n, event_type, user_id, floor(value) AS tin, event_id % 13 AS tout, CASE WHEN event_id % 100 = 0 THEN NULL WHEN event_type = 'view' THEN event_id % 100 - 1 ELSE (event_id * 7 + user_id) % (event_id % 100) END AS up FROM events),
  anc AS (SELECT trace_id, n, up AS a FROM e WHERE up IS NOT NULL UNION ALL SELECT anc.trace_id, anc.n, e.up FROM anc JOIN e ON e.trace_id = anc.trace_id AND e.n = anc.a WHERE e.up IS NOT NULL)"""


@query("g19_agent_totals", f"""WITH RECURSIVE {AGENTS}, b AS (SELECT anc.trace_id, a AS n, count(*) AS calls, sum(tin) AS tin, sum(CASE WHEN event_type = 'error' THEN 0 ELSE tout END) AS tout FROM anc JOIN e USING (trace_id, n) WHERE event_type NOT IN ('signup', 'click') GROUP BY ALL)
  SELECT e.trace_id, 's' || e.n AS span_id, CASE event_type WHEN 'signup' THEN 'agent' WHEN 'click' THEN 'tool' ELSE 'model' END AS kind, CASE event_type WHEN 'signup' THEN 'agent ' || user_id WHEN 'click' THEN 'tool · ' || CASE WHEN e.n % 2 = 0 THEN 'look' ELSE 'click' END ELSE 'model ' || (user_id % 3) END AS label,
  CASE WHEN event_type <> 'click' THEN CAST(e.tin AS DOUBLE) END AS input_tokens, CASE WHEN event_type <> 'error' THEN CAST(e.tout AS DOUBLE) END AS output_tokens, CASE WHEN event_type = 'signup' THEN CAST(calls AS BIGINT) END AS model_calls, CASE WHEN event_type = 'signup' THEN CAST(b.tin AS DOUBLE) END AS calls_input_tokens, CASE WHEN event_type = 'signup' THEN CAST(b.tout AS DOUBLE) END AS calls_output_tokens FROM e LEFT JOIN b ON b.trace_id = e.trace_id AND b.n = e.n""")
def agent_totals(spark, d):
    """Calls with the model calls and tokens beneath each agent, over trees of any depth."""
    return model_calls.chips(_agent_trees(tables.read(spark, d, "events")))


@query("r1_intervals", f"""WITH RECURSIVE {AGENTS}, s AS (SELECT trace_id, a AS n, count(*) AS beneath FROM anc GROUP BY ALL), p AS (SELECT trace_id, n, [[floor(n / 3), n]] AS path FROM e WHERE up IS NULL UNION ALL SELECT e.trace_id, e.n, list_append(p.path, [floor(e.n / 3), hash_order.o]) FROM p JOIN e ON e.trace_id = p.trace_id AND e.up = p.n JOIN (SELECT 's' || range AS k, row_number() OVER (ORDER BY 's' || range) AS o, range AS n FROM range(100)) hash_order ON hash_order.n = e.n),
  o AS (SELECT trace_id, n, row_number() OVER (PARTITION BY trace_id ORDER BY path) AS ordinal FROM p)
  SELECT o.trace_id, 's' || o.n AS span_id, CAST(ordinal AS INT) AS ordinal, CAST(ordinal + coalesce(beneath, 0) AS INT) AS last FROM o LEFT JOIN s ON s.trace_id = o.trace_id AND s.n = o.n""")
def span_intervals(spark, d):
    """First and last ordinal of each span's subtree."""
    return traces.intervals(_agent_trees(tables.read(spark, d, "events"))).select("trace_id", "span_id", "ordinal", F.col("last").cast("int").alias("last"))


@query("h11_every_seventh", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY user_id, event_id) AS n FROM events) WHERE n % 7 = 1")
def every_seventh(spark, d):
    rows = tables.read(spark, d, "events")
    return scans.every_nth(rows, ["user_id", "event_id"], 7, Scratch(spark, "h11")).select("event_id", "user_id")


def _bytes(number: Column, n: int) -> Column:
    """``n`` bytes of a whole number, the lowest first."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(number.cast("bigint"), 8 * k).bitwiseAND(255)), 2, "0")) for k in range(n)])


def _field(number: int, value: Column) -> Column:
    """A protobuf field of up to 16,383 bytes; its length takes two bytes."""
    tag = F.unhex(F.lit(f"{number << 3 | 2:02x}"))
    size = lambda v: (F.length(v) % 128 + 128) * 256 + F.floor(F.length(v) / 128)
    whole = lambda v: F.concat(tag, F.unhex(F.hex(size(v))), v)
    return F.get(F.transform(F.array(value), whole), F.lit(0))  # the value is computed once


def _eight(number: int, value: Column) -> Column:
    low_first = lambda h: F.concat(F.lit(f"{number << 3 | 1:02x}"), *[F.substring(h, 15 - 2 * k, 2) for k in range(8)])
    return F.unhex(fields.once(F.lpad(F.hex(value), 16, "0"), low_first))


@query("c17_otlp_protobuf", """SELECT lpad(lower(to_hex(o_orderkey + 1)), 32, '0') AS trace_id, lpad(lower(to_hex(o_orderkey + 1)), 16, '0') AS span_id, CAST(NULL AS VARCHAR) AS parent_id, o_orderpriority AS name, CAST(o_orderkey % 6 AS INT) AS kind, 'orders' AS service, 'lib' AS scope,
  CAST((o_orderkey + 1) * 1000 AS DOUBLE) AS start_ms, (o_orderkey + 1) * 1000 + 0.25 AS end_ms, CASE o_orderstatus WHEN 'F' THEN 2 ELSE 0 END AS status_code, '["' || o_orderstatus || '",' || (o_orderkey % 100) || ']' AS status FROM orders WHERE o_orderkey % 7 <> 3""")
def otlp_protobuf(spark, d):
    """Orders as export requests in protobuf; each seventh breaks off and gives nothing."""
    key = F.col("o_orderkey") + 1
    text = lambda c: F.encode(c, "utf-8")
    id_of = lambda n: F.unhex(F.lpad(F.hex(key), 2 * n, "0"))
    small = lambda number, value: F.concat(F.unhex(F.lit(f"{number << 3:02x}")), _bytes(value, 1))
    pair = lambda k, value: F.concat(_field(1, text(F.lit(k))), _field(2, value))
    listed = F.concat(_field(1, _field(1, text(F.col("o_orderstatus")))), _field(1, small(3, F.col("o_orderkey") % 100)))
    status = F.when(F.col("o_orderstatus") == "F", _field(15, small(3, F.lit(2)))).otherwise(F.unhex(F.lit("")))
    span = F.concat(_field(1, id_of(16)), _field(2, id_of(8)), _field(4, F.unhex(F.lit("00" * 8))), _field(5, text(F.col("o_orderpriority"))), small(6, F.col("o_orderkey") % 6), _eight(7, key * 1_000_000_000), _eight(8, key * 1_000_000_000 + 250_999), _field(9, pair("status", _field(5, listed))), status)
    resource = _field(1, _field(1, pair("service.name", _field(1, text(F.lit("orders"))))))
    whole = _field(1, F.concat(resource, _field(2, F.concat(_field(1, _field(1, text(F.lit("lib")))), _field(2, span)))))
    cut = F.get(F.transform(F.array(whole), lambda w: F.substring(w, F.lit(1), F.length(w) - F.when(F.col("o_orderkey") % 7 == 3, 1).otherwise(0))), F.lit(0))
    payloads = otlp_proto.with_json(tables.read(spark, d, "orders").select(cut.alias("body")), "body", "Traces")
    read = otlp.spans(payloads.where("error IS NULL"), "json")
    return read.select("trace_id", "span_id", "parent_id", "name", "kind", "service", "scope", "start_ms", "end_ms", "status_code", F.element_at("attributes", "status").alias("status"))


@query("c19_otlp_values", """SELECT lpad(lower(to_hex(o_orderkey + 1)), 16, '0') AS span_id, CAST(o_orderkey % 6 AS INT) AS kind, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS status_code,
  CASE o_orderkey % 3 WHEN 0 THEN '["' || o_orderstatus || '",' || o_custkey || ',true]' WHEN 1 THEN '{"key":' || o_custkey || ',"list":[["' || o_orderpriority || '"]]}' ELSE o_orderpriority END AS value FROM orders""")
def otlp_values(spark, d):
    """Enumerations by number and by name, lists and objects as values."""
    key, n, status = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    kind = F.when(key % 2 == 0, F.get(F.array(*map(F.lit, otlp.SPAN_KINDS)), (key % 6).cast("int"))).otherwise((key % 6).cast("string"))
    code = F.when(status == "F", F.lit('"STATUS_CODE_ERROR"')).when(status == "O", F.lit("1")).otherwise(F.lit('"STATUS_CODE_UNSET"'))
    word = lambda c: F.concat(F.lit('{"stringValue":"'), c, F.lit('"}'))
    number = F.concat(F.lit('{"intValue":"'), n, F.lit('"}'))
    listed = F.concat(F.lit('{"arrayValue":{"values":['), word(status), F.lit(","), number, F.lit(',{"boolValue":true}]}}'))
    within = F.concat(F.lit('{"arrayValue":{"values":[{"arrayValue":{"values":['), word(F.col("o_orderpriority")), F.lit("]}}]}}"))
    object_ = F.concat(F.lit('{"kvlistValue":{"values":[{"key":"key","value":{"intValue":"0"}},{"key":"key","value":'), number, F.lit('},{"key":"list","value":'), within, F.lit("}]}}"))
    value = F.when(key % 3 == 0, listed).when(key % 3 == 1, object_).otherwise(word(F.col("o_orderpriority")))
    body = F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":[{"spanId":"'), F.lpad(F.hex(key + 1), 16, "0"), F.lit('","kind":"'), kind, F.lit('","status":{"code":'), code, F.lit('},"attributes":[{"key":"v","value":'), value, F.lit("}]}]}]}]}"))
    read = otlp.spans(tables.read(spark, d, "orders").select(body.alias("body")), "body")
    return read.select("span_id", "kind", "status_code", F.element_at("attributes", "v").alias("value"))


@query("o2_deep_values", r"""SELECT event_id AS id, 'auth password=[REDACTED] and secret: [REDACTED], user_id=' || user_id || ' {"msg":"{\"token\":\"[REDACTED]\",\"kind\":\"' || event_type || '\"}"} ' || CASE WHEN event_id % 3 = 0 THEN 'credential=[REDACTED]' ELSE 'credential=[REDACTED] end ' || event_id END AS redacted FROM events""")
def redacted_deep_values(spark, d):
    """Sensitive containers of several levels, JSON within a quoted string, and each third text a container that doesn't end."""
    n = F.col("event_id").cast("string")
    deep = F.concat(F.lit('{"a":{"b":{"c":["deep'), n, F.lit('",{"d":"}"}]}}}'))
    listed = F.concat(F.lit('["x",["y",["zz'), n, F.lit('"]]]'))
    quoted = F.concat(F.lit(' {"msg":"{\\"token\\":\\"t'), n, F.lit('\\",\\"kind\\":\\"'), F.col("event_type"), F.lit('\\"}"} '))
    last = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('credential={"a":['), n)).otherwise(F.concat(F.lit('credential={"a":['), n, F.lit("]} end "), n))
    own = F.concat(F.lit("auth password="), deep, F.lit(" and secret: "), listed, F.lit(", user_id="), F.col("user_id").cast("string"), quoted, last)
    return tables.read(spark, d, "events").select(F.col("event_id").alias("id"), redaction.redact_text(own).alias("redacted"))


@query("f7_locations", """WITH s AS (SELECT p_partkey AS site, 'src/m' || (p_partkey % 5) || '/f' || (p_partkey % 3) || '.ts' AS file, p_partkey // 4 AS line FROM part),
  e AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'f' || (user_id % 3) || '.ts' ELSE 'src/m' || (user_id % 5) || '/f' || (user_id % 3) || '.ts' END AS path, event_id % 500 AS line, event_type, user_id FROM events),
  h AS (SELECT e.id, s.site, s.line FROM e JOIN s ON e.line BETWEEN s.line AND s.line + 3 AND (e.path = s.file OR ends_with(s.file, '/' || e.path))),
  b AS (SELECT id, min(site) AS site FROM h QUALIFY_RANK GROUP BY id HAVING count(*) = 1),
  m AS (SELECT e.id, -1 AS site FROM e LEFT JOIN b ON b.id = e.id WHERE b.id IS NULL AND event_type = 'error')
  SELECT id, site, true AS exact FROM b UNION ALL SELECT id, site, false FROM m""".replace("FROM h QUALIFY_RANK", "FROM (SELECT * FROM h QUALIFY line = max(line) OVER (PARTITION BY id))"))
def located(spark, d):
    """Statements by the place that an event tells, in paths of several kinds, or by its message."""
    key = F.col("p_partkey")
    of = lambda a, b: F.concat(F.lit("src/m"), (a % 5).cast("string"), F.lit("/f"), (b % 3).cast("string"), F.lit(".ts"))
    parts = tables.read(spark, d, "part").select(key.cast("bigint").alias("site"), of(key, key).alias("file"), F.floor(key / 4).alias("line"), F.lit(None).cast("string").alias("pattern"))
    known = parts.union(spark.createDataFrame([(-1, "src/errors.ts", 1, "an error of user *")], parts.schema))
    n, user = F.col("event_id"), F.col("user_id")
    whole = of(user, user)
    path = F.when(n % 4 == 1, F.regexp_extract(whole, "[^/]*$", 0)).when(n % 4 == 2, F.concat(F.lit("/srv/app/"), whole)).when(n % 4 == 3, F.concat(F.lit("C:\\app\\"), F.regexp_replace(whole, "/", r"\\")))
    message = F.when(F.col("event_type") == "error", F.concat(F.lit("an error of user "), user.cast("string"))).otherwise(F.lit("nothing"))
    rows = tables.read(spark, d, "events").select(n.alias("id"), path.alias("file"), (n % 500).alias("line"), message.alias("message"))
    return sites.written_by(rows, known)


@query("a7_json_documents", """SELECT o_orderkey AS id, CAST(o_orderkey % 4 AS INT) AS document, 'a,"]}' || o_orderpriority AS note, CAST(row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) AS BIGINT) AS place FROM orders""")
def json_arrays(spark, d):
    """Orders written as four files, one array or one run of objects each, and read back element by element."""
    group = (F.col("o_orderkey") % 4).cast("int")
    note = F.concat(F.lit('a,"]}'), F.col("o_orderpriority"))
    json = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.struct(note.alias("note")).alias("inner"), group.alias("document")))
    own = tables.read(spark, d, "orders").select(group.alias("g"), F.lit(1).alias("kind"), F.col("o_orderkey").cast("bigint").alias("at"), F.when(group < 2, F.concat(F.lit(","), json)).otherwise(json).alias("value"))
    ends = spark.range(2).select(F.col("id").cast("int").alias("g"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.lit("[{}").alias("value")), F.struct(F.lit(2).alias("kind"), F.lit("]").alias("value")))).alias("x")).select("g", "x.kind", F.lit(0).cast("bigint").alias("at"), "x.value")
    path = Scratch(spark, "a7").path("documents")
    own.union(ends).repartition(4, "g").sortWithinPartitions("g", "kind", "at").select("g", "value").write.partitionBy("g").text(path)
    read = json_documents.read_documents(spark, f"{path}/g=*").where("text <> '{}'")
    body = F.from_json("text", "id bigint, inner struct<note:string>, document int")
    rows = read.where("error IS NULL").withColumn("x", body).select("x.id", "x.document", F.col("x.inner.note").alias("note"), "element")
    return rows.withColumn("place", F.when(F.col("document") < 2, F.col("element") - 1).otherwise(F.col("element"))).drop("element")


@query("c1_terminal_lines", """WITH g AS (SELECT DISTINCT event_id // 4 AS k FROM events), n AS (SELECT k, k % 5 AS session, row_number() OVER (PARTITION BY k % 5 ORDER BY k) - 1 AS r FROM g)
  SELECT session, CAST(3 * r + 1 AS BIGINT) AS line, 'done ' || k AS text FROM n UNION ALL SELECT session, CAST(3 * r + 3 AS BIGINT), 'shown ' || k FROM n""")
def terminal_output(spark, d):
    """Events as chunks of terminals: four make a redrawn line, two on the second screen, and a sequence cut in two."""
    k, esc = F.floor(F.col("event_id") / 4), F.lit("\x1b")
    words = k.cast("string")
    parts = [
        F.concat(F.lit("10% of "), F.col("user_id").cast("string"), F.lit("\r")),
        F.concat(esc, F.lit("[3")),
        F.concat(F.lit("1mdone "), words, esc, F.lit("[0m\r\n"), esc, F.lit("[?1049hhidden")),
        F.concat(F.lit("\nmore hidden"), esc, F.lit("[?1049lshown "), words, F.lit("\n")),
    ]
    chunk = F.get(F.array(*parts), (F.col("event_id") % 4).cast("int"))
    rows = tables.read(spark, d, "events").select((k % 5).alias("session"), F.col("event_id").alias("n"), chunk.alias("text"))
    return terminal.terminal_lines(rows)
