"""Lines of logs into events: prefixes, JSON, logfmt, plain text, stack traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions.fields import level_of, once
from lumenlog.functions.text import first_line, leading_level, strip_ansi
from lumenlog.operators.scans import numbered, ranged, running
from lumenlog.scratch import Scratch

#: Forms of container prefixes and of logfmt pairs.
COMPOSE = r"^([A-Za-z0-9][\w.-]{0,127}) +\| ?"
REPLICA = r"[-_](\d+)$"  # of any length: numbers of replicas may be ids
KUBERNETES = r"^\[pod/([^/\]\s]{1,253})/([^\]\s]{1,63})\] ?"
DOCKER_TIME = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:\d{2})) "
PAIR = r'([A-Za-z_@][\w.@/-]*)=("(?:[^"\\]|\\.)*"|[^\s"]*)(?=\s|$)'
#: Names that are tried for an event's level, message and time, in this order.
LEVELS = ["level", "severity", "log.level", "severityText", "SeverityText"]
MESSAGES = ["message", "msg", "event", "name", "body.stringValue", "Body.stringValue", "body", "Body"]
TIMES = ["timestamp", "time", "ts", "datetime", "timeMillis", "@timestamp"]
MOST_FIELDS, MOST_MESSAGE, MOST_LINES = 120, 512, 1000
CONTINUES = r"^(\s+|Caused by: |\.\.\. \d+ more|Traceback |During handling of )"


def container_prefix(line: Column) -> Column:
    """Struct of ``service``, ``container``, ``time`` (text or null) and ``payload``; without a prefix the line is the payload."""
    text = strip_ansi(line)
    kubernetes, compose = text.rlike(KUBERNETES), F.regexp_extract(text, COMPOSE, 1)
    composed = ~kubernetes & compose.rlike(REPLICA)
    name = F.regexp_replace(compose, REPLICA, "")
    old_style = compose.contains("_") & ~compose.contains("-")
    service = F.when(kubernetes, F.regexp_extract(text, KUBERNETES, 2)).when(composed, F.when(old_style, F.regexp_replace(name, "^[^_]*_", "")).otherwise(name))
    container = F.when(kubernetes, F.concat(F.lit("pod/"), F.regexp_extract(text, KUBERNETES, 1), F.lit("/"), F.regexp_extract(text, KUBERNETES, 2))).when(composed, compose)
    rest = F.when(kubernetes, F.regexp_replace(text, KUBERNETES, "")).when(composed, F.regexp_replace(text, COMPOSE, ""))
    time = F.nullif(F.regexp_extract(rest, DOCKER_TIME, 1), F.lit(""))
    payload = F.coalesce(F.when(time.isNotNull(), F.regexp_replace(rest, DOCKER_TIME, "")).otherwise(rest), line)
    return F.struct(service.alias("service"), container.alias("container"), time.alias("time"), payload.alias("payload"))


def _first_of_each(entries: Column, most: int = MOST_FIELDS) -> Column:
    """Map of key and value entries; the first of equal keys wins."""
    first = lambda es, keys: F.filter(es, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    kept = once(entries, lambda es: once(F.transform(es, lambda e: e["key"]), lambda keys: first(es, keys)))
    return F.map_from_entries(F.slice(kept, 1, most))


def logfmt(line: Column) -> Column:
    """Map of a line that is ``key=value`` pairs and nothing else, two at least; null for other lines."""
    all_pairs = line.rlike(r'^\s*(?:[A-Za-z_@][\w.@/-]*=(?:"(?:[^"\\]|\\.)*"|[^\s"]*)(?:\s+|$))+$')
    keys = F.regexp_extract_all(line, F.lit(PAIR), F.lit(1))
    values = F.regexp_extract_all(line, F.lit(PAIR), F.lit(2))

    def plain(v: Column) -> Column:
        inner = F.substring(v, F.lit(2), F.length(v) - 2)
        for escape, char in ((r"\\n", "\n"), (r"\\t", "\t"), (r"\\(.)", "$1")):
            inner = F.regexp_replace(inner, escape, char)
        return F.when(v.startswith('"'), inner).otherwise(v)

    entries = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), plain(v).alias("value")))
    return F.when(all_pairs & (F.size(keys) >= 2), _first_of_each(entries))


def flattened(json: Column, depth: int = 4) -> Column:
    """Map of a JSON object's primitive fields: own names first, then nested ones by dotted path, then by leaf name."""
    entries = lambda j: F.map_entries(F.from_json(j, "map<string,string>"))
    nested = lambda v: v.startswith("{")
    pair = lambda e, name: F.struct(e[name].alias("key"), e["value"].alias("value"))
    below = lambda e: F.transform(entries(e["value"]), lambda c: F.struct(F.concat(e["key"], F.lit("."), c["key"]).alias("key"), c["key"].alias("leaf"), c["value"].alias("value")))

    def found(level: Column, at: int) -> Column:
        """Struct of ``paths`` and ``leaves`` of this level and those beneath it; each object is parsed once."""
        plain = F.filter(level, lambda e: e["value"].isNotNull() & ~nested(e["value"]) & ~e["value"].startswith("["))

        def both(own: Column, deeper: Column | None) -> Column:
            here = {name: F.transform(own, lambda e: pair(e, key)) for name, key in (("paths", "key"), ("leaves", "leaf"))}
            here["leaves"] = here["leaves"] if at else F.slice(here["leaves"], 1, 0)
            return F.struct(*[(c if deeper is None else F.concat(c, deeper[name])).alias(name) for name, c in here.items()])

        if at == depth - 1:
            return once(plain, lambda own: both(own, None))
        inner = F.flatten(F.transform(F.filter(level, lambda e: nested(e["value"])), below))
        return once(plain, lambda own: once(inner, lambda under: once(found(under, at + 1), lambda deeper: both(own, deeper))))

    top = F.transform(entries(json), lambda e: F.struct(e["key"].alias("key"), e["key"].alias("leaf"), e["value"].alias("value")))
    return once(once(top, lambda level: found(level, 0)), lambda f: _first_of_each(F.concat(f["paths"], f["leaves"])))


def parse(lines: DataFrame, line: str = "line", stream: str = "file") -> DataFrame:
    """``lines`` with ``level``, ``message``, ``time_text``, ``is_json`` and ``fields``.

    A JSON object gives its flattened fields, a logfmt line its pairs, other lines none. A plain
    line's level is the one that it begins with; a structured one's defaults to info, or to error on
    ``stderr``. A null line is an empty one.
    """
    text = F.trim(strip_ansi(F.coalesce(F.col(line), F.lit(""))))
    is_object = F.get_json_object(text, "$").startswith("{")
    fields = F.when(is_object, flattened(text)).otherwise(F.coalesce(logfmt(text), F.create_map().cast("map<string,string>")))
    pick = lambda names: F.coalesce(*[F.element_at("fields", n) for n in names])
    default = "error" if stream == "stderr" else "info"
    structured = F.size("fields") > 0
    summary = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    parsed = lines.withColumn("is_json", F.coalesce(is_object, F.lit(False))).withColumn("fields", fields)
    message = F.when(structured, F.coalesce(pick(MESSAGES), summary)).when(F.col("is_json"), "JSON event").otherwise(first_line(text))
    return parsed.withColumns(
        {
            "level": F.when(structured, level_of(pick(LEVELS), default)).otherwise(leading_level(text)),
            "message": F.substring(message, 1, MOST_MESSAGE),
            "time_text": pick(TIMES),
        }
    )


def joined_traces(lines: DataFrame, source: str, order: str, line: str) -> DataFrame:
    """Stack traces joined to the line before them: one row for each first line; after ``MOST_LINES`` lines the next begins a row of its own.

    Sources are ordered and numbered on their own, a hot one in several ranges; no list is longer than ``MOST_LINES``.
    """
    own = numbered(ranged(lines.select(source, order, line), [source], [order], Scratch(lines.sparkSession, "traces")), [source], [order], "_place")
    starts = F.when(F.col(line).rlike(CONTINUES) & (F.col("_place") > 1), 0).otherwise(1)
    marked = own.withColumn("_starts", starts)
    begun = F.when(F.col("_starts") == 1, F.col("_place"))
    events = running(marked, [source], [order], {"_event": ("max", begun)}, "upto")
    placed = events.withColumn("_part", F.floor((F.col("_place") - F.col("_event")) / MOST_LINES))
    gathered = placed.groupBy(source, "_event", "_part").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))).alias("_all"), F.min(order).alias("first"))
    return gathered.select(source, "first", F.size("_all").alias("n_lines"), F.array_join(F.transform("_all", lambda x: x["l"]), "\n").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text, JSON-lines or logfmt files, parsed."""
    return parse(spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line")).where("line <> ''"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV export read back: quoted cells may span lines; ``field:`` columns make the open map."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    own = [c for c in raw.columns if not c.startswith("field:")]
    entries = [F.struct(F.lit(c.removeprefix("field:")).alias("key"), F.col(f"`{c}`").alias("value")) for c in raw.columns if c.startswith("field:")]
    fields = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())) if entries else F.create_map().cast("map<string,string>")
    return raw.select(*[F.col(f"`{c}`") for c in own], fields.alias("fields"))


def write_jsonl(events: DataFrame, path: str) -> None:
    """One JSON object a line, each file one task's rows."""
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.text(path)


def write_csv(events: DataFrame, path: str, most_fields: int = 200) -> None:
    """Envelope columns and one column a field name, the first ``most_fields`` in name order (the format's limit)."""
    names = [r[0] for r in events.select(F.explode(F.map_keys("fields")).alias("n")).distinct().orderBy("n").limit(most_fields).collect()]
    own = [c for c in events.columns if c != "fields"]
    events.select(*own, *[F.element_at("fields", n).alias(f"field:{n}") for n in names]).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
