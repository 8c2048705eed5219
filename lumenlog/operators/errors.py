"""Groups of errors by where they were raised, or by their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.text import first_line, template

#: Forms of a source location in a stack frame.
FRAME = r"\(([^()\s:]+\.[A-Za-z]+):(\d+)(?::\d+)?\)"
PYTHON_FRAME = r'File "([^"]+)", line (\d+)'


def location(text: Column) -> Column:
    """``file:line`` of the first frame in a text, null if there is none."""
    found = [F.when(F.regexp_extract(text, p, 1) != "", F.concat(F.regexp_extract(text, p, 1), F.lit(":"), F.regexp_extract(text, p, 2))) for p in (FRAME, PYTHON_FRAME)]
    return F.coalesce(*found)


def error_groups(errors: DataFrame, text: str = "text", id: str = "id", samples: int = 5) -> DataFrame:
    """Errors by exception type and location, or else by template: count, first and last id, location, sample ids.

    A group without location joins the one group with location whose errors have the same template,
    if there is exactly one.
    """
    line = first_line(F.col(text))
    own = errors.select(F.col(id).alias("id"), template(line).alias("template"), location(F.col(text)).alias("location"), line.alias("line"))
    kind = template(F.substring_index(F.col("line"), ":", 1))
    keyed = own.withColumn("key", F.when(F.col("location").isNotNull(), F.concat(kind, F.lit("@"), F.col("location"))).otherwise(F.col("template")))
    owners = keyed.where("location IS NOT NULL").groupBy("template").agg(F.countDistinct("key").alias("owners"), F.min("key").alias("owner")).where("owners = 1")
    placed = keyed.join(owners.select("template", "owner"), "template", "left").withColumn("key", F.when(F.col("location").isNull(), F.coalesce("owner", "key")).otherwise(F.col("key")))
    groups = placed.groupBy("key").agg(F.count("*").alias("events"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("location").alias("location"))
    order = Window.partitionBy("key").orderBy("id")
    few = placed.select("key", "id").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= samples)
    return groups.join(few.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("samples")), "key")


#: Keys under which an exception or its cause stands, keys of its stack, and words of a plain one.
INSIDE = ["err", "error", "exception", "thrown", "cause", "rootCause"]
STACKS = ["$.stack", "$.stack_trace", "$.stackTrace", "$.stacktrace", "$['exception.stacktrace']"]
PLAIN = r"\b(?:Error|Exception|Traceback|Caused by:)\b|(?m)^\s*\w*(?:Error|Exception): |^\s*File \"[^\"]+\", line \d+"
DEPTH = 8


def _at(value: Column, path: str, shape: str = "") -> Column:
    """What stands at a path, if it isn't null and of the shape."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.coalesce(F.schema_of_variant(found).startswith(shape) & ~F.is_variant_null(found), F.lit(False)), found)


def _string(value: Column, *paths: str) -> Column:
    """The first value at the paths, if it is text."""
    return F.try_variant_get(_only(F.coalesce(*[_at(value, p) for p in paths]), "STRING"), "$", "string")


def _only(value: Column, shape: str) -> Column:
    return F.when(F.coalesce(F.schema_of_variant(value).startswith(shape), F.lit(False)), value)


def _blocks(node: Column) -> Column:
    """Title and text of the exception at a node, and of a traceback in its message."""
    value, label = node["value"], node["label"]
    told = F.concat_ws(": ", _string(value, "$.type", "$.name", "$['exception.type']"), _string(value, "$.message", "$.localizedMessage", "$['exception.message']"))
    about = F.coalesce(F.nullif(told, F.lit("")), label)
    title = F.when(label == "Caused by", F.concat(F.lit("Caused by: "), about)).otherwise(about)
    stack = F.coalesce(*[_at(value, p) for p in STACKS])
    listed = F.array_join(F.try_variant_get(_only(stack, "ARRAY<STRING>"), "$", "array<string>"), "\n")
    part = lambda frame, key, missing="": F.coalesce(F.try_variant_get(frame, f"$.{key}", "string"), F.lit(missing))
    frames = F.transform(F.try_variant_get(value, "$.extendedStackTrace", "array<variant>"), lambda f: F.concat(F.lit("    at "), part(f, "class"), F.lit("."), part(f, "method"), F.lit("("), part(f, "file", "Unknown Source"), F.lit(":"), part(f, "line"), F.lit(")")))
    message = _string(value, "$['exception.message']")
    bare = F.when((label != "Exception") | _at(value, "$['exception.message']").isNotNull(), F.coalesce(message, title))
    body = F.coalesce(F.try_variant_get(_only(stack, "STRING"), "$", "string"), listed, F.coalesce(F.nullif(F.array_join(frames, "\n"), F.lit("")), F.when(frames.isNotNull(), title)), bare)
    said = _string(value, "$.message")
    row = lambda place, t, text: F.when(F.length(text) > 0, F.struct(F.concat(node["path"], F.lit(place)).alias("path"), t.alias("title"), text.alias("text")))
    is_object, is_text = (F.coalesce(F.schema_of_variant(value).startswith(s), F.lit(False)) for s in ("OBJECT", "STRING"))
    own = F.when(is_text, row("0", label, F.try_variant_get(value, "$", "string"))).when(is_object, row("0", title, body))
    return F.array(own, F.when(is_object & stack.isNull() & said.rlike(r"\n\s*(?:at\s|File \")"), row("9", title, said)))


def exceptions(events: DataFrame, raw: str = "raw", is_json: str = "is_json", id: str = "id") -> DataFrame:
    """One row an exception that an event tells of: ``id``, ``block`` (from 0, causes after what they caused), ``title``, ``text``.

    Plain text is one block if it reads like an error or names a place in a source file. In JSON,
    exceptions are looked for under the usual keys, ``DEPTH`` levels deep; their stacks may be text,
    lists of lines or lists of frames. Texts are whole. Null, empty and broken texts have none.
    """
    rows = events.select(F.col(id).alias("id"), F.col(raw).alias("raw"), F.coalesce(F.col(is_json), F.lit(False)).alias("json"))
    rows = rows.withColumn("_0", F.when(F.col("json"), F.array(F.struct(F.lit("").alias("path"), F.lit("Exception").alias("label"), F.try_parse_json("raw").alias("value")))))

    def below(node: Column) -> Column:
        at = [(str(i + 1), "Caused by" if key in ("cause", "rootCause") else key, _at(_only(node["value"], "OBJECT"), f"$.{key}")) for i, key in enumerate(INSIDE)]
        return F.filter(F.array(*[F.when(v.isNotNull(), F.struct(F.concat(node["path"], F.lit(i)).alias("path"), F.lit(label).alias("label"), v.alias("value"))) for i, label, v in at]), lambda n: n.isNotNull())

    for depth in range(DEPTH):
        rows = rows.withColumn(f"_{depth + 1}", F.flatten(F.transform(f"_{depth}", below)))
    found = F.flatten(F.transform(F.concat(*[f"_{d}" for d in range(DEPTH + 1)]), _blocks))
    plain = F.when((F.col("raw") != "") & (F.col("raw").rlike(PLAIN) | location(F.col("raw")).isNotNull()), F.array(F.struct(F.lit("0").alias("path"), F.lit("Exception").alias("title"), F.col("raw").alias("text"))))
    every = F.when(F.col("json"), F.array_sort(F.filter(found, lambda b: b.isNotNull()))).otherwise(plain)
    return rows.select("id", F.posexplode(every).alias("block", "b")).select("id", "block", "b.title", "b.text")
