"""Spans that record calls of language models: what was called, and the messages that they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.fields import number
from lumenlog.scratch import Scratch

from .traces import distinct_spans, subtree_sums

# Names of operations, of attributes, and of span events.
MODEL = ["chat", "text_completion", "generate_content", "embeddings", "completion"]
AGENT = ["invoke_agent", "create_agent"]
KNOWN = [*MODEL, *AGENT, "execute_tool", "retrieval", "fetch_response"]
CONTENT = ["gen_ai.input.messages", "gen_ai.output.messages", "gen_ai.system_instructions", "gen_ai.tool.call.arguments", "gen_ai.tool.call.result", "gen_ai.prompt", "gen_ai.completion"]
TOKENS = {
    "input_tokens": ["gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "llm.usage.prompt_tokens"],
    "output_tokens": ["gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "llm.usage.completion_tokens"],
    "cached_tokens": ["gen_ai.usage.cache_read.input_tokens", "gen_ai.usage.cache_read_input_tokens"],
}
NAMES = {
    "provider": ["gen_ai.provider.name", "gen_ai.system"],
    "model": ["gen_ai.response.model", "gen_ai.request.model", "llm.response.model", "llm.request.model"],
    "agent": ["gen_ai.agent.name"],
    "tool": ["gen_ai.tool.name"],
    "conversation": ["gen_ai.conversation.id"],
    "tool_call_id": ["gen_ai.tool.call.id"],
}
EVENT_ROLES = {"gen_ai.system.message": "system", "gen_ai.user.message": "user", "gen_ai.assistant.message": "assistant", "gen_ai.tool.message": "tool"}

EVENTS = "array<struct<name:string,attributes:map<string,string>>>"
PART = "struct<kind:string,name:string,id:string,text:string>"
MESSAGE = f"struct<role:string,output:boolean,parts:array<{PART}>>"


def _own(*keys: str, of: str = "attributes") -> Column:
    """The first of the attributes that is there."""
    return F.coalesce(*[F.element_at(F.col(of), k) for k in keys])


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def _prepared(spans: DataFrame) -> DataFrame:
    """``spans`` with the optional columns ``status_message`` and ``events``, and no null in ``attributes``."""
    for name, kind in {"status_message": "string", "events": EVENTS}.items():
        if name not in spans.columns:
            spans = spans.withColumn(name, F.lit(None).cast(kind))
    return spans.withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))


def operation() -> Column:
    """The operation that a span's attributes and name tell; null if it is no call."""
    keys = F.map_keys("attributes")
    asked = _filled(_own("llm.request.type"))
    word = F.lower(F.element_at(F.split(F.col("name"), r"[\s.]"), 1))
    inferred = (
        F.when(word.isin(*KNOWN), word)
        .when(asked == "completion", "text_completion")
        .when(asked.isNotNull(), asked)
        .when(_own("gen_ai.tool.name").isNotNull(), "execute_tool")
        .when(_own("gen_ai.agent.name").isNotNull() & _own("gen_ai.request.model").isNull(), "invoke_agent")
        .when(_own("gen_ai.request.model").isNotNull(), "chat")
        .otherwise("other")
    )
    is_call = F.exists(keys, lambda k: k.startswith("gen_ai.")) | asked.isNotNull()
    return F.coalesce(_filled(_own("gen_ai.operation.name")), F.when(is_call, inferred))


def kind_of(operation: Column) -> Column:
    return F.when(operation.isin(*MODEL), "model").when(operation == "execute_tool", "tool").when(operation.isin(*AGENT), "agent").when(operation.isNotNull(), "other")


def has_content() -> Column:
    """Whether a span carries messages, in attributes or in events."""
    listed = F.exists(F.map_keys("attributes"), lambda k: k.isin(*CONTENT) | k.startswith("gen_ai.prompt.") | k.startswith("gen_ai.completion."))
    told = F.exists("events", lambda e: e["name"].startswith("gen_ai.") & (F.size(e["attributes"]) > 0))
    return listed | F.coalesce(told, F.lit(False))


def _reasons() -> Column:
    told = _own("gen_ai.response.finish_reasons")
    read = F.when(F.ltrim(told).startswith("["), F.from_json(told, "array<string>"))
    listed = F.coalesce(read, F.when(told.isNotNull(), F.array(told)))
    flat = _filled(_own("gen_ai.completion.0.finish_reason"))
    return F.coalesce(F.when(F.size(listed) > 0, listed), F.when(flat.isNotNull(), F.array(flat)))


def model_calls(spans: DataFrame) -> DataFrame:
    """One row a span that is a call: what, where, how long, tokens (null unless a plain number from 0), reasons of its end.

    ``spans``: ``trace_id, span_id, name, service, start_ms, end_ms, status_code, attributes``; optional
    ``status_message`` and ``events`` (names and attribute maps). Spans without attributes are no calls.
    """
    rows = _prepared(spans).withColumn("operation", operation()).where("operation IS NOT NULL")
    tokens = {c: number(_own(*keys)) for c, keys in TOKENS.items()}
    return rows.select(
        "trace_id",
        "span_id",
        "operation",
        kind_of(F.col("operation")).alias("kind"),
        "name",
        "service",
        *[_filled(_own(*keys)).alias(c) for c, keys in NAMES.items()],
        "start_ms",
        F.greatest(F.lit(0.0), F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        *[F.when(n >= 0, n).alias(c) for c, n in tokens.items()],
        _reasons().alias("finish_reasons"),
        F.coalesce(F.col("status_code") == 2, F.lit(False)).alias("error"),
        F.coalesce("status_message", _filled(_own("error.type"))).alias("error_message"),
        has_content().alias("has_content"),
    )


def tool_runs(parts: DataFrame, calls: DataFrame) -> DataFrame:
    """Tool calls in messages and the spans of the same trace that ran them, by the call's id.

    ``parts`` are rows of :func:`message_parts`, ``calls`` of :func:`model_calls`. A call without an
    id or a run has no row; of several runs the earliest counts.
    """
    asked = parts.where("kind = 'tool_call' AND id IS NOT NULL").select("trace_id", "span_id", F.col("id").alias("tool_call_id")).distinct()
    ran = calls.where("operation = 'execute_tool' AND tool_call_id IS NOT NULL")
    first = ran.groupBy("trace_id", "tool_call_id").agg(F.min(F.struct("start_ms", "span_id", "duration_ms", "error", "error_message")).alias("run"))
    found = asked.join(first, ["trace_id", "tool_call_id"])
    return found.where(F.col("span_id") != F.col("run.span_id")).select("trace_id", "span_id", "tool_call_id", F.col("run.span_id").alias("run_span_id"), "run.duration_ms", "run.error", "run.error_message")


# Values of any shape (variants).
def _is(value: Column, shape: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(shape), F.lit(False))


def _at(value: Column, path: str) -> Column:
    found = F.try_variant_get(value, path, "variant")
    return F.when(~F.is_variant_null(found), found)


def _string(value: Column) -> Column:
    """The text of a value that is text."""
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def _shown(value: Column) -> Column:
    """A value as text: text itself, else its JSON."""
    return F.coalesce(_string(value), F.to_json(value), F.lit(""))


def _structured(text: Column) -> Column:
    """JSON text of an object or list as its value, other text as a text value."""
    read = F.when(F.ltrim(text).startswith("[") | F.ltrim(text).startswith("{"), F.try_parse_json(text))
    return F.coalesce(read, F.when(text.isNotNull(), text.cast("variant")))


def _value(value: Column) -> Column:
    """Arguments and results, as JSON without spaces where they are JSON."""
    text = _string(value)
    return F.coalesce(F.to_json(F.when(F.ltrim(text).startswith("[") | F.ltrim(text).startswith("{"), F.try_parse_json(text))), _shown(value))


def _part(kind: str, text: Column, name: Column | None = None, id: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), (none if name is None else name).alias("name"), (none if id is None else id).alias("id"), text.alias("text"))


def _list(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _kept(parts: Column) -> Column:
    return F.filter(parts, lambda p: p.isNotNull())


def read_part(value: Column) -> Column:
    """A part of a message from a value of either shape; null if the value is no part."""
    type = _string(_at(value, "$.type"))
    said = _shown(F.coalesce(_at(value, "$.content"), _at(value, "$.text")))
    has_text = F.coalesce(_at(value, "$.content"), _at(value, "$.text")).isNotNull()
    id = _filled(_string(_at(value, "$.id")))
    answer = F.coalesce(_at(value, "$.response"), _at(value, "$.result"), _at(value, "$.content"))
    return (
        F.when(_is(value, "STRING"), _part("text", _shown(value)))
        .when(~_is(value, "OBJECT"), F.lit(None).cast(PART))
        .when((type == "text") | (type.isNull() & has_text), _part("text", said))
        .when(type.isin("reasoning", "thinking"), _part("reasoning", said))
        .when(type.isin("tool_call", "function_call"), _part("tool_call", _value(_at(value, "$.arguments")), _string(_at(value, "$.name")), id))
        .when(type.isin("tool_call_response", "tool_result"), _part("tool_result", _value(answer), id=id))
        .otherwise(_part("other", _value(F.coalesce(_at(value, "$.content"), _at(value, "$.uri"), value)), F.coalesce(type, F.lit("part"))))
    )


def _asked(call: Column) -> Column:
    name = _string(F.coalesce(_at(call, "$.function.name"), _at(call, "$.name")))
    return F.when(_is(call, "OBJECT"), _part("tool_call", _value(F.coalesce(_at(call, "$.function.arguments"), _at(call, "$.arguments"))), name, _filled(_string(_at(call, "$.id")))))


def read_message(value: Column, output: bool, role: Column | None = None) -> Column:
    """A message with ``parts``, or with ``content`` and ``tool_calls``; null if it has no part. ``role`` is used where it names none."""
    fallback = F.lit("assistant" if output else "user")
    speaker = F.coalesce(_string(_at(value, "$.role")), *([] if role is None else [role]), fallback)
    none = F.array().cast(f"array<{PART}>")
    content = _at(value, "$.content")
    plain = F.when(speaker == "tool", _part("tool_result", _value(content), id=_filled(_string(_at(value, "$.tool_call_id"))))).otherwise(_part("text", _shown(content)))
    told = F.when(content.isNotNull() & (_shown(content) != ""), F.array(plain))
    listed = F.coalesce(_list(value, "$.parts"), _list(value, "$.content"))
    said = F.coalesce(F.transform(listed, read_part), told, none)
    calls = F.coalesce(F.transform(_list(value, "$.tool_calls"), _asked), none)
    whole = F.struct(speaker.alias("role"), F.lit(output).alias("output"), _kept(F.concat(said, calls)).alias("parts"))
    text = F.struct(F.coalesce(*([] if role is None else [role]), fallback).alias("role"), F.lit(output).alias("output"), F.array(_part("text", _shown(value))).alias("parts"))
    found = F.when(_is(value, "OBJECT"), whole).when(_is(value, "STRING"), text)
    return F.when(F.size(found["parts"]) > 0, found)


def _messages(text: Column, output: bool) -> Column:
    """All messages of an attribute: a list of them, or one."""
    value = _structured(text)
    many = F.transform(F.coalesce(_list(value, "$"), F.when(text.isNotNull(), F.array(value))), lambda m: read_message(m, output))
    return F.coalesce(_kept(many), F.array().cast(f"array<{MESSAGE}>"))


def _numbers(keys: Column, pattern: Column | str) -> Column:
    """The numbers at the first group of ``pattern`` in the keys that have one, ascending."""
    found = F.transform(keys, lambda k: F.regexp_extract(k, pattern, 1).try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: n.isNotNull())))


def _flat(prefix: str, output: bool) -> Column:
    """Messages whose pieces are attributes of their own, as ``gen_ai.prompt.0.content``."""
    attributes = F.col("attributes")
    at = lambda i, rest: F.element_at(attributes, F.concat(F.lit(f"gen_ai.{prefix}."), i.cast("string"), F.lit("." + rest)))

    def call(i: Column, j: Column) -> Column:
        got = lambda what: F.element_at(attributes, F.concat(F.lit(f"gen_ai.{prefix}."), i.cast("string"), F.lit(".tool_calls."), j.cast("string"), F.lit("." + what)))
        text = got("arguments")
        shown = F.coalesce(F.to_json(F.when(F.ltrim(text).startswith("{") | F.ltrim(text).startswith("["), F.try_parse_json(text))), text, F.lit(""))
        return _part("tool_call", shown, got("name"), _filled(got("id")))

    def message(i: Column) -> Column:
        role = F.coalesce(at(i, "role"), F.lit("assistant" if output else "user"))
        content = _filled(at(i, "content"))
        said = F.when(role == "tool", _part("tool_result", content, id=_filled(at(i, "tool_call_id")))).otherwise(_part("text", content))
        own = F.filter(F.map_keys(attributes), lambda k: k.startswith(F.concat(F.lit(f"gen_ai.{prefix}."), i.cast("string"), F.lit(".tool_calls."))))
        calls = F.transform(_numbers(own, r"\.tool_calls\.(\d+)\.(?:name|arguments|id)$"), lambda j: call(i, j))
        parts = F.concat(F.when(content.isNotNull(), F.array(said)).otherwise(F.array().cast(f"array<{PART}>")), calls)
        return F.when(F.size(parts) > 0, F.struct(role.alias("role"), F.lit(output).alias("output"), parts.alias("parts")))

    return _kept(F.transform(_numbers(F.map_keys(attributes), rf"^gen_ai\.{prefix}\.(\d+)\..+$"), message))


def _told() -> Column:
    """Messages recorded as span events."""
    roles = F.create_map(*[F.lit(x) for pair in EVENT_ROLES.items() for x in pair])
    none = F.array().cast(f"array<{MESSAGE}>")

    def read(event: Column) -> Column:
        name, got = event["name"], lambda *keys: F.coalesce(*[F.element_at(event["attributes"], k) for k in keys])
        role = F.element_at(roles, name)
        content = _structured(got("gen_ai.event.content", "content"))
        # text beside a role is the content of a message without other members
        plain = F.when(_is(content, "STRING") & (_shown(content) != ""), F.struct(role.alias("role"), F.lit(False).alias("output"), F.array(F.when(role == "tool", _part("tool_result", _shown(content))).otherwise(_part("text", _shown(content)))).alias("parts")))
        choice = _structured(got("gen_ai.event.content", "message"))
        return (
            F.when(name == "gen_ai.content.prompt", _messages(got("gen_ai.prompt"), False))
            .when(name == "gen_ai.content.completion", _messages(got("gen_ai.completion"), True))
            .when(role.isNotNull(), F.array(F.coalesce(F.when(_is(content, "OBJECT"), read_message(content, False, role)), plain)))
            .when((name == "gen_ai.choice") & _is(choice, "OBJECT"), F.array(read_message(F.coalesce(_at(choice, "$.message"), choice), True)))
            .otherwise(none)
        )

    return _kept(F.flatten(F.transform(F.coalesce("events", F.array().cast(EVENTS)), read)))


def _one(role: str, output: bool, parts: Column) -> Column:
    """A list of one message, or of none if it has no parts."""
    own = F.struct(F.lit(role).alias("role"), F.lit(output).alias("output"), parts.alias("parts"))
    return F.when(F.size(parts) > 0, F.array(own)).otherwise(F.array().cast(f"array<{MESSAGE}>"))


def message_parts(spans: DataFrame) -> DataFrame:
    """One row a part of every message that a span recorded, in order: system, input, output, tool run, tools offered.

    Messages are read from JSON attributes; without these from numbered attributes, and without
    those from events. ``message`` and ``part`` count from 0; ``kind`` is text, reasoning, tool_call,
    tool_result or other; values that aren't text are JSON without spaces. Texts are whole: redact
    them with ``functions.redaction`` before cutting. Spans are as in :func:`model_calls`.
    """
    rows = _prepared(spans).where(has_content() | _own("gen_ai.tool.definitions").isNotNull())
    system = _structured(_own("gen_ai.system_instructions"))
    instructions = _kept(F.transform(F.coalesce(_list(system, "$"), F.when(_own("gen_ai.system_instructions") != "", F.array(system))), read_part))
    read = rows.withColumns({"_in": _messages(_own("gen_ai.input.messages", "gen_ai.prompt"), False), "_out": _messages(_own("gen_ai.output.messages", "gen_ai.completion"), True)})
    direct = (F.size("_in") > 0) | (F.size("_out") > 0)
    flat = read.withColumn("_flat", F.when(~direct, F.concat(_flat("prompt", False), _flat("completion", True))))
    body = F.when(direct, F.concat("_in", "_out")).when(F.size("_flat") > 0, F.col("_flat")).otherwise(_told())
    tool, id = _filled(_own("gen_ai.tool.name")), _filled(_own("gen_ai.tool.call.id"))
    ran = {key: _structured(_own(key)) for key in ("gen_ai.tool.call.arguments", "gen_ai.tool.call.result")}
    asked, answered = (F.when(_own(key).isNotNull(), F.array(_part(kind, _shown(ran[key]), tool, id))) for key, kind in zip(ran, ("tool_call", "tool_result"), strict=True))
    name = lambda t: F.coalesce(_string(F.coalesce(_at(t, "$.function.name"), _at(t, "$.name"))), F.lit("tool"))
    offered = F.transform(_list(_structured(_own("gen_ai.tool.definitions")), "$"), lambda t: _part("other", _shown(t), name(t)))
    every = F.concat(_one("system", False, instructions), body, _one("assistant", False, asked), _one("tool", True, answered), _one("tools", False, offered))
    messages = flat.select("trace_id", "span_id", F.posexplode(every.cast(f"array<{MESSAGE}>")).alias("message", "m"))
    return messages.select("trace_id", "span_id", "message", "m.role", "m.output", F.posexplode("m.parts").alias("part", "p")).select("trace_id", "span_id", "message", "role", "output", "part", "p.*")


def chips(spans: DataFrame) -> DataFrame:
    """What a waterfall shows of each call: ``kind``, ``label``, own tokens, and for agents the model calls beneath them.

    ``model_calls``, ``calls_input_tokens`` and ``calls_output_tokens`` count over the agent's whole
    subtree, nested agents and tools included; they are null for other kinds and for agents without
    a model call beneath. Tokens that a call doesn't tell count as 0. Of spans with one id the earliest counts.
    """
    own = Scratch(spans.sparkSession, "chips").keep(distinct_spans(spans), "spans")
    calls = model_calls(own)
    models = calls.where("kind = 'model'").select("trace_id", "span_id", F.lit(1).alias("n"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("input_tokens", "output_tokens")])
    names = ["n", "input_tokens", "output_tokens"]
    beneath = subtree_sums(own, models, names).select("trace_id", "span_id", *[F.col(c).alias(f"_{c}") for c in names])
    label = F.when(F.col("kind") == "tool", F.concat(F.lit("tool · "), F.coalesce("tool", "name"))).otherwise(F.coalesce("model", "agent", "operation"))
    has = (F.col("kind") == "agent") & (F.col("_n") > 0)
    totals = {"model_calls": F.col("_n").cast("bigint"), "calls_input_tokens": F.col("_input_tokens"), "calls_output_tokens": F.col("_output_tokens")}
    joined = calls.join(beneath, ["trace_id", "span_id"], "left")
    return joined.select("trace_id", "span_id", "kind", label.alias("label"), "input_tokens", "output_tokens", *[F.when(has, value).alias(name) for name, value in totals.items()])
