"""Redaction by the names of keys: fields of events, and assignments in texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import once
from .text import REDACTED, redact

#: Words that make a key sensitive, and ends of keys that only share such a word.
SENSITIVE = r"password|passwd|passphrase|secret|token|api[-_ ]?key|authorization|cookie|private[-_ ]?key|access[-_ ]?key|credential"
HARMLESS_END = r"(?:count|limit|ttl|expires?|duration|(?:input|output|prompt|completion|cached|reasoning|total|max)[-_.]?tokens)"
#: A key of an assignment in a text: not harmless, with a sensitive word or ``pwd`` as its last part.
_KEY = rf"(?![\w.-]*{HARMLESS_END}[\"']?\s*[:=])(?:[\w.-]*(?:{SENSITIVE})[\w.-]*|(?:[\w.-]*[-_.])?pwd)"


def _before(opens: str) -> str:
    """A key and its sign. What follows must begin with ``opens``, which is seen first: other words are passed over without a search for sensitive ones."""
    ahead = rf"(?=[\w.-]++(?: [\w.-]++)?(?:\\*+[\"'])?\s*+[:=]\s*+{opens})"  # keys of two words have one blank
    return rf"(?i)((?<![\w.-]){ahead}{_KEY}(?:\\*[\"'])?\s*[:=]\s*)"


#: Levels of objects and arrays within each other that a container's end is found through; loops are possessive, so long texts need no stack.
DEPTH = 12
_STRING = r'"(?:[^"\\]++|\\.)*+"'


def _container(depth: int) -> str:
    deeper = f"|{_container(depth - 1)}" if depth > 1 else ""
    return rf"[{{\[](?:[^{{}}\[\]\"]++|{_STRING}{deeper})*+[}}\]]"


#: Values, what they begin with, and what stands before and after the replacement: in double quotes, in single quotes, in the escaped quotes of a
#: quoted text (as many backslashes, more of them before quotes within it), a container, or bare with its scheme.
_VALUES = [
    (r'"(?:[^"\\]++|\\.)*+"?', '"', '"', '"'),
    (r"'(?:[^'\\]++|\\.)*+'?", "'", "'", "'"),
    (r'(\\+)"(?:[^\\"]++|\\++(?!")|\2\\++")*+(?:\2")?', r"\\", '$2"', '$2"'),
    (_container(DEPTH), r"[{\[]", "", ""),
    (r"(?!\\*[\"'{\[])(?:(?:bearer|basic)\s+)?[^\s,;\]}\"']+", r"[^\s,;\]}\"'{\[]", "", ""),
]


def is_sensitive_key(key: Column, configured: tuple[str, ...] = ()) -> Column:
    """Whether a field's name tells that its value is secret: by its words, or as one of ``configured`` whatever its case and marks."""
    named = key.rlike(rf"(?i)(?:{SENSITIVE}|(?:^|[-_. ])pwd$)") & ~key.rlike(rf"(?i){HARMLESS_END}$")
    plain = [re.sub(r"[^a-z0-9]", "", c.lower()) for c in configured]
    return named | F.regexp_replace(F.lower(key), "[^a-z0-9]", "").isin(plain) if plain else named


def redact_assignments(text: Column, replacement: str = REDACTED) -> Column:
    """The text with the values of sensitive keys replaced in ``key=value``, ``key: value`` and ``"key": "value"``.

    Quotes stay, also escaped ones of JSON within a quoted string; a bare value ends at a blank, comma,
    semicolon or closing bracket, and the credential after ``Bearer`` or ``Basic`` belongs to it.
    Containers are replaced whole. Where a container's end isn't found, because its brackets don't match or it
    is more than ``DEPTH`` levels deep, everything to the end of the text is replaced.
    """
    out, put = text, replacement.replace("\\", r"\\").replace("$", r"\$")
    for value, opens, before, after in _VALUES:
        out = F.regexp_replace(out, _before(opens) + value, "$1" + before + put + after)
    open_ = rf"(?!{re.escape(replacement)})[{{\[]"
    out = F.regexp_replace(out, rf"(?s){_before(open_)}{open_}.*", "$1" + put)
    return F.when(text.rlike(rf"(?i)(?:{SENSITIVE}|pwd)"), out).otherwise(text)


def redact_text(text: Column, replacement: str = REDACTED) -> Column:
    """Assignments and credentials of known form replaced."""
    return once(redact_assignments(text, replacement), lambda t: redact(t, replacement))


def redact_fields(fields: Column, configured: tuple[str, ...] = (), replacement: str = REDACTED) -> Column:
    """The map with the values of sensitive fields replaced, and credentials in the others.

    A field is sensitive by its name, or if its value is also that of a field with a sensitive
    path that ends in its name: ``token`` beside ``auth.secret.token``. Null maps and values stay null.
    """
    def path(key: Column) -> Column:
        parts = F.split(key, r"\.")
        return F.exists(F.sequence(F.lit(1), F.size(parts)), lambda n: is_sensitive_key(F.array_join(F.slice(parts, F.lit(1), n), "."), configured))

    def redacted(own: Column, entries: Column) -> Column:
        twin = lambda k, v: F.exists(entries, lambda e: (e["value"] == v) & ((e["key"] == k) | F.endswith(e["key"], F.concat(F.lit("."), k))))
        return F.transform_values(own, lambda k, v: F.when(v.isNull(), v).when(is_sensitive_key(k, configured) | F.coalesce(twin(k, v), F.lit(False)), F.lit(replacement)).otherwise(redact_text(v, replacement)))

    return once(fields, lambda own: once(F.filter(F.map_entries(own), lambda e: path(e["key"])), lambda entries: redacted(own, entries)))


def redact_event(events, text: tuple[str, ...] = ("message", "raw"), fields: str = "fields", configured: tuple[str, ...] = ()):
    """Events with their texts and their map of fields redacted; other columns stay."""
    return events.withColumns({**{c: redact_text(F.col(c)) for c in text}, fields: redact_fields(F.col(fields), configured)})
