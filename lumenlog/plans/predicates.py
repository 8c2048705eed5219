"""Search terms as column expressions, all two-valued: a missing field is never null in a filter.

Terms combine with ``&``, ``|`` and :func:`exclude`. There is no text syntax to parse here: callers
compose expressions, and Catalyst pushes what it can into the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlog.functions.fields import field, number


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def word(text: str) -> Column:
    """Level, message or raw line contains the text, whatever the case; ``*`` stands for any run within a line."""
    columns = [F.col(c) for c in ("level", "message", "raw")]
    if "*" in text:
        pattern = "(?i)" + ".*".join(map(re.escape, text.split("*")))
        tests = [_true(c.rlike(pattern)) for c in columns]
    else:
        tests = [_true(F.lower(c).contains(text.lower())) for c in columns]
    return tests[0] | tests[1] | tests[2]


def phrase(text: str) -> Column:
    """Level, message and raw line, joined by blanks, contain the text."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("undefined")) for c in ("level", "message", "raw")])
    return F.lower(joined).contains(text.lower())


def has(name: str, value: str) -> Column:
    """The field's text contains the value; an empty value matches all rows."""
    return F.lower(F.coalesce(field(name), F.lit(""))).contains(value.lower())


def like(name: str, pattern: str) -> Column:
    """The whole field matches a pattern with ``*``; a missing field doesn't."""
    return _true(field(name).rlike("(?is)^" + ".*".join(map(re.escape, pattern.split("*"))) + "$"))


def matches(name: str, pattern: str) -> Column:
    """The field matches a regular expression somewhere, case-sensitive."""
    if re.search(r"\(\?[=!<]|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not supported")
    return _true(field(name).rlike(pattern))


def compares(name: str, operator: str, bound: float) -> Column:
    """A numeric comparison; a value that is no number is searched for the literal text instead."""
    value = number(field(name))
    test = {">": value > bound, ">=": value >= bound, "<": value < bound, "<=": value <= bound}[operator]
    literal = f"{operator}{bound:g}"
    return F.when(value.isNotNull(), test).otherwise(has(name, literal))


def between(name: str, low: float, high: float) -> Column:
    return _true(number(field(name)).between(low, high))


def status_class(digit: int) -> Column:
    """Status 5xx, 4xx, …"""
    return _true(field("status").startswith(str(digit)))


def exists(name: str) -> Column:
    return field(name).isNotNull()


def since(now_ms: float, span_ms: float) -> Column:
    return F.coalesce(F.col("ts_ms"), F.lit(0.0)) >= F.lit(now_ms - span_ms)


def within(low_ms: float, high_ms: float) -> Column:
    return F.coalesce(F.col("ts_ms"), F.lit(0.0)).between(low_ms, high_ms)


def levels(*names: str) -> Column:
    """One of the levels; none named matches nothing."""
    return _true(F.col("level").isin(*names)) if names else F.lit(False)


def source(name: str) -> Column:
    return _true(F.lower("server_id") == name.lower())


def sessions(*ids: str) -> Column:
    return F.coalesce(F.col("session_id"), F.lit("*")).isin(*ids)


def up_to(id: int) -> Column:
    """Rows of a fixed snapshot, for paging that doesn't shift."""
    return F.col("id") <= id


def exclude(term: Column) -> Column:
    """Rows that the term doesn't match; rows without the field are among them."""
    return ~_true(term)
