"""Events and the statements of source code that wrote them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.fields import field

from .ranks import ceil_rank, nth_values

#: Key words of statements, with their patterns, that may be broadcast.
MOST_KEYS = 100_000
#: Lines above a reported one in which the statement may begin: calls over several lines are told at either end.
LINES_ABOVE = 3


def attributed(events: DataFrame, sites: DataFrame, message: str = "message", id: str = "id") -> DataFrame:
    """``id`` and ``site`` of events whose message has all literals of a statement in order.

    ``sites``: ``site``, ``pattern`` with ``*`` between literals. A statement is looked up by the
    rarest of its words (by the number of statements that have it, then the longest), an equi-join
    on words; the pattern is tested on what that finds. The key words are broadcast if they are counted
    to be few, so the words of messages that are none don't travel. The statement with most literal
    text wins; if several tie, the event has none.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: F.length(w) > 1))
    literal = F.length(F.regexp_replace("pattern", r"\*", ""))
    regex = F.concat(F.lit("(?s)"), F.regexp_replace(F.regexp_replace("pattern", r"([\\.\[\]{}()+?^$|])", r"\\$1"), r"\*", ".*"))
    listed = sites.select("site", regex.alias("regex"), literal.alias("score"), F.explode(words(F.col("pattern"))).alias("word"))
    common = listed.groupBy("word").agg(F.count("*").alias("sites"))
    rank = Window.partitionBy("site").orderBy("sites", F.desc(F.length("word")), "word")
    keys = listed.join(common, "word").withColumn("_n", F.row_number().over(rank)).where("_n = 1").select("site", "regex", "score", "word")
    spread = events.select(F.col(id).alias("id"), F.col(message).alias("message"), F.explode(words(F.col(message))).alias("word"))
    few = keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    hits = spread.join(F.broadcast(keys) if few else keys, "word").where(F.expr("message RLIKE regex")).select("id", "site", "score").distinct()
    best = hits.groupBy("id").agg(F.max("score").alias("score"))
    return hits.join(best, ["id", "score"]).groupBy("id").agg(F.count("*").alias("n"), F.min("site").alias("site")).where("n = 1").select("id", "site")


def plain_path(path: Column) -> Column:
    """A path with slashes only, without a leading ``./`` or scheme."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:file://|\./)", "")


def at_locations(events: DataFrame, sites: DataFrame, id: str = "id", file: str = "file", line: str = "line") -> DataFrame:
    """``id`` and ``site`` of events that tell where they were written: the closest statement at that line or up to three above.

    ``sites``: ``site``, ``file``, ``line``. Paths agree if one is the other or ends in it after a slash. A
    statement is looked up by its file's name and each line that may be told for it, an equi-join of
    four rows a statement; if several are as close, the event has none. Null paths and lines match nothing.
    """
    name = lambda c: F.regexp_extract(c, r"[^/]*$", 0)
    told = events.select(F.col(id).alias("id"), plain_path(F.col(file)).alias("path"), F.col(line).cast("bigint").alias("at"))
    lines = F.explode(F.sequence(F.col("line").cast("bigint"), F.col("line").cast("bigint") + LINES_ABOVE)).alias("at")
    listed = sites.where("line IS NOT NULL").select("site", plain_path(F.col("file")).alias("own"), F.col("line").cast("bigint").alias("begin"), lines)
    met = told.withColumn("name", name(F.col("path"))).join(listed.withColumn("name", name(F.col("own"))), ["name", "at"])
    slash = lambda c: F.concat(F.lit("/"), c)
    hits = met.where((F.col("path") == F.col("own")) | F.endswith("path", slash(F.col("own"))) | F.endswith("own", slash(F.col("path")))).select("id", "site", "begin").distinct()
    best = hits.groupBy("id").agg(F.max("begin").alias("begin"))
    return hits.join(best, ["id", "begin"]).groupBy("id").agg(F.count("*").alias("n"), F.min("site").alias("site")).where("n = 1").select("id", "site")


def written_by(events: DataFrame, sites: DataFrame, message: str = "message", id: str = "id", file: str = "file", line: str = "line") -> DataFrame:
    """``id``, ``site`` and ``exact`` of events: by the place that they tell, or else by their message.

    ``sites`` has the columns of :func:`attributed` and :func:`at_locations`; a null pattern is found by place only.
    """
    placed = at_locations(events, sites, id, file, line).withColumn("exact", F.lit(True))
    rest = events.join(placed.select(F.col("id").alias(id)), id, "left_anti")
    return placed.union(attributed(rest, sites.where("pattern IS NOT NULL"), message, id).withColumn("exact", F.lit(False)))


def statistics(events: DataFrame, sites_of: DataFrame) -> DataFrame:
    """Hits, errors, quiet failures, last id and duration percentiles (by ceiling rank) of every statement; ``exact`` hits where they are told."""
    rows = events.join(sites_of, "id")
    quiet = F.col("level").isin("trace", "debug", "info") & F.lower("message").rlike(r"\b(fail(ed|ure)?|error|exception)\b") & ~F.lower("message").rlike(r"\b(no|without|0) (fail|error|exception)")
    counted = rows.groupBy("site").agg(F.count("*").alias("hits"), F.count_if(F.col("level").isin("error", "fatal")).alias("errors"), F.count_if(quiet).alias("quiet"), F.max("id").alias("last_id"), *([F.count_if("exact").alias("exact")] if "exact" in sites_of.columns else []))
    ranked = nth_values(rows, ["site"], "duration_ms", {"p50": ceil_rank(0.5), "p95": ceil_rank(0.95)})
    return counted.join(ranked.drop("n"), "site", "left")


def findings(stats: DataFrame) -> DataFrame:
    """Rules over statement statistics, one row a finding: noisy (500 hits and 30 % of all), quiet-failure (3 and half of the hits)."""
    total = stats.agg(F.sum("hits").alias("all"))
    joined = stats.join(F.broadcast(total))
    found = F.array_compact(F.array(F.when((F.col("hits") >= 500) & (F.col("hits") >= 0.3 * F.col("all")) & (F.col("errors") == 0), "noisy"), F.when((F.col("quiet") >= 3) & (2 * F.col("quiet") >= F.col("hits")), "quiet-failure")))
    return joined.select("site", "hits", F.explode(found).alias("rule"))


def health(rows: DataFrame, placeholders: DataFrame, truncated: str | None = None) -> DataFrame:
    """Rules over events with their statement, one row a finding: ``site, hits, rule``.

    ``rows``: ``site, id, level, raw, is_json, fields``; ``placeholders``: ``site`` and how many
    values it formats. oversized: 3 hits, and 8,192 characters on average or cut events (the boolean
    column ``truncated``). contextless: 3 and half of the hits are structured warnings or errors
    without a trace or request id, where at least 50 structured events exist and half of them have
    one. unstructured: 2 values, 3 hits, all plain text. Null texts have no characters.
    """
    known = F.coalesce(field("traceId"), field("requestId"), F.lit("")) != ""
    structured = F.coalesce("is_json", F.lit(False))
    cut = F.coalesce(F.col(truncated), F.lit(False)) if truncated else F.lit(False)
    counted = rows.groupBy("site").agg(
        F.count("*").alias("hits"),
        F.sum(F.length(F.coalesce("raw", F.lit("")))).alias("chars"),
        F.count_if(cut).alias("cut"),
        F.count_if(~structured).alias("plain"),
        F.count_if(structured & known).alias("correlated"),
        F.count_if(structured & ~known & F.col("level").isin("warn", "error", "fatal")).alias("bare"),
    )
    whole = counted.agg((F.sum("hits") - F.sum("plain")).alias("all_structured"), F.sum("correlated").alias("all_correlated"))
    joined = counted.join(F.broadcast(whole)).join(placeholders.groupBy("site").agg(F.max("placeholders").alias("values")), "site", "left")
    many = F.col("hits") >= 3
    rules = {
        "oversized": many & ((F.col("cut") > 0) | (F.col("chars") >= 8192 * F.col("hits"))),
        "contextless": (F.col("all_structured") >= 50) & (2 * F.col("all_correlated") >= F.col("all_structured")) & (F.col("bare") >= 3) & (2 * F.col("bare") >= F.col("hits")),
        "unstructured": many & (F.col("values") >= 2) & (F.col("plain") == F.col("hits")),
    }
    found = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    return joined.select("site", "hits", F.explode(found).alias("rule"))
