"""Pages, context, order, retention and joins of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.fields import field, number
from lumenlog.functions.text import natural_key
from lumenlog.scratch import Scratch

from .scans import numbered, ranged, running


def newest(events: DataFrame, condition: Column, size: int = 1000, before: int | None = None) -> DataFrame:
    """The newest matching events; ``before`` continues from an id (keyset paging)."""
    rows = events.where(condition)
    if before is not None:
        rows = rows.where(F.col("id") < before)
    return rows.orderBy(F.desc("id")).limit(size)


def context(events: DataFrame, anchors: DataFrame, around: int = 25) -> DataFrame:
    """The events before and after each anchor (``id``) in its source and session, with their distance.

    Rows are numbered within source and session (ranges of a hot one are numbered apart), and
    neighbours found by an equi-join on the number, so an anchor costs its neighbours only. Events
    without a source or session are a group too.
    """
    keys = ["server_id", "session_id"]
    own = ranged(events.select("id", *keys), keys, ["id"], Scratch(events.sparkSession, "context"))
    placed = numbered(own, keys, ["id"], "place")
    wanted = placed.join(anchors.select("id"), "id", "left_semi").select(F.col("id").alias("anchor"), "server_id", "session_id", F.explode(F.sequence(F.col("place") - around, F.col("place") + around)).alias("place"), F.col("place").alias("own"))
    there = placed.select("id", F.struct(*keys).alias("of"), "place")  # a struct of nulls is a key too
    return there.join(wanted.withColumn("of", F.struct(*keys)).drop(*keys), ["of", "place"]).select("anchor", "id", (F.col("place") - F.col("own")).alias("distance"))


def sorted_by(events: DataFrame, name: str, size: int, descending: bool = False) -> DataFrame:
    """The first events by a field: numbers by value, then texts in natural order, missing ones last either way."""
    text = F.nullif(field(name), F.lit(""))
    keyed = events.withColumns({"_number": number(text), "_text": natural_key(text)})
    kind = F.when(text.isNull(), 2).when(F.col("_number").isNull(), 1).otherwise(0)
    direction = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    return keyed.orderBy(kind, direction("_number"), direction("_text"), "id").limit(size).drop("_number", "_text")


def size_estimate() -> Column:
    """Bytes that an event takes, about."""
    texts = F.length("message") + F.length("raw") + F.length("server_id")
    return (256 + 2 * texts + F.aggregate(F.map_entries("fields"), F.lit(0), lambda s, e: s + 32 + 2 * (F.length(e["key"]) + F.length(e["value"])))).cast("long")


def retained(events: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """The newest events within both bounds.

    Ids are dealt into 1,000 cells between the least and greatest; whole cells are kept from the
    newest on while they fit, and only the cell that doesn't fit is numbered row by row.
    """
    sized = events.withColumn("_size", size_estimate())
    ends = sized.agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    cell = F.floor((F.col("id") - F.col("_low")) * 1000 / (F.col("_high") - F.col("_low") + 1)).cast("int")
    celled = sized.join(F.broadcast(ends)).withColumn("_cell", cell)
    counted = celled.groupBy("_cell").agg(F.count("*").alias("_rows"), F.sum("_size").alias("_bytes"))
    newer = Window.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)  # 1,000 rows at most
    before = counted.select("_cell", F.coalesce(F.sum("_rows").over(newer), F.lit(0)).alias("_rows_before"), F.coalesce(F.sum("_bytes").over(newer), F.lit(0)).alias("_bytes_before"), "_rows", "_bytes")
    fits = (F.col("_rows_before") + F.col("_rows") <= most_rows) & (F.col("_bytes_before") + F.col("_bytes") <= most_bytes)
    starts = (F.col("_rows_before") < most_rows) & (F.col("_bytes_before") < most_bytes)
    marked = celled.join(F.broadcast(before.select("_cell", "_rows_before", "_bytes_before", fits.alias("_fits"), starts.alias("_starts"))), "_cell")
    order = Window.partitionBy("_cell").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    edge = marked.where("_starts AND NOT _fits").withColumns({"_r": F.count("*").over(order) + F.col("_rows_before"), "_b": F.sum("_size").over(order) + F.col("_bytes_before")})
    partly = edge.where((F.col("_r") <= most_rows) & (F.col("_b") <= most_bytes))
    return marked.where("_fits").select(*events.columns).union(partly.select(*events.columns))


def crash_links(events: DataFrame, is_structured: Column, is_crash: Column, window_ms: float = 2000) -> DataFrame:
    """For each crash the structured error just before it in its source and session, each error once.

    As-of join: the last structured event before the crash must be an error within the window; a
    structured event in between resets it.
    """
    keys = ["server_id", "session_id"]
    own = ranged(events.select("id", "ts_ms", "level", *keys, is_structured.alias("_structured"), is_crash.alias("_crash")), keys, ["id"], Scratch(events.sparkSession, "crashes"))
    last = F.when(F.col("_structured"), F.struct("id", "ts_ms", "level"))
    found = running(own, keys, ["id"], {"_last": ("last", last)}).where((F.col("_last.level") == "error") & F.col("_crash") & (F.col("ts_ms") - F.col("_last.ts_ms") <= window_ms))
    return found.groupBy(F.col("_last.id").alias("error_id")).agg(F.min("id").alias("crash_id")).select("crash_id", "error_id")


def merged_ranges(ranges: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """Unions of overlapping or touching whole-number ranges of each key."""
    # One row a place: of equal rows, which stand in any order, either walk below might take another one as an island's first.
    longest = ranges.groupBy(key, first).agg(F.max(last).alias(last))
    own = ranged(longest, [key], [first], Scratch(ranges.sparkSession, "ranges"))
    seen = running(own, [key], [first], {"_before": ("max", F.col(last))}).withColumn("_new", F.when(F.col(first) > F.col("_before") + 1, 1).otherwise(0))
    island = running(seen, [key], [first], {"_island": ("sum", F.col("_new"))}, "upto")
    return island.groupBy(key, "_island").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("_island")


def in_ranges(rows: DataFrame, ranges: DataFrame, key: str, at: str, first: str, last: str, width: int = 1000) -> DataFrame:
    """Rows whose place lies in a range of their key (semi-join): an equi-join on the cells that ranges touch."""
    cells = ranges.select(key, first, last, F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))).alias("_cell"))
    celled = rows.withColumn("_cell", F.floor(F.col(at) / width))
    inside = (celled[at] >= cells[first]) & (celled[at] <= cells[last])
    return celled.join(cells, (celled[key] == cells[key]) & (celled["_cell"] == cells["_cell"]) & inside, "left_semi").drop("_cell")


def diff_ranges(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """Changed lines of unified diffs as ranges ``key, a, b`` of the new file; a removal counts at the line after it.

    Null and empty diffs have none. Rows of one key are merged.
    """
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    start = F.struct(F.lit(0).cast("bigint").alias("line"), F.lit(False).alias("inside"), F.array().cast("array<bigint>").alias("changed"))

    def step(s: Column, text: Column) -> Column:
        first, file = text.rlike(hunk), text.startswith("diff --git ")
        added, removed = text.startswith("+"), text.startswith("-")
        line = F.when(first, F.regexp_extract(text, hunk, 1).try_cast("bigint")).when(s["inside"] & ~file & (added | text.startswith(" ") | (text == "")), s["line"] + 1).otherwise(s["line"])
        counts = ~first & ~file & s["inside"] & (added | removed)
        at = F.when(removed, F.greatest(s["line"], F.lit(1))).otherwise(s["line"])
        changed = F.when(counts, F.concat(s["changed"], F.array(at))).otherwise(s["changed"])
        return F.struct(line.alias("line"), (first | s["inside"] & ~file).alias("inside"), changed.alias("changed"))

    lines = diffs.select(F.col(key).alias(key), F.explode(F.array_distinct(F.aggregate(F.split(diff, r"\r?\n"), start, step)["changed"])).alias("a"))
    return merged_ranges(lines.withColumn("b", F.col("a")), key, "a", "b")
