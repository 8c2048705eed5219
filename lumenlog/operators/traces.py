"""Trees of spans: rows in depth-first order, critical path, self time, summaries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenlog.scratch import Scratch

from .scans import ranged, running

#: Spans of a trace that is walked within one task; larger ones are dealt out.
MOST_SPANS = 10_000


def distinct_spans(spans: DataFrame) -> DataFrame:
    """One span a trace and id: the earliest."""
    order = Window.partitionBy("trace_id", "span_id").orderBy("start_ms", "end_ms", "name", "status_code")
    return spans.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def with_roots(spans: DataFrame) -> DataFrame:
    """``spans`` with ``parent_id`` null where the parent isn't in the trace or is the span itself."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("_there"))
    joined = spans.join(parents, ["trace_id", "parent_id"], "left")
    return joined.withColumn("parent_id", F.when(F.col("_there") & (F.col("parent_id") != F.col("span_id")), F.col("parent_id"))).drop("_there")


def _climbed(nodes: DataFrame, scratch: Scratch, join) -> DataFrame:
    """``nodes`` whose ``up`` has been led to a root, where it is null.

    Each round every node takes over what the node at ``up`` has, so the distance doubles: as many
    rounds as the logarithm of the deepest tree. ``join(low, high)`` gives the columns that are carried on
    of a node and of the one at its ``up``. Nodes that reach no root, on a cycle or above a gap,
    are left out once a round leads none to a root.
    """
    names = [c for c in nodes.columns if c not in ("trace_id", "span_id", "up")]
    now, before = scratch.keep(nodes, "nodes"), None
    while (left := now.where("up IS NOT NULL").count()) and left != before:
        high = now.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in names])
        carried = now.where("up IS NOT NULL").join(high, ["trace_id", "up"])
        moved = carried.select("trace_id", "span_id", F.col("_up").alias("up"), *[join(c).alias(c) for c in names])
        after = scratch.keep(now.where("up IS NULL").unionByName(moved), "nodes")
        scratch.drop(now)
        now, before = after, left
    return now.where("up IS NULL")


def _walked(batches, names: list[str], schema: pa.Schema):
    """Rows of :func:`_toured` of batches in order of trace, start, end and id; what is held is a batch and the rest of one trace."""
    held: dict[str, list] = {}

    def walk(rows: dict[str, list]) -> pa.RecordBatch:
        traces, ids, parents, starts = (rows[c] for c in ("trace_id", "span_id", "parent_id", "start_ms"))
        place = {key: i for i, key in enumerate(zip(traces, ids, strict=True))}
        up = [None if p is None or p == s or t is None else place.get((t, p)) for t, s, p in zip(traces, ids, parents, strict=True)]
        first, after, last, depth, sums = ([None] * len(ids) for _ in range(5))
        roots, order, values = [], [], list(zip(*[rows[c] for c in names], strict=True)) if names else []
        for i in range(len(ids) - 1, -1, -1):
            if up[i] is None:
                roots.append(i)
            else:
                after[i], first[up[i]] = first[up[i]], i
        total = [0] * len(names)
        base, bases, lows = 0, [None] * len(ids), {}
        for n, root in enumerate(reversed(roots)):
            if n and traces[root] != traces[order[-1]]:
                base = len(order)
            at, deep = root, 0
            while at is not None:
                order.append(at)
                depth[at], bases[at] = deep, base
                if starts[at] is not None:
                    lows[base] = min(lows.get(base, starts[at]), starts[at])
                if names:
                    total = [a + b for a, b in zip(total, values[at], strict=True)]
                    sums[at] = total
                if first[at] is not None:
                    at, deep = first[at], deep + 1
                    continue
                while at is not None:  # it ends, and so do those whose last child it is
                    last[at] = len(order)
                    if names:
                        sums[at] = [b - a for a, b in zip(sums[at], total, strict=True)]
                    if after[at] is not None:
                        at = after[at]
                        break
                    at, deep = up[at], deep - 1
        out = [
            [traces[i] for i in order],
            [ids[i] for i in order],
            [depth[i] for i in order],
            [n - bases[i] + 1 for n, i in enumerate(order)],
            [last[i] - bases[i] for i in order],
            [None if starts[i] is None else starts[i] - lows[bases[i]] for i in order],
            *[[sums[i][k] for i in order] for k in range(len(names))],
        ]
        return pa.record_batch([pa.array(x, type=f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    for batch in batches:
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            held.setdefault(name, []).extend(column.to_pylist())
        cut = len(held["trace_id"])
        while cut and held["trace_id"][cut - 1] == held["trace_id"][-1]:
            cut -= 1
        if cut:
            yield walk({c: v[:cut] for c, v in held.items()})
            held = {c: v[cut:] for c, v in held.items()}
    if held.get("trace_id"):
        yield walk(held)


def _ranked(spans: DataFrame, names: list[str], scratch: Scratch) -> DataFrame:
    """Rows of :func:`_toured` of traces of any size: a list of entering and leaving each span, whose places are found by doubling.

    A span is entered before its first child, and left before its next sibling or its parent is; what
    each place knows is the spans and numbers from there to its trace's end. Keys are structs, so
    that nulls are keys.
    """
    order, side = ["start_ms", "end_ms", "span_id"], lambda id, out: F.struct(id, F.lit(out).alias("out"))
    id, up = F.col("span_id"), F.col("parent_id").alias("span_id")
    keys = ["trace_id", "parent_id"]
    beside = running(ranged(with_roots(spans), keys, order, scratch), keys, order, {"_next": ("last", F.struct("span_id"))}, backwards=True)
    own = scratch.keep(beside.drop("_range"), "siblings")
    firsts = own.where("parent_id IS NOT NULL").groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.min(F.struct(*order))["span_id"].alias("_first"))
    found = own.join(firsts, ["trace_id", "span_id"], "left")
    nothing = [F.lit(0).cast(own.schema[c].dataType).alias(c) for c in names]
    trace = F.struct("trace_id").alias("trace_id")
    down = F.when(F.col("_first").isNotNull(), side(F.col("_first").alias("span_id"), False)).otherwise(side(id, True))
    along = F.when(F.col("_next").isNotNull(), side(F.col("_next.span_id").alias("span_id"), False)).when(F.col("parent_id").isNotNull(), side(up, True))
    one = lambda n: F.lit(n).cast("bigint")
    entered = found.select(trace, side(id, False).alias("span_id"), down.alias("up"), one(1).alias("_n"), one(1).alias("_deep"), *names)
    left = own.select(trace, side(id, True).alias("span_id"), along.alias("up"), one(0).alias("_n"), one(-1).alias("_deep"), *nothing)
    places = _climbed(entered.unionByName(left), scratch, lambda c: F.col(c) + F.col(f"_{c}"))
    of = lambda c, out: F.max(F.when(F.col("span_id.out") == out, F.col(c)))
    ends = places.groupBy(F.col("trace_id.trace_id").alias("trace_id"), F.col("span_id.span_id").alias("span_id")).agg(
        of("_n", False).alias("_from"), of("_n", True).alias("_to"), of("_deep", False).alias("_deep"), *[(of(c, False) - of(c, True)).alias(f"_all_{c}") for c in names]
    )
    joined = scratch.keep(ends.join(own.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), "start_ms", *names), F.col("trace_id").eqNullSafe(F.col("_t")) & F.col("span_id").eqNullSafe(F.col("_s"))), "places")
    traces = joined.groupBy("_t").agg(F.max("_from").alias("_size"), F.min("start_ms").alias("_low"))
    rows = joined.drop("_t").join(traces, F.col("trace_id").eqNullSafe(F.col("_t")))
    number = lambda c: c.cast("int")
    return rows.select(
        "trace_id", "span_id", number(-F.col("_deep")).alias("depth"), number(F.col("_size") - F.col("_from") + 1).alias("ordinal"), number(F.col("_size") - F.col("_to")).alias("last"),
        (F.col("start_ms") - F.col("_low")).alias("offset_ms"), *[(F.col(f"_all_{c}") - F.col(c)).alias(c) for c in names],
    )


def _toured(spans: DataFrame, scratch: Scratch, names: list[str] | None = None, most: int = MOST_SPANS) -> DataFrame:
    """Depth, ordinal, last ordinal beneath, offset, and sums beneath of the columns ``names``, of every span that a root reaches.

    Roots and children stand in order of start, end and id. Traces of ``most`` spans at most are
    walked whole within tasks, many in each; those of larger ones are dealt out span by span.
    """
    names = names or []
    own = scratch.keep(spans.select("trace_id", "span_id", "parent_id", "start_ms", "end_ms", *names), "spans")
    large = scratch.keep(own.groupBy(F.col("trace_id").alias("_t")).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("_t"), "large")
    is_large = F.col("trace_id").eqNullSafe(F.col("_t"))
    any_large = bool(large.head(1))
    small = own.join(large, is_large, "left_anti") if any_large else own
    type_of = lambda c: own.schema[c].dataType.simpleString()
    schema = ", ".join(f"`{n}` {t}" for n, t in {"trace_id": type_of("trace_id"), "span_id": type_of("span_id"), "depth": "int", "ordinal": "int", "last": "int", "offset_ms": type_of("start_ms"), **{c: type_of(c) for c in names}}.items())
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    dealt = small.select("trace_id", "span_id", "parent_id", "start_ms", "end_ms", *names).repartition("trace_id").sortWithinPartitions("trace_id", "start_ms", "end_ms", "span_id").drop("end_ms")
    walked = dealt.mapInArrow(lambda batches: _walked(batches, names, arrow), schema)
    return walked.unionByName(_ranked(own.join(large, is_large, "left_semi"), names, scratch)) if any_large else walked


def waterfall(spans: DataFrame) -> DataFrame:
    """Depth, ordinal in depth-first order and offset from the trace's start of every span that a root reaches.

    Siblings stand in order of start, end and id. Ids are distinct in a trace
    (:func:`distinct_spans`); spans on a cycle have no root and no row, of any depth none is cut.
    """
    return _toured(spans, Scratch(spans.sparkSession, "waterfall")).select("trace_id", "span_id", "depth", "ordinal", "offset_ms")


def self_times(spans: DataFrame) -> DataFrame:
    """Duration of every span less the union of its children's time within it; a span is no child of itself."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to"))
    clipped = spans.join(parents, ["trace_id", "parent_id"]).select("trace_id", "parent_id", F.greatest("start_ms", "_from").alias("a"), F.least("end_ms", "_to").alias("b"), "span_id").where("b > a AND span_id <> parent_id").drop("span_id")
    keys, order = ["trace_id", "parent_id"], ["a", "b"]
    own = ranged(clipped, keys, order, Scratch(spans.sparkSession, "self-times"))
    fresh = running(own, keys, order, {"_before": ("max", F.col("b"))}).select("trace_id", F.col("parent_id").alias("span_id"), F.greatest(F.lit(0.0), F.col("b") - F.greatest("a", F.coalesce("_before", "a"))).alias("covered"))
    covered = fresh.groupBy("trace_id", "span_id").agg(F.sum("covered").alias("covered"))
    joined = spans.join(covered, ["trace_id", "span_id"], "left")
    return joined.withColumn("self_ms", F.greatest(F.lit(0.0), F.col("end_ms") - F.col("start_ms") - F.coalesce("covered", F.lit(0.0)))).drop("covered")


def hotspots(spans: DataFrame, top: int = 8) -> DataFrame:
    """Services and names with the most self time, with their share of all."""
    grouped = self_times(spans).groupBy("service", "name").agg(F.count("*").alias("spans"), F.sum("self_ms").alias("self_ms"), F.count_if(F.col("status_code") == 2).alias("errors"))
    total = grouped.agg(F.sum("self_ms").alias("_all"))
    share = F.floor(F.col("self_ms") / F.col("_all") * 1000 + 0.5) / 1000
    return grouped.join(F.broadcast(total)).withColumn("share", share).drop("_all").where("self_ms > 0").orderBy(F.desc("self_ms"), "name").limit(top)


def summaries(spans: DataFrame) -> DataFrame:
    """One row a trace: root's name and service, services, start, duration, spans, errors."""
    root = F.when(F.col("parent_id").isNull(), F.struct("start_ms", "end_ms", "span_id"))
    return with_roots(spans).groupBy("trace_id").agg(
        F.min_by("name", root).alias("root_name"),
        F.min_by("service", root).alias("root_service"),
        F.array_join(F.array_sort(F.collect_set("service")), ",").alias("services"),
        F.min("start_ms").alias("start_ms"),
        (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"),
        F.count("*").alias("spans"),
        F.count_if(F.col("status_code") == 2).alias("errors"),
    )


def critical_paths(spans: DataFrame) -> DataFrame:
    """From the root that ends last, the child that ends last, and so on down: the spans of each trace's critical path.

    Of roots with equal ends the first counts, of children the last, by start and id. Ids are
    distinct in a trace, as for :func:`waterfall`.
    """
    scratch = Scratch(spans.sparkSession, "critical_paths")
    rooted = scratch.keep(with_roots(spans).select("trace_id", "span_id", "parent_id", "start_ms", "end_ms"), "rooted")
    roots = Window.partitionBy("trace_id").orderBy(F.desc("end_ms"), "start_ms", "span_id")
    first = rooted.where("parent_id IS NULL").withColumn("_n", F.row_number().over(roots)).where("_n = 1")
    last = Window.partitionBy("trace_id", "parent_id").orderBy(F.desc("end_ms"), F.desc("start_ms"), F.desc("span_id"))
    chosen = rooted.where("parent_id IS NOT NULL").withColumn("_n", F.row_number().over(last)).where("_n = 1")
    nodes = first.select("trace_id", "span_id", F.col("parent_id").alias("up"), F.lit(0).alias("step")).union(chosen.select("trace_id", "span_id", "parent_id", F.lit(1)))
    return _climbed(nodes, scratch, lambda c: F.col(c) + F.col(f"_{c}")).select("trace_id", "span_id", "step")


def intervals(spans: DataFrame) -> DataFrame:
    """Interval numbers of the trees: ``trace_id``, ``span_id``, ``ordinal`` and ``last``, the greatest ordinal beneath or at a span.

    Ordinals are those of :func:`waterfall`. Spans on a cycle have no row, ids are distinct in a trace.
    """
    return _toured(spans, Scratch(spans.sparkSession, "intervals")).select("trace_id", "span_id", "ordinal", "last")


def subtree_sums(spans: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """For every span the sums of ``names`` over all spans beneath it, itself not included: a difference of prefix sums.

    ``values`` has ``trace_id``, ``span_id`` and numbers; spans without a row or a number there count as
    0. Sums are exact for whole numbers and, as differences of doubles, near for others. Traces of any depth.
    """
    each = values.groupBy("trace_id", "span_id").agg(*[F.sum(c).alias(c) for c in names])
    rows = spans.select("trace_id", "span_id", "parent_id", "start_ms", "end_ms").join(each, ["trace_id", "span_id"], "left")
    filled = rows.withColumns({c: F.coalesce(c, F.lit(0).cast(each.schema[c].dataType)) for c in names})
    return _toured(filled, Scratch(spans.sparkSession, "subtrees"), names).select("trace_id", "span_id", "ordinal", "last", *names)
