"""Operators over streams that carry state from batch to batch: stack traces, crashes, network requests.

Spark keeps one state a key in the checkpoint, so a query that is stopped, or loses an executor, goes
on where it was. A batch's rows of one key are handled in order by one task, so a trigger's size
(``maxFilesPerTrigger`` and the like) bounds what a task holds, and a key's state is one event, one
id or one request. Rows of a key that arrive in later batches come after those of earlier ones.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenlog.sources.lines import CONTINUES, MOST_LINES

#: Milliseconds after an error in which a crash belongs to it; and one that ends its process.
ATTACH_MS, EXIT_ATTACH_MS = 2_000, 30_000
#: Milliseconds after which an answered request is told if nothing of its body has come.
UNREAD_MS = 2_000


def _rows(frames: Iterable[pd.DataFrame], *order: str) -> list:
    """The rows of a key's frames in order, nulls first, as tuples with None for nulls."""
    rows = [r for f in frames for r in f.astype(object).where(f.notna(), None).itertuples(index=False)]
    return sorted(rows, key=lambda r: [(v is not None, v) for v in (getattr(r, c) for c in order)])


def _state(state: GroupState) -> dict | None:
    return json.loads(state.get[0]) if state.exists else None


def joined_traces(stream: DataFrame, source: str, order: str, line: str, hold_ms: int = 100) -> DataFrame:
    """Stack traces joined to the line before them, as :func:`lumenlog.sources.lines.joined_traces` gives them of a table.

    A source's last event is held until a line that doesn't continue it, or until nothing has come for
    ``hold_ms`` of processing time; a line that would have continued it begins an event then. Held
    events are in the checkpoint when a query ends and leave in its next run. A query that is to end by
    itself runs no idle batches (:func:`lumenlog.streaming.tail.run_available`). A null line is an
    empty one; rows without a source are a source.
    """
    kinds = dict(stream.dtypes)
    continues = re.compile(CONTINUES).match

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = _state(state), []

        def release() -> None:
            out.append((key[0], held["first"], len(held["lines"]), "\n".join(held["lines"])))

        if state.hasTimedOut:
            release()
            state.remove()
        else:
            for r in _rows(frames, "at"):
                text = r.line or ""
                if held and len(held["lines"]) < MOST_LINES and continues(text):
                    held["lines"].append(text)
                    continue
                if held:
                    release()
                held = {"first": r.at, "lines": [text]}
            state.update((json.dumps(held),))
            state.setTimeoutDuration(hold_ms)
        yield pd.DataFrame(out, columns=["source", "first", "n_lines", "text"], dtype=object)

    rows = stream.select(F.col(source).alias("source"), F.col(order).cast("bigint").alias("at"), F.col(line).alias("line"))
    schema = f"source {kinds[source]}, first bigint, n_lines int, text string"
    return rows.groupBy("source").applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.ProcessingTimeTimeout).withColumnRenamed("source", source)


def crash_links(stream: DataFrame, time: str = "ts", lag: str = "30 seconds") -> DataFrame:
    """For each crash the structured error just before it in its source and session, each error once: ``crash_id``, ``error_id``.

    ``stream`` has ``id, server_id, session_id, level, structured, crash, exits`` and a timestamp
    ``time``. A structured event resets what a crash may follow; an error is remembered for
    ``ATTACH_MS``, by a crash with ``exits`` for ``EXIT_ATTACH_MS``. A run's state goes once the
    watermark, ``lag`` behind the newest event, has passed all that could follow; events later than the
    watermark are left out. Null flags count as false.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            last = _state(state)
            for r in _rows(frames, "id"):
                at = r.ts.timestamp() * 1000
                if r.structured:
                    last = {"id": r.id, "error": r.level in ("error", "fatal"), "at": at}
                elif r.crash and last and last["error"] and at - last["at"] <= (EXIT_ATTACH_MS if r.exits else ATTACH_MS):
                    out.append((r.id, last["id"]))
                    last = None
            if last:
                state.update((json.dumps(last),))
                state.setTimeoutTimestamp(max(int(last["at"]) + EXIT_ATTACH_MS + 1, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["crash_id", "error_id"], dtype=object)

    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("structured", "crash", "exits")]
    rows = stream.withWatermark(time, lag).where(F.col(time).isNotNull()).select("id", "server_id", "session_id", "level", *flags, F.col(time).alias("ts"))
    return rows.groupBy("server_id", "session_id").applyInPandasWithState(run, "crash_id bigint, error_id bigint", "last string", "append", GroupStateTimeout.EventTimeTimeout)


def requests(stream: DataFrame, time: str = "ts", lag: str = "30 seconds", forget_ms: int = 600_000) -> DataFrame:
    """One row a request and hop when it ends: ``tab, request, hop, url, status, duration_ms, state``.

    ``stream`` has ``tab, request, kind, url, status`` and a timestamp ``time``; kinds are ``sent``,
    ``response``, ``data``, ``finished`` and ``failed``. A ``sent`` for a request under way is a
    redirect: the hop before ends with the ``status`` that comes with it. States are ``ok``,
    ``error`` (status 400 and up), ``failed``; ``unread`` for an answer of whose body nothing came
    for ``UNREAD_MS``, told once with the time to its answer, after which only a failure is told too;
    and ``pending`` for a request that nothing was heard of for ``forget_ms``. Those times end when the
    watermark, ``lag`` behind the newest event, has passed them. Ends of unknown requests, and events
    later than the watermark, are left out. Rows without tab or request are a request; of one time, kinds
    count in the order above.
    """
    kinds = dict(stream.dtypes)
    turn = {kind: n for n, kind in enumerate(("sent", "response", "data", "finished", "failed"))}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, now = [], _state(state)

        def tell(end: float | None, how: str | None = None, status: int | None = None) -> None:
            code = now["status"] if status is None else status
            named = how or ("error" if code is not None and code >= 400 else "ok")
            out.append((*key, now["hop"], now["url"], code, None if end is None else end - now["sent"], named))

        if state.hasTimedOut:
            due = now["answered"] is not None and not now["told"]
            if due:
                tell(now["answered"], "unread")
                now["told"] = True
            elif not now["told"]:
                tell(None, "pending")
            if not due:
                now = None
        else:
            for r in _rows(frames, "ts", "turn"):
                at = r.ts.timestamp() * 1000
                if r.kind == "sent":
                    if now and not now["told"]:
                        tell(at, status=r.status)
                    now = {"hop": now["hop"] + 1 if now else 0, "url": r.url, "sent": at, "status": None, "answered": None, "heard": at, "told": False}
                elif now and r.kind == "response":
                    now |= {"status": r.status, "answered": at, "heard": at}
                elif now and r.kind == "data":
                    now["heard"] = at
                elif now and r.kind in ("finished", "failed"):
                    if r.kind == "failed" or not now["told"]:
                        tell(at, "failed" if r.kind == "failed" else None)
                    now = None
        if now:
            state.update((json.dumps(now),))
            wait = forget_ms if now["told"] or now["answered"] is None else UNREAD_MS
            state.setTimeoutTimestamp(max(int(now["heard"]) + wait, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["tab", "request", "hop", "url", "status", "duration_ms", "state"], dtype=object)

    order = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(n)) for kind, n in turn.items()], F.lit(len(turn)))
    rows = stream.withWatermark(time, lag).where(F.col(time).isNotNull()).select("tab", "request", "kind", "url", F.col("status").cast("int").alias("status"), F.col(time).alias("ts"), order.alias("turn"))
    schema = f"tab {kinds['tab']}, request {kinds['request']}, hop int, url string, status int, duration_ms double, state string"
    return rows.groupBy("tab", "request").applyInPandasWithState(run, schema, "request string", "append", GroupStateTimeout.EventTimeTimeout)


def rates(stream: DataFrame, series: str = "series", time: str = "ts", value: str = "total", id: str = "id", lag: str = "60 seconds", keep_ms: int = 3_600_000) -> DataFrame:
    """Change a second of cumulative counters as their points come: ``series``, ``id``, ``time_ms``, ``rate``.

    As :func:`lumenlog.operators.metrics.rates` after :func:`~lumenlog.operators.metrics.without_late`, with ``id``
    as the order of arrival: a point that isn't later than its series' newest is left out, a drop is a
    restart from zero, a first point and one without a value have no rate. A series' newest point is kept until the
    watermark, ``lag`` behind the newest of all, is ``keep_ms`` past it; then the series begins anew. Points
    later than the watermark, and points without a time, are left out. A null series is a series.
    """
    kinds = dict(stream.dtypes)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            last = _state(state)
            for r in _rows(frames, "id", "ts"):
                at = r.ts.timestamp() * 1000
                if last and at <= last["at"]:
                    continue
                change = r.total
                if last and last["total"] is not None and r.total is not None and r.total >= last["total"]:
                    change = r.total - last["total"]
                out.append((key[0], r.id, at, None if last is None or change is None else change / ((at - last["at"]) / 1000)))
                last = {"at": at, "total": r.total}
            state.update((json.dumps(last),))
            state.setTimeoutTimestamp(max(int(last["at"]) + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["series", "id", "time_ms", "rate"], dtype=object)

    rows = stream.withWatermark(time, lag).where(F.col(time).isNotNull()).select(F.col(series).alias("series"), F.col(id).alias("id"), F.col(value).cast("double").alias("total"), F.col(time).alias("ts"))
    schema = f"series {kinds[series]}, id {kinds[id]}, time_ms double, rate double"
    return rows.groupBy("series").applyInPandasWithState(run, schema, "last string", "append", GroupStateTimeout.EventTimeTimeout)
