"""How services keep to the naming conventions of spans and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.fields import number

#: Attribute names of old conventions, and what replaced them.
RENAMED = {
    "http.method": "http.request.method",
    "http.status_code": "http.response.status_code",
    "http.url": "url.full",
    "http.target": "url.path and url.query",
    "http.scheme": "url.scheme",
    "http.user_agent": "user_agent.original",
    "http.request_content_length": "http.request.body.size",
    "http.response_content_length": "http.response.body.size",
    "net.peer.name": "server.address",
    "net.peer.port": "server.port",
    "net.host.name": "server.address",
    "net.host.port": "server.port",
    "net.sock.peer.addr": "network.peer.address",
    "http.client_ip": "client.address",
    "db.statement": "db.query.text",
    "db.operation": "db.operation.name",
    "db.sql.table": "db.collection.name",
    "messaging.destination": "messaging.destination.name",
}
#: Ids in names of spans, and units at the end of names of metrics.
ID_IN_NAME = r"(?i)(?:^|[/\s=:])(?:\d{2,}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{16,})(?=$|[/\s?&.#])"
UNIT_IN_NAME = r"(?i)[._](ms|millis|milliseconds|seconds|secs|ns|nanoseconds|us|microseconds|bytes|kb|mb|percent)$"
TALLY = "array<struct<check:string,example:string>>"


def _when(check: str, holds: Column, example: Column | None = None) -> Column:
    return F.when(holds, F.struct(F.lit(check).alias("check"), (F.lit(None).cast("string") if example is None else example).alias("example")))


def _old(attributes: Column) -> Column:
    """A tally for each old name among the attributes."""
    return F.transform(F.array_intersect(F.map_keys(attributes), F.array(*map(F.lit, RENAMED))), lambda k: F.struct(F.concat(F.lit("old:"), k).alias("check"), F.lit(None).cast("string").alias("example")))


def _unnamed() -> Column:
    return (F.col("service") == "unknown_service") | F.col("service").startswith("unknown_service:")


def tallies(spans: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """``service, check, hits, names, example`` of what services send: spans, and names of metric series.

    ``spans``: ``service, name, kind, status_code, attributes``; ``metrics``: ``service, name,
    attributes``, a row a series. The check ``server`` counts spans of kind server. ``names`` counts
    distinct examples, ``example`` is the least. Null attributes are none; a null service is one of its own.
    """
    empty = F.create_map().cast("map<string,string>")
    attributes = F.coalesce("attributes", empty)
    has = lambda key: F.coalesce(F.element_at(attributes, key) != "", F.lit(False))
    server = F.coalesce(F.col("kind") == 2, F.lit(False))
    status = number(F.coalesce(F.element_at(attributes, "http.response.status_code"), F.element_at(attributes, "http.status_code")))
    checks = [
        _when("server", server),
        _when("unnamed-service", _unnamed()),
        _when("span-name-ids", F.col("name").rlike(ID_IN_NAME), F.col("name")),
        _when("missing-route", server & (has("http.request.method") | has("http.method")) & ~has("http.route"), F.col("name")),
        _when("unmarked-error", server & (status >= 500) & (F.coalesce("status_code", F.lit(0)) != 2), F.concat_ws(" ", status.cast("long").cast("string"), "name")),
    ]
    found = spans.select("service", F.explode(F.concat(F.array_compact(F.array(*checks)).cast(TALLY), _old(attributes))).alias("t"))
    if metrics is not None:
        named = [_when("unnamed-service", _unnamed()), _when("unit-in-name", F.col("name").rlike(UNIT_IN_NAME), F.col("name"))]
        found = found.union(metrics.select("service", F.explode(F.concat(F.array_compact(F.array(*named)).cast(TALLY), _old(attributes))).alias("t")))
    return found.groupBy("service", "t.check").agg(F.count("*").alias("hits"), F.countDistinct("t.example").alias("names"), F.min("t.example").alias("example"))


def findings(tallied: DataFrame) -> DataFrame:
    """``service, code, severity, hits, example`` of :func:`tallies`; old names of a service are one finding.

    A missing route counts if half of the service's server spans lack it.
    """
    old = F.col("check").startswith("old:")
    code = F.when(old, "old-attributes").otherwise(F.col("check"))
    servers = F.sum(F.when(F.col("check") == "server", F.col("hits")))
    example = F.min(F.when(old, F.substring("check", 5, 200)).otherwise(F.col("example")))
    grouped = tallied.groupBy("service", code.alias("code")).agg(F.sum("hits").alias("hits"), example.alias("example"))
    of = tallied.groupBy(F.col("service").alias("_service")).agg(servers.alias("servers"))
    joined = grouped.join(of, F.col("service").eqNullSafe(F.col("_service"))).where("code <> 'server' AND (code <> 'missing-route' OR 2 * hits >= servers)")
    severity = F.when(F.col("code") == "missing-route", "information").when(F.col("code").isin("old-attributes", "unit-in-name"), "hint").otherwise("warning")
    return joined.select("service", "code", severity.alias("severity"), "hits", "example")
