"""Near-duplicate documents: similarity sketches, banding, exact verification, components.

A document is its set of word shingles. Sketches have ``COORDINATES`` values, made in rounds: each
round hashes every shingle to a bin and a value, and bins still empty take their least value; the
rounds end when all are filled, and from round ``COORDINATES`` on each round fills one given bin,
so they do end. Values agree with the probability of the sets' similarity, concentrated as in
independent trials, for one hash of each shingle and round. ``BANDS`` bands of ``ROWS`` values are
the buckets: a pair of similarity 0.8 shares none with probability (1 - 0.8^5)^40, about 1e-7.

Documents with the same set are one node. First each bucket names a pivot, the member whose buckets
are fullest (the middle of its group of copies), and every other member is confirmed on the full
sets against the pivot that it shares most buckets with: a large group costs one test a member.
``ROUNDS`` such rounds are followed by all that is left, the members of a bucket that are not in one
component yet. Buckets of ``SMALL`` members or fewer give pairs, a few for each member. Larger ones
are gathered into clusters; nodes outside a cluster's largest component are its queries, and they
are tested against all of the cluster in blocks: a task holds the sets of some queries, as one
sorted list of shingles with their owners, and streams some of the members past it, so no pair
becomes a row and only one link for a query and component leaves the task.

Sets do not travel: texts of candidates go to their pivot or block, salted so that many members
are spread over tasks, and sets are rebuilt there. The table of equal sets is kept before rows
join it, so both sides of the join are plain shuffles, of which adaptive execution splits a hot digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.scratch import Scratch

from .components import components
from .shingle_sets import BASE, mix, shingle_sets
from .worker_memory import tidy

COORDINATES, BANDS, ROWS = 200, 40, 5
#: Members tested beside one copy of their pivot.
PER_PIVOT = 200
#: Rounds of pivots, and members of a bucket that is tested pair by pair after them.
ROUNDS, SMALL = 1, 8
#: Shingles of the queries that a block holds, about, and members that pass it in one task.
BLOCK, SLICE = 500_000, 1_000
#: Rows that name texts to fetch that may be broadcast; 24 bytes each.
MOST_BROADCAST = 200_000
#: Ids of documents to leave out that may be broadcast; 8 bytes each.
MOST_DROPPED = 200_000


def sketch(shingles: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """The sketch of a set that isn't empty."""
    out = np.full(size, 1 << 63, np.uint64)
    empty, shift, low = size, np.uint64(32), np.uint64(0xFFFFFFFF)
    for turn in range(2 * size):
        hashed = mix(shingles + np.uint64((turn + 1) * BASE & (1 << 64) - 1))
        value = (hashed & low) | np.uint64(turn << 32)
        if turn < size:
            np.minimum.at(out, ((hashed >> shift) * np.uint64(size) >> shift).astype(np.intp), value)
        else:
            out[turn - size] = min(out[turn - size], value.min())
        empty = int((out == 1 << 63).sum())
        if not empty:
            return out
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """A hash of each band's values and of its number, as signed longs."""
    rows = values.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(BASE)
    for k in range(ROWS):
        out = mix(out * np.uint64(BASE) + rows[:, k])
    return out.view(np.int64)


SIGNED = "id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>"


def signatures(docs: DataFrame, text: str, id: str, width: int, lower: bool) -> DataFrame:
    """Size, digest (128 bits) and bands of every row's shingle set; no bands for an empty set."""

    def run(batches):
        for batch in (whole.slice(begin, 256) for whole in batches for begin in range(0, len(whole), 256)):
            n, first, second, buckets = [], [], [], []
            for found in shingle_sets(batch.column(1).to_pylist(), width, lower):
                n.append(len(found))
                digest = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)
                first.append(digest[0])
                second.append(digest[1])
                buckets.append(bands(sketch(found)) if len(found) else np.zeros(0, np.int64))
            offsets = np.cumsum([0] + [len(b) for b in buckets], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*buckets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, first, second)), lists], ["id", "n_shingles", "d1", "d2", "bands"])

    return docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(tidy(run), SIGNED)


def verify(pairs: DataFrame, docs: DataFrame, text: str, id: str, width: int, lower: bool, percent: int) -> DataFrame:
    """Those of ``pairs`` (``pivot``, ``member``) whose full sets are similar enough, as edges ``u``, ``v``."""
    groups = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PER_PIVOT).alias("parts"))
    dealt = pairs.join(groups, "pivot").select("pivot", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), "member")
    wanted = dealt.select("pivot", "part", F.col("member").alias("id")).union(dealt.select("pivot", "part", F.col("pivot").alias("id")).distinct())
    texts = texts_of(wanted, docs, text, id)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    beside = texts.repartition(parts, "pivot", "part").sortWithinPartitions("pivot", "part", (F.col("id") != F.col("pivot")).cast("int"))

    def run(batches):
        at, own = None, None
        for whole in batches:
            for begin in range(0, len(whole), 256):
                batch = whole.slice(begin, 256)
                ids, pivots, salts = (batch.column(c).to_pylist() for c in ("id", "pivot", "part"))
                u, v = [], []
                for key, pivot, salt, found in zip(ids, pivots, salts, shingle_sets(batch.column("text").to_pylist(), width, lower), strict=True):
                    if key == pivot:
                        at, own = (pivot, salt), found
                        continue
                    common = len(np.intersect1d(own, found, assume_unique=True)) if at == (pivot, salt) else 0
                    if common and 100 * common >= percent * (len(own) + len(found) - common):
                        u.append(key)
                        v.append(pivot)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return beside.select("id", "pivot", "part", "text").mapInArrow(tidy(run), "u bigint, v bigint")


def texts_of(wanted: DataFrame, docs: DataFrame, text: str, id: str) -> DataFrame:
    """``wanted`` (with ``id``) and each one's text; broadcast only if it is counted to be few rows."""
    few = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).join(F.broadcast(wanted) if few else wanted, "id")


class Queries:
    """Sets of a block's queries as one sorted list of shingles and their owners."""

    def __init__(self):
        self.nodes: list[int] = []
        self.components: list[int] = []
        self.sets: list[np.ndarray] = []
        self.linked: set[tuple[int, int]] = set()
        self.shingles = None

    def add(self, node: int, component: int, found: np.ndarray) -> None:
        self.nodes.append(node)
        self.components.append(component)
        self.sets.append(found)

    def like(self, component: int, found: np.ndarray, percent: int) -> list[int]:
        """Queries of other components that are similar to a member of ``component`` and not linked with it yet."""
        if not self.sets:
            return []
        if self.shingles is None:
            self.sizes = np.array([len(x) for x in self.sets], np.int64)
            every, owners = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.sizes)
            order = np.argsort(every, kind="stable")
            self.shingles, first = np.unique(every[order], return_index=True)
            self.owners, self.bounds = owners[order], np.append(first, len(every))
            self.of = np.array(self.components, np.int64)
        at = np.minimum(np.searchsorted(self.shingles, found), len(self.shingles) - 1)
        at = at[self.shingles[at] == found]
        begin, size = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        places = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        common = np.bincount(self.owners[places], minlength=len(self.sizes))
        near = (100 * common >= percent * (self.sizes + len(found) - common)) & (self.of != component)
        fresh = [int(k) for k in np.flatnonzero(near) if (int(k), component) not in self.linked]
        self.linked.update((k, component) for k in fresh)
        return [self.nodes[k] for k in fresh]


def verify_blocks(left: DataFrame, docs: DataFrame, scratch: Scratch, text: str, id: str, width: int, lower: bool, percent: int) -> DataFrame:
    """Links between nodes of different components in the open buckets ``left``, as edges ``u``, ``v``."""
    met = left.where(F.col("component") != F.col("first.component")).select(F.col("component").alias("u"), F.col("first.component").alias("v")).distinct()
    clusters = components(met, scratch).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    placed = scratch.keep(left.select("node", "component", "n_shingles").distinct().join(clusters, "component"), "clusters")
    sizes = placed.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    whole = sizes.groupBy("cluster").agg(F.sum("n").alias("nodes"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "component", "shingles")).alias("main"))
    blocks = F.ceil((F.col("shingles") - F.col("main.shingles")) / BLOCK).cast("int")
    dealt = whole.select("cluster", F.col("main.component").alias("main"), F.greatest(blocks, F.lit(1)).alias("blocks"), F.ceil(F.col("nodes") / SLICE).cast("int").alias("slices"))
    rows = placed.join(dealt, "cluster").withColumns({"own_block": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), "own_slice": F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    common = [F.col("node").alias("id"), "component", "cluster"]
    queries = rows.where(F.col("component") != F.col("main")).select(*common, F.col("own_block").alias("block"), every("slices").alias("slice"), F.lit(0).alias("member"))
    members = rows.select(*common, every("blocks").alias("block"), F.col("own_slice").alias("slice"), F.lit(1).alias("member"))
    wanted = scratch.keep(queries.union(members), "blocks")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["cluster", "block", "slice"]
    ordered = texts_of(wanted, docs, text, id).repartition(parts, *keys).sortWithinPartitions(*keys, "member").select(*keys, "member", "id", "component", "text")

    def run(batches):
        at, held = None, Queries()
        for whole in batches:
            for begin in range(0, len(whole), 256):
                batch = whole.slice(begin, 256)
                columns = [c.to_pylist() for c in batch.columns]
                u, v = [], []
                for cluster, block, part, member, node, component, found in zip(*columns[:6], shingle_sets(columns[6], width, lower), strict=True):
                    if at != (cluster, block, part):
                        at, held = (cluster, block, part), Queries()
                    if not member:
                        held.add(node, component, found)
                        continue
                    linked = held.like(component, found, percent)
                    u += linked
                    v += [node] * len(linked)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return ordered.mapInArrow(tidy(run), "u bigint, v bigint")


def groups(docs: DataFrame, scratch: Scratch, text: str = "text", id: str = "doc_id", width: int = 5, lower: bool = True, percent: int = 80) -> DataFrame:
    """For every row of ``docs``: ``id``, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``.

    A null text counts as empty. A text without words has an empty set, is linked with nothing and
    kept. An id names a document: of repeated rows with different texts one text is compared, and
    all get its component. A row with a null id is linked with nothing: its component is null and
    it is kept. Of each group the document with the smallest id is kept. Other columns aren't read.
    """
    signed = scratch.keep(signatures(docs, text, id, width, lower), "signatures")
    known = signed.where("id IS NOT NULL AND n_shingles > 0")
    nodes = known.groupBy("id").agg(F.max(F.struct("d1", "d2", "n_shingles")).alias("x")).select("id", "x.*")
    sets = scratch.keep(nodes.groupBy("d1", "d2").agg(F.min("id").alias("node")), "sets")
    member_of = scratch.keep(nodes.join(sets, ["d1", "d2"]).select("id", "node", "d1", "d2", "n_shingles"), "nodes")
    alone = known.join(member_of.where("id = node"), ["id", "d1", "d2"]).select("node", known["n_shingles"], "bands").dropDuplicates(["node"])
    buckets = alone.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    counted = scratch.keep(buckets.join(shared, "bucket"), "shared")
    weights = counted.groupBy("node").agg(F.sum("n").alias("weight"))
    multi = scratch.keep(counted.join(weights, "node").select("bucket", "node", "n_shingles", "weight", F.col("node").alias("component")), "buckets")
    scratch.drop(counted)
    components_now = None
    for turn in range(ROUNDS + 1):
        order = F.xxhash64("node", F.lit(turn)) if turn else -F.col("weight")
        first = F.struct(order.alias("order"), F.col("node"), F.col("component"), F.col("n_shingles"))
        per = multi.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.min(first).alias("first"))
        open_ = scratch.keep(per.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.min("first").alias("first")).where("parts > 1").drop("parts"), "open")
        if not open_.limit(1).count():
            break
        left = scratch.keep(multi.join(open_, "bucket"), "left")
        if last := turn == ROUNDS:
            few = left.where(F.col("n") <= SMALL)
            other = few.select("bucket", F.col("node").alias("pivot"), F.col("component").alias("of"), F.col("n_shingles").alias("n_pivot"))
            pairs = few.select("bucket", "component", F.col("node").alias("member"), "n_shingles").join(other, "bucket").where((F.col("pivot") < F.col("member")) & (F.col("of") != F.col("component")))
            near = F.least("n_shingles", "n_pivot") * 100 >= F.greatest("n_shingles", "n_pivot") * percent
            pairs = pairs.where(near).select("pivot", "member").distinct()
        else:
            of = F.col("first.n_shingles")
            tested = left.where((F.col("component") != F.col("first.component")) & (F.least("n_shingles", of) * 100 >= F.greatest("n_shingles", of) * percent))
            tests = tested.groupBy(F.col("node").alias("member"), F.col("first.node").alias("pivot")).agg(F.count("*").alias("n"))
            pairs = tests.groupBy("member").agg(F.max(F.struct("n", "pivot")).alias("x")).select("x.pivot", "member")
        pairs = scratch.keep(pairs, "pairs")
        edges = scratch.keep(verify(pairs, docs, text, id, width, lower, percent), "links")
        if last and (many := left.where(F.col("n") > SMALL)).limit(1).count():
            edges = edges.union(scratch.keep(verify_blocks(many, docs, scratch, text, id, width, lower, percent), "links"))
        if components_now is not None:
            edges = edges.union(components_now.select(F.col("node").alias("u"), F.col("component").alias("v")))
        components_now = scratch.keep(components(edges, scratch), "components")
        if last:
            break
        labelled = left.select("bucket", "node", "n_shingles", "weight").join(components_now, "node", "left")
        after = scratch.keep(labelled.select("bucket", "node", "n_shingles", "weight", F.coalesce("component", "node").alias("component")), "buckets")
        for table in (multi, open_, left):
            scratch.drop(table)
        multi = after
    placed = member_of.select("id", "node")
    if components_now is not None:
        placed = placed.join(components_now, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    else:
        placed = placed.select("id", F.col("node").alias("component"))
    out = signed.select("id", "n_shingles").join(placed, "id", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id), "n_shingles", "component_id", (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))


def keep_one(docs: DataFrame, scratch: Scratch, text: str = "text", id: str = "doc_id", width: int = 5, lower: bool = True, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that :func:`groups` doesn't keep; of rows with one id, one stays.

    Columns may have any names. Of rows with one id the first in the order of their other columns stays
    (maps and variants have no order); rows without an id all stay. The ids left out are broadcast if
    they are counted to be few; else the join shuffles texts by id.
    """
    found = scratch.keep(groups(docs, scratch, text, id, width, lower, percent), "groups")
    gone = found.where("NOT kept").select(id).distinct()
    few = gone.limit(MOST_DROPPED + 1).count() <= MOST_DROPPED
    left = docs.join(F.broadcast(gone) if few else gone, id, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if found.where(F.col(id).isNotNull()).groupBy(id).count().where("count > 1").limit(1).count():
        ordered = [F.col(f"`{c}`") for c, kind in left.dtypes if c != id and not any(odd in kind for odd in ("map<", "variant"))]
        rows = left.select(F.col(f"`{id}`").alias("key"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"), F.struct(F.lit(0), *ordered).alias("place"))
        one = rows.where("key IS NOT NULL").groupBy("key").agg(F.min_by("row", "place").alias("row"))
        left = one.select("row").union(rows.where("key IS NULL").select("row")).select("row.*")
    return left
