"""Removal of long repeated byte strings: difference-cover suffix sorting to the depth that is asked for.

Which ``LENGTH``-byte strings of all texts start in more than one place? That is a question about
neighbours in the order of suffixes, and only their first ``LENGTH`` bytes matter:

1. Sort sampled tuples. Positions whose offset in their text, modulo ``PERIOD``, lies in the
   difference cover are sampled. For any two positions some shift below ``PERIOD`` brings both
   onto the sample. The ``TUPLE`` bytes at each sampled position are sorted, range by range, and
   equal neighbours get a name, their rank in the order. A tuple that stands alone is discarded:
   no repeated string can hold it at that place.
2. Recurse on names. The names of a position and of the one ``PERIOD`` bytes on make a tuple of the
   next level, sorted and named in the same way where both have names. Two levels reach
   ``LENGTH - PERIOD + 1`` bytes, all that two equal strings are sure to share from a sampled
   position on, so the recursion ends there.
3. Merge the remaining suffixes. Positions that reach a named sample within ``PERIOD`` bytes are the only
   ones left. Their strings of ``LENGTH`` bytes are sorted with one another.
4. Compare adjacent prefixes. Equal neighbours are the repeated strings; what they cover is removed.

Order is that of fingerprints, not of letters: any order that puts equal strings side by side
serves. Tuples of steps 1 and 2 travel as the 24 bits of a fingerprint that follow those of their
range, so one in a hundred may collide, which adds candidates and loses none. Step 4 decides removals and
compares 64 bits of a second, independent fingerprint beside the bits of the range of the first:
76 bits at 10^8 candidates, where two different strings of all agree with probability 10^-7, and
91 bits at 10^13, as ranges grow in number with the corpus.

Texts never move. Rows are kept once with the block that they were read in; tasks send sorted
arrays of names, each name once a block, range by range, and what comes back to a block are the
names that other places share, in a file of its block. A string that a third of the texts share
is one name a block. Whole-text copies are found first by digest and only the first is sampled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenlog.scratch import Scratch, small_batches

from .shingle_sets import BASE, OF_BYTE, UNBASE, mix, powers
from .worker_memory import tidy

LENGTH = 200
#: A perfect difference set: each difference modulo the period occurs once. Fixed values.
PERIOD = 57
COVER = [0, 1, 3, 13, 32, 36, 43, 52]
#: Names of a range, about; ranges are sorted in memory.
PER_RANGE = 400_000
#: Bytes of a name that travel, beside the bits of its range: ranges grow in number with the corpus.
SAMPLE_BYTES, STRING_BYTES, STRING_BACK = 3, 8, 7
#: Bytes of text taken together, and names gathered before they are sent.
AT_ONCE, MOST_NAMES = 1 << 21, 6_000_000
#: The second fingerprint: its own number for each byte and its own base.
OF_BYTE_2 = np.random.default_rng(20240301).integers(0, 1 << 64, 256, dtype=np.uint64)
BASE_2 = 0xD1342543DE82EF95
UNBASE_2 = pow(BASE_2, -1, 1 << 64)


def prefix_sums(data: np.ndarray, of_byte: np.ndarray = OF_BYTE, base: int = BASE) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(of_byte[data] * powers(base, len(data)), out=total[1:])
    return total


def names_at(total: np.ndarray, at: np.ndarray, length: int, unbase: int = UNBASE) -> np.ndarray:
    """Fingerprints of the strings of ``length`` bytes that start at ``at``."""
    return mix((total[at + length] - total[at]) * powers(unbase, len(total))[at] + np.uint64(length))


class Texts:
    """Some texts end to end."""

    def __init__(self, texts: list[bytes], length: int):
        self.texts, self.length, self.tuple = texts, length, length - 2 * PERIOD + 1
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(np.concatenate([[0], self.sizes]))[:-1]
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.total = prefix_sums(self.data)

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions at which a tuple fits into their text, in order, and the tuples' fingerprints."""
        cover = np.array(COVER, np.int64)
        found = [np.zeros(0, np.int64)]
        for begin, size in zip(self.begin.tolist(), self.sizes.tolist(), strict=True):
            if size >= self.length:
                own = (np.arange(0, size, PERIOD, dtype=np.int64)[:, None] + cover).ravel()
                found.append(begin + own[own <= size - self.tuple])
        at = np.concatenate(found)
        return at, names_at(self.total, at, self.tuple)

    def pairs(self, at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of named positions those whose text has a named one ``PERIOD`` on, and the fingerprints of both names."""
        if not len(at):
            return at, names
        text = np.searchsorted(self.begin, at, "right")
        then = np.minimum(np.searchsorted(at, at + PERIOD), len(at) - 1)
        both = np.flatnonzero((at[then] == at + PERIOD) & (text[then] == text))
        return at[both], mix(mix(names[both]) * np.uint64(BASE) + names[then[both]])

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Positions whose string reaches one of the sampled positions ``repeated`` within a period."""
        text = np.searchsorted(self.begin, repeated, "right") - 1
        # texts of no bytes share their begin with the next one: the last of them is meant
        low = np.maximum(repeated - PERIOD + 1, self.begin[text])
        high = np.minimum(repeated, self.begin[text] + self.sizes[text] - self.length)
        good = high >= low
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, low[good], 1)
        np.add.at(edge, high[good] + 1, -1)
        return np.flatnonzero(np.cumsum(edge)[:-1] > 0)

    def strings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both fingerprints of the strings at ``at``."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        second = prefix_sums(self.data, OF_BYTE_2, BASE_2)
        return names_at(self.total, at, self.length), names_at(second, at, self.length, UNBASE_2)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(self.data) + 1, np.int32)
        edge[starts] += 1
        np.add.at(edge, starts + self.length, -1)
        return np.cumsum(edge)[:-1] > 0


def ranges(values: np.ndarray, bits: int) -> np.ndarray:
    """The range of each fingerprint: its leading bits."""
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def within(values: np.ndarray, bits: int, size: int) -> np.ndarray:
    """What is kept of a fingerprint beside its range: the next ``size`` bytes."""
    if bits + 8 * size > 64:
        raise ValueError(f"{bits} bits of ranges and {size} bytes are more than a fingerprint has")
    return (values << np.uint64(bits)) >> np.uint64(64 - 8 * size)


def outbox(names: list, bits: int, size: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Names by range, each once: those found once, and those found more often.

    A name is a fingerprint, of which the bytes after its range's bits are kept, or a pair, of whose
    second eight bytes are kept.
    """
    if not names:
        return
    double = isinstance(names[0], tuple)
    values = np.concatenate([x[0] for x in names] if double else names)
    order = np.argsort(values)
    values = values[order]
    keys = np.concatenate([x[1] for x in names])[order] if double else within(values, bits, size)
    parts = ranges(values, bits)
    new = values[1:] != values[:-1]
    if double:
        if (~new & (keys[1:] != keys[:-1])).any():
            order = np.lexsort((keys, values))
            values, keys = values[order], keys[order]
        new |= keys[1:] != keys[:-1]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), new]))
    many = np.diff(first, append=len(values)) > 1
    parts, keys = parts[first], keys[first]
    edges = np.flatnonzero(np.diff(parts, prepend=-1, append=1 << 62))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(parts[a]), packed(keys[a:b][~many[a:b]], size), packed(keys[a:b][many[a:b]], size)


def packed(keys: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def shared_names(rows: DataFrame, size: int, ranked: bool = False, back: int | None = None) -> DataFrame:
    """For every block and range the names of the block that are found in more than one place: ``block``, ``part``, ``names``, ``n_home``.

    The first ``n_home`` of the names are those that no block before has. ``ranks`` has the place of
    each name among the repeated ones of its range, if asked for. Of each name the low ``back``
    bytes come back, all if not given: they only tell the names of one block apart.
    """
    back = back or size

    def compare(group: pa.Table) -> pa.Table:
        once = [unpacked(x, size) for x in group.column("once").to_pylist()]
        often = [unpacked(x, size) for x in group.column("often").to_pylist()]
        ordered = np.sort(np.concatenate([*once, *often, *often]))
        repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        out, ranks, home, seen = [b""] * len(once), [b""] * len(once), [0] * len(once), np.zeros(len(repeated), bool)
        for k in np.argsort(group.column("block").to_numpy(), kind="stable").tolist():
            own = np.concatenate([once[k][np.isin(once[k], repeated, assume_unique=True)], often[k]])
            at = np.searchsorted(repeated, own)
            fresh = ~seen[at]
            seen[at] = True
            order = np.concatenate([np.flatnonzero(fresh), np.flatnonzero(~fresh)])
            out[k], home[k] = packed(own[order], back), int(fresh.sum())
            if ranked:
                ranks[k] = at[order].astype("<u4").tobytes()
        return pa.table({"block": group.column("block"), "part": group.column("part"), "names": pa.array(out, pa.binary()), "n_home": pa.array(home, pa.int32()), "ranks": pa.array(ranks, pa.binary())})

    return rows.groupBy("part").applyInArrow(compare, "block int, part int, names binary, n_home int, ranks binary").where(F.length("names") > 0)


class Held:
    """Names of a block that other places share, to be looked up."""

    def __init__(self, table: pa.Table | None, size: int, home: bool = False):
        rows = [] if table is None else list(zip(*(table.column(c).to_pylist() for c in ("part", "names", "n_home", "ranks")), strict=True))
        keys = [unpacked(x[: n * size] if home else x, size) for _, x, n, _ in rows]
        self.size = size
        parts = np.repeat(np.array([r[0] for r in rows], np.int64), [len(k) for k in keys])
        codes = self.coded(parts, np.concatenate([*keys, np.zeros(0, np.uint64)]))
        ids = np.concatenate([*(np.uint64(part) << np.uint64(32) | np.frombuffer(r, "<u4").astype(np.uint64) for part, _, _, r in rows if r), np.zeros(0, np.uint64)])
        order = np.lexsort((parts, codes))  # a block's batches may each have sent a name
        order = order[np.concatenate([np.ones(min(1, len(order)), bool), (codes[order[1:]] != codes[order[:-1]]) | (parts[order[1:]] != parts[order[:-1]])])]
        self.codes, self.parts, self.ids = codes[order], parts[order], ids[order] if len(ids) else ids

    def coded(self, parts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Range and key as one number, if it has room for both; else the key, and ranges are compared beside it."""
        return keys & np.uint64((1 << 8 * self.size) - 1) if self.size > STRING_BACK - 1 else parts.astype(np.uint64) << np.uint64(8 * self.size) | keys

    def places(self, parts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Where each name stands here, -1 if it doesn't."""
        n = len(self.codes)
        if not n or not len(keys):
            return np.full(len(keys), -1)
        codes = self.coded(parts, keys)
        at = np.searchsorted(self.codes, codes)
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        while len(left):  # once, and again for keys that several ranges have
            there = at[left]
            left = left[(there < n) & (self.codes[np.minimum(there, n - 1)] == codes[left])]
            same = self.parts[at[left]] == parts[left]
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
        return out

    def has(self, values: np.ndarray, bits: int, second: np.ndarray | None = None) -> np.ndarray:
        return self.places(ranges(values, bits), within(values, bits, self.size) if second is None else second) >= 0


class BlockFiles:
    """A table written by block, read block by block inside tasks."""

    def __init__(self, folder: str):
        self.folder = folder
        self._block, self._held = None, {}

    @staticmethod
    def write(df: DataFrame, folder: str) -> str:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        with small_batches(df.sparkSession):
            df.repartition(parts, "block").write.partitionBy("block").option("compression", "uncompressed").parquet(folder)
        return folder

    def read(self, block: int) -> pa.Table | None:
        files, base = fs.FileSystem.from_uri(self.folder)
        found = files.get_file_info(fs.FileSelector(f"{base}/block={block}", allow_not_found=True))
        tables = [pq.read_table(x.path, filesystem=files, partitioning=None) for x in found if x.path.endswith(".parquet")]
        return pa.concat_tables(tables) if tables else None

    def of(self, block: int, make: Callable, *key):
        """``make(table)`` of the block, made once for it."""
        if block != self._block:
            self._block, self._held = block, {}
        if key not in self._held:
            self._held[key] = make(self.read(block))
        return self._held[key]

    def held(self, block: int, size: int, home: bool = False) -> Held:
        return self.of(block, lambda table: Held(table, size, home), size, home)


def _walk(batches, copies: BlockFiles, length: int) -> Iterator[tuple[int, list, Texts, np.ndarray]]:
    """Block, rows, texts to sample, and for each row 1 for a copy, 2 for the first of copies."""
    for whole in batches:
        rows, size = [], 0
        for row in zip(*(column.to_pylist() for column in whole.columns), strict=True):
            if rows and (row[0] != rows[0][0] or size > AT_ONCE):
                yield _texts(rows, copies, length)
                rows, size = [], 0
            rows.append((*row[:3], row[3].encode("utf-8", "surrogatepass"), *row[4:]))
            size += len(rows[-1][3])
        if rows:
            yield _texts(rows, copies, length)


def _texts(rows: list, copies: BlockFiles, length: int):
    named = lambda table: {} if table is None else dict(zip(table.column("row").to_pylist(), table.column("role").to_pylist(), strict=True))
    role = copies.of(rows[0][0], named)
    roles = np.array([role.get(r[1], 0) for r in rows])
    return rows[0][0], rows, Texts([b"" if k == 1 else r[3] for r, k in zip(rows, roles, strict=True)], length), roles


def _send(batches, copies: str, length: int, bits: int, width: int, names) -> Iterator[pa.RecordBatch]:
    held, size, block = [], 0, None

    def flush():
        found = list(outbox(held, bits, width))
        if found:
            part, once, often = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int32()), pa.array(part, pa.int32()), pa.array(once, pa.binary()), pa.array(often, pa.binary())], ["block", "part", "once", "often"])

    for own, _, texts, _ in _walk(batches, BlockFiles(copies), length):
        if held and (own != block or size > MOST_NAMES):
            yield from flush()
            held, size = [], 0
        block = own
        held.append(names(own, texts))
        size += len(held[-1][0]) if isinstance(held[-1], tuple) else len(held[-1])
    yield from flush()


SENT = "block int, part int, once binary, often binary"


def remove_repeats(docs: DataFrame, scratch: Scratch, text: str = "text", id: str = "doc_id", length: int = LENGTH, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """For every row of ``docs``: ``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and ``kept_text`` if asked for.

    ``carry`` names columns that come along unchanged.
    A null text counts as empty. Strings within one text count like those of different texts, and
    repeated rows repeat each other. Strings are judged on the input, so no copy stays. Where a
    removed span cuts a character, ``kept_text`` leaves its other bytes out; the digest has them.
    No more columns of ``docs`` are read; an empty table gives an empty result.
    """
    if length < 2 * PERIOD:
        raise ValueError(f"strings need {2 * PERIOD} bytes or more")
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    carried = [f"carried_{c}" for c in carry]
    kept = scratch.keep(rows.select(F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("row"), "id", "text", *carried, F.unhex(F.sha2("text", 256)).alias("digest")), "texts")
    total = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    long_ = kept.where(F.octet_length("text") >= length).select("block", "row", "digest")
    # kept as a table, so both sides of the join are plain shuffles, of which adaptive execution splits a hot digest
    often = scratch.keep(long_.groupBy("digest").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1"), "often")
    roles = long_.join(often, "digest").select("block", "row", F.when(F.col("row") == F.col("first"), 2).otherwise(1).alias("role"))
    copies = BlockFiles.write(roles, scratch.path("copies"))
    source = kept.select("block", "row", "id", "text")
    with_carried = kept.select("block", "row", "id", "text", *carried)
    bits_of = lambda n: max(4, math.ceil(math.log2(max(1, n) / PER_RANGE + 1)) + 2)
    sampled = total * len(COVER) / PERIOD
    bits = bits_of(sampled), bits_of(sampled / 4), bits_of(total / 4)

    def send(size: int, level: int, names) -> DataFrame:
        return source.mapInArrow(tidy(lambda batches: _send(batches, copies, length, bits[level], size, names())), SENT)

    tuples = BlockFiles.write(shared_names(send(SAMPLE_BYTES, 0, lambda: lambda _, texts: texts.sample()[1]), SAMPLE_BYTES, ranked=True), scratch.path("tuples"))

    def named(files: BlockFiles, block: int, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions with names of the first level, and the fingerprints of their pairs of names."""
        at, values = texts.sample()
        held = files.held(block, SAMPLE_BYTES)
        place = held.places(ranges(values, bits[0]), within(values, bits[0], SAMPLE_BYTES))
        has = place >= 0
        return texts.pairs(at[has], held.ids[place[has]])

    def recurse():
        files = BlockFiles(tuples)
        return lambda block, texts: named(files, block, texts)[1]

    pairs = BlockFiles.write(shared_names(send(SAMPLE_BYTES, 1, recurse), SAMPLE_BYTES), scratch.path("pairs"))

    def remaining(first: BlockFiles, second: BlockFiles, block: int, texts: Texts) -> np.ndarray:
        at, values = named(first, block, texts)
        return texts.candidates(at[second.held(block, SAMPLE_BYTES).has(values, bits[1])])

    def merge():
        first, second = BlockFiles(tuples), BlockFiles(pairs)
        return lambda block, texts: texts.strings(remaining(first, second, block, texts))

    strings = BlockFiles.write(shared_names(send(STRING_BYTES, 2, merge), STRING_BYTES, back=STRING_BACK), scratch.path("strings"))

    def cut(batches):
        first, second, third = BlockFiles(tuples), BlockFiles(pairs), BlockFiles(strings)
        for block, own, texts, roles in _walk(batches, BlockFiles(copies), length):
            at = remaining(first, second, block, texts)
            values, beside = texts.strings(at)
            gone = texts.covered(at[third.held(block, STRING_BACK).has(values, bits[2], beside)])
            out = []
            for k, (_, _, key, data, *_) in enumerate(own):
                n = len(data)
                if roles[k]:
                    out.append((key, n, n, 1, b""))
                    continue
                mask = gone[texts.begin[k] : texts.begin[k] + n]
                removed = int(mask.sum())
                rest = np.frombuffer(data, np.uint8)[~mask].tobytes() if removed else data
                out.append((key, n, removed, int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()), rest))
            keys, n, removed, spans, rest = zip(*out, strict=True)
            longs = [pa.array(x, pa.int64()) for x in (n, removed, spans)]
            digests = pa.array([hashlib.sha256(x).hexdigest() for x in rest])
            more_columns = [pa.array([x.decode("utf-8", "ignore") for x in rest], pa.string())] if with_text else []
            along = [pa.array([r[4 + k] for r in own], types[k + 1]) for k in range(len(carry))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, types[0]), *longs, digests, *more_columns, *along], out_names)

    out_names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text, *carried]
    fields = [rows.schema[c] for c in ("id", *carried)]
    types = [to_arrow_type(f.dataType) for f in fields]
    schema = f"id {fields[0].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * with_text
    schema += "".join(f", {f.name} {f.dataType.simpleString()}" for f in fields[1:])
    return with_carried.mapInArrow(tidy(cut), schema).select(F.col("id").alias(id), *out_names[1 : len(out_names) - len(carried)], *[F.col(f"carried_{c}").alias(c) for c in carry])
