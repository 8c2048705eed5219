"""Packing of token sequences into windows by minimum bin slack.

Documents longer than a window give full windows and one remainder. Remainders wait in a pool;
when the pool is full (``POOL`` remainders) or the task's rows end, windows are filled one by one:
the longest remainder goes in first, then a subset-sum program over the lengths that are left
picks the multiset that fills the window closest to its capacity. Reachable sums are the bits of
one integer; each length's copies enter in powers of two, so one shift and one "or" bring in a
batch, and walking back over the stored integers gives how many of each length were taken.

What a task has left at its end is cut: the last window's content, if it doesn't fill it, is
split into lengths that are powers of two, which need no padding. So only a window that no
subset fills exactly is padded, and these are rare in a full pool.

No shuffle: Spark deals out the documents, every task packs its own, and windows are numbered by
partition, then counted. A pool holds lengths and references only, so memory is bounded by the
ids of ``POOL`` remainders. Results are the same for the same partitions of the input.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_ids import encoder
from .worker_memory import tidy

#: Remainders that a task gathers before it packs them.
POOL = 4096
#: Windows of one partition.
PER_PARTITION = 1 << 40
MOST_DOCS_AT_ONCE = 512


def fill(counts: dict[int, int], room: int, lengths: list[int] | None = None) -> dict[int, int]:
    """How many of each length bring the sum closest to ``room`` without passing it; ``lengths``: those of ``counts``, longest first.

    >>> fill({5: 2, 4: 1, 3: 3}, 11)
    {5: 1, 3: 2}
    """
    steps: list[tuple[int, int, int]] = []  # sums reachable before, length, copies brought in
    reached, full = 1, 1 << room
    within = (full << 1) - 1
    for length in lengths if lengths is not None else sorted(counts, reverse=True):
        if length > room:
            continue
        left = min(counts[length], room // length)
        copies = 1
        while left and not reached & full:
            copies = min(copies, left)
            steps.append((reached, length, copies))
            reached |= (reached << length * copies) & within
            left -= copies
            copies *= 2
        if reached & full:
            break
    total, taken = reached.bit_length() - 1, defaultdict(int)
    for before, length, copies in reversed(steps):
        if not before >> total & 1:
            taken[length] += copies
            total -= length * copies
    return dict(sorted(taken.items(), reverse=True))


def pack(lengths: dict[int, int], window: int) -> Iterator[dict[int, int]]:
    """Windows as counts of lengths, until nothing is left."""
    counts = dict(lengths)
    order = sorted(counts, reverse=True)
    while order:
        chosen = {order[0]: 1}
        counts[order[0]] -= 1
        for length, n in fill(counts, window - order[0], order).items():
            chosen[length] = chosen.get(length, 0) + n
            counts[length] -= n
        order = [k for k in order if k not in chosen or counts[k]]
        yield chosen


def powers(total: int) -> list[int]:
    """The powers of two that sum to ``total``, largest first."""
    return [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]


class Packer:
    """The pool of one task; ``add`` and ``finish`` return pieces (document's key, start, length, ids, whole length, window, offset)."""

    def __init__(self, window: int, first_window: int):
        self.window, self.next = window, first_window
        self.pool: dict[int, deque] = defaultdict(deque)
        self.size = 0
        self.out: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        start, whole = 0, len(ids)
        while whole - start >= self.window:
            self.out.append((key, start, self.window, ids[start : start + self.window], whole, self.next, 0))
            self.next += 1
            start += self.window
        if start < whole:
            self.pool[whole - start].append((key, start, ids[start:], whole))
            self.size += 1
        if self.size >= POOL:
            self.flush(last=False)

    def _place(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, whole in pieces:
            self.out.append((key, start, len(ids), ids, whole, self.next, offset))
            offset += len(ids)
        self.next += 1

    def flush(self, last: bool) -> None:
        """Fills windows from the pool; those that aren't full go back to it, or are cut at the end."""
        back = []
        for chosen in pack({k: len(v) for k, v in self.pool.items()}, self.window):
            pieces = [self.pool[length].popleft() for length, n in chosen.items() for _ in range(n)]
            if sum(k * n for k, n in chosen.items()) == self.window:
                self._place(pieces)
            else:
                back.append(pieces)
        self.pool.clear()
        self.size = 0
        if not last and sum(map(len, back)) < POOL // 2:
            for piece in (p for pieces in back for p in pieces):
                self.pool[len(piece[2])].append(piece)
                self.size += 1
            return
        self._cut([p for pieces in back for p in pieces])

    def _cut(self, pieces: list[tuple]) -> None:
        """Lays the pieces end to end, cut at full windows and then at powers of two."""
        total = sum(len(p[2]) for p in pieces)
        left = deque(pieces)
        for size in [self.window] * (total // self.window) + powers(total % self.window):
            content = []
            while size:
                key, start, ids, whole = left.popleft()
                if len(ids) > size:
                    left.appendleft((key, start + size, ids[size:], whole))
                    ids = ids[:size]
                content.append((key, start, ids, whole))
                size -= len(ids)
            self._place(content)

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = 4096, text: str = "text", id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row a piece: ``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, and ``ids`` if asked for.

    A null text counts as empty, so its document is its end id alone. Repeated rows are packed each
    for itself. Each id of a document lies in one piece; a window's pieces follow each other from
    offset 0. Columns of ``docs`` other than the two named are not read.
    """
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        own = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(window, TaskContext.get().partitionId() * PER_PARTITION)

        def rows(pieces, kind):
            keys, start, length, ids, whole, sequence, offset = zip(*pieces, strict=True)
            longs = [pa.array(x, pa.int64()) for x in (start, length, [zlib.crc32(x.tobytes()) for x in ids], whole, sequence, offset)]
            more = [pa.array(list(ids), pa.list_(pa.int64()))] if with_ids else []
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *longs, *more], columns + ["ids"] * with_ids)

        kind = None
        for whole_batch in batches:
            kind = whole_batch.column(0).type
            for at in range(0, len(whole_batch), MOST_DOCS_AT_ONCE):
                batch = whole_batch.slice(at, MOST_DOCS_AT_ONCE)
                for key, ids in zip(batch.column(0).to_pylist(), own.run(batch.column(1).to_pylist()), strict=True):
                    packer.add(key, np.frombuffer(ids + end, "<u4"))
                if pieces := packer.take():
                    yield rows(pieces, kind)
        if packer.size:
            packer.flush(last=True)
        if pieces := packer.take():
            yield rows(pieces, kind)

    source = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    longs = ", ".join(f"{c} bigint" for c in columns[1:])
    packed = source.mapInArrow(tidy(run), f"id {kind}, {longs}" + ", ids array<bigint>" * with_ids)
    return packed.withColumnRenamed("id", id)
