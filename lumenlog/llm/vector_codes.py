"""Codes of vectors: each part of a vector becomes the number of its codebook's nearest entry.

Vectors are cut into equal parts, and each part's place has a codebook of its own. In every round
the driver builds a kd-tree over each codebook (some entries, whatever the number of vectors) and
broadcasts the trees; tasks look up the parts of a block of vectors together. A search goes down to
the nearer child first and visits the other for those queries whose bound is not above the best
distance so far: equal bounds are visited too, so of equally near entries the lower index is found
wherever in the tree it stands. Sums of integers go up a tree of partial sums and give the next
round's entries; all numbers are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.scratch import Scratch

from .vectors import exact, floors, integers, keep_blocks, largest, longs, over_blocks, sums, usable, whole

#: Entries of a leaf at most, unless they are all alike.
LEAF = 2


class Tree:
    """A kd-tree over the entries (rows of integers) of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._split(list(range(len(entries))))

    def _split(self, some: list[int]):
        """A leaf, the list of its entries; or the dimension, the largest value left of the cut, the least right of it, and both children."""
        values = self.entries[some]
        spread = [int(c.max()) - int(c.min()) for c in values.T]
        if len(some) <= LEAF or not max(spread, default=0):
            return some
        dim = spread.index(max(spread))
        ordered = sorted(some, key=lambda e: self.entries[e][dim])
        at = lambda place: self.entries[ordered[place]][dim]
        cuts = [place for place in range(1, len(ordered)) if at(place - 1) < at(place)]
        cut = min(cuts, key=lambda place: abs(2 * place - len(ordered)))
        return dim, int(at(cut - 1)), int(at(cut)), self._split(ordered[:cut]), self._split(ordered[cut:])

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the nearest entry's index, the lowest of equally near ones, and the squared distance."""
        bound = 4 * max(queries.shape[1], 1) * max(largest(queries), largest(self.entries), 1) ** 2
        x, entries = exact(queries, bound), exact(self.entries, bound)
        best, found = np.full(len(x), bound, x.dtype), np.full(len(x), len(entries), np.intp)

        def visit(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, list):
                for e in node:
                    distance = ((x[at] - entries[e]) ** 2).sum(1)
                    better = (distance < best[at]) | (distance == best[at]) & (e < found[at])
                    best[at[better]], found[at[better]] = distance[better], e
                return
            dim, below, above, left, right = node
            value = x[at, dim]
            bounds = [np.maximum(value - below, 0) ** 2, np.maximum(above - value, 0) ** 2]
            nearer_left = (bounds[0] <= bounds[1]).astype(bool)
            visit(left, at[nearer_left])
            visit(right, at[~nearer_left])
            for child, bound_of, there in ((right, bounds[1], nearer_left), (left, bounds[0], ~nearer_left)):
                rest, least = at[there], bound_of[there]
                visit(child, rest[(least <= best[rest]).astype(bool)])

        visit(self.root, np.arange(len(x)))
        return found, best


def cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def sha_of(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in codebooks for entry in book for v in entry).encode()).hexdigest()


def codes(df: DataFrame, scratch: Scratch, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, scale: int = 4096, rounds: int = 6) -> DataFrame:
    """For every usable vector: ``id``, ``code``, ``error``, ``label_error``, ``codebooks_sha256``.

    Null vectors and vectors with null or non-finite components are left out. Codebooks start as the
    parts of the vectors with the smallest ids; rows that share an id stand in the order of their
    components, rows without an id after all others, and with fewer vectors there are fewer
    entries. All coded vectors have the size of the first of them that ``parts`` divides; vectors of
    other sizes get a null code and error. ``label_error`` is the sum of the errors of equal labels,
    nulls together, null where none has an error. Sums that no long holds are null. Repeated rows
    count as often as they occur. An empty table gives no rows; columns other than the three aren't
    read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits, so a codebook has 1 to 256 entries")
    own = df.where(usable(vector)).select(F.col(id).alias("id"), F.col(label).alias("beside"), F.col(vector).cast("array<double>").alias("x"))
    order = (F.asc_nulls_last("id"), "x")
    sized = own.where((F.size("x") > 0) & (F.size("x") % parts == 0)).orderBy(*order).limit(1).collect()
    size = len(sized[0].x) if sized else 0
    kind, label_kind = dict(own.dtypes)["id"], dict(own.dtypes)["beside"]
    schema = f"id {kind}, label {label_kind}, code string, error bigint"
    coded = df.sparkSession.createDataFrame([], schema)
    books: list[np.ndarray] = []
    if size:
        some = own.where(F.size("x") == size)
        first = some.orderBy(*order).limit(entries).collect()
        blocks, context = keep_blocks(some, scratch), df.sparkSession.sparkContext
        books = cut(whole(integers(np.array([r.x for r in first], "<f8").tobytes(), size, scale)), parts)
        for _ in range(rounds):
            sent = context.broadcast([Tree(book) for book in books])

            def moved(data: bytes, sent=sent) -> tuple:
                found = [sums(x, tree.nearest(x)[0], len(tree.entries)) for x, tree in zip(cut(integers(data, size, scale), parts), sent.value, strict=True)]
                return tuple(array for pair in found for array in pair)

            total = over_blocks(blocks, moved)
            books = [floors(book, total[2 * part], total[2 * part + 1]) for part, book in enumerate(books)]
            sent.unpersist()
        last = context.broadcast([Tree(book) for book in books])

        def run(batches):
            for batch in batches:
                for at in range(len(batch)):
                    found = [tree.nearest(x) for x, tree in zip(cut(integers(batch.column("x")[at].as_py(), size, scale), parts), last.value, strict=True)]
                    errors = sum(np.array([int(d) for d in distance], object) for _, distance in found)
                    text = [row.tobytes().hex() for row in np.stack([number for number, _ in found], 1).astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays([batch.column("ids")[at].values, batch.column("beside")[at].values, pa.array(text, pa.string()), longs(errors)], ["id", "label", "code", "error"])

        coded = blocks.mapInArrow(run, schema)
    other = own.where(F.size("x") != size).select("id", F.col("beside").alias("label"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    kept = scratch.keep(coded.union(other), "codes")
    # a kept table on either side of the join, so adaptive execution can split a hot label
    totals = scratch.keep(kept.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")), "label-errors")
    totals = totals.select(F.col("label").alias("of"), F.col("total").try_cast("bigint").alias("label_error"))
    joined = kept.join(totals, kept["label"].eqNullSafe(totals["of"]))
    return joined.select(F.col("id").alias(id), "code", "error", "label_error", F.lit(sha_of(books)).alias("codebooks_sha256"))
