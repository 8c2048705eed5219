"""Vectors in blocks, as whole numbers, with sums that stay exact at any magnitude.

A block is one row: the ids of some vectors, what else is carried with them, and their components
as one matrix of doubles. Components become integers by ``floor(scale * x)``; the floor of a double
is a double, so a matrix of doubles holds them exactly. What is computed from them takes the
narrowest of three kinds that its largest possible value fits: doubles below 2^53, where sums and
products of integers are exact in any order (BLAS included), 64-bit integers below 2^63, and else
Python's integers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.scratch import Scratch

#: Vectors of a block at most; 1 MB at 64 components.
ROWS = 2_048
LONG = 1 << 63

#: Elementwise Python integers.
whole = np.frompyfunc(int, 1, 1)


def usable(vector: str | Column) -> Column:
    """Whether a vector is there and all its components are finite numbers; never null."""
    own = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def keep_blocks(df: DataFrame, scratch: Scratch, name: str = "blocks") -> DataFrame:
    """The columns ``id``, ``beside`` and ``x`` (array<double>, all of one size, without nulls) of ``df`` as a kept table of blocks."""

    def run(batches):
        for whole in batches:
            for begin in range(0, len(whole), ROWS):
                batch = whole.slice(begin, ROWS)
                ids, beside, x = batch.columns
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                flat = x.flatten().to_numpy(zero_copy_only=False).astype("<f8")
                yield pa.RecordBatch.from_arrays([one(ids), one(beside), pa.array([flat.tobytes()], pa.binary())], ["ids", "beside", "x"])

    types = dict(df.dtypes)
    schema = f"ids array<{types['id']}>, beside array<{types['beside']}>, x binary"
    return scratch.keep(df.select("id", "beside", "x").mapInArrow(run, schema), name)


def integers(data: bytes, size: int, scale: int) -> np.ndarray:
    """A block's matrix of integers: doubles, or Python's integers where ``scale * x`` is no double."""
    x = np.frombuffer(data, "<f8").reshape(-1, size)
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if np.isfinite(scaled).all():
        return scaled
    return np.where(np.isfinite(scaled), whole(np.nan_to_num(scaled)), whole(x) * scale)  # a double of that magnitude is whole


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def exact(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` in the narrowest kind for results below ``bound``."""
    if bound < 1 << 53:
        return x.astype(np.float64)
    return x.astype(np.int64) if bound < LONG else whole(x)


def sums(x: np.ndarray, numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number below ``n`` the sum of its rows of ``x`` and their count, as Python's integers."""
    own = exact(x, (len(x) + 1) * largest(x))
    chosen = (np.arange(n)[:, None] == numbers).astype(own.dtype)
    return whole(chosen @ own), whole(np.bincount(numbers, minlength=n))


def floors(entries: np.ndarray, total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``total // count`` for entries that have rows, the entry itself for others."""
    return np.array([[int(s) // int(n) for s in row] if n else list(old) for old, row, n in zip(entries, total, count, strict=True)], object).reshape(entries.shape)


def over_blocks(blocks: DataFrame, of_block: Callable[[bytes], tuple]) -> tuple:
    """Elementwise sums of ``of_block(x)``, a tuple of arrays of Python's integers, over all blocks; partial sums in each task, then in a tree."""

    def both(a, b):
        return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b, strict=True))

    return blocks.select("x").rdd.treeAggregate(None, lambda total, row: both(total, of_block(row[0])), both)


def longs(values) -> pa.Array:
    """Integers as longs; those that no long holds are null."""
    return pa.array([int(v) if -LONG <= v < LONG else None for v in values], pa.int64())
