"""Centroid clustering of vectors of whole numbers, with exact results whatever the partitions.

Distances of a block of vectors to all centroids are one matrix product, |x|^2 - 2 x.c + |c|^2, in
doubles through BLAS. Every value on the way is an integer below ``4 * size * most^2``, ``most``
being the largest component of the block and the centroids; where that is below 2^53 the product is
exact, whatever order BLAS sums in. Blocks beyond it subtract and square in 64-bit integers, or in
Python's where those don't suffice either. Sums and counts of a round go up a tree of partial sums;
the driver gets ``k`` sums, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.scratch import Scratch

from .vectors import LONG, exact, floors, integers, keep_blocks, largest, longs, over_blocks, sums, usable, whole


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the number of the nearest centroid, the smaller of equally near ones, and the squared distance."""
    bound = 4 * x.shape[1] * max(largest(x), largest(centroids)) ** 2
    own, c = exact(x, bound), exact(centroids, bound)
    if own.dtype == np.float64:
        distances = (own * own).sum(1)[:, None] - 2 * (own @ c.T) + (c * c).sum(1)
    else:
        distances = np.stack([((own - one) ** 2).sum(1) for one in c], 1)
    number = distances.argmin(1)
    return number, distances[np.arange(len(own)), number]


def sha_of(centroid) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def clusters(df: DataFrame, scratch: Scratch, id: str = "vec_id", vector: str = "embedding", size: int = 64, k: int = 8, scale: int = 1024, rounds: int = 10, seed: int = 3) -> DataFrame:
    """For every usable vector: ``id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    Vectors that are null, of another size than ``size``, or with null or non-finite components are
    left out. The first centroids are the vectors with the smallest ``sha256(seed:id)``; rows that
    share an id stand in the order of their components, rows without an id after all others, and
    with fewer than ``k`` vectors there are fewer centroids. Repeated rows count as often as they
    occur. Distances and inertias that no long holds are null. An empty table gives no rows; other
    columns aren't read.
    """
    own = df.where(usable(vector) & (F.size(vector) == size)).select(F.col(id).alias("id"), F.lit(0).alias("beside"), F.col(vector).cast("array<double>").alias("x"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = own.select("id", "x", digest.alias("digest")).orderBy(F.asc_nulls_last("digest"), "x").limit(k).collect()
    kind = dict(own.dtypes)["id"]
    schema = f"`{id}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return df.sparkSession.createDataFrame([], schema)
    blocks, context = keep_blocks(own, scratch), df.sparkSession.sparkContext
    centroids = whole(integers(np.array([r.x for r in first], "<f8").tobytes(), size, scale))
    for _ in range(rounds):
        sent = context.broadcast(centroids)

        def moved(data: bytes, sent=sent) -> tuple:
            x = integers(data, size, scale)
            return sums(x, nearest(x, sent.value)[0], len(sent.value))

        centroids = floors(centroids, *over_blocks(blocks, moved))
        sent.unpersist()
    sent = context.broadcast(centroids)

    def spread(data: bytes) -> tuple:
        number, distance = nearest(integers(data, size, scale), sent.value)
        total = np.zeros(len(sent.value), object)
        np.add.at(total, number, [int(d) for d in distance])
        return (total,)

    (inertias,) = over_blocks(blocks, spread)
    total = int(sum(inertias))
    shas = [sha_of(c) for c in centroids]

    def run(batches):
        for batch in batches:
            for at in range(len(batch)):
                number, distance = nearest(integers(batch.column("x")[at].as_py(), size, scale), sent.value)
                every = pa.array([total if total < LONG else None] * len(number), pa.int64())
                columns = [batch.column("ids")[at].values, pa.array(number, pa.int32()), longs(distance), longs([inertias[c] for c in number]), every, pa.array([shas[c] for c in number])]
                yield pa.RecordBatch.from_arrays(columns, [id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(run, schema)
