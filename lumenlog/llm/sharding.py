"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (offset and skip from
its name's hash). The shards take turns; at each turn a shard claims the first free slot in its
order. The table then holds nearly equal numbers of slots for each shard, and when a shard comes
or goes most slots keep their owner. Placing a row is one hash and one lookup.

The table has ``slots`` rows, a parameter that doesn't depend on the data, so broadcasting it is
bounded: 65,537 slots of two integers are about 1 MB. :func:`lookup_table` refuses tables above
``MOST_SLOTS``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = 65_537) -> list[int]:
    """For each slot the index of the shard that owns it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not _is_prime(slots) or slots > MOST_SLOTS or slots < len(shards):
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    place = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests]
    owner = [-1] * slots
    filled = 0
    while True:
        for shard in range(len(shards)):
            at = place[shard]
            while owner[at] >= 0:
                at = (at + skip[shard]) % slots
            owner[at] = shard
            place[shard] = (at + skip[shard]) % slots
            filled += 1
            if filled == slots:
                return owner


def place(df: DataFrame, key: str, shards: list[str], slots: int = 65_537) -> DataFrame:
    """``df`` with columns ``slot`` (long) and ``shard`` (string); one broadcast join, no shuffle.

    Equal keys land on the same shard, so repeated rows stay together; a null key counts as a key
    of its own. Columns of ``df`` named slot or shard are replaced. An empty table stays empty.
    """
    spark: SparkSession = df.sparkSession
    owner = lookup_table(shards, slots)
    rows = [(slot, shards[shard]) for slot, shard in enumerate(owner)]
    table = spark.createDataFrame(rows, "slot bigint, shard string")
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null"))
    keyed = df.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(text), F.lit(slots)))
    return keyed.join(F.broadcast(table), "slot")


def write_sharded(df: DataFrame, path: str, key: str, shards: list[str], slots: int = 65_537) -> None:
    """Writes one folder a shard. Rows of a shard are spread over tasks by key, so a large shard is many files."""
    place(df, key, shards, slots).drop("slot").write.partitionBy("shard").parquet(path)
