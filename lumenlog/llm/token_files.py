"""Token ids in Arrow files with batches of fixed-size lists, for random access without copies.

A shard is one file in Arrow's file format (the stream format with an index of its batches at the
end). Its batches have the columns ``ids``, fixed-size lists of the sequence length in the
smallest unsigned type that holds the vocabulary, and ``mask``, fixed-size lists of bits that are
false where the last sequence is padded. A sequence is found by dividing its number by the
sequences of a batch, and read from the mapped file in place. Beside it lies an index file with
each document's key, first token in the shard and number of tokens.

Shards hold ranges of keys in ascending order and documents in ascending order within, so the
files in the manifest's order are the whole corpus in order. Each attempt of a task writes one shard under
a name that no other attempt has and tells it in its row of the manifest, which Spark commits for one
attempt of each task only. So the files and the index that a reader takes are of one attempt, and nothing is
renamed, which object stores can't; what other attempts left is deleted when the manifest stands.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .word_ids import encoder
from .worker_memory import tidy

#: Sequences of a batch.
PER_BATCH = 256
MOST_DOCS_AT_ONCE = 512
MANIFEST = "shard bigint, file string, documents bigint, tokens bigint"


def id_type(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


class ShardWriter:
    """Writes one shard, batch by batch; at most one batch of ids is held."""

    def __init__(self, folder: str, shard: int, sequence: int, kind: np.dtype, key_type: pa.DataType):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.file = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        self.name, self.sequence, self.kind, self.key_type = f"{self.folder}/{self.file}", sequence, kind, key_type
        self.files.create_dir(self.folder, recursive=True)
        self.schema = pa.schema({"ids": pa.list_(pa.from_numpy_dtype(kind), sequence), "mask": pa.list_(pa.bool_(), sequence)})
        self.out = self.files.open_output_stream(self.name + ".arrow")
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.held: list[np.ndarray] = []
        self.held_size = self.tokens = 0
        self.index: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        self.index.append((key, self.tokens, len(ids)))
        self.tokens += len(ids)
        self.held.append(ids.astype(self.kind))
        self.held_size += len(ids)
        if self.held_size >= PER_BATCH * self.sequence:
            self._write(last=False)

    def _write(self, last: bool) -> None:
        ids, full = np.concatenate([*self.held, np.zeros(0, self.kind)]), PER_BATCH * self.sequence
        while len(ids) >= full or last and len(ids):
            some, ids = ids[:full], ids[full:]
            rows = -(-len(some) // self.sequence)
            padded = np.zeros(rows * self.sequence, self.kind)
            padded[: len(some)] = some
            mask = np.arange(len(padded)) < len(some)
            self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(padded), self.sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)], schema=self.schema))
        self.held, self.held_size = [ids], len(ids)

    def close(self) -> None:
        self._write(last=True)
        self.writer.close()
        self.out.close()
        keys, start, n = zip(*self.index, strict=True) if self.index else ((), (), ())
        index = pa.table({"key": pa.array(keys, self.key_type), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(n, pa.int64())})
        with self.files.open_output_stream(self.name + ".index") as out, pa.ipc.new_file(out, index.schema) as writer:
            writer.write_table(index)


class ShardReader:
    """Random access to one shard, by the manifest's name for it."""

    def __init__(self, folder: str, file: str):
        self.files, base = fs.FileSystem.from_uri(folder)
        self.name = f"{base}/{file}"
        self.reader = pa.ipc.open_file(self._open(".arrow"))
        self.sequence = self.reader.schema.field("ids").type.list_size
        self._at, self._batch = -1, None

    def _open(self, kind: str):
        if isinstance(self.files, fs.LocalFileSystem):
            return pa.memory_map(self.name + kind)
        return self.files.open_input_file(self.name + kind)

    def index(self) -> pa.Table:
        return pa.ipc.open_file(self._open(".index")).read_all()

    def _get(self, batch: int) -> pa.RecordBatch:
        if batch != self._at:
            self._at, self._batch = batch, self.reader.get_batch(batch)
        return self._batch

    def sequence_at(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence; the ids are a view of the file."""
        batch, row = self._get(number // PER_BATCH), number % PER_BATCH
        at, ids, mask = row * self.sequence, batch.column("ids").values, batch.column("mask").values
        return ids.to_numpy(zero_copy_only=True)[at : at + self.sequence], mask.slice(at, self.sequence).to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """The ids from ``start`` on, across sequences and batches."""
        full, found = PER_BATCH * self.sequence, []
        while n:
            ids = self._get(start // full).column("ids").values.to_numpy(zero_copy_only=True)
            found.append(ids[start % full : start % full + n])
            start += len(found[-1])
            n -= len(found[-1])
        return np.concatenate(found) if len(found) != 1 else found[0]


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, sequence: int = 2048, shards: int | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Encodes and writes ``docs`` and returns the manifest: ``shard``, ``file``, ``documents``, ``tokens``.

    A null text counts as empty: its end id alone. Null keys come first, repeated keys stand side by
    side. An empty table gives an empty manifest. ``shards``: ranges of keys, by default as many as
    the session has shuffle partitions. Runs at once.
    """
    spark: SparkSession = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        own, writer, number = encoder(vocabulary), None, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, len(whole), MOST_DOCS_AT_ONCE):
                batch = whole.slice(at, MOST_DOCS_AT_ONCE)
                writer = writer or ShardWriter(folder, number, sequence, id_type(max(own.size, end_id + 1)), batch.column(0).type)
                for key, ids in zip(batch.column(0).to_pylist(), own.run(batch.column(1).to_pylist()), strict=True):
                    writer.add(key, np.frombuffer(ids + end, "<u4"))
        if writer:
            writer.close()
            n, documents, tokens = (pa.array([x], pa.int64()) for x in (number, len(writer.index), writer.tokens))
            yield pa.RecordBatch.from_arrays([n, pa.array([writer.file]), documents, tokens], ["shard", "file", "documents", "tokens"])

    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(shards, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    ordered.mapInArrow(tidy(run), MANIFEST).write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    drop_orphans(folder, {r.file for r in manifest.select("file").collect()})  # a row a shard
    return manifest


def drop_orphans(folder: str, files: set[str]) -> None:
    """Deletes shards in ``folder`` that the manifest doesn't name: those of attempts that failed or came second."""
    there, base = fs.FileSystem.from_uri(folder)
    for found in there.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        name, kind = found.base_name.partition(".")[::2]
        if kind in ("arrow", "index") and name.startswith("shard-") and name not in files:
            there.delete_file(found.path)


def read_documents(spark: SparkSession, folder: str, key_type: str = "bigint") -> DataFrame:
    """From the files, one row a document: ``key``, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids_crc32``.

    The manifest has a row a shard; the running total over it is the only step in one task.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = manifest.select("shard", "file", before.alias("base"))

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(folder, row["file"])
                index = shard.index()
                start, n = index.column("start").to_pylist(), index.column("n_tokens").to_pylist()
                crc = [zlib.crc32(shard.tokens(a, k).astype("<u4").tobytes()) for a, k in zip(start, n, strict=True)]
                columns = [index.column("key").combine_chunks(), *(pa.array(x, pa.int64()) for x in ([row["base"] + a for a in start], n, crc))]
                yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], ["key", "start", "n_tokens", "ids_crc32"])

    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return based.repartition(files, "shard").mapInArrow(tidy(read), f"key {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
