"""Files that are one JSON document each, of any size: the elements of an array, or objects one after another.

Spark's text reader cuts a file at commas, in splits of the file side by side. A task has the pieces of a
split in their order, so their bytes are scanned in Arrow batches, and no piece is sorted or shuffled. One
scan tells of each split what the next ones must know: whether it ends within a string and how deep, for
both ways in which it may begin; these become running values over one row a split. The second scan knows
how its split begins, and cuts elements at commas of the outer level, or where an object ends. Only
elements that a split or a chunk of ``CHUNK`` bytes cuts are put together by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.scratch import Scratch

#: Bytes that are scanned at once.
CHUNK = 4 << 20
QUOTE, SLASH, COMMA, OPENS, ENDS, CLOSES = range(1, 7)
KINDS = np.zeros(256, np.uint8)
for _bytes, _kind in ((b'"', QUOTE), (b"\\", SLASH), (b",", COMMA), (b"[{", OPENS), (b"]", ENDS), (b"}", CLOSES)):
    KINDS[list(_bytes)] = _kind
BRACKET = re.compile(rb"(?:[ \t\n\x0b\f\r]|\xef\xbb\xbf)*\[")
SPLITS = "file string, block bigint, bytes bigint, told bigint, quotes bigint, rise0 bigint, rise1 bigint, low0 bigint, low1 bigint, array boolean"
PARTS = "file string, block bigint, chunk bigint, part bigint, whole boolean, ended bigint, late boolean, text binary, error string"
FAR = 1 << 60


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Texts between commas, the rows of a split in their order."""
    read = spark.read.option("lineSep", ",").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"), F.col("value").cast("binary").alias("value"))


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, bytes, bool]]:
    """The first row of a split (without its text), the bytes of some of its pieces with a comma after each, and whether they are the split's last."""
    head, held, size = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file"), batch.column("block")
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
        cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = {name: batch.column(name)[a].as_py() for name in batch.schema.names if name != "value"}
            if head is not None and (own["file"], own["block"]) != (head["file"], head["block"]):
                yield head, b"".join(held), True
                held, size = [], 0
            elif size >= CHUNK:
                yield head, b"".join(held), False
                held, size = [], 0
            head = own
            values = batch.column("value").slice(a, b - a)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), values), b",")[0].as_buffer()
            held += [joined, b","]
            size += joined.size + 1
    if head is not None:
        yield head, b"".join(held), True


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of commas, brackets and quotes, their kinds, and the quotes before each. What a backslash precedes is left out, but for commas."""
    kinds = KINDS[np.frombuffer(data, np.uint8)]
    at = np.flatnonzero(kinds)
    kinds = kinds[at]
    slash = kinds == SLASH
    if slash.any():
        n = np.arange(len(at))
        next_to = np.zeros(len(at), bool)
        next_to[1:] = slash[:-1] & (at[1:] == at[:-1] + 1)
        first = np.maximum.accumulate(np.where(slash & ~next_to, n, 0))  # of the run of backslashes
        escaped = np.zeros(len(at), bool)
        escaped[1:] = next_to[1:] & ((n - first)[:-1] % 2 == 0)
        kept = ~slash & (~escaped | (kinds == COMMA))
        at, kinds = at[kept], kinds[kept]
    quote = kinds == QUOTE
    return at, kinds, np.cumsum(quote) - quote


def _depths(kinds: np.ndarray, inside: np.ndarray, depth: int) -> np.ndarray:
    """How deep it is after each mark."""
    step = np.where(kinds == OPENS, 1, np.where(kinds >= ENDS, -1, 0))
    return depth + np.cumsum(np.where(inside, 0, step))


def _told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of ``SPLITS`` for each split: its bytes with commas, its quotes, and how deep it goes if it begins outside (0) or inside (1) of a string."""
    rows, now = [], None
    for head, data, last in _chunks(batches):
        if now is None:
            array = bool(BRACKET.match(data)) if head["block"] == 0 else None
            now = {"file": head["file"], "block": head["block"], "bytes": head["bytes"], "told": 0, "quotes": 0, "rise0": 0, "rise1": 0, "low0": FAR, "low1": FAR, "array": array}
        at, kinds, before = _marks(data)
        for k in (0, 1):
            inside = (before + now["quotes"] + k) % 2 == 1
            deep = _depths(kinds, inside, now[f"rise{k}"])
            if len(deep):
                now[f"rise{k}"] = int(deep[-1])
                now[f"low{k}"] = min(now[f"low{k}"], int(deep[(kinds == COMMA) & ~inside].min(initial=FAR)))
        now["told"] += len(data)
        now["quotes"] += int((kinds == QUOTE).sum())
        if last:
            rows.append(now)
            now = None
    schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in SPLITS.split(", "))])
    yield pa.RecordBatch.from_pylist(rows, schema)


def _cut(data: bytes, array: bool, inside: bool, depth: int) -> tuple[np.ndarray, int | None, bool, int]:
    """Where elements end, the place of the first comma before which the array is closed, whether the end is within a string, and how deep."""
    at, kinds, before = _marks(data)
    within = (before + inside) % 2 == 1
    deep = _depths(kinds, within, depth)
    out = ~within
    if array:
        closed = np.flatnonzero(out & (kinds == COMMA) & (deep <= 0))
        close = int(at[closed[0]]) if len(closed) else None
        ends = at[out & (kinds == COMMA) & (deep == 1)]
        ends = ends if close is None else ends[ends < close]
    else:
        close, ends = None, at[out & (kinds == CLOSES) & (deep <= 0)]
    return ends, close, bool((inside + int((kinds == QUOTE).sum())) % 2), int(deep[-1]) if len(deep) else depth


def _elements(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``PARTS``: ``part`` counts the elements that ended in the split before, ``whole`` ones lie in one chunk."""
    state = None
    for head, data, last in _chunks(batches):
        if state is None:
            array = head["array"] if head["array"] is not None else bool(BRACKET.match(data))
            state = {"inside": bool(head["inside"]), "depth": head["depth"] or 0, "closed": bool(head["closed"]), "told": 0, "chunk": 0, "part": 0}
        state["told"] += len(data)
        alone = head["cut"] is None  # the file's only split; Spark's reader may have left out a byte order mark
        cut = last and (state["told"] in (head["bytes"] + 1, head["bytes"] - 2) if alone else head["cut"])
        final = last and (alone or head["final"])
        end = len(data) - 1 if cut or (final and array) else len(data)  # the comma after the file's last piece is none, or ends an array's element at most
        first = head["block"] == 0 and state["chunk"] == 0
        begin = BRACKET.match(data).end() if first and array else 0
        texts, error = [], None
        if state["closed"]:
            late = data[:end]
        else:
            ends, close, state["inside"], state["depth"] = _cut(data, array, state["inside"], state["depth"])
            late = None
            stop = end
            if close is not None:
                piece = max(data.rfind(b",", begin, close) + 1, begin)
                stop = data.rfind(b"]", piece, close)
                stop, rest = (stop, stop + 1) if stop >= 0 else (piece, close)
                late, state["closed"] = data[rest:end], True
            ends = ends[ends < end]
            after = ends + (0 if array else 1)
            begins = np.concatenate([[begin], ends + 1])
            stops = np.concatenate([after, [max(stop, begins[-1])]])
            texts = [data[a:b] for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
            error = "the array isn't closed" if array and cut and final and close is None else None
        n = len(texts)
        if n:
            whole = np.ones(n, bool)
            whole[0] = first
            whole[-1] &= final or close is not None
            ended = np.ones(n, np.int64)
            ended[-1] = 0
            yield _rows(head, state, state["part"] + np.arange(n), whole, ended, False, texts, [None] * (n - 1) + [error])
            state["part"] += n - 1
        if late is not None:
            yield _rows(head, state, np.zeros(1, np.int64), np.zeros(1, bool), np.zeros(1, np.int64), True, [late], ["content after the array"])
        state["chunk"] += 1
        if last:
            state = None


def _rows(head: dict, state: dict, part, whole, ended, late: bool, texts: list[bytes], errors: list) -> pa.RecordBatch:
    n = len(texts)
    same = lambda value, kind: pa.repeat(pa.scalar(value, kind), n)
    columns = [same(head["file"], pa.string()), same(head["block"], pa.int64()), same(state["chunk"], pa.int64()), pa.array(part), pa.array(whole), pa.array(ended), same(late, pa.bool_()), pa.array(texts, pa.binary()), pa.array(errors, pa.string())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PARTS.split(", ")])


def _begins(splits: DataFrame) -> DataFrame:
    """How splits of files of several splits begin: ``array``, ``inside``, ``depth``, ``closed``; ``final`` and ``cut`` tell whether the split is the last, and without a comma at its end."""
    every = Window.partitionBy("file")
    before = every.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda value: F.coalesce(F.sum(value).over(before), F.lit(0).cast("bigint"))
    inside = splits.withColumns({"array": F.max("array").over(every), "final": F.col("block") == F.max("block").over(every), "all": F.sum("told").over(every), "inside": summed("quotes") % 2 == 1, "n": F.count("*").over(every)})
    own = lambda name: F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    deep = inside.withColumn("depth", summed(own("rise")))
    closed = F.coalesce(F.max(F.col("depth") + own("low") <= 0).over(before), F.lit(False)) & F.col("array")
    cut = F.col("final") & F.col("all").isin(F.col("bytes") + 1, F.col("bytes") - 2)
    return deep.withColumns({"closed": closed, "cut": cut}).where("n > 1").select("file", "block", "array", "inside", "depth", "closed", "final", "cut")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``element`` (from 1 in each file), ``text`` and ``error`` of all elements of JSON files.

    A file that begins with a bracket is an array, whose elements may be of any kind; others are objects one
    after another, on lines or not. What isn't JSON has an error, so have an array's last
    element if the array isn't closed, and content after it, which is a row without a number.
    Blank elements, and empty files, give no rows.
    """
    scratch = Scratch(spark, "documents")
    pieces = _pieces(spark, path)
    splits = scratch.keep(pieces.mapInArrow(_told, SPLITS), "splits")
    # Files of one split aren't in it: a row for each split of the others, so it is small and the pieces keep their order.
    placed = pieces.join(F.broadcast(_begins(splits)), ["file", "block"], "left")
    parts = scratch.keep(placed.mapInArrow(_elements, PARTS), "parts")
    counts = parts.groupBy("file", "block").agg(F.sum("ended").alias("ended"))
    earlier = F.sum("ended").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("file", "block", earlier.alias("earlier")).where("earlier > 0")
    element = F.when(~F.col("late"), F.col("part") + 1 + F.coalesce("earlier", F.lit(0)))
    own = parts.join(F.broadcast(offsets), ["file", "block"], "left").withColumns({"element": element, "text": F.col("text").cast("string")})
    listed = F.array_sort(F.collect_list(F.struct("block", "chunk", "text")))
    joined = own.where("NOT whole").groupBy("file", "element").agg(F.array_join(F.transform(listed, lambda p: p["text"]), "").alias("text"), F.min("error").alias("error"))
    every = own.where("whole").select(*joined.columns).union(joined).withColumn("text", F.regexp_replace("text", r"^[\s\x{FEFF}]+|\s+$", ""))
    odd = F.when(F.try_parse_json("text").isNull(), "no JSON")
    return every.where("text <> ''").withColumn("error", F.coalesce("error", odd)).select("file", "element", "text", "error")
