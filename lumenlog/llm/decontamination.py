"""Words of documents that stand in windows of benchmark items, by a prefix-filtered join.

An item's windows are its runs of ``window`` consecutive words (all of its words if it has fewer).
A window is a sequence of shingles of up to ``WIDTH`` words, and a text that holds the window holds
all of them; so of its shingles, ordered by rarity in the documents, the rarest alone is a necessary
prefix, and only where a text has that shingle is the window looked for. The shingle's place gives
the one place where the window can begin; it must begin and end within the text (length and
positional bounds), its words' hashes must agree, and then its words are compared themselves.

Documents are read twice, for the shingles' counts and for the windows, and texts are never
shuffled: what is sent to the tasks is the benchmark. It is counted first. ``MOST_WINDOWS`` windows and
``MOST_BYTES`` of their text are broadcast at most; a larger benchmark is taken in slices of that size, each
against all documents, and the windows found are gathered by the texts' digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.scratch import Scratch

from .shingle_sets import AT_ONCE, BASE, LOWER, mix, word_hashes
from .worker_memory import tidy

#: Words of a shingle; a window of fewer words is one shingle.
WIDTH = 3
#: Windows, and bytes of their text, that a slice of the benchmark holds, about; a slice is broadcast.
MOST_WINDOWS, MOST_BYTES = 100_000, 32_000_000
#: Bytes that no word has, after A-Z became a-z.
APART = np.array([b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
_NO_WORDS = bytes(32 if apart else b for b, apart in enumerate(APART))
#: Cells of the table that tells most shingles of documents apart from those looked for.
CELLS = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).translate(_NO_WORDS).split()


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; runs of other widths have other hashes."""
    out = np.full(max(0, len(hashes) - width + 1), width, np.uint64)
    for k in range(width):
        out = out * np.uint64(BASE) + hashes[k : k + len(out)]
    return mix(out)


SHINGLES = "item string, window binary, words int, offset int, shingle bigint"


def item_windows(benchmark: DataFrame, text: str, id: str, window: int) -> DataFrame:
    """A row for every shingle of every item's windows; ``window`` is its words, a blank between two."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words_of(text)
                size = min(window, len(own))
                if not size:
                    continue
                shingles = rolled(word_hashes(b" ".join(own))[0], min(WIDTH, size)).view(np.int64)
                for begin in range(0, len(own) - size + 1, 1_000):  # so many windows of a long item at a time
                    places = range(begin, min(begin + 1_000, len(own) - size + 1))
                    each = size - min(WIDTH, size) + 1
                    windows = [w for p in places for w in [b" ".join(own[p : p + size])] * each]
                    columns = [[item] * len(windows), windows, [size] * len(windows), list(range(each)) * len(places)]
                    types = (pa.string(), pa.binary(), pa.int32(), pa.int32())
                    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate([shingles[p : p + each] for p in places]))], ["item", "window", "words", "offset", "shingle"])

    return benchmark.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(run, SHINGLES)


class Sought:
    """Shingle hashes to look for, sorted, and the widths of those shingles."""

    def __init__(self, shingles: np.ndarray, widths: set[int]):
        self.shingles, self.widths = np.unique(shingles.view(np.uint64)), sorted(widths)
        self.cells = np.zeros(CELLS, bool)
        self.cells[self.shingles % np.uint64(CELLS)] = True

    def find(self, hashes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words where a shingle begins that is looked for, within one text, and its number."""
        places, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width in self.widths:
            own = rolled(hashes, width)
            at = np.flatnonzero(self.cells[own & np.uint64(CELLS - 1)])
            near = np.searchsorted(self.shingles, own[at])
            found = self.shingles[np.minimum(near, len(self.shingles) - 1)] == own[at]
            found &= at + width <= texts[np.minimum(np.searchsorted(texts, at, "right"), len(texts) - 1)]
            places.append(at[found])
            numbers.append(near[found])
        return np.concatenate(places), np.concatenate(numbers)


class Windows(Sought):
    """A slice's windows by their rarest shingles: words' hashes, words, and what is told of a window that is found."""

    def __init__(self, rows: list[tuple[bytes, int, int, object]]):
        self.words = [r[0].split(b" ") for r in rows]
        super().__init__(np.array([r[2] for r in rows], np.int64), {min(WIDTH, len(w)) for w in self.words})
        numbers = np.searchsorted(self.shingles, np.array([r[2] for r in rows], np.int64).view(np.uint64))
        self.order = np.argsort(numbers, kind="stable")
        self.bounds = np.searchsorted(numbers[self.order], np.arange(len(self.shingles) + 1))
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.offsets = np.array([r[1] for r in rows], np.int64)
        self.hashes = np.zeros((len(rows), max(self.sizes)), np.uint64)
        for size in np.unique(self.sizes):
            of = np.flatnonzero(self.sizes == size)
            self.hashes[of, :size] = word_hashes(b" ".join(rows[k][0] for k in of))[0].reshape(len(of), size)
        self.told = [r[3] for r in rows]

    def occurrences(self, data: bytes, hashes: np.ndarray, start: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each window found in ``data`` and its first word's place; ``texts``: the place of each text's first word, and the end."""
        places, numbers = self.find(hashes, texts)
        many = self.bounds[numbers + 1] - self.bounds[numbers]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        window = self.order[np.repeat(self.bounds[numbers], many) + within]
        place = np.repeat(places, many)
        begin, size = place - self.offsets[window], self.sizes[window]
        end_of_text = texts[np.searchsorted(texts, place, "right")]
        begin_of_text = texts[np.searchsorted(texts, place, "right") - 1]
        fits = (begin >= begin_of_text) & (begin + size <= end_of_text)
        window, begin, size = window[fits], begin[fits], size[fits]
        same = np.ones(len(window), bool)
        for k in range(self.hashes.shape[1]):
            some = np.flatnonzero(same & (k < size))
            same[some] = hashes[begin[some] + k] == self.hashes[window[some], k]
        window, begin = window[same], begin[same]
        alike = np.zeros(len(window), bool)
        for at, (w, b) in enumerate(zip(window.tolist(), begin.tolist(), strict=True)):
            own = self.words[w]
            last = int(start[b + len(own) - 1]) + len(own[-1])
            alike[at] = data[int(start[b]) : last].translate(_NO_WORDS).split() == own and (last == len(data) or bool(APART[data[last]]))
        return window[alike], begin[alike]


def read_texts(texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Some texts at a time, lower-cased: their bytes, words' hashes and first bytes, and the place of each text's first word, and the end."""
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and (not some or size < AT_ONCE):
            some.append((texts[at] or "").encode("utf-8", "surrogatepass").translate(LOWER))
            size += len(some[-1]) + 1
            at += 1
        data = b"\n".join(some)
        hashes, start = word_hashes(data, APART)
        yield data, hashes, start, np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in some]))


def shingle_counts(texts: DataFrame, sent: Broadcast) -> DataFrame:
    """``shingle`` and ``n`` of the broadcast shingles that a task has met."""

    def run(batches):
        sought = sent.value
        n = np.zeros(len(sought.shingles), np.int64)
        for batch in batches:
            for _, hashes, _, bounds in read_texts(batch.column(0).to_pylist()):
                n += np.bincount(sought.find(hashes, bounds)[1], minlength=len(n))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(sought.shingles[met].view(np.int64)), pa.array(n[met])], ["shingle", "n"])

    return texts.mapInArrow(tidy(run), "shingle bigint, n bigint")


def per_text(texts: list[str | None], windows: Windows | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text its number of words, the windows found and the places where they begin."""
    for data, hashes, start, bounds in read_texts(texts):
        window, begin = windows.occurrences(data, hashes, start, bounds) if windows else (np.zeros(0, np.int64),) * 2
        order = np.argsort(begin, kind="stable")
        window, begin = window[order], begin[order]
        edges = np.searchsorted(begin, bounds)
        for k in range(len(bounds) - 1):
            yield int(bounds[k + 1] - bounds[k]), window[edges[k] : edges[k + 1]], begin[edges[k] : edges[k + 1]] - bounds[k]


def covered(begin: np.ndarray, size: np.ndarray) -> int:
    """Words in the union of runs; ``begin`` ascends."""
    if not len(begin):
        return 0
    reach = np.maximum.accumulate(begin + size)
    return int(np.maximum(0, begin + size - np.maximum(begin, np.concatenate([[0], reach[:-1]]))).sum())


def sha_of(items) -> str:
    """Digest of the distinct item ids, sorted as strings."""
    return hashlib.sha256(",".join(sorted(set(items))).encode("utf-8", "surrogatepass")).hexdigest()


def hits(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = 10) -> DataFrame:
    """For every row of ``docs``: ``id``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (array of ids as strings, sorted), ``items_sha256``, ``contaminated``.

    A null text has no words, neither as a document nor as an item; an item without words has no
    window. Of items that share an id any one's windows count for it; windows of an item without an
    id hit words, but it isn't listed. Equal windows of several items count for each of them.
    Repeated rows of ``docs`` each get their result. An empty table of documents gives no rows, an
    empty benchmark no hits. Other columns aren't read.
    """
    shingles = scratch.keep(item_windows(benchmark, item_text, item_id, window), "shingles")
    pairs = scratch.keep(shingles.select("item", "window").distinct(), "pairs")
    total = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("window") + F.length(F.coalesce("item", F.lit("")))), F.lit(0)).alias("bytes")).first()
    slices = max(1, -(-total.n // MOST_WINDOWS), -(-total.bytes // MOST_BYTES))
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    part = lambda column: F.pmod(F.xxhash64(column), F.lit(slices)).cast("int")
    prefixes = scratch.keep(rarest(shingles, own, scratch, slices), "prefixes")
    if slices == 1:
        return _direct(own, id, pairs, prefixes)
    found = []
    for k in range(slices):
        rows = prefixes.where(part("window") == k).collect()  # MOST_WINDOWS rows or so, as counted above
        if rows:
            found.append(_found(own, Windows([(bytes(r.window), r.offset, r.shingle, hashlib.sha256(bytes(r.window)).digest()[:16]) for r in rows])))
    found = [scratch.keep(f.dropDuplicates(["digest"]), f"found-{k}") for k, f in enumerate(found)]
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    every = scratch.keep(every, "found")
    spans = every.groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    start = F.struct(F.lit(0).cast("int").alias("n"), F.lit(0).cast("int").alias("reach"))

    def further(s, x):
        end = x["begin"] + x["size"]
        return F.struct((s["n"] + F.greatest(end - F.greatest(x["begin"], s["reach"]), F.lit(0))).alias("n"), F.greatest(end, s["reach"]).alias("reach"))

    n_hit = spans.select("digest", F.aggregate("spans", start, further)["n"].cast("bigint").alias("n_hit"))
    named = pairs.where("item IS NOT NULL").select("item", F.substring(F.unhex(F.sha2("window", 256)), 1, 16).alias("key"))
    met = every.select("digest", F.explode("windows").alias("key")).distinct().join(named, "key")
    items = met.groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    result = scratch.keep(n_hit.join(items, "digest", "left"), "results")
    keyed = own.select("id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text")
    counted = _counted(keyed)
    joined = counted.join(result, "digest", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(F.col("id").alias(id), "n_words", n.alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"), listed.alias("items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def rarest(shingles: DataFrame, own: DataFrame, scratch: Scratch, slices: int) -> DataFrame:
    """Of every window the shingle that is rarest in the documents (then the least hash, then the first): ``window``, ``offset``, ``shingle``."""
    distinct = scratch.keep(shingles.select("shingle", F.least("words", F.lit(WIDTH)).alias("width")).distinct(), "distinct")
    texts, context, counts = own.select("text"), own.sparkSession.sparkContext, None
    for k in range(slices):
        rows = distinct.where(F.pmod(F.xxhash64("shingle"), F.lit(slices)) == k).toArrow()  # ``window`` times a slice's windows at most
        if len(rows):
            sent = context.broadcast(Sought(rows.column("shingle").to_numpy(), set(rows.column("width").to_pylist())))
            some = scratch.keep(shingle_counts(texts, sent).groupBy("shingle").agg(F.sum("n").alias("n")), "counts")
            counts = some if counts is None else counts.union(some)
    if counts is None:
        return shingles.select("window", "offset", "shingle")
    each = shingles.select("window", "offset", "shingle").distinct().join(counts, "shingle", "left")
    first = F.min(F.struct(F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "shingle", "offset")).alias("x")
    return each.groupBy("window").agg(first).select("window", "x.offset", "x.shingle")


def _direct(own: DataFrame, id: str, pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """All windows in one broadcast: each task writes its documents' results."""
    items: dict[bytes, list[str]] = {}
    for r in pairs.collect():  # counted: MOST_WINDOWS rows at most
        items.setdefault(bytes(r.window), []).extend([] if r.item is None else [r.item])
    rows = [(bytes(r.window), r.offset, r.shingle, tuple(items[bytes(r.window)])) for r in prefixes.collect()]
    sent = own.sparkSession.sparkContext.broadcast(Windows(rows) if rows else None)
    schema = f"`{id}` {dict(own.dtypes)['id']}, n_words bigint, n_hit bigint, n_items bigint, items array<string>, items_sha256 string, contaminated boolean"

    def run(batches):
        windows = sent.value
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                n, hit, listed = [], [], []
                for words, window, begin in per_text(batch.column(1).to_pylist(), windows):
                    n.append(words)
                    hit.append(covered(begin, windows.sizes[window]) if windows else 0)
                    listed.append(sorted({item for w in set(window.tolist()) for item in windows.told[w]}))
                arrays = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in listed], pa.int64()), pa.array(listed, pa.list_(pa.string())), pa.array([sha_of(x) for x in listed]), pa.array([h > 0 for h in hit], pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id, "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"])

    return own.mapInArrow(tidy(run), schema)


def _found(own: DataFrame, windows: Windows) -> DataFrame:
    """Texts that hold windows of a slice, by digest: spans of words, and the windows' keys."""
    sent = own.sparkSession.sparkContext.broadcast(windows)
    span = pa.struct([("begin", pa.int32()), ("size", pa.int32())])

    def run(batches):
        windows = sent.value
        for whole in batches:
            for at in range(0, len(whole), 256):
                texts = whole.column(0).slice(at, 256).to_pylist()
                digests, spans, keys = [], [], []
                for text, (_, window, begin) in zip(texts, per_text(texts, windows), strict=True):
                    if len(window):
                        digests.append(hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).digest())
                        spans.append([{"begin": b, "size": s} for b, s in sorted(set(zip(begin.tolist(), windows.sizes[window].tolist(), strict=True)))])
                        keys.append([windows.told[w] for w in sorted(set(window.tolist()))])
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(spans, pa.list_(span)), pa.array(keys, pa.list_(pa.binary()))], ["digest", "spans", "windows"])

    return own.select("text").mapInArrow(tidy(run), "digest binary, spans array<struct<begin: int, size: int>>, windows array<binary>")


def _counted(keyed: DataFrame) -> DataFrame:
    """Words of each text beside its digest."""

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                n = [words for words, _, _ in per_text(batch.column(2).to_pylist(), None)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "digest", "n_words"])

    return keyed.mapInArrow(tidy(run), f"id {dict(keyed.dtypes)['id']}, digest binary, n_words bigint")
