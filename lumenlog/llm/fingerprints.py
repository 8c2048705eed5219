"""One-permutation MinHash fingerprints of texts, as packed low-order bits.

The shingles of a text are hashed once. The leading bits of a hash are its bin, so in the sorted
hashes the first of each bin is the bin's minimum. An empty bin takes the value of another one:
a hash of its number and of the attempt names a bin, the first that isn't empty is copied; after
``ATTEMPTS`` of them the order of all bins by a hash that includes the empty bin's number decides,
so this always ends. The low byte of every bin is kept, eight to a long.

Unequal values agree in a byte by chance once in 256 times; :func:`likeness` takes that out.
All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import split_words, whole_text

BINS, BIN_BITS, LOW_BITS = 256, 8, 8
SHINGLE = 5
ATTEMPTS = 12


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: array of 32 longs, null for a text without words.

    A text of fewer than ``SHINGLE`` words has one shingle, all its words. Each step is a
    projection of its own; what a step uses several times the optimizer leaves in place.
    """
    words, sorted_, least, dense, full = (F.col(f"_{name}_{x}") for x in ("words", "sorted", "least", "dense", "full"))
    drop = [f"_{name}_{x}" for x in ("words", "sorted", "least", "dense", "full")]
    shingle = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])  # noqa: E731  words past the end are null and change nothing
    hashes = F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))), shingle))
    bin_of = lambda h: F.shiftright(h, 64 - BIN_BITS).cast("int") + BINS // 2
    first = F.filter(sorted_, lambda h, i: (i == 0) | (bin_of(F.get(sorted_, i - 1)) != bin_of(h)))
    gap = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n)
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(bin_of(F.get(least, i - 1)))
    spread = F.concat(F.flatten(F.transform(least, lambda h, i: F.concat(gap(bin_of(h) - before(i) - 1), F.array(h)))), gap(BINS - 1 - bin_of(F.element_at(least, -1))))

    def densified(value: Column, i: Column) -> Column:
        tries = [F.get(dense, F.pmod(F.xxhash64(i, F.lit(a)), F.lit(BINS)).cast("int")) for a in range(ATTEMPTS)]
        last = F.array_min(F.transform(least, lambda h: F.struct(F.xxhash64(i, F.lit(-1), bin_of(h)).alias("order"), h.alias("value"))))["value"]
        return F.coalesce(value, *tries, last)

    byte = lambda at: F.get(full, at).bitwiseAND(F.lit(255).cast("bigint"))

    def packed(word: Column) -> Column:
        out = byte(word * 8)
        for k in range(1, 8):
            out = out.bitwiseOR(F.shiftleft(byte(word * 8 + k), 8 * k))
        return out

    return (
        df.withColumn(f"_{name}_words", split_words(whole_text(text)))
        .withColumn(f"_{name}_sorted", F.sort_array(hashes))
        .withColumn(f"_{name}_least", first)
        .withColumn(f"_{name}_dense", spread)
        .withColumn(f"_{name}_full", F.transform(dense, densified))
        .withColumn(name, F.when(full.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(BINS * LOW_BITS // 64 - 1)), packed)))
        .drop(*drop)
    )


def as_text(fingerprint: Column) -> Column:
    """Hexadecimal digits, 16 a long; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1: bytes that agree, less those that do by chance.

    Two texts without words are alike, one without is unlike all others.
    """
    ones = F.lit(0x0101010101010101).cast("bigint")

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for k in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(d.bitwiseAND(ones))

    differ = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda total, x: total + x)
    chance = 2.0**-LOW_BITS
    estimate = ((F.lit(1.0) - differ / BINS) - chance) / (1 - chance)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(estimate, F.lit(0.0))).cast("double")


def _place(range: Column, wraps, copy: bool) -> Column:
    wraps = F.lit(wraps) if isinstance(wraps, bool) else wraps
    return F.struct(range.alias("range"), wraps.alias("wraps"), F.lit(copy).alias("copy"))


def with_next(df: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """``df`` with ``next_<column>`` of the row that follows in ascending ``id``; after the last row the first.

    Rows are dealt into ranges of ``id``, as many as shuffle partitions, cut at approximate
    quantiles; the first row of a range also goes to the range before, so one shuffle and a window
    within each range find every neighbour. Null ids come first; equal ids follow each other in
    the order of ``columns``.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(id, [i / ranges for i in range(1, ranges)] or [1.0], 10_000)).first()[0] or []
    cuts = sorted(set(cuts)) if ranges > 1 else []
    held = F.lit(cuts) if cuts else F.array().cast("array<bigint>")
    range_of = F.when(F.col(id).isNull(), 0).otherwise(F.size(F.filter(held, lambda c: c < F.col(id))))
    ranged = df.withColumn("_range", range_of)
    firsts = sorted((r["_range"], r["first"]) for r in df.select(range_of.alias("_range"), F.col(id).alias("_id")).groupBy("_range").agg(F.min(F.struct(F.col("_id").isNotNull().alias("there"), F.col("_id").alias("id")))["id"].alias("first")).collect())
    if not firsts:
        return df.withColumns({f"next_{c}": F.col(c) for c in columns})
    own = [_place(F.col("_range"), False, False)]
    at = F.lit([n for n, _ in firsts])
    first_of = F.array(*[F.lit(f).cast("bigint") for _, f in firsts])
    to_of = F.lit([firsts[k - 1][0] for k in range(len(firsts))])
    k = (F.array_position(at, F.col("_range")) - 1).cast("int")
    is_first = F.get(first_of, k).eqNullSafe(F.col(id))
    copy = _place(F.get(to_of, k), k == 0, True)
    dealt = ranged.withColumn("_to", F.explode(F.when(is_first, F.array(*own, copy)).otherwise(F.array(*own)))).drop("_range")
    order = Window.partitionBy("_to.range").orderBy("_to.wraps", F.col(id).asc_nulls_first(), *columns)
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(~F.col("_to.copy")).drop("_to")


def edited_pairs(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Fingerprints of every text, of the text with its second half replaced from the next one, and their likeness.

    ``id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``. A null text counts as empty. Repeated rows are rows of their own; an empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id).alias("id"), whole_text(text).alias("text"))
    own = with_next(with_fingerprint(rows, "text", "print"), "id", ["text", "print"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = own.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    printed = with_fingerprint(edited.select("id", n.cast("long").alias("n_chars"), "edited", "print", "next_print"), "edited", "edited_print")
    return printed.select(
        F.col("id").alias(id),
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
