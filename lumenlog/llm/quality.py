"""Quality rules whose thresholds adapt to each language and source.

Every document is measured with DataFrame functions alone. A text is judged by the least rate that its
count supports, the count less so many square roots of it as the rule says, so one mark or two in a
text, or few words, tell nothing. The rates of the documents of each language and source go into mergeable quantile sketches: a sketch is the number of rows in each
of a fixed series of cells whose width grows with the value (eight leading bits are kept, so a
quantile is off by 1/128 of itself at most). Merging sketches is adding counts, so Spark builds
them with partial sums, whatever the partitions, a hot source is no more work than many small
ones, and the sketch of a language, or of all rows, comes from those of its sources.

A group's threshold is read from its own sketch merged with its language's, which counts as
``PRIOR`` documents, so a group of few documents leans on its language and a large one on itself;
what a language of fewer documents can't supply comes from all rows. Where the upper quartile isn't
zero, a text is too high above it plus ``STRETCH`` times its distance from the median. Where it is
zero, most of the group has nothing of what is counted: a text is then too high from the rate that
``RARE`` percent of those that have some stay below, and where fewer than ``LEAST`` percent have any
the rule is off, for there is nothing to read from the sketch. The base rule (too few words, too many repeated ones) holds besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.scratch import Scratch

from .common import split_words, whole_text

#: Documents that a language's sketch counts as in those of its groups.
PRIOR = 200
#: Merged counts are whole numbers of this part of a document.
PARTS = 1000
#: Bits of a value that a cell keeps.
BITS = 8
#: The upper quantile in percent, and how many times its distance from the median is added.
PERCENT, STRETCH = 75, 3
#: Of the texts that have any of what most have none of, the percent whose rates pass.
RARE = 10
#: Percent of a merged sketch that has to have some of it.
LEAST = 1
#: Rates in ten-thousandths: what is counted, of how many, and the square roots of the count that are taken off before a text is judged.
RULES = {"symbols": ("n_symbols", "word_chars", 2), "dup_lines": ("n_dup_lines", "n_lines", 1), "word_length": ("word_chars", "n_words", 2)}
#: Rules of which every text has some.
COMMON = ("word_length",)
#: A threshold that nothing exceeds.
OFF = 1 << 62
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Rows of thresholds that may be broadcast; each is under 200 bytes.
MOST_BROADCAST = 10_000


def repeat_words(words: Column, hashes: Column, width: int = 5) -> Column:
    """Words that lie in a window of ``width`` words found twice or more; 0 at once if the windows' hashes are distinct.

    Equal windows have equal hashes, so only texts with equal hashes compare the windows
    themselves: sorted with their places, neighbours that are equal are marked, and the marked
    places, in order, cover ``width`` words each or up to the next place.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.struct(F.array_join(F.slice(words, i + 1, width), " ").alias("w"), i.alias("p")))

    def marked(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["w"] == F.get(s, b)["w"], F.lit(False))
        kept = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.array_sort(F.transform(kept, lambda k: F.get(s, k)["p"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    counted = once(F.array_sort(windows), lambda s: once(marked(s), covered))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), counted).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``MEASURES`` and ``base_failed``; columns of these names, and those named _words, _hashes or _lines, are replaced.

    A null or empty text has no words and fails the base rule.
    """
    docs = docs.drop(*MEASURES, "base_failed", "_words", "_hashes")
    own = whole_text(text)
    lines = F.filter(F.split(own, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = F.col("_words")
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)])
    hashes = F.when(F.size(words) >= 5, F.transform(F.sequence(F.lit(0), F.size(words) - 5), window)).otherwise(F.array().cast("array<bigint>"))
    return (
        docs.withColumn("_words", split_words(own))
        .withColumn("_lines", lines)
        .withColumns({"_hashes": hashes, "n_words": F.size(words).cast("long"), "word_chars": F.length(F.array_join(words, "")).cast("long")})
        .withColumns(
            {
                "n_symbols": F.length(F.regexp_replace(own, r"[^#*$%&|<>]+", "")).cast("long"),
                "n_lines": F.size("_lines").cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": repeat_words(words, F.col("_hashes")),
            }
        )
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .drop("_words", "_hashes", "_lines")
    )


def rate(part: Column, whole: str) -> Column:
    return F.floor(10_000 * part / F.greatest(F.col(whole), F.lit(1))).cast("long")


def least_rates() -> dict[str, Column]:
    """What the verdicts compare, in whole ten-thousandths: the rates of counts less some square roots of them."""
    less = lambda part, roots: F.greatest(F.col(part) - F.ceil(roots * F.sqrt(part)), F.lit(0))
    return {name: rate(less(part, roots), whole) for name, (part, whole, roots) in RULES.items()}


def sketched_rates() -> dict[str, Column]:
    """What the sketches hold: plain rates of what every text has, least rates of what most have none of."""
    return {name: rate(F.col(RULES[name][0]), RULES[name][1]) if name in COMMON else least for name, least in least_rates().items()}


def cell(value: Column) -> Column:
    """The cell of a whole number: its leading ``BITS`` bits, the rest zero."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.expr("0") + F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def group_key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("null"))


def sketches(measured: DataFrame) -> DataFrame:
    """Sketches of every language and source, of the texts that pass the base rule: ``lang_key``, ``source_key``, ``rule``, ``cell``, ``n``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), cell(value).alias("cell")) for name, value in sketched_rates().items()])).alias("x")
    rows = measured.where("NOT base_failed").select(group_key("lang").alias("lang_key"), group_key("source").alias("source_key"), pairs)
    return rows.groupBy("lang_key", "source_key", "x.rule", "x.cell").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame) -> DataFrame:
    """The sketches of every group with their language's and, for small languages, the whole table's counts merged in."""
    groups = sketch.groupBy("lang_key", "source_key", "rule").agg(F.sum("n").alias("own"))
    lang = sketch.groupBy("lang_key", "rule", "cell").agg(F.sum("n").alias("n"))
    of_lang = groups.groupBy("lang_key", "rule").agg(F.sum("own").alias("total"))
    every = sketch.groupBy("rule", "cell").agg(F.sum("n").alias("n")).join(groups.groupBy("rule").agg(F.sum("own").alias("whole")), "rule")
    keys = ["lang_key", "source_key", "rule", "cell"]
    own = sketch.select(*keys, (F.col("n") * PARTS).alias("n"))
    placed = groups.select("lang_key", "source_key", "rule").join(of_lang, ["lang_key", "rule"])
    from_lang = placed.join(lang, ["lang_key", "rule"]).select(*keys, F.expr(f"{PARTS} * least({PRIOR}, total) * n div total").alias("n"))
    from_all = placed.where(F.col("total") < PRIOR).join(every, "rule").select(*keys, F.expr(f"{PARTS} * ({PRIOR} - total) * n div whole").alias("n"))
    return own.union(from_lang).union(from_all).groupBy(*keys).agg(F.sum("n").alias("n"))


def thresholds(measured: DataFrame) -> DataFrame:
    """One row a language and source: ``lang_key``, ``source_key`` and ``most_<rule>`` for each rule; no rows of an empty table."""
    cells = F.array_sort(F.collect_list(F.struct("cell", "n")))  # some thousands of cells at most
    grouped = merged(sketches(measured)).groupBy("lang_key", "source_key", "rule").agg(cells.alias("cells"), F.sum("n").alias("in_all"))

    def quantile(percent: int, cells: Column, in_all: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("at"))

        def step(s: Column, c: Column) -> Column:
            seen = s["seen"] + c["n"]
            return F.struct(seen.alias("seen"), F.when((s["at"] < 0) & (seen * 100 >= in_all * percent), c["cell"]).otherwise(s["at"]).alias("at"))

        return F.aggregate(cells, start, step)["at"]

    some = F.filter("cells", lambda c: c["cell"] > 0)
    in_some = F.aggregate(some, F.lit(0).cast("long"), lambda n, c: n + c["n"])
    every, in_all = F.col("cells"), F.col("in_all")
    found = grouped.select("lang_key", "source_key", "rule", quantile(50, every, in_all).alias("middle"), quantile(PERCENT, every, in_all).alias("upper"), F.when(in_some * 100 >= in_all * LEAST, quantile(RARE, some, in_some)).alias("rare"))
    fence = F.col("upper") + STRETCH * (F.col("upper") - F.col("middle"))
    most = F.when(F.col("upper") > 0, fence).when(F.col("rare") > 0, F.col("rare") - 1).otherwise(F.lit(OFF))
    return found.groupBy("lang_key", "source_key").agg(*[F.max(F.when(F.col("rule") == rule, most)).alias(f"most_{rule}") for rule in RULES])


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``kept``: no base failure and no least rate above its group's threshold; other columns stay as they are.

    ``limits`` has a row a group. It is broadcast only if it is counted to be ``MOST_BROADCAST``
    rows at most; else, where it is a table (:class:`Scratch`), both sides are plain shuffles, of
    which adaptive execution splits hot groups.
    """
    few = limits.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    own = F.struct(*[F.col(f"`{c}`") for c in measured.columns if c != "kept"]).alias("row")
    least = F.struct(*[value.alias(name) for name, value in least_rates().items()]).alias("least")
    keyed = measured.select(own, least, "base_failed", group_key("lang").alias("lang_key"), group_key("source").alias("source_key"))
    passed = ~F.col("base_failed")
    for rule in RULES:
        passed &= cell(F.col(f"least.{rule}")) <= F.col(f"most_{rule}")
    joined = keyed.join(F.broadcast(limits) if few else limits, ["lang_key", "source_key"], "left")
    return joined.select("row.*", F.coalesce(passed, F.lit(False)).alias("kept"))


def filter_documents(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with its columns, whatever their names.

    Rows with null texts, or none of the words that the base rule asks for, go; a null language or
    source is a group of its own. Rows are measured once and kept in ``scratch`` with what was
    measured, so texts are never shuffled. An empty table gives an empty table.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "lang", "source", F.col(text).alias("text"))
    measured = scratch.keep(measure(rows).drop("text"), "measured")
    limits = scratch.keep(thresholds(measured), "thresholds")
    return judge(measured, limits).where("kept").select("whole.*")
