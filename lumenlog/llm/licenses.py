"""License phrases and notices in texts, by diagonal voting.

Templates are phrases and notices as words. Every rolling k-gram of a text is hashed; grams whose
hash is a template gram's are joined with the template positions of that gram, and a hit votes for
the diagonal, the text position less the template position. Places where a template stands as it
is collect all its votes on one diagonal; where words are inserted or left out, votes fall on
neighbouring diagonals, which are merged before the share of the template's grams is taken.

All steps are DataFrame functions. The template table has a row a gram, some hundreds; it is
broadcast only below ``MOST_GRAMS`` rows, and beyond that the join is Spark's choice and the
test of hashes within the row is left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import split_words, whole_text

#: Characters between words, after lower-casing; upper-case letters are part of words before it.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Template grams that may be broadcast and held in the plan.
MOST_GRAMS = 5_000
#: Phrases that label a text wherever their words stand one after the other.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Openings of well-known notices; found with words changed, too.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "notice-mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "notice-apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "notice-gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "notice-bsd",
    "this work is licensed under a creative commons attribution": "notice-cc",
    "this source code form is subject to the terms of the mozilla public license": "notice-mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "notice-isc",
    "this is free and unencumbered software released into the public domain": "notice-public-domain",
}
PHRASE_GRAM, NOTICE_GRAM = 2, 4
#: Share of a notice's grams that makes it found, and how far apart merged diagonals may lie.
FOUND, GAP = 0.6, 3


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the short way where all characters are ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def templates(docs: DataFrame, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """A row a template gram: ``h2``, ``gram``, ``k``, ``template``, ``label``, ``at``, ``grams``."""
    rows = []
    for number, (text, label, k) in enumerate([(t, v, PHRASE_GRAM) for t, v in phrases.items()] + [(t, v, NOTICE_GRAM) for t, v in notices.items()]):
        words = re.sub(SEPARATORS, " ", text.lower()).split()
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {text}")
        grams = len(words) - k + 1
        rows += [(words[i], words[i + 1], " ".join(words[i : i + k]), k, number, label, i, grams) for i in range(grams)]
    made = docs.sparkSession.createDataFrame(rows, "a string, b string, gram string, k int, template int, label string, at int, grams int")
    return made.select(F.xxhash64("a", "b").alias("h2"), "gram", "k", "template", "label", "at", "grams")


def scan(docs: DataFrame, text: str = "text", id: str = "doc_id", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """For every row of ``docs``: ``id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    A null or empty text has no words and no labels (empty strings) and scores 0. Repeated rows
    give repeated results. ``score`` is the largest share of a template's grams found in one place.
    """
    table = templates(docs, phrases, notices)
    rows = table.limit(MOST_GRAMS + 1).collect()
    small = len(rows) <= MOST_GRAMS
    lowered = docs.select(F.col(id).alias("_id"), lower_ascii(whole_text(text)).alias("_text"))
    words = lowered.select(F.monotonically_increasing_id().alias("_row"), "_id", split_words(F.col("_text"), SEPARATORS).alias("_words"))
    w = F.col("_words")
    hashes = F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<bigint>"))
    hit = (lambda p: F.get(F.col("_hashes"), p).isin([r["h2"] for r in rows])) if small else (lambda p: F.lit(True))
    places = F.filter(F.sequence(F.lit(0), F.size("_hashes") - 1), hit)
    grams = F.transform(places, lambda p: F.struct(p.alias("pos"), F.get(F.col("_hashes"), p).alias("h2"), F.array_join(F.slice(w, p + 1, NOTICE_GRAM), " ").alias("next")))
    empty = F.array().cast("array<struct<pos:int,h2:bigint,next:string>>")
    hashed = words.withColumn("_hashes", hashes)
    found = hashed.select("_row", "_id", F.size(w).cast("long").alias("n_words"), F.explode_outer(F.when(F.size("_hashes") > 0, grams).otherwise(empty)).alias("g"))
    flat = found.select("_row", "_id", "n_words", "g.*")
    same = (flat["h2"] == table["h2"]) & (F.substring_index(flat["next"], " ", PHRASE_GRAM) == F.substring_index(table["gram"], " ", PHRASE_GRAM)) & ((table["k"] == PHRASE_GRAM) | (flat["next"] == table["gram"]))
    hits = flat.join(F.broadcast(table) if small else table, same, "left").select("_row", "_id", "n_words", "template", "k", "label", "grams", "pos", "at")
    diagonals = hits.groupBy("_row", "_id", "n_words", "template", "k", "label", "grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count("pos").alias("votes"), F.min("pos").alias("from"), F.max("pos").alias("to"))
    order = Window.partitionBy("_row", "template").orderBy("diagonal")
    near = (F.col("k") == NOTICE_GRAM) & (F.col("diagonal") - F.lag("diagonal").over(order) <= GAP)
    bands = (
        diagonals.withColumn("begins", F.when(near, 0).otherwise(1))
        .withColumn("band", F.sum("begins").over(order))
        .groupBy("_row", "_id", "n_words", "template", "k", "label", "grams", "band")
        .agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("diagonal"), (F.max("to") - F.min("from")).alias("span"))
    )
    share = F.when(F.col("span") <= 2 * F.col("grams"), F.least(F.col("votes") / F.col("grams"), F.lit(1.0)))
    base = (F.col("k") == PHRASE_GRAM) & (F.col("votes") == F.col("grams"))
    labelled = F.when(base | ((F.col("k") == NOTICE_GRAM) & (share >= FOUND)), F.col("label"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        bands.groupBy("_row")
        .agg(
            F.max("_id").alias(id),
            F.max("n_words").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("diagonal").cast("long"))).alias("first_word"),
            F.max(F.when(base, F.col("diagonal").cast("long"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined(labelled).alias("labels"),
            F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
        )
        .drop("_row")
    )
