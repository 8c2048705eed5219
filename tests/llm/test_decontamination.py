"""Benchmark windows in documents against plain Python, in one broadcast and in slices."""

import hashlib
import random
import re

import pytest

from lumenlog.llm import decontamination
from lumenlog.scratch import Scratch

from .fixtures import prose, rows, table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def plain(docs, items, window=10):
    runs = {}
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            runs.setdefault(tuple(own[i : i + size]), set()).add(item)
    sizes = {len(r) for r in runs}
    out = []
    for doc, text in docs:
        own = words(text)
        hit, met = set(), set()
        for size in sizes:
            for i in range(len(own) - size + 1):
                if items_of := runs.get(tuple(own[i : i + size])):
                    hit.update(range(i, i + size))
                    met |= items_of
        listed = sorted(str(x) for x in met if x is not None)
        sha = hashlib.sha256(",".join(listed).encode()).hexdigest()
        out.append((doc, len(own), len(hit), len(listed), listed, sha, bool(hit)))
    return out


def hard_tables():
    passage = prose(1, 60)  # of the documents of rows()
    long = prose(40, 35)
    items = [(1, passage), (2, long), (10, " ".join(long.split()[:12])), (3, "MIT"), (4, "one"), (5, "Two WORDS"), (6, None), (7, ""), (8, " ,.; "), (9, "naïve é"), (2, "other text of an item with the same number as one before it"), (None, " ".join(long.split()[20:32])), (11, "a b c d e a b c d e a b"), (12, "xyz xyz xyz"), (13, long), (14, "Straße, ΟΔΟΣ")]
    own = random.Random(9)
    parts = long.split()
    texts = [r[1] for r in rows()]
    texts += [" ".join([prose(50 + i, 5), *parts[i : i + n], prose(70 + i, 5)]) for i, n in enumerate([9, 10, 11, 30, 35, 12])]
    texts += [",".join(parts[3:20]).upper(), long, long + long[:50], " ".join(parts[:9]) + "x " + parts[9], "xyz " * 50, "mit" * 3 + " MIT; mit", "one-one.one", " ".join(parts[5:13])]
    texts += [" ".join(own.choice(["a", "b", "c", "d", "e", "mit", "xyz"]) for _ in range(300)) for _ in range(5)]
    return [(i, t) for i, t in enumerate(texts)] + [(0, texts[3]), (None, long), (None, long)], items


def frames(spark, docs, items):
    extra = [("item", "'x'"), ("window", "1"), ("digest", "'d'"), ("spans", "2"), ("shingle", "3"), ("n", "4")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    for name, value in extra:
        docs, items = docs.selectExpr("*", f"{value} AS {name}"), items.selectExpr("*", f"{value} AS {name}")
    return docs.repartition(3), items


@pytest.mark.parametrize("most", [100_000, 9])
def test_hits(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MOST_WINDOWS", most)
    docs, items = hard_tables()
    found = decontamination.hits(*frames(spark, docs, items), Scratch(spark, "t"))
    want = plain(docs, items)
    assert sum(r[-1] for r in want) > 15
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("most", [100_000, 2])
def test_bytes_and_windows_of_other_widths(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MOST_BYTES", most * 100)
    docs, items = hard_tables()
    found = decontamination.hits(*frames(spark, docs, items), Scratch(spark, "t"), window=2)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain(docs, items, 2), key=str)


def test_empty_tables(spark):
    docs, items = hard_tables()
    assert decontamination.hits(*frames(spark, [], items), Scratch(spark, "t")).count() == 0
    for none in ([], [(1, None)]):
        found = decontamination.hits(*frames(spark, docs, none), Scratch(spark, "t")).collect()
        assert sorted(map(tuple, found), key=str) == sorted(plain(docs, []), key=str)


def test_a_very_long_text_and_a_word_without_end(spark):
    passage = prose(91, 40)
    docs = [(1, prose(92, 200_000) + " " + passage + " " + prose(93, 1000)), (2, "x" * 3_000_000), (3, "x" * 3_000_000 + " " + passage)]
    items = [(1, passage), (2, "x" * 3_000_000)]
    found = decontamination.hits(*frames(spark, docs, items), Scratch(spark, "t")).collect()
    assert sorted(map(tuple, found)) == sorted(plain(docs, items))


def test_keeps_fixture_columns(spark):
    """The shared fixture's columns, which clash with the operator's own, aren't read."""
    items = spark.createDataFrame([(1, prose(1, 60))], "item_id bigint, text string")
    found = decontamination.hits(table(spark), items, Scratch(spark, "t")).collect()
    assert len(found) == len(rows()) and sum(r.contaminated for r in found) >= 3
