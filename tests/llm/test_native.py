import hashlib
import re
from collections import Counter
from pathlib import Path

import pytest

from lumenlog.llm import fingerprints, licenses, quality
from lumenlog.scratch import Scratch

from .fixtures import rows, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    n_repeat = len(covered)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), n_repeat, len(words) < 10 or 100 * n_repeat > 20 * len(words))


def test_measures(spark):
    found = quality.measure(table(spark)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(r[0], *measures(r[1])) for r in rows()], key=str)


def test_verdicts_keep_every_row_and_follow_the_sketches(spark):
    measured = quality.measure(table(spark))
    judged = quality.judge(measured, quality.thresholds(measured)).select("doc_id", "base_failed", "kept").collect()
    assert len(judged) == len(rows())
    assert not any(r.kept for r in judged if r.base_failed)


@pytest.mark.parametrize("value", [0, 1, 63, 64, 65, 127, 1000, 123_456_789])
def test_cells_keep_leading_bits(spark, value):
    from pyspark.sql import functions as F

    cell = spark.range(1).select(quality.cell(F.lit(value).cast("bigint"))).first()[0]
    shift = max(0, value.bit_length() - quality.BITS)
    assert cell == value >> shift << shift


def verdicts(spark, some):
    measured = quality.measure(table(spark, some=some))
    return {r.doc_id: r.kept for r in quality.judge(measured, quality.thresholds(measured)).collect()}


def test_thresholds_adapt_to_the_source(spark):
    code = [(i, "fn main # $ | & x y z w v u " * 3 + " ".join(f"w{j}" for j in range(i % 7)) + f" u{i} # $ | &" * (1 + i % 5), "en", "code", 0) for i in range(300)]
    code = [(i, " ".join(f"{w}{i + k}" if k % 7 else w for k, w in enumerate(t.split())), *rest) for i, t, *rest in code]
    plain = [(1000 + i, "some plain words without any of those marks at all here " + f"u{i}", "en", "plain", 0) for i in range(300)]
    marked = code[4][1]
    few = "some plain words without many of those * marks at all here"
    kept = verdicts(spark, [*code, *plain, (5000, marked, "en", "plain", 0), (5001, few, "en", "plain", 0)])
    assert all(kept[r[0]] for r in plain) and sum(kept[r[0]] for r in code) > 290
    assert kept[4] and not kept[5000], "the text passes in its own source only"
    assert kept[5001], "one mark is no rate"


def test_small_groups_lean_on_their_language(spark):
    plain = [(i, f"some plain words without any marks here or there u{i} v{i}", "en", "plain", 0) for i in range(400)]
    odd = " ".join(f"## $$ && word{i}" for i in range(20))
    kept = verdicts(spark, [*plain, (1000, odd, "en", "rare", 0), (1001, odd + " more", "en", "rare", 0)])
    assert not kept[1000] and not kept[1001], "the two are all that their source has"


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_sketches_decide_on_the_test_tables(spark, sf):
    """Thresholds differ among groups, and no constants in their place give the same verdicts."""
    path = f"/root/testdata/sf{sf}/documents.parquet"
    if not Path(path).exists():
        pytest.skip("no test tables here")
    measured = quality.measure(spark.read.parquet(path)).drop("text").persist()
    limits = quality.thresholds(measured)
    found = limits.collect()
    assert len({r.most_word_length for r in found}) > 5
    kept = lambda most: {r.doc_id for r in quality.judge(measured, most).where("kept").select("doc_id").collect()}
    adapted = kept(limits)
    names = [f"most_{rule}" for rule in quality.RULES]
    for pick in (min, max) if sf == "0.1" else (min,):
        same = spark.createDataFrame([(r.lang_key, r.source_key, *[pick(x[n] for x in found) for n in names]) for r in found], limits.schema)
        assert kept(same) != adapted
    measured.unpersist()


def test_filter_keeps_columns_of_any_name(spark):
    clashing = table(spark).selectExpr("*", *[f"'mine' AS {c}" for c in ("most_symbols", "most_word_length", "lang_key", "source_key", "whole", "n_symbols", "base_failed", "row", "least")])
    found = quality.filter_documents(clashing, Scratch(spark, "t"))
    assert found.columns == clashing.columns and found.count() > 5
    assert {r.most_symbols + r.lang_key + r.whole + r.n_symbols for r in found.collect()} == {"mine" * 4}
    own = [c for c in clashing.columns if c not in ("n_symbols", "base_failed", "n_words", "kept")]
    measured = quality.measure(clashing)
    judged = quality.judge(measured, quality.thresholds(measured))
    assert set(own) <= set(judged.columns) and judged.where("lang_key = 'mine' AND most_symbols = 'mine'").count() == len(rows())
    assert quality.filter_documents(table(spark, some=[]), Scratch(spark, "t")).count() == 0


def test_empty_tables(spark):
    none = table(spark, some=[])
    measured = quality.measure(none)
    assert quality.judge(measured, quality.thresholds(measured)).count() == 0
    assert licenses.scan(none).count() == 0
    assert fingerprints.edited_pairs(none).count() == 0


def places(text):
    text = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    found = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_base_phrases(spark):
    found = licenses.scan(table(spark)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(r[0], *places(r[1])) for r in rows()], key=str)


def test_changed_notices_are_found(spark):
    found = {r.doc_id: r for r in licenses.scan(table(spark)).collect()}
    changed = next(r for r in found.values() if "notice-mit" in r.labels)
    assert 0.6 <= changed.score < 1
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found.values())


def test_large_template_sets_join_without_the_row_test(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_GRAMS", 3)
    test_base_phrases(spark)


def shingles(text):
    words = WORD.findall(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("ranges", ["1", "4", "40"])
def test_fingerprints(spark, ranges):
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    found = fingerprints.edited_pairs(table(spark)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    own = sorted([(r[0] if r[0] is not None else -1, r[1] or "") for r in rows()])
    assert len(found) == len(own)
    by = sorted(found, key=lambda r: (r.doc_id if r.doc_id is not None else -1, r.n_chars))
    prints = {}
    for k, (row, (_, text)) in enumerate(zip(by, own, strict=True)):
        following = own[(k + 1) % len(own)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, row.near_edited), (following, row.near_next)):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - true) < 0.17
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
        assert prints.setdefault(edited, row.edited_fingerprint) == row.edited_fingerprint


@pytest.mark.parametrize("rule, junk", [("symbols", lambda i: " ".join(f"w{j}q{i}%%" if j % (2 + i % 4) == 0 else f"w{j}q{i}" for j in range(80))), ("dup_lines", lambda i: "\n".join([f"line{i} again"] * (5 + i % 9) + [f"other{j}x{i} line{j}y{i} words{j}z{i}" for j in range(60)])), ("word_length", lambda i: " ".join(f"{'w' * (8 + i % 9)}{j}q{i}" for j in range(60)))])
def test_each_rule_follows_its_sketch(spark, rule, junk):
    """With the thresholds of other groups in their place, a rule's verdicts change; where nothing is there to read, it is off."""
    plain = lambda i: " ".join(f"some{j}x{i}" for j in range(60))
    docs = [(1000 * s + i, junk(i * (s + 1)) if i < 5 + 3 * s else plain(i + 1000 * s), "en", f"s{s}", 0) for s in range(3) for i in range(150)]
    measured = quality.measure(table(spark, some=docs)).persist()
    limits = quality.thresholds(measured).orderBy("source_key").collect()
    names = [f"most_{r}" for r in quality.RULES]
    assert len({r[f"most_{rule}"] for r in limits}) > 1
    kept = lambda most: {r.doc_id for r in quality.judge(measured, most).where("kept").select("doc_id").collect()}
    own = kept(spark.createDataFrame(limits))
    shuffled = [(r.lang_key, r.source_key, *[other[n] if n == f"most_{rule}" else r[n] for n in names]) for r, other in zip(limits, limits[1:] + limits[:1], strict=True)]
    assert kept(spark.createDataFrame(shuffled, ["lang_key", "source_key", *names])) != own
    measured.unpersist()


def test_a_rule_without_spread_is_off(spark):
    measured = quality.measure(table(spark, some=[(i, " ".join(f"some{j}x{i}" for j in range(30)), "en", "s", 0) for i in range(50)]))
    (limits,) = quality.thresholds(measured).collect()
    assert limits.most_symbols == limits.most_dup_lines == quality.OFF and 0 < limits.most_word_length < quality.OFF
