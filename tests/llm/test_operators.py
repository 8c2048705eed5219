import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenlog.llm import bpe_trie, near_dup, packing, sharding, substrings, token_files
from lumenlog.llm.queries import vocabulary
from lumenlog.scratch import Scratch

from .brute import components, cut, sha
from .fixtures import prose, rows, table

tokenizers = pytest.importorskip("tokenizers")
WORDS, BYTES = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


def library(path):
    return tokenizers.Tokenizer.from_file(path)


def test_bpe_agrees_with_the_library(spark):
    own = library(BYTES)
    want = []
    for r in rows():
        ids = own.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(",".join(map(str, ids)).encode()), sha(own.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, bpe_trie.digests(table(spark), BYTES).collect()), key=str) == sorted(want, key=str)
    full = bpe_trie.encode_decode(table(spark), BYTES).collect()
    assert sorted((r.decoded for r in full)) == sorted(r[1] or "" for r in rows())


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_bpe_of_any_text(text):
    ids = test_bpe_of_any_text.own.encode(text, add_special_tokens=False).ids
    (found, decoded), = bpe_trie.coder(BYTES).run([text])
    assert found == ",".join(map(str, ids)) and decoded == text.encode()


test_bpe_of_any_text.own = library(BYTES)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_word_ids_of_any_text(text):
    from lumenlog.llm.word_ids import encoder

    assert np.frombuffer(encoder(WORDS).run([text])[0], "<u4").tolist() == test_word_ids_of_any_text.own.encode(text, add_special_tokens=False).ids


test_word_ids_of_any_text.own = library(WORDS)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(1, 60))
def test_fill_is_the_best_subset(counts, room):
    reached = {0}
    for length, n in counts.items():
        reached = {s + length * k for s in reached for k in range(n + 1) if s + length * k <= room}
    chosen = packing.fill(counts, room)
    assert sum(k * n for k, n in chosen.items()) == max(reached)
    assert all(n <= counts[k] for k, n in chosen.items())


@pytest.mark.parametrize("pool", [3, 4096])
def test_packing(spark, monkeypatch, pool):
    monkeypatch.setattr(packing, "POOL", pool)
    own = library(WORDS)
    found = packing.pack_documents(table(spark).coalesce(1), WORDS, with_ids=True).collect()
    ids = Counter(tuple(own.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows())
    windows, whole = defaultdict(list), defaultdict(list)
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
        windows[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id].append(r)
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0
    single = {k: v for k, v in whole.items() if sum(r[0] == k for r in rows()) == 1}
    for pieces in single.values():
        joined = tuple(x for r in sorted(pieces, key=lambda r: r.start) for x in r.ids)
        assert joined in ids and all(r.doc_tokens == len(joined) for r in pieces)
    assert sum(r.length for r in found) == sum(len(k) * n for k, n in ids.items())


def test_token_files(spark, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    (tmp_path / "tokens").mkdir()
    for kind in ("arrow", "index"):  # as an attempt leaves them that was lost
        (tmp_path / "tokens" / f"shard-000000-lost.{kind}").write_bytes(b"half")
    manifest = token_files.write_tokens(table(spark), folder, WORDS, sequence=64, shards=3)
    own = library(WORDS)
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for r in ordered:
        ids = own.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = sorted(map(tuple, token_files.read_documents(spark, folder).collect()), key=lambda r: r[1])
    assert found == want
    shard = token_files.ShardReader(folder, manifest.orderBy("shard").first().file)
    ids, mask = shard.sequence_at(0)
    assert len(ids) == len(mask) == 64 and ids.dtype == np.uint16 and mask.all() and not ids.flags.owndata
    named = {r.file for r in manifest.collect()}
    assert {p.name.split(".")[0] for p in tmp_path.glob("tokens/shard-*")} == named and len(named) == manifest.count()


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    found = near_dup.groups(table(spark), Scratch(spark, "t"), width=width).collect()
    want = components({r[0]: r[1] for r in rows() if r[0] is not None}, width)
    assert len(found) == len(rows())
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


@pytest.mark.parametrize("rounds, small, block, slice_", [(0, 8, 500_000, 1000), (0, 2, 300, 7), (1, 8, 500_000, 1000), (1, 1, 300, 7), (3, 100, 1, 1)])
def test_near_duplicates_linked_through_others_only(spark, monkeypatch, rounds, small, block, slice_):
    """A chain whose ends are unlike, and a group that has no member near all others; by pivots, pairs and blocks."""
    for name, value in (("ROUNDS", rounds), ("SMALL", small), ("BLOCK", block), ("SLICE", slice_)):
        monkeypatch.setattr(near_dup, name, value)
    words = prose(11, 120).split()
    chain = [(i, " ".join(words[4 * i : 4 * i + 60]), "en", "s", 0) for i in range(12)]
    star = prose(12, 100).split()
    group = [(100 + i, " ".join(w if j not in (7 * i % 100, 7 * i % 100 + 1) else f"q{i}" for j, w in enumerate(star)), "en", "s", 0) for i in range(60)]
    found = near_dup.groups(table(spark, some=[*chain, *group]), Scratch(spark, "t"), width=2).collect()
    want = components({r[0]: r[1] for r in [*chain, *group]}, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def test_sketch_fills_every_coordinate_and_estimates():
    own = np.random.default_rng(1)
    common, a, b = (own.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    x, y = (near_dup.sketch(np.concatenate([common, z])) for z in (a, b))
    assert abs((x == y).mean() - 0.8) < 0.12
    assert (near_dup.sketch(common[:1]) < 1 << 63).all()


@pytest.mark.parametrize("at_once", [1, 1 << 21])
def test_repeated_strings(spark, at_once, monkeypatch):
    monkeypatch.setattr(substrings, "AT_ONCE", at_once)
    found = substrings.remove_repeats(table(spark), Scratch(spark, "t"), with_text=True, carry=("lang",)).collect()
    want = [(r[0], len((r[1] or "").encode()), removed, spans, sha(rest), rest.decode("utf-8", "ignore"), r[2]) for r, (rest, removed, spans) in zip(rows(), cut([r[1] for r in rows()]), strict=True)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_repeated_strings_that_share_ends_only(spark):
    """Overlaps, strings of exactly the length, and one byte less."""
    x = prose(21, 200)
    texts = [x[:199] + "A", "B" + x[:199], x[:200] + "C", "DD" + x[300:500] + "E", "FFF" + x[300:500], x[500:720] + "zz" + x[620:900], "y" + x[520:800], "é" * 150, "ü" + "é" * 100]
    some = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    found = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(table(spark, some=some), Scratch(spark, "t")).collect()}
    assert found == {i: (removed, spans, sha(rest)) for i, (rest, removed, spans) in enumerate(cut(texts))}


@pytest.mark.parametrize("bits", [4, 17, 28, 32])
@pytest.mark.parametrize("size", [4, 7])
def test_names_of_all_ranges_are_told_apart(bits, size):
    """Names that differ in their range only, or in their last bits only."""
    base = 0x0123456789ABCDEF
    values = np.array([base, base | 0xF << 60, base ^ 1 << 32, base ^ 1 << (63 - bits), 7], np.uint64)
    second = np.arange(5, dtype=np.uint64) // np.uint64(2) if size == 7 else None
    sent = list(substrings.outbox([(values[:3], second[:3])] if size == 7 else [values[:3]], bits, size))
    table = pa.table({"part": [p for p, _, _ in sent], "names": [a + b for _, a, b in sent], "n_home": [0] * len(sent), "ranks": [b""] * len(sent)})
    held = substrings.Held(table, size)
    beside = second if size == 7 else substrings.within(values, bits, size)
    keys = lambda k: (int(values[k]) >> 64 - bits, int(beside[k]))
    want = [keys(k) in {keys(j) for j in range(3)} for k in range(5)]
    assert held.has(values, bits, second).tolist() == want and want[:3] == [True] * 3 and not want[4]


def test_ranges_and_kept_bytes_need_room():
    with pytest.raises(ValueError):
        substrings.within(np.zeros(1, np.uint64), 33, 4)


def test_the_cover_has_every_difference_once():
    period = substrings.PERIOD
    assert sorted((a - b) % period for a in substrings.COVER for b in substrings.COVER if a != b) == list(range(1, period))


def test_sharding(spark):
    shards = [f"s{i}" for i in range(10)]
    owner = sharding.lookup_table(shards, 997)
    assert max(Counter(owner).values()) - min(Counter(owner).values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 997)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 9)
    assert moved < 300
    placed = sharding.place(table(spark), "doc_id", shards, 997).collect()
    assert len(placed) == len(rows()) and all(shards[owner[r.slot]] == r.shard for r in placed)
    assert len({(r.doc_id, r.shard) for r in placed}) == len({r.doc_id for r in placed})
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 1000)


def test_empty_tables(spark, tmp_path):
    none = table(spark, some=[])
    assert bpe_trie.digests(none, BYTES).count() == 0
    assert packing.pack_documents(none, WORDS).count() == 0
    assert near_dup.groups(none, Scratch(spark, "t")).count() == 0
    assert substrings.remove_repeats(none, Scratch(spark, "t")).count() == 0
    assert sharding.place(none, "doc_id", ["a"], 7).count() == 0
    token_files.write_tokens(none, f"file://{tmp_path}/none", WORDS)
    assert token_files.read_documents(spark, f"file://{tmp_path}/none").count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from lumenlog.llm import quality

    docs = [r for r in rows() if r[0] is not None]
    docs = [*docs, *[(5000 + i, prose(100 + i, 40 + i), "en", "s0", 0) for i in range(20)]]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    measured = quality.measure(frame)
    passed = {r.doc_id: r.text for r in quality.judge(measured, quality.thresholds(measured)).where("kept").collect()}
    assert 5003 in passed and 3 not in passed
    groups = components(passed, 5)
    left = {k: t for k, t in sorted(passed.items()) if groups[k][1] == k}
    final = dict(zip(left, [rest.decode("utf-8", "ignore") for rest, _, _ in cut(list(left.values()))], strict=True))
    own = library(WORDS)
    want = {k: len(own.encode(t, add_special_tokens=False).ids) + 1 for k, t in final.items()}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = Counter()
    for r in found:
        total[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert total == want


def test_one_of_each_group_stays_whatever_the_columns(spark):
    """Repeated and null ids, and columns named as the operator's own."""
    some = [r for r in rows() if r[0] is not None]
    some += [(some[0][0], "another text of the first id", "de", "s0", 1), (None, prose(3, 40), "en", "s0", 1), (None, prose(3, 40), "en", "s0", 1)]
    docs = table(spark, some=some).selectExpr("*", "1 AS _first", "2 AS row", "3 AS place", "4 AS component_id", "map('a', 1) AS m")
    found = near_dup.keep_one(docs, Scratch(spark, "t"))
    assert found.columns == docs.columns
    got = found.collect()
    ids = [r.doc_id for r in got if r.doc_id is not None]
    want = components({r[0]: r[1] for r in sorted(some, key=str) if r[0] is not None}, 5)
    assert len(ids) == len(set(ids)) and sum(r.doc_id is None for r in got) == 2
    assert {i for i in ids if i != some[0][0]} == {k for k, (_, c) in want.items() if k == c and k != some[0][0]}
    assert all(r._first == 1 and r.m == {"a": 1} for r in got)


def test_pipeline_of_nothing_null_ids_and_clashing_names(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _first int, row string, beside string, kept_text string, _words int"
    docs = [(i if i % 7 else None, prose(300 + i // 2, 60), ["en", None][i % 2], None, None, i, "r", "b", "k", 0) for i in range(1, 20)] + [(3, prose(77, 50), "en", "s", 1, 1, "r", "b", "k", 0), (40, None, None, None, None, None, None, None, None, None)]
    for name, some in (("none", []), ("some", docs)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        found = corpus_pipeline.run(spark, folder).collect()
        assert bool(found) == bool(some)
    assert None in {r.doc_id for r in found} and 40 not in {r.doc_id for r in found} and 3 in {r.doc_id for r in found}
