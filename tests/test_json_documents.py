"""Elements of JSON files, read in splits of a few bytes, against the json module."""

import json
import random

from lumenlog.sources import json_documents


def test_elements_of_arrays_and_objects(spark, tmp_path):
    own = random.Random(2)
    texts = ['a,b]"}', "\\", 'x\\",{[', "é\n", "", "plain"]

    def value(depth=0):
        kind = own.randrange(6 if depth < 3 else 3)
        if kind < 2:
            return own.choice(texts)
        if kind == 2:
            return own.choice([1, -2.5, None, True])
        items = [value(depth + 1) for _ in range(own.randrange(4))]
        return items if kind == 3 else {own.choice(texts) + str(i): v for i, v in enumerate(items)}

    arrays = [[value() for _ in range(n)] for n in (0, 1, 40, 120)]
    objects = [{"n": i, "v": value()} for i in range(60)]
    (tmp_path / "in").mkdir()
    want = {}
    for i, items in enumerate(arrays):
        for indent in (None, 2):
            name = f"array{i}-{indent}.json"
            (tmp_path / "in" / name).write_text("﻿ \n" * (i % 2) + json.dumps(items, indent=indent, ensure_ascii=bool(i % 2)) + "\n", "utf-8")
            want[name] = items
    for name, between in (("lines.json", "\n"), ("joined.json", ""), ("pretty.json", "\n\n")):
        (tmp_path / "in" / name).write_text(between.join(json.dumps(x, indent=2 if name == "pretty.json" else None) for x in objects), "utf-8")
        want[name] = objects
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = json_documents.read_documents(spark, f"{tmp_path}/in").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found = {name: [] for name in want}
    for r in sorted(rows, key=lambda r: r.element):
        assert r.error is None
        found[r.file.rsplit("/", 1)[-1]].append(json.loads(r.text))
    assert found == want


def test_broken_documents_are_told(spark, tmp_path):
    files = {"late": '[1, 2] x, "y"', "open": '[{"a": 1}, {"b": [2', "odd": '[1, zz, 3]', "cut": '{"a": {"b": 1}}\n{"c": {', "empty": "", "blank": " \n", "none": "[ ]"}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = json_documents.read_documents(spark, str(tmp_path)).collect()
    found = sorted((r.file.rsplit("/", 1)[-1][:-5], r.element or 0, r.text, r.error) for r in rows)
    assert found == [
        ("cut", 1, '{"a": {"b": 1}}', None),
        ("cut", 2, '{"c": {', "no JSON"),
        ("late", 0, 'x, "y"', "content after the array"),
        ("late", 1, "1", None),
        ("late", 2, "2", None),
        ("odd", 1, "1", None),
        ("odd", 2, "zz", "no JSON"),
        ("odd", 3, "3", None),
        ("open", 1, '{"a": 1}', None),
        ("open", 2, '{"b": [2', "the array isn't closed"),
    ]


def test_pieces_are_not_kept(spark, tmp_path, monkeypatch):
    """What is kept between steps is a row an element and split, not a row a piece, and an open array is told across splits."""
    items = [{"n": i, "v": ["a,b", "\\\"],", list(range(20))]} for i in range(200)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "closed.json").write_text(json.dumps(items))
    (tmp_path / "in" / "open.json").write_text(json.dumps(items)[:-1])
    kept, own = [], json_documents.Scratch.keep
    monkeypatch.setattr(json_documents.Scratch, "keep", lambda self, df, name: kept.append(own(self, df, name)) or kept[-1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = json_documents.read_documents(spark, f"{tmp_path}/in").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in ("closed", "open"):
        found = sorted((r for r in rows if r.file.endswith(f"/{name}.json")), key=lambda r: r.element)
        assert [json.loads(r.text) for r in found] == items
        assert [r.error for r in found] == [None] * 199 + [None if name == "closed" else "the array isn't closed"]
    assert sum(t.count() for t in kept) < 3 * len(rows)
