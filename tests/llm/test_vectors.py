"""Vector codes and clusters against plain Python, on hard vectors too."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenlog.llm import clusters, vector_codes, vectors
from lumenlog.scratch import Scratch

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def whole(x, scale):
    return int(x) * scale if abs(x) >= 2**53 else math.floor(scale * x)


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def long(v):
    return v if v is None or v < 2**63 else None


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def nulls_last(v):
    return (v is None, v)


def moved(rows, entries, number):
    out = []
    for e, old in enumerate(entries):
        own = [r for r, n in zip(rows, number, strict=True) if n == e]
        out.append([sum(c) // len(own) for c in zip(*own, strict=True)] if own else old)
    return out


def nearest(row, entries):
    return min(range(len(entries)), key=lambda e: (square(row, entries[e]), e))


def plain_clusters(rows, size, k=8, rounds=10, scale=1024):
    own = [(i, [whole(x, scale) for x in v]) for i, v, _ in rows if usable(v) and len(v) == size]
    digest = lambda i: None if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    own.sort(key=lambda r: (nulls_last(digest(r[0])), r[1]))
    points, centroids = [v for _, v in own], [v for _, v in own[:k]]
    for _ in range(rounds):
        centroids = moved(points, centroids, [nearest(v, centroids) for v in points])
    number = [nearest(v, centroids) for v in points]
    far = [square(v, centroids[n]) for v, n in zip(points, number, strict=True)]
    of = [sum(d for d, m in zip(far, number, strict=True) if m == n) for n in number]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, long(d), long(o), long(sum(far)), sha[n]) for (i, _), n, d, o in zip(own, number, far, of, strict=True)]


def plain_codes(rows, size, parts=8, entries=16, rounds=6, scale=4096):
    own = sorted(((i, [whole(x, scale) for x in v], label) for i, v, label in rows if usable(v)), key=lambda r: (nulls_last(r[0]), r[1]))
    sized = [r for r in own if len(r[1]) == size]
    width = size // parts
    books, numbers = [], []
    for p in range(parts):
        points = [v[p * width : (p + 1) * width] for _, v, _ in sized]
        book = points[:entries]
        for _ in range(rounds):
            book = moved(points, book, [nearest(v, book) for v in points])
        books.append(book)
        numbers.append([(n, square(v, book[n])) for v in points for n in [nearest(v, book)]])
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(i, "".join(f"{n[at][0]:02x}" for n in numbers), long(sum(n[at][1] for n in numbers)), label) for at, (i, _, label) in enumerate(sized)]
    coded += [(i, None, None, label) for i, v, label in own if len(v) != size]

    def of(label):
        errors = [e for _, _, e, other in coded if other == label and e is not None]
        return long(sum(errors)) if errors else None

    return [(i, code, error, of(label), sha) for i, code, error, label in coded]


def hard_rows(size, most=1.0, seed=5, n=60):
    own = random.Random(seed)
    rows = [(i, [own.uniform(-most, most) for _ in range(size)], own.choice([None, 0, 1, 2])) for i in range(n)]
    grid = [(100 + i, [own.choice([-1.0, 0.0, 1.0]) for _ in range(size)], None) for i in range(n // 2)]
    odd = [(200, None, 1), (201, [None] * size, 1), (202, [math.nan] * size, 7), (203, [math.inf] + [0.0] * (size - 1), 1), (204, [], 9), (205, [0.5] * (size + 3), 3), (206, [0.5] * (size - 1), 2)]
    return [*rows, *grid, *odd, rows[3], (3, [0.25] * size, 0), (None, [0.125] * size, None), (None, [-0.125] * size, 4), rows[7]]


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "x", "ids", "beside", "digest", "code", "cluster", "distance"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df.repartition(3)


@pytest.mark.parametrize("most", [1.0, 1e5, 1e12, 1e300, 1.7e308])
def test_clusters(spark, most):
    rows = hard_rows(6, most)
    found = clusters.clusters(table(spark, rows), Scratch(spark, "t"), size=6)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_clusters(rows, 6), key=str)


@pytest.mark.parametrize("most", [1.0, 1e5, 1e12, 1.7e308])
def test_codes(spark, most):
    rows = hard_rows(16, most)
    found = vector_codes.codes(table(spark, rows), Scratch(spark, "t"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_codes(rows, 16), key=str)


def test_few_and_no_vectors(spark):
    few = [(5, [1.0] * 8, None), (4, [1.0] * 8, 2)]
    found = clusters.clusters(table(spark, few), Scratch(spark, "t"), size=8).collect()
    assert sorted(map(tuple, found)) == sorted(plain_clusters(few, 8))
    found = vector_codes.codes(table(spark, few), Scratch(spark, "t")).collect()
    assert sorted(map(tuple, found)) == sorted(plain_codes(few, 8))
    for none in ([], [(1, None, 1)]):
        assert clusters.clusters(table(spark, none), Scratch(spark, "t")).count() == 0
        assert vector_codes.codes(table(spark, none), Scratch(spark, "t")).count() == 0
    (odd,) = vector_codes.codes(table(spark, [(1, [1.0, 2.0], 3)]), Scratch(spark, "t")).collect()
    assert (odd.vec_id, odd.code, odd.error, odd.label_error) == (1, None, None, None)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 40), st.integers(1, 4), st.sampled_from([2, 5, 1000, 2**27, 2**40]))
def test_tree_finds_the_lowest_of_the_nearest(seed, entries, size, most):
    own = random.Random(seed)
    draw = lambda n: [[own.randrange(-most, most) for _ in range(size)] for _ in range(n)]
    book, queries = draw(entries), draw(30)
    book += own.sample(book, min(3, len(book)))
    number, distance = vector_codes.Tree(np.array(book, object)).nearest(np.array(queries, float))
    assert number.tolist() == [nearest(q, book) for q in queries]
    assert [int(d) for d in distance] == [square(q, book[n]) for q, n in zip(queries, number.tolist(), strict=True)]


@pytest.mark.parametrize("most, kind", [(1000, np.float64), (2**24, np.int64), (2**31, object)])
def test_distances_stay_exact_beyond_doubles(most, kind):
    own = random.Random(most)
    x = np.array([[own.randrange(most // 2, most) for _ in range(64)] for _ in range(50)], float)
    assert vectors.exact(x, 4 * 64 * vectors.largest(x) ** 2).dtype == kind
    number, distance = clusters.nearest(x, x[:8].astype(object))
    plain = [[int(v) for v in row] for row in x]
    assert number.tolist() == [nearest(row, plain[:8]) for row in plain]
    assert [int(d) for d in distance] == [square(row, plain[n]) for row, n in zip(plain, number.tolist(), strict=True)]


def test_blocks_are_cut(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 7)
    rows = hard_rows(8)
    found = clusters.clusters(table(spark, rows), Scratch(spark, "t"), size=8)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_clusters(rows, 8), key=str)
