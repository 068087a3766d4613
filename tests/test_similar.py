"""The cosine join against all pairs."""

from __future__ import annotations

import math
import random

import pytest

from siltstone.operators.similar import cosine_pairs


def plain(rows, threshold, marked=lambda r: True):
    out = {}
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if x[1] == y[1] and (marked(x) or marked(y)):
                size = math.sqrt(sum(v * v for v in x[2] or [])) * math.sqrt(sum(v * v for v in y[2] or []))
                cosine = sum(a * b for a, b in zip(x[2] or [], y[2] or [])) / size if size else 0
                if cosine >= threshold:
                    out[min(x[0], y[0]), max(x[0], y[0])] = cosine
    return out


def vectors(seed, n, sparse):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.choice([-1, 1, 2]) * rng.random() if rng.random() < (0.15 if sparse else 1) else 0.0 for _ in range(24)]
        if sparse:
            v[0] = rng.random()  # a dimension that nearly all have
        if rows and rng.random() < 0.3:
            v = [x + rng.choice([0, 0, 0.05]) for x in rows[rng.randrange(len(rows))][2]]
        rows.append((i, rng.choice("aab"), v, rng.random() < 0.2))
    return rows


@pytest.mark.parametrize(("sparse", "threshold", "block"), [(True, 0.8, 1024), (True, 0.5, 7), (False, 0.7, 10)])
def test_cosine_pairs_equal_all_pairs(spark, sparse, threshold, block):
    rows = vectors(5, 150, sparse)
    df = spark.createDataFrame(rows, "id long, g string, v array<double>, m boolean").repartition(3)
    pairs, work = cosine_pairs(df, "id", "v", threshold, "g", block=block)
    got = {(r.a, r.b): r.cosine for r in pairs.collect()}
    assert got == pytest.approx(plain(rows, threshold)) and len(got) > 10 and pairs.count() == len(got)
    some = {(r.a, r.b): r.cosine for r in cosine_pairs(df, "id", "v", threshold, "g", marked="m", block=block)[0].collect()}
    assert some == pytest.approx(plain(rows, threshold, lambda r: r[3])) and 0 < len(some) < len(got)
    if not sparse:  # every row has every dimension: only the last can be the last that two share
        assert [(r.dim, r.rows) for r in work.collect()] == [(23, 150)]


def test_sparse_vectors_are_compared_where_they_may_match(spark):
    rows = [(i, "a", [0.3] + [1.0 if d == i % 40 else 0.0 for d in range(40)]) for i in range(400)]
    pairs, work = cosine_pairs(spark.createDataFrame(rows, "id long, g string, v array<double>"), "id", "v", 0.9)
    assert pairs.count() == 40 * 45 and sum(r.compared for r in work.collect()) == 40 * 45  # of 79,800


def test_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [2.0, 0.0]), (5, [-1.0, 0.0]), (6, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert [(r.a, r.b) for r in cosine_pairs(df.where("size(v) = 2 or v is null"), "id", "v", 0.5)[0].collect()] == [(3, 4)]
    assert cosine_pairs(df.where("false"), "id", "v", 0.5)[0].isEmpty()
    with pytest.raises(ValueError):
        cosine_pairs(df, "id", "v", 0.0)


def test_blocks_grow_with_the_rows(spark):
    """A row is sent to a bounded number of cells, and equal vectors, which make all pairs, come out block by block."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)] if i % 2 else [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(600)]
    want = {(i, j) for i, x in rows for j, y in rows if i < j and sum(p * q for p, q in zip(x, y)) >= 0.9 * math.hypot(*x) * math.hypot(*y)}
    for kind in ("float", "double"):
        pairs, work = cosine_pairs(spark.createDataFrame(rows, f"id long, v array<{kind}>"), "id", "v", 0.9, block=4)
        assert {(r.a, r.b) for r in pairs.collect()} == want and pairs.count() == len(want) > 300 * 299 / 2
        assert work.first().cells <= 16 * 17 / 2  # blocks of 4 rows would meet in 150 * 151 / 2


def test_vectors_of_different_sizes_are_refused(spark):
    with pytest.raises(Exception, match="different numbers of dimensions"):
        cosine_pairs(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0] * 4)], "id long, v array<double>").coalesce(1), "id", "v", 0.5)
