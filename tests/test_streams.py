"""Heaviest paths by blocks against one pass over all rows, and numbers and running results of large groups."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions.scratch import Scratch
from siltstone.operators import order
from siltstone.operators import streams as A

NODES = "image long, id long, offset long, size long, file_type string, score double, structured boolean, links array<string>, vector array<double>"


def arcs(rng, n, look, values=(-3, -1, 0, 1, 2)):
    """Random edges with many ties: (own, ptr, back, score)."""
    into = [sorted(rng.sample(range(1, look + 1), rng.randrange(0, look + 1))) for _ in range(n)]
    back = [[d for d in ds if True] for ds in into]
    own = np.array([rng.choice(values) for _ in range(n)], np.int64)
    flat = np.array([d for ds in back for d in ds], np.int32)
    ptr = np.concatenate(([0], np.cumsum([len(d) for d in back]))).astype(np.int64)
    return own, ptr, flat, np.array([rng.choice(values) for _ in flat], np.int64)


def cut(whole, a, b):
    own, ptr, back, score = whole
    return own[a:b], ptr[a : b + 1] - ptr[a], back[ptr[a] : ptr[b]], score[ptr[a] : ptr[b]]


@pytest.mark.parametrize(("look", "size"), [(1, 1), (1, 4), (3, 3), (3, 7), (5, 8)])
def test_block_matrices_give_the_weights_of_one_pass(look, size):
    rng = random.Random(look * 10 + size)
    for _ in range(20):
        n = size * rng.randrange(2, 7)
        whole = arcs(rng, n, look)
        nothing = np.full(look, A.NONE)
        # an edge over the beginning has nothing to come from
        weight, step = A.forward(*whole, nothing)
        matrices = [A.transfer(*cut(whole, a, a + size), look) for a in range(0, n, size)]
        state = nothing
        for k, m in enumerate(matrices):
            got, steps = A.forward(*cut(whole, k * size, (k + 1) * size), state)
            assert (got == weight[k * size : (k + 1) * size]).all() and (steps == step[k * size : (k + 1) * size]).all()
            state = A.after(state, m.reshape(-1))
            held = np.concatenate((nothing, weight))[(k + 1) * size : (k + 1) * size + look]
            assert (np.maximum(state, A.NONE // 2) == np.maximum(held, A.NONE // 2)).all()
        both = A.after(nothing, A.product([m.reshape(-1) for m in matrices]).reshape(-1))
        assert (np.maximum(both, A.NONE // 2) == np.maximum(state, A.NONE // 2)).all()


def test_passed_is_where_paths_come_from():
    rng = random.Random(3)
    for _ in range(50):
        n, look = rng.randrange(1, 30), rng.randrange(1, 6)
        step = np.array([rng.randrange(look + 1) for _ in range(n)], np.int32)
        for r, p in enumerate(A.passed(step, look)):
            while r >= 0 and step[r]:
                r -= step[r]
            assert p == (look + r if r < 0 else -1)


def images(seed, lengths):
    rng = random.Random(seed)
    rows = []
    for image, n in enumerate(lengths):
        at = 0
        for k in range(n):
            at += rng.choice([0, 10, 60, 60, 90, 120])
            rows.append((image, k, at, rng.choice([5, 50, 120]), rng.choice("ab"), rng.choice([-30.0, -30.0, 5.0, 1.5]), rng.random() < 0.5, rng.sample("wxyz", rng.randrange(3)), rng.choice([[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]])))
    return rows


def test_streams_of_many_blocks_equal_those_of_one(spark, block_rows=5):
    w = A.Weights(max_gap=300, max_overlap=200, max_lookback=4)
    df = spark.createDataFrame(images(8, [120, 1, 30]), NODES).repartition(3)
    one = sorted(map(str, A.assemble(df, w, 2).collect()))
    assert one == sorted(map(str, A.assemble(df, replace(w, block_rows=block_rows), 2).collect()))
    assert sorted(map(str, A.edges(df, w).collect())) == sorted(map(str, A.edges(df, replace(w, block_rows=block_rows)).collect()))


def test_equal_paths_are_told_apart_alike(spark):
    # every edge and every row weigh the same, so all paths of one length tie
    rows = [(0, k, 10 * k, 10, "a", 1.0, True, [], [1.0]) for k in range(60)]
    w = A.Weights(max_lookback=3, gap_penalty=0.0)
    df = spark.createDataFrame(rows, NODES)
    got = [A.assemble(df, replace(w, block_rows=b), 2).orderBy("stream", "position").collect() for b in (1024, 5)]
    assert got[0] == got[1] and [r.id for r in got[0]] == list(range(60))


def test_an_unbroken_piece_takes_many_tasks(spark):
    n = 30_000
    df = spark.range(n).select(F.lit(0).cast("long").alias("image"), "id", (F.col("id") * 10).alias("offset"), F.lit(10).cast("long").alias("size"), F.lit("a").alias("file_type"), (F.col("id") % 7 - 5).cast("double").alias("score"), F.lit(False).alias("structured"), F.array().cast("array<string>").alias("links"), F.array((F.col("id") % 2).cast("double"), F.lit(0.5)).alias("vector"))
    w = A.Weights(max_lookback=4, block_rows=512)
    got = A.assemble(df, w, 1).cache()
    best = A.assemble(df, replace(w, block_rows=n), 1)
    assert got.count() == best.count() > n / 2 and got.exceptAll(best).isEmpty()
    rows, solved = A._solve(A.pieces(df, w.max_gap).withColumn("turn", F.lit(0)), w, Scratch(spark, "t"))
    assert solved.count() == -(-n // 512) and rows.select("piece").distinct().count() == 1
    got.unpersist()


def test_streams_of_odd_tables(spark):
    none = spark.createDataFrame([], NODES)
    assert A.assemble(none).isEmpty() and A.edges(none).isEmpty()
    odd = spark.createDataFrame([(1, 0, 0, 10, None, None, None, None, [0.0, 0.0]), (1, 1, 10, 10, None, float("nan"), None, [], [1.0, 0.0]), (1, 2, 20, 0, "a", 2.0, True, ["x"], [1.0, 0.0])], NODES)
    got = A.assemble(odd, max_streams=5).collect()
    assert sorted(r.id for r in got) == [0, 1, 2]


def test_numbers_in_groups_of_any_size(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 < 3, F.lit("big")).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"), F.lit(1).alias("h"), F.hash("id").alias("o"), "id")
    got = order.numbered(rows.repartition(5), ["g", "h"], ["o", "id"], Scratch(spark, "t")).collect()
    groups = {}
    for r in sorted(rows.collect(), key=lambda r: (r.o, r.id)):
        groups.setdefault(r.g, []).append(r.id)
    assert len(got) == 5000 and all(groups[r.g][r.rn] == r.id and r.n_rows == len(groups[r.g]) for r in got)
    assert order.numbered(rows.where("false"), ["g"], ["o"], Scratch(spark, "t")).isEmpty()


@pytest.mark.parametrize("fan", [2, 16])
def test_running_sums(spark, fan):
    blocks = spark.createDataFrame([(g, b, bytearray(np.array([b + g], np.int64).tobytes()), bytearray(np.array([100 * g], np.int64).tobytes())) for g in range(4) for b in range(1 + 13 * g)], "g long, block long, payload binary, start binary")
    got = order.running(blocks, ["g"], F.col("start"), lambda x: np.sum(x, axis=0), lambda s, x: s + x, "int64", Scratch(spark, "t"), fan).collect()
    assert len(got) == 4 + 13 * 6
    for r in got:
        assert np.frombuffer(r.state, np.int64)[0] == 100 * r.g + sum(b + r.g for b in range(r.block))
