"""Incremental scans: the best link kept over micro-batches."""

from __future__ import annotations

import random

import pytest

from siltstone.operators import links as L
from siltstone.streaming import resume as R

LINKS = "path string, chunk_id long, chunk_seq long, match_seq long, url string, video_id string, title string, offset long, pattern_name string, pattern_idx int, confidence double"


def some_links(seed, n):
    rng = random.Random(seed)
    ids = ["hot"] * 5 + [f"id{i}" for i in range(40)]
    return [(f"img{rng.randrange(2)}", rng.randrange(9), rng.randrange(9), i, f"u{rng.randrange(4)}", rng.choice(ids) if rng.random() > 0.02 else None, rng.choice([None, None, "a title", "other"]), rng.randrange(3) * 100, "short", rng.randrange(3), rng.choice([0.5, 0.9, 1.0])) for i in range(n)]


def feed(spark, where, files):
    return spark.readStream.schema(LINKS).option("maxFilesPerTrigger", files).parquet(where)


def test_best_of_equals_best_links(spark):
    rows = [r for r in some_links(1, 400) if r[5]]
    df = spark.createDataFrame(rows, LINKS).repartition(3)
    for also in ((), ("path",)):
        assert sorted(map(tuple, L.best_of(df.toPandas().astype(object), [*also, "video_id"]).where(lambda x: x.notna(), None).values), key=str) == sorted(map(tuple, L.best_links(df, *also).collect()), key=str)


@pytest.mark.parametrize("also", [(), ("path",)])
def test_stream_best_equals_best_links_after_any_split(spark, tmp_path, also):
    rows = some_links(2, 300)
    everything = spark.createDataFrame(rows + rows[:20], LINKS)
    where, out, state = (str(tmp_path / x) for x in ("feed", "out", "state"))
    parts = [rows[:150], rows[150:160], rows[160:] + rows[:20]]
    for i, part in enumerate(parts):  # the stream ends and starts again between the parts
        spark.createDataFrame(part, LINKS).repartition(2).write.mode("append").parquet(where)
        got = R.stream_best(feed(spark, where, 1 + i), out, state, *also).collect()
        seen = spark.createDataFrame([r for p in parts[: i + 1] for r in p], LINKS)
        assert sorted(got) == sorted(L.best_links(seen.where("video_id IS NOT NULL"), *also).collect())
    assert sorted(got) == sorted(L.best_links(everything.where("video_id IS NOT NULL"), *also).collect())
    upgrades = spark.read.parquet(out)
    keys = [*also, "video_id"]
    assert upgrades.groupBy(*keys, "version").count().where("count > 1").isEmpty()
    assert 0 < upgrades.where("version > 1").count() < upgrades.count()
    assert sorted(R.stream_best(feed(spark, where, 1), out, state, *also).collect()) == sorted(got)  # nothing new


def test_stream_best_after_a_failed_batch(spark, tmp_path, monkeypatch):
    rows = [r for r in some_links(3, 120) if r[5]]
    where, out, state = (str(tmp_path / x) for x in ("feed", "out", "state"))
    spark.createDataFrame(rows, LINKS).repartition(3).write.parquet(where)
    from pyspark.sql import DataFrameWriter

    write, calls = DataFrameWriter.parquet, []

    def fails_once(self, path, *a, **k):
        write(self, path, *a, **k)
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost after its rows were written")

    monkeypatch.setattr(DataFrameWriter, "parquet", fails_once)
    with pytest.raises(Exception, match="lost after its rows"):
        R.stream_best(feed(spark, where, 1), out, state)
    got = R.stream_best(feed(spark, where, 1), out, state).collect()
    monkeypatch.undo()
    assert sorted(got) == sorted(L.best_links(spark.createDataFrame(rows, LINKS)).collect())
    assert spark.read.parquet(out).groupBy("video_id", "version").count().where("count > 1").isEmpty()


def test_stream_best_of_nothing(spark, tmp_path):
    where, out, state = (str(tmp_path / x) for x in ("feed", "out", "state"))
    spark.createDataFrame([], LINKS).write.parquet(where)
    assert R.stream_best(feed(spark, where, 1), out, state).isEmpty()


def test_an_id_is_compared_without_pandas(monkeypatch):
    """The state is compared row by row: equal to best_of() of all rows, which is not called for an id."""
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, x):
            self.exists, self.get = True, x

    rows = [r for r in some_links(4, 200) if r[5] == "hot"] + [("img0", 1, 2, None, None, "hot", "a title", None, None, None, 1.0)]
    columns = [x.split()[0] for x in LINKS.split(", ")]
    random.Random(5).shuffle(rows)
    state, want, out = State(), [], []
    for i in range(0, len(rows), 7):
        best = L.best_of(pd.DataFrame(rows[: i + 7], columns=columns).astype(object), ["video_id"]).iloc[0]
        want.append(tuple(None if pd.isna(v) else v for v in best))
    with monkeypatch.context() as m:
        m.setattr(L, "best_of", None)
        run = R._better(columns, ["video_id"])
        for i, w in zip(range(0, len(rows), 7), want, strict=True):
            out += [r for f in run(("hot",), iter([pd.DataFrame(rows[i : i + 7], columns=columns)]), state) for r in f.values.tolist()]
            assert tuple(state.get[:-1]) == w
    assert [r[-1] for r in out] == list(range(1, len(set(want)) + 1)) and len(out) > 1
