"""Groups kept between batches, and extraction from SQL."""

from __future__ import annotations

import random

import pytest

from siltstone import queries_scan
from siltstone.functions import table_functions
from siltstone.functions.scratch import Scratch
from siltstone.operators.graph import components
from siltstone.streaming.groups import IncrementalGroups, stream_groups


def test_groups_equal_components_after_each_batch(spark, tmp_path):
    rng = random.Random(9)
    held, everything = IncrementalGroups(spark, str(tmp_path / "g")), []
    assert held.find().isEmpty()
    for batch in range(5):
        links = [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.choice([0, 6, 12]))] + ([(7, 7), (None, 3)] if batch == 1 else [])
        df = spark.createDataFrame(links, "a long, b long")
        held.add(df, batch)
        held.add(df, batch)  # a batch that comes again adds nothing
        everything += [x for x in links if None not in x]
        want = {r.id: r.component for r in components(spark.createDataFrame(everything, "a long, b long"), Scratch(spark, "t")).collect()}
        got = {r.id: r.component for r in held.find().collect()}
        assert {i: c for i, c in got.items() if i in want} == want and held.find().count() == len(got)
        assert all(got[i] == i for i in got.keys() - want.keys()) and got.keys() == {i for x in everything for i in x}
    held.clear()
    assert IncrementalGroups(spark, str(tmp_path / "g")).find().isEmpty()


def test_a_batch_that_fails_leaves_the_groups_as_they_were(spark, tmp_path, monkeypatch):
    from siltstone.streaming import groups

    held = IncrementalGroups(spark, str(tmp_path / "g"), "string")
    df = lambda *x: spark.createDataFrame(list(x), "a string, b string")
    held.add(df(("b", "c"), ("x", "y")), 0)
    before = sorted(held.find().collect())
    with monkeypatch.context() as m:
        m.setattr(groups, "write_text", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            held.add(df(("a", "c"), ("y", "c")), 1)
    assert sorted(held.find().collect()) == before
    held.add(df(("a", "c"), ("y", "c")), 1)
    assert {tuple(r) for r in held.find().collect()} == {(i, "a") for i in "abcxy"}


def test_stream_of_links(spark, tmp_path):
    where = str(tmp_path / "feed")
    spark.createDataFrame([(1, 2), (3, 4), (4, 5), (2, 3), (8, 9)], "a long, b long").repartition(3).write.parquet(where)
    feed = spark.readStream.schema("a long, b long").option("maxFilesPerTrigger", 1).parquet(where)
    got = stream_groups(feed, str(tmp_path / "g"), str(tmp_path / "state"))
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)}


def test_sql_alone_gives_link_windows(spark):
    rows = lambda name: sorted(map(str, queries_scan.QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    assert rows("link_windows_sql") == rows("link_windows") != []


def test_table_functions(spark):
    table_functions.register(spark)
    url = "https://youtu.be/abcDEF_-123"
    spark.createDataFrame([("p", 1, 0, 10, bytearray(f"{url} {url}".encode())), ("p", 2, 1, 99, None)], "path string, chunk_id long, chunk_seq long, offset long, data binary").createOrReplaceTempView("some_chunks")
    at = lambda q: [(r.chunk_id, r.offset, r.video_id) for r in spark.sql(q).orderBy("offset").collect()]
    assert at("SELECT * FROM extract_links(TABLE(some_chunks), true)") == [(1, 10, "abcDEF_-123")]
    assert at("SELECT * FROM extract_links(TABLE(some_chunks) PARTITION BY (path), false)") == [(1, 10, "abcDEF_-123"), (1, 39, "abcDEF_-123")]
    for bad in ("extract_links(TABLE(SELECT 1 AS x), true)", "extract_links(1, true)", "extract_links(TABLE(some_chunks), 3)"):
        with pytest.raises(Exception, match="extract_links takes|no column"):
            spark.sql(f"SELECT * FROM {bad}").collect()
    assert spark.sql("SELECT t.id, l.pattern_name FROM VALUES (1, 'x'), (2, 'https://youtu.be/abcDEF_-123'), (3, NULL) AS t(id, x), LATERAL find_links(x) l").collect() == [(2, "short")]
