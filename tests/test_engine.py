"""Values that the engine must reproduce, and behaviour at the edges."""

from __future__ import annotations

import glob
import json
import os
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone import queries_structure as Q
from siltstone.functions import octets as O
from siltstone.functions import predicates as V
from siltstone.functions import scores as S
from siltstone.functions.scratch import Scratch
from siltstone.operators import chunks as C
from siltstone.operators import exfat as X
from siltstone.operators import graph as G
from siltstone.operators import joins as J
from siltstone.operators import links as L
from siltstone.operators import media as M
from siltstone.operators import report as T
from siltstone.operators import streams as A
from siltstone.plans import scan as N
from siltstone.sources import images, sinks
from siltstone.streaming import resume as R


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'string' if isinstance(v, str) else 'long'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(*columns).first()


def test_chunks(spark):
    row = spark.createDataFrame([("a", 5000, bytearray(5000))], "path string, length long, content binary")
    got = [(r.offset, r.size) for r in C.chunk_ranges(row, "length", 1024, 64).orderBy("offset").collect()]
    assert got == [(0, 1088), (1024, 1088), (2048, 1088), (3072, 1088), (4096, 904)]
    assert C.chunk_ranges(row, "length", 0, 64).count() == 0
    assert C.chunk_ranges(row, "length", 1024, 0, start=5000).count() == 0
    assert [r.chunk_id for r in C.chunks(row, 2048, 0, reverse=True).orderBy("chunk_seq").collect()] == [2, 1, 0]
    assert one(spark, C.aligned_chunk_size(F.lit(100)))[0] == 64
    for offset, size, error in ((0, 5000, None), (5000, 1, "InvalidOffset"), (4999, 2, "InvalidSize")):
        assert row.select(C.slice_of(F.col("content"), F.col("length"), F.lit(offset), F.lit(size)).alias("s")).first().s.error == error


@pytest.mark.parametrize(("text", "valid"), [('{"key": "value"}', True), ('["item1", "item2"]', True), ('  {"nested": {"data": true}}  ', True), ("not json", False), ("{", False), ("", False), ('[x] {"a":1}', True), ('{"a": NaN, "b": 1}', False), ('{"a": 1} x trailing', False)])
def test_json(spark, text, valid):
    assert one(spark, V.is_valid_json(F.col("t")), t=text)[0] is valid


def test_probably_json_counts_net_brackets(spark):
    assert one(spark, V.is_probably_json(F.col("t")), t='{"a": "}}}", "b')[0] is False
    assert one(spark, V.is_probably_json(F.col("t")), t='{"a": "}}}"}')[0] is True
    assert one(spark, V.is_probably_json(F.col("t")), t='{"a":  1}')[0] is False  # 9 bytes
    assert one(spark, V.is_probably_json(F.lit(None).cast("string")))[0] is False


@pytest.mark.parametrize(("text", "valid"), [("https://www.youtube.com/watch?v=dQw4w9WgXcQ", True), ("https://youtu.be/dQw4w9WgXcQ", True), ("https://www.youtube.com/embed/dQw4w9WgXcQ", True), ("https://example.com", False), ("not a url", False), ("", False)])
def test_links_valid(spark, text, valid):
    assert one(spark, V.is_valid_link(F.col("t")), t=text)[0] is valid


@pytest.mark.parametrize(("data", "low", "high"), [(b"", 0, 0), (b"a" * 20, 0, 0), (bytes(range(16)), 3.9, 4.1), (b"hello world this is a test", 3.39, 3.40), (bytes((i * 37 + 17) % 256 for i in range(200)), 7.64, 7.65), (bytes((i * 17 + 23) % 256 for i in range(100)), 6.64, 6.65)])
def test_entropy(spark, data, low, high):
    assert low <= one(spark, O.entropy("d"), d=data)[0] <= high


def test_vectors(spark):
    v = one(spark, O.byte_frequency("d"), d=bytes([0, 0, 1, 1]))[0]
    assert v[0] == v[1] == 0.5 and sum(v) == 1
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert one(spark, O.cosine(a, a), O.cosine(a, b), O.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == (1.0, 0.0, 0.0)
    s = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, O.jaccard(s("x", "y"), s("y", "z")), O.jaccard(s("x"), s("x")), O.jaccard(s(), s()))[:] == (1 / 3, 1.0, 0.0)


def test_search(spark):
    assert one(spark, O.find_first(F.col("d"), b"lo"), O.find_first(F.col("d"), b"zz"), O.find_first(F.col("d"), b""), d=b"hello")[:] == (3, None, None)
    assert one(spark, O.count_overlapping(F.col("d"), b"aa"), d=b"aaaa")[0] == 3
    long = b"." * 40 + b"a needle of twenty b" + b"." * 40
    assert one(spark, O.find_first(F.col("d"), b"a needle of twenty b"), d=long)[0] == 40
    assert one(spark, O.le_int(F.col("d"), 0, 2), O.le_int(F.col("d"), 0, 4), O.le_int(F.col("d"), 2, 4), d=b"\x01\x02\x03\x04")[:] == (0x0201, 0x04030201, None)
    f = one(spark, V.block_flags(F.col("d")), d=b"\x85" + b"y" + b"\0" * 30)[0]
    assert (f.is_empty, f.has_metadata, f.hot_positions, f.zero_count) == (False, True, [1], 30)


def test_csv_and_kinds(spark):
    csv = lambda t: one(spark, V.is_csv(F.col("t")), t=t)[0]
    assert csv("a,b\nc,d\n") and not csv("a,b") and not csv("ab\nc,d")
    lines = lambda n: "a,b,c,d,e\n" + "1,2,3\n" * n + "x\n" * (9 - n)
    assert csv(lines(5)) and not csv(lines(4))
    kind = lambda d: one(spark, V.file_type(F.col("d")), d=d)[0]
    assert [kind(b"{}"), kind(b"[1]"), kind(b"<a>"), kind(b"see http://x"), kind(b"abc"), kind(b"")] == ["json", "json", "html", "txt", "unknown", "unknown"]


def test_names_and_cleaning(spark):
    assert one(spark, V.sanitized(F.col("t")), t="Title: Secret/Plan?")[0] == "Title SecretPlan"
    assert one(spark, V.sanitized(F.col("t")), t="é" * 40)[0] == "é" * 23 + "..."
    assert one(spark, V.cleaned(F.col("t"), F.lit("txt")), t="a\x00b\x01c\n\td")[0] == "ab c\n\td"
    assert one(spark, V.cleaned(F.col("t"), F.lit("png")), t="a\x01")[0] == "a\x01"
    assert one(spark, V.media_group(F.col("t")), t="clip [dQw4w9WgXcQ].mp4")[0] == "dQw4w9WgXcQ"
    stems = {"clip.info.json": "clip", "clip.jpg": "clip", "clip.mp4": "clip", "clip.webp": "clip", "clip.fr.vtt": "clip.fr", "clip.ru.vtt": "clip", "clip.part.xyz": "clip.part", "clip": "clip", ".hidden": ".hidden"}
    for name, stem in stems.items():
        assert one(spark, V.media_group(F.col("t")), t=name)[0] == f"NOID_{stem}"
    assert V.safe_name(None) is None


def links_of(spark, *chunks, dedup=True):
    rows = [("p", i, i, o, bytearray(d)) for i, (o, d) in enumerate(chunks)]
    return L.extract(spark.createDataFrame(rows, "path string, chunk_id long, chunk_seq long, offset long, data binary"), dedup)


def test_link_extraction(spark):
    a = b"<title>Some &amp; title - YouTube</title> https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1 and https://youtu.be/dQw4w9WgXcQ"
    got = links_of(spark, (1000, a), (9000, b"x v=short https://youtu.be/toolongvideo1"), (5000, b"nothing here")).collect()
    assert [(r.video_id, r.pattern_name, r.title, r.offset) for r in got if r.chunk_id == 0] == [("dQw4w9WgXcQ", "standard", "Some & title", 1000 + a.index(b"https://www"))]
    assert [r.video_id for r in got if r.chunk_id == 1] == ["toolongvide"]  # the first 11 characters, as no end is asked for
    every = links_of(spark, (0, a), dedup=False).collect()
    assert len({(r.offset, r.pattern_name) for r in every}) == len(every) and {r.pattern_name for r in every} >= {"standard", "short"}


def test_best_links(spark):
    cols = "path string, video_id string, title string, confidence double, chunk_seq long, offset long, pattern_idx int"
    rows = [("p", "a", None, 1.0, 0, 5, 0), ("p", "a", "T", 0.5, 1, 9, 1), ("p", "b", None, 0.5, 0, 5, 0), ("p", "b", None, 0.9, 3, 1, 2), ("p", "b", None, 0.9, 2, 7, 2)]
    got = {r.video_id: (r.title, r.confidence, r.chunk_seq) for r in L.best_links(spark.createDataFrame(rows, cols), "path").collect()}
    assert got == {"a": ("T", 0.5, 1), "b": (None, 0.9, 2)}
    assert L.at_least(spark.createDataFrame(rows, cols), 0.9).count() == 3 and L.at_least(spark.createDataFrame(rows, cols), 0).count() == 5


def test_scores(spark):
    lit = F.lit
    assert one(spark, S.link_density(lit(1), lit(0)), S.link_density(lit(2), lit(1 << 20)))[:] == (0.0, 2.0)
    assert one(spark, S.target_score(lit(1), lit(0.0), lit(False), lit(1 << 20)))[0] == pytest.approx(0.2)
    assert one(spark, S.target_score(lit(0), lit(0.0), lit(True), lit(20 * 1024)))[0] == 30.0


def test_groups(spark):
    rows = [(1, 0, "t", ["a", "b"]), (2, 10, "t", ["b", "a"]), (3, 5, "t", ["b", "a", "c"]), (4, 1, "u", ["a", "b"]), (5, 2, "t", [])]
    nodes = spark.createDataFrame(rows, "id long, offset long, file_type string, links array<string>")
    edges = G.jaccard_pairs(nodes, "id", "links", 0.3, "file_type")
    got = {r.group_id: [m.id for m in r.members] for r in G.groups(nodes, edges).collect()}
    assert got == {1: [1, 3, 2], 4: [4], 5: [5]}
    with pytest.raises(ValueError):
        G.jaccard_pairs(nodes, "id", "links", 0.0)


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = G.components(chain, Scratch(spark, "t"))
    assert got.count() == 201 and got.agg(F.max("component")).first()[0] == 0


def test_components_of_hot_ids(spark):
    star = spark.range(1, 1500).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionAll(spark.range(2000, 3000).select(F.col("id").alias("a"), F.lit(5000).cast("long").alias("b")))
    got = G.components(star, Scratch(spark, "t")).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {(0, 1500), (2000, 1001)}


@pytest.mark.parametrize("written", [False, True])
@pytest.mark.parametrize("rows", [0, 100_000])
def test_components_by_stars_and_in_one_task(spark, rows, written):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(1500, 1990)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(7, 7), (900, 900), (None, 901)]
    pairs = [p if rng.random() < 0.5 else p[::-1] for p in pairs] + pairs[:30]
    low = {x: x for a, b in pairs if a != b and a is not None and b is not None for x in (a, b)}
    for _ in low:
        for a, b in pairs:
            if a in low and b in low:
                low[a] = low[b] = min(low[a], low[b])
    links = spark.createDataFrame(pairs, "a long, b long")
    scratch = Scratch(spark, "t")
    got = G.components(scratch.save(links) if written else links, scratch, rows=rows).collect()
    assert len(got) == len(low) and {r.id: r.component for r in got} == low


def test_a_written_table_leaves_no_shuffle_files(spark):
    dirs = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    there = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held, before = spark.conf.get(name, None), there()
    saved = Scratch(spark, "t").save(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count())
    for _ in range(40):  # they go in the background
        if not (left := there() - before):
            break
        time.sleep(0.25)
    assert not left and saved.count() == 1000 and spark.conf.get(name, None) == held


@pytest.mark.parametrize("rows", [0, 100_000])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_dealt_join(spark, how, rows):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 40).alias("k"), "id")
    small = spark.createDataFrame([(7, "a"), (8, "b"), (99, "c"), (None, "d")], "k long, v string")
    counts = big.groupBy("k").agg(F.count("*").alias("n"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(J.dealt_join(big, small, ["k"], counts, Scratch(spark, "t"), how, rows=rows)) == key(big.join(small, ["k"], how))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_join(spark, how):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 40).alias("k"), "id")
    small = spark.createDataFrame([(7, "a"), (8, "b"), (99, "c"), (None, "d")], "k long, v string")
    hot = J.hot_keys(big.groupBy("k").agg(F.count("*").alias("n")), ["k"], Scratch(spark, "t"), rows=100)
    assert {(r.k, r.parts) for r in hot.collect()} == {(7, 11), (None, 10)}
    assert [(r.k, r.parts) for r in J.hot_keys(big.groupBy("k").agg(F.count("*").alias("n")), ["k"], Scratch(spark, "t"), rows=10, limit=2).orderBy("k").collect()] == [(None, 33), (7, 34)]  # of two keys, no shorter parts fit
    key = lambda df: sorted(map(str, df.collect()))
    assert key(J.hot_join(big, small, ["k"], hot, how)) == key(big.join(small, ["k"], how))
    assert J.hot_keys(big.groupBy("k").agg(F.count("*").alias("n")), ["k"], Scratch(spark, "t"), rows=5000) is None


def test_pair_score(spark):
    lit = F.lit
    assert one(spark, G.pair_score(lit(1.0), lit(1 / 3), lit(1.0)))[0] == pytest.approx(0.55 + 0.25 / 3 + 0.2)
    match = G.metadata_match(lit("Clip.txt"), lit("clip.TXT"), lit(2), lit(3), lit(1), lit(2))
    none = G.metadata_match(lit(None).cast("string"), lit(None).cast("string"), lit(None).cast("long"), lit(3), lit(1), lit(2))
    assert one(spark, match, none)[:] == (1.0, 0.0)


def test_streams(spark):
    data = [(0, b"aaaaaaaa", "json"), (50, b"zzzzzzzz", "html"), (140, b"aaaaaaab", "json"), (190, b"zzzzzzzy", "html")]
    rows = spark.createDataFrame([(1, i, o, len(d), t, 50.0, True, [], bytearray(d)) for i, (o, d, t) in enumerate(data)], "image long, id long, offset long, size long, file_type string, score double, structured boolean, links array<string>, data binary")
    nodes = rows.withColumn("vector", O.byte_frequency("data")).drop("data")
    w = A.Weights(max_gap=200, max_overlap=20)
    got = A.assemble(nodes, w, 2).collect()
    assert {s: [r.id for r in got if r.stream == s] for s in (0, 1)} in ({0: [1, 3], 1: [0, 2]}, {0: [0, 2], 1: [1, 3]})
    assert {round(r.total_score, 4) for r in got} == {128.8487} and {round(r.confidence, 4) for r in got} == {64.4244}
    edges = {(r.a, r.b): round(r.score, 4) for r in A.edges(nodes, w).collect()}
    assert edges[0, 2] == 28.8487


def plain_streams(rows, w, most):
    """Edges and streams of one image's rows (id, offset, size, kind, score, structured, links, vector) by definition."""
    import itertools
    import math

    def score(a, b):
        gap, overlap = max(b[1] - a[1] - a[2], 0), max(a[1] + a[2] - b[1], 0)
        dot = sum(x * y for x, y in zip(a[7], b[7], strict=True))
        size = math.sqrt(sum(x * x for x in a[7])) * math.sqrt(sum(x * x for x in b[7]))
        union = len(set(a[6]) | set(b[6]))
        s = w.cosine_weight * (dot / size if size else 0) + w.jaccard_weight * (len(set(a[6]) & set(b[6])) / union if union else 0)
        s += (w.type_match_bonus if a[3] == b[3] else -w.type_mismatch_penalty) + w.structure_bonus * (a[5] and b[5])
        return gap, overlap, s - w.gap_penalty * gap / w.max_gap - w.overlap_penalty * overlap / w.max_overlap

    def edges_of(rows):
        out = {}
        for j, b in enumerate(rows):
            for a in itertools.takewhile(lambda a: b[1] - a[1] - a[2] <= w.max_gap, reversed(rows[max(0, j - w.max_lookback) : j])):  # noqa: B023
                gap, overlap, s = score(a, b)
                if overlap <= w.max_overlap and s >= w.min_edge_score:
                    out[a[0], b[0]] = s
        return out

    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    first, streams = edges_of(rows), []
    while rows and len(streams) < most:
        arcs, best = edges_of(rows), {}
        for i, r in enumerate(rows):  # every path's weight, by its last row
            best[r[0]] = max([(r[4], 1, [r[0]])] + [(best[a[0]][0] + arcs[a[0], r[0]] + r[4], 2 + k, [*best[a[0]][2], r[0]]) for k, a in enumerate(rows[:i]) if (a[0], r[0]) in arcs and best[a[0]][0] + arcs[a[0], r[0]] > 0], key=lambda x: x[:2])
        total, _, path = max(((*best[r[0]][:1], i, best[r[0]][2]) for i, r in enumerate(rows)), key=lambda x: x[:2])
        streams.append((total, path))
        rows = [r for r in rows if r[0] not in path]
    return first, streams


def test_streams_equal_a_plain_solution(spark):
    import random

    rng = random.Random(5)
    w = A.Weights(max_gap=100, max_overlap=40, max_lookback=4)
    images_, rows = {}, []
    for image in range(12):
        at, mine = 0, []
        for k in range(rng.randrange(1, 40)):
            at += rng.choice([0, 10, 60, 90, 130, 400])
            mine.append((k, at, rng.choice([5, 50, 120]), rng.choice("ab"), rng.choice([-30.0, 5.0, 20.0, rng.random()]), rng.random() < 0.5, rng.sample("wxyz", rng.randrange(3)), [rng.random() for _ in range(4)]))
        images_[image] = mine
        rows += [(image, *r) for r in mine]
    df = spark.createDataFrame(rows, "image long, id long, offset long, size long, file_type string, score double, structured boolean, links array<string>, vector array<double>").repartition(3)
    found, got = {}, {}
    for r in A.edges(df, w).collect():
        found.setdefault(r.image, {})[r.a, r.b] = r.score
    for r in sorted(A.assemble(df, w, 3).collect(), key=lambda r: (r.stream, r.position)):
        got.setdefault((r.image, r.stream), (r.total_score, []))[1].append(r.id)
    for image, mine in images_.items():
        arcs, streams = plain_streams(mine, w, 3)
        assert found.get(image, {}) == pytest.approx(arcs)
        assert [got[image, k][1] for k in range(len(streams))] == [p for _, p in streams] and (image, len(streams)) not in got
        assert [got[image, k][0] for k in range(len(streams))] == pytest.approx([t for t, _ in streams])


def test_affinity_by_words_links_and_distance(spark):
    import math

    mb = 1 << 20
    rows = [(0, 0, ["aaaa", "bbbb"], ["x"], [1.0, 0.0]), (1, mb, ["aaaa", "bbbb"], ["x"], [0.0, 1.0]), (2, 2 * mb, None, ["x"], [1.0, 0.0]), (3, 30 * mb, ["aaaa", "bbbb"], [], [1.0, 0.0]), (4, 2 * mb, ["cccc"], ["x"], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, offset long, words array<string>, links array<string>, vector array<double>")
    got = {(r.a, r.b): r.affinity for r in G.affinity_pairs(df).collect()}
    e = lambda d: math.exp(-d / 10)
    assert got == pytest.approx({(0, 1): e(1), (0, 2): e(2), (1, 2): e(1), (2, 4): 1.0, (0, 4): e(2), (1, 4): e(1)})


def test_exfat(spark):
    boot = X.boot_sectors(Q._volume(spark)).first().boot
    assert (boot.sector_size, boot.cluster_size, boot.fat_offset, boot.cluster_heap_offset, boot.cluster_count, boot.root_dir_cluster) == (512, 512, 512, 1024, 12, 2)
    assert X.parse_entry_set(b"\x85" * 31) is None
    bad = bytearray(Q.exfat_image()[1024:1120])
    bad[1] = 1
    assert X.parse_entry_set(bytes(bad)) is None
    wrong = spark.createDataFrame([("w", 512, bytearray(512))], "path string, length long, content binary")
    assert X.boot_sectors(wrong).first().boot is None
    images_, boots, entries = Q._volume_entries(spark)
    files = {r.name: r for r in X.extract_files(images_, entries, boots).collect()}
    assert bytes(files["chain.txt"].data) == bytes([67]) * 512 + bytes([68]) * 512 + bytes([70]) * 176
    assert bytes(files["flat file with a long name.bin"].data) == bytes([71]) * 512 + bytes([72]) * 188
    assert bytes(files["gone.txt"].data) == bytes([73]) * 512 + bytes([74]) * 512 and files["gone.txt"].is_deleted  # the chain runs in a circle
    assert "recovered_0x540.bin" in files


def test_exfat_boot_behind_the_start(spark):
    """A sector number of 0 is wrong only where the boot sector lies at offset 0."""
    raw = bytearray(Q.exfat_image())
    raw[80:84] = bytes(4)
    rows = [("a", len(raw), raw), ("b", 512 + len(raw), bytearray(512) + raw)]
    got = {r.path: r.boot for r in X.boot_sectors(spark.createDataFrame(rows, "path string, length long, content binary")).collect()}
    assert got["a"] is None and got["b"].fat_offset == 512 and got["b"].boot_sector_offset == 512


def entry_bytes(name_slots, length, cluster=3, size=10):
    head = bytes([0x85, 1 + len(name_slots)]).ljust(32, b"\0")
    ext = bytearray(32)
    ext[0], ext[3], ext[20], ext[24] = 0xC0, length, cluster, size
    return head + bytes(ext) + b"".join(name_slots)


def test_exfat_names():
    slot = lambda text, kind=0xC1: bytes([kind, 0]) + text.encode("utf-16-le", "surrogatepass")[:30].ljust(30, b"\0")
    name = lambda *slots, n=40: X.parse_entry_set(entry_bytes(slots, n))[0]["filename"]
    assert name(slot("a" * 15), slot("bc")) == "a" * 15 + "bc"
    assert name(slot("ab"), slot("cd")) == "abcd"  # a NUL ends its own slot only
    assert name(slot("ab"), slot("cd", 0xC0), slot("ef")) == "ab"  # a foreign slot ends the name
    assert name(slot("a\ud800b" + "c" * 12), n=3) == "abc"  # half of a pair does not count
    assert name(slot("abcdef"), n=3) == "abc"


def test_exfat_extracts_and_errors(spark):
    got = {r.asked: (r["size"], r.error) for r in Q.exfat_extract(spark, "").collect()}
    assert got == {"cluster 3": (1200, None), "cluster 7": (700, None), "cluster 1": (0, None), "entry 1024": (1200, None), "entry 1056": (None, "No valid exFAT entry set at offset 0x420"), "entry 1048576": (None, "Entry offset 0x100000 is beyond image size")}
    none = spark.createDataFrame([("w", 4096, bytearray(4096))], "path string, length long, content binary")
    assert X.extract_file(none, 3, 10, True).first().error == X.NO_BOOT == X.extract_entry(none, 0).first().error


def plain_walk(data, base):
    """The same walk a block at a time."""
    pos, cold, seen, out = 0, 0, set(), []
    while pos + 32 <= len(data):
        block = data[pos : pos + 32]
        if any(block):
            found = X.parse_entry_set(data, pos)
            if found:
                out.append(("entry", base + pos))
                pos += 32 * found[1]
                continue
            if set(block) & set(b"yh{v/") and pos >= cold:
                end = min(pos + 4096, len(data))
                out += [("link", x[3]) for x in L.matcher().scan(data[pos:end], base + pos, True, seen)]
                cold = max(end - 128, 0)
        pos += 32
    return out


def test_combined_scan_equals_a_plain_walk(spark):
    import random

    rng = random.Random(3)
    for _ in range(20):
        data = bytearray(rng.randrange(20_000))
        for _ in range(12):
            at = rng.randrange(len(data) + 1) // 32 * 32
            data[at:at] = rng.choice([entry_bytes([bytes([0xC1, 0]) + b"a\0" * 15], 15), b"see https://youtu.be/dQw4w9WgX%02d " % rng.randrange(99) + b"h" * 40, bytes(320), b"yyyy" * 100])
        assert [(r[0], r[1]) for r in X.combined(bytes(data), 7)] == plain_walk(bytes(data), 7)
    got = Q.exfat_combined(spark, "").collect()
    assert [(r.kind, r.name) for r in got if r.kind == "link"] == [("link", "dQw4w9WgXcQ")] and sum(r.kind == "entry" for r in got) == 4


def test_large_image(spark, tmp_path):
    """A sparse file of over 2 GiB: carving, entries and files come from byte ranges."""
    far = (2 << 30) + (5 << 20)
    path = str(tmp_path / "disk.img")
    volume = bytearray(Q.exfat_image())
    with open(path, "wb") as f:
        f.write(volume)
        f.seek(far)
        f.write(Q.golden_image())
    image = images.large_image(spark, f"file://{path}")
    links, found, files = N.carve(image, N.Options(chunk_kb=1024))
    assert [r.video_id for r in links.collect()] == ["dQw4w9WgXcQ"] and links.first().offset >= far
    assert (files.first().start_offset, files.first().sha256) == (far, "aa9f3519e0f5cfe505c0ee678b5898a027d224e8cc13b4ccf369f429004f943b")
    entries, _ = X.scan_range(spark, f"file://{path}", limit=8192)
    small = Q._volume(spark)
    boots = X.boot_sectors(image)
    parts = X.extract_files(image, X.entry_sets(C.chunks(image, 8192, X.OVERLAP).where("offset < 8192")), boots)
    want = {r.name: bytes(r.data) for r in X.extract_files(small, X.entry_sets(C.chunks(small, 8192, X.OVERLAP)), X.boot_sectors(small)).collect()}
    assert {r.name: bytes(r.data) for r in parts.collect()} == want and [r.filename for r in entries.collect()] == [r.filename for r in X.entry_sets(C.chunks(small, 8192, X.OVERLAP)).orderBy("offset").collect()]


def test_golden(spark, tmp_path):
    links, found, files = N.carve(Q.golden(spark))
    assert [(r.video_id, r.pattern_name) for r in links.collect()] == [("dQw4w9WgXcQ", "standard")]
    f = found.first()
    assert (f.offset, f.size, f.n_links, f.file_type) == (0, 1 << 20, 1, "txt")
    assert f.score == pytest.approx(20.12)
    r = files.first()
    assert (r.filename, r.sha256, r.size_kb) == ("recovered_0001_Title Secret Plan.txt", "aa9f3519e0f5cfe505c0ee678b5898a027d224e8cc13b4ccf369f429004f943b", 39)
    as_json, as_html = N.run(spark, Q.golden(spark), str(tmp_path))
    report = json.load(open(as_json))
    assert report["success"] and report["recovered_files"][0]["sha256"] == r.sha256 and "Secret Plan" in open(as_html).read()
    assert len(glob.glob(f"{tmp_path}/01_RECOVERED_FILES/*")) == 1 and os.path.exists(f"{tmp_path}/session.info")


def test_report(spark):
    check = lambda ts, rate, n: one(spark, T.checksum(F.lit(ts), F.lit(rate), F.lit(n)))[0]
    assert check("2026-02-10 14:14:59", 100.0, 1).startswith("24e4e88e") and check("2026-02-10 14:11:42", 0.0, 0).startswith("30b33eb8")
    row = spark.range(1).select(*T.scan_results(F.lit(1 << 20), F.lit(1 << 19), F.lit(1 << 19), F.lit(0), F.lit(10.0))).first()
    assert row.avg_speed_mbps == 0.05
    empty = T.recovery_stats(spark.createDataFrame([], "size_kb long, validation_status string"), 3).first()
    assert (empty.total_processed, empty.success_rate, empty.candidates_rejected) == (0, 0.0, 3)


def test_small_helpers(spark):
    got = one(spark, T.completion(F.lit(1), F.lit(4)), T.completion(F.lit(1), F.lit(0)), T.hex_offset(F.lit(255)), T.duration(F.lit(3725)), T.kilobytes(F.lit(2)), T.megabytes(F.lit(1 << 20)))
    assert got[:] == (25.0, 0.0, "0xFF", "01:02:05", 2048, 1.0)
    assert images.memory_mb("Node 0 MemFree: 1 kB\nNode 0 MemTotal:       32768 kB\n") == 32 and images.memory_mb("x") is None
    raw = spark.createDataFrame([("a", 600, bytearray(range(200)) * 3)], "path string, length long, content binary")
    assert len(images.first_bytes(raw).first().head) == 512
    eta = T.throughput(spark.createDataFrame([("k", i, 10.0, 2.0, 100.0 - 10 * i) for i in range(300)], "k string, t long, mb double, s double, left double"), "k", "t", "mb", "s", "left").where("t = 4").first()
    assert (eta.current, round(eta.average, 9), round(eta.eta, 9)) == (5.0, 5.0, 12.0)


def test_throughput_is_a_plain_fold(spark):
    import random

    rng = random.Random(2)
    values = [rng.random() * 10 ** rng.randrange(9) for _ in range(700)]
    got = [r.average for r in T.throughput(spark.createDataFrame([("k", i, v, 1.0) for i, v in enumerate(values)], "k string, t long, mb double, s double"), "k", "t", "mb", "s").orderBy("t").collect()]
    want = [values[0]]
    for v in values[1:]:
        want.append(want[-1] * 0.9 + v * 0.1)
    assert got == pytest.approx(want, rel=1e-12)


def test_media_categories(spark, tmp_path):
    classify = lambda t: F.struct(F.substring(t, 1, 1).alias("category"), F.when(t.contains("?"), 0.2).otherwise(0.9).alias("confidence"))
    rows = [("a.info.json", '{"title": "News", "description": "d"}'), ("a.mp4", None), ("b.info.json", '{"title": "Who?"}'), ("b.en.vtt", "?"), ("b.vtt", "Sport"), ("c.mp4", "x"), ("d.info.json", "broken")]
    files = spark.createDataFrame(rows, "name string, text string")
    got = {r.name: r.category for r in M.categorised(files, classify).collect()}
    assert got == {"a.info.json": "N", "a.mp4": "N", "b.info.json": "S", "b.en.vtt": "S", "b.vtt": "S", "c.mp4": "Unknown", "d.info.json": " "}
    M.sort_into(M.categorised(files, classify), str(tmp_path / "out"))
    assert (tmp_path / "out" / "category=N").is_dir()


def test_options():
    assert N.Options().check() is None
    assert N.Options(chunk_kb=0).check() and N.Options(chunk_min_kb=4096).check() and N.Options(profile="x").check()
    assert images.cpu_list("0-3,8-11") == [0, 1, 2, 3, 8, 9, 10, 11]


def test_sources(spark, tmp_path):
    raw = bytes(range(256)) * 40
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "disk [dQw4w9WgXcQ].mp4").write_bytes(raw)
    assert bytes(images.image(spark, str(tmp_path / "in")).first().content) == raw
    assert images.listing(spark, str(tmp_path / "in")).first().media_group == "dQw4w9WgXcQ"
    rows = images.byte_ranges(spark, str(tmp_path / "in" / "disk [dQw4w9WgXcQ].mp4"), chunk=4096, overlap=32).orderBy("offset").collect()
    assert [(r.offset, r.size) for r in rows] == [(0, 4128), (4096, 4128), (8192, 2048)] and bytes(rows[1].data) == raw[4096:8224]
    (tmp_path / "links.json").write_text('{"links": ["a", "b", "c"]}')
    assert [r.link for r in images.link_list(spark, str(tmp_path / "links.json"), 2).collect()] == ["a", "b"]


def test_resume(spark, tmp_path):
    path = str(tmp_path / "cp.json")
    for position in (5, 9):
        R.save_checkpoint(spark, path, "disk", "h", position, {"k": 1}, backup=True)
    assert R.load_checkpoint(spark, path).first().position == 9 and R.load_checkpoint(spark, f"{path}.bak").first().position == 5
    v = lambda p, h, n: one(spark, R.resume_verdict(F.lit("a"), F.lit(p), F.lit("h"), F.lit(h), F.lit(n), F.lit(10)))[0]
    assert [v("b", "h", 1), v("a", "x", 1), v("a", "h", 11), v("a", "h", 10)] == ["path", "hash", "position", None]


def test_stream_links(spark, tmp_path):
    schema = "path string, chunk_id long, chunk_seq long, offset long, data binary"
    where = [str(tmp_path / x) for x in ("chunks", "out", "state")]
    told, hot = [], []
    for i in range(2):
        text = b"see https://youtu.be/dQw4w9WgXc%d " % i + "Привет, как дела ".encode() * 1000
        rows = [("p", i, i, i * 100, bytearray(text))] + [("q", i, i, 0, bytearray(6 << 20))]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(where[0])
        got = R.stream_links(spark, where[0], schema, where[1], where[2], told.append, hot.append)
        assert got["links"].count() == i + 1 and got["bytes_scanned"] == (6 << 20) + len(text)
    assert [x["bytes_scanned"] > R.PROGRESS for x in told] == [True, True]
    assert [(x["path"], x["confidence"] == x["score"] / 10) for x in hot] == [("p", True)] * 2
    # a batch that is run again replaces its rows
    import shutil

    shutil.rmtree(where[2])
    R.stream_links(spark, where[0], schema, where[1], where[2])
    assert spark.read.parquet(f"{where[1]}/links").where("epoch = 0").count() == 2
    assert spark.read.parquet(f"{where[1]}/progress").where("epoch = 0").count() == 2


def test_a_bad_chunk_gives_an_error_row(spark, monkeypatch):
    rows = [("p", i, i, 0, d) for i, d in enumerate([bytearray(b"https://youtu.be/dQw4w9WgXcQ"), bytearray(b"boom v=")])]

    def scan(self, data, base, dedup, seen=None, plain=L.Matcher.scan):
        if b"boom" in data:
            raise ValueError("bad")
        return plain(self, data, base, dedup, seen)

    monkeypatch.setattr(L.Matcher, "scan", scan)
    batch = pa.RecordBatch.from_pylist([dict(zip(("path", "chunk_id", "chunk_seq", "offset", "data"), (*r[:4], bytes(r[4])), strict=True)) for r in rows])
    got = [x for out in L._scan(True)([batch]) for x in out.to_pylist()]
    assert [(r["chunk_id"], r["video_id"], r["error"]) for r in got] == [(0, "dQw4w9WgXcQ", None), (1, None, "ValueError: bad")]


def test_sink_writes_in_place(spark, tmp_path):
    sinks.write_text(spark, str(tmp_path / "a.txt"), "é")
    assert (tmp_path / "a.txt").read_text() == "é" and not (tmp_path / "a.txt.tmp").exists()
