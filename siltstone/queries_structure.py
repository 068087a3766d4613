"""Queries: similarity graphs, streams, exFAT, recovery, reports, resume."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import planted as D
from siltstone import queries_scan as Q
from siltstone.functions import octets as O
from siltstone.functions import predicates as V
from siltstone.functions.scratch import Scratch
from siltstone.operators import chunks as C
from siltstone.operators import exfat as X
from siltstone.operators import graph as G
from siltstone.operators import media as M
from siltstone.operators import report as T
from siltstone.operators import similar as SIM
from siltstone.operators import streams as A
from siltstone.plans import scan as N
from siltstone.streaming import resume as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---------------------------------------------------------------- similarity graphs

#: Each document holds its own link and those of two other groups of three; types repeat every four documents.
_SETS = """s AS (SELECT doc_id AS id, list_distinct([substr(md5(cast(doc_id - doc_id % 3 AS STRING)), 1, 11), substr(md5(cast(doc_id - doc_id % 5 AS STRING)), 1, 11), substr(md5(cast(doc_id - doc_id % 7 AS STRING)), 1, 11)]) AS links, doc_id % 4 AS file_type FROM documents)"""
_EDGES = f"""{_SETS}, x AS (SELECT id, file_type, len(links) AS n, unnest(links) AS link FROM s),
g AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.link = b.link AND a.file_type = b.file_type AND a.id < b.id GROUP BY a.id, b.id),
e AS (SELECT a, b, k / (na + nb - k) AS jaccard FROM g WHERE k / (na + nb - k) >= 0.3)"""


def _link_sets(spark, sf_dir):
    part = lambda n: F.expr(f"substr(md5(cast(doc_id - doc_id % {n} AS STRING)), 1, 11)")
    return D.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("offset"), F.array_distinct(F.array(part(3), part(5), part(7))).alias("links"), (F.col("doc_id") % 4).alias("file_type"))


@query(f"WITH {_EDGES} SELECT a, b, round(jaccard, 6) AS jaccard FROM e")
def linker_edges(spark, sf_dir):
    return G.jaccard_pairs(_link_sets(spark, sf_dir), "id", "links", 0.3, "file_type").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def _components_sql(prefix: str, nodes: str) -> str:
    """Smallest reachable id by a recursive CTE over edges e (a, b)."""
    return f"""WITH RECURSIVE {prefix}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS low FROM u UNION SELECT u.b, r.low FROM r JOIN u ON u.a = r.id WHERE r.low < u.b)
    SELECT n.id, coalesce(min(r.low), n.id) AS group_id FROM {nodes} n LEFT JOIN r ON r.id = n.id GROUP BY n.id"""


@query(_components_sql(_EDGES, "s"))
def linker_groups(spark, sf_dir):
    sets = _link_sets(spark, sf_dir)
    edges = G.jaccard_pairs(sets, "id", "links", 0.3, "file_type")
    return G.groups(sets, edges).select("group_id", F.explode("members").alias("m")).select(F.col("m.id").alias("id"), "group_id")


#: The decay that puts affinity out of reach beyond 16 KiB, so that the band prunes at every table size.
DECAY = 100 * 2.302585092994046 / (16 / 1024)
_BYTES = D.E_SQL[: D.E_SQL.index(",\ne AS")]
_AFFINITY = f"""{D.F_SQL}, {_BYTES}, n AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, exp(-{DECAY} * abs(x."offset" - y."offset") / 1048576.0 / 100.0) AS factor, x.vid = y.vid AS linked FROM f x JOIN f y ON x.doc_id < y.doc_id AND abs(x."offset" - y."offset") <= 16384),
d AS (SELECT pair.a, pair.b, sum(p1.n * p2.n) AS dot FROM pair JOIN c p1 ON p1.doc_id = pair.a JOIN c p2 ON p2.doc_id = pair.b AND p1.byte = p2.byte GROUP BY 1, 2),
e AS (SELECT a, b, affinity FROM (SELECT pair.a, pair.b, CASE WHEN linked THEN greatest(1.0, dot / (n1.norm * n2.norm)) ELSE dot / (n1.norm * n2.norm) END * factor AS affinity FROM pair JOIN d ON d.a = pair.a AND d.b = pair.b JOIN n n1 ON n1.doc_id = pair.a JOIN n n2 ON n2.doc_id = pair.b WHERE factor >= 0.1) WHERE affinity >= 0.5)"""


def _affinity(spark, sf_dir):
    f = D.fragments(spark, sf_dir).select(F.col("doc_id").alias("id"), "offset", F.lit(None).cast("array<string>").alias("words"), F.array("vid").alias("links"), O.byte_frequency("data").alias("vector"))
    f = Scratch(spark, "affinity").save(f)
    return f, G.affinity_pairs(f, 0.5, DECAY)


@query(f"WITH {_AFFINITY} SELECT a, b, round(affinity, 6) AS affinity FROM e")
def cluster_edges(spark, sf_dir):
    return _affinity(spark, sf_dir)[1].select("a", "b", F.round("affinity", 6).alias("affinity"))


@query(_components_sql(_AFFINITY.replace("n AS (SELECT doc_id, sqrt", "nn AS (SELECT doc_id, sqrt").replace("JOIN n n1", "JOIN nn n1").replace("JOIN n n2", "JOIN nn n2"), "(SELECT doc_id AS id FROM documents)"))
def cluster_groups(spark, sf_dir):
    f, edges = _affinity(spark, sf_dir)
    return G.groups(f, edges).select("group_id", F.explode("members").alias("m")).select(F.col("m.id").alias("id"), "group_id")


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: regexp_full_match(w, '[a-z]{4,}')))"


@query(
    f"""WITH s AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE len(regexp_extract_all(text, '[\\x20-\\x7E]')) >= octet_length(encode(text)) // 2), x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM s),
    g AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.word = b.word AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id)
    SELECT a, b, round(k / (na + nb - k), 6) AS jaccard FROM g WHERE k / (na + nb - k) >= 0.7"""
)
def word_jaccard_pairs(spark, sf_dir):
    d = D.documents(spark, sf_dir).select("doc_id", V.word_set(F.col("text"), F.encode("text", "UTF-8")).alias("words"))
    return G.jaccard_pairs(d, "doc_id", "words", 0.7).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.v, y.v), 5) AS cosine FROM e x JOIN e y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.4"""
)
def embedding_cosine_pairs(spark, sf_dir):
    """All pairs of embeddings of a cosine of 0.4 or more."""
    pairs, _ = SIM.cosine_pairs(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 0.4)
    return pairs.select("a", "b", F.round("cosine", 5).alias("cosine"))


@query(
    f"""WITH {D.P_SQL}, {D.E_SQL}, v AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id), d AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.n * y.n) AS dot FROM c x JOIN c y ON y.doc_id = x.doc_id + 1 AND x.byte = y.byte GROUP BY 1, 2),
    q AS (SELECT a, b, dot / (u.norm * w.norm) AS cosine, CASE WHEN a.vid = b.vid THEN 1.0 ELSE 0.0 END AS jaccard, CASE WHEN a.source = b.source OR a.doc_id // 4 = b.doc_id // 4 OR length(a.text) = length(b.text) THEN 1.0 ELSE 0.0 END AS metadata
      FROM (SELECT d.a AS i, d.b AS j, dot FROM d) d JOIN v u ON u.doc_id = i JOIN v w ON w.doc_id = j JOIN p a ON a.doc_id = i JOIN p b ON b.doc_id = j)
    SELECT a.doc_id AS a, b.doc_id AS b, metadata::DOUBLE AS metadata, round(CASE WHEN cosine >= 0.92 THEN cosine * 0.55 ELSE 0 END + CASE WHEN jaccard >= 0.3 THEN jaccard * 0.25 ELSE 0 END + CASE WHEN metadata >= 1 THEN metadata * 0.20 ELSE 0 END, 6)::DOUBLE AS score FROM q"""
)
def pair_scores(spark, sf_dir):
    d = D.bodies(spark, sf_dir).select("doc_id", F.upper("source").alias("name"), F.floor(F.col("doc_id") / 4).alias("cluster"), F.length("text").alias("size"), F.array("vid").alias("links"), O.byte_frequency("data").alias("v"))
    x, y = (d.select(F.col("doc_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("name", "cluster", "size", "links", "v"))) for s in "ab")
    p = x.join(y, F.col("b") == F.col("a") + 1)
    meta = G.metadata_match(F.col("name_a"), F.lower("name_b"), F.col("cluster_a"), F.col("cluster_b"), F.col("size_a"), F.col("size_b"))
    score = G.pair_score(O.cosine(F.col("v_a"), F.col("v_b")), O.jaccard(F.col("links_a"), F.col("links_b")), meta)
    return p.select("a", "b", meta.alias("metadata"), F.round(score, 6).alias("score"))


# ---------------------------------------------------------------- streams

_W = A.Weights(max_gap=8192, max_overlap=4096, max_lookback=6)


def _nodes(spark, sf_dir):
    """The bodies as fragments of one image per 500 ids."""
    f = D.fragments(spark, sf_dir)
    e = O.entropy("data")
    return f.select(
        F.floor(F.col("doc_id") / 500).alias("image"), F.col("doc_id").alias("id"), "offset", "size", F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("file_type"), (F.col("doc_id") % 50 + 0.5).alias("score"),
        V.is_structured(e).alias("structured"), F.array("vid").alias("links"), O.byte_frequency("data").alias("vector"),
    )


@query(
    f"""WITH {D.F_SQL}, {D.E_SQL}, v AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id),
    z AS (SELECT f.doc_id // 500 AS image, f.doc_id AS id, "offset", size, f.doc_id % 3 AS t, entropy BETWEEN 3 AND 6 AS ok, vid, row_number() OVER (PARTITION BY f.doc_id // 500 ORDER BY "offset", f.doc_id) AS rn FROM f JOIN e ON e.doc_id = f.doc_id),
    q AS (SELECT x.image, x.id AS a, y.id AS b, x.rn AS rn, greatest(y."offset" - x."offset" - x.size, 0) AS gap, greatest(x."offset" + x.size - y."offset", 0) AS overlap, x.t = y.t AS same, x.ok AND y.ok AS ok, x.vid = y.vid AS linked FROM z x JOIN z y ON x.image = y.image AND x.rn < y.rn AND y.rn - x.rn <= 6),
    k AS (SELECT *, coalesce(max(CASE WHEN gap > 8192 THEN rn END) OVER (PARTITION BY b), 0) AS stop FROM q),
    d AS (SELECT k.a, k.b, sum(p1.n * p2.n) AS dot FROM k JOIN c p1 ON p1.doc_id = k.a JOIN c p2 ON p2.doc_id = k.b AND p1.byte = p2.byte WHERE rn > stop GROUP BY 1, 2),
    w AS (SELECT k.image, k.a, k.b, gap, overlap, -15.0 * gap / 8192 - 20.0 * overlap / 4096 + CASE WHEN same THEN 8 ELSE -5 END + 25.0 * dot / (n1.norm * n2.norm) + CASE WHEN linked THEN 10 ELSE 0 END + CASE WHEN ok THEN 6 ELSE 0 END AS score
      FROM k JOIN d ON d.a = k.a AND d.b = k.b JOIN v n1 ON n1.doc_id = k.a JOIN v n2 ON n2.doc_id = k.b WHERE rn > stop AND overlap <= 4096)
    SELECT image, a, b, gap::BIGINT AS gap, overlap::BIGINT AS overlap, round(score, 5)::DOUBLE AS score FROM w WHERE score >= 5"""
)
def stream_edges(spark, sf_dir):
    nodes = Scratch(spark, "nodes").save(_nodes(spark, sf_dir))
    return A.edges(nodes, _W).select("image", "a", "b", "gap", "overlap", F.round("score", 5).alias("score"))


@query()
def stream_paths(spark, sf_dir):
    return A.assemble(_nodes(spark, sf_dir), _W, 3)


# the rows of stream_edges at other weights: rows back, largest gap and overlap
@query(ORACLES["stream_edges"].replace("y.rn - x.rn <= 6", "y.rn - x.rn <= 200").replace("8192", "1048576").replace("4096", "65536"))
def stream_edges_full(spark, sf_dir):
    """The edges at the default weights: 200 rows back, gaps of 1 MiB."""
    nodes = Scratch(spark, "nodes").save(_nodes(spark, sf_dir))
    return A.edges(nodes).select("image", "a", "b", "gap", "overlap", F.round("score", 5).alias("score"))


@query()
def stream_paths_full(spark, sf_dir):
    return A.assemble(_nodes(spark, sf_dir))


@query()
def cluster_edges_full(spark, sf_dir):
    """The affinities at the default decay and threshold, by words where both fragments have some."""
    words = V.word_set(F.col("text"), F.encode("text", "UTF-8"))
    f = D.fragments(spark, sf_dir).select(F.col("doc_id").alias("id"), "offset", words.alias("words"), F.array("vid").alias("links"), O.byte_frequency("data").alias("vector"))
    return G.affinity_pairs(Scratch(spark, "affinity").save(f)).select("a", "b", F.round("affinity", 6).alias("affinity"))


# ---------------------------------------------------------------- exFAT


def exfat_image() -> bytes:
    """A small volume: boot sector, table, and a directory of a chained, a contiguous and a deleted file."""
    image = bytearray(16 * 512)
    image[3:11] = X.MAGIC.encode()
    image[108], image[109] = 9, 0
    for at, v in ((80, 1), (84, 1), (88, 2), (92, 12), (96, 2)):
        struct.pack_into("<I", image, at, v)
    for c, v in ((3, 4), (4, 6), (6, 0xFFFFFFFF), (9, 10), (10, 9)):
        struct.pack_into("<I", image, 512 + 4 * c, v)

    def entry(name: str, cluster: int, size: int, flags: int = 0, deleted: bool = False) -> bytes:
        units = name.encode("utf-16-le")
        names = [units[i : i + 30] for i in range(0, len(units), 30)] or [b""]
        head = bytes([0x05 if deleted else 0x85, 1 + len(names)]).ljust(32, b"\0")
        ext = bytearray(32)
        ext[0], ext[1], ext[3] = 0x40 if deleted else 0xC0, flags, len(name)
        struct.pack_into("<I", ext, 20, cluster)
        struct.pack_into("<Q", ext, 24, size)
        return head + bytes(ext) + b"".join(bytes([0x41 if deleted else 0xC1, 0]) + n.ljust(30, b"\0") for n in names)

    place = lambda c: 1024 + (c - 2) * 512
    root = entry("chain.txt", 3, 1200) + entry("flat file with a long name.bin", 7, 700, flags=2) + entry("gone.txt", 9, 2000, deleted=True) + entry("", 12, 100, flags=2)
    image[place(2) : place(2) + len(root)] = root
    for c in (3, 4, 6, 7, 8, 9, 10, 12):
        image[place(c) : place(c) + 512] = bytes([64 + c]) * 512
    return bytes(image)


def _volume(spark):
    raw = exfat_image()
    return spark.createDataFrame([("volume", len(raw), bytearray(raw))], "path string, length long, content binary")


def _volume_entries(spark):
    images = _volume(spark)
    boots = X.boot_sectors(images)
    parts = C.chunks(images, 1024, X.OVERLAP)
    return images, boots, X.entry_sets(parts)


def _int(at: str, n: int) -> str:
    """DuckDB: little-endian integer of n bytes of the hexadecimal string x, from byte `at` on."""
    return "try_cast('0x' || " + " || ".join(f"substr(x, (2 * ({at} + {i}) + 1)::INT, 2)" for i in reversed(range(n))) + " AS BIGINT)"


#: DuckDB: the volume's bytes (i), boot parameters (b), directory entries (e), table (t), chains (h), from the hexadecimal string.
_EXFAT = f"""WITH RECURSIVE i AS (SELECT '{exfat_image().hex().upper()}' AS x),
b AS (SELECT x, 2 ** {_int("108", 1)} AS sector, 2 ** {_int("109", 1)} * 2 ** {_int("108", 1)} AS cluster, {_int("80", 4)} AS fat, {_int("84", 4)} AS fat_length, {_int("88", 4)} AS heap, {_int("92", 4)} AS clusters, {_int("96", 4)} AS root FROM i WHERE substr(x, 7, 16) = '4558464154202020'),
s AS (SELECT x, 32 * k AS o, {_int("32 * k", 1)} AS kind, {_int("32 * k + 1", 1)} AS more, {_int("32 * k + 32", 1)} AS ext FROM i, (SELECT unnest(range(255)) AS k)),
e AS (SELECT o, 1 + more AS consumed, kind = 5 AS is_deleted, {_int("o + 35", 1)} AS letters, {_int("o + 52", 4)} AS first_cluster, {_int("o + 56", 7)} AS size, {_int("o + 33", 1)} & 2 = 2 AS no_fat_chain,
  coalesce(list_aggregate(list_slice(list_filter(list_transform(range(15 * (more - 1)), lambda u: {_int("o + 64 + 32 * (u // 15) + 2 + 2 * (u % 15)", 2)}), lambda u: u > 0), 1, {_int("o + 35", 1)}), 'string_agg', ','), '') AS units FROM s WHERE kind IN (133, 5) AND more >= 2 AND ext IN (192, 64)),
f AS (SELECT e.*, CASE WHEN units = '' THEN '' ELSE array_to_string(list_transform(string_split(units, ','), lambda u: chr(u::INT)), '') END AS filename, ceil(size / 512)::BIGINT AS n FROM e WHERE first_cluster >= 2 OR size = 0),
t AS (SELECT c, {_int("512 + 4 * c", 4)} AS next FROM i, (SELECT unnest(range(2, 14)) AS c)),
h AS (SELECT o, n, 0 AS position, first_cluster AS c, [first_cluster] AS seen FROM f WHERE n > 0
  UNION ALL SELECT h.o, h.n, position + 1, z, list_append(seen, z) FROM (SELECT h.*, CASE WHEN f.no_fat_chain THEN h.c + 1 ELSE t.next END AS z FROM h JOIN f ON f.o = h.o JOIN t ON t.c = h.c) h WHERE position + 1 < n AND z BETWEEN 2 AND 13 AND NOT list_contains(seen, z))"""


@query(f"{_EXFAT} SELECT 'volume' AS path, sector::BIGINT AS sector_size, cluster::BIGINT AS cluster_size, (fat * sector)::BIGINT AS fat_offset, fat_length AS fat_length_sectors, (heap * sector)::BIGINT AS cluster_heap_offset, clusters AS cluster_count, root AS root_dir_cluster, 0::BIGINT AS boot_sector_offset FROM b")
def exfat_boot(spark, sf_dir):
    return X.boot_sectors(_volume(spark)).select("path", "boot.*")


@query(f"{_EXFAT} SELECT 'volume' AS path, o::BIGINT AS \"offset\", consumed::INT AS consumed, is_deleted, filename, size, first_cluster, no_fat_chain, (heap * sector + (first_cluster - 2) * cluster)::BIGINT AS data_offset FROM f, b")
def exfat_entries(spark, sf_dir):
    images, boots, entries = _volume_entries(spark)
    return X.with_data_offset(entries, boots).drop("boot")


@query(f"{_EXFAT} SELECT 'volume' AS path, o::BIGINT AS \"offset\", position::INT AS position, c AS cluster FROM h")
def exfat_chains(spark, sf_dir):
    images, boots, entries = _volume_entries(spark)
    files = entries.select("path", "offset", "first_cluster", F.ceil(F.col("size") / 512).alias("n_clusters"), "no_fat_chain")
    return X.cluster_chains(files, X.fat_table(images, boots))


@query(
    f"""{_EXFAT}, d AS (SELECT h.o, string_agg(substr(x, (2 * (heap * sector + (c - 2) * cluster) + 1)::INT, (2 * cluster)::INT), '' ORDER BY position) AS bytes FROM h, b GROUP BY h.o)
    SELECT 'volume' AS path, f.o::BIGINT AS "offset", CASE WHEN filename <> '' THEN filename ELSE concat('recovered_0x', printf('%X', f.o), '.bin') END AS name, (length(substr(bytes, 1, 2 * size)) // 2)::INT AS size, sha256(unhex(substr(bytes, 1, 2 * size))) AS sha256, is_deleted FROM f JOIN d ON d.o = f.o"""
)
def exfat_carve(spark, sf_dir):
    images, boots, entries = _volume_entries(spark)
    return X.extract_files(images, entries, boots).select("path", "offset", "name", F.length("data").alias("size"), F.sha2("data", 256).alias("sha256"), "is_deleted")


def combined_image() -> bytes:
    """The volume with links in two of its files' clusters."""
    image = bytearray(exfat_image())
    image[1536:1580] = b"see https://youtu.be/dQw4w9WgXcQ here".ljust(44)
    image[3600:3640] = b"https://youtu.be/dQw4w9WgXcQ".ljust(40)
    return bytes(image)


@query()
def exfat_combined(spark, sf_dir):
    """Directory entries and links of one walk over a volume."""
    raw = combined_image()
    images = spark.createDataFrame([("volume", len(raw), bytearray(raw))], "path string, length long, content binary")
    entries, links = X.entries_and_links(C.chunks(images, 8192, X.OVERLAP))
    return entries.select(F.lit("entry").alias("kind"), "offset", F.col("filename").alias("name")).unionAll(links.select(F.lit("link"), "offset", "video_id"))


@query()
def exfat_extract(spark, sf_dir):
    """Files by cluster and by the place of their entry, with what is wrong where there are none."""
    images = _volume(spark)
    by_cluster = [X.extract_file(images, c, n, flat).select(F.lit(f"cluster {c}").alias("asked"), F.length("data").alias("size"), "error") for c, n, flat in ((3, 1200, False), (7, 700, True), (1, 10, True))]
    by_entry = [X.extract_entry(images, at).select(F.lit(f"entry {at}").alias("asked"), F.length("data").alias("size"), "error") for at in (1024, 1056, 1 << 20)]
    out = by_cluster[0]
    for df in (*by_cluster[1:], *by_entry):
        out = out.unionAll(df)
    return out


# ---------------------------------------------------------------- recovery, reports


def golden_image() -> bytes:
    image = bytearray(1 << 20)
    link = "https://www.youtube.com/watch?v=" + "dQw4w9WgXcQ"
    text = f"Title: Secret Plan\nCheck this video: {link}\n".encode() + b"A" * 20_000 + b"\x00\x00\x01\x02End of file."
    page = b"<html><head><title>My Web Page</title></head><body>Video: https://youtu.be/dQw4w9WgXcQ " + b"B" * 20_000 + b"</body></html>"
    image[102_400 : 102_400 + len(text)] = text
    image[204_800 : 204_800 + len(page)] = page
    return bytes(image)


def golden(spark: SparkSession) -> DataFrame:
    raw = golden_image()
    return spark.createDataFrame([("golden", len(raw), bytearray(raw))], "path string, length long, content binary")


@query()
def recovered_files(spark, sf_dir):
    _, _, files = N.carve(golden(spark))
    return files.select("stream", "filename", "file_type", "title", "size_kb", F.round("confidence", 4).alias("confidence"), "sha256", "start_offset", "end_offset")


_STATUS = "CASE doc_id % 5 WHEN 0 THEN 'Valid' WHEN 1 THEN 'Valid' WHEN 2 THEN 'MinorIssues' WHEN 3 THEN 'Corrupted' ELSE 'Unknown' END"


@query(
    f"""WITH s AS (SELECT count(*) AS n, count(*) FILTER ({_STATUS} IN ('Valid', 'MinorIssues')) AS ok, sum((n_chars // 1024) * 1024)::BIGINT AS bytes FROM documents)
    SELECT n AS total_processed, ok AS successful_recoveries, n - ok AS failed_recoveries, round(ok / n * 100.0, 6) AS success_rate, bytes AS total_bytes_recovered, round(ok / n * 70.0 + least(bytes / 1073741824.0, 100) * 0.3, 6) AS efficiency_score, greatest(5 - n, 0)::BIGINT AS candidates_rejected FROM s"""
)
def report_stats(spark, sf_dir):
    d = D.documents(spark, sf_dir).select(F.expr(_STATUS).alias("validation_status"), F.floor(F.col("n_chars") / 1024).alias("size_kb"))
    s = T.recovery_stats(d, 5)
    return s.withColumn("success_rate", F.round("success_rate", 6)).withColumn("efficiency_score", F.round("efficiency_score", 6))


@query(
    """WITH t AS (SELECT sum(octet_length(encode(text)))::DOUBLE AS n FROM documents), k AS (SELECT n, sum(least(69632, n - 65536 * i)) AS scanned, count(*) AS c FROM (SELECT n, unnest(range(ceil(n / 65536)::BIGINT)) AS i FROM t) GROUP BY n)
    SELECT round(n / 1048576, 6) AS image_size_mb, round(scanned / 1048576, 6) AS bytes_read_mb, round(n / 1048576, 6) AS bytes_unique_mb, c::BIGINT AS candidates_found, 10.0::DOUBLE AS scan_time_sec, round(scanned / 1048576 / 10, 6) AS avg_speed_mbps FROM k"""
)
def scan_results(spark, sf_dir):
    total = D.documents(spark, sf_dir).agg(F.sum(F.octet_length("text")).cast("long").alias("length"))
    s = C.chunk_ranges(total, "length", 65_536, 4_096).agg(F.first("length").alias("n"), F.sum("size").alias("scanned"), F.count("*").alias("c"))
    out = s.select(*T.scan_results(F.col("n").cast("double"), F.col("scanned").cast("double"), F.col("n").cast("double"), F.col("c"), F.lit(10.0)))
    return out.select(*(F.round(c, 6).alias(c) if c not in ("candidates_found", "scan_time_sec") else c for c in out.columns))


@query(
    f"""WITH {D.F_SQL} SELECT source AS image, row_number() OVER (PARTITION BY source ORDER BY "offset") AS cluster_id, concat('0x', printf('%X', "offset")) AS start_offset_hex, concat('0x', printf('%X', "offset" + size)) AS end_offset_hex, size AS size_bytes, (size // 1024)::BIGINT AS size_kb, (doc_id % 7)::BIGINT AS link_count FROM f"""
)
def data_clusters(spark, sf_dir):
    f = D.fragments(spark, sf_dir).select(F.col("source").alias("image"), "offset", "size", (F.col("doc_id") % 7).alias("n_links"), F.lit(0.0).alias("cyrillic"), F.lit(0.0).alias("score"))
    return T.data_clusters(f).drop("density", "confidence").withColumn("cluster_id", F.col("cluster_id").cast("long"))


@query(
    f"""WITH {D.F_SQL}, t AS (SELECT max("offset" + size) AS n FROM f), h AS (SELECT DISTINCT least("offset" * 256 // n, 255)::BIGINT AS block FROM f, t WHERE doc_id % 3 = 0)
    SELECT b.block, CASE WHEN h.block IS NOT NULL THEN 2 WHEN b.block < 128.0 THEN 1 ELSE 0 END AS state FROM (SELECT unnest(range(256)) AS block) b LEFT JOIN h ON h.block = b.block"""
)
def heatmap(spark, sf_dir):
    f = D.fragments(spark, sf_dir)
    total = f.agg(F.max(F.col("offset") + F.col("size"))).first()[0]
    return T.heatmap(f.where("doc_id % 3 = 0"), F.lit(total), 256, F.lit(total / 2))  # every third fragment has a find


@query(
    """WITH RECURSIVE s AS (SELECT user_id, ts, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS k FROM events WHERE value IS NOT NULL),
    r AS (SELECT user_id, ts, v, k, v AS a FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.ts, s.v, s.k, r.a * 0.9 + s.v * 0.1 FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1)
    SELECT user_id, ts, round(v, 6) AS current, round(a, 6) AS average FROM r"""
)
def throughput(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null").withColumn("seconds", F.lit(1.0))
    t = T.throughput(d, "user_id", "ts", "value", "seconds")
    return t.select("user_id", "ts", F.round("current", 6).alias("current"), F.round("average", 6).alias("average"))


@query(
    """SELECT doc_id, round(CASE WHEN n_chars > 0 THEN least(doc_id, n_chars) / n_chars * 100.0 ELSE 0 END, 6)::DOUBLE AS completion, concat('0x', printf('%X', doc_id * 4096)) AS place, printf('%02d:%02d:%02d', n_chars // 3600, n_chars // 60 % 60, n_chars % 60) AS took,
    CASE WHEN doc_id % 5 = 1 THEN 'path' WHEN doc_id % 5 = 2 THEN 'hash' WHEN doc_id > n_chars THEN 'position' END AS refused FROM documents"""
)
def resume_validation(spark, sf_dir):
    d, n = D.documents(spark, sf_dir), F.col("n_chars")
    refused = R.resume_verdict(F.lit("a"), F.when(F.col("doc_id") % 5 == 1, "b").otherwise("a"), F.lit("h"), F.when(F.col("doc_id") % 5 == 2, "g").otherwise("h"), F.col("doc_id"), n)
    return d.select("doc_id", F.round(T.completion(F.least("doc_id", "n_chars"), n), 6).alias("completion"), T.hex_offset(F.col("doc_id") * 4096).alias("place"), T.duration(n).alias("took"), refused.alias("refused"))


_FILE = "concat(source, '-', cast(doc_id - doc_id % 36 AS STRING), CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(' [', substr(md5(cast(doc_id - doc_id % 3 AS STRING)), 1, 11), ']') END, CASE doc_id % 9 WHEN 0 THEN '.info.json' WHEN 1 THEN '.en.vtt' WHEN 2 THEN '.mp4' WHEN 3 THEN '.jpg' WHEN 4 THEN '.fr.vtt' WHEN 5 THEN '.part.xyz' WHEN 6 THEN '.webp' WHEN 7 THEN '.srt' ELSE '' END)"
_ENDS = "\\.info\\.json$|\\.en\\.vtt$|\\.ru\\.vtt$|\\.vtt$|\\.srt$|\\.webp$|\\.jpg$|\\.mp4$|\\.mkv$|\\.webm$"
_GROUPS = f"""n AS (SELECT doc_id, text, {_FILE} AS name FROM documents), g AS (SELECT *, CASE WHEN regexp_extract(name, '\\[([A-Za-z0-9_-]{{11}})\\]', 1) <> '' THEN regexp_extract(name, '\\[([A-Za-z0-9_-]{{11}})\\]', 1)
  WHEN regexp_matches(name, '{_ENDS}') THEN concat('NOID_', regexp_replace(name, '{_ENDS}', '')) ELSE concat('NOID_', regexp_replace(name, '^(.+)\\.[^.]+$', '\\1')) END AS media_group FROM n)"""


@query(f"WITH {_GROUPS} SELECT media_group, count(*) AS n, arg_min(name, (CASE WHEN ends_with(name, '.info.json') THEN 0 WHEN ends_with(name, '.vtt') THEN 1 ELSE 2 END, name)) AS best FROM g GROUP BY media_group")
def media_groups(spark, sf_dir):
    return M.grouped(D.documents(spark, sf_dir).select(F.expr(_FILE).alias("name")))


_TEXT = """CASE WHEN doc_id % 9 = 0 THEN concat('{"title": "t', cast(doc_id AS STRING), '", "description": "', source, '"}') ELSE text END"""


@query(
    f"""WITH {_GROUPS}, t AS (SELECT doc_id, name, media_group, CASE WHEN ends_with(name, '.info.json') THEN concat('t', cast(doc_id AS STRING), ' ', source) ELSE text END AS read, CASE WHEN ends_with(name, '.info.json') THEN 0 WHEN ends_with(name, '.vtt') THEN 1 ELSE 2 END AS rank FROM (SELECT g.*, d.source FROM g JOIN documents d USING (doc_id))),
    c AS (SELECT *, CASE WHEN contains(read, 'the') THEN 'English' ELSE 'Other' END AS category, length(read) % 10 / 10.0 AS confidence FROM t WHERE rank < 2),
    i AS (SELECT media_group, arg_min(CASE WHEN confidence > 0.2 THEN category ELSE '' END, name) FILTER (rank = 0) AS info, arg_min(category, name) FILTER (rank = 1 AND confidence > 0.2) AS captions FROM c GROUP BY media_group)
    SELECT t.doc_id, t.media_group, coalesce(nullif(i.info, ''), i.captions, 'Unknown') AS category FROM t LEFT JOIN i ON i.media_group = t.media_group"""
)
def media_categories(spark, sf_dir):
    classify = lambda t: F.struct(F.when(t.contains("the"), "English").otherwise("Other").alias("category"), (F.length(t) % 10 / 10.0).alias("confidence"))
    files = D.documents(spark, sf_dir).select("doc_id", F.concat(F.expr(_FILE)).alias("name"), F.expr(_TEXT).alias("text"))
    return M.categorised(files, classify).select("doc_id", "media_group", "category")


@query("SELECT event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10")
def log_tail(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts")
    return T.last_entries(d, "event_type", "ts", "event_id")


@query(f"WITH {D.P_SQL} SELECT vid, count(*) AS n FROM (SELECT DISTINCT vid, lang FROM p) GROUP BY vid")
def stream_dedup(spark, sf_dir):
    """Structured Streaming: rows with a key seen before go, over all micro-batches of the table's files."""
    scratch = Scratch(spark, "stream-dedup")
    rows = scratch.save(D.bodies(spark, sf_dir).select("doc_id", "vid", "lang", F.concat("vid", F.lit("/"), "lang").alias("key")))
    feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(rows._scratch_path)
    return R.stream_dedup(feed, "key", f"{scratch.base}/out", f"{scratch.base}/state").groupBy("vid").agg(F.count("*").alias("n"))


@query(f"""{Q._LINKS}, t AS (SELECT *, CASE WHEN doc_id % 4 = 1 THEN substr(md5(url), 1, 6) END AS title FROM l)
    SELECT video_id, doc_id, pattern_name, title, confidence FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY title IS NULL, confidence DESC, doc_id, pattern_idx) AS r FROM t) WHERE r = 1""")
def stream_best_links(spark, sf_dir):
    """Structured Streaming with a keyed state: the best link of each id after all micro-batches of the table's links."""
    title = F.when(F.col("doc_id") % 4 == 1, F.substring(F.md5("url"), 1, 6))
    links = Q._links(spark, sf_dir).select("video_id", "doc_id", F.col("doc_id").alias("chunk_seq"), F.lit(0).alias("offset"), "pattern_idx", "pattern_name", "confidence", title.alias("title"))
    scratch = Scratch(spark, "stream-best")
    rows = scratch.save(links)
    feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, len(rows.inputFiles()) // 3)).parquet(rows._scratch_path)
    return R.stream_best(feed, f"{scratch.base}/out", f"{scratch.base}/state").select("video_id", "doc_id", "pattern_name", "title", "confidence")


@query(f"WITH {D.P_SQL} SELECT doc_id FROM p WHERE vid NOT IN (SELECT vid FROM p WHERE doc_id % 6 = 0)")
def remaining_fragments(spark, sf_dir):
    """Fragments whose link no chosen fragment (every sixth) has: an anti join."""
    d = D.bodies(spark, sf_dir).select("doc_id", "vid")
    return d.join(d.where("doc_id % 6 = 0").select("vid"), "vid", "left_anti").select("doc_id")
