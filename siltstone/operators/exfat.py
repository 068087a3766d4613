"""exFAT: boot sectors, directory entry sets, cluster chains, file extraction."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import octets as O
from siltstone.functions import predicates as V
from siltstone.functions.scratch import Scratch
from siltstone.operators import links
from siltstone.sources.images import byte_ranges, bytes_at, large_image, spread

# The on-disk format.
SECTOR, ENTRY, MAGIC = 512, 32, "EXFAT   "
MAX_CLUSTER, MAX_FILE = 32 * 1024 * 1024, 250 * 1024 * 1024
LAST_CLUSTER = 0xFFFFFFF7
SEARCH = 4 * 1024 * 1024
#: A set has at most 1 + 255 entries, so this much overlap keeps every set whole in some chunk.
OVERLAP = (1 + 255) * ENTRY


def boot_params(sector: Column, at: Column) -> Column:
    """Struct of the boot parameters of a sector (at least 120 bytes) found at a byte offset; null if it is none."""
    byte = lambda i: O.le_int(sector, i, 1)
    u32 = lambda i: O.le_int(sector, i, 4)
    shift, cshift = byte(108), byte(109)
    size = F.call_function("shiftleft", F.lit(1).cast("long"), shift.cast("int"))
    cluster = F.call_function("shiftleft", size, cshift.cast("int"))
    fat, heap = u32(80) * size, u32(88) * size
    ok = (F.length(sector) >= 120) & (O.latin(F.substring(sector, 4, 8)) == MAGIC) & shift.between(9, 12) & (cshift <= 25) & (cluster > 0) & (cluster <= MAX_CLUSTER) & (fat + at != 0) & (heap + at != 0)
    fields = F.struct(
        size.alias("sector_size"), cluster.alias("cluster_size"), (fat + at).alias("fat_offset"), u32(84).alias("fat_length_sectors"),
        (heap + at).alias("cluster_heap_offset"), u32(92).alias("cluster_count"), u32(96).alias("root_dir_cluster"), at.cast("long").alias("boot_sector_offset"),
    )
    return F.when(ok, fields)


def boot_sectors(images: DataFrame) -> DataFrame:
    """(path, boot) of images (path, length): the first valid sector at 0, 512, ... up to 4 MiB, or null."""
    head = images.select("path", "length", F.lit(0).cast("long").alias("_at"), F.least("length", F.lit(SEARCH + SECTOR)).alias("_n"))
    head = bytes_at(head, images, "_at", "_n", "head")
    last = F.least(F.lit(SEARCH), F.greatest(F.col("length") - 1, F.lit(0)))
    at = head.select("path", "head", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(SECTOR).cast("long"))).alias("at"))
    found = at.select("path", "at", boot_params(F.substring("head", (F.col("at") + 1).cast("int"), F.lit(SECTOR)), F.col("at")).alias("boot"))
    first = found.where("boot is not null").groupBy("path").agg(F.min_by("boot", "at").alias("boot"))
    return images.select("path").join(first, "path", "left")


def parse_entry_set(data: bytes, at: int = 0) -> tuple[dict, int] | None:
    """(entry, slots used) of the set that starts at a slot; None if there is none."""
    slot = lambda k: data[at + k * ENTRY : at + (k + 1) * ENTRY]
    head = slot(0)
    if len(head) < ENTRY or head[0] not in (0x85, 0x05):
        return None
    more = head[1]
    if more < 2 or len(data) < at + (1 + more) * ENTRY:
        return None
    ext = slot(1)
    if ext[0] not in (0xC0, 0x40):
        return None
    cluster, size = struct.unpack_from("<I", ext, 20)[0], struct.unpack_from("<Q", ext, 24)[0]
    if cluster < 2 and size > 0 or size >= 1 << 63:
        return None
    left, name = ext[3], []
    for k in range(2, 1 + more):
        part = slot(k)
        if part[0] not in (0xC1, 0x41):
            break
        for (unit,) in struct.iter_unpack("<H", part[2:]):
            if not unit or not left:
                break
            if not 0xD800 <= unit <= 0xDFFF:  # half of a pair stands for no character
                name.append(chr(unit))
                left -= 1
    return {"is_deleted": head[0] == 0x05, "filename": "".join(name), "size": size, "first_cluster": cluster, "no_fat_chain": bool(ext[1] & 2)}, 1 + more


ENTRIES = "path string, offset long, consumed int, is_deleted boolean, filename string, size long, first_cluster long, no_fat_chain boolean"


def _entries(batches):
    for batch in batches:
        rows = []
        for path, base, data in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "data")), strict=True):
            at = 0
            while at + ENTRY <= len(data):
                found = parse_entry_set(data, at)
                if found:
                    e, used = found
                    rows.append((path, base + at, used, e["is_deleted"], e["filename"], e["size"], e["first_cluster"], e["no_fat_chain"]))
                    at += used * ENTRY
                else:
                    at += ENTRY
        if rows:
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in ENTRIES.split(", ")])


def entry_sets(chunks: DataFrame) -> DataFrame:
    """Directory entries of chunks (path, offset, data) that overlap by OVERLAP bytes; sets seen twice are one."""
    marks = O.latin(F.col("data")).rlike("[\x05\u0085]")
    return chunks.where(marks).select("path", "offset", "data").mapInArrow(_entries, ENTRIES).dropDuplicates(["path", "offset"])


HOT = np.isin(np.arange(256), list(b"yh{v/"))
#: Bytes scanned for links from a hot block on, and those of them that the next window may show again.
WINDOW, AGAIN = 4096, 128
BOTH = f"kind string, {ENTRIES}, url string, video_id string, title string, pattern_name string, confidence double"


def combined(data: bytes, base: int):
    """("entry", ...) and ("link", ...) rows of one chunk in one walk over its 32-byte blocks: empty blocks are skipped, an
    entry set is taken whole, and a block with a hot byte opens a window for links, but not inside the one before."""
    n = len(data) // ENTRY
    rows = np.frombuffer(data, np.uint8, n * ENTRY).reshape(n, ENTRY)
    marks = np.flatnonzero((rows[:, 0] == 0x85) | (rows[:, 0] == 0x05)) if n else np.zeros(0, np.int64)
    hot = np.flatnonzero(HOT[rows].any(axis=1)) if n else np.zeros(0, np.int64)
    pos, cold, seen, matcher = 0, 0, set(), links.matcher()  # block numbers; ids count over the whole chunk
    while True:
        i = np.searchsorted(marks, pos)
        j = np.searchsorted(hot, max(pos, cold))
        mark, warm = (int(x[k]) if k < len(x) else n for x, k in ((marks, i), (hot, j)))
        pos = min(mark, warm)
        if pos >= n:
            return
        found = parse_entry_set(data, pos * ENTRY) if pos == mark else None
        if found:
            e, used = found
            yield "entry", base + pos * ENTRY, used, e["is_deleted"], e["filename"], e["size"], e["first_cluster"], e["no_fat_chain"], *(None,) * 5
            pos += used
            continue
        if pos == warm:
            end = min(pos * ENTRY + WINDOW, len(data))
            for url, video_id, title, offset, name, _, confidence in matcher.scan(data[pos * ENTRY : end], base + pos * ENTRY, True, seen):
                yield "link", offset, *(None,) * 6, url, video_id, title, name, confidence
            cold = -(-max(end - AGAIN, 0) // ENTRY)
        pos += 1


def _combined(batches):
    for batch in batches:
        rows = [(r[0], path, *r[1:]) for path, base, data in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "data")), strict=True) for r in combined(data, base)]
        if rows:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in BOTH.split(", ")])


def entries_and_links(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directory entries and links of chunks (path, offset, data) from one scan, each in order of offset."""
    found = Scratch(chunks.sparkSession, "entries").save(chunks.select("path", "offset", "data").mapInArrow(_combined, BOTH))
    entries = found.where("kind = 'entry'").select(*(f.split()[0] for f in ENTRIES.split(", "))).dropDuplicates(["path", "offset"])
    return entries.orderBy("path", "offset"), found.where("kind = 'link'").select("path", "offset", "url", "video_id", "title", "pattern_name", "confidence").orderBy("path", "offset", "pattern_name")


def scan_range(spark: SparkSession, path: str, offset: int = 0, limit: int = 0, chunk: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """Entries (with data_offset) and links of a range of a file of any size, read by byte ranges; limit 0: to its end."""
    chunks = byte_ranges(spark, path, chunk=chunk, overlap=OVERLAP, start=offset, limit=limit)
    entries, found = entries_and_links(chunks)
    boots = boot_sectors(large_image(spark, path)).select(F.lit(path).alias("path"), "boot")
    return with_data_offset(entries, boots).drop("boot").orderBy("path", "offset"), found


def with_data_offset(entries: DataFrame, boots: DataFrame) -> DataFrame:
    """Adds data_offset: heap + (cluster - 2) * cluster size; null for clusters under 2 and images without boot sector."""
    at = F.col("boot.cluster_heap_offset") + (F.col("first_cluster") - 2) * F.col("boot.cluster_size")
    return entries.join(boots, "path", "left").withColumn("data_offset", F.when(F.col("first_cluster") >= 2, at))


#: Table entries that are read at once.
FAT_PIECE = 1 << 18


def _fat_entries(batches):
    for batch in batches:
        for path, first, n, part in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "n", "part")), strict=True):
            value = np.frombuffer(part, "<u4", len(part) // 4).astype(np.int64)
            at = np.flatnonzero((value >= 2) & (value < LAST_CLUSTER) & (value <= n + 1))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(at), pa.string()), pa.array(at + first), pa.array(value[at])], names=["path", "cluster", "next"])


def fat_table(images: DataFrame, boots: DataFrame) -> DataFrame:
    """(path, cluster, next) of the image's allocation table, links that lead on only; read in pieces of FAT_PIECE."""
    n = F.col("boot.cluster_count")
    rows = images.select("path", "length").join(boots.where("boot is not null"), "path")
    rows = rows.select("path", "length", n.alias("n"), F.col("boot.fat_offset").alias("_fat"), F.explode(F.sequence(F.lit(2).cast("long"), n + 1, F.lit(FAT_PIECE).cast("long"))).alias("first"))
    rows = rows.select("path", "first", "n", (F.col("_fat") + 4 * F.col("first")).alias("at"), "length", F.least(F.lit(FAT_PIECE), F.col("n") + 2 - F.col("first")).alias("_count"))
    rows = rows.where("at < length").select("path", "first", "n", "at", F.least(4 * F.col("_count"), F.col("length") - F.col("at")).alias("size"))
    return bytes_at(spread(rows, images), images, "at", "size").mapInArrow(_fat_entries, "path string, cluster long, next long")


def cluster_chains(files: DataFrame, fat: DataFrame) -> DataFrame:
    """(path, offset, position, cluster) of files (path, offset, first_cluster, n_clusters, no_fat_chain).

    Contiguous files are a sequence. Chains are found by pointer doubling: round k knows the first 2^k clusters of every
    chain and the jump of 2^k clusters, so a chain of n clusters takes log2(n) joins. A cluster met again ends a chain."""
    scratch = Scratch(files.sparkSession, "chains")
    flat = files.where("no_fat_chain and n_clusters > 0").select("path", "offset", F.posexplode(F.sequence(F.col("first_cluster"), F.col("first_cluster") + F.col("n_clusters") - 1)).alias("position", "cluster"))
    linked = files.where("not no_fat_chain and n_clusters > 0")
    longest = linked.agg(F.max("n_clusters")).first()[0] or 0
    if not longest:
        return flat.select("path", "offset", F.col("position").cast("int").alias("position"), "cluster")
    known = scratch.save(linked.select("path", "offset", "n_clusters", F.lit(0).alias("position"), F.col("first_cluster").alias("cluster")))
    jump = scratch.save(fat) if longest > 1 else fat
    step = 1
    while step < longest:
        further = known.join(jump, ["path", "cluster"]).select("path", "offset", "n_clusters", (F.col("position") + step).alias("position"), F.col("next").alias("cluster")).where("position < n_clusters")
        further = scratch.save(further)
        if further.isEmpty():
            break
        known = scratch.save(known.unionAll(further).groupBy("path", "offset", "n_clusters", "cluster").agg(F.min("position").alias("position")).select("path", "offset", "n_clusters", "position", "cluster"))
        jump = scratch.save(jump.join(jump.select("path", F.col("cluster").alias("next"), F.col("next").alias("far")), ["path", "next"]).select("path", "cluster", F.col("far").alias("next")))
        step *= 2
    return flat.select("path", "offset", F.col("position").cast("int").alias("position"), "cluster").unionAll(known.select("path", "offset", "position", "cluster"))


def contents(images: DataFrame, files: DataFrame, boots: DataFrame) -> DataFrame:
    """(path, offset, data) of files (path, offset, first_cluster, size, no_fat_chain): the bytes of their clusters in order.

    A file's clusters meet in one row, as the result is one value."""
    files = files.join(boots.where("boot is not null"), "path").withColumn("n_clusters", F.ceil(F.col("size") / F.col("boot.cluster_size")))
    chain = cluster_chains(files, fat_table(images, boots))
    place = F.col("boot.cluster_heap_offset") + (F.col("cluster") - 2) * F.col("boot.cluster_size")
    rows = chain.join(files.select("path", "offset", "boot"), ["path", "offset"]).where("cluster <= boot.cluster_count + 1").join(images.select("path", "length"), "path")
    rows = rows.where(place < F.col("length")).select("path", "offset", "position", place.alias("at"), F.col("boot.cluster_size").alias("n"))
    parts = bytes_at(rows, images, "at", "n")
    whole = parts.groupBy("path", "offset").agg(F.array_sort(F.collect_list(F.struct("position", "part"))).alias("parts"))
    data = F.aggregate("parts", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["part"]))
    return whole.join(files.select("path", "offset", "size"), ["path", "offset"]).select("path", "offset", F.substring(data, F.lit(1), F.col("size").cast("int")).alias("data"))


def extract_files(images: DataFrame, entries: DataFrame, boots: DataFrame) -> DataFrame:
    """(path, offset, name, data, is_deleted) of the carvable entries, 250 MiB each at most."""
    files = entries.where((F.col("size") > 0) & (F.col("size") <= MAX_FILE) & (F.col("first_cluster") >= 2))
    out = files.join(contents(images, files.select("path", "offset", "first_cluster", "size", "no_fat_chain"), boots), ["path", "offset"])
    name = F.when(F.col("filename") != "", F.col("filename")).otherwise(F.concat(F.lit("recovered_0x"), F.hex("offset"), F.lit(".bin")))
    return out.where(V.is_carvable(F.col("size"), F.col("first_cluster"), F.col("data"))).select("path", "offset", name.alias("name"), "data", "is_deleted")


NO_BOOT = "exFAT boot sector not found in image"


def extract_file(images: DataFrame, first_cluster: int, size: int, no_fat_chain: bool) -> DataFrame:
    """(path, data, error) of the file that starts at a cluster of each image: no bytes for a cluster under 2 or size 0."""
    boots = Scratch(images.sparkSession, "boots").save(boot_sectors(images))
    asked = images.select("path", F.lit(0).cast("long").alias("offset"), F.lit(first_cluster).cast("long").alias("first_cluster"), F.lit(size).cast("long").alias("size"), F.lit(no_fat_chain).alias("no_fat_chain"))
    got = contents(images, asked.where("first_cluster >= 2 and size > 0"), boots)
    out = boots.join(got, "path", "left")
    return out.select("path", F.when(F.col("boot").isNotNull(), F.coalesce("data", F.lit(b"").cast("binary"))).alias("data"), F.when(F.col("boot").isNull(), NO_BOOT).alias("error"))


def extract_entry(images: DataFrame, entry_offset: int) -> DataFrame:
    """(path, name, data, error) of the file whose entry set starts at an offset of each image."""
    boots = Scratch(images.sparkSession, "boots").save(boot_sectors(images))
    at = F.lit(entry_offset).cast("long")
    here = images.select("path", "length", at.alias("offset"), F.least(F.lit(OVERLAP), F.col("length") - at).alias("n"))
    sets = bytes_at(here.where(at + 3 * ENTRY <= F.col("length")), images, "offset", "n", "data").select("path", "offset", "data")
    entries = entry_sets(sets).where(F.col("offset") == at)
    good = entries.where("first_cluster >= 2 and size > 0")
    got = contents(images, good.select("path", "offset", "first_cluster", "size", "no_fat_chain"), boots).select("path", "data")
    place = F.concat(F.lit("0x"), F.hex(at))
    out = here.join(boots, "path").join(entries.select("path", "filename", "first_cluster", F.col("size").alias("bytes")), "path", "left").join(got, "path", "left")
    error = (
        F.when(F.col("boot").isNull(), NO_BOOT)
        .when(at + 3 * ENTRY > F.col("length"), F.concat(F.lit("Entry offset "), place, F.lit(" is beyond image size")))
        .when(F.col("filename").isNull(), F.concat(F.lit("No valid exFAT entry set at offset "), place))
        .when((F.col("first_cluster") < 2) | (F.col("bytes") == 0), F.concat(F.lit("Invalid entry: cluster="), F.col("first_cluster"), F.lit(", size="), F.col("bytes")))
    )
    ok = lambda c: F.when(error.isNull(), c)
    return out.select("path", ok(F.col("filename")).alias("name"), ok(F.coalesce("data", F.lit(b"").cast("binary"))).alias("data"), error.alias("error"))
