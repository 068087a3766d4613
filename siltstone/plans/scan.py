"""End-to-end plans: scan, carve, report."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import octets as O
from siltstone.functions import predicates as V
from siltstone.functions import scores as S
from siltstone.functions.scratch import Scratch
from siltstone.operators import chunks as C
from siltstone.operators import links as L
from siltstone.operators import recover as R
from siltstone.operators import report as T
from siltstone.operators import streams as A
from siltstone.sources import sinks


@dataclass(frozen=True)
class Options:
    """What a scan can be told; check() gives the first error or None."""

    chunk_kb: int = 2048
    chunk_min_kb: int = 64
    overlap_kb: int = 64
    start: int = 0
    reverse: bool = False
    dedup: bool = True
    min_confidence: float = 0.0
    target_min_kb: int = 0
    target_max_kb: int = 0
    max_streams: int = 3
    early_exit: int = 0
    links_only: bool = False
    profile: str = "validated"

    def check(self) -> str | None:
        if self.chunk_kb <= 0 or self.chunk_min_kb <= 0:
            return "chunk sizes must be over 0"
        if self.chunk_min_kb > self.chunk_kb:
            return "chunk_min_kb must not exceed chunk_kb"
        if self.target_max_kb and self.target_min_kb > self.target_max_kb:
            return "target_min_kb must not exceed target_max_kb"
        if self.profile not in S.THRESHOLDS:
            return f"profile must be one of {', '.join(S.THRESHOLDS)}"
        return None


def features(chunks: DataFrame, links: DataFrame | None = None, n_links: Column | None = None, vector: bool = False) -> DataFrame:
    """Of chunks (path, chunk_id, offset, size, data): their columns without the data, and file_type, n_links, links,
    cyrillic, brackets, entropy, is_empty, target_score, fast_score, fragment_score, on demand vector (byte frequencies).
    Links are counted by chunk, or given as a number. Only narrow columns are joined; the bytes stay where they are read."""
    data, text = F.col("data"), V.text_of(F.col("data"))
    own = {"file_type": V.file_type(data), "cyrillic": V.cyrillic_density(data), "brackets": O.count_bytes(data, "{}[]"), "is_empty": F.length(F.translate(O.latin(data), "\x00", "")) == 0, "entropy": O.entropy(data), "checks": V.validation(text), "html": V.is_html(text), "csv": V.is_csv(text)}
    out = chunks.withColumns(own | ({"vector": O.byte_frequency(data)} if vector else {})).drop("data")
    if links is not None:
        n = links.where("error is null").groupBy("path", "chunk_id").agg(F.count("*").alias("n_links"), F.collect_set("video_id").alias("links"))
        out = out.join(n, ["path", "chunk_id"], "left")
    else:
        out = out.withColumn("n_links", F.lit(0) if n_links is None else n_links).withColumn("links", F.array().cast("array<string>"))
    out = out.withColumns({"n_links": F.coalesce("n_links", F.lit(0)), "links": F.coalesce("links", F.array().cast("array<string>"))})
    out = out.withColumn("target_score", S.target_score(F.col("n_links"), F.col("cyrillic"), F.col("brackets") > 0, F.col("size")))
    out = out.withColumn("fast_score", S.target_score(F.col("n_links"), F.col("cyrillic"), F.col("brackets") > 10, F.col("size")))
    score = S.fragment_score(F.col("target_score"), F.col("entropy"), F.col("checks"), F.col("html"), F.col("csv"), F.col("size"))
    return out.withColumn("fragment_score", score).drop("html", "csv")


def hot(featured: DataFrame, profile: str = "validated") -> DataFrame:
    """The hot fragments, `score` being that of the profile."""
    if profile == "fast":
        return featured.withColumn("score", F.col("fast_score")).where((F.col("n_links") > 0) & (F.col("score") > S.THRESHOLDS["fast"]))
    return featured.withColumn("score", F.col("fragment_score.overall_score")).where((F.col("score") > S.THRESHOLDS["validated"]) & ~F.col("is_empty"))


def scan(images: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(links, hot fragments) of images (path, length), with content or large ones read by ranges."""
    if wrong := options.check():
        raise ValueError(wrong)
    chunk = max(64, options.chunk_kb * 1024 // 64 * 64)
    parts = C.chunks(images, chunk, options.overlap_kb * 1024, options.start, options.reverse)
    raw = Scratch(images.sparkSession, "scan").save(L.extract(parts, options.dedup))
    links = L.at_least(L.best_links(raw.where("error is null"), "path"), options.min_confidence).orderBy("path", "offset", "pattern_idx")
    if options.links_only:
        return links, parts.limit(0)
    found = hot(features(parts, raw, vector=True), options.profile)
    if options.target_max_kb:
        found = found.where(F.col("size").between(options.target_min_kb * 1024, options.target_max_kb * 1024))
    return links, found


def carve(images: DataFrame, options: Options = Options(), weights: A.Weights = A.Weights()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, hot fragments, recovered files) of images (path, length), with content or large ones."""
    scratch = Scratch(images.sparkSession, "carve")
    links, found = scan(images, options)
    numbered = images.withColumn("image", F.xxhash64("path"))
    found = scratch.save(found.select(F.xxhash64("path").alias("image"), "chunk_id", "offset", "size", "file_type", "n_links", "links", "cyrillic", "score", "target_score", "fragment_score", "vector"))
    nodes = found.select("image", F.col("chunk_id").alias("id"), "offset", "size", "file_type", (F.col("score") + F.col("fragment_score.overall_score")).alias("score"), S.has_valid_structure(F.col("fragment_score")).alias("structured"), "links", "vector")
    streams = A.assemble(nodes, weights, options.max_streams)
    kind = found.select("image", "offset", "file_type")
    first = streams.where("position = 0").select("image", "stream", "offset").join(kind, ["image", "offset"]).select("image", "stream", "file_type")
    files = R.recovered(R.gathered(streams, numbered).join(first, ["image", "stream"]))
    if options.early_exit:
        files = files.orderBy("image", "stream").limit(options.early_exit)
    return links, found, files


def run(spark: SparkSession, images: DataFrame, directory: str, options: Options = Options()) -> tuple[str, str]:
    """Carves one image, writes its files, notes and reports; the paths of the JSON and HTML reports. The driver holds the
    files' rows (max_streams of them) and totals; clusters pass through it one by one."""
    began, started = datetime.now(), datetime.now()
    path, length = images.select("path", "length").first()
    sinks.write_session(spark, directory, image=path, started=str(started), chunk_kb=str(options.chunk_kb))
    _, found, files = carve(images, options)
    scratch = Scratch(spark, "run")
    files = scratch.save(files.withColumn("data", F.encode("text", "UTF-8")))
    status = sinks.write_files(files, directory)
    done = scratch.save(files.drop("data", "text").join(status, "filename"))
    clusters = scratch.save(T.data_clusters(found).orderBy("cluster_id"))
    n_clusters = clusters.count()
    stats = T.recovery_stats(done, n_clusters).first().asDict()
    listed = [r.asDict() | {"id": i} for i, r in enumerate(done.orderBy("stream").collect(), 1)]
    seconds = (datetime.now() - began).total_seconds()
    stamp = started.strftime("%Y-%m-%d %H:%M:%S")
    check = spark.range(1).select(T.checksum(F.lit(stamp), F.lit(float(stats["success_rate"])), F.lit(len(listed)))).first()[0]
    scanned = spark.range(1).select(*T.scan_results(F.lit(length), F.lit(length), F.lit(length), F.lit(n_clusters), F.lit(seconds))).first().asDict()
    report = {"metadata": {"timestamp": stamp, "image_path": path, "output_dir": directory}, "scan_results": scanned | {"files_recovered": len(listed)}, "recovered_files": listed, "stats": stats, "success": bool(listed), "report_checksum": check}
    return sinks.write_report(spark, directory, report, started, lambda: (r.asDict() for r in clusters.orderBy("cluster_id").toLocalIterator()))
