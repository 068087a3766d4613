"""Restoring files from assembled streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import predicates as V
from siltstone.sources.images import bytes_at


def gathered(streams: DataFrame, images: DataFrame) -> DataFrame:
    """(image, stream, confidence, total_score, start_offset, end_offset, data): the bytes of each stream's fragments,
    in order. streams: a row per fragment (image, stream, position, offset, size, confidence, total_score); images:
    image, path and content or none. One value per stream, as the file is one value."""
    part = bytes_at(streams.join(images.select("image", "path"), "image"), images, "offset", "size")
    whole = part.groupBy("image", "stream").agg(
        F.array_sort(F.collect_list(F.struct("position", "part"))).alias("parts"), F.first("confidence").alias("confidence"), F.first("total_score").alias("total_score"),
        F.min("offset").alias("start_offset"), F.max(F.col("offset") + F.col("size")).alias("end_offset"),
    )
    return whole.withColumn("data", F.aggregate("parts", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["part"]))).drop("parts")


def recovered(files: DataFrame) -> DataFrame:
    """Cleans, names and hashes files (data binary, file_type): adds text, title, filename, size_kb, sha256. Numbers run
    in the order of `stream`; files is a short list (the streams kept of an image)."""
    text = V.cleaned(F.decode("data", "UTF-8"), F.col("file_type"))
    out = files.withColumn("text", text).withColumn("title", V.file_title(F.col("text"), F.col("file_type")))
    name = V.sanitized(F.col("title"))
    number = F.lpad((F.col("stream") + 1).cast("string"), 4, "0")
    filename = F.concat(F.lit("recovered_"), number, F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("_"), name)).otherwise(""), F.lit("."), "file_type")
    clean = F.encode("text", "UTF-8")
    return out.withColumn("filename", filename).withColumn("size_kb", F.floor(F.length(clean) / 1024)).withColumn("sha256", F.sha2(clean, 256))
