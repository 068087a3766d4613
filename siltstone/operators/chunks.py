"""Overlapping chunks, bounds-checked slices and fixed-size blocks of binary rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import predicates as V
from siltstone.sources.images import bytes_at, spread


def aligned_chunk_size(size: Column) -> Column:
    """A multiple of 64, 64 at least."""
    return F.greatest(F.lit(64), F.floor(size / 64) * 64).cast("long")


def chunk_ranges(images: DataFrame, length: str, chunk: int, overlap: int, start: int = 0, reverse: bool = False) -> DataFrame:
    """Adds chunk_id, offset, size (and chunk_seq, the scan order) for offsets start, start + chunk, ...; no rows for
    chunk 0, an empty image or a start behind its end."""
    if chunk <= 0:
        return images.select("*", *(F.lit(None).cast("long").alias(c) for c in ("chunk_id", "offset", "size", "chunk_seq"))).limit(0)
    n = F.ceil((F.col(length) - start) / chunk)
    out = images.where(F.col(length) > start).select("*", n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk_id"))
    out = out.withColumn("offset", F.col("chunk_id") * chunk + start)
    out = out.withColumn("size", F.least(F.lit(chunk + overlap), F.col(length) - F.col("offset")).cast("long"))
    return out.withColumn("chunk_seq", F.col("_n") - 1 - F.col("chunk_id") if reverse else F.col("chunk_id")).drop("_n")


def chunks(images: DataFrame, chunk: int, overlap: int, start: int = 0, reverse: bool = False) -> DataFrame:
    """(path, chunk_id, offset, size, chunk_seq, data) of images (path, length), with content or read by ranges."""
    out = chunk_ranges(images.select("path", "length"), "length", chunk, overlap, start, reverse).drop("length")
    return bytes_at(spread(out, images), images, "offset", "size", "data").select("path", "chunk_id", "offset", "size", "chunk_seq", "data")


def slice_of(content: Column, length: Column, offset: Column, size: Column) -> Column:
    """Struct of data and error: InvalidOffset at or behind the end, InvalidSize beyond it."""
    error = F.when((offset < 0) | (offset >= length), "InvalidOffset").when((size < 0) | (offset + size > length), "InvalidSize")
    data = F.when(error.isNull(), F.substring(content, (offset + 1).cast("int"), size.cast("int")))
    return F.struct(data.alias("data"), error.alias("error"))


def blocks(rows: DataFrame, data: str, width: int = 32) -> DataFrame:
    """Adds block (number) and the flags of each full block of `width` bytes; the flags' struct is `flags`."""
    n = F.floor(F.length(data) / width).cast("int")
    out = rows.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    return out.withColumn("flags", V.block_flags(F.substring(F.col(data), F.col("block") * width + 1, F.lit(width))))
