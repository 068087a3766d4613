"""Statistics of a scan as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MB = 1024.0 * 1024.0


def recovery_stats(files: DataFrame, candidates: Column | int) -> DataFrame:
    """One row of totals of files (size_kb, validation_status)."""
    candidates = F.lit(candidates) if isinstance(candidates, int) else candidates
    s = files.agg(F.count("*").alias("total_processed"), F.count_if(F.col("validation_status").isin("Valid", "MinorIssues")).alias("successful_recoveries"), F.coalesce(F.sum(F.col("size_kb") * 1024), F.lit(0)).cast("long").alias("total_bytes_recovered"))
    rate = F.when(F.col("total_processed") > 0, F.col("successful_recoveries") / F.col("total_processed") * 100.0).otherwise(0.0)
    gb = F.least(F.col("total_bytes_recovered") / (MB * 1024.0), F.lit(100.0))
    return s.select(
        "total_processed", "successful_recoveries", (F.col("total_processed") - F.col("successful_recoveries")).alias("failed_recoveries"), rate.alias("success_rate"), "total_bytes_recovered",
        F.when(F.col("total_processed") > 0, rate * 0.7 + gb * 0.3).otherwise(0.0).alias("efficiency_score"), F.greatest(candidates - F.col("total_processed"), F.lit(0)).cast("long").alias("candidates_rejected"),
    )


def scan_results(image_size: Column, scanned: Column, unique: Column, candidates: Column, seconds: Column) -> list[Column]:
    speed = F.when(seconds > 0, scanned / MB / seconds).otherwise(0.0)
    return [(image_size / MB).alias("image_size_mb"), (scanned / MB).alias("bytes_read_mb"), (unique / MB).alias("bytes_unique_mb"), candidates.alias("candidates_found"), seconds.alias("scan_time_sec"), speed.alias("avg_speed_mbps")]


def checksum(timestamp: Column, rate: Column, n_files: Column) -> Column:
    """SHA-256 of the quoted timestamp, the rate and the number of files, one after the other."""
    return F.sha2(F.concat(F.lit('"'), timestamp, F.lit('"'), rate.cast("double").cast("string"), n_files.cast("string")), 256)


def data_clusters(fragments: DataFrame) -> DataFrame:
    """Numbered clusters of fragments (image, offset, size, n_links, cyrillic, score), by offset in each image."""
    return fragments.select(
        "image", F.row_number().over(W.partitionBy("image").orderBy("offset")).alias("cluster_id"), hex_offset(F.col("offset")).alias("start_offset_hex"), hex_offset(F.col("offset") + F.col("size")).alias("end_offset_hex"),
        F.col("size").alias("size_bytes"), F.floor(F.col("size") / 1024).alias("size_kb"), F.col("n_links").alias("link_count"), F.col("cyrillic").alias("density"), F.col("score").alias("confidence"),
    )


def heatmap(found: DataFrame, total: Column, blocks: int, scanned_to: Column) -> DataFrame:
    """(block, state) of a map of `blocks` blocks: 2 where something was found, 1 scanned, 0 not yet; found: offset."""
    at = F.least(F.floor(F.col("offset") / total * blocks), F.lit(blocks - 1))
    hits = found.groupBy(at.cast("long").alias("block")).agg(F.first(scanned_to / total * blocks).alias("edge"))
    every = found.sparkSession.range(blocks).withColumnRenamed("id", "block")
    edge = found.agg(F.max(scanned_to / total * blocks).alias("all_edge"))
    joined = every.join(F.broadcast(hits), "block", "left").join(F.broadcast(edge))
    return joined.select("block", F.when(F.col("edge").isNotNull(), 2).when(F.col("block") < F.col("all_edge"), 1).otherwise(0).alias("state"))


#: Rows of a stretch, and stretches whose sums can still count: 0.9 to the power of their rows is 0 in doubles.
STRETCH, REACH = 64, 128


def throughput(events: DataFrame, key: str, order: str, mb: str, seconds: str, remaining_mb: str | None = None) -> DataFrame:
    """Speed of each step and its running average (0.9 old + 0.1 new, from the first), per key; with remaining_mb also eta,
    the seconds left at that average (null at 0).

    The average is folded over the step's own stretch of rows, from a value that stands for all rows before the stretch. That
    value is a sum over stretches, weighted by powers of 0.9; weights that are 0 in doubles end the sum."""
    now = F.when(F.col(seconds) > 0, F.col(mb) / F.col(seconds)).otherwise(0.0)
    more = [remaining_mb] if remaining_mb else []
    rn = F.row_number().over(W.partitionBy(key).orderBy(order, "current")) - 1
    steps = events.select(key, order, now.alias("current"), *more).withColumn("_rn", rn).withColumn("_stretch", F.floor(F.col("_rn") / STRETCH))
    fold = lambda values, start: F.aggregate(values, start, lambda old, new: old * 0.9 + new * 0.1)
    seeded = lambda values: fold(F.slice(values, F.lit(2), F.size(values)), F.element_at(values, 1))
    steps = steps.withColumn("_seen", F.collect_list("current").over(W.partitionBy(key, "_stretch").orderBy("_rn")))
    ends = steps.groupBy(key, "_stretch").agg(F.max_by("_seen", "_rn").alias("_all"))
    ends = ends.withColumn("_sum", F.when(F.col("_stretch") == 0, seeded(F.col("_all"))).otherwise(fold(F.col("_all"), F.lit(0.0))))
    earlier = F.collect_list("_sum").over(W.partitionBy(key).orderBy("_stretch").rowsBetween(-REACH, -1))
    ends = ends.select(key, "_stretch", F.aggregate(earlier, F.lit(0.0), lambda old, new: old * 0.9**STRETCH + new).alias("_before"))
    average = F.when(F.col("_stretch") == 0, seeded(F.col("_seen"))).otherwise(fold(F.col("_seen"), F.col("_before")))
    out = steps.join(ends, [key, "_stretch"]).select(key, order, "current", average.alias("average"), *more)
    if remaining_mb:
        out = out.withColumn("eta", F.when(F.col("average") > 0, F.col(remaining_mb) / F.col("average"))).drop(remaining_mb)
    return out


def last_entries(log: DataFrame, key: str, *order: str, n: int = 10) -> DataFrame:
    """The last n rows of each key."""
    newest = W.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def counters(chunks: DataFrame, links: DataFrame, hot: DataFrame) -> DataFrame:
    """One row of totals of a scan: bytes_scanned, links_found, hot_fragments, chunks_processed, errors."""
    c = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes_scanned"), F.count("*").alias("chunks_processed"))
    n = links.agg(F.count_if(F.col("error").isNull()).alias("links_found"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return c.join(n).join(hot.agg(F.count("*").alias("hot_fragments"))).select("bytes_scanned", "links_found", "hot_fragments", "chunks_processed", "errors")  # one row each


def completion(done: Column, total: Column) -> Column:
    """Per cent of total that is done; 0 of nothing."""
    return F.when(total > 0, done / total * 100.0).otherwise(0.0)


def hex_offset(at: Column) -> Column:
    return F.concat(F.lit("0x"), F.hex(at))


def duration(seconds: Column) -> Column:
    """HH:MM:SS."""
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, F.floor(seconds) % 60)


def kilobytes(kb: Column) -> Column:
    return kb * 1024


def megabytes(size: Column) -> Column:
    return size / MB
